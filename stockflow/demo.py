"""Stock and flow frames from the star-schema tables (orders, lineitem, customer, nation, region).

An entity is a region. The stock of a month is its customers with an order in it; an order is an inflow; a line is an
outflow, effective when shipped and processed in the month of its order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.functions.calendar import month_of
from stockflow.functions.rules import Issue, Rule, group_or_other
from stockflow.operators import base as B
from stockflow.operators import hierarchy as H

CODES = ["A", "N", "R"]
FLOWS = ["inflow", "outflow", "out_a", "out_n", "out_r", "overlay", "plain_a", "plain_n", "plain_r", "years_sum", "years_known", "years_issue"]
LISTED = ["AUTOMOBILE", "BUILDING", "MACHINERY"]
ISSUE = Issue("1997-06-01", "1998-01-01", 48, 50)
ERAS = [("e1", "1996-01-01", "1998-12-01"), ("e2", "1999-01-01", None)]
LATE = 997
BREAKS = [("FY1997", "1997-03-01"), ("FY2000", "1999-12-01")]
YEARS = [Rule("0-9", "range", 0, 10), Rule("10-19", "range", 10, 20), Rule("20-29", "range", 20, 30), Rule("30+", "range", 30), Rule("Unknown", "unknown")]
#: Nodes of overlapping groups with their parent and place in lists, and the node of each code; a code counts in all nodes above its own.
LINKS = [("all", None, 1), ("urgent", "all", 2), ("urgent-top", "urgent", 3), ("urgent-high", "urgent", 4), ("normal", "all", 5)]
NODE_OF = [("1", "urgent-top"), ("2", "urgent-high"), ("3", "normal"), ("5", "normal")]


@dataclass
class Frames:
    """The frames of one data directory."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def members(self) -> DataFrame:
        """o_custkey with entity, group_code, segment, nation and balance: customers with their region; nations and regions are 25 and 5 rows by design."""
        nations = self.table("nation").join(F.broadcast(self.table("region")), F.col("n_regionkey") == F.col("r_regionkey"))
        c = self.table("customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
        return c.select(F.col("c_custkey").alias("o_custkey"), F.col("r_name").alias("entity"), F.col("c_mktsegment").alias("segment"), group_or_other(F.col("c_mktsegment"), LISTED).alias("group_code"), F.col("n_name").alias("nation"), F.col("c_acctbal").alias("balance"))

    @cached_property
    def orders(self) -> DataFrame:
        o = self.table("orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), month_of("o_orderdate").alias("order_month"))
        return o.join(self.members, "o_custkey")

    @cached_property
    def stock(self) -> DataFrame:
        present = self.table("orders").select("o_custkey", month_of("o_orderdate").alias("month")).distinct()
        return present.join(self.members, "o_custkey").withColumnRenamed("o_custkey", "member")

    @cached_property
    def inflow(self) -> DataFrame:
        return self.orders.select(F.col("order_month").alias("effective_month"), F.col("order_month").alias("file_month"), "entity", F.substring("o_orderpriority", 1, 1).alias("code"), "group_code", "segment", "nation", "balance", "status", "price", "o_orderpriority")

    @cached_property
    def all_outflow(self) -> DataFrame:
        line = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("long").alias("years"), "l_discount", month_of("l_shipdate").alias("effective_month"))
        out = line.join(self.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        text = F.when(F.col("l_discount") == 0, "REDACTED").when(F.col("l_discount") != 0.05, F.col("years").cast("string"))
        return out.select("l_orderkey", "l_linenumber", "l_partkey", "effective_month", F.col("order_month").alias("file_month"), "entity", F.col("l_returnflag").alias("code"), F.when(F.col("l_linestatus") == "O", "Y").alias("overlay"), "years", text.alias("years_text"), "group_code", "segment", "nation", "balance")

    @cached_property
    def last_month(self) -> DataFrame:
        return self.table("orders").agg(month_of_max("o_orderdate", F.max).alias("last_month"), month_of_max("o_orderdate", F.min).alias("first_month"))

    @cached_property
    def outflow(self) -> DataFrame:
        """Outflows effective in the months of the stock."""
        return self.all_outflow.join(F.broadcast(self.last_month), F.col("effective_month").between(F.col("first_month"), F.col("last_month"))).drop("first_month", "last_month")

    @property
    def issue(self) -> Column:
        return ISSUE.hits(F.col("file_month"), F.col("years"))

    @cached_property
    def months(self) -> DataFrame:
        """The months of the stock, from one column of the orders."""
        return self.table("orders").select(month_of("o_orderdate").alias("month")).distinct()

    @cached_property
    def base(self) -> DataFrame:
        return B.monthly_base(self.stock, self.inflow, self.outflow, CODES, self.issue, months=self.months)

    @cached_property
    def base_by_group(self) -> DataFrame:
        return B.monthly_base(self.stock, self.inflow, self.outflow, CODES, self.issue, ["group_code"], self.months)

    @cached_property
    def base_all_groups(self) -> DataFrame:
        """The base of each group that an entity has, and of group 'all': their sums, from the same counts."""
        return B.all_groups(self.base_by_group, "group_code")

    @cached_property
    def month_flags(self) -> DataFrame:
        """month, provisional, reissued and tag of each month's file: reissued where it has more rows than the manifest before listed.

        The manifest before has no orders that came late (every 997th key).
        """
        n = self.table("orders").groupBy(month_of("o_orderdate").alias("month")).agg(F.count("*").alias("size"), F.count_if(F.col("o_orderkey") % LATE != 0).alias("size_before"))
        version = F.when(F.col("size") != F.col("size_before"), 2).otherwise(1)
        newest = B.provisional(n)
        return n.join(newest, "month").select("month", "provisional", (version > 1).alias("reissued"), F.concat(F.date_format("month", "yyyy-MM"), F.lit(" v"), version).alias("tag"))

    @cached_property
    def links(self) -> DataFrame:
        return self.spark.createDataFrame(LINKS, "node string, parent string, place int")

    @cached_property
    def hierarchy(self) -> DataFrame:
        """code, node, level, parent, place: each code in its node and those above, by the links' closure."""
        codes = self.spark.createDataFrame(NODE_OF, "code string, node string")
        return H.membership(codes, self.links).join(H.levels(self.links).join(self.links.select("node", "place"), "node"), "node").select("code", "node", F.col("level").cast("int").alias("level"), "parent", "place")

    @cached_property
    def eras(self) -> DataFrame:
        """era, first_month, last_month: an open era ends with the stock."""
        e = self.spark.createDataFrame(ERAS, "era string, first_month string, last_month string")
        last = self.last_month.select(F.col("last_month").alias("latest"))
        return e.crossJoin(F.broadcast(last)).select("era", F.to_date("first_month").alias("first_month"), F.coalesce(F.to_date("last_month"), "latest").alias("last_month"), F.col("last_month").isNull().alias("open"))


def month_of_max(c: str, f) -> Column:
    return F.to_date(F.trunc(f(c), "MM"))


#: The same frames for DuckDB, in the other style: plain counts by entity and for the total, joined by UNION ALL.
PRELUDE = """
links AS (SELECT * FROM (VALUES {links}) v(node, parent, place)),
node_of AS (SELECT * FROM (VALUES {node_of}) v(code, node)),
above AS (SELECT node, parent AS ancestor, 1 AS distance FROM links WHERE parent IS NOT NULL UNION ALL SELECT a.node, l.parent, a.distance + 1 FROM above a JOIN links l ON l.node = a.ancestor WHERE l.parent IS NOT NULL),
hierarchy AS (SELECT c.code, l.node, CAST((SELECT count(*) FROM above a WHERE a.node = l.node) AS INTEGER) AS level, l.parent, l.place FROM node_of c JOIN links l ON l.node = c.node OR l.node IN (SELECT ancestor FROM above a WHERE a.node = c.node)),
members AS (SELECT c_custkey, r_name AS entity, c_mktsegment AS segment, n_name AS nation, c_acctbal AS balance,
    CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY') THEN c_mktsegment ELSE 'other' END AS group_code
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
ordered AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus AS status, o_totalprice AS price, CAST(date_trunc('month', o_orderdate) AS DATE) AS order_month, m.* FROM orders JOIN members m ON o_custkey = c_custkey),
stock AS (SELECT DISTINCT order_month AS month, entity, o_custkey AS member, group_code, segment, nation, balance FROM ordered),
inflow AS (SELECT order_month AS effective_month, order_month AS file_month, entity, substr(o_orderpriority, 1, 1) AS code, group_code, segment, nation, balance, status, price, o_orderpriority FROM ordered),
bounds AS (SELECT min(month) AS first_month, max(month) AS last_month FROM stock),
all_outflow AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS effective_month, order_month AS file_month, entity, l_returnflag AS code,
    CASE WHEN l_linestatus = 'O' THEN 'Y' END AS overlay, CAST(l_quantity AS BIGINT) AS years,
    CASE WHEN l_discount = 0 THEN 'REDACTED' WHEN l_discount <> 0.05 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS years_text, group_code, segment, nation, balance,
    order_month BETWEEN DATE '1997-06-01' AND DATE '1998-01-01' AND l_quantity BETWEEN 48 AND 50 AS issue
    FROM lineitem JOIN ordered ON l_orderkey = o_orderkey),
outflow AS (SELECT o.* FROM all_outflow o, bounds b WHERE effective_month BETWEEN b.first_month AND b.last_month),
entities AS (SELECT DISTINCT entity FROM stock UNION ALL SELECT 'ALL'),
months AS (SELECT DISTINCT month FROM stock),
groups AS (SELECT DISTINCT group_code FROM stock),
s2 AS (SELECT * FROM stock UNION ALL SELECT * REPLACE ('ALL' AS entity) FROM stock),
i2 AS (SELECT * FROM inflow UNION ALL SELECT * REPLACE ('ALL' AS entity) FROM inflow),
o2 AS (SELECT * FROM outflow UNION ALL SELECT * REPLACE ('ALL' AS entity) FROM outflow),
ocount AS (SELECT entity, effective_month AS month, group_code, count(*) AS outflow, count(*) FILTER (code = 'A') AS out_a, count(*) FILTER (code = 'N') AS out_n, count(*) FILTER (code = 'R') AS out_r,
    count(*) FILTER (overlay = 'Y') AS overlay, count(*) FILTER (code = 'A' AND overlay IS DISTINCT FROM 'Y') AS plain_a, count(*) FILTER (code = 'N' AND overlay IS DISTINCT FROM 'Y') AS plain_n,
    count(*) FILTER (code = 'R' AND overlay IS DISTINCT FROM 'Y') AS plain_r, sum(years) FILTER (NOT issue) AS years_sum, count(years) FILTER (NOT issue) AS years_known, count(*) FILTER (issue) AS years_issue
    FROM o2 GROUP BY ALL),
base_by_group AS (SELECT e.entity, m.month, e.group_code, coalesce(s.n, 0) AS stock, coalesce(i.n, 0) AS inflow, coalesce(o.outflow, 0) AS outflow, coalesce(out_a, 0) AS out_a, coalesce(out_n, 0) AS out_n, coalesce(out_r, 0) AS out_r,
    coalesce(overlay, 0) AS overlay, coalesce(plain_a, 0) AS plain_a, coalesce(plain_n, 0) AS plain_n, coalesce(plain_r, 0) AS plain_r, CAST(coalesce(years_sum, 0) AS BIGINT) AS years_sum, coalesce(years_known, 0) AS years_known, coalesce(years_issue, 0) AS years_issue
    FROM (SELECT entity, group_code FROM s2 UNION SELECT entity, group_code FROM i2 UNION SELECT entity, group_code FROM o2) e CROSS JOIN months m
    LEFT JOIN (SELECT entity, month, group_code, count(*) AS n FROM s2 GROUP BY ALL) s ON s.entity = e.entity AND s.month = m.month AND s.group_code = e.group_code
    LEFT JOIN (SELECT entity, effective_month AS month, group_code, count(*) AS n FROM i2 GROUP BY ALL) i ON i.entity = e.entity AND i.month = m.month AND i.group_code = e.group_code
    LEFT JOIN ocount o ON o.entity = e.entity AND o.month = m.month AND o.group_code = e.group_code),
base AS (SELECT entity, month, CAST(sum(stock) AS BIGINT) AS stock, CAST(sum(inflow) AS BIGINT) AS inflow, CAST(sum(outflow) AS BIGINT) AS outflow, CAST(sum(out_a) AS BIGINT) AS out_a, CAST(sum(out_n) AS BIGINT) AS out_n, CAST(sum(out_r) AS BIGINT) AS out_r,
    CAST(sum(overlay) AS BIGINT) AS overlay, CAST(sum(plain_a) AS BIGINT) AS plain_a, CAST(sum(plain_n) AS BIGINT) AS plain_n, CAST(sum(plain_r) AS BIGINT) AS plain_r, CAST(sum(years_sum) AS BIGINT) AS years_sum, CAST(sum(years_known) AS BIGINT) AS years_known, CAST(sum(years_issue) AS BIGINT) AS years_issue
    FROM base_by_group GROUP BY ALL),
fiscal AS (SELECT month, year(month + INTERVAL 3 MONTH) AS fy, quarter(month + INTERVAL 3 MONTH) AS fq FROM months),
bridge AS (SELECT 'month' AS grain, strftime(month, '%Y-%m') AS period, month, 1::BIGINT AS expected FROM fiscal
    UNION ALL SELECT 'quarter', 'FY' || fy || 'Q' || fq, month, 3 FROM fiscal UNION ALL SELECT 'fy', 'FY' || fy, month, 12 FROM fiscal),
rolled AS (SELECT entity, grain, period, max(month) AS last_month, arg_max(stock, month) AS stock, round(avg(stock), 4) AS mean_stock, CAST(sum(inflow) AS BIGINT) AS inflow, CAST(sum(outflow) AS BIGINT) AS outflow,
    CAST(sum(out_a) AS BIGINT) AS out_a, CAST(sum(out_n) AS BIGINT) AS out_n, CAST(sum(out_r) AS BIGINT) AS out_r, CAST(sum(overlay) AS BIGINT) AS overlay, CAST(sum(plain_a) AS BIGINT) AS plain_a, CAST(sum(plain_n) AS BIGINT) AS plain_n, CAST(sum(plain_r) AS BIGINT) AS plain_r,
    CAST(sum(years_sum) AS BIGINT) AS years_sum, CAST(sum(years_known) AS BIGINT) AS years_known, CAST(sum(years_issue) AS BIGINT) AS years_issue, count(*) AS months, max(expected) AS expected, count(*) < max(expected) AS partial
    FROM base JOIN bridge USING (month) GROUP BY ALL),
eras AS (SELECT 'e1' AS era, DATE '1996-01-01' AS first_month, DATE '1998-12-01' AS last_month, false AS open UNION ALL SELECT 'e2', DATE '1999-01-01', last_month, true FROM bounds),
month_flags AS (SELECT order_month AS month, row_number() OVER (ORDER BY order_month DESC) <= 3 AS provisional, count(*) FILTER (o_orderkey % 997 = 0) > 0 AS reissued,
    strftime(order_month, '%Y-%m') || CASE WHEN count(*) FILTER (o_orderkey % 997 = 0) > 0 THEN ' v2' ELSE ' v1' END AS tag FROM ordered GROUP BY order_month),
ends AS (SELECT entity, max(month) FILTER (stock > 0) AS end_month FROM base GROUP BY entity),
running AS (SELECT b.entity, b.month, e.era, e.open, b.stock, row_number() OVER w AS n, CAST(sum(inflow) OVER w AS BIGINT) AS run_inflow, CAST(sum(outflow) OVER w AS BIGINT) AS run_outflow, round(avg(stock) OVER w, 4) AS run_mean,
    (SELECT z.stock FROM base z WHERE z.entity = b.entity AND z.month = e.first_month - INTERVAL 1 MONTH) AS stock_0
    FROM base b JOIN eras e ON b.month BETWEEN e.first_month AND e.last_month
    WINDOW w AS (PARTITION BY b.entity, e.era ORDER BY b.month ROWS UNBOUNDED PRECEDING))
"""


def _rows(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in r) + ")" for r in rows)


def sql(select: str) -> str:
    """A DuckDB query over the prelude's frames."""
    prelude = PRELUDE.strip().replace("{links}", _rows(LINKS)).replace("{node_of}", _rows(NODE_OF))
    return f"WITH RECURSIVE {prelude}\n{select.strip()}"
