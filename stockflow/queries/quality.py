"""Data-quality checks as jobs: what they return are violations, or the figures that show there are none."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockflow.demo import BREAKS, CODES, FLOWS, Frames, sql
from stockflow.functions import rules as R
from stockflow.operators import base as B
from stockflow.operators import checks as K
from stockflow.operators import hierarchy as H
from stockflow.operators import rollup as U
from stockflow.queries import query
from stockflow.queries.cubes import _CORE, _DIMENSIONS, _OUT_MEASURES, IN_DIMENSIONS, OUT_BY_GROUP, OUT_DIMENSIONS, _breakdown_sql


@query("SELECT l_returnflag AS code, count(*) AS n FROM lineitem WHERE l_returnflag NOT IN ('A', 'N') GROUP BY 1")
def unmapped_codes(f: Frames) -> DataFrame:
    """Codes in the data that a crosswalk lacks."""
    crosswalk = f.spark.createDataFrame([("A",), ("N",)], "code string")
    codes = f.table("lineitem").groupBy(F.col("l_returnflag").alias("code")).agg(F.count("*").alias("n"))
    return codes.join(F.broadcast(crosswalk), "code", "left_anti")


@query("SELECT l_returnflag AS code FROM lineitem UNION SELECT o_orderstatus FROM orders")
def code_domain(f: Frames) -> DataFrame:
    return f.table("lineitem").select(F.col("l_returnflag").alias("code")).union(f.table("orders").select("o_orderstatus")).distinct()


@query(sql("SELECT entity, month FROM base WHERE out_a + out_n + out_r <> outflow OR overlay + plain_a + plain_n + plain_r <> outflow"))
def partition_check(f: Frames) -> DataFrame:
    """Categories partition the outflow, and so do the overlay and the plain ones."""
    both = [[f"out_{c.lower()}" for c in CODES], ["overlay", *(f"plain_{c.lower()}" for c in CODES)]]
    return K.partition(f.base, {"outflow": both[0]}, ["entity", "month"]).unionByName(K.partition(f.base, {"outflow": both[1]}, ["entity", "month"])).distinct()


@query(sql("SELECT count(*) AS months, count(*) FILTER (p) AS provisional, CAST(sum(stock) AS BIGINT) AS stock, count(*) FILTER (stock <> parts) AS differ, count(*) FILTER (stock = 0) AS empty FROM (SELECT *, row_number() OVER (ORDER BY month DESC) <= 3 AS p FROM (SELECT a.month, a.stock, sum(b.stock) AS parts FROM base a JOIN base b ON b.month = a.month AND b.entity <> 'ALL' WHERE a.entity = 'ALL' GROUP BY ALL))"))
def panel_check(f: Frames) -> DataFrame:
    """Months, provisional ones, and violations: totals that the entities don't add up to, months without a stock."""
    total, parts = f.base.where("entity = 'ALL'"), f.base.where("entity <> 'ALL'")
    differ = K.sums(total, parts, ["month"], ["stock"]).agg(F.count("*").alias("differ"))
    months = total.join(F.broadcast(B.provisional(total)), "month").agg(F.count("*").alias("months"), F.count_if("provisional").alias("provisional"), F.sum("stock").alias("stock"), F.count_if(F.col("stock") == 0).alias("empty"))
    return months.crossJoin(F.broadcast(differ))


@query(sql("SELECT entity, month, 'missing' AS problem FROM (SELECT entity, month FROM base WHERE stock > 0 EXCEPT SELECT entity, effective_month FROM o2) UNION ALL SELECT entity, month, 'extra' FROM (SELECT entity, effective_month AS month FROM o2 EXCEPT SELECT entity, month FROM base WHERE stock > 0)"))
def row_set_diff(f: Frames) -> DataFrame:
    """Entities and months with a stock against those with an outflow: what only one side has."""
    flows = B.with_total(f.outflow, "effective_month", [], [F.count("*").alias("n")])
    return K.row_sets(f.base.where("stock > 0"), flows, ["entity", "month"])


_SOURCE_SQL = "SELECT l_orderkey, l_linenumber, l_returnflag AS code, CASE WHEN l_discount = 0 THEN 'REDACTED' WHEN l_discount = 0.05 THEN 'none' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS years FROM lineitem"
_PUBLISHED_SQL = "SELECT l_orderkey, l_linenumber, code, coalesce(years_text, 'none') AS years FROM all_outflow"


@query(sql(f"SELECT *, 'missing' AS problem FROM (({_SOURCE_SQL}) EXCEPT ALL ({_PUBLISHED_SQL})) UNION ALL SELECT *, 'extra' FROM (({_PUBLISHED_SQL}) EXCEPT ALL ({_SOURCE_SQL}))"))
def multiset_diff(f: Frames) -> DataFrame:
    """Published records, written and read back, against source rows, both ways, with repetitions."""
    from stockflow.sources.files import work_dir

    out = work_dir(f.spark, "records")
    f.all_outflow.select("l_orderkey", "l_linenumber", "code", "years_text").write.parquet(out)
    published = f.spark.read.parquet(out).select("l_orderkey", "l_linenumber", "code", F.coalesce("years_text", F.lit("none")).alias("years"))
    line = f.table("lineitem")
    years = F.when(F.col("l_discount") == 0, "REDACTED").when(F.col("l_discount") == 0.05, "none").otherwise(F.col("l_quantity").cast("long").cast("string"))
    source = line.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("code"), years.alias("years"))
    return K.multisets(source, published)


@query(sql("SELECT 'none' AS kind, (SELECT count(*) FROM lineitem WHERE l_discount = 0.05) AS source, (SELECT count(*) FROM all_outflow WHERE years_text IS NULL) AS published UNION ALL SELECT 'REDACTED', (SELECT count(*) FROM lineitem WHERE l_discount = 0), (SELECT count(*) FROM all_outflow WHERE years_text = 'REDACTED')"))
def record_null_counts(f: Frames) -> DataFrame:
    """How many source rows have none and a redacted value, and how many of the published ones: they must be equal."""
    d, t = F.col("l_discount"), F.col("years_text")
    source = f.table("lineitem").agg(F.count_if(d == 0.05).alias("a"), F.count_if(d == 0).alias("b"))
    published = f.all_outflow.agg(F.count_if(t.isNull()).alias("c"), F.count_if(t == "REDACTED").alias("d"))
    row = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), F.col(x).alias("source"), F.col(y).alias("published"))
    return source.crossJoin(published).select(F.inline(F.array(row("none", "a", "c"), row("REDACTED", "b", "d"))))


@query(sql("SELECT month FROM (SELECT month, lag(month) OVER (ORDER BY month) AS before FROM months) WHERE before IS NOT NULL AND month <> before + INTERVAL 1 MONTH"))
def month_gaps(f: Frames) -> DataFrame:
    """Months that don't follow the one before: windows over rows are only valid without any."""
    return K.gaps(B.months_of(f.stock))


@query(sql("SELECT month, round((stock - before) / nullif(before, 0), 4) AS change FROM (SELECT month, stock, lag(stock) OVER (ORDER BY month) AS before FROM base WHERE entity = 'ALL') WHERE abs(round((stock - before) / nullif(before, 0), 4)) > 0.02 AND month NOT IN (DATE '1997-03-01', DATE '1999-12-01')"))
def continuity_check(f: Frames) -> DataFrame:
    """Months whose stock jumps by more than 2 % and that no listed break explains."""
    return K.jumps(f.base.where("entity = 'ALL'").select("month", "stock"), "stock", 0.02, [m for _, m in BREAKS])


@query(sql("SELECT count(*) FILTER (years_text = 'REDACTED') AS raw, count(*) FILTER (coalesce(years_text = 'REDACTED', false)) AS typed, count(*) FILTER (years_text IS NULL) AS missing FROM all_outflow"))
def redaction_check(f: Frames) -> DataFrame:
    t = F.col("years_text")
    return f.all_outflow.agg(F.count_if(t == "REDACTED").alias("raw"), F.count_if(R.redacted(t)).alias("typed"), F.count_if(t.isNull()).alias("missing"))


@query(sql("SELECT field, value, missing, redacted FROM (SELECT 'years_text' AS field, count(*) FILTER (years_text <> 'REDACTED') AS value, count(*) FILTER (years_text IS NULL) AS missing, count(*) FILTER (years_text = 'REDACTED') AS redacted FROM all_outflow UNION ALL SELECT 'overlay', count(*) FILTER (overlay <> 'REDACTED'), count(*) FILTER (overlay IS NULL), count(*) FILTER (overlay = 'REDACTED') FROM all_outflow)"))
def completeness_profile(f: Frames) -> DataFrame:
    """Value, missing and redacted counts per field, in one pass."""
    fields = ["years_text", "overlay"]
    one = f.all_outflow.agg(*(x for c in fields for x in (F.count_if(F.col(c) != "REDACTED").alias(f"{c}_v"), F.count_if(F.col(c).isNull()).alias(f"{c}_m"), F.count_if(F.col(c) == "REDACTED").alias(f"{c}_r"))))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"{c}_v").alias("value"), F.col(f"{c}_m").alias("missing"), F.col(f"{c}_r").alias("redacted")) for c in fields))))


_RECORD = "file_month AS month, l_orderkey, l_linenumber, code, years_text"
_PUBLISHED = f"""SELECT {_RECORD.replace("code,", "CASE WHEN l_orderkey % 500 = 1 AND l_linenumber = 1 THEN 'X' ELSE code END AS code,")} FROM all_outflow WHERE NOT (l_orderkey % 700 = 3 AND l_linenumber = 2)
    UNION ALL SELECT {_RECORD} FROM all_outflow WHERE l_orderkey % 900 = 5 AND l_linenumber = 1"""
_COLUMNS = ["l_orderkey", "l_linenumber", "code", "years_text"]


def _records(f: Frames, planted: bool = True) -> tuple[DataFrame, DataFrame]:
    """Source records and what was published of them: some changed, some lost, some twice."""
    from stockflow.sources.files import work_dir

    source = f.all_outflow.select(F.col("file_month").alias("month"), *_COLUMNS)
    k, n, out = F.col("l_orderkey"), F.col("l_linenumber"), work_dir(f.spark, "records")
    rows = source
    if planted:
        rows = source.where(~((k % 700 == 3) & (n == 2))).withColumn("code", F.when((k % 500 == 1) & (n == 1), "X").otherwise(F.col("code")))
        rows = rows.unionByName(source.where((k % 900 == 5) & (n == 1)))
    rows.write.parquet(out)
    return source, f.spark.read.parquet(out)


@query(sql(f"SELECT *, 'missing' AS problem FROM (SELECT {_RECORD} FROM all_outflow EXCEPT ALL ({_PUBLISHED})) UNION ALL SELECT *, 'extra' FROM (({_PUBLISHED}) EXCEPT ALL SELECT {_RECORD} FROM all_outflow)"))
def multisets_by_month(f: Frames) -> DataFrame:
    """Published records against their source: changed, lost and doubled ones, looked for in the months only whose figures differ."""
    return K.multisets_by_month(*_records(f), "month", _COLUMNS)


_MONTHLY = "SELECT month, count(*) AS n, {0} FROM ({1}) GROUP BY month"
_CELLS = ", ".join(f"count(*) FILTER ({c} IS NULL) AS m_{c}, count(*) FILTER (CAST({c} AS VARCHAR) = 'REDACTED') AS r_{c}, bit_xor(hash({c})) AS x_{c}, sum(hash({c}) % 1000000007) AS l_{c}" for c in _COLUMNS)


@query(sql(f"SELECT * FROM (" + " UNION ALL ".join(f"SELECT a.month, '{c}' AS \"column\", a.n, b.n AS n_other, a.m_{c} AS missing, b.m_{c} AS missing_other, a.r_{c} AS redacted, b.r_{c} AS redacted_other FROM ({_MONTHLY.format(_CELLS, f'SELECT {_RECORD} FROM all_outflow')}) a JOIN ({_MONTHLY.format(_CELLS, _PUBLISHED)}) b USING (month) WHERE a.n <> b.n OR a.x_{c} <> b.x_{c} OR a.l_{c} <> b.l_{c}" for c in _COLUMNS) + ")"))
def differing_months(f: Frames) -> DataFrame:
    """Months and columns of the published records whose figures are not those of the source, with null and redacted counts of both."""
    return K.differing_months(*_records(f), "month", _COLUMNS).where(F.col("column") != "*")


@query(sql("SELECT entity, month FROM base WHERE years_known + years_issue <> outflow"))
def issue_balance_check(f: Frames) -> DataFrame:
    return K.partition(f.base, {"outflow": ["years_known", "years_issue"]}, ["entity", "month"])


@query(sql("""SELECT count(*) FILTER (effective_month <> file_month) AS differ, count(*) FILTER (effective_month = file_month) AS same,
    (SELECT count(*) FROM (SELECT month FROM base WHERE entity = 'ALL' AND outflow > 0 EXCEPT SELECT effective_month FROM outflow)) AS cube_only FROM all_outflow"""))
def time_basis_check(f: Frames) -> DataFrame:
    """Rows whose two months differ, and months of the cube whose flow is not that of the effective month."""
    differ = F.col("effective_month") != F.col("file_month")
    rows = f.all_outflow.agg(F.count_if(differ).alias("differ"), F.count_if(~differ).alias("same"))
    direct = f.outflow.groupBy(F.col("effective_month").alias("month")).agg(F.count("*").alias("outflow"))
    wrong = K.sums(f.base.where("entity = 'ALL'"), direct, ["month"], ["outflow"]).agg(F.count("*").alias("cube_only"))
    return rows.crossJoin(F.broadcast(wrong))


@query(sql("SELECT effective_month AS month, count(*) AS n FROM all_outflow WHERE effective_month > (SELECT last_month FROM bounds) GROUP BY 1"))
def refused_flows(f: Frames) -> DataFrame:
    """Flows effective after the last snapshot month."""
    late = f.all_outflow.join(F.broadcast(f.last_month.select("last_month")), F.col("effective_month") > F.col("last_month"))
    return late.groupBy(F.col("effective_month").alias("month")).agg(F.count("*").alias("n"))


def _unlike(whole: str, parts: str, keys: str, measures: list[str]) -> str:
    """keys, measure, value, summed: measures that two selections do not agree on."""
    each = " UNION ALL ".join(f"SELECT {keys}, '{m}' AS measure, CAST(coalesce(a.{m}, 0) AS BIGINT) AS value, CAST(coalesce(b.{m}, 0) AS BIGINT) AS summed FROM ({whole}) a FULL JOIN ({parts}) b USING ({keys})" for m in measures)
    return f"SELECT * FROM ({each}) WHERE value <> summed"


_DIRECT = """SELECT e.entity, m.month, coalesce(s.n, 0) AS stock, coalesce(i.n, 0) AS inflow, coalesce(o.n, 0) AS outflow, coalesce(o.y, 0) AS overlay FROM entities e CROSS JOIN months m LEFT JOIN (SELECT entity, month, count(*) AS n FROM s2 GROUP BY ALL) s USING (entity, month)
    LEFT JOIN (SELECT entity, effective_month AS month, count(*) AS n FROM i2 GROUP BY ALL) i USING (entity, month) LEFT JOIN (SELECT entity, effective_month AS month, count(*) AS n, count(*) FILTER (overlay = 'Y') AS y FROM o2 GROUP BY ALL) o USING (entity, month)"""
_SUMMED = "SELECT entity, month, sum(stock) AS stock, sum(inflow) AS inflow, sum(outflow) AS outflow, sum(overlay) AS overlay FROM base_by_group GROUP BY ALL"


@query(sql(_unlike(_DIRECT, _SUMMED, "entity, month", ["stock", "inflow", "outflow", "overlay"])))
def group_partition_check(f: Frames) -> DataFrame:
    """Groups add up to the core, measure by measure."""
    return K.sums(f.base, f.base_by_group, ["entity", "month"], ["stock", *FLOWS])


_FY_OUT = "SELECT o.entity, 'FY' || year(effective_month + INTERVAL 3 MONTH) AS period, d.dimension, count(*) AS flow, count(*) FILTER (code = 'A') AS out_a, count(*) FILTER (overlay = 'Y') AS overlay FROM o2 o JOIN ends e ON e.entity = o.entity AND effective_month <= end_month CROSS JOIN (VALUES ('segment'), ('nation'), ('balance'), ('years'), ('code'), ('overlay'), ('delay')) d(dimension) GROUP BY ALL"
_FY_CELLS = f"SELECT entity, period, dimension, sum(flow) AS flow, sum(out_a) AS out_a, sum(overlay) AS overlay FROM ({_breakdown_sql('o2', OUT_DIMENSIONS, _OUT_MEASURES)}) WHERE grain = 'fy' GROUP BY ALL"


@query(sql(_unlike(_FY_OUT, _FY_CELLS, "entity, period, dimension", ["flow", "out_a", "overlay"])))
def breakdown_partition_check(f: Frames) -> DataFrame:
    """The values of each dimension of the breakdown cube add up to the fiscal years' outflow, in sum and by category."""
    from stockflow.queries.cubes import cube_outflow_breakdown

    measures = ["flow", *(f"out_{c.lower()}" for c in CODES), "overlay"]
    fy = U.roll_up(B.alive(f.base), ["outflow", *measures[1:]]).where("grain = 'fy'").withColumnRenamed("outflow", "flow")
    whole = fy.select("entity", "period", F.explode(F.array(*map(F.lit, OUT_DIMENSIONS))).alias("dimension"), *measures)
    return K.sums(whole, cube_outflow_breakdown(f).where("grain = 'fy'"), ["entity", "period", "dimension"], measures)


_PLAIN_CELLS = " UNION ALL ".join(f"SELECT o.entity, {{0}} AS period, '{d}' AS dimension, {_DIMENSIONS[d][0]} AS v, count(*) AS flow FROM (SELECT o.*, end_month FROM outflow o JOIN ends USING (entity) WHERE effective_month <= end_month) o {{1}} GROUP BY ALL" for d in OUT_DIMENSIONS)
_PLAIN = f"SELECT 'fy' AS grain, * FROM ({_PLAIN_CELLS.format("'FY' || year(effective_month + INTERVAL 3 MONTH)", '')}) UNION ALL SELECT 'era', * FROM ({_PLAIN_CELLS.format('e.era', 'JOIN eras e ON effective_month BETWEEN e.first_month AND e.last_month')})"


@query(sql(_unlike(_PLAIN, f"SELECT entity, grain, period, dimension, value AS v, flow FROM ({_breakdown_sql('o2', OUT_DIMENSIONS, _OUT_MEASURES)}) WHERE grain IN ('fy', 'era') AND entity <> 'ALL'", "entity, grain, period, dimension, v", ["flow"])))
def breakdown_recomputation(f: Frames) -> DataFrame:
    """The outflow breakdown, all seven dimensions by fiscal years and eras, against plain counts of the rows."""
    from stockflow.functions.calendar import fy_key
    from stockflow.queries.cubes import _value_of, cube_outflow_breakdown

    keys = ["entity", "grain", "period", "dimension", "v"]
    cube = cube_outflow_breakdown(f).where("grain IN ('fy', 'era') AND entity <> 'ALL'").select("entity", "grain", "period", "dimension", F.col("value").alias("v"), "flow")
    cells = K.plain_cells(f.outflow, "effective_month", {d: _value_of(f, d) for d in OUT_DIMENSIONS})
    kept = cells.join(B.entity_ends(f.base), "entity").where("month <= last_month").drop("last_month")
    years = kept.select("*", F.lit("fy").alias("grain"), fy_key(F.col("month")).alias("period"))
    eras = kept.join(F.broadcast(f.eras), F.col("month").between(F.col("first_month"), F.col("last_month"))).select(*kept.columns, F.lit("era").alias("grain"), F.col("era").alias("period"))
    return K.sums(cube, years.unionByName(eras), keys, ["flow"])


_GROUP_CELLS = f"SELECT entity, grain, period, dimension, value AS v, sum(flow) AS flow FROM ({_breakdown_sql('o2', OUT_BY_GROUP, _OUT_MEASURES, 'group_code')}) GROUP BY ALL"
_WHOLE_CELLS = f"SELECT entity, grain, period, dimension, value AS v, flow FROM ({_breakdown_sql('o2', OUT_DIMENSIONS, _OUT_MEASURES)}) WHERE grain <> 't12' AND dimension <> 'segment'"


@query(sql(_unlike(_WHOLE_CELLS, _GROUP_CELLS, "entity, grain, period, dimension, v", ["flow"])))
def breakdown_group_partition_check(f: Frames) -> DataFrame:
    """The groups of the breakdown by group add up to the breakdown, cell by cell, in all windows that both have."""
    from stockflow.queries.cubes import cube_outflow_breakdown, cube_outflow_breakdown_by_group

    keys = ["entity", "grain", "period", "dimension", "v"]
    cells = lambda cube: cube.select("entity", "grain", "period", "dimension", F.col("value").alias("v"), "flow")
    whole = cells(cube_outflow_breakdown(f).where("grain <> 't12'")).where(F.col("dimension").isin(OUT_BY_GROUP))
    return K.sums(whole, cells(cube_outflow_breakdown_by_group(f)), keys, ["flow"])


_SHARES = f"SELECT entity, grain, period, dimension, sum(flow) FILTER (NOT is_unknown) AS known, min(share_den) AS den FROM ({_breakdown_sql('i2', IN_DIMENSIONS, {})}) WHERE is_share GROUP BY ALL"


@query(sql(f"SELECT entity, grain, period, dimension FROM ({_SHARES}) WHERE abs(known / nullif(den, 0) - 1) > 0.000001 OR (den IS NULL) <> (known = 0)"))
def share_sum_check(f: Frames) -> DataFrame:
    """Windows and dimensions of the inflow breakdown whose known shares do not add up to 1."""
    from stockflow.queries.cubes import cube_inflow_breakdown

    return K.share_sums(cube_inflow_breakdown(f), ["entity", "grain", "period", "dimension"])


_RUN_AGAIN = "SELECT r.entity, r.era, r.n, r.month, r.stock, r.run_inflow, r.run_outflow, (SELECT sum(b.inflow) FROM base b JOIN eras e ON e.era = r.era WHERE b.entity = r.entity AND b.month BETWEEN e.first_month AND r.month) AS again_in, (SELECT sum(b.outflow) FROM base b JOIN eras e ON e.era = r.era WHERE b.entity = r.entity AND b.month BETWEEN e.first_month AND r.month) AS again_out FROM running r"


@query(sql(f"SELECT entity, 'all' AS group_code, era, n, 'flow' AS problem FROM ({_RUN_AGAIN}) WHERE run_inflow <> again_in OR run_outflow <> again_out"))
def era_check(f: Frames) -> DataFrame:
    """The era cube against the months it runs over, and its groups against all."""
    from stockflow.queries.cubes import _ERA_FLOWS, cube_era

    return K.eras(cube_era(f), B.alive(f.base_all_groups), _ERA_FLOWS)


@query(sql(" UNION ALL ".join(f"SELECT entity, grain, period FROM ({_CORE}) WHERE rate_{m}_small IS DISTINCT FROM (rate_{m}_den < 30) OR rate_{m}_den <= 0" for m in "abc")))
def small_base_check(f: Frames) -> DataFrame:
    """Small-base flags of the core cube's three rates are those of their denominators."""
    from stockflow.queries.cubes import cube_core

    cube, keys = cube_core(f), ["entity", "grain", "period"]
    a, b, c = (K.small_bases(cube, f"rate_{m}_den", f"rate_{m}_small", keys) for m in "abc")
    return a.unionByName(b).unionByName(c)


@query("SELECT fiscal_year, CAST(month AS VARCHAR) AS month FROM (VALUES ('FY1998', DATE '1997-03-01')) t(fiscal_year, month)")
def break_year_check(f: Frames) -> DataFrame:
    """Listed breaks whose month lies in another fiscal year than they say: one is planted, the breaks of the data are right."""
    from stockflow.functions.calendar import fy_key

    years = f.month_flags.select("month")
    listed = f.spark.createDataFrame([*BREAKS, ("FY1998", "1997-03-01")], "fiscal_year string, m string").select("fiscal_year", F.to_date("m").alias("month"))
    return K.breaks(listed.join(years, "month"), fy_key(F.col("month")))


@query(sql(f"SELECT entity, why FROM (SELECT entity, 'flows after its end' AS why FROM base GROUP BY entity HAVING max(month) FILTER (inflow > 0 OR outflow > 0) > max(month) FILTER (stock > 0 AND NOT (entity = 'ASIA' AND month > DATE '2000-06-01')))"))
def entity_end_check(f: Frames) -> DataFrame:
    """Entities with flows after their last month of stock (one is cut here)."""
    cut = (F.col("entity") == "ASIA") & (F.col("month") > F.lit("2000-06-01").cast("date"))
    return B.refused_ends(f.base.withColumn("stock", F.when(cut, 0).otherwise(F.col("stock"))))


@query(sql("SELECT effective_month AS month, code FROM inflow WHERE code NOT IN (SELECT code FROM hierarchy) GROUP BY ALL"))
def overlap_partition_check(f: Frames) -> DataFrame:
    """Months and codes that no node of the hierarchy has."""
    return f.inflow.join(f.hierarchy.select("code"), "code", "left_anti").select(F.col("effective_month").alias("month"), "code").distinct()


@query(sql("SELECT strftime(month, '%Y-%m') AS month, n AS listed, n AS present, true AS same_size FROM (SELECT order_month AS month, count(*) AS n FROM ordered GROUP BY 1)"))
def manifest_reconciliation(f: Frames) -> DataFrame:
    """A manifest's rows and file sizes, as JSON, against the files that are really there."""
    from stockflow.functions.calendar import month_key
    from stockflow.sources.files import work_dir

    out, listing = work_dir(f.spark, "months"), work_dir(f.spark, "manifest")
    keyed = f.orders.select("o_orderkey", month_key(F.col("order_month")).alias("month"))
    keyed.repartition("month").write.partitionBy("month").parquet(out)
    read = lambda: f.spark.read.schema("o_orderkey long, month string").parquet(out).select("month", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("size")).groupBy("month", "file", "size").agg(F.count("*").alias("n"))
    keyed.groupBy("month").agg(F.count("*").alias("listed")).join(read().groupBy("month").agg(F.sum("size").alias("bytes")), "month").write.json(listing)
    there = read().groupBy("month").agg(F.sum("n").alias("present"), F.sum("size").alias("size"))
    listed = f.spark.read.schema("month string, listed long, bytes long").json(listing)
    return listed.join(there, "month", "full_outer").select("month", "listed", "present", F.col("bytes").eqNullSafe(F.col("size")).alias("same_size"))


_NODE_COUNTS = "SELECT entity, effective_month AS month, node, count(*) AS n FROM i2 JOIN hierarchy USING (code) GROUP BY ALL"


@query(sql(f"""SELECT * FROM (SELECT p.entity, p.month, p.node, d.level, 'n' AS measure, p.n AS value, CAST(coalesce(c.summed, 0) AS BIGINT) AS summed
    FROM (SELECT * FROM ({_NODE_COUNTS}) WHERE node <> 'all' UNION ALL SELECT entity, effective_month, 'all', count(*) FROM i2 GROUP BY ALL) p
    JOIN (SELECT l.node, count(a.ancestor) AS level FROM links l LEFT JOIN above a ON a.node = l.node GROUP BY l.node) d ON d.node = p.node
    LEFT JOIN (SELECT x.entity, x.month, l.parent, sum(x.n) AS summed FROM ({_NODE_COUNTS}) x JOIN links l ON l.node = x.node GROUP BY ALL) c ON c.entity = p.entity AND c.month = p.month AND c.parent = p.node
    WHERE p.node IN (SELECT parent FROM links)) WHERE value <> summed"""))
def hierarchy_proof(f: Frames) -> DataFrame:
    """Level by level, parents whose children do not add up to them. The whole is all inflow here, whose codes without a node are no child of it: the violations are these."""
    keys = ["month", "entity"]
    nodes = B.with_total(f.inflow.join(f.hierarchy.select("code", "node"), "code"), "effective_month", ["node"], [F.count("*").alias("n")])
    whole = B.with_total(f.inflow, "effective_month", [], [F.count("*").alias("n")]).withColumn("node", F.lit("all"))
    return H.partition(nodes.where("node <> 'all'").unionByName(whole), f.links, keys, ["n"]).select("entity", "month", "node", "level", "measure", "value", "summed")


_PLACES_SQL = """SELECT n_name AS node, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'WORLD' FROM region UNION ALL SELECT 'WORLD', NULL"""


def _places(f: Frames) -> DataFrame:
    """node, parent: nations below regions below the world."""
    r = f.table("region").select("r_regionkey", "r_name")
    nations = f.table("nation").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("node"), F.col("r_name").alias("parent"))
    regions = r.select(F.col("r_name").alias("node"), F.lit("WORLD").alias("parent"))
    return nations.unionByName(regions).unionByName(f.spark.createDataFrame([("WORLD", None)], "node string, parent string"))


@query(f"""WITH RECURSIVE p AS ({_PLACES_SQL}), above AS (SELECT node, parent AS ancestor, 1 AS distance FROM p WHERE parent IS NOT NULL UNION ALL SELECT a.node, p.parent, a.distance + 1 FROM above a JOIN p ON p.node = a.ancestor WHERE p.parent IS NOT NULL)
    SELECT a.ancestor AS node, a.distance, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM above a JOIN nation ON n_name = a.node JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""")
def hierarchy_closure(f: Frames) -> DataFrame:
    """Customers and their balance in all places above their nation, by the closure of (node, parent) links."""
    c = f.table("customer").join(f.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("node"), "c_acctbal")
    return c.join(H.closure(_places(f)), "node").groupBy(F.col("ancestor").alias("node"), "distance").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query(f"""WITH RECURSIVE p AS (SELECT node, CASE WHEN node = 'ASIA' THEN 'CHINA' WHEN node = 'KENYA' THEN 'ATLANTIS' ELSE parent END AS parent FROM ({_PLACES_SQL}) UNION ALL SELECT 'PERU', 'EUROPE'),
    above AS (SELECT node, parent AS ancestor FROM p WHERE parent IS NOT NULL UNION SELECT a.node, p.parent FROM above a JOIN p ON p.node = a.ancestor WHERE p.parent IS NOT NULL)
    SELECT node, 'cycle' AS problem FROM above WHERE node = ancestor UNION ALL SELECT node, 'orphan' FROM p WHERE parent NOT IN (SELECT node FROM p) UNION ALL SELECT node, 'two parents' FROM p GROUP BY node HAVING count(DISTINCT coalesce(parent, '')) > 1""")
def hierarchy_problems(f: Frames) -> DataFrame:
    """Places with a cycle, an orphan and a second parent planted: each is reported."""
    moved = F.when(F.col("node") == "ASIA", "CHINA").when(F.col("node") == "KENYA", "ATLANTIS").otherwise(F.col("parent"))
    planted = _places(f).withColumn("parent", moved).unionByName(f.spark.createDataFrame([("PERU", "EUROPE")], "node string, parent string"))
    return H.problems(planted)


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS code, 'listed twice' AS problem FROM nation WHERE n_nationkey = 3 UNION ALL SELECT DISTINCT CAST(c_nationkey AS VARCHAR), 'not listed' FROM customer WHERE c_nationkey = 7""")
def crosswalk_check(f: Frames) -> DataFrame:
    """A crosswalk of nations with one code listed twice and one left out (both planted), against the customers' codes."""
    n = f.table("nation").select(F.col("n_nationkey").cast("string").alias("code"))
    planted = n.where("code <> '7'").unionByName(n.where("code = '3'"))
    return K.crosswalk_problems(planted, f.table("customer").select(F.col("c_nationkey").cast("string").alias("code")))


@query(sql("SELECT month, CASE WHEN month = DATE '1997-03-01' THEN 'net flow' ELSE 'stock' END AS problem FROM months WHERE month IN (DATE '1997-03-01', DATE '1998-05-01')"))
def panel_basis_check(f: Frames) -> DataFrame:
    """The panel's net flow against in minus out, and its stock against the snapshots' counts: one of each is planted."""
    at = lambda m: F.col("month") == F.lit(m).cast("date")
    panel = f.base.where("entity = 'ALL'").select("month", (F.col("stock") + at("1998-05-01").cast("int")).alias("stock"), "inflow", "outflow", (F.col("inflow") - F.col("outflow") + at("1997-03-01").cast("int")).alias("net_flow"))
    return K.panel_basis(panel, f.stock.groupBy("month").agg(F.count("*").alias("stock")))
