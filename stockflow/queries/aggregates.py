"""Counts, partitions, grids, rollups and windows over the monthly base."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockflow.demo import BREAKS, CODES, FLOWS, Frames, sql
from stockflow.functions import calendar as C
from stockflow.operators import base as B
from stockflow.operators import rollup as R
from stockflow.queries import query


@query(sql("SELECT month, count(*) AS stock FROM stock GROUP BY month"))
def stock_by_month(f: Frames) -> DataFrame:
    return f.stock.groupBy("month").agg(F.count("*").alias("stock"))


@query(sql("SELECT month, outflow, out_a, out_n, out_r, overlay, plain_a, plain_n, plain_r FROM base WHERE entity = 'ALL' AND outflow > 0"))
def partition_counts(f: Frames) -> DataFrame:
    """Categories partition the total; the overlay cuts across, and with the plain ones partitions it too."""
    return f.outflow.groupBy(F.col("effective_month").alias("month")).agg(*B.flow_counts(CODES))


@query(sql("SELECT effective_month AS month, count(*) FILTER (code IN ('1', '2', '3')) AS pressing, count(*) FILTER (code = '1') AS type_1, count(*) FILTER (code = '2') AS type_2, count(*) FILTER (code = '3') AS type_3 FROM inflow GROUP BY 1"))
def subtype_counts(f: Frames) -> DataFrame:
    """A second partition inside one category."""
    pressing = F.count_if(F.col("code").isin("1", "2", "3")).alias("pressing")
    return f.inflow.groupBy(F.col("effective_month").alias("month")).agg(pressing, *B.categories("code", ["1", "2", "3"], "type"))


@query(sql("SELECT month, entity, count(*) AS stock FROM s2 GROUP BY ALL"))
def grouping_sets_total(f: Frames) -> DataFrame:
    return B.with_total(f.stock, "month", [], [F.count("*").alias("stock")])


@query(sql("SELECT month, entity, group_code, count(*) AS stock FROM s2 GROUP BY ALL"))
def grouping_sets_by_group(f: Frames) -> DataFrame:
    return B.with_total(f.stock, "month", ["group_code"], [F.count("*").alias("stock")])


@query(sql("SELECT month, entity, count(*) AS stock FROM stock GROUP BY ALL UNION ALL SELECT month, 'ALL', count(*) FROM stock GROUP BY month"))
def union_total(f: Frames) -> DataFrame:
    parts = f.stock.groupBy("month", "entity").agg(F.count("*").alias("stock"))
    return parts.unionByName(parts.groupBy("month").agg(F.sum("stock").alias("stock")).withColumn("entity", F.lit("ALL")))


@query(sql("SELECT entity, month, years_sum, years_known, years_issue, round(years_known / nullif(outflow, 0), 4) AS coverage FROM base"))
def coverage_sum(f: Frames) -> DataFrame:
    return f.base.select("entity", "month", "years_sum", "years_known", "years_issue", R.rated(F.col("years_known"), F.col("outflow")).alias("coverage"))


@query(sql("""SELECT m.month, s.n AS stock, coalesce(i.n, 0) AS inflow, coalesce(o.outflow, 0) AS outflow, coalesce(i.n, 0) - coalesce(o.outflow, 0) AS net_flow, coalesce(o.overlay, 0) AS overlay, coalesce(o.a, 0) AS out_a, coalesce(o.n, 0) AS out_n, coalesce(o.r, 0) AS out_r,
        coalesce(o.pa, 0) AS plain_a, coalesce(o.pn, 0) AS plain_n, coalesce(o.pr, 0) AS plain_r, row_number() OVER (ORDER BY m.month DESC) <= 3 AS provisional
    FROM months m JOIN (SELECT month, count(*) AS n FROM stock GROUP BY 1) s USING (month) LEFT JOIN (SELECT effective_month AS month, count(*) AS n FROM inflow GROUP BY 1) i USING (month)
    LEFT JOIN (SELECT effective_month AS month, count(*) AS outflow, count(*) FILTER (overlay = 'Y') AS overlay, count(*) FILTER (code = 'A') AS a, count(*) FILTER (code = 'N') AS n, count(*) FILTER (code = 'R') AS r,
        count(*) FILTER (code = 'A' AND overlay IS NULL) AS pa, count(*) FILTER (code = 'N' AND overlay IS NULL) AS pn, count(*) FILTER (code = 'R' AND overlay IS NULL) AS pr FROM outflow GROUP BY 1) o USING (month)"""))
def monthly_panel(f: Frames) -> DataFrame:
    """One row for each snapshot month: stock, flows, net flow, the outflow's partitions and overlay, and whether it is provisional."""
    month = F.col("effective_month").alias("month")
    s = f.stock.groupBy("month").agg(F.count("*").alias("stock"))
    i = f.inflow.groupBy(month).agg(F.count("*").alias("inflow"))
    o = f.outflow.groupBy(month).agg(*B.flow_counts(CODES))
    panel = B.filled(s.join(i, "month", "left").join(o, "month", "left"), ["month"])
    return panel.withColumn("net_flow", F.col("inflow") - F.col("outflow")).join(F.broadcast(B.provisional(B.months_of(f.stock))), "month")


@query(sql("SELECT entity, month, stock, inflow, outflow FROM base"))
def dense_grid(f: Frames) -> DataFrame:
    return f.base.select("entity", "month", "stock", "inflow", "outflow")


@query(sql("SELECT * FROM base"))
def monthly_base(f: Frames) -> DataFrame:
    return f.base


@query(sql("SELECT entity, max(month) FILTER (stock > 0) AS last_month FROM base GROUP BY entity"))
def entity_end(f: Frames) -> DataFrame:
    return B.entity_ends(f.base)


#: One region's records end early here, with and without going on at 0.
_CUT = "SELECT * REPLACE (CASE WHEN entity = 'ASIA' AND month > DATE '2000-06-01' THEN 0 ELSE stock END AS stock) FROM base"


def _cut(f: Frames) -> DataFrame:
    ended = (F.col("entity") == "ASIA") & (F.col("month") > F.lit("2000-06-01").cast("date"))
    return f.base.withColumn("stock", F.when(ended, 0).otherwise(F.col("stock")))


@query(sql(f"SELECT b.entity, b.month, b.stock FROM ({_CUT}) b JOIN (SELECT entity, max(month) FILTER (stock > 0) AS last FROM ({_CUT}) GROUP BY 1) e USING (entity) WHERE b.month <= e.last OR b.entity = 'EUROPE'"))
def entity_that_ends(f: Frames) -> DataFrame:
    return B.within_life(_cut(f), ["EUROPE"]).select("entity", "month", "stock")


@query(sql(f"SELECT b.entity, b.month, b.stock FROM ({_CUT}) b JOIN (SELECT entity, max(month) FILTER (stock > 0) AS last FROM ({_CUT}) GROUP BY 1) e USING (entity) WHERE b.month <= e.last OR b.entity = 'ASIA'"))
def continued_at_zero(f: Frames) -> DataFrame:
    return B.within_life(_cut(f), ["ASIA"]).select("entity", "month", "stock")


@query(sql("SELECT month, row_number() OVER (ORDER BY month DESC) <= 3 AS provisional FROM months"))
def provisional_months(f: Frames) -> DataFrame:
    return B.provisional(B.months_of(f.stock))


@query(sql("SELECT string_agg(strftime(month, '%Y-%m'), ',' ORDER BY month) AS provisional FROM (SELECT month FROM months ORDER BY month DESC LIMIT 3)"))
def provisional_list(f: Frames) -> DataFrame:
    newest = B.provisional(B.months_of(f.stock)).where("provisional")
    return newest.agg(F.array_join(F.sort_array(F.collect_list(C.month_key(F.col("month")))), ",").alias("provisional"))


@query(sql("SELECT entity, grain, period, last_month, stock, months, expected, partial FROM rolled"))
def rollup_stock(f: Frames) -> DataFrame:
    return R.roll_up(f.base, []).drop("mean_stock")


@query(sql("SELECT entity, grain, period, inflow, outflow, inflow - outflow AS net_flow FROM rolled"))
def rollup_flow(f: Frames) -> DataFrame:
    return R.roll_up(f.base, ["inflow", "outflow"]).select("entity", "grain", "period", "inflow", "outflow", (F.col("inflow") - F.col("outflow")).alias("net_flow"))


@query(sql("SELECT * FROM rolled"))
def all_grains(f: Frames) -> DataFrame:
    return R.roll_up(f.base, FLOWS)


@query(sql("SELECT entity, grain, period, stock, stock - lag(stock) OVER (PARTITION BY entity, grain ORDER BY last_month) AS stock_change FROM rolled"))
def stock_change(f: Frames) -> DataFrame:
    return R.stock_change(R.roll_up(f.base, [])).select("entity", "grain", "period", "stock", "stock_change")


@query(sql("SELECT entity, grain, period, months < rolled.expected AS partial, bool_or(p.provisional) AS provisional, bool_or(p.reissued) AS reissued FROM rolled JOIN bridge b USING (grain, period) JOIN month_flags p ON p.month = b.month GROUP BY ALL"))
def period_flags(f: Frames) -> DataFrame:
    """Flags of periods: an OR over their months."""
    p = F.broadcast(C.bridge(f.month_flags.select("month")).join(f.month_flags, "month"))
    flags = [F.bool_or(c).alias(c) for c in ("provisional", "reissued")]
    return f.base.join(p, "month").groupBy("entity", "grain", "period").agg((F.count("*") < F.max("expected")).alias("partial"), *flags)


_T = "SELECT entity, month, outflow, CASE WHEN count(*) OVER w = 12 THEN CAST(sum(outflow) OVER w AS BIGINT) END AS t_flow, CASE WHEN count(*) OVER w = 12 THEN round(avg(stock) OVER w, 4) END AS t_mean FROM base WINDOW w AS (PARTITION BY entity ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"


@query(sql(_T))
def trailing_12(f: Frames) -> DataFrame:
    return R.trailing(f.base, "outflow").select("entity", "month", "outflow", "t_flow", "t_mean")


@query(sql(f"SELECT r.entity, r.grain, r.period, t.t_flow, t.t_mean, round(t.t_flow / nullif(t.t_mean, 0), 4) AS rate FROM rolled r JOIN ({_T}) t ON t.entity = r.entity AND t.month = r.last_month"))
def rate_method_a(f: Frames) -> DataFrame:
    """The trailing year of a period's last month, taken along in the rollup."""
    t = R.trailing(f.base, "outflow")
    p = F.broadcast(C.bridge(B.months_of(f.stock)))
    r = t.join(p, "month").groupBy("entity", "grain", "period").agg(F.max_by("t_flow", "month").alias("t_flow"), F.max_by("t_mean", "month").alias("t_mean"))
    return r.withColumn("rate", R.rated(F.col("t_flow"), F.col("t_mean")))


@query(sql("SELECT entity, period, outflow, mean_stock, round(outflow / nullif(mean_stock, 0), 4) AS rate, partial AS year_to_date FROM rolled WHERE grain = 'fy'"))
def rate_method_b(f: Frames) -> DataFrame:
    r = R.roll_up(f.base, ["outflow"]).where("grain = 'fy'")
    return r.select("entity", "period", "outflow", "mean_stock", R.rated(F.col("outflow"), F.col("mean_stock")).alias("rate"), F.col("partial").alias("year_to_date"))


@query(sql("SELECT entity, grain, period, round(outflow * 12.0::DOUBLE / months / nullif(mean_stock, 0), 4) AS rate FROM rolled"))
def rate_method_c(f: Frames) -> DataFrame:
    r = R.roll_up(f.base, ["outflow"])
    return r.select("entity", "grain", "period", R.rated(F.col("outflow") * 12.0 / F.col("months"), F.col("mean_stock")).alias("rate"))


@query(sql("SELECT entity, grain, period, CASE WHEN mean_stock > 0 THEN outflow END AS rate_num, CASE WHEN mean_stock > 0 THEN mean_stock END AS rate_den, CASE WHEN mean_stock > 0 THEN round(outflow / mean_stock, 4) END AS rate, CASE WHEN mean_stock > 0 THEN mean_stock < 30 END AS small_base FROM rolled"))
def rate_guards(f: Frames) -> DataFrame:
    return R.roll_up(f.base, ["outflow"]).select("entity", "grain", "period", *R.guarded(F.col("outflow"), F.col("mean_stock")))


@query(sql("SELECT entity, grain, period, round(outflow / nullif(mean_stock, 0), 4) AS rate_outflow, round(out_a / nullif(mean_stock, 0), 4) AS rate_out_a, round(out_r / nullif(mean_stock, 0), 4) AS rate_out_r, round(inflow / nullif(mean_stock, 0), 4) AS rate_inflow FROM rolled"))
def rate_family(f: Frames) -> DataFrame:
    """Numerators that share one denominator."""
    flows = ["outflow", "out_a", "out_r", "inflow"]
    return R.roll_up(f.base, flows).select("entity", "grain", "period", *(R.rated(F.col(x), F.col("mean_stock")).alias(f"rate_{x}") for x in flows))


@query(sql("""SELECT r.*, inflow - outflow AS net_flow, stock - lag(stock) OVER (PARTITION BY entity, grain ORDER BY last_month) AS stock_change, round(years_known / nullif(outflow, 0), 4) AS coverage, k.provisional, k.reissued, k.files
    FROM rolled r JOIN (SELECT grain, period, bool_or(provisional) AS provisional, bool_or(reissued) AS reissued, string_agg(tag, ',' ORDER BY month) AS files FROM bridge JOIN month_flags USING (month) GROUP BY ALL) k USING (grain, period)"""))
def period_rollup(f: Frames) -> DataFrame:
    """Stocks, flows, net flow, change, coverage, and each period's flags and file tags."""
    r = R.stock_change(R.roll_up(f.base, FLOWS))
    r = r.withColumn("net_flow", F.col("inflow") - F.col("outflow")).withColumn("coverage", R.rated(F.col("years_known"), F.col("outflow")))
    p = C.bridge(f.month_flags.select("month")).join(f.month_flags, "month")
    marks = p.groupBy("grain", "period").agg(*(F.bool_or(c).alias(c) for c in ("provisional", "reissued")), F.array_join(F.sort_array(F.collect_list("tag")), ",").alias("files"))
    return r.join(F.broadcast(marks), ["grain", "period"])


@query(sql("SELECT count(*) / count(DISTINCT month) AS mean_stock FROM stock"))
def mean_stock_distinct(f: Frames) -> DataFrame:
    return f.stock.agg((F.count("*") / F.countDistinct("month")).alias("mean_stock"))


@query(sql("SELECT grain, period, max(last_month) AS last_month FROM rolled GROUP BY ALL"))
def period_list(f: Frames) -> DataFrame:
    r = R.roll_up(f.base, [])
    return r.groupBy("grain", "period").agg(F.max("last_month").alias("last_month")).orderBy(F.desc("last_month"))


@query(sql("SELECT DISTINCT entity, group_code FROM base_by_group WHERE stock > 0 OR inflow > 0 OR outflow > 0"))
def present_pairs(f: Frames) -> DataFrame:
    some = F.max(F.greatest("stock", "inflow", "outflow"))
    return f.base_by_group.groupBy("entity", "group_code").agg(some.alias("n")).where("n > 0").select("entity", "group_code")


@query(sql("""SELECT entity, era, r.month, n, run_inflow, run_outflow, run_mean, bool_or(k.provisional) AS run_provisional, bool_or(k.reissued) AS run_reissued FROM running r JOIN eras e USING (era)
    JOIN month_flags k ON k.month BETWEEN e.first_month - INTERVAL 1 MONTH AND r.month GROUP BY ALL"""))
def era_running(f: Frames) -> DataFrame:
    """Running flows, mean stock and flags; the month before an era counts among its reissued ones."""
    e = F.broadcast(f.eras.select("era", F.add_months("first_month", -1).alias("month_0"), F.col("last_month").alias("end")))
    run = Window.partitionBy("era").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    flags = f.month_flags.join(e, F.col("month").between(F.col("month_0"), F.col("end")))
    flags = flags.select("era", "month", F.bool_or("provisional").over(run).alias("run_provisional"), F.bool_or("reissued").over(run).alias("run_reissued"))
    r = R.running(f.base, f.eras, ["inflow", "outflow"]).select("entity", "era", "month", "n", "run_inflow", "run_outflow", "run_mean")
    return r.join(F.broadcast(flags), ["era", "month"])


@query(sql("SELECT entity, era, n, round(run_outflow * 12.0::DOUBLE / n / nullif(run_mean, 0), 4) AS rate FROM running"))
def era_rates(f: Frames) -> DataFrame:
    r = R.running(f.base, f.eras, ["outflow"])
    return r.select("entity", "era", "n", R.rated(F.col("run_outflow") * 12.0 / F.col("n"), F.col("run_mean")).alias("rate"))


@query(sql("SELECT entity, era, n, stock, stock_0, stock - stock_0 AS change, CASE WHEN stock_0 >= 30 THEN round((stock - stock_0) / stock_0, 4) END AS percent, stock_0 < 30 AS small_base FROM running"))
def era_change(f: Frames) -> DataFrame:
    r = R.running(f.base, f.eras, [])
    small = F.col("stock_0") < R.SMALL
    return r.select("entity", "era", "n", "stock", "stock_0", "change", F.when(~small, R.rated(F.col("change"), F.col("stock_0"))).alias("percent"), small.alias("small_base"))


@query(sql("SELECT entity, month, stock, stock - lag(stock, 12) OVER w AS change_12, round((stock - lag(stock, 12) OVER w) / nullif(lag(stock, 12) OVER w, 0), 4) AS percent_12 FROM base WINDOW w AS (PARTITION BY entity ORDER BY month)"))
def change_12(f: Frames) -> DataFrame:
    w = Window.partitionBy("entity").orderBy("month")
    before = F.lag("stock", 12).over(w)
    return f.base.select("entity", "month", "stock", (F.col("stock") - before).alias("change_12"), R.rated(F.col("stock") - before, before).alias("percent_12"))


@query(sql("SELECT entity, arg_max(stock, month) - coalesce(any_value(before), arg_min(stock, month)) AS change FROM (SELECT b.entity, b.month, b.stock, z.stock AS before FROM base b LEFT JOIN base z ON z.entity = b.entity AND z.month = DATE '1996-12-01' WHERE b.month BETWEEN DATE '1997-01-01' AND DATE '1998-12-01') GROUP BY entity"))
def change_range(f: Frames) -> DataFrame:
    """Change over a range: from the row before it, or its first row where there is none."""
    inside = F.col("month").between(F.lit("1997-01-01").cast("date"), F.lit("1998-12-01").cast("date"))
    before = F.col("month") == F.lit("1996-12-01").cast("date")
    first = F.coalesce(F.max(F.when(before, F.col("stock"))), F.min_by(F.when(inside, F.col("stock")), F.when(inside, F.col("month"))))
    return f.base.groupBy("entity").agg((F.max_by(F.when(inside, F.col("stock")), F.when(inside, F.col("month"))) - first).alias("change"))


_CUT_FY = f"SELECT entity, 'FY' || fy AS period, arg_max(stock, c.month) AS stock FROM ({_CUT} UNION ALL BY NAME SELECT * REPLACE ('NEW' AS entity) FROM base WHERE entity = 'ASIA' AND month >= DATE '1998-01-01') c JOIN fiscal USING (month) GROUP BY ALL"


@query(sql(f"SELECT r.entity, r.period, round(r.stock / nullif(b.stock, 0), 4) AS growth, coalesce(b.stock, 0) = 0 AS no_base FROM ({_CUT_FY}) r LEFT JOIN ({_CUT_FY}) b ON b.entity = r.entity AND b.period = 'FY1996' WHERE r.period >= 'FY1996'"))
def growth_index(f: Frames) -> DataFrame:
    """Stock as a multiple of the base year's; entities without a stock then are listed, with no growth."""
    new = f.base.where("entity = 'ASIA' AND month >= DATE '1998-01-01'").withColumn("entity", F.lit("NEW"))
    fy = R.roll_up(_cut(f).unionByName(new), []).where("grain = 'fy' AND period >= 'FY1996'").select("entity", "period", "stock")
    start = F.max(F.when(F.col("period") == "FY1996", F.col("stock"))).over(Window.partitionBy("entity"))
    fy = fy.withColumn("start", start)
    return fy.select("entity", "period", R.rated(F.col("stock"), F.col("start")).alias("growth"), (F.coalesce("start", F.lit(0)) == 0).alias("no_base"))


@query(sql("SELECT entity, period, stock - lag(stock) OVER w AS stock_change, inflow - outflow AS net_flow, abs(coalesce(stock - lag(stock) OVER w, 0) - (inflow - outflow)) > 500 AS gap, abs(coalesce(stock - lag(stock) OVER w, 0) - (inflow - outflow)) > 500 AND period NOT IN ('FY1997', 'FY2000') AS unlisted FROM rolled WHERE grain = 'fy' WINDOW w AS (PARTITION BY entity ORDER BY last_month)"))
def reconciliation_fy(f: Frames) -> DataFrame:
    r = R.stock_change(R.roll_up(f.base, ["inflow", "outflow"]).where("grain = 'fy'"))
    net = F.col("inflow") - F.col("outflow")
    gap = F.abs(F.coalesce("stock_change", F.lit(0)) - net) > 500
    listed = F.broadcast(f.spark.createDataFrame(BREAKS, "period string, m string").select("period", F.lit(True).alias("listed")))
    return r.join(listed, "period", "left").select("entity", "period", "stock_change", net.alias("net_flow"), gap.alias("gap"), (gap & F.col("listed").isNull()).alias("unlisted"))
