"""Query-time algebra on cube rows: ratios, guarded sums, combinations, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockflow.demo import Frames, sql
from stockflow.operators import algebra as A
from stockflow.operators import base as B
from stockflow.operators import rollup as R
from stockflow.queries import query


def _rolled(f: Frames, *flows: str) -> DataFrame:
    return R.roll_up(f.base, list(flows))


@query(sql("SELECT entity, grain, period, round(outflow / nullif(stock, 0), 4) AS ratio FROM rolled"))
def safe_ratio(f: Frames) -> DataFrame:
    return _rolled(f, "outflow").select("entity", "grain", "period", R.rated(F.col("outflow"), F.col("stock")).alias("ratio"))


@query(sql("SELECT grain, round(sum(outflow) / sum(mean_stock), 4) AS ratio FROM rolled WHERE entity <> 'ALL' GROUP BY grain"))
def ratio_of_sums(f: Frames) -> DataFrame:
    return _rolled(f, "outflow").where("entity <> 'ALL'").groupBy("grain").agg(R.rated(F.sum("outflow"), F.sum("mean_stock")).alias("ratio"))


@query(sql("SELECT entity, grain, period, out_a + out_n AS total FROM rolled"))
def sum_columns(f: Frames) -> DataFrame:
    return _rolled(f, "out_a", "out_n").select("entity", "grain", "period", (F.col("out_a") + F.col("out_n")).alias("total"))


@query(sql("SELECT grain, period, CAST(sum(outflow) AS BIGINT) AS value, CAST(NULL AS VARCHAR) AS refused FROM rolled WHERE entity IN ('ASIA', 'EUROPE') GROUP BY ALL"))
def guarded_sum(f: Frames) -> DataFrame:
    return A.sum_entities(_rolled(f, "outflow"), "outflow", ["ASIA", "EUROPE"])


@query(sql("SELECT grain, period, CAST(NULL AS BIGINT) AS value, 'total and part' AS refused FROM rolled WHERE entity IN ('ASIA', 'ALL') GROUP BY ALL"))
def guarded_sum_refused(f: Frames) -> DataFrame:
    return A.sum_entities(_rolled(f, "outflow"), "outflow", ["ASIA", "ALL"])


@query(sql("SELECT entity, count(*) AS periods, CAST(sum(outflow) AS BIGINT) AS value FROM rolled WHERE grain = 'month' AND last_month BETWEEN DATE '1997-01-01' AND DATE '1997-12-01' GROUP BY entity"))
def sum_across_periods(f: Frames) -> DataFrame:
    m = _rolled(f, "outflow").where("grain = 'month' AND last_month BETWEEN DATE '1997-01-01' AND DATE '1997-12-01'")
    return A.sum_periods(A.kinds(m, outflow="flow", stock="stock"), "outflow", ["entity"])


_VALUES = "SELECT entity, year(effective_month + INTERVAL 3 MONTH) AS fy, code AS value, count(*) AS n FROM o2 GROUP BY ALL"


@query(sql(f"SELECT entity, fy, 'ok' AS chosen, CAST(sum(n) AS BIGINT) AS value, CAST(NULL AS VARCHAR) AS refused FROM ({_VALUES}) WHERE value IN ('A', 'R') GROUP BY ALL HAVING count(*) = 2 UNION ALL SELECT entity, fy, 'bad', NULL, 'missing' FROM ({_VALUES}) WHERE value = 'A' GROUP BY ALL"))
def sum_across_values(f: Frames) -> DataFrame:
    """The chosen values of one dimension, each once; refused where one is missing, repeated, or unknown."""
    from stockflow.functions.calendar import fiscal_year

    n = B.with_total(f.outflow.withColumn("fy", fiscal_year(F.col("effective_month")).cast("long")), "fy", ["code"], [F.count("*").alias("n")]).withColumnRenamed("month", "fy").withColumnRenamed("code", "value")
    good, bad = A.sum_values(n, "n", ["A", "R"], ["entity", "fy"]), A.sum_values(n, "n", ["A", "X"], ["entity", "fy"])
    return good.where("refused IS NULL").withColumn("chosen", F.lit("ok")).unionByName(bad.withColumn("chosen", F.lit("bad"))).select("entity", "fy", "chosen", F.col("total").alias("value"), "refused")


_AGO = "date_diff('month', month, (SELECT last_month FROM bounds))"


@query(sql(f"""SELECT entity, CAST(sum(outflow) FILTER ({_AGO} < 12) AS BIGINT) AS last_12, CAST(sum(outflow) FILTER ({_AGO} BETWEEN 12 AND 23) AS BIGINT) AS prior_12,
    round(sum(outflow) FILTER ({_AGO} < 12) / nullif(avg(stock) FILTER ({_AGO} < 12), 0), 4) AS rate_12, round(sum(outflow) FILTER ({_AGO} BETWEEN 12 AND 23) / nullif(avg(stock) FILTER ({_AGO} BETWEEN 12 AND 23), 0), 4) AS rate_before FROM base GROUP BY entity"""))
def tiles_12(f: Frames) -> DataFrame:
    """The last twelve months and the twelve before: flows and their rates."""
    b = f.base.join(F.broadcast(f.last_month.select(F.col("last_month").alias("newest")))).withColumn("ago", F.months_between("newest", "month"))
    now, before = F.col("ago") < 12, F.col("ago").between(12, 23)
    part = lambda w: (F.sum(F.when(w, F.col("outflow"))), F.avg(F.when(w, F.col("stock"))))
    (n, m), (n0, m0) = part(now), part(before)
    return b.groupBy("entity").agg(n.alias("last_12"), n0.alias("prior_12"), R.rated(n, m).alias("rate_12"), R.rated(n0, m0).alias("rate_before"))


@query(sql("SELECT entity, period, round(plain_a / nullif(outflow, 0), 4) AS share_a, round(plain_n / nullif(outflow, 0), 4) AS share_n, round(plain_r / nullif(outflow, 0), 4) AS share_r, round(overlay / nullif(outflow, 0), 4) AS share_overlay FROM rolled WHERE grain = 'fy'"))
def reason_shares(f: Frames) -> DataFrame:
    parts = ["plain_a", "plain_n", "plain_r", "overlay"]
    r = _rolled(f, "outflow", *parts).where("grain = 'fy'")
    return r.select("entity", "period", *(R.rated(F.col(p), F.col("outflow")).alias("share_" + p.removeprefix("plain_")) for p in parts))


@query(sql("SELECT entity, period, stock, stock - lag(stock) OVER w AS stock_change, round((stock - lag(stock) OVER w) / nullif(lag(stock) OVER w, 0), 4) AS percent, inflow, outflow, round(outflow / nullif(mean_stock, 0), 4) AS rate FROM rolled WHERE grain = 'fy' WINDOW w AS (PARTITION BY entity ORDER BY last_month)"))
def comparison_table(f: Frames) -> DataFrame:
    r = R.stock_change(_rolled(f, "inflow", "outflow").where("grain = 'fy'"))
    return r.select("entity", "period", "stock", "stock_change", R.rated(F.col("stock_change"), F.col("stock") - F.col("stock_change")).alias("percent"), "inflow", "outflow", R.rated(F.col("outflow"), F.col("mean_stock")).alias("rate"))


_YEARLY = "SELECT entity, 'fy' AS grain, period, outflow FROM rolled WHERE grain = 'fy' UNION ALL SELECT entity, 't12', strftime(month, '%Y-%m'), CAST(sum(outflow) OVER w AS BIGINT) FROM base WINDOW w AS (PARTITION BY entity ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER w = 12"


@query(sql(f"SELECT a.entity, a.grain, a.period, a.outflow, b.outflow AS outflow_before FROM ({_YEARLY}) a LEFT JOIN ({_YEARLY}) b ON b.entity = a.entity AND b.grain = a.grain AND b.period = CASE a.grain WHEN 'fy' THEN 'FY' || (CAST(substr(a.period, 3) AS INTEGER) - 1) ELSE (CAST(substr(a.period, 1, 4) AS INTEGER) - 1) || substr(a.period, 5) END"))
def prior_year_snapshot(f: Frames) -> DataFrame:
    """Fiscal years and trailing twelve months beside those of a year before."""
    from stockflow.functions.calendar import month_key

    fy = _rolled(f, "outflow").where("grain = 'fy'").select("entity", "grain", "period", "outflow")
    t = R.trailing(f.base, "outflow").where("t_flow IS NOT NULL").select("entity", F.lit("t12").alias("grain"), month_key(F.col("month")).alias("period"), F.col("t_flow").alias("outflow"))
    r, p = fy.unionByName(t), F.col("period")
    nxt = F.when(F.col("grain") == "fy", F.concat(F.lit("FY"), F.substring(p, 3, 4).cast("int") + 1)).otherwise(F.concat(F.substring(p, 1, 4).cast("int") + 1, F.substring(p, 5, 3)))
    return r.join(r.select("entity", "grain", nxt.alias("period"), F.col("outflow").alias("outflow_before")), ["entity", "grain", "period"], "left")


_LATEST = "SELECT entity, max(month) FILTER (stock > 0) AS last_month, arg_max(stock, month) AS stock FROM (SELECT * REPLACE (CASE WHEN entity = 'AFRICA' AND month > DATE '2000-06-01' THEN 0 ELSE stock END AS stock) FROM base WHERE entity <> 'ALL') GROUP BY entity"


@query(sql(f"SELECT entity, stock, last_month < (SELECT last_month FROM bounds) AND stock = 0 AS ended, CASE WHEN stock > 0 THEN row_number() OVER (PARTITION BY stock > 0 ORDER BY stock DESC, entity) END AS place, strftime(last_month, '%Y-%m') AS last_month FROM ({_LATEST})"))
def entity_ranking(f: Frames) -> DataFrame:
    """Current entities by their latest stock; ended ones (one is cut here) apart, without a place."""
    from stockflow.functions.calendar import month_key

    cut = (F.col("entity") == "AFRICA") & (F.col("month") > F.lit("2000-06-01").cast("date"))
    b = f.base.where("entity <> 'ALL'").withColumn("stock", F.when(cut, 0).otherwise(F.col("stock")))
    latest = b.groupBy("entity").agg(F.max(F.when(F.col("stock") > 0, F.col("month"))).alias("last"), F.max_by("stock", "month").alias("stock")).crossJoin(F.broadcast(f.last_month.select("last_month")))
    now = F.col("stock") > 0
    place = F.row_number().over(Window.partitionBy(now).orderBy(F.desc("stock"), "entity")).cast("long")
    return latest.select("entity", "stock", ((F.col("last") < F.col("last_month")) & ~now).alias("ended"), F.when(now, place).alias("place"), month_key(F.col("last")).alias("last_month"))


@query(sql("SELECT entity, rate, (SELECT round(outflow / mean_stock, 4) FROM rolled WHERE entity = 'ALL' AND period = 'FY2000') AS total_rate, row_number() OVER (ORDER BY rate DESC, entity) AS place FROM (SELECT entity, round(outflow / nullif(mean_stock, 0), 4) AS rate FROM rolled WHERE period = 'FY2000' AND entity <> 'ALL') WHERE rate IS NOT NULL"))
def rate_ranking(f: Frames) -> DataFrame:
    r = _rolled(f, "outflow").where("period = 'FY2000'").select("entity", R.rated(F.col("outflow"), F.col("mean_stock")).alias("rate"))
    total = r.where("entity = 'ALL'").select(F.col("rate").alias("total_rate"))
    parts = r.where("entity <> 'ALL' AND rate IS NOT NULL").withColumn("place", F.row_number().over(Window.orderBy(F.desc("rate"), "entity")).cast("long"))
    return parts.crossJoin(F.broadcast(total)).select("entity", "rate", "total_rate", "place")


@query(sql("SELECT entity, era, n, stock FROM running WHERE n % 6 = 0 OR n = 20"))
def months_shown(f: Frames) -> DataFrame:
    return R.running(f.base, f.eras, []).where("n % 6 = 0 OR n = 20").select("entity", "era", "n", "stock")


@query(sql("SELECT r.entity, r.era, r.n, r.stock, r.run_outflow, r.n = least(o.n, 48) AS at_n, r.n = w.n AS whole_window FROM running r, (SELECT max(n) AS n FROM running WHERE open) o, (SELECT era, max(n) AS n FROM running GROUP BY era) w WHERE w.era = r.era AND (r.n = least(o.n, 48) OR r.n = w.n)"))
def era_at_n(f: Frames) -> DataFrame:
    """Each era's row at N, the open era's months (48 at most), and that of its whole window."""
    r = R.running(f.base, f.eras, ["outflow"])
    months = B.months_of(f.stock).join(F.broadcast(f.eras), F.col("month").between(F.col("first_month"), F.col("last_month"))).groupBy("era").agg(F.count("*").alias("whole"), F.bool_or("open").alias("is_open"))
    ns = months.withColumn("at", F.least(F.max(F.when(F.col("is_open"), F.col("whole"))).over(Window.partitionBy(F.lit(1))), F.lit(48))).select("era", "whole", "at")
    rows = r.join(F.broadcast(ns), "era").where("n = at OR n = whole")
    return rows.select("entity", "era", "n", "stock", "run_outflow", (F.col("n") == F.col("at")).alias("at_n"), (F.col("n") == F.col("whole")).alias("whole_window"))


@query(sql("SELECT r.entity, r.era, r.n, round((r.stock - r.stock_0) / nullif(r.stock_0, 0), 4) AS percent FROM running r JOIN (SELECT entity, max(n) AS n FROM running WHERE open GROUP BY 1) o ON r.entity = o.entity AND r.n = o.n"))
def era_at_point(f: Frames) -> DataFrame:
    r = R.running(f.base, f.eras, [])
    n = r.where("open").groupBy("entity").agg(F.max("n").alias("n"))
    return r.join(n, ["entity", "n"]).select("entity", "era", "n", R.rated(F.col("change"), F.col("stock_0")).alias("percent"))


_OWN = "SELECT entity, count(*) AS own_n FROM base, eras WHERE open AND month BETWEEN eras.first_month AND eras.last_month AND NOT (entity = 'ASIA' AND month > DATE '2000-06-01') GROUP BY entity"


@query(sql(f"SELECT entity, own_n, max(CASE WHEN era = 'e1' THEN run_outflow END) AS e1, max(CASE WHEN era = 'e2' THEN run_outflow END) AS e2 FROM running JOIN ({_OWN}) USING (entity) WHERE n = own_n GROUP BY ALL"))
def entity_era_table(f: Frames) -> DataFrame:
    """Each entity's eras at its own N: the months that the open era has for it (one entity is cut here)."""
    kept = ~((F.col("entity") == "ASIA") & (F.col("month") > F.lit("2000-06-01").cast("date")))
    r = R.running(f.base.where(kept), f.eras, ["outflow"])
    own = F.max(F.when(F.col("open"), F.col("n"))).over(Window.partitionBy("entity"))
    return r.withColumn("own_n", own).where("n = own_n").groupBy("entity", "own_n").pivot("era", ["e1", "e2"]).agg(F.max("run_outflow"))


@query(sql("SELECT entity, era, n, stock FROM running UNION ALL SELECT DISTINCT entity, era, 0, stock_0 FROM running"))
def era_line(f: Frames) -> DataFrame:
    """Months 1 to N with the month before the era as month 0."""
    r = R.running(f.base, f.eras, [])
    return r.select("entity", "era", "n", "stock").unionByName(r.where("n = 1").select("entity", "era", F.lit(0).cast("long").alias("n"), F.col("stock_0").alias("stock")))


@query(sql("SELECT b.grain, b.period, e.era, count(*) AS months, round(count(*) / max(b.expected), 4) AS part FROM bridge b JOIN eras e ON b.month BETWEEN e.first_month AND e.last_month GROUP BY ALL"))
def era_period_overlap(f: Frames) -> DataFrame:
    from stockflow.functions.calendar import bridge

    p = bridge(B.months_of(f.stock)).join(F.broadcast(f.eras), F.col("month").between(F.col("first_month"), F.col("last_month")))
    return p.groupBy("grain", "period", "era").agg(F.count("*").alias("months"), R.rated(F.count("*"), F.max("expected")).alias("part"))


@query(sql("SELECT entity, grain, period, years_sum, years_known, round(years_sum / nullif(years_known, 0), 1) AS mean_years, round(years_known / nullif(outflow, 0), 4) AS coverage FROM rolled"))
def years_lost(f: Frames) -> DataFrame:
    r = _rolled(f, "years_sum", "years_known", "outflow")
    return r.select("entity", "grain", "period", "years_sum", "years_known", R.rated(F.col("years_sum"), F.col("years_known"), 1).alias("mean_years"), R.rated(F.col("years_known"), F.col("outflow")).alias("coverage"))


@query(sql("SELECT e.entity, m.month, coalesce(b.stock, 0) = 0 AND coalesce(b.inflow, 0) = 0 AND coalesce(b.outflow, 0) = 0 AS no_staff FROM entities e CROSS JOIN months m LEFT JOIN base b ON b.entity = e.entity AND b.month = m.month"))
def no_staff(f: Frames) -> DataFrame:
    return f.base.select("entity", "month", ((F.col("stock") == 0) & (F.col("inflow") == 0) & (F.col("outflow") == 0)).alias("no_staff"))
