"""The published cubes and what is read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockflow.demo import BREAKS, CODES, FLOWS, YEARS, Frames, sql
from stockflow.functions.calendar import fy_key
from stockflow.functions.rules import Rule, assigned
from stockflow.operators import base as B
from stockflow.operators import combine as C
from stockflow.operators import rollup as R
from stockflow.plans import cubes as P
from stockflow.plans import full as X
from stockflow.queries import query
from stockflow.sources.files import work_dir


def _stored(cube: DataFrame, name: str) -> DataFrame:
    """The cube written and read back: what is left of it is what the file says."""
    out = work_dir(cube.sparkSession, name)
    cube.write.parquet(out)
    return cube.sparkSession.read.parquet(out)


_FLOWS_SQL = ", ".join(f"CAST(sum({x}) AS BIGINT) AS {x}" for x in FLOWS)
#: Numerators of rates by name: all outflow, two of its categories, and inflow.
RATES = {"out": "outflow", "a": "out_a", "r": "out_r", "in": "inflow"}


def _nums(name: str, ok: str, of: str) -> str:
    return ", ".join(f"CASE WHEN {ok} THEN {of.format(c)} END AS rate_{r}_{name}_num" for r, c in RATES.items())


def _core_sql(source: str, k: str) -> str:
    """The core cube of a base with keys ``k``, the trailing months by a join of the base with itself."""
    same = " AND ".join(f"y.{c} = z.{c}" for c in k.split(", "))
    a, b = "tm = 12 AND tmean > 0", "grain = 'fy' AND mean > 0"
    return f"""SELECT {k}, grain, period, CAST(year(last_month + INTERVAL 3 MONTH) AS BIGINT) AS fiscal_year, first_month, last_month, expected AS months_in_period, months, provisional, months < expected AS partial, reissued, has_break, files,
        stock, stock - lag(stock) OVER (PARTITION BY {k}, grain ORDER BY last_month) AS stock_change, {", ".join(FLOWS)}, inflow - outflow AS net_flow, round(years_known / nullif(outflow, 0), 4) AS coverage,
        {_nums("a", a, "t_{0}")}, CASE WHEN {a} THEN round(tmean, 4) END AS rate_a_den, CASE WHEN tm = 12 THEN tm END AS rate_a_months, CASE WHEN {a} THEN tmean < 30 END AS rate_a_small,
        {_nums("b", b, "{0}")}, CASE WHEN {b} THEN round(mean, 4) END AS rate_b_den, CASE WHEN grain = 'fy' THEN months END AS rate_b_months, CASE WHEN {b} THEN mean < 30 END AS rate_b_small,
        {_nums("c", "mean > 0", "round({0} * 12.0::DOUBLE / months, 4)")}, CASE WHEN mean > 0 THEN round(mean, 4) END AS rate_c_den, months AS rate_c_months, CASE WHEN mean > 0 THEN mean < 30 END AS rate_c_small
    FROM (SELECT {k}, grain, period, min(month) AS first_month, max(month) AS last_month, arg_max(stock, month) AS stock, avg(stock) AS mean, count(*) AS months, max(expected) AS expected, {_FLOWS_SQL},
            bool_or(provisional) AS provisional, bool_or(reissued) AS reissued, bool_or(month IN (DATE '1997-03-01', DATE '1999-12-01')) AS has_break, string_agg(tag, ',' ORDER BY month) AS files
        FROM ({source}) JOIN bridge USING (month) JOIN month_flags USING (month) GROUP BY ALL) r
    JOIN (SELECT {", ".join(f"z.{c}" for c in k.split(", "))}, z.month AS last_month, count(*) AS tm, avg(y.stock) AS tmean, {", ".join(f"CAST(sum(y.{c}) AS BIGINT) AS t_{c}" for c in RATES.values())}
        FROM ({source}) z JOIN ({source}) y ON {same} AND y.month BETWEEN z.month - INTERVAL 11 MONTH AND z.month GROUP BY ALL) t USING ({k}, last_month)"""


def _breaks(f: Frames) -> DataFrame:
    return f.spark.createDataFrame(BREAKS, "fiscal_year string, m string").select(F.to_date("m").alias("month"))


@query(sql(_core_sql("SELECT base.* FROM base JOIN ends USING (entity) WHERE month <= end_month", "entity")))
def cube_core(f: Frames) -> DataFrame:
    return X.core_cube(B.alive(f.base), f.month_flags, _breaks(f), FLOWS, RATES)


_CORE = _core_sql("SELECT base.* FROM base JOIN ends USING (entity) WHERE month <= end_month", "entity")


def _rates_sql(name: str, kind: str) -> str:
    den = f"rate_{name}_den"
    nums = ", ".join(f"CAST(sum(rate_{r}_{name}_num) FILTER ({den} IS NOT NULL) AS {kind}) AS rate_{r}_{name}_num" for r in RATES)
    return f"{nums}, sum({den}) AS {den}, max(rate_{name}_months) AS rate_{name}_months, sum({den}) < 30 AS rate_{name}_small"


def _added(*names: str) -> str:
    return ", ".join(f"CASE WHEN count(*) = count({c}) THEN CAST(sum({c}) AS BIGINT) END AS {c}" for c in names)


_COMBINED_CORE = f"""SELECT grain, period, max(fiscal_year) AS fiscal_year, min(first_month) AS first_month, max(last_month) AS last_month, max(months_in_period) AS months_in_period, max(months) AS months, bool_or(provisional) AS provisional, bool_or(partial) AS partial,
    bool_or(reissued) AS reissued, bool_or(has_break) AS has_break, max(files) AS files, {_added("stock", "stock_change", *FLOWS, "net_flow")}, round(sum(years_known) / nullif(sum(outflow), 0), 4) AS coverage,
    {_rates_sql("a", "BIGINT")}, {_rates_sql("b", "BIGINT")}, {_rates_sql("c", "DOUBLE")}, CAST(count(*) AS INTEGER) AS entities FROM ({_CORE}) WHERE entity IN ('AFRICA', 'AMERICA') GROUP BY grain, period"""


@query(sql(_COMBINED_CORE))
def combine_entities(f: Frames) -> DataFrame:
    """Two entities combined from the stored core cube by the kinds that its file carries: what adds, what is ORed, and which ratios are made anew from their parts."""
    return C.combine(_stored(cube_core(f), "core-cube"), ["AFRICA", "AMERICA"])


@query(sql(f"""SELECT 'none' AS route, grain, period, stock, outflow, rate_out_a_num, rate_a_den, 1 AS entities FROM ({_CORE}) WHERE entity = 'ALL' UNION ALL SELECT 'one', grain, period, stock, outflow, rate_out_a_num, rate_a_den, 1 FROM ({_CORE}) WHERE entity = 'ASIA'
    UNION ALL SELECT 'several', grain, period, stock, outflow, rate_out_a_num, rate_a_den, entities FROM ({_COMBINED_CORE})"""))
def selection_routes(f: Frames) -> DataFrame:
    """What a selection of no, one and several entities shows of the stored core cube."""
    cube = _stored(cube_core(f), "core-cube")
    shown = ["grain", "period", "stock", "outflow", "rate_out_a_num", "rate_a_den", "entities"]
    none, one, several = (C.route(cube, x).select(F.lit(name).alias("route"), *shown) for name, x in (("none", []), ("one", ["ASIA"]), ("several", ["AFRICA", "AMERICA"])))
    return none.unionByName(one).unionByName(several)


_PRESENT = "SELECT entity, group_code FROM base_by_group GROUP BY ALL HAVING max(greatest(stock, inflow, outflow)) > 0"
_GROUPED = f"SELECT base_by_group.* FROM base_by_group JOIN ({_PRESENT}) USING (entity, group_code) JOIN ends USING (entity) WHERE month <= end_month"


@query(sql(_core_sql(_GROUPED, "entity, group_code")))
def cube_core_by_group(f: Frames) -> DataFrame:
    return X.core_cube(B.alive(f.base_all_groups).where("group_code <> 'all'"), f.month_flags, _breaks(f), FLOWS, RATES, ["group_code"])


_ALL_GROUPS = f"SELECT * FROM ({_GROUPED}) UNION ALL BY NAME SELECT base.*, 'all' AS group_code FROM base JOIN ends USING (entity) WHERE month <= end_month"
_ERA_FLOWS = ["inflow", "outflow", "out_a", "out_n", "out_r", "overlay"]
_ERA_RATES = ", ".join(f"CASE WHEN mean > 0 THEN round(run_{c} * 12.0::DOUBLE / n, 4) END AS rate_{r}_era_num" for r, c in RATES.items())


_ERA = f"""SELECT entity, group_code, era, n, count(*) OVER (PARTITION BY entity, group_code, era) AS era_months, month_0, month_n, provisional, partial, reissued, stock_0, stock_n, stock_n - stock_0 AS change,
        CASE WHEN stock_0 >= 30 THEN round((stock_n - stock_0) / stock_0, 4) END AS percent, stock_0 < 30 AS percent_small, {", ".join(f"run_{c}" for c in _ERA_FLOWS)}, {_ERA_RATES},
        CASE WHEN mean > 0 THEN round(mean, 4) END AS rate_era_den, n AS rate_era_months, CASE WHEN mean > 0 THEN mean < 30 END AS rate_era_small
    FROM (SELECT z.entity, z.group_code, e.era, p.month AS month_0, z.month AS month_n, count(*) AS n, bool_or(w.provisional) AS provisional, e.open AS partial, bool_or(w.reissued OR coalesce(q.reissued, false)) AS reissued,
            p.stock AS stock_0, z.stock AS stock_n, avg(y.stock) AS mean, {", ".join(f"CAST(sum(y.{c}) AS BIGINT) AS run_{c}" for c in _ERA_FLOWS)}
        FROM ({_ALL_GROUPS}) z JOIN eras e ON z.month BETWEEN e.first_month AND e.last_month JOIN ({_ALL_GROUPS}) y ON y.entity = z.entity AND y.group_code = z.group_code AND y.month BETWEEN e.first_month AND z.month
        JOIN month_flags w ON w.month = y.month LEFT JOIN ({_ALL_GROUPS}) p ON p.entity = z.entity AND p.group_code = z.group_code AND p.month = e.first_month - INTERVAL 1 MONTH LEFT JOIN month_flags q ON q.month = p.month
        GROUP BY ALL)"""


@query(sql(_ERA))
def cube_era(f: Frames) -> DataFrame:
    """All and each group, by months in the era."""
    return X.era_cube(B.alive(f.base_all_groups), f.eras, f.month_flags, _ERA_FLOWS, RATES, ["group_code"])


_BY_YEARS = "CASE WHEN years IS NULL OR issue THEN 'Unknown' WHEN years < 10 THEN '0-9' WHEN years < 20 THEN '10-19' WHEN years < 30 THEN '20-29' ELSE '30+' END"
_YEAR_VALUES = "(VALUES ('0-9'), ('10-19'), ('20-29'), ('30+'), ('Unknown')) v(value)"


def _share_sql(counts: str, values: str, keys: str = "", group: str = "") -> str:
    on = "AND c.group_code = g.group_code" if group else ""
    return f"""SELECT *, CASE WHEN value <> 'Unknown' THEN known END AS share_den, CASE WHEN value <> 'Unknown' THEN round(flow / nullif(known, 0), 4) END AS share, round(known / nullif(whole, 0), 4) AS coverage FROM (
        SELECT *, CAST(sum(flow) FILTER (value <> 'Unknown') OVER w AS BIGINT) AS known, CAST(sum(flow) OVER w AS BIGINT) AS whole FROM (
            SELECT e.entity, {keys} b.period, v.value, CAST(sum(coalesce(c.n, 0)) AS BIGINT) AS flow, count(*) < max(b.expected) AS partial
            FROM entities e CROSS JOIN bridge b CROSS JOIN {values} {group}
            LEFT JOIN ({counts}) c ON c.entity = e.entity AND c.month = b.month AND c.value = v.value {on}
            WHERE b.grain = 'fy' GROUP BY ALL) WINDOW w AS (PARTITION BY entity, {keys.replace("g.", "")} period))"""


def _values(f: Frames, *values: str) -> DataFrame:
    return f.spark.createDataFrame([(v,) for v in values], "value string")


#: Ranges of the balance; a negative one is not known.
BALANCE = [Rule("below 3000", "range", 0, 3000), Rule("3000-5999", "range", 3000, 6000), Rule("6000+", "range", 6000), Rule("Unknown", "unknown")]
_BALANCE = "CASE WHEN balance IS NULL OR balance < 0 THEN 'Unknown' WHEN balance < 3000 THEN 'below 3000' WHEN balance < 6000 THEN '3000-5999' ELSE '6000+' END"
#: Months from an order to its shipping; shipped before it, it is not known.
DELAY = [Rule("same month", "range", 0, 1), Rule("1-11 months", "range", 1, 12), Rule("12-35 months", "range", 12, 36), Rule("36+ months", "range", 36), Rule("Unknown", "unknown")]
_LAG = "date_diff('month', file_month, effective_month)"
_DELAY = f"CASE WHEN {_LAG} < 0 THEN 'Unknown' WHEN {_LAG} < 1 THEN 'same month' WHEN {_LAG} < 12 THEN '1-11 months' WHEN {_LAG} < 36 THEN '12-35 months' ELSE '36+ months' END"
PRICE = [Rule("below 100000", "range", 0, 100_000), Rule("100000-299999", "range", 100_000, 300_000), Rule("300000+", "range", 300_000), Rule("Unknown", "unknown")]
_PRICE = "CASE WHEN price IS NULL THEN 'Unknown' WHEN price < 100000 THEN 'below 100000' WHEN price < 300000 THEN '100000-299999' ELSE '300000+' END"
_STATUS = "CASE WHEN status = 'P' THEN 'Unknown' WHEN status = 'F' THEN 'done' ELSE 'open' END"
#: Dimensions of the breakdowns: how SQL gives their value, their values in order (None: names of nations), and their kind.
_DIMENSIONS = {
    "segment": ("segment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], "R"),
    "nation": ("nation", None, "R"),
    "balance": (_BALANCE, ["below 3000", "3000-5999", "6000+", "Unknown"], "R"),
    "years": (_BY_YEARS, ["0-9", "10-19", "20-29", "30+", "Unknown"], "N"),
    "code": ("code", ["A", "N", "R"], "N"),
    "overlay": ("CASE WHEN overlay = 'Y' THEN 'with' ELSE 'without' END", ["with", "without"], "N"),
    "delay": (_DELAY, [r.value for r in DELAY], "N"),
    "urgency": ("code", ["1", "2", "3", "4", "5"], "N"),
    "price": (_PRICE, [r.value for r in PRICE], "N"),
    "priority": ("CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'pressing' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Unknown' ELSE 'normal' END", ["pressing", "normal", "Unknown"], "S"),
    "status": (_STATUS, ["done", "open", "Unknown"], "S"),
}
OUT_DIMENSIONS = ["segment", "nation", "balance", "years", "code", "overlay", "delay"]
IN_DIMENSIONS = ["segment", "nation", "balance", "urgency", "price", "priority", "status"]
OUT_BY_GROUP, IN_BY_GROUP = ["nation", "balance", "years", "code", "overlay", "delay"], ["nation", "balance", "urgency", "price", "priority", "status"]
_OUT_MEASURES = {**{f"out_{c.lower()}": f"count(*) FILTER (code = '{c}')" for c in CODES}, "overlay": "count(*) FILTER (overlay = 'Y')"}


def _breakdown_sql(flow: str, dimensions: list[str], measures: dict[str, str], group: str = "") -> str:
    """A breakdown cube from windows crossed with values, each counted apart."""
    g = "group_code, " if group else ""
    counts = " UNION ALL ".join(f"SELECT entity, {g}effective_month AS month, '{d}' AS dimension, {_DIMENSIONS[d][0]} AS value, count(*) AS flow{''.join(f', {m} AS {c}' for c, m in measures.items())} FROM {flow} GROUP BY ALL" for d in dimensions)
    stocks = " UNION ALL ".join(f"SELECT entity, {g}month, '{d}' AS dimension, {_DIMENSIONS[d][0]} AS value, count(*) AS stock FROM s2 GROUP BY ALL" for d in dimensions if _DIMENSIONS[d][2] == "R")
    rows = ", ".join(f"('{d}', '{v}', {i}, '{'N' if v == 'Unknown' and _DIMENSIONS[d][2] == 'R' else _DIMENSIONS[d][2]}', {str(v == 'Unknown').lower()})" for d in dimensions for i, v in enumerate(_DIMENSIONS[d][1] or [], 1))
    values = f"SELECT * FROM (VALUES {rows}) v(dimension, value, value_order, kind, is_unknown)"
    if "nation" in dimensions:
        values += " UNION ALL SELECT 'nation', n_name, CAST(row_number() OVER (ORDER BY n_name) AS INTEGER), 'R', false FROM nation"
    in_era = "SELECT era, month, open, row_number() OVER (PARTITION BY era ORDER BY month) AS n FROM months JOIN eras ON month BETWEEN first_month AND last_month"
    spans = f"""SELECT 'fy' AS grain, 'FY' || fy AS period, month, false AS open FROM fiscal UNION ALL SELECT 'era', era, month, open FROM ({in_era})
        UNION ALL SELECT 'first_n', era, month, open FROM ({in_era}) WHERE n <= (SELECT max(n) FROM ({in_era}) WHERE open)"""
    if not group:
        spans += " UNION ALL SELECT 't12', strftime(e.month, '%Y-%m'), m.month, false FROM months e JOIN months m ON m.month BETWEEN e.month - INTERVAL 11 MONTH AND e.month"
    spans = f"SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY grain, period) AS window_months, max(month) OVER (PARTITION BY grain, period) AS window_end FROM ({spans})) WHERE grain <> 't12' OR window_months = 12"
    rated = {d for d in dimensions if _DIMENSIONS[d][2] == "R"}
    has_stock = f"c.dimension IN ({', '.join(repr(d) for d in sorted(rated))})"
    pairs = f"JOIN (SELECT entity, group_code FROM base_by_group GROUP BY ALL HAVING max(greatest(stock, {'outflow' if flow == 'o2' else 'inflow'})) > 0) g USING (entity)" if group else ""
    on = " AND x.group_code = g.group_code" if group else ""
    names = ["flow", *measures]
    return f"""SELECT entity, {g}grain, period, first_month, last_month, CASE WHEN grain IN ('era', 'first_n') THEN window_months ELSE 12 END AS months_in_period, months, dimension, value, value_order, provisional,
        CASE WHEN grain IN ('era', 'first_n') THEN open OR months < window_months ELSE grain = 'fy' AND months < 12 END AS partial, reissued, is_unknown, kind = 'S' AS is_share, {", ".join(names)},
        CASE WHEN {has_stock} THEN stock END AS stock, CASE WHEN kind = 'R' AND mean > 0 THEN CASE WHEN grain IN ('era', 'first_n') THEN round(flow * 12.0::DOUBLE / months, 4) ELSE CAST(flow AS DOUBLE) END END AS rate_num,
        CASE WHEN kind = 'R' AND mean > 0 THEN round(mean, 4) END AS rate_den, CASE WHEN kind = 'R' THEN months END AS rate_months, CASE WHEN kind = 'R' AND mean > 0 THEN mean < 30 END AS rate_small, CASE WHEN kind = 'R' THEN mean = 0 END AS not_applicable,
        CASE WHEN kind = 'S' THEN nullif(CAST(coalesce(sum(flow) FILTER (NOT is_unknown) OVER w, 0) AS BIGINT), 0) END AS share_den, round(coalesce(sum(flow) FILTER (NOT is_unknown) OVER w, 0) / nullif(sum(flow) OVER w, 0), 4) AS coverage
    FROM (SELECT e.entity, {'g.group_code, ' if group else ''}p.grain, p.period, v.dimension, v.value, v.value_order, v.kind, v.is_unknown, min(p.month) AS first_month, max(p.month) AS last_month, max(window_end) AS window_end, max(window_months) AS window_months,
            count(*) AS months, bool_or(p.open) AS open, bool_or(k.provisional) AS provisional, bool_or(k.reissued) AS reissued, arg_max(coalesce(s.stock, 0), p.month) AS stock, avg(coalesce(s.stock, 0)) AS mean,
            {", ".join(f"CAST(sum(coalesce(x.{c}, 0)) AS BIGINT) AS {c}" for c in names)}
        FROM ends e {pairs} JOIN ({spans}) p ON p.month <= e.end_month JOIN month_flags k ON k.month = p.month CROSS JOIN ({values}) v
        LEFT JOIN ({counts}) x ON x.entity = e.entity AND x.month = p.month AND x.dimension = v.dimension AND x.value = v.value{on}
        LEFT JOIN ({stocks}) s ON s.entity = e.entity AND s.month = p.month AND s.dimension = v.dimension AND s.value = v.value{on.replace("x.", "s.")}
        GROUP BY ALL) c WHERE grain <> 't12' OR last_month = window_end WINDOW w AS (PARTITION BY entity, {g}grain, period, dimension)"""


def _value_of(f: Frames, dimension: str):
    p = F.col("o_orderpriority")
    return {
        "segment": lambda: F.col("segment"),
        "nation": lambda: F.col("nation"),
        "balance": lambda: assigned(BALANCE, F.col("balance"), issue=F.col("balance") < 0),
        "years": lambda: assigned(YEARS, F.col("years"), issue=f.issue),
        "code": lambda: F.col("code"),
        "urgency": lambda: F.col("code"),
        "overlay": lambda: F.when(F.col("overlay") == "Y", "with").otherwise("without"),
        "delay": lambda: assigned(DELAY, F.months_between("effective_month", "file_month"), issue=F.months_between("effective_month", "file_month") < 0),
        "price": lambda: assigned(PRICE, F.col("price")),
        "priority": lambda: F.when(p.isin("1-URGENT", "2-HIGH"), "pressing").when(p == "4-NOT SPECIFIED", "Unknown").otherwise("normal"),
        "status": lambda: F.when(F.col("status") == "P", "Unknown").when(F.col("status") == "F", "done").otherwise("open"),
    }[dimension]()


def _breakdown(f: Frames, flow: DataFrame, dimensions: list[str], measures: dict, by: list[str] | None = None) -> DataFrame:
    listed = [(d, v, i, "N" if v == "Unknown" and _DIMENSIONS[d][2] == "R" else _DIMENSIONS[d][2], v == "Unknown", _DIMENSIONS[d][2] == "R") for d in dimensions for i, v in enumerate(_DIMENSIONS[d][1] or [], 1)]
    values = f.spark.createDataFrame(listed, "dimension string, value string, value_order int, kind string, is_unknown boolean, has_stock boolean")
    if "nation" in dimensions:  # a table of 25 rows by design
        order = F.row_number().over(Window.orderBy("n_name"))
        values = values.unionByName(f.table("nation").select(F.lit("nation").alias("dimension"), F.col("n_name").alias("value"), order.alias("value_order"), F.lit("R").alias("kind"), F.lit(False).alias("is_unknown"), F.lit(True).alias("has_stock")))
    rated = {d: _value_of(f, d) for d in dimensions if _DIMENSIONS[d][2] == "R"}
    return X.breakdown_cube(X.valued(f.stock, rated), X.valued(flow, {d: _value_of(f, d) for d in dimensions}), values, f.month_flags, X.windows(f.month_flags, f.eras, trailing=not by), measures, by)


def _out_measures() -> dict:
    return {**{f"out_{c.lower()}": F.count_if(F.col("code") == c) for c in CODES}, "overlay": F.count_if(F.col("overlay") == "Y")}


@query(sql(_breakdown_sql("o2", OUT_DIMENSIONS, _OUT_MEASURES)))
def cube_outflow_breakdown(f: Frames) -> DataFrame:
    """Seven dimensions by fiscal years, trailing twelve months, eras and their first months."""
    return _breakdown(f, f.outflow, OUT_DIMENSIONS, _out_measures())


_LOST_MEASURES = {"years_sum": "CAST(sum(years) FILTER (NOT issue) AS BIGINT)", "years_known": "count(years) FILTER (NOT issue)"}
_LOST = f"""SELECT entity, dimension, value, grain, period, flow, round(rate_num / rate_den, 4) AS rate, round(years_sum / nullif(years_known, 0), 4) AS years_lost, round(years_known / nullif(flow, 0), 4) AS years_coverage, coverage FROM ({_breakdown_sql("o2", OUT_DIMENSIONS, _LOST_MEASURES)})"""


@query(sql(f"""SELECT * FROM (WITH lost AS ({_LOST}) SELECT a.*, b.flow AS flow_before, b.rate AS rate_before, b.years_lost AS years_lost_before, b.years_coverage AS years_coverage_before, b.coverage AS coverage_before FROM lost a
    LEFT JOIN lost b ON b.entity = a.entity AND b.dimension = a.dimension AND b.value = a.value AND b.grain = a.grain
    AND b.period = CASE a.grain WHEN 'fy' THEN 'FY' || (CAST(substr(a.period, 3) AS INTEGER) - 1) WHEN 't12' THEN (CAST(substr(a.period, 1, 4) AS INTEGER) - 1) || substr(a.period, 5) END)"""))
def dimension_snapshot(f: Frames) -> DataFrame:
    """Every dimension's values in every window: outflow, rate, average years lost and coverage, beside those of the year before (fiscal years, trailing twelve months; eras have none)."""
    issue = f.issue
    measures = {"years_sum": F.sum(F.when(~issue, F.col("years"))), "years_known": F.count(F.when(~issue, F.col("years")))}
    cube = _breakdown(f, f.outflow, OUT_DIMENSIONS, measures)
    shown = {"flow": F.col("flow"), "rate": R.rated(F.col("rate_num"), F.col("rate_den")), "years_lost": R.rated(F.col("years_sum"), F.col("years_known")), "years_coverage": R.rated(F.col("years_known"), F.col("flow")), "coverage": F.col("coverage")}
    return X.beside_before(cube, ["entity", "dimension", "value"], shown)


def _combined_breakdown_sql(cube: str, group: str, flows: list[str]) -> str:
    w = f"(PARTITION BY {group}grain, period, dimension)"
    known = f"sum(flow) FILTER (NOT is_unknown) OVER {w}"
    return f"""SELECT {group}grain, period, first_month, last_month, months_in_period, months, dimension, value, value_order, provisional, partial, reissued, is_unknown, is_share, {", ".join(flows)}, stock, rate_num, rate_den, rate_months, rate_den < 30 AS rate_small, not_applicable,
        CASE WHEN is_share THEN nullif(CAST(coalesce({known}, 0) AS BIGINT), 0) END AS share_den, round(coalesce({known}, 0) / nullif(sum(flow) OVER {w}, 0), 4) AS coverage, entities
    FROM (SELECT {group}grain, period, dimension, value, min(first_month) AS first_month, max(last_month) AS last_month, max(months_in_period) AS months_in_period, max(months) AS months, max(value_order) AS value_order, bool_or(provisional) AS provisional, bool_or(partial) AS partial,
        bool_or(reissued) AS reissued, bool_or(is_unknown) AS is_unknown, bool_or(is_share) AS is_share, {_added(*flows, "stock")}, sum(rate_num) FILTER (rate_den IS NOT NULL) AS rate_num, sum(rate_den) AS rate_den, max(rate_months) AS rate_months, bool_and(not_applicable) AS not_applicable,
        CAST(count(*) AS INTEGER) AS entities FROM ({cube}) WHERE entity IN ('AFRICA', 'AMERICA', 'ASIA') GROUP BY ALL)"""


@query(sql(_combined_breakdown_sql(_breakdown_sql("o2", OUT_DIMENSIONS, _OUT_MEASURES), "", ["flow", *_OUT_MEASURES])))
def combine_breakdown(f: Frames) -> DataFrame:
    """Three entities combined from the stored outflow breakdown, with rates from their parts and the coverage of each dimension made anew."""
    return C.combine(_stored(cube_outflow_breakdown(f), "outflow-breakdown"), ["AFRICA", "AMERICA", "ASIA"])


@query(sql(_combined_breakdown_sql(_breakdown_sql("i2", IN_BY_GROUP, {}, "group_code"), "group_code, ", ["flow"])))
def combine_breakdown_by_group(f: Frames) -> DataFrame:
    """Three entities combined, group by group, from the stored inflow breakdown, with the denominators of shares made anew."""
    return C.combine(_stored(cube_inflow_breakdown_by_group(f), "inflow-breakdown"), ["AFRICA", "AMERICA", "ASIA"])


@query(sql(_breakdown_sql("o2", OUT_BY_GROUP, _OUT_MEASURES, "group_code")))
def cube_outflow_breakdown_by_group(f: Frames) -> DataFrame:
    return _breakdown(f, f.outflow, OUT_BY_GROUP, _out_measures(), ["group_code"])


_PRIORITY = "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'pressing' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Unknown' ELSE 'normal' END"
_IN_VALUES = "(VALUES ('pressing'), ('normal'), ('Unknown')) v(value)"


def _priority(f: Frames, by: list[str]) -> DataFrame:
    p = F.col("o_orderpriority")
    flow = f.inflow.withColumn("value", F.when(p.isin("1-URGENT", "2-HIGH"), "pressing").when(p == "4-NOT SPECIFIED", "Unknown").otherwise("normal"))
    return P.breakdown(P.value_base(f.stock, flow, _values(f, "pressing", "normal", "Unknown"), by), by, B.months_of(f.stock))


@query(sql(_breakdown_sql("i2", IN_DIMENSIONS, {})))
def cube_inflow_breakdown(f: Frames) -> DataFrame:
    """Three rated dimensions, two of counts, and two of shares of the known, which have no stock and no rate."""
    return _breakdown(f, f.inflow, IN_DIMENSIONS, {})


@query(sql(_breakdown_sql("i2", IN_BY_GROUP, {}, "group_code")))
def cube_inflow_breakdown_by_group(f: Frames) -> DataFrame:
    return _breakdown(f, f.inflow, IN_BY_GROUP, {}, ["group_code"])


@query(sql(f"SELECT entity, period, value, flow AS n, share_den, share FROM ({_share_sql(f'SELECT entity, effective_month AS month, {_PRIORITY} AS value, count(*) AS n FROM i2 GROUP BY ALL', _IN_VALUES)})"))
def share_of_known(f: Frames) -> DataFrame:
    return _priority(f, []).select("entity", "period", "value", F.col("flow").alias("n"), "share_den", "share")


_SEGMENT = """SELECT e.entity, b.period, v.value, CAST(sum(coalesce(o.n, 0)) AS BIGINT) AS flow, count(*) < max(b.expected) AS partial, round(avg(coalesce(s.n, 0)), 4) AS mean_stock
    FROM entities e CROSS JOIN bridge b CROSS JOIN (SELECT DISTINCT segment AS value FROM stock) v
    LEFT JOIN (SELECT entity, effective_month AS month, segment AS value, count(*) AS n FROM o2 GROUP BY ALL) o ON o.entity = e.entity AND o.month = b.month AND o.value = v.value
    LEFT JOIN (SELECT entity, month, segment AS value, count(*) AS n FROM s2 GROUP BY ALL) s ON s.entity = e.entity AND s.month = b.month AND s.value = v.value
    WHERE b.grain = 'fy' GROUP BY ALL"""


def _segments(f: Frames) -> DataFrame:
    stock, flow = f.stock.withColumn("value", F.col("segment")), f.outflow.withColumn("value", F.col("segment"))
    return P.value_base(stock, flow, stock.select("value").distinct(), [])


@query(sql(f"SELECT entity, period, value, flow, mean_stock, round(flow / nullif(mean_stock, 0), 4) AS rate, mean_stock = 0 AS not_applicable, mean_stock > 0 AND mean_stock < 30 AS small_base FROM ({_SEGMENT})"))
def breakdown_fy(f: Frames) -> DataFrame:
    return P.breakdown(_segments(f), [], B.months_of(f.stock)).select("entity", "period", "value", "flow", "mean_stock", "rate", "not_applicable", "small_base")


_SEG_MONTH = """SELECT e.entity, m.month, v.value, coalesce(o.n, 0) AS flow, coalesce(s.n, 0) AS stock FROM entities e CROSS JOIN months m CROSS JOIN (SELECT DISTINCT segment AS value FROM stock) v
    LEFT JOIN (SELECT entity, effective_month AS month, segment AS value, count(*) AS n FROM o2 GROUP BY ALL) o ON o.entity = e.entity AND o.month = m.month AND o.value = v.value
    LEFT JOIN (SELECT entity, month, segment AS value, count(*) AS n FROM s2 GROUP BY ALL) s ON s.entity = e.entity AND s.month = m.month AND s.value = v.value"""


@query(sql(f"SELECT entity, month, value, CAST(sum(flow) OVER w AS BIGINT) AS t_flow, round(avg(stock) OVER w, 4) AS t_mean FROM ({_SEG_MONTH}) WINDOW w AS (PARTITION BY entity, value ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER w = 12"))
def breakdown_t12(f: Frames) -> DataFrame:
    """Trailing twelve months per value, only where the window is full."""
    return R.trailing(_segments(f), "flow", ["value"]).where("t_flow IS NOT NULL").select("entity", "month", "value", "t_flow", "t_mean")


@query(sql(f"SELECT entity, era, value, CAST(sum(flow) AS BIGINT) AS flow, round(avg(stock), 4) AS mean_stock, round(sum(flow) * 12.0::DOUBLE / count(*) / nullif(avg(stock), 0), 4) AS rate FROM (SELECT x.*, e.era, row_number() OVER (PARTITION BY entity, value, era ORDER BY month) AS n FROM ({_SEG_MONTH}) x JOIN eras e ON month BETWEEN e.first_month AND e.last_month) WHERE n <= (SELECT count(*) FROM months JOIN eras ON open AND month BETWEEN first_month AND last_month) GROUP BY ALL"))
def breakdown_first_n(f: Frames) -> DataFrame:
    """The same number of first months of every era: as many as the open one has."""
    inside = _segments(f).join(F.broadcast(f.eras), F.col("month").between(F.col("first_month"), F.col("last_month")))
    n = F.row_number().over(Window.partitionBy("entity", "value", "era").orderBy("month"))
    open_n = B.months_of(f.stock).join(F.broadcast(f.eras.where("open")), F.col("month").between(F.col("first_month"), F.col("last_month"))).agg(F.count("*").alias("open_n"))
    rows = inside.withColumn("n", n).crossJoin(F.broadcast(open_n)).where("n <= open_n")
    return rows.groupBy("entity", "era", "value").agg(F.sum("flow").alias("flow"), F.round(F.avg("stock"), 4).alias("mean_stock"), R.rated(F.sum("flow") * 12.0 / F.count("*"), F.avg("stock")).alias("rate"))


@query(sql(f"SELECT value, period, flow, flow - lag(flow) OVER (PARTITION BY value ORDER BY period) AS change FROM ({_SEGMENT}) WHERE entity = 'ALL'"))
def breakdown_trend(f: Frames) -> DataFrame:
    b = P.breakdown(_segments(f), [], B.months_of(f.stock)).where("entity = 'ALL'")
    return b.select("value", "period", "flow", (F.col("flow") - F.lag("flow").over(Window.partitionBy("value").orderBy("period"))).alias("change"))


_NODES = "hierarchy h"


@query(sql(f"SELECT h.node, h.level, h.parent, h.place, string_agg(DISTINCT h.code, ',' ORDER BY h.code) AS codes, CAST(sum(o.n) AS BIGINT) AS n FROM {_NODES} JOIN (SELECT code, count(*) AS n FROM inflow GROUP BY code) o USING (code) GROUP BY ALL"))
def group_hierarchy(f: Frames) -> DataFrame:
    """The hierarchy over the codes that the inflow has, by the closure of its links: each node's level, place, codes and rows."""
    codes = f.inflow.groupBy("code").agg(F.count("*").alias("n"))
    found = codes.join(f.hierarchy, "code").groupBy("node", "level", "parent", "place")
    return found.agg(F.array_join(F.sort_array(F.collect_set("code")), ",").alias("codes"), F.sum("n").alias("n"))


_OVERLAP = f"SELECT entity, effective_month AS month, node, count(*) AS n FROM i2 JOIN {_NODES} USING (code) GROUP BY ALL"


def _overlap(f: Frames) -> DataFrame:
    return P.overlapping(f.inflow, f.hierarchy, "effective_month", F.count("*").alias("n"))


@query(sql(_OVERLAP))
def overlapping_groups(f: Frames) -> DataFrame:
    return _overlap(f).select("entity", "month", "node", "n")


@query(sql(f"SELECT *, round(n / nullif(max(CASE WHEN node = 'all' THEN n END) OVER (PARTITION BY entity, month), 0), 4) AS share FROM ({_OVERLAP})"))
def group_share(f: Frames) -> DataFrame:
    return P.with_share(_overlap(f), ["entity", "month"], "n").select("entity", "month", "node", "n", "share")


_CUBE_O = f"SELECT o.entity, b.grain, b.period, o.node, CAST(sum(o.n) AS BIGINT) AS n FROM ({_OVERLAP}) o JOIN bridge b USING (month) GROUP BY ALL"


def _cube_overlap(f: Frames) -> DataFrame:
    from stockflow.functions.calendar import bridge

    return _overlap(f).join(F.broadcast(bridge(B.months_of(f.stock))), "month").groupBy("entity", "grain", "period", "node").agg(F.sum("n").alias("n"))


#: Segments by node and level; a segment counts in each of its nodes, one that is not listed in all and unknown.
SEGMENT_NODES = [(c, n, level) for c, nodes in {"AUTOMOBILE": ("all", "goods", "goods-vehicles"), "MACHINERY": ("all", "goods", "goods-machines"), "FURNITURE": ("all", "goods", "homes"), "BUILDING": ("all", "homes", "homes-buildings")}.items() for level, n in enumerate(nodes)]
_NODE_VALUES = "(VALUES " + ", ".join(f"('{c}', '{n}')" for c, n, _ in SEGMENT_NODES) + ", ('HOUSEHOLD', 'all'), ('HOUSEHOLD', 'unknown')) h(segment, node)"
_NODE_BASE = f"""SELECT e.entity, m.month, d.node, coalesce(s.n, 0) AS stock, coalesce(i.n, 0) AS inflow, coalesce(o.n, 0) AS outflow FROM ends e JOIN months m ON m.month <= e.end_month CROSS JOIN (SELECT DISTINCT node FROM {_NODE_VALUES}) d
    LEFT JOIN (SELECT entity, month, node, count(*) AS n FROM s2 JOIN {_NODE_VALUES} USING (segment) GROUP BY ALL) s ON s.entity = e.entity AND s.month = m.month AND s.node = d.node
    LEFT JOIN (SELECT entity, effective_month AS month, node, count(*) AS n FROM i2 JOIN {_NODE_VALUES} USING (segment) GROUP BY ALL) i ON i.entity = e.entity AND i.month = m.month AND i.node = d.node
    LEFT JOIN (SELECT entity, effective_month AS month, node, count(*) AS n FROM o2 JOIN {_NODE_VALUES} USING (segment) GROUP BY ALL) o ON o.entity = e.entity AND o.month = m.month AND o.node = d.node"""
_NODE_CUBE = f"""SELECT entity, node, grain, period, n, last_month, months, months_in_period, provisional, partial, reissued, stock, whole AS stock_all, round(stock / nullif(whole, 0), 4) AS share, inflow, outflow, stock_0, stock - stock_0 AS change,
    CASE WHEN stock_0 >= 30 THEN round((stock - stock_0) / stock_0, 4) END AS percent, stock_0 < 30 AS percent_small FROM (
    SELECT b.entity, b.node, p.grain, p.period, CAST(NULL AS BIGINT) AS n, max(b.month) AS last_month, count(*) AS months, max(expected) AS months_in_period, bool_or(provisional) AS provisional, count(*) < max(expected) AS partial, bool_or(reissued) AS reissued,
        arg_max(b.stock, b.month) AS stock, arg_max(a.stock, b.month) AS whole, CAST(sum(b.inflow) AS BIGINT) AS inflow, CAST(sum(b.outflow) AS BIGINT) AS outflow, CAST(NULL AS BIGINT) AS stock_0
    FROM ({_NODE_BASE}) b JOIN ({_NODE_BASE}) a ON a.entity = b.entity AND a.month = b.month AND a.node = 'all' JOIN bridge p ON p.month = b.month JOIN month_flags f ON f.month = b.month GROUP BY ALL
    UNION ALL
    SELECT z.entity, z.node, 'era', e.era, count(*), z.month, count(*), count(*), bool_or(f.provisional), e.open, bool_or(f.reissued OR coalesce(q.reissued, false)), z.stock, a.stock, CAST(sum(y.inflow) AS BIGINT), CAST(sum(y.outflow) AS BIGINT), p.stock
    FROM ({_NODE_BASE}) z JOIN eras e ON z.month BETWEEN e.first_month AND e.last_month JOIN ({_NODE_BASE}) y ON y.entity = z.entity AND y.node = z.node AND y.month BETWEEN e.first_month AND z.month JOIN month_flags f ON f.month = y.month
    JOIN ({_NODE_BASE}) a ON a.entity = z.entity AND a.month = z.month AND a.node = 'all' LEFT JOIN ({_NODE_BASE}) p ON p.entity = z.entity AND p.node = z.node AND p.month = e.first_month - INTERVAL 1 MONTH LEFT JOIN month_flags q ON q.month = p.month
    GROUP BY ALL)"""


def _node_cube(f: Frames) -> DataFrame:
    nodes = f.spark.createDataFrame(SEGMENT_NODES, "code string, node string, level int")
    coded = lambda rows: rows.withColumn("code", F.col("segment"))
    return X.overlap_cube(coded(f.stock), coded(f.inflow), coded(f.outflow), nodes, f.month_flags, f.eras)


@query(sql(_NODE_CUBE))
def cube_overlapping_groups(f: Frames) -> DataFrame:
    """Stock, shares and flows of overlapping groups by month, quarter, fiscal year, and era by months in it."""
    return _node_cube(f)


@query(sql(f"SELECT entity, grain, period, stock AS n, share FROM ({_NODE_CUBE}) WHERE node = 'unknown' AND grain <> 'era' AND stock > 0"))
def unknown_group_count(f: Frames) -> DataFrame:
    """Where codes of no group have a stock: its size and share at each period."""
    return _node_cube(f).where("node = 'unknown' AND grain <> 'era' AND stock > 0").select("entity", "grain", "period", F.col("stock").alias("n"), "share")


@query(sql(f"""SELECT grain, period, n, node, CAST(sum(stock) AS BIGINT) AS stock, round(sum(stock) / nullif(sum(stock_all), 0), 4) AS share, CAST(sum(inflow) AS BIGINT) AS inflow, CAST(sum(stock - stock_0) AS BIGINT) AS change,
    CASE WHEN sum(stock_0) >= 30 THEN round(sum(stock - stock_0) / sum(stock_0), 4) END AS percent, sum(stock_0) < 30 AS percent_small FROM ({_NODE_CUBE}) WHERE entity IN ('ASIA', 'AFRICA') GROUP BY ALL HAVING count(*) = 2"""))
def combine_groups(f: Frames) -> DataFrame:
    """Two entities' groups combined from the stored cube: counts add, share, percent and small base are made anew; points that miss an entity are dropped."""
    both = C.combine(_stored(_node_cube(f), "overlap-cube"), ["ASIA", "AFRICA"], whole=True)
    return both.select("grain", "period", "n", "node", "stock", "share", "inflow", "change", "percent", "percent_small")


@query(sql(f"SELECT entity, period, CAST(sum(n) AS BIGINT) AS n FROM ({_CUBE_O}) WHERE grain = 'fy' AND node IN ('urgent-top', 'urgent-high') GROUP BY ALL HAVING count(*) = 2"))
def sum_subgroups(f: Frames) -> DataFrame:
    """Chosen subgroups added; points that miss a part are dropped."""
    parts = _cube_overlap(f).where("grain = 'fy' AND node IN ('urgent-top', 'urgent-high')")
    return parts.groupBy("entity", "period").agg(F.sum("n").alias("n"), F.count("*").alias("k")).where("k = 2").drop("k")


@query(sql(f"SELECT entity, dimension, value, period, flow, flow - lag(flow) OVER w AS change, round(rate_num / rate_den, 4) AS rate FROM ({_breakdown_sql('o2', OUT_DIMENSIONS, _OUT_MEASURES)}) WHERE grain = 'fy' WINDOW w AS (PARTITION BY entity, dimension, value ORDER BY period)"))
def dimension_trend(f: Frames) -> DataFrame:
    """Every value of every dimension over all fiscal years, with its change from the one before."""
    w = Window.partitionBy("entity", "dimension", "value").orderBy("period")
    rows = cube_outflow_breakdown(f).where("grain = 'fy'")
    return rows.select("entity", "dimension", "value", "period", "flow", (F.col("flow") - F.lag("flow").over(w)).alias("change"), R.rated(F.col("rate_num"), F.col("rate_den")).alias("rate"))


_PANEL = _breakdown_sql("i2", IN_BY_GROUP, {}, "group_code")
_SHOWN_RATE = "CASE WHEN is_share THEN round(flow / share_den, 4) ELSE round(rate_num / rate_den, 4) END"


@query(sql(f"""SELECT entity, group_code, dimension, value, {", ".join(f"max(flow) FILTER (period = '{e}') AS flow_{e}, max({_SHOWN_RATE}) FILTER (period = '{e}') AS rate_{e}, bool_or(rate_small) FILTER (period = '{e}') AS small_{e}, bool_or(partial) FILTER (period = '{e}') AS partial_{e}, max(coverage) FILTER (period = '{e}') AS coverage_{e}, coalesce(max(unknown) FILTER (period = '{e}'), 0) AS unknown_{e}" for e in ("e1", "e2"))}
    FROM (SELECT *, CAST(sum(flow) FILTER (is_unknown) OVER (PARTITION BY entity, group_code, period, dimension) AS BIGINT) AS unknown FROM ({_PANEL}) WHERE grain = 'first_n') WHERE NOT is_unknown GROUP BY ALL"""))
def group_panel(f: Frames) -> DataFrame:
    """A group's known values beside each other by era, over the same first months: count, rate or share, flags; what is unknown and the coverage stand apart."""
    w = Window.partitionBy("entity", "group_code", "period", "dimension")
    rows = cube_inflow_breakdown_by_group(f).where("grain = 'first_n'").withColumn("unknown", F.sum(F.when(F.col("is_unknown"), F.col("flow")).otherwise(0)).over(w)).where("NOT is_unknown")
    shown = F.when(F.col("is_share"), R.rated(F.col("flow"), F.col("share_den"))).otherwise(R.rated(F.col("rate_num"), F.col("rate_den")))
    cells = rows.withColumn("rate", shown).groupBy("entity", "group_code", "dimension", "value").pivot("period", ["e1", "e2"]).agg(
        F.max("flow").alias("flow"), F.max("rate").alias("rate"), F.bool_or("rate_small").alias("small"), F.bool_or("partial").alias("partial"), F.max("coverage").alias("coverage"), F.coalesce(F.max("unknown"), F.lit(0)).alias("unknown"),
    )
    names = ["flow", "rate", "small", "partial", "coverage", "unknown"]
    return cells.select("entity", "group_code", "dimension", "value", *(F.col(f"{e}_{c}").alias(f"{c}_{e}") for e in ("e1", "e2") for c in names))


@query(sql(f"""SELECT entity, group_code, own_n, max(CASE WHEN era = 'e1' THEN run_outflow END) AS outflow_e1, max(CASE WHEN era = 'e2' THEN run_outflow END) AS outflow_e2, max(CASE WHEN era = 'e1' THEN round(rate_out_era_num / rate_era_den, 4) END) AS rate_e1, max(CASE WHEN era = 'e2' THEN round(rate_out_era_num / rate_era_den, 4) END) AS rate_e2
    FROM (SELECT *, max(CASE WHEN partial THEN n END) OVER (PARTITION BY entity, group_code) AS own_n FROM ({_ERA})) WHERE n = own_n GROUP BY ALL"""))
def group_era_table(f: Frames) -> DataFrame:
    """Each entity's groups at their own N, the months that the open era has for them, beside the same point of the other era."""
    own = F.max(F.when(F.col("partial"), F.col("n"))).over(Window.partitionBy("entity", "group_code"))
    rows = cube_era(f).withColumn("own_n", own).where("n = own_n").withColumn("rate", R.rated(F.col("rate_out_era_num"), F.col("rate_era_den")))
    out = rows.groupBy("entity", "group_code", "own_n").pivot("era", ["e1", "e2"]).agg(F.max("run_outflow").alias("outflow"), F.max("rate").alias("rate"))
    return out.select("entity", "group_code", "own_n", *(F.col(f"{e}_{c}").alias(f"{c}_{e}") for c in ("outflow", "rate") for e in ("e1", "e2")))


#: Parents of the segments' nodes.
PART_OF = [("goods", "all"), ("homes", "all"), ("unknown", "all"), ("goods-vehicles", "goods"), ("goods-machines", "goods"), ("homes-buildings", "homes")]
_PART_OF = "(VALUES " + ", ".join(f"('{n}', '{p}')" for n, p in PART_OF) + ") l(node, parent)"


@query(sql(f"""SELECT c.entity, c.period, l.parent, c.node, c.stock, p.stock AS stock_parent, round(c.stock / nullif(p.stock, 0), 4) AS share, CAST(p.stock - sum(c.stock) OVER (PARTITION BY c.entity, l.parent) AS BIGINT) AS rest
    FROM (SELECT * FROM ({_NODE_CUBE}) WHERE grain = 'fy') c JOIN {_PART_OF} ON l.node = c.node JOIN (SELECT * FROM ({_NODE_CUBE}) WHERE grain = 'fy') p ON p.entity = c.entity AND p.period = c.period AND p.node = l.parent
    WHERE c.period = (SELECT max(period) FROM bridge WHERE grain = 'fy' AND month = (SELECT last_month FROM bounds))"""))
def parts_of_parent(f: Frames) -> DataFrame:
    """At one point, the latest fiscal year, the stock of each part beside its parent's, its share, and what the parts leave or count twice."""
    latest = f.last_month.select(fy_key(F.col("last_month")).alias("period"))
    at = _node_cube(f).where("grain = 'fy'").join(F.broadcast(latest), "period").select("entity", "period", "node", "stock")
    links = f.spark.createDataFrame(PART_OF, "node string, parent string")
    parent = at.select("entity", F.col("node").alias("parent"), F.col("stock").alias("stock_parent"))
    both = at.join(links, "node").join(parent, ["entity", "parent"])
    rest = F.col("stock_parent") - F.sum("stock").over(Window.partitionBy("entity", "parent"))
    return both.select("entity", "period", "parent", "node", "stock", "stock_parent", R.rated(F.col("stock"), F.col("stock_parent")).alias("share"), rest.alias("rest"))
