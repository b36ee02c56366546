"""Typing, predicates, value rules and calendar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.demo import ISSUE, LISTED, YEARS, Frames, sql
from stockflow.functions import calendar as C
from stockflow.functions import rules as R
from stockflow.functions.rules import Rule
from stockflow.operators import issues as I
from stockflow.queries import query
from stockflow.queries.cubes import _CORE
from stockflow.sources.files import work_dir


def _counts(df: DataFrame, value) -> DataFrame:
    return df.withColumn("value", value).groupBy("value").agg(F.count("*").alias("n"))


@query(sql("SELECT l_orderkey, l_linenumber, TRY_CAST(nullif(years_text, 'REDACTED') AS INTEGER) AS years, coalesce(years_text = 'REDACTED', false) AS years_redacted FROM all_outflow"))
def redacted_typing(f: Frames) -> DataFrame:
    t = F.col("years_text")
    return f.all_outflow.select("l_orderkey", "l_linenumber", R.typed(t, "int").alias("years"), R.redacted(t).alias("years_redacted"))


@query(sql("SELECT o_orderkey, strftime(order_month, '%Y%m') AS raw, order_month AS month, CAST(try_strptime(CASE WHEN o_orderkey % 7 = 0 THEN '202413' ELSE strftime(order_month, '%Y%m') END, '%Y%m') AS DATE) AS checked FROM ordered"))
def yyyymm_to_month(f: Frames) -> DataFrame:
    raw = F.date_format("order_month", "yyyyMM")
    return f.orders.select("o_orderkey", raw.alias("raw"), R.yyyymm(raw).alias("month"), R.yyyymm(F.when(F.col("o_orderkey") % 7 == 0, "202413").otherwise(raw)).alias("checked"))


@query(sql("SELECT file_month, count(*) AS n, count(*) FILTER (code = 'R') AS by_code FROM all_outflow WHERE CASE WHEN file_month >= DATE '1998-01-01' THEN code = 'R' ELSE overlay = 'Y' AND code <> 'A' END GROUP BY file_month"))
def scoped_population(f: Frames) -> DataFrame:
    """The population by the new code from 1998 on, by an old one (of two fields) before."""
    old = F.when((F.col("overlay") == "Y") & (F.col("code") != "A"), "R").otherwise("none")
    inside = R.scope(F.col("file_month"), "1998-01-01", F.col("code"), old, "R")
    return f.all_outflow.where(inside).groupBy("file_month").agg(F.count("*").alias("n"), F.count_if(F.col("code") == "R").alias("by_code"))


@query(sql("SELECT strftime(file_month, '%Y-%m') AS file_month, entity AS agency, code AS category, years_text AS length_of_service FROM all_outflow"))
def allowlist_projection(f: Frames) -> DataFrame:
    allowed = [("agency", "entity"), ("category", "code"), ("length_of_service", "years_text")]
    return f.all_outflow.select(C.month_key(F.col("file_month")).alias("file_month"), *(F.col(source).alias(name) for name, source in allowed))


@query(sql("SELECT file_month, count(*) AS n, count(*) FILTER (issue) AS unknown FROM all_outflow GROUP BY file_month"))
def issue_predicate(f: Frames) -> DataFrame:
    return f.all_outflow.groupBy("file_month").agg(F.count("*").alias("n"), F.count_if(f.issue).alias("unknown"))


#: Known issues: two of one field overlap, one is of codes, one of another dataset, and one makes its field unusable.
ISSUES = [
    ("b-large", "outflow", "years", "1997-06-01", "1998-01-01", 48.0, 50.0, None, "unknown"),
    ("a-forties", "outflow", "years", "1997-09-01", "1997-12-01", 40.0, 49.0, None, "unknown"),
    ("early-returns", "outflow", "code", "1995-03-01", "1995-05-01", None, None, "R|X", "unknown"),
    ("elsewhere", "inflow", "code", "1995-01-01", "1998-12-01", None, None, None, "unknown"),
    ("from-60", "outflow", "years", "1992-01-01", "1998-12-01", 60.0, None, None, "unknown"),
    ("discount-lost", "outflow", "discount", "1992-01-01", "1998-12-01", None, None, None, "unusable"),
]


def _issues(f: Frames) -> DataFrame:
    """The issue table through CSV, as it is kept."""
    out = work_dir(f.spark, "issues")
    text = [tuple(None if x is None else str(x) for x in r) for r in ISSUES]
    f.spark.createDataFrame(text, ", ".join(f"{c.split()[0]} string" for c in I.SCHEMA.split(", "))).write.option("header", True).csv(out)
    return f.spark.read.schema(I.SCHEMA).option("header", True).csv(out)


_YEARS_ISSUE = "CASE WHEN years BETWEEN 40 AND 49 AND file_month BETWEEN DATE '1997-09-01' AND DATE '1997-12-01' THEN 'a-forties' WHEN years BETWEEN 48 AND 50 AND file_month BETWEEN DATE '1997-06-01' AND DATE '1998-01-01' THEN 'b-large' END"
_CODE_ISSUE = "CASE WHEN code = 'R' AND file_month BETWEEN DATE '1995-03-01' AND DATE '1995-05-01' THEN 'early-returns' END"


@query(sql(f"SELECT entity, 'years' AS field, {_YEARS_ISSUE} AS issue, count(*) AS n FROM all_outflow WHERE years IS NOT NULL GROUP BY ALL UNION ALL SELECT entity, 'code', {_CODE_ISSUE}, count(*) FROM all_outflow WHERE code IS NOT NULL GROUP BY ALL"))
def issue_table_applied(f: Frames) -> DataFrame:
    """How many values each issue of the table hit, each row once a field, though issues overlap; and how many are believed."""
    fields = ["years", "code"]
    return I.applied(I.named(f.all_outflow, _issues(f), "outflow", fields), fields, ["entity"])


@query(sql(f"SELECT file_month AS month, count(*) AS n, count(*) FILTER (({_YEARS_ISSUE}) IS NULL) AS known, count(*) FILTER (({_YEARS_ISSUE}) IS NOT NULL) AS hit, CAST(sum(years) FILTER (({_YEARS_ISSUE}) IS NULL) AS BIGINT) AS years FROM all_outflow GROUP BY ALL"))
def issue_table_balance(f: Frames) -> DataFrame:
    """Month by month: values that are believed and those that are not add up to all, and only the former are added."""
    rows = I.usable(I.named(f.all_outflow, _issues(f), "outflow", ["years"]), ["years"])
    return rows.groupBy(F.col("file_month").alias("month")).agg(F.count("*").alias("n"), F.count("years").alias("known"), F.count("years_issue").alias("hit"), F.sum("years").alias("years"))


@query(sql("SELECT entity, 'outflow.discount is unusable: discount-lost' AS said, count(*) AS n FROM all_outflow GROUP BY ALL"))
def issue_table_refusal(f: Frames) -> DataFrame:
    """A job that reads an unusable field is refused, and says why; one that does not runs."""
    issues = _issues(f)
    said = None
    try:
        I.named(f.all_outflow.withColumn("discount", F.lit(0.0)), issues, "outflow", ["years", "discount"])
    except I.Refused as e:
        said = str(e)
    return I.named(f.all_outflow, issues, "outflow", ["years"]).groupBy("entity").agg(F.lit(said).alias("said"), F.count("*").alias("n"))


@query(sql("SELECT group_code AS value, count(*) AS n FROM members GROUP BY 1"))
def group_or_other(f: Frames) -> DataFrame:
    return _counts(f.table("customer"), R.group_or_other(F.col("c_mktsegment"), LISTED))


@query(sql("SELECT entity, CASE WHEN years IS NULL OR issue THEN 'Unknown' WHEN years < 10 THEN '0-9' WHEN years < 20 THEN '10-19' WHEN years < 30 THEN '20-29' ELSE '30+' END AS value, count(*) AS n FROM all_outflow GROUP BY ALL"))
def dimension_values(f: Frames) -> DataFrame:
    return f.all_outflow.withColumn("value", R.assigned(YEARS, F.col("years"), issue=f.issue)).groupBy("entity", "value").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN p_size >= 1 AND p_size < 16 THEN 'small' WHEN p_size >= 16 AND p_size < 40 THEN 'medium' WHEN p_size >= 40 THEN 'large' ELSE '__unmapped__' END AS value, count(*) AS n FROM part GROUP BY 1")
def rule_range(f: Frames) -> DataFrame:
    return _counts(f.table("part"), R.assigned([Rule("small", "range", 1, 16), Rule("medium", "range", 16, 40), Rule("large", "range", 40)], F.col("p_size")))


@query("SELECT CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 'machines' WHEN c_mktsegment IN ('BUILDING') THEN 'building' ELSE '__unmapped__' END AS value, count(*) AS n FROM customer GROUP BY 1")
def rule_codes(f: Frames) -> DataFrame:
    return _counts(f.table("customer"), R.assigned([Rule("machines", "codes", codes=("AUTOMOBILE", "MACHINERY")), Rule("building", "codes", codes=("BUILDING",))], F.col("c_mktsegment")))


@query("SELECT CASE WHEN p_type = 'PROMO' THEN 'promo' WHEN p_type IS NOT NULL THEN 'other type' END AS value, count(*) AS n FROM part GROUP BY 1")
def rule_rest(f: Frames) -> DataFrame:
    return _counts(f.table("part"), R.assigned([Rule("other type", "rest"), Rule("promo", "codes", codes=("PROMO",))], F.col("p_type")))


@query("SELECT CASE WHEN o_orderpriority IS NULL OR o_orderpriority = '4-NOT SPECIFIED' THEN 'Unknown' ELSE 'known' END AS value, count(*) AS n FROM orders GROUP BY 1")
def rule_unknown(f: Frames) -> DataFrame:
    return _counts(f.table("orders"), R.assigned([Rule("known", "rest"), Rule("Unknown", "unknown", codes=("4-NOT SPECIFIED",))], F.col("o_orderpriority")))


@query("SELECT CASE WHEN p_brand IN ('Brand#1', 'Brand#2') AND p_size >= 1 AND p_size < 25 THEN 'low' WHEN p_brand IN ('Brand#1', 'Brand#2') AND p_size >= 25 AND p_size < 51 THEN 'high' WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'Unknown' ELSE 'other plan' END AS value, count(*) AS n FROM part GROUP BY 1")
def rule_plan_grade(f: Frames) -> DataFrame:
    plans = ("Brand#1", "Brand#2")
    rules = [Rule("low", "plan_grade", 1, 25, plans), Rule("high", "plan_grade", 25, 51, plans), Rule("Unknown", "codes", codes=plans), Rule("other plan", "unknown_rest")]
    return _counts(f.table("part"), R.assigned(rules, F.col("p_brand"), grade=F.col("p_size").cast("string")))


@query("SELECT CASE WHEN starts_with(p_type, 'S') THEN 's-types' WHEN starts_with(p_type, 'E') OR starts_with(p_type, 'L') THEN 'e or l' ELSE '__unmapped__' END AS value, count(*) AS n FROM part GROUP BY 1")
def rule_prefix(f: Frames) -> DataFrame:
    return _counts(f.table("part"), R.assigned([Rule("s-types", "prefix", codes=("S",)), Rule("e or l", "prefix", codes=("E", "L"))], F.col("p_type")))


@query("SELECT CASE WHEN nullif(o_orderpriority, '4-NOT SPECIFIED') IS NULL THEN 'none' ELSE 'given' END AS value, count(*) AS n FROM orders GROUP BY 1")
def rule_null(f: Frames) -> DataFrame:
    return _counts(f.table("orders"), R.assigned([Rule("none", "null"), Rule("given", "rest")], F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED"))))


@query("SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'pressing' ELSE 'Unknown' END AS value, count(*) AS n FROM orders GROUP BY 1")
def rule_unknown_rest(f: Frames) -> DataFrame:
    return _counts(f.table("orders"), R.assigned([Rule("pressing", "codes", codes=("1-URGENT", "2-HIGH")), Rule("Unknown", "unknown_rest")], F.col("o_orderpriority")))


@query("SELECT p_type, count(*) AS n FROM part WHERE p_type NOT IN ('PROMO', 'SMALL') GROUP BY 1")
def unmapped_values(f: Frames) -> DataFrame:
    """Values that no rule takes: a build refuses while there are any."""
    value = R.assigned([Rule("promo", "codes", codes=("PROMO",)), Rule("small", "codes", codes=("SMALL",))], F.col("p_type"))
    return f.table("part").where(value == R.UNMAPPED).groupBy("p_type").agg(F.count("*").alias("n"))


@query(sql("SELECT *, file_month BETWEEN DATE '1997-06-01' AND DATE '1998-01-01' AND years BETWEEN 48 AND 50 AS known_issue FROM (SELECT l_orderkey, l_linenumber, file_month, years FROM all_outflow)"))
def issue_marker(f: Frames) -> DataFrame:
    """Published rows with the marker only: the value stays."""
    return f.all_outflow.select("l_orderkey", "l_linenumber", "file_month", "years", ISSUE.hits(F.col("file_month"), F.col("years")).alias("known_issue"))


@query(sql("SELECT DISTINCT month, strftime(month, '%Y-%m') AS m_key, 'FY' || fy || 'Q' || fq AS q_key, 'FY' || fy AS fy_key, fy AS fiscal_year, CAST(make_date(CAST(fy AS INTEGER) - 1, 10, 1) AS DATE) AS fy_first, CAST(make_date(CAST(fy AS INTEGER), 9, 1) AS DATE) AS fy_last FROM fiscal"))
def period_keys(f: Frames) -> DataFrame:
    m = F.col("month")
    bounds = C.bounds_of(C.fy_key(m))
    return f.stock.select("month").distinct().select("month", C.month_key(m).alias("m_key"), C.quarter_key(m).alias("q_key"), C.fy_key(m).alias("fy_key"), C.fiscal_year(m).cast("long").alias("fiscal_year"), bounds["first_month"].alias("fy_first"), bounds["last_month"].alias("fy_last"))


@query(sql("SELECT CAST(unnest(generate_series(first_month, last_month, INTERVAL 1 MONTH)) AS DATE) AS month FROM bounds"))
def month_spine(f: Frames) -> DataFrame:
    return C.spine(f.last_month)


@query(sql("SELECT grain, period, min(month) AS first_month, max(month) AS last_month, max(expected) AS expected, count(*) AS published FROM bridge GROUP BY ALL"))
def period_table(f: Frames) -> DataFrame:
    p = C.bridge(f.stock.select("month").distinct())
    return p.groupBy("grain", "period").agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.max("expected").alias("expected"), F.count("*").alias("published"))


@query(sql("""SELECT * FROM bridge UNION ALL SELECT 't12', strftime(e.month, '%Y-%m'), m.month, 12 FROM months e JOIN months m ON m.month BETWEEN e.month - INTERVAL 11 MONTH AND e.month WHERE e.month >= (SELECT first_month + INTERVAL 11 MONTH FROM bounds)
    UNION ALL SELECT 'era', era, month, count(*) OVER (PARTITION BY era) FROM months JOIN eras ON month BETWEEN first_month AND last_month"""))
def period_bridge(f: Frames) -> DataFrame:
    """Each month with its month, quarter, fiscal year, trailing windows and eras."""
    from stockflow.plans.full import windows

    more = windows(f.month_flags, f.eras).where("grain IN ('t12', 'era')").select("grain", "period", "month", F.col("window_months").alias("expected"))
    return C.bridge(f.month_flags.select("month")).select("grain", "period", "month", "expected").unionByName(more)


@query(sql("SELECT m.month, era FROM months m JOIN eras ON m.month BETWEEN first_month AND last_month"))
def era_assignment(f: Frames) -> DataFrame:
    """The interval join of months and eras; both are small dimensions."""
    months = f.stock.select("month").distinct()
    return months.join(F.broadcast(f.eras), F.col("month").between(F.col("first_month"), F.col("last_month"))).select("month", "era")


@query(sql("SELECT grain, period, bool_or(month IN (DATE '1997-03-01', DATE '1999-12-01')) AS has_break FROM bridge GROUP BY ALL"))
def break_flags(f: Frames) -> DataFrame:
    from stockflow.demo import BREAKS

    breaks = f.spark.createDataFrame(BREAKS, "fiscal_year string, m string").select(F.to_date("m").alias("month"), F.lit(True).alias("broken"))
    p = C.bridge(f.stock.select("month").distinct()).join(F.broadcast(breaks), "month", "left")
    return p.groupBy("grain", "period").agg(F.bool_or(F.coalesce("broken", F.lit(False))).alias("has_break"))


@query(sql("SELECT entity, grain, period, last_month, stock FROM rolled WHERE grain = 'quarter' AND last_month >= DATE '1996-05-01' AND (last_month - INTERVAL 2 MONTH) <= DATE '1999-02-01'"))
def select_range(f: Frames) -> DataFrame:
    """Rows of a grain whose periods overlap a range of months."""
    from stockflow.operators.rollup import roll_up

    r = roll_up(f.base, ["inflow"]).where("grain = 'quarter'")
    return r.where((F.col("last_month") >= F.lit("1996-05-01").cast("date")) & (F.add_months("last_month", -2) <= F.lit("1999-02-01").cast("date"))).select("entity", "grain", "period", "last_month", "stock")


_ASKED = "(VALUES ('1999-05', '1990-01'), ('FY1997Q2', 'FY1997Q2'), ('FY1996', '1998-02'), ('2001-01', '2010-12')) a(a, b)"


@query(sql(f"""SELECT grain, a, b, CAST(min(month) AS DATE) AS first_month, CAST(max(month) AS DATE) AS last_month, arg_min(period, month) AS first_period, arg_max(period, month) AS last_period FROM (
    SELECT a.a, a.b, b.grain, b.period, b.month FROM (SELECT a, b, least(x.lo, y.lo) AS lo, greatest(x.hi, y.hi) AS hi FROM {_ASKED} JOIN keys x ON x.key = a.a JOIN keys y ON y.key = a.b) a JOIN bridge b ON true
    WHERE EXISTS (SELECT 1 FROM bridge c WHERE c.grain = b.grain AND c.period = b.period AND c.month BETWEEN a.lo AND a.hi)) GROUP BY ALL""").replace("WITH RECURSIVE ", """WITH RECURSIVE keys AS (SELECT * FROM (VALUES ('1999-05', DATE '1999-05-01', DATE '1999-05-01'), ('1990-01', DATE '1990-01-01', DATE '1990-01-01'), ('FY1997Q2', DATE '1997-01-01', DATE '1997-03-01'),
    ('FY1996', DATE '1995-10-01', DATE '1996-09-01'), ('1998-02', DATE '1998-02-01', DATE '1998-02-01'), ('2001-01', DATE '2001-01-01', DATE '2001-01-01'), ('2010-12', DATE '2010-12-01', DATE '2010-12-01')) k(key, lo, hi)),
""", 1))
def snap_range(f: Frames) -> DataFrame:
    """Ranges as asked for, by keys of any grain: swapped if reversed, cut to the data, and snapped to whole periods of each grain."""
    asked = f.spark.createDataFrame([("1999-05", "1990-01"), ("FY1997Q2", "FY1997Q2"), ("FY1996", "1998-02"), ("2001-01", "2010-12")], "a string, b string")
    x, y = C.bounds_of(F.col("a")), C.bounds_of(F.col("b"))
    asked = asked.select("a", "b", F.least(x["first_month"], y["first_month"]).alias("lo"), F.greatest(x["last_month"], y["last_month"]).alias("hi"))
    p = C.bridge(f.month_flags.select("month")).groupBy("grain", "period").agg(F.min("month").alias("first"), F.max("month").alias("last"))
    near = F.broadcast(asked).join(p, (F.col("last") >= F.col("lo")) & (F.col("first") <= F.col("hi")))
    return near.groupBy("grain", "a", "b").agg(F.min("first").alias("first_month"), F.max("last").alias("last_month"), F.min_by("period", "first").alias("first_period"), F.max_by("period", "last").alias("last_period"))


@query(sql(f"""SELECT entity, grain, period, CASE WHEN months > months_in_period THEN 'too many months' WHEN partial <> (months < months_in_period) THEN 'partial flag' WHEN grain <> CASE WHEN period LIKE 'FY%Q%' THEN 'quarter' WHEN period LIKE 'FY%' THEN 'fy' ELSE 'month' END THEN 'key of another grain'
    WHEN len(string_split(files, ',')) <> months THEN 'files' WHEN date_diff('month', first_month, last_month) + 1 <> months THEN 'gap' WHEN net_flow <> inflow - outflow THEN 'net flow' END AS problem FROM ({_CORE}) WHERE problem IS NOT NULL"""))
def validate_period_rows(f: Frames) -> DataFrame:
    """Rows of the core cube that contradict themselves (none)."""
    from stockflow.operators import checks as K
    from stockflow.queries.cubes import cube_core

    return K.period_rows(cube_core(f), C.grain_of(F.col("period")))
