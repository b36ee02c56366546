"""Published records: order, filters, search, pages, options."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockflow.demo import Frames, sql
from stockflow.functions.calendar import fiscal_year, month_key
from stockflow.operators.order import by_column, by_priority, placed
from stockflow.operators import lookup as L
from stockflow.queries import query
from stockflow.sources.files import publish_plan, work_dir

_REC = "SELECT strftime(file_month, '%Y-%m') AS file_month, strftime(effective_month, '%Y-%m') AS month, entity AS agency, code AS category, overlay AS overlay, years_text AS length_of_service, segment FROM all_outflow"


def _records(f: Frames) -> DataFrame:
    return f.all_outflow.select(month_key(F.col("file_month")).alias("file_month"), month_key(F.col("effective_month")).alias("month"), F.col("entity").alias("agency"), F.col("code").alias("category"), "overlay", F.col("years_text").alias("length_of_service"), "segment")


@query(sql(_REC))
def published_records(f: Frames) -> DataFrame:
    """Row for row, text only, sorted by key and then by every other column."""
    r = _records(f)
    return r.orderBy("file_month", "agency", *[c for c in r.columns if c not in ("file_month", "agency")])


_PLACED = ["p_type", "p_brand", "p_size", "p_partkey"]


@query("SELECT p_type, p_brand, p_size, p_partkey, row_number() OVER (ORDER BY p_type, p_brand, p_size, p_partkey) AS place FROM part")
def total_order(f: Frames) -> DataFrame:
    """All rows of a deterministic order, with their places."""
    return placed(f.table("part").select(*_PLACED), _PLACED)


@query(sql("SELECT entity, month, v, row_number() OVER (ORDER BY v DESC NULLS LAST, entity, month) AS place FROM (SELECT entity, month, nullif(stock, 0) AS v FROM base)"))
def sort_nulls_last(f: Frames) -> DataFrame:
    """Empties last, by ranges: largest values first."""
    b = f.base.select("entity", "month", F.nullif(F.col("stock"), F.lit(0)).alias("v"))
    b = b.withColumns({"_empty": F.col("v").isNull(), "_less": -F.col("v")})
    return placed(b, ["_empty", "_less", "entity", "month"]).select("entity", "month", "v", "place")


_TEXTS = "SELECT DISTINCT coalesce(years_text, 'none') AS v FROM all_outflow"


@query(sql(f"SELECT v, row_number() OVER (ORDER BY TRY_CAST(v AS DOUBLE) IS NULL, TRY_CAST(v AS DOUBLE), v) AS place FROM ({_TEXTS})"))
def numeric_text_order(f: Frames) -> DataFrame:
    v = f.all_outflow.select(F.coalesce("years_text", F.lit("none")).alias("v")).distinct()
    n = F.col("v").try_cast("double")
    return placed(v.withColumns({"_text": n.isNull(), "_n": n}), ["_text", "_n", "v"]).select("v", "place")


@query("SELECT o_orderpriority AS v, row_number() OVER (ORDER BY CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 2 END, o_orderpriority) AS place FROM (SELECT DISTINCT o_orderpriority FROM orders)")
def priority_order(f: Frames) -> DataFrame:
    v = F.col("v")
    w = Window.orderBy(F.when(v == "5-LOW", 0).when(v == "1-URGENT", 1).otherwise(2), v)
    return f.table("orders").select(F.col("o_orderpriority").alias("v")).distinct().withColumn("place", F.row_number().over(w).cast("long"))


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 25 OFFSET 50")
def page_rows(f: Frames) -> DataFrame:
    """The third page of 25."""
    return f.table("part").select("p_partkey", "p_name").orderBy("p_partkey").offset(50).limit(25)


@query(sql(f"SELECT category, count(*) AS n FROM ({_REC}) GROUP BY 1"))
def group_counts(f: Frames) -> DataFrame:
    return _records(f).groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("category"))


@query(sql("SELECT l_orderkey, l_linenumber, entity, code FROM all_outflow WHERE entity = 'ASIA' AND year(effective_month + INTERVAL 3 MONTH) = 1998 AND code IN ('A', 'N')"))
def record_filter(f: Frames) -> DataFrame:
    """Equality, fiscal year of the effective month, and a group of codes by a semi-join with its crosswalk."""
    group = f.spark.createDataFrame([("A",), ("N",)], "code string")
    rows = f.all_outflow.where((F.col("entity") == "ASIA") & (fiscal_year(F.col("effective_month")) == 1998))
    return rows.join(F.broadcast(group), "code", "left_semi").select("l_orderkey", "l_linenumber", "entity", "code")


@query(sql(f"SELECT agency, category, segment, count(*) AS n FROM ({_REC}) WHERE contains(lower(concat_ws(chr(1), agency, category, segment)), 'mach') GROUP BY ALL"))
def record_search(f: Frames) -> DataFrame:
    shown = F.lower(F.concat_ws("\u0001", "agency", "category", "segment"))
    return _records(f).where(shown.contains("mach")).groupBy("agency", "category", "segment").agg(F.count("*").alias("n"))


_OPTIONS = f"SELECT 'agency' AS field, agency AS option, count(*) AS n FROM ({_REC}) GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM ({_REC}) GROUP BY 2 UNION ALL SELECT 'length_of_service', length_of_service, count(*) FROM ({_REC}) GROUP BY 2"


@query(sql(f"SELECT *, row_number() OVER (PARTITION BY field ORDER BY option IS NULL, option = 'REDACTED', TRY_CAST(option AS DOUBLE) IS NULL, TRY_CAST(option AS DOUBLE), option) AS place FROM ({_OPTIONS})"))
def filter_options(f: Frames) -> DataFrame:
    """Each field's values with their counts, in display order: numbers by size, then text, then redacted, none last."""
    fields = ("agency", "category", "length_of_service")
    n = _records(f).select(F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("option")) for c in fields)))).groupBy("field", "option").agg(F.count("*").alias("n"))
    number = F.col("option").try_cast("double")
    order = Window.partitionBy("field").orderBy(F.col("option").isNull(), F.col("option").eqNullSafe("REDACTED"), number.isNull(), number, "option")
    return n.withColumn("place", F.row_number().over(order).cast("long"))


@query(sql("SELECT strftime(month, '%Y-%m') AS month, count(*) AS n FROM stock WHERE month(month) = 9 OR month = (SELECT last_month FROM bounds) GROUP BY 1"))
def fy_end_and_latest_snapshots(f: Frames) -> DataFrame:
    latest = f.last_month.select("last_month")
    kept = f.stock.crossJoin(F.broadcast(latest)).where((F.month("month") == 9) | (F.col("month") == F.col("last_month")))
    return kept.groupBy(month_key(F.col("month")).alias("month")).agg(F.count("*").alias("n"))


_SHOWN = "SELECT effective_month AS month, l_orderkey, l_linenumber, entity, CASE code WHEN 'A' THEN 'Accepted' WHEN 'R' THEN 'Returned' ELSE code END AS state, p_partkey || ' ' || p_name AS part FROM all_outflow JOIN part ON p_partkey = l_partkey"
_IN_ORDER = ["month", "l_orderkey", "l_linenumber"]


def _shown(f: Frames) -> str:
    """Records as they are shown, names for codes and parts with their title, stored in order."""
    part = f.table("part").select("p_partkey", "p_name")
    rows = f.all_outflow.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.date_format("effective_month", "yyyy-MM-dd").alias("month"), "l_orderkey", "l_linenumber", "entity", L.displayed(F.col("code"), {"A": "Accepted", "R": "Returned"}).alias("state"), F.concat_ws(" ", "p_partkey", "p_name").alias("part"),
    )
    path = work_dir(f.spark, "lookup")
    L.build(rows, _IN_ORDER, path, rows_per_file=20_000)
    return path


def _pages_sql(where: str, wanted: list[int], size: int) -> str:
    asked = ", ".join(f"({n})" for n in wanted)
    return f"""SELECT a.n AS asked, CAST(x.month AS VARCHAR) AS month, l_orderkey, l_linenumber, entity, state, part, least(greatest(a.n, 1), pages) AS page, pages, total, place
    FROM (SELECT *, row_number() OVER (ORDER BY month, l_orderkey, l_linenumber) AS place, count(*) OVER () AS total, CAST(ceil(count(*) OVER () / {size}.0) AS BIGINT) AS pages FROM ({_SHOWN}) WHERE {where}) x
    JOIN (VALUES {asked}) a(n) ON place BETWEEN (least(greatest(a.n, 1), pages) - 1) * {size} + 1 AND least(greatest(a.n, 1), pages) * {size}"""


def _pages(f: Frames, wanted: list[int], size: int, condition=None) -> DataFrame:
    path, out = _shown(f), None
    for n in wanted:
        one = L.page(f.spark, path, n, size, condition).select(F.lit(n).alias("asked"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query(sql(_pages_sql("true", [0, 1, 7, 1_000_000_000], 40)))
def lookup_pages(f: Frames) -> DataFrame:
    """Pages of all records, in order: one below 1 and one beyond the last are clamped."""
    return _pages(f, [0, 1, 7, 1_000_000_000], 40)


@query(sql(_pages_sql("contains(lower(concat_ws('|', entity, state, part)), 'returned') AND contains(lower(part), 'green')", [1, 2, 999], 25)))
def lookup_search(f: Frames) -> DataFrame:
    """The rows that hold a display name and a part of a title, whatever their case, page by page."""
    return _pages(f, [1, 2, 999], 25, L.contains(" ReTurned", "entity", "state", "part") & L.contains("GREEN", "part"))


_SORTED = "SELECT entity, month, '{c}' AS by_column, {d} AS descending, nullif({c}, 0) AS v, row_number() OVER (ORDER BY nullif({c}, 0) {o} NULLS LAST, entity, month) AS place FROM base"


@query(sql(" UNION ALL ".join(_SORTED.format(c=c, d=d, o=o) for c in ("stock", "outflow") for d, o in (("false", "ASC"), ("true", "DESC")))))
def sort_by_column(f: Frames) -> DataFrame:
    """The base by a chosen column, up and down, empties last either way."""
    out = None
    for c in ("stock", "outflow"):
        rows = f.base.select("entity", "month", F.lit(c).alias("by_column"), F.nullif(F.col(c), F.lit(0)).alias("v"))
        for down in (False, True):
            one = placed(rows, by_column("v", down, "entity", "month")).select("entity", "month", "by_column", F.lit(down).alias("descending"), "v", "place")
            out = one if out is None else out.unionByName(one)
    return out


@query(sql("SELECT v, row_number() OVER (ORDER BY CASE v WHEN 'REDACTED' THEN 0 WHEN '30' THEN 1 ELSE 2 END, TRY_CAST(v AS DOUBLE) IS NULL, TRY_CAST(v AS DOUBLE), v) AS place FROM (SELECT DISTINCT coalesce(years_text, 'none') AS v FROM all_outflow UNION SELECT DISTINCT code FROM all_outflow)"))
def priority_number_order(f: Frames) -> DataFrame:
    """Codes in a display order: two listed ones, then numbers by value, then text."""
    v = f.all_outflow.select(F.explode(F.array(F.coalesce("years_text", F.lit("none")), "code")).alias("v")).distinct()
    return placed(v, by_priority("v", ["REDACTED", "30"]))


_PLANNED = "SELECT DISTINCT '{0}' AS dataset, '{0}_' || strftime({1}, '%Y%m') || '.parquet' AS filename, {1} AS m FROM {2}"


@query(sql(f"""SELECT dataset, strftime(m, '%Y-%m') AS month, filename, dataset = 'stock' AND month(m) <> 9 AS latest_only FROM ({_PLANNED.format('stock', 'month', 'stock')} UNION ALL {_PLANNED.format('outflow', 'file_month', 'all_outflow')})
    WHERE dataset <> 'stock' OR month(m) = 9 OR m = (SELECT last_month FROM bounds)"""))
def records_plan(f: Frames) -> DataFrame:
    """Which files of a manifest are published as records: all months of the flows, and of the stock each fiscal year's end and the latest month."""
    listed = lambda d, rows, m: rows.select(F.lit(d).alias("dataset"), F.concat(F.lit(f"{d}_"), F.date_format(m, "yyyyMM"), F.lit(".parquet")).alias("filename"), F.col(m).alias("month")).distinct()
    plan = publish_plan(listed("stock", f.stock, "month").unionByName(listed("outflow", f.all_outflow, "file_month")), "stock")
    return plan.select("dataset", month_key(F.col("month")).alias("month"), "filename", "latest_only")
