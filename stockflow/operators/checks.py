"""Checks of frames: what they return are violations, so an empty frame is a pass. Each is tested on a planted violation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockflow.sources.files import work_dir


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def partition(base: DataFrame, parts: dict[str, list[str]], keys: list[str]) -> DataFrame:
    """Rows whose parts don't add up to their whole, for some whole."""
    wrong = [reduce(lambda a, b: a + b, (F.col(c) for c in cs)) != F.col(whole) for whole, cs in parts.items()]
    return base.where(any_of(wrong)).select(*keys)


def sums(base: DataFrame, finer: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """keys, measure, value, summed: measures of ``base`` that the rows of ``finer`` don't add up to, missing rows being 0."""
    n = finer.groupBy(*keys).agg(*(F.sum(m).alias(f"_{m}") for m in measures))
    both = base.select(*keys, *measures).join(n, keys, "full_outer")
    rows = both.select(*keys, F.inline(F.array(*(F.struct(F.lit(m).alias("measure"), F.coalesce(m, F.lit(0)).cast("long").alias("value"), F.coalesce(f"_{m}", F.lit(0)).cast("long").alias("summed")) for m in measures))))
    return rows.where("value <> summed")


def plain_cells(rows: DataFrame, month: str, values: dict[str, Column]) -> DataFrame:
    """entity, month, dimension, v, flow: counts of rows by each dimension's values. Rows are counted where they lie; what joins the cells later (ends, eras) deals out counts, never rows by their few entities."""
    each = F.array(*(F.struct(F.lit(d).alias("dimension"), v.alias("v")) for d, v in values.items()))
    return rows.select("entity", F.col(month).alias("month"), F.inline(each)).groupBy("entity", "month", "dimension", "v").agg(F.count("*").alias("flow"))


def row_sets(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, problem: keys that only one of two frames has."""
    a, b = a.select(*keys).distinct(), b.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("problem", F.lit("missing")).unionByName(b.join(a, keys, "left_anti").withColumn("problem", F.lit("extra")))


def multisets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, with repetitions, that only one of two frames has."""
    return a.exceptAll(b).withColumn("problem", F.lit("missing")).unionByName(b.exceptAll(a).withColumn("problem", F.lit("extra")))


def monthly_figures(df: DataFrame, month: str, columns: list[str], mark: str = "REDACTED") -> DataFrame:
    """month, column, n, missing, redacted, low, xor: for each month, of each column and of whole rows (column "*"), counts and two figures of hashes that no order changes, in one pass."""
    text = lambda c: F.to_json(F.struct(F.col(c).alias("v")))
    hashes = {c: F.xxhash64(text(c)) for c in columns} | {"*": F.xxhash64(F.to_json(F.struct(*sorted(columns))))}
    aggregates = []
    for i, (c, h) in enumerate(hashes.items()):
        none = F.lit(0).cast("long") if c == "*" else F.count_if(F.col(c).isNull())
        hidden = F.lit(0).cast("long") if c == "*" else F.count_if(F.col(c).cast("string") == mark)
        aggregates += [none.alias(f"m{i}"), hidden.alias(f"r{i}"), F.sum(F.pmod(h, F.lit(2**31))).alias(f"l{i}"), F.bit_xor(h).alias(f"x{i}")]
    one = df.groupBy(F.col(month).alias("month")).agg(F.count("*").alias("n"), *aggregates)
    cells = (F.struct(F.lit(c).alias("column"), F.col("n").alias("n"), F.col(f"m{i}").alias("missing"), F.col(f"r{i}").alias("redacted"), F.col(f"l{i}").alias("low"), F.col(f"x{i}").alias("xor")) for i, c in enumerate(hashes))
    return one.select("month", F.inline(F.array(*cells)))


def differing_months(a: DataFrame, b: DataFrame, month: str, columns: list[str]) -> DataFrame:
    """month, column, n, n_other, missing, missing_other, redacted, redacted_other: months and columns ("*": whole rows) whose figures differ between two frames."""
    figures = ["n", "missing", "redacted", "low", "xor"]
    x, y = (monthly_figures(df, month, columns) for df in (a, b))
    y = y.select(F.col("month").alias("_month"), F.col("column").alias("_column"), *(F.col(c).alias(f"{c}_other") for c in figures))
    both = x.join(y, F.col("month").eqNullSafe(F.col("_month")) & (F.col("column") == F.col("_column")), "full_outer")
    differ = both.where(~any_equal(figures))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return differ.select(F.coalesce("month", "_month").alias("month"), F.coalesce("column", "_column").alias("column"), *(zero(c) for f in figures[:3] for c in (f, f"{f}_other")))


def any_equal(figures: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"{c}_other")) for c in figures))


#: Rows of both frames that a task of ``multisets_by_month`` compares, about: what it holds in memory.
ROWS_PER_TASK = 1_000_000


def multisets_by_month(a: DataFrame, b: DataFrame, month: str, columns: list[str]) -> DataFrame:
    """Rows (of month and columns), with repetitions, that only one of two frames has. Figures by month come first: only months whose rows differ are compared row by row, and equal frames are not compared at all.

    The figures are stored, a row a month, so that they are worked out once. They tell how many rows there are to
    compare, and so many tasks compare them: more rows make more tasks, not larger ones.
    """
    names = [month, *(c for c in columns if c != month)]
    out = work_dir(a.sparkSession, "differing-months")
    differing_months(a, b, month, columns).where(F.col("column") == "*").select(F.col("month").alias("_month"), "n", "n_other").coalesce(1).write.parquet(out)
    months = a.sparkSession.read.parquet(out)
    n = months.agg(F.sum(F.col("n") + F.col("n_other")).alias("n")).first()["n"]
    if n is None:
        return a.select(*names).limit(0).withColumn("problem", F.lit("missing"))
    of = lambda df: df.select(*names).join(F.broadcast(months.select("_month")), F.col(month).eqNullSafe(F.col("_month")), "left_semi").repartition(-(-n // ROWS_PER_TASK), *names)
    return multisets(of(a), of(b))


def jumps(months: DataFrame, measure: str, limit: float, listed: list[str]) -> DataFrame:
    """month, change: months whose change from the one before is more than ``limit`` of it and which are not listed. ``months`` has a row a month."""
    before = F.lag(measure).over(Window.orderBy("month"))
    change = F.round(F.try_divide(F.col(measure) - before, before), 4)
    return months.select("month", change.alias("change")).where((F.abs("change") > limit) & ~F.date_format("month", "yyyy-MM-dd").isin(listed))


def period_rows(cube: DataFrame, grain_of: Column) -> DataFrame:
    """entity, grain, period, problem: period rows that contradict themselves."""
    problem = (
        F.when(F.col("months") > F.col("months_in_period"), "too many months")
        .when(F.col("partial") != (F.col("months") < F.col("months_in_period")), "partial flag")
        .when(~grain_of.eqNullSafe(F.col("grain")), "key of another grain")
        .when(F.size(F.split("files", ",")) != F.col("months"), "files")
        .when(F.months_between("last_month", "first_month") + 1 != F.col("months"), "gap")
        .when(F.col("net_flow") != F.col("inflow") - F.col("outflow"), "net flow")
    )
    return cube.select("entity", "grain", "period", problem.alias("problem")).where("problem IS NOT NULL")


def eras(era: DataFrame, base: DataFrame, flows: list[str]) -> DataFrame:
    """entity, group_code, era, n, problem: eras' rows that differ from the months they run over (``base``, with group_code), or groups that don't add up to all."""
    m = base.select("entity", "group_code", F.col("month").alias("month_n"), F.col("stock").alias("_stock"), *(F.col(c).alias(f"_{c}") for c in flows))
    w = Window.partitionBy("entity", "group_code", "era").orderBy("n")
    steps = era.join(m, ["entity", "group_code", "month_n"], "left")
    wrong = [~(F.col(f"run_{c}") - F.coalesce(F.lag(f"run_{c}").over(w), F.lit(0))).eqNullSafe(F.col(f"_{c}")) for c in flows]
    steps = steps.withColumn("_flow", any_of(wrong)).withColumn("_n", F.row_number().over(w) != F.col("n"))
    problem = F.when(F.col("_n"), "months in era").when(~F.col("stock_n").eqNullSafe(F.col("_stock")), "stock").when(F.col("_flow"), "flow")
    rows = steps.select("entity", "group_code", "era", "n", problem.alias("problem")).where("problem IS NOT NULL")
    keys, whole = ["entity", "era", "n"], era.where("group_code = 'all'")
    groups = sums(whole, era.where("group_code <> 'all'"), keys, [f"run_{c}" for c in flows])
    return rows.unionByName(groups.select("entity", F.lit("all").alias("group_code"), "era", "n", F.concat(F.lit("groups: "), "measure").alias("problem")))


def small_bases(cube: DataFrame, den: str, flag: str, keys: list[str], small: int = 30) -> DataFrame:
    """Rows whose small-base flag is not that of their denominator."""
    return cube.where(~F.col(flag).eqNullSafe(F.col(den) < small)).select(*keys)


def gaps(months: DataFrame) -> DataFrame:
    """month: months that do not follow the one before them. ``months`` has a row a month."""
    before = F.lag("month").over(Window.orderBy("month"))
    return months.withColumn("_before", before).where(F.col("month") != F.add_months("_before", 1)).select("month")


def share_sums(cube: DataFrame, keys: list[str]) -> DataFrame:
    """keys: where the known values of a share dimension do not add up to their denominator, or it is there without any."""
    s = cube.where("is_share").groupBy(*keys).agg(F.sum(F.when(~F.col("is_unknown"), F.col("flow"))).alias("known"), F.min("share_den").alias("least"), F.max("share_den").alias("most"))
    wrong = (F.col("least") != F.col("most")) | (F.col("known") != F.col("least")) | (F.col("least").isNull() != (F.coalesce("known", F.lit(0)) == 0))
    return s.where(wrong).select(*keys)


def breaks(listed: DataFrame, fy: Column) -> DataFrame:
    """Listed breaks (fiscal_year, month) whose month lies in another fiscal year."""
    return listed.where(fy != F.col("fiscal_year")).select("fiscal_year", "month")


def crosswalk_problems(crosswalk: DataFrame, data: DataFrame, code: str = "code") -> DataFrame:
    """code, problem: codes listed twice, blank ones, and codes of the data that the crosswalk lacks."""
    listed = crosswalk.groupBy(F.col(code).alias("code")).agg(F.count("*").alias("n"))
    twice = listed.where("n > 1").select("code", F.lit("listed twice").alias("problem"))
    blank = listed.where(F.col("code").isNull() | (F.trim("code") == "")).select("code", F.lit("blank").alias("problem"))
    lost = data.select(F.col(code).alias("code")).distinct().join(listed, "code", "left_anti").select("code", F.lit("not listed").alias("problem"))
    return twice.unionByName(blank).unionByName(lost)


def panel_basis(panel: DataFrame, snapshot: DataFrame) -> DataFrame:
    """month, problem: months of a panel (month, stock, inflow, outflow, net_flow) whose net flow is not in minus out, whose stock is not the snapshot's count (month, stock), or that one side lacks."""
    s = snapshot.select("month", F.col("stock").alias("_stock"))
    why = F.when(F.col("stock").isNull(), "not in the panel").when(F.col("_stock").isNull(), "no snapshot").when(F.col("net_flow") != F.col("inflow") - F.col("outflow"), "net flow").when(F.col("stock") != F.col("_stock"), "stock")
    return panel.join(s, "month", "full_outer").select("month", why.alias("problem")).where("problem IS NOT NULL")
