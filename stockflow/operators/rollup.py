"""Rollups of the monthly base: stocks take the last month, flows add up, rates are ratios of sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockflow.functions.calendar import bridge

SMALL = 30


def rated(numerator: Column, denominator: Column, digits: int = 4) -> Column:
    """Ratio of sums; NULL where the denominator is 0 or either side is NULL."""
    return F.round(F.try_divide(numerator, denominator), digits)


def roll_up(base: DataFrame, flows: list[str], by: list[str] | None = None) -> DataFrame:
    """Per key, grain and period: last stock, mean stock, sums of flows, months published and expected, partial."""
    keys = ["entity", *(by or []), "grain", "period"]
    periods = F.broadcast(bridge(base.select("month").distinct()))
    out = base.join(periods, "month").groupBy(*keys).agg(
        F.max("month").alias("last_month"),
        F.max_by("stock", "month").alias("stock"),
        F.round(F.avg("stock"), 4).alias("mean_stock"),
        *(F.sum(f).alias(f) for f in flows),
        F.count("*").alias("months"),
        F.max("expected").alias("expected"),
    )
    return out.withColumn("partial", F.col("months") < F.col("expected"))


def stock_change(rolled: DataFrame, by: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy("entity", *(by or []), "grain").orderBy("last_month")
    return rolled.withColumn("stock_change", F.col("stock") - F.lag("stock").over(w))


def trailing(base: DataFrame, flow: str, by: list[str] | None = None, n: int = 12) -> DataFrame:
    """Sum of a flow and mean stock over the last n months; NULL before n months."""
    w = Window.partitionBy("entity", *(by or [])).orderBy("month").rowsBetween(1 - n, 0)
    full = F.count("*").over(w) == n
    return base.withColumn("t_flow", F.when(full, F.sum(flow).over(w))).withColumn("t_mean", F.when(full, F.round(F.avg("stock").over(w), 4)))


def guarded(flow: Column, mean: Column) -> list[Column]:
    """Numerator, denominator, rate and small-base flag; all NULL on a zero mean."""
    some = mean > 0
    return [F.when(some, flow).alias("rate_num"), F.when(some, mean).alias("rate_den"), rated(flow, F.when(some, mean)).alias("rate"), F.when(some, mean < SMALL).alias("small_base")]


def running(base: DataFrame, eras: DataFrame, flows: list[str], by: list[str] | None = None) -> DataFrame:
    """Per era and month in it: running flows and mean stock, stock in the month before the era, change since."""
    by = by or []
    inside = base.join(F.broadcast(eras), (F.col("month") >= F.col("first_month")) & (F.col("month") <= F.col("last_month")))
    w = Window.partitionBy("entity", *by, "era").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    out = inside.withColumn("n", F.count("*").over(w))
    for f in flows:
        out = out.withColumn(f"run_{f}", F.sum(f).over(w))
    out = out.withColumn("run_mean", F.round(F.avg("stock").over(w), 4))
    start = base.select("entity", *by, F.add_months("month", 1).alias("first_month"), F.col("stock").alias("stock_0"))
    return out.join(start, ["entity", *by, "first_month"], "left").withColumn("change", F.col("stock") - F.col("stock_0"))
