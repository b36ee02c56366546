"""Cubes over dimension values and overlapping groups, built from monthly counts on a dense grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockflow.functions.calendar import bridge
from stockflow.functions.rules import UNKNOWN
from stockflow.operators import base as B
from stockflow.operators.rollup import SMALL, rated


def value_base(stock: DataFrame, flow: DataFrame, values: DataFrame, by: list[str]) -> DataFrame:
    """Per entity (and keys) that occurs, month and dimension value: flow and, where the stock has the dimension, stock; 0 where none."""
    parts = [(flow, "effective_month", [F.count("*").alias("flow")])]
    if "value" in stock.columns:
        parts.append((stock, "month", [F.count("*").alias("stock")]))
    return B.dense(B.counted(parts, [*by, "value"]), ["entity", *by], B.months_of(stock), values.select("value"))


def breakdown(base: DataFrame, by: list[str], months: DataFrame) -> DataFrame:
    """Per fiscal year and value: flow, share of known, coverage; with a stock: rate, not_applicable and small base.

    Unknown values have counts only. A value without any stock has no rate and is not applicable, never a small base.
    """
    p = F.broadcast(bridge(months).where("grain = 'fy'"))
    keys = ["entity", *by, "period"]
    has_stock = "stock" in base.columns
    more = [F.round(F.avg("stock"), 4).alias("mean_stock")] if has_stock else []
    out = base.join(p, "month").groupBy(*keys, "value").agg(F.sum("flow").alias("flow"), (F.count("*") < F.max("expected")).alias("partial"), *more)
    w = Window.partitionBy(*keys)
    known, whole = F.sum(F.when(F.col("value") != UNKNOWN, F.col("flow"))).over(w), F.sum("flow").over(w)
    is_known = F.col("value") != UNKNOWN
    out = out.withColumns({"share_den": F.when(is_known, known), "share": F.when(is_known, rated(F.col("flow"), known)), "coverage": rated(known, whole)})
    if has_stock:
        some = is_known & (F.col("mean_stock") > 0)
        out = out.withColumns({"rate": F.when(some, rated(F.col("flow"), F.col("mean_stock"))), "not_applicable": is_known & (F.col("mean_stock") == 0), "small_base": some & (F.col("mean_stock") < SMALL)})
    return out


def overlapping(rows: DataFrame, bridge_: DataFrame, month: str, measure: Column) -> DataFrame:
    """Counts per node of a code hierarchy: a row counts in every node of its code. The bridge is a configuration table."""
    return B.with_total(rows.join(bridge_, "code"), month, ["node"], [measure])


def with_share(df: DataFrame, keys: list[str], measure: str, whole: str = "all") -> DataFrame:
    """The share of each node in the whole of the same keys."""
    total = F.max(F.when(F.col("node") == whole, F.col(measure))).over(Window.partitionBy(*keys))
    return df.withColumn("share", rated(F.col(measure), total))
