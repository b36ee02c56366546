"""Guarded sums and comparisons of cube rows. A column's kind says how it may be combined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.functions.rules import UNKNOWN

SUMMABLE = ("flow", "stock_change")


def kinds(df: DataFrame, **of: str) -> DataFrame:
    """``df`` with the kind of columns in their metadata."""
    for name, kind in of.items():
        df = df.withMetadata(name, {"kind": kind})
    return df


def kind_of(df: DataFrame, name: str) -> str | None:
    return df.schema[name].metadata.get("kind")


def poisoned_sum(c: str) -> Column:
    """Sum, or NULL if any value is NULL."""
    return F.when(F.count("*") == F.count(c), F.sum(c))


def sum_entities(df: DataFrame, measure: str, entities: list[str], total: str = "ALL") -> DataFrame:
    """Per period the sum over the entities, with why it is refused (else NULL): total among parts, duplicates, missing ones."""
    chosen = df.where(F.col("entity").isin(entities))
    refused = (
        F.when(F.max((F.col("entity") == total).cast("int")) * F.lit(int(len(entities) > 1)) == 1, "total and part")
        .when(F.count("*") != F.countDistinct("entity"), "duplicate")
        .when(F.countDistinct("entity") < len(set(entities)), "missing")
    )
    out = chosen.groupBy("grain", "period").agg(poisoned_sum(measure).alias("value"), refused.alias("refused"))
    return out.withColumn("value", F.when(F.col("refused").isNull(), F.col("value")))


def sum_periods(df: DataFrame, measure: str, keys: list[str], month: str = "last_month") -> DataFrame:
    """Per key the sum over consecutive months; refused unless the column's kind is summable, NULL over gaps and repeated months."""
    if kind_of(df, measure) not in SUMMABLE:
        raise ValueError(f"{measure} is no flow: it can't be added over time")
    span = F.months_between(F.max(month), F.min(month)).cast("long") + 1
    return df.groupBy(*keys).agg(F.count("*").alias("periods"), F.when((span == F.countDistinct(month)) & (span == F.count("*")), poisoned_sum(measure)).alias("value"))


def sum_values(df: DataFrame, measure: str, values: list[str], keys: list[str]) -> DataFrame:
    """Per key the sum over chosen values of one dimension, with why it is refused (else NULL): repeated or missing values, or ones that are not known."""
    chosen = df.where(F.col("value").isin(values))
    refused = F.when(F.max((F.col("value") == UNKNOWN).cast("int")) == 1, "unknown value").when(F.count("*") != F.countDistinct("value"), "repeated").when(F.countDistinct("value") < len(set(values)), "missing")
    out = chosen.groupBy(*keys).agg(poisoned_sum(measure).alias("total"), refused.alias("refused"))
    return out.withColumn("total", F.when(F.col("refused").isNull(), F.col("total")))
