"""Manifests kept refresh by refresh, and what each refresh reissued since the one before.

A refresh is a partition of the state table, written once. Marks are not stored: they follow from two neighbouring
refreshes, so a mark appears with the refresh that changed a file, stays while that is the newest, and goes with the next.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "dataset string, month date, filename string, version long, size long"
KEYS = ["dataset", "month"]


def state(spark: SparkSession, path: str) -> DataFrame:
    """All manifests with their refresh (from 1 on)."""
    try:
        return spark.read.schema(f"{ENTRY}, refresh int").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{ENTRY}, refresh int")


def newest(spark: SparkSession, path: str) -> int:
    """The newest refresh, 0 if there is none."""
    return state(spark, path).agg(F.coalesce(F.max("refresh"), F.lit(0)).alias("n")).first()["n"]


def record(manifest: DataFrame, path: str, refresh: int | None = None) -> int:
    """Keep a manifest as the next refresh and give its number; one with the newest's content is no refresh, so that marks stay.

    ``refresh`` repeats one that failed half way: it replaces what that left. Two files of one dataset and month are refused.
    """
    spark = manifest.sparkSession
    rows = manifest.select(*(c.split()[0] for c in ENTRY.split(", ")))
    if twice := rows.groupBy(*KEYS).count().where("count > 1").first():
        raise ValueError(f"two files of {twice['dataset']} in {twice['month']}")
    last = newest(spark, path)
    if refresh is None:
        own = state(spark, path).where(F.col("refresh") == last).drop("refresh")
        if last and not rows.exceptAll(own).limit(1).count() and not own.exceptAll(rows).limit(1).count():
            return last
        refresh = last + 1
    if refresh not in (last, last + 1):
        raise ValueError(f"refresh {refresh} does not follow {last}")
    rows.withColumn("refresh", F.lit(refresh)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("refresh").parquet(path)
    return refresh


def changes(spark: SparkSession, path: str, refresh: int | None = None) -> DataFrame:
    """dataset, month, version, version_before, change of a refresh (else the newest) against the one before it: new, reissued (other version or size), withdrawn; NULL where nothing changed. In the first, nothing is new."""
    at = newest(spark, path) if refresh is None else refresh
    s = state(spark, path)
    now, before = s.where(F.col("refresh") == at), s.where(F.col("refresh") == at - 1)
    before = before.select(*KEYS, F.col("version").alias("version_before"), F.col("size").alias("size_before"))
    both = now.select(*KEYS, "version", "size").join(before, KEYS, "full_outer")
    first = F.lit(at <= 1)
    change = (
        F.when(F.col("size").isNull(), "withdrawn")
        .when(F.col("size_before").isNull(), F.when(~first, "new"))
        .when(~F.col("version").eqNullSafe(F.col("version_before")) | ~F.col("size").eqNullSafe(F.col("size_before")), "reissued")
    )
    return both.select(*KEYS, "version", "version_before", change.alias("change"))


def flags(spark: SparkSession, path: str, dataset: str, refresh: int | None = None) -> DataFrame:
    """month, reissued, tag of a dataset's files in a refresh (else the newest): what cubes of it are to say."""
    c = changes(spark, path, refresh).where((F.col("dataset") == dataset) & F.col("version").isNotNull())
    return c.select("month", F.coalesce(F.col("change") == "reissued", F.lit(False)).alias("reissued"), F.concat(F.date_format("month", "yyyy-MM"), F.lit(" v"), F.col("version")).alias("tag"))


def wrong_flags(published: DataFrame, flags_: DataFrame) -> DataFrame:
    """month, problem: months whose published flag or tag (month, reissued, tag) is not that of the state, and months that one side lacks."""
    f = flags_.select("month", F.col("reissued").alias("_reissued"), F.col("tag").alias("_tag"), F.lit(True).alias("_there"))
    both = published.select("month", "reissued", "tag", F.lit(True).alias("_here")).join(f, "month", "full_outer")
    why = F.when(F.col("_here").isNull(), "not published").when(F.col("_there").isNull(), "not in the state").when(~F.col("reissued").eqNullSafe(F.col("_reissued")), "flag").when(~F.col("tag").eqNullSafe(F.col("_tag")), "tag")
    return both.select("month", why.alias("problem")).where("problem IS NOT NULL")
