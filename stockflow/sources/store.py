"""A stored table with a kept ledger: rows by source file and load, and a ledger that says which loads count.

Rows of a load are written first, each source file in a partition of its own (``source_file``, ``load``), by dynamic
partition overwrite: a load that failed half way and comes again replaces what it left. One write to the ledger then makes
the load count. Readers take, of each source file, the partition of its last entry, so they see it whole, before or after;
files of other sources are never touched. What no longer counts is deleted apart. One writer at a time.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

FILES = "source_file string, size long, modified timestamp"
ENTRY = f"{FILES}, rows long, action string, at timestamp, load string"
LOADED, REMOVED = "loaded", "removed"


def ledger(spark: SparkSession, store: str) -> DataFrame:
    """All entries: source_file, size, modified, rows, action (loaded, removed), at, load."""
    try:
        return spark.read.schema(ENTRY).parquet(f"{store}/ledger")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ENTRY)


def current(spark: SparkSession, store: str) -> DataFrame:
    """The last entry of each source file that is loaded and not removed."""
    last = ledger(spark, store).groupBy("source_file").agg(F.max(F.struct("at", "load", "size", "modified", "rows", "action")).alias("last"))
    return last.select("source_file", "last.*").where(F.col("action") == LOADED).drop("action")


def _stored(spark: SparkSession, store: str) -> DataFrame:
    """All stored rows; names of partitions are text, whatever they look like."""
    found = spark.read.option("mergeSchema", True).parquet(f"{store}/rows").schema
    named = StructType([StructField(x.name, StringType()) if x.name in ("source_file", "load") else x for x in found.fields])
    return spark.read.schema(named).parquet(f"{store}/rows")


def rows(spark: SparkSession, store: str) -> DataFrame:
    """The rows that count, with their source_file and load: partitions that the ledger does not name are not read."""
    return _stored(spark, store).join(current(spark, store).select("source_file", "load"), ["source_file", "load"])


def _enter(entries: DataFrame, store: str, load: str) -> None:
    entries.select("source_file", "size", "modified", "rows", "action", F.current_timestamp().alias("at"), F.lit(load).alias("load")).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load").parquet(f"{store}/ledger")


def has(spark: SparkSession, store: str, load: str) -> bool:
    return bool(ledger(spark, store).where(F.col("load") == load).limit(1).count())


def add(df: DataFrame, files: DataFrame, store: str, load: str, between: Callable[[], None] = lambda: None) -> str:
    """Load the rows of ``files`` (source_file, size, modified) out of ``df`` (with source_file) as ``load``: "loaded", "nothing new", or "already loaded".

    A load that the ledger has adds nothing, nor does a file whose current entry has the same size and time. A file with
    other ones replaces what was loaded of it, once the ledger says so. Files without rows have an entry too. ``between`` runs when rows
    are written and the ledger is not.
    """
    spark = df.sparkSession
    if has(spark, store, load):
        return "already loaded"
    now = current(spark, store).select("source_file", "size", "modified")
    new = files.select("source_file", "size", "modified").join(now, ["source_file", "size", "modified"], "left_anti")
    counted = new.join(df.groupBy("source_file").agg(F.count("*").alias("rows")), "source_file", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    found = counted.withColumn("action", F.lit(LOADED))
    if not new.limit(1).count():
        return "nothing new"
    fresh = df.join(new.select("source_file"), "source_file", "left_semi").withColumn("load", F.lit(load))
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_file", "load").parquet(f"{store}/rows")
    between()
    _enter(found, store, load)
    return LOADED


def supersede(spark: SparkSession, manifest: DataFrame, store: str, load: str) -> DataFrame:
    """Remove what left the manifest (source_file, size, modified) as ``load``, and return its files that are to be loaded: new ones, and those with another size or time."""
    now = current(spark, store)
    gone = now.join(manifest, "source_file", "left_anti").select("source_file", "size", "modified", F.lit(0).cast("long").alias("rows"), F.lit(REMOVED).alias("action"))
    if not has(spark, store, load) and gone.limit(1).count():
        _enter(gone, store, load)
    return manifest.join(now.select("source_file", "size", "modified"), ["source_file", "size", "modified"], "left_anti")


def sweep(spark: SparkSession, store: str) -> int:
    """Delete the partitions that no longer count, and how many. For when no reader of an older state is left; the partitions' names, not their rows, come to the driver, a thousand at a time."""
    there = _stored(spark, store).select("source_file", "load", F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder")).distinct()
    stale = there.join(current(spark, store).select("source_file", "load"), ["source_file", "load"], "left_anti").select("folder")
    jvm, n = spark.sparkContext._jvm, 0
    for r in stale.toLocalIterator():
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(r.folder))
        with contextlib.closing(jvm.org.apache.hadoop.fs.FileSystem.newInstance(path.toUri(), spark.sparkContext._jsc.hadoopConfiguration())) as fs:
            n += bool(fs.delete(path, True))
    return n
