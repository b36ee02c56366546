"""Monthly files: scans with file metadata, a manifest, a ledger of what is loaded, and sinks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

NAME = r"([a-z]+)_(\d{6})_(\d+)\.parquet$"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where none is configured: a temporary one in local mode, which is set then, else the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        local = spark.sparkContext.master.startswith("local")
        found = tempfile.mkdtemp(prefix="stockflow-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/stockflow-work"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def scan(spark: SparkSession, *paths: str) -> DataFrame:
    """All columns of all files by name, with the file's name."""
    return spark.read.option("mergeSchema", True).parquet(*paths).select("*", F.col("_metadata.file_name").alias("source_file"))


def name_parts(name: Column) -> list[Column]:
    """Dataset, month and version from a file's name."""
    return [F.regexp_extract(name, NAME, 1).alias("dataset"), F.try_to_date(F.regexp_extract(name, NAME, 2), "yyyyMM").alias("period"), F.regexp_extract(name, NAME, 3).try_cast("int").alias("version")]


def to_load(manifest: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files that the ledger doesn't have."""
    return manifest.join(ledger, ["dataset", "filename"], "left_anti")


def superseded(table: DataFrame, manifest: DataFrame) -> DataFrame:
    """The table without rows of files that left the manifest."""
    return table.join(manifest.select(F.col("filename").alias("source_file")), "source_file", "left_semi")


def ledger_difference(manifest: DataFrame, ledger: DataFrame) -> DataFrame:
    """filename, problem: files that the manifest lists and the ledger lacks, and the other way round."""
    keys = ["dataset", "filename"]
    missing = manifest.join(ledger, keys, "left_anti").select("filename", F.lit("not loaded").alias("problem"))
    return missing.unionByName(ledger.join(manifest, keys, "left_anti").select("filename", F.lit("not listed").alias("problem")))


def publish_plan(manifest: DataFrame, stock: str, year_end: int = 9) -> DataFrame:
    """Files (dataset, filename, month) to publish: every month of the flows; of the dataset ``stock`` those of the fiscal year's last month, and the latest one, which ``latest_only`` marks where it is no year's end."""
    is_stock = F.col("dataset") == stock
    latest = manifest.where(is_stock).agg(F.max("month").alias("_latest"))
    rows = manifest.crossJoin(F.broadcast(latest))
    ends = F.month("month") == year_end
    return rows.where(~is_stock | ends | (F.col("month") == F.col("_latest"))).withColumn("latest_only", is_stock & ~ends).drop("_latest")


def _figures(columns: list[str]) -> list[Column]:
    h = F.xxhash64(F.to_json(F.struct(*sorted(columns))))
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.pmod(h, F.lit(2**31))), F.lit(0)).alias("low"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor")]


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: rows and two order-insensitive figures of row hashes, which no partitioning changes."""
    return df.agg(*_figures(df.columns))


HISTORY = "name string, source string, path string, rows long, low long, xor long, at timestamp"


def history(spark: SparkSession, store: str) -> DataFrame:
    """All promotions of a store, oldest first: a table that is only appended to."""
    spark.createDataFrame([], HISTORY).write.mode("append").parquet(f"{store}/history")
    return spark.read.schema(HISTORY).parquet(f"{store}/history").orderBy("at")


def published(spark: SparkSession, store: str, name: str) -> DataFrame:
    """The current content of ``name``: that of its last promotion."""
    last = history(spark, store).where(F.col("name") == name).agg(F.max_by("path", "at").alias("path")).first()["path"]
    return spark.read.parquet(last)


def publish(df: DataFrame, checks: Callable[[DataFrame], list[DataFrame]], store: str, name: str, source: str, complete: bool = True) -> str:
    """Write, audit, publish. What is said: published, unchanged, or refused and why.

    Rows go to a new folder, so readers of the current content are not disturbed; the stage is read back and must have the
    figures observed while it was written, and every frame of ``checks(stage)`` must be empty. One row in the history then
    makes it current. ``source`` says what it was made from (later ones sort after earlier ones): an older one than the
    current content's is refused, and so is a build that is not ``complete``; the same rows of the same source are no new
    promotion.
    """
    spark = df.sparkSession
    if not complete:
        return "refused: it is incomplete"
    before = history(spark, store).where(F.col("name") == name).orderBy(F.desc("at")).first()
    if before and source < before["source"]:
        return "refused: its source is older"
    path, seen = f"{store}/{name}/{uuid.uuid4().hex}", Observation()
    df.observe(seen, *_figures(df.columns)).write.parquet(path)
    staged = spark.read.parquet(path)
    figures = fingerprint(staged).first()
    if figures.asDict() != seen.get:
        return "refused: the stage is not what was written"
    if any(c.limit(1).count() for c in checks(staged)):
        return "refused: a check finds something"
    if before and source == before["source"] and all(figures[c] == before[c] for c in ("rows", "low", "xor")):
        return "unchanged"
    row = spark.range(1).select(F.lit(name).alias("name"), F.lit(source).alias("source"), F.lit(path).alias("path"), *(F.lit(figures[c]).cast("long").alias(c) for c in ("rows", "low", "xor")), F.current_timestamp().alias("at"))
    row.coalesce(1).write.mode("append").parquet(f"{store}/history")
    return "published"
