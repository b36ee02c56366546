"""Places in a total order."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockflow.sources.files import work_dir


def by_column(column: str, descending: bool, *ties: str) -> list[Column | str]:
    """The order by a chosen column, up or down, empties last either way, then by ``ties``."""
    return [F.desc_nulls_last(column) if descending else F.asc_nulls_last(column), *ties]


def by_priority(column: str, listed: list[str]) -> list[Column]:
    """The order of codes: listed ones first as they are listed, then numbers by their value, then other text, empties last."""
    first = F.lit(len(listed))
    for i, code in enumerate(listed):
        first = F.when(F.col(column) == code, i).otherwise(first)
    number = F.col(column).try_cast("double")
    return [F.col(column).isNull(), first, number.isNull(), number, F.col(column)]


def placed(rows: DataFrame, by: list[str | Column]) -> DataFrame:
    """``rows`` with their place from 1 on in the order of ``by``: sorted by ranges and numbered within each.

    The sorted rows are written once, each with its range; the ranges' sizes, one row a range, give the first place of
    each. Rows alike in ``by`` are of one range and have some order.
    """
    spark = rows.sparkSession
    out = work_dir(spark, "placed")
    part, at = f"part_{uuid.uuid4().hex}", f"at_{uuid.uuid4().hex}"
    rows.sort(*by).withColumn(part, F.spark_partition_id()).write.parquet(out)
    done = spark.read.parquet(out)
    sizes = done.groupBy(part).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(part, before.alias(at))
    place = F.row_number().over(Window.partitionBy(part).orderBy(*by))
    return done.join(F.broadcast(starts), part).withColumn("place", (F.col(at) + place).cast("long")).drop(part, at)


def write_ordered(rows: DataFrame, by: list[str], path: str, rows_per_group: int = 100_000, rows_per_file: int = 5_000_000) -> None:
    """Write ``rows`` as Parquet whose files, by name, and rows within them are in the order of ``by``: ranges are sorted apart, and each writes its files. Row groups and files hold so many rows at most."""
    out = rows.sort(*by).write.option("compression", "zstd").option("parquet.block.row.count.limit", rows_per_group).option("maxRecordsPerFile", rows_per_file)
    out.parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows with their file's numbers (range, and file of the range) and their row in it."""
    name = F.col("_metadata.file_name")
    numbers = F.struct(F.regexp_extract(name, r"^part-(\d+)", 1).cast("int").alias("range"), F.coalesce(F.regexp_extract(name, r"[-.]c(\d+)[.]", 1).try_cast("int"), F.lit(0)).alias("file"))
    return spark.read.parquet(path).select("*", numbers.alias("_file"), F.col("_metadata.row_index").alias("_row"))


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """The rows that ``write_ordered`` stored, with their place from 1 on. Only a row a file comes together."""
    rows = stored(spark, path)
    sizes = rows.groupBy("_file").agg(F.count("*").alias("_n"))
    starts = sizes.select("_file", F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(starts, "_file").withColumn("place", (F.col("_before") + F.col("_row") + 1).cast("long")).drop("_file", "_row", "_before")


def order_violations(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """file, row: stored rows that come before the one that stands before them: within each file by its rows, and across files by their first and last."""
    key = F.struct(*by)
    rows = stored(spark, path).select("_file", "_row", key.alias("_key"))
    before = F.lag("_key").over(Window.partitionBy("_file").orderBy("_row"))
    inside = rows.withColumn("_before", before).where("_before > _key").select("_file", "_row")
    ends = rows.groupBy("_file").agg(F.min_by("_key", "_row").alias("_first"), F.max_by("_key", "_row").alias("_last"))
    across = ends.withColumn("_before", F.lag("_last").over(Window.orderBy("_file"))).where("_before > _first").select("_file", F.lit(0).cast("long").alias("_row"))
    return inside.unionByName(across).select(F.concat_ws("-", "_file.range", "_file.file").alias("file"), F.col("_row").alias("row"))
