"""Look-up pages over a table that is stored in order: a page reads the files that hold it, and no others.

``build`` writes rows in order with an index, a row a file: its path, its number in the order and its rows. A page's place
in the order gives its files. With a condition the hits are counted by file first (one pass over the columns it reads);
then too a page reads its files only. What comes to the driver is at most a page's files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockflow.operators import order as O


def build(rows: DataFrame, by: list[str], path: str, rows_per_file: int = 5_000_000) -> None:
    """Store ``rows`` in the order of ``by``, then of every other column that has an order, and the index of their files: no two builds place rows otherwise."""
    ties = [f.name for f in rows.schema.fields if f.name not in by and "map<" not in f.dataType.simpleString()]
    O.write_ordered(rows, [*by, *ties], f"{path}/rows", rows_per_file=rows_per_file)
    stored = O.stored(rows.sparkSession, f"{path}/rows").withColumn("_path", F.col("_metadata.file_path"))
    stored.groupBy("_path", "_file").agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/index")


def displayed(code: Column, names: dict[str, str]) -> Column:
    """A code's display name; a code without one stands for itself."""
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(table[code], code)


def contains(term: str, *shown: str | Column) -> Column:
    """Whether any shown column holds the term, upper and lower case alike, blanks at its ends aside; an empty term is in all rows."""
    wanted = term.strip().lower()
    cells = [F.lower(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))) for c in shown]
    out = F.lit(wanted == "")
    for c in cells:
        out = out | F.contains(c, F.lit(wanted))
    return out


def page(spark: SparkSession, path: str, number: int, size: int = 50, condition: Column | None = None) -> DataFrame:
    """The rows of one page (from 1 on) with page, pages, total and their place among all hits. Pages below 1 and beyond the last are clamped; without hits there is no row."""
    index = spark.read.parquet(f"{path}/index")
    if condition is not None:
        hits = O.stored(spark, f"{path}/rows").where(condition).groupBy(F.col("_file").alias("_hit")).agg(F.count("*").alias("hits"))
        index = index.join(hits, F.col("_file") == F.col("_hit")).select("_path", "_file", F.col("hits").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = index.withColumns({"before": before, "total": F.sum("n").over(Window.partitionBy())})
    total = files.agg(F.coalesce(F.max("total"), F.lit(0)).alias("total")).first()["total"]
    pages = max(1, -(-total // size))
    number = min(max(number, 1), pages)
    first, last = (number - 1) * size + 1, min(number * size, total)
    own = files.where((F.col("before") < last) & (F.col("before") + F.col("n") >= first)).select("_path", "before").collect()  # each holds a row of the page: at most ``size`` of them
    whole = spark.read.parquet(f"{path}/rows").schema
    if not own:
        return spark.createDataFrame([], whole).select("*", *(F.lit(x).cast("long").alias(c) for c, x in (("page", 1), ("pages", 1), ("total", 0), ("place", 0))))
    rows = spark.read.schema(whole).parquet(*(r["_path"] for r in own)).select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row"))
    rows = rows if condition is None else rows.where(condition)
    rank = F.col("_row") + 1 if condition is None else F.row_number().over(Window.partitionBy("_path").orderBy("_row"))
    starts = spark.createDataFrame([(r["_path"], r["before"]) for r in own], "_path string, _before long")
    placed = rows.withColumn("_rank", rank).join(F.broadcast(starts), "_path").withColumn("place", F.col("_before") + F.col("_rank"))
    kept = placed.where(F.col("place").between(first, last)).drop("_path", "_row", "_rank", "_before")
    return kept.select(*whole.names, *(F.lit(x).cast("long").alias(c) for c, x in (("page", number), ("pages", pages), ("total", total))), F.col("place").cast("long").alias("place"))
