"""Small helpers shared by the operators: written intermediate tables, clean inputs and row blocks."""

from __future__ import annotations

import ctypes
import math
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.sources.files import shared_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here and a lost executor costs only its tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def blocks_for(rows: int, per_block: int) -> int:
    """How many blocks of about ``per_block`` rows hold ``rows`` rows (1 at least)."""
    return max(1, math.ceil(rows / per_block))


def dealt(key: str | Column, blocks: int) -> Column:
    """Block number of a row: a hash of its key, so that no block depends on data values such as a source."""
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), a null text being empty; other columns, whatever their names, go no further."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def one_text_each(rows: DataFrame, *also: str) -> DataFrame:
    """One row for each doc_id, with the text of the least hash (ties: the smallest) and columns ``also``, that are equal within an id: repeated ids are combined before they are shuffled."""
    best = rows.groupBy("doc_id", *also).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("best"))
    return best.select("doc_id", *also, "best.text")


_HELD: dict[object, object] = {}
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def held(key: object, make):
    """The worker's table for a key, made by ``make()``. A worker keeps one table: the next kind of work drops the last one's."""
    if key not in _HELD:
        let_go()
        _HELD[key] = make()
    return _HELD[key]


def let_go() -> None:
    """Drop the worker's table, and give back to the system what it and earlier work took: a worker lives on from stage to stage."""
    _HELD.clear()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def thrifty(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``run`` for mapInPandas, by a worker that gives memory back before it and once its own tables are gone."""

    def outer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        yield from run(batches)
        let_go()

    return outer
