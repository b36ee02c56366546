"""Searching vectors in shards: valid rows dealt by hash into bounded shards with an index each, and query blocks sent to every shard."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.llm.common import blocks_for, dealt, let_go, written

Arrays = dict[str, np.ndarray]


def valid(df: DataFrame, id_col: str, vector_col: str, **also: Column) -> DataFrame:
    """(vec_id, columns of ``also``, vector, dim) of rows with an id and a non-empty vector of finite components; repeated rows count once, several vectors of an id are rows of their own."""
    v = df.select(F.col(id_col).cast("long").alias("vec_id"), *(c.cast("long").alias(name) for name, c in also.items()), F.col(vector_col).cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)).where(~bad)
    return v.dropDuplicates(["vec_id", *also, "vector"]).withColumn("dim", F.size("vector"))


def to_bytes(arrays: Arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def from_bytes(data: bytes) -> Arrays:
    with np.load(io.BytesIO(data)) as found:
        return dict(found)


def packed(rows: DataFrame, block: Column, name: str, build: Callable[[Arrays], Arrays]) -> DataFrame:
    """One row per block and dimension of ``rows`` (long columns, vector, dim): what ``build`` makes of its columns as arrays, in bytes."""
    longs = [c for c in rows.columns if c not in ("vector", "dim")]

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(longs[0], kind="stable")
        arrays = {c: pdf[c].to_numpy(np.int64) for c in longs} | {"vector": np.vstack(pdf["vector"].to_numpy()).astype(np.float64)}
        return pd.DataFrame({name: [key[0]], "dim": [key[1]], f"{name}_data": [to_bytes(build(arrays))]})

    return rows.withColumn(name, block).groupBy(name, "dim").applyInPandas(pack, f"{name} int, dim int, {name}_data binary")


def search(rows: DataFrame, queries: DataFrame, key: str, per_shard: int, per_queries: int, build: Callable[[Arrays], Arrays], prepare: Callable[[Arrays], Arrays], find: Callable[[Arrays, Arrays], pd.DataFrame], schema: str) -> DataFrame:
    """What ``find(index, queries)`` gives for each query block and each shard.

    ``build`` makes a shard's index, once, of the columns of ``rows`` (``key``, other longs, vector, dim), and ``prepare``
    a block of ``queries`` (query_id, query_key, vector, dim). A shard holds about ``per_shard`` rows and a query block
    ``per_queries``, whatever the input's size; tasks grow in number, not in memory. An index stays in its task while the
    query blocks come by.
    """
    return searched(*indexed(rows, key, per_shard, build), queries, per_queries, prepare, find, schema)


def indexed(rows: DataFrame, key: str, per_shard: int, build: Callable[[Arrays], Arrays]) -> tuple[DataFrame, int]:
    """The written indexes of all shards, as ``search`` describes them, and the number of shards."""
    shards = blocks_for(rows.count(), per_shard)
    return written(packed(rows, dealt(F.xxhash64(key, "vector"), shards), "shard", build), "index"), shards


def searched(index: DataFrame, shards: int, queries: DataFrame, per_queries: int, prepare: Callable[[Arrays], Arrays], find: Callable[[Arrays, Arrays], pd.DataFrame], schema: str) -> DataFrame:
    """The second half of ``search``, for an index that several sets of queries go through."""
    blocks = packed(queries, dealt(F.xxhash64("query_id", "query_key"), blocks_for(queries.count(), per_queries)), "qblock", prepare)
    right = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        last, held = None, {}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if last != (r.shard, r.dim):
                    last, held = (r.shard, r.dim), from_bytes(r.shard_data)
                yield find(held, from_bytes(r.qblock_data))

    pairs = index.repartition(shards, "shard").join(right.repartition(shards, "shard"), ["shard", "dim"])
    return pairs.mapInPandas(run, schema)


def keyed(queries: DataFrame) -> DataFrame:
    """(query_id, query_key, vector, dim): the key tells several vectors of one id apart."""
    return queries.select(F.col("vec_id").alias("query_id"), F.xxhash64("vector").alias("query_key"), "vector", "dim")


def joined(parts: list[tuple[np.ndarray, ...]], columns: list[str]) -> pd.DataFrame:
    """One frame of tuples of arrays."""
    return pd.DataFrame({c: np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i, c in enumerate(columns)})
