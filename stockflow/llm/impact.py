"""Exact top-k search by an impact-ordered index, score at a time.

A component of a vector is a posting of its dimension, and its absolute value the impact. A shard's index keeps postings
in segments by quantised impact, and within a segment in lists by dimension. A block of queries takes the segments by
descending impact and adds their contributions, each list to the rows that are in it. After a segment, what a row can
still gain or lose is at most the product of two lengths: of its components that are left, and of the query's in the
same dimensions. The rows that lead by then are scored exactly; others that cannot reach the k-th of these, by that
bound, are out. A query stops when the rows that are left have a quarter of the components, at most, that the segments that are
left have postings; those rows, and no others, are then scored exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockflow.llm.vectors import Arrays, joined, keyed, search, valid

SEGMENTS = 8
CHEAPER = 4
FIRST_CHECK = 0.6
QUERIES = 128
LEAST = -(2.0**62)


def impact_index(arrays: Arrays) -> Arrays:
    """``arrays`` (vec_id, vector) with postings (rows and values, by segment and dimension), the lists' ends and the segments' least impacts."""
    v = arrays["vector"]
    impact = np.abs(v)
    some = np.flatnonzero(impact.reshape(-1))
    by_impact = -np.sort(-impact.reshape(-1)[some])
    # a segment is quantised impacts from one bound down to the next; equal impacts are never in two
    bounds = np.unique([by_impact[max(0, len(some) * i // SEGMENTS - 1)] for i in range(1, SEGMENTS + 1)])[::-1] if len(some) else np.zeros(0)
    segment = np.searchsorted(-bounds, -impact.reshape(-1)[some], "left")
    dimension = some % v.shape[1]
    order = np.lexsort((dimension, segment))
    ends = np.cumsum(np.bincount(segment[order] * v.shape[1] + dimension[order], minlength=len(bounds) * v.shape[1]))
    return arrays | {"rows": (some[order] // v.shape[1]).astype(np.int32), "values": v.reshape(-1)[some[order]].astype(np.int32), "ends": ends, "bounds": bounds}


def best_of_shard(index: Arrays, q: Arrays, k: int) -> tuple[list[tuple[np.ndarray, ...]], np.ndarray]:
    """(query_id, query_key, vec_id, score) arrays of each query's k best rows (score descending, id ascending), rows of its own id left out; and, for each query, postings, postings read and rows scored."""
    parts, read = [], []
    for at in range(0, len(q["vector"]), QUERIES):
        some = {name: x[at : at + QUERIES] for name, x in q.items()}
        more, counts = _best_of_some(index, some, k)
        parts += more
        read.append(counts)
    return parts, np.concatenate(read) if read else np.zeros((0, 3), np.int64)


def _best_of_some(index: Arrays, q: Arrays, k: int) -> tuple[list[tuple[np.ndarray, ...]], np.ndarray]:
    v, ids = index["vector"], index["vec_id"]
    # single and double precision hold whole numbers below 2**24 and 2**53 exactly; larger sums are taken as integers
    most = np.abs(v).max(initial=0) * np.abs(q["vector"]).max(initial=0) * v.shape[1]
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    v, w = v.astype(kind), q["vector"].astype(kind)
    rows, dim = v.shape
    n = min(k, rows)
    left = np.arange(len(w))
    may: list[np.ndarray] = [np.arange(rows)] * len(w)
    read = np.zeros((len(w), 3), np.int64)
    read[:, 0] = total = len(index["rows"])
    sums = np.zeros((rows, len(w)), kind)  # of the queries that are left
    own = ids[:, None] == q["query_id"][None, :]
    ends, segments = index["ends"].tolist(), len(index["bounds"])
    postings, values, first = index["rows"], index["values"].astype(kind)[:, None], 0
    for s in range(segments):
        for d in range(dim):
            last = ends[s * dim + d]
            if first < last:
                sums[postings[first:last]] += values[first:last] * w[left, d]
            first = last
        read[left, 1] = first
        if s + 1 < segments and first < FIRST_CHECK * total:
            continue
        rest = np.abs(v) < index["bounds"][s]  # components that are left
        long = np.sqrt((np.where(rest, v, 0).astype(np.float64) ** 2).sum(axis=1)).astype(np.float32)
        bound = np.sqrt(rest.astype(np.float32) @ (w[left].T.astype(np.float32) ** 2))
        bound *= long[:, None] * np.float32(1 + 1e-5)  # more than all rounding
        sums[own[:, left]] = LEAST
        lead = np.argpartition(sums, rows - n, axis=0)[rows - n :]
        exact = np.einsum("nqd,qd->nq", v[lead], w[left]).astype(np.float64)
        exact[np.take_along_axis(own[:, left], lead, axis=0)] = LEAST
        bound += sums
        possible = bound >= (exact.min(axis=0) - 0.5).astype(np.float32) * np.where(exact.min(axis=0) > 0, 1 - 1e-6, 1 + 1e-6).astype(np.float32)
        count = possible.sum(axis=0)
        stop = (count * dim * CHEAPER <= total - first) | (s + 1 == segments)
        for at in np.flatnonzero(stop):
            may[left[at]] = np.flatnonzero(possible[:, at])
        if stop.any():
            left, sums = left[~stop], sums[:, ~stop]
        if not len(left):
            break
    parts = []
    for i, c in enumerate(may):
        c = c[~own[c, i]]
        s = (v[c] @ w[i]).astype(np.int64)
        o = np.lexsort((ids[c], -s))[:k]
        read[i, 2] = len(c)
        parts.append((np.full(len(o), q["query_id"][i]), np.full(len(o), q["query_key"][i]), ids[c][o], s[o]))
    return parts, read


def _searched(df: DataFrame, queries: DataFrame, scale: int, id_col: str, vector_col: str, rows_per_shard: int, queries_per_block: int, find, schema: str) -> DataFrame:
    as_int = lambda d: valid(d, id_col, vector_col).withColumn("vector", F.transform("vector", lambda x: F.floor(F.lit(float(scale)) * x).cast("double")))
    return search(as_int(df), keyed(as_int(queries)), "vec_id", rows_per_shard, queries_per_block, impact_index, lambda a: a, find, schema)


def top_k(df: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", rows_per_shard: int = 4096, queries_per_block: int = 512) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k rows with the highest integer inner product.

    A component x becomes floor(scale * x). Ties go to the smaller vec_id; rows with a query's own vec_id are no
    candidates; fewer candidates than k give all. Rows without id, and vectors that are null, empty or hold null or
    non-finite components, take no part; repeated rows count once; several vectors of an id are candidates and queries of
    their own; vectors of different lengths never meet. Empty tables give no rows.
    """
    find = lambda index, q: joined(best_of_shard(index, q, k)[0], ["query_id", "query_key", "vec_id", "score"])
    found = _searched(df, queries, scale, id_col, vector_col, rows_per_shard, queries_per_block, find, "query_id long, query_key long, vec_id long, score long")
    w = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def postings_read(df: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", rows_per_shard: int = 4096, queries_per_block: int = 512) -> DataFrame:
    """query_id, postings, postings_read and rows_scored: for each query and shard, how much of the index ``top_k`` reads before its proof."""

    def find(index: Arrays, q: Arrays) -> pd.DataFrame:
        return pd.DataFrame(best_of_shard(index, q, k)[1], columns=["postings", "postings_read", "rows_scored"]).assign(query_id=q["query_id"])

    return _searched(df, queries, scale, id_col, vector_col, rows_per_shard, queries_per_block, find, "query_id long, postings long, postings_read long, rows_scored long")
