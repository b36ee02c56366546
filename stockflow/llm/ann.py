"""Approximate nearest neighbours by cosine: a hash-prefix forest in each shard.

Each tree is a sorted array of hash strings, one bit for the side of a random hyperplane. A query descends to its longest
matching prefix in every tree; then all trees ascend together, one bit at a time, until the entries under the prefixes
are ENTRIES times the shard's rows. A row is met once in each tree where it shares the prefix; the rows met most often, a
bounded share of the shard, are scored exactly. Equal vectors enter once and are expanded afterwards, so a common vector
is no large bucket. A forest is built once and written; query blocks then come by.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockflow.llm.common import written
from stockflow.llm.vectors import Arrays, joined, keyed, search, valid

BITS = 16
TREES = 384
ENTRIES = 2.0
SCORED, LEAST_SCORED = 0.09, 180


def hash_strings(v: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """Hash strings of BITS bits as numbers (first bit highest), trees x rows; the same planes everywhere, orthogonal by sets of the dimension's size."""
    rng, dim = np.random.default_rng(seed), v.shape[1]
    planes = np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-trees * BITS // dim))], axis=1)[:, : trees * BITS]
    bits = np.packbits((v @ planes > 0).reshape(len(v), trees, BITS), axis=2)
    return np.ascontiguousarray((bits[:, :, 0].astype(np.uint16) << 8 | bits[:, :, 1]).T)


def forest(arrays: Arrays, trees: int, seed: int) -> Arrays:
    """The shard's rows with their sorted arrays: hash strings, and the rows in their order."""
    code = hash_strings(arrays["vector"], trees, seed)
    order = np.argsort(code, axis=1, kind="stable")
    return arrays | {"norm": np.sqrt((arrays["vector"] ** 2).sum(axis=1)), "strings": np.take_along_axis(code, order, axis=1), "order": order.astype(np.uint16 if len(code.T) <= 1 << 16 else np.int32)}


def candidates(index: Arrays, code: np.ndarray, entries: float, most: int, least: int = 0) -> list[np.ndarray]:
    """The rows met most often, ``most`` at most, for each query, whose hash strings are a column of ``code``.

    Of rows met alike the first are taken. Trees ascend together until they hold ``entries`` times the shard's rows,
    and ``least`` different ones.
    """
    strings, order = index["strings"], index["order"]
    trees, n = strings.shape
    found: list[np.ndarray] = [np.zeros(0, np.int64)] * code.shape[1]
    left, enough = np.arange(code.shape[1]), min(entries, trees) * n
    for level in range(BITS, -1, -1):
        drop = BITS - level
        low = (code[:, left].astype(np.int64) >> drop) << drop
        lo = np.stack([np.searchsorted(s, c, "left") for s, c in zip(strings, low, strict=True)])
        hi = np.stack([np.searchsorted(s, c, "right") for s, c in zip(strings, low + (1 << drop) - 1, strict=True)])
        done = (hi - lo).sum(axis=0) >= enough
        for at in np.flatnonzero(done):
            size = hi[:, at] - lo[:, at]
            place = np.repeat(np.arange(trees) * n + lo[:, at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            met = np.bincount(order.reshape(-1)[place], minlength=n)
            rows = np.flatnonzero(met)
            if len(rows) < min(least, n):
                done[at] = False
                continue
            if len(rows) > most:
                rank = met[rows] * n + (n - 1 - rows)
                rows = np.sort(rows[np.argpartition(rank, len(rows) - most)[len(rows) - most :]])
            found[left[at]] = rows
        left = left[~done]
        if not len(left):
            break
    return found


def nearest(df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, entries: float = ENTRIES, scored: float = SCORED, seed: int = 7, rows_per_shard: int = 4096, queries_per_block: int = 512) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest found by cosine, in double precision.

    Nearest first, ties to the smaller vec_id; rows with a query's own vec_id are no candidates; fewer candidates than k
    give all found. Rows without id, and vectors that are null, empty, zero or hold null or non-finite components, take
    no part; repeated rows count once; several vectors of an id are candidates and queries of their own; vectors of
    different lengths never meet. At most ``scored`` of a shard's rows, or LEAST_SCORED rows, are scored. Empty tables give no rows.
    """
    usable = lambda d: valid(d, id_col, vector_col).where(F.exists("vector", lambda x: x != 0))
    # of equal vectors the k + 1 smallest ids can be in a result; the limit works before the shuffle, so a common vector is cut there
    w = Window.partitionBy("vector").orderBy("vec_id")
    few = usable(df).withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1)
    classes = few.groupBy("vector", "dim").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    classes = written(classes.withColumn("class", F.monotonically_increasing_id()), "vectors")
    first = F.col("members")[0]
    # a class of one vec_id is no candidate for that id
    rows = classes.select("class", first.alias("first"), F.when(F.size("members") == 1, first).otherwise(-1).alias("only"), F.when(F.size("members") == 1, 1).otherwise(0).cast("long").alias("single"), "vector", "dim")

    def find(index: Arrays, q: Arrays) -> pd.DataFrame:
        n = len(index["norm"])
        parts, norms = [], np.sqrt((q["vector"] ** 2).sum(axis=1))
        least = max(4 * (k + 1), LEAST_SCORED)
        for i, c in enumerate(candidates(index, q["strings"], entries, max(least, int(scored * n)), least)):
            c = c[(index["only"][c] != q["query_id"][i]) | (index["single"][c] == 0)]
            s = (index["vector"][c] @ q["vector"][i]) / (index["norm"][c] * norms[i])
            o = np.lexsort((index["first"][c], -s))[:k]
            parts.append((np.full(len(o), q["query_id"][i]), np.full(len(o), q["query_key"][i]), index["class"][c][o], index["first"][c][o], s[o]))
        return joined(parts, ["query_id", "query_key", "class", "first", "score"])

    prepare = lambda a: a | {"strings": hash_strings(a["vector"], trees, seed)}
    found = search(rows, keyed(usable(queries)), "class", rows_per_shard, queries_per_block, lambda a: forest(a, trees, seed), prepare, find, "query_id long, query_key long, class long, first long, score double")
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "first"))).where(F.col("n") <= k)
    members = best.join(classes.select("class", "members"), "class").select("query_id", "query_key", "score", F.explode("members").alias("vec_id"))
    top = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    ranked = members.where(F.col("vec_id") != F.col("query_id")).withColumn("rank", F.row_number().over(top))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
