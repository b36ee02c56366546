"""Hard negatives by threshold joins: for an anchor and each of its positives, rows of other labels that score in a window below it.

A shard's inverted index leaves out what a bound covers: dimensions stand by falling energy, and at threshold t a row
has postings only as far as the length of the rest of it (its suffix) is at least t for a query of length 1. Postings
come in levels, from high thresholds to low ones, so that lowering the threshold adds postings and repeats none. At each
level the partial scores grow by the new postings; a row whose partial score and whose suffix's length times the query's
in the same dimensions stay below the threshold is pruned, others are scored exactly. From then on every row at or above
the threshold is known. An anchor lowers its threshold until its windows are full or end above it.

The same index serves two joins: with rows of the anchor's own label, for its positives, and then with all others.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockflow.llm.common import written
from stockflow.llm.vectors import Arrays, indexed, joined, searched, valid

GROUPS = 16
QUERIES = 128
LOWER = 0.8
LEAST = 0.13
PAIRS = 1 << 16
SAFE = 1 + 1e-9


def _suffix_lengths(v: np.ndarray) -> np.ndarray:
    """Length of each row from each dimension on, and 0 after the last."""
    squares = np.cumsum((v.astype(np.float64) ** 2)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.hstack([squares, np.zeros((len(v), 1))]))


def threshold_index(arrays: Arrays) -> Arrays:
    """``arrays`` (vec_id, label, vector) sorted by group of labels, with dimensions by falling energy; thresholds from high to 0, each row's end of postings at each, and the postings by group, threshold and dimension."""
    v, group = arrays["vector"], arrays["label"] % GROUPS
    rows, dim = v.shape
    order, perm = np.argsort(group, kind="stable"), np.argsort(-(v**2).sum(axis=0), kind="stable")
    v, group = v[order][:, perm], group[order]
    suffix = _suffix_lengths(v)
    lengths = suffix[:, 0]
    steps, least = [lengths.max(initial=0) * LOWER], LEAST * float(np.median(lengths[lengths > 0])) if (lengths > 0).any() else 0.0
    while steps[-1] * LOWER > least > 0:
        steps.append(steps[-1] * LOWER)
    steps = np.array([*steps, 0.0]) if least > 0 else np.zeros(1)
    cut = np.stack([(suffix[:, :dim] >= t).sum(axis=1) for t in steps], axis=1)
    row, at = np.nonzero(v)
    level = (cut[row] <= at[:, None]).sum(axis=1)
    by = np.lexsort((at, level, group[row]))
    ends = np.cumsum(np.bincount((group[row][by] * len(steps) + level[by]) * dim + at[by], minlength=GROUPS * len(steps) * dim))
    return {
        "vec_id": arrays["vec_id"][order], "label": arrays["label"][order], "vector": v, "perm": perm, "steps": steps, "cut": cut.astype(np.int32),
        "suffix": np.take_along_axis(suffix, cut, axis=1), "rows": row[by].astype(np.int32), "values": v[row[by], at[by]], "ends": ends, "first": np.searchsorted(group, np.arange(GROUPS + 1)),
    }


class _Join:
    """Partial and exact scores of some queries with the rows of some groups, by falling threshold."""

    def __init__(self, index: Arrays, groups: range, w: np.ndarray, may: np.ndarray) -> None:
        self.index, self.groups, self.may = index, groups, may
        self.start, self.stop = int(index["first"][groups.start]), int(index["first"][groups.stop])
        self.v, self.w = index["vector"][self.start : self.stop], w
        most = np.abs(self.v).max(initial=0) * np.abs(w).max(initial=0) * w.shape[1]
        self.kind = np.float64 if most < 2**53 else np.int64
        self.v, self.w = self.v.astype(self.kind), self.w.astype(self.kind)
        self.rest = _suffix_lengths(w)
        self.sums = np.zeros(may.shape, self.kind)
        self.known = np.zeros(may.shape, bool)
        self.exact = np.zeros(may.shape, self.kind)
        self.read, self.scored = 0, 0

    def lower(self, level: int, active: np.ndarray) -> np.ndarray:
        """Scores to the level's threshold for active queries: from then on each row at or above the returned thresholds is known."""
        x, last = self.index, len(self.index["steps"]) - 1
        dim, w = self.w.shape[1], self.w[active]
        sums = self.sums[:, active]
        for g in self.groups:
            at = (g * (last + 1) + level) * dim
            first = int(x["ends"][at - 1]) if at else 0
            for d in range(dim):
                end = int(x["ends"][at + d])
                if first < end:
                    sums[x["rows"][first:end] - self.start] += x["values"][first:end, None].astype(self.kind) * w[:, d]
                    self.read += (end - first) * len(active)
                first = end
        self.sums[:, active] = sums
        if level == last:  # no suffix is left: partial scores are scores
            self.exact[:, active], self.known[:, active] = sums, True
            return np.full(len(active), -np.inf)
        threshold = x["steps"][level] * self.rest[active, 0]
        cut = x["cut"][self.start : self.stop, level]
        bound = x["suffix"][self.start : self.stop, level, None] * self.rest[active][:, cut].T * SAFE + sums
        row, col = np.nonzero((bound >= threshold) & self.may[:, active] & ~self.known[:, active])
        self.scored += len(row)
        for i in range(0, len(row), PAIRS):
            r, c = row[i : i + PAIRS], active[col[i : i + PAIRS]]
            self.exact[r, c] = np.einsum("nd,nd->n", self.v[r], self.w[c])
        self.known[row, active[col]] = True
        return threshold


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _blocks(q: Arrays):
    for at in range(0, len(q["vector"]), QUERIES):
        yield {name: x[at : at + QUERIES] for name, x in q.items()}


def positives_of_shard(index: Arrays, q: Arrays, k: int) -> list[tuple[np.ndarray, ...]]:
    """(query_id, query_key, vec_id, score) arrays of each query's k best rows of its own label."""
    parts = []
    for g in np.unique(q["label"] % GROUPS).tolist():
        of_group = {name: x[q["label"] % GROUPS == g] for name, x in q.items()}
        ids, labels = (index[c][index["first"][g] : index["first"][g + 1]] for c in ("vec_id", "label"))
        for some in _blocks(of_group) if len(ids) else ():
            may = (labels[:, None] == some["label"]) & (ids[:, None] != some["query_id"])
            join, active = _Join(index, range(g, g + 1), some["vector"][:, index["perm"]], may), np.arange(len(some["vector"]))
            for level in range(len(index["steps"])):
                threshold = join.lower(level, active)
                full = ((join.exact[:, active] >= threshold) & join.known[:, active] & may[:, active]).sum(axis=0) >= k
                active = active[~full]
                if not len(active):
                    break
            for i in range(len(some["vector"])):
                c = np.flatnonzero(join.known[:, i] & may[:, i])
                o = c[_best(join.exact[c, i], ids[c], k)]
                parts.append((np.full(len(o), some["query_id"][i]), np.full(len(o), some["query_key"][i]), ids[o], join.exact[o, i].astype(np.int64)))
    return parts


def negatives_of_shard(index: Arrays, q: Arrays, k: int, windows: int, work: list | None = None) -> list[tuple[np.ndarray, ...]]:
    """(query_id, query_key, at, vec_id, score) arrays of each query's k best rows of other labels in each of its windows lo..hi; ``work`` takes (pairs of rows and queries, postings of these, postings read, pairs scored)."""
    ids, labels, parts = index["vec_id"], index["label"], []
    for some in _blocks(q):
        may = (labels[:, None] != some["label"]) & (ids[:, None] != some["query_id"])
        lo, hi = (np.stack([some[f"{end}{i}"] for i in range(windows)]) for end in ("lo", "hi"))
        join, active = _Join(index, range(GROUPS), some["vector"][:, index["perm"]], may), np.arange(len(some["vector"]))
        for level in range(len(index["steps"])):
            threshold = join.lower(level, active)
            known, s = join.known[:, active] & may[:, active], join.exact[:, active]
            done = np.ones(len(active), bool)
            for i in range(windows):
                low, high = lo[i, active], hi[i, active]
                found = (known & (s >= np.maximum(low, threshold)) & (s <= high)).sum(axis=0)
                done &= (found >= k) | (threshold <= low) | (low > high)
            active = active[~done]
            if not len(active):
                break
        if work is not None:
            work.append((may.size, len(index["rows"]) * len(some["vector"]), join.read, join.scored))
        for i in range(len(some["vector"])):
            c = np.flatnonzero(join.known[:, i] & may[:, i])
            s = join.exact[c, i]
            for at in range(windows):
                inside = (s >= lo[at, i]) & (s <= hi[at, i])
                o = _best(s[inside], ids[c[inside]], k)
                parts.append((np.full(len(o), some["query_id"][i]), np.full(len(o), some["query_key"][i]), np.full(len(o), at), ids[c[inside]][o], s[inside][o].astype(np.int64)))
    return parts


def mine(df: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rows_per_shard: int = 4096, queries_per_block: int = 512) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    A component x becomes floor(scale * x), a score is the integer inner product with the anchor, higher ones come first,
    ties by smaller id. An anchor's positives are its first ``positives`` other rows of its label; a positive's negatives
    its first ``negatives`` rows of other labels with least * positive_score <= 100 * score <= most * positive_score
    (none, if the positive's score is negative). Rows without id, label or vector, and those with an empty vector or null
    or non-finite components, take no part; repeated rows count once; rows of an anchor's own id are neither positives
    nor negatives of it; several vectors or labels of an id are rows and anchors of their own; vectors of different
    lengths never meet. Sums beyond 63 bits are undefined. Empty tables give no rows.
    """
    label = F.col(label_col).cast("long")

    def whole(d: DataFrame) -> DataFrame:
        v = valid(d.where(label.isNotNull()), id_col, vector_col, label=label)
        return v.withColumn("vector", F.transform("vector", lambda x: F.floor(F.lit(float(scale)) * x).cast("double")))

    index, shards = indexed(whole(df), "vec_id", rows_per_shard, threshold_index)
    queries = whole(anchors).select(F.col("vec_id").alias("query_id"), F.xxhash64("vector", "label").alias("query_key"), "label", "vector", "dim")
    key = ["query_id", "query_key"]

    def ranked(found: DataFrame, k: int, *by: str) -> DataFrame:
        w = Window.partitionBy(*key, *by).orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    near = searched(index, shards, queries, queries_per_block, lambda a: a, lambda x, q: joined(positives_of_shard(x, q, positives), [*key, "vec_id", "score"]), "query_id long, query_key long, vec_id long, score long")
    best = written(ranked(near, positives).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("best")), "positives")
    down = lambda x: ((x - F.pmod(x, F.lit(100))) / 100).cast("long")  # noqa: E731  # exact below 2**53
    ends = []
    for i in range(positives):
        score = F.try_element_at("best", F.lit(i + 1))["score"]
        ends += [F.coalesce(-down(score * -least), F.lit(1)).alias(f"lo{i}"), F.coalesce(down(score * most), F.lit(0)).alias(f"hi{i}")]
    asked = queries.join(best, key).select(*key, "label", *ends, "vector", "dim")
    far = searched(index, shards, asked, queries_per_block, lambda a: a, lambda x, q: joined(negatives_of_shard(x, q, negatives, positives), [*key, "at", "vec_id", "score"]), "query_id long, query_key long, at int, vec_id long, score long")
    of = best.select(*key, F.posexplode("best").alias("at", "positive"))
    found = ranked(far, negatives, "at").join(of, [*key, "at"])
    return found.select(F.col("query_id").alias("anchor_id"), F.col("positive.vec_id").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"))
