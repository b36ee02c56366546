"""Near-duplicates by BagMinHash over multisets of word shingles.

The weight of a shingle is how often a document has it. Each dyadic interval of weights carries a Poisson process of
points (time, register, place in the interval), the same wherever the shingle occurs; a document has the points below
its weight, and each register keeps the earliest. Two registers agree with the probability of the weighted Jaccard
similarity. Bands of registers give buckets, and the multisets' overlap decides.

Equal texts are one node. Nodes are compared with pivots of their buckets, not with each other; what is linked becomes
one component, and next time the pivot is of a bucket's largest component, so that a large group costs about a pair a
node. Nodes of buckets that still lie in several components are joined across these by their rarest shingles, one pair
for each two components first and then those that are still apart, so that no pair of a bucket that reaches the
threshold is lost. Buckets of many nodes are dealt over several tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockflow.llm.common import held, let_go, texts, written
from stockflow.llm.words import in_parts

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 6
MOST_WORDS = 250_000
HOT, SALTS = 2000, 16
PARITY = 512
TURNS = 2

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Exponential waiting times by a 16-bit uniform, as whole numbers: sums of them do not depend on the order of work.
WAIT = (-np.log1p(-(np.arange(65536) + 0.5) / 65536) * 2**36).astype(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class Hashes(dict):
    """Word -> number in ``value``: a 64-bit hash of its lower-case form."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[int] = []
        self.value = np.zeros(0, np.uint64)

    def __missing__(self, word: str) -> int:
        self.new.append(int.from_bytes(hashlib.blake2b(word.lower().encode(), digest_size=8).digest(), "little"))
        self[word] = n = len(self)
        return n

    def of(self, texts_: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of all texts, and their count for each text."""
        if len(self) > MOST_WORDS:
            self.clear()
            self.value = np.zeros(0, np.uint64)
        get, out = self.__getitem__, []
        for text in texts_:
            parts = text.split()
            out.append(np.fromiter(map(get, parts), np.int64, len(parts)))
        self.value, self.new = np.concatenate([self.value, np.array(self.new, np.uint64)]), []
        return self.value[np.concatenate(out)] if out else np.zeros(0, np.uint64), np.array([len(x) for x in out], np.int64)


def hashes() -> Hashes:
    """The worker's table."""
    return held(Hashes, Hashes)


def multisets(texts_: list[str], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes | None]]:
    """Of all texts (4096 at most): text number, shingle (52 bits) and weight, ascending; and a key of each text's words, None without words.

    A text of fewer words than a shingle has one shingle of all its words.
    """
    value, counts = hashes().of(texts_)
    ends = np.cumsum(counts)
    keys = [hashlib.md5(value[b - c : b].tobytes()).digest() if c else None for b, c in zip(ends.tolist(), counts.tolist(), strict=True)]
    doc = np.repeat(np.arange(len(texts_)), counts)
    at = np.arange(len(value))
    left = ends[doc] - at if len(value) else at
    first = (left >= width) | (at == (ends - counts)[doc] if len(value) else at)
    h = np.zeros(len(value), np.uint64)
    for k in range(width):
        inside = left > k
        h[inside] = mix(h[inside] * STEP + value[np.minimum(at + k, len(value) - 1)][inside] + np.uint64(1))
    both, weight = np.unique(doc[first].astype(np.uint64) << np.uint64(52) | h[first] >> np.uint64(12), return_counts=True)
    return (both >> np.uint64(52)).astype(np.int64), both & np.uint64((1 << 52) - 1), weight, keys


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """Registers of each text: the earliest point of its processes in each; a text without shingles keeps the largest number."""
    late = np.iinfo(np.int64).max
    out = np.full(n_docs * registers, late)
    top = int(weight.max(initial=0)).bit_length()
    parts = []
    for j in range(top + 1):  # weights [0, 1), [1, 2), [2, 4), ...
        low = 0 if j == 0 else 1 << (j - 1)
        has = weight > low
        if has.any():
            parts.append((doc[has], mix(shingle[has] * STEP + np.uint64(j)), np.full(int(has.sum()), max(0, j - 1)), low, weight[has]))
    if not parts:
        return out.reshape(n_docs, registers)
    d = np.concatenate([p[0] for p in parts])
    key = np.concatenate([p[1] for p in parts])
    log = np.concatenate([p[2] for p in parts])  # of the interval's width
    part = np.concatenate([(p[4] - p[3]) for p in parts])  # of the interval, what the weight covers
    time, serial = np.zeros(len(d), np.int64), 0
    while len(d):
        k = int(np.clip(40_000 // len(d), 1, 512))
        u = mix(key[:, None] + STEP * np.arange(serial + 1, serial + k + 1, dtype=np.uint64))
        v = mix(u + STEP)
        wait = WAIT[(u & np.uint64(0xFFFF)).astype(np.int64)] + (u >> np.uint64(44)).astype(np.int64) >> log[:, None]
        wait[:, 0] += time
        times = np.cumsum(wait, axis=1)
        register = ((v & np.uint64(0xFFFFFFFF)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        place = (v >> np.uint64(32)).astype(np.float64) * 2.0**-32  # in the interval; below the weight: the document's
        mine = place * (1 << log)[:, None] < part[:, None]
        np.minimum.at(out, (d[:, None] * registers + register)[mine], times[mine])
        latest = out.reshape(n_docs, registers).max(axis=1)
        time, serial = times[:, -1], serial + k
        goes_on = time < latest[d]
        d, key, log, part, time = d[goes_on], key[goes_on], log[goes_on], part[goes_on], time[goes_on]
    return out.reshape(n_docs, registers)


def occurrences(shingle: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The multiset as a set of 32-bit numbers of (shingle, occurrence), ascending: its overlaps are those of the multisets."""
    again = np.repeat(shingle, weight)
    nth = np.arange(len(again)) - np.repeat(np.cumsum(weight) - weight, weight)
    return np.sort((mix(again * STEP + nth.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32).view(np.int32))


def parities(items: np.ndarray) -> np.ndarray:
    """Of each of PARITY classes of items, by their low bits, whether their number is odd: the bits of a few 64-bit numbers."""
    odd = (np.bincount(items & (PARITY - 1), minlength=PARITY) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two multisets given as ``occurrences``."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if not len(a):
        return 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    common = int((b[at] == a).sum())
    return common / max(1, len(a) + len(b) - common)


def _components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of an undirected graph, by smallest neighbours with pointer jumping."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("component").alias("m"))
        nearer = label.join(near, label["node"] == near["a"]).select("node", F.least("component", "m").alias("c"), F.col("component").alias("was"))
        jump = label.select(F.col("node").alias("c"), F.col("component").alias("further"))
        new = written(nearer.join(jump, "c", "left").select("node", F.least("c", F.coalesce("further", "c")).alias("component"), "was"), "labels")
        label = new.select("node", "component")
        if not new.where(F.col("component") != F.col("was")).limit(1).count():
            return label


def _contracted(label: DataFrame | None, edges: DataFrame) -> DataFrame:
    """``label`` (node, component) after ``edges`` (a, b) of nodes: only the graph of components that they join is gone through."""
    if label is None:
        return _components(edges)
    of = lambda c: label.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    between = edges.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = _components(between.where("a <> b").distinct()).select(F.col("node").alias("component"), F.col("component").alias("to"))
    moved = label.join(joined, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    new = joined.select(F.col("component").alias("node"), F.col("to").alias("component")).join(label.select("node"), "node", "left_anti")
    return written(moved.unionByName(new), "labels")


def _with_components(df: DataFrame, label: DataFrame) -> DataFrame:
    return df.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose multisets' similarity reaches the threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        for pdf in batches:
            s = np.array([similarity(x, y) for x, y in zip(pdf["sa"], pdf["sb"], strict=True)], float)
            yield pdf[["a", "b"]][s >= threshold]

    one = pairs.select("a", "b").join(sets.select(F.col("node").alias("b"), F.col("items").alias("sb")), "b")
    two = one.join(sets.select(F.col("node").alias("a"), F.col("items").alias("sa")), "a")
    # sizes alone can rule a pair out
    small, large = F.least(F.size("sa"), F.size("sb")), F.greatest(F.size("sa"), F.size("sb"))
    return written(two.where(small >= threshold * large).mapInPandas(run, "a binary, b binary"), "edges")


def _salted(buckets: DataFrame) -> DataFrame:
    """A row of each part of each of ``buckets`` (bucket, n, ...): a bucket of more than HOT nodes is dealt in SALTS parts."""
    return buckets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > HOT, SALTS - 1).otherwise(0))))


def _still_open(rows: DataFrame, label: DataFrame) -> DataFrame:
    """``rows`` (bucket, salt, n, node) with components, of those buckets that have several."""
    of = _with_components(rows, label)
    several = of.groupBy("bucket", "n").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket", "n")
    return written(of.join(_salted(several).drop("n"), ["bucket", "salt"]), "open")


def _with_pivots(rows: DataFrame, each: list[str], turn: int) -> DataFrame:
    """Pairs (a, b): nodes with the pivot, a node of the largest component, of one of their buckets, for each of ``each``.

    The pivot of the largest component there is taken, so that the nodes of a large group meet the same few.
    """
    parts = rows.groupBy("bucket", "n", "component").agg(F.count("*").alias("m"), F.max_by("node", F.xxhash64("node", F.lit(turn))).alias("rep"))
    pivots = parts.groupBy("bucket", "n").agg(F.max(F.struct("m", "rep", "component")).alias("p"))
    near = rows.join(_salted(pivots).drop("n"), ["bucket", "salt"]).where(F.col("component") != F.col("p.component")).withColumn("other", F.col("p.component"))
    return near.groupBy("node", *each).agg(F.max(F.struct("p.m", "p.rep")).alias("p")).select(F.col("node").alias("a"), F.col("p.rep").alias("b"))


def _across(nodes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """All pairs (a, b) of ``nodes`` (node, component) from different components that can reach the threshold, with their components and a bound of their overlap.

    Of two multisets that do, each has one of the other's items among its rarest: so many that the others could not
    make up the threshold. Only these rarest items are joined, and at the first one that both have, what follows it in
    both must still be able to make up the threshold. Parities of the items by hash give a second bound: they differ in
    at most as many places as there are items that only one of the two has.
    """
    parity = [f"w{i}" for i in range(PARITY // 64)]
    items = nodes.join(sets, "node").select("node", "component", F.size("items").alias("size"), F.explode("items").alias("item"))
    counts = items.groupBy("item").agg(F.count("*").alias("n"), F.min("component").alias("x"), F.max("component").alias("y"))
    w = Window.partitionBy("node").orderBy("n", "item")
    ranked = items.join(counts, "item").withColumn("nth", F.row_number().over(w))
    rare = ranked.where((F.col("nth") <= F.col("size") - F.ceil(F.col("size") * threshold) + 1) & (F.col("x") != F.col("y")))
    rare = rare.select("item", "node", "component", "size", "nth").join(sets.select("node", *parity), "node")
    rare = written(rare, "rare")
    other = rare.select("item", *(F.col(c).alias(f"{c}_b") for c in ("node", "component", "size", "nth", *parity)))
    needed = threshold / (1 + threshold) * (F.col("size") + F.col("size_b")) - 1e-6
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_b"))) for c in parity[1:]), F.bit_count(F.col(parity[0]).bitwiseXOR(F.col(f"{parity[0]}_b"))))
    bound = F.least((F.col("size") + F.col("size_b") - differ) / 2, F.col("size"), F.col("size_b"))
    both = rare.join(other, "item").where((F.col("node") < F.col("node_b")) & (F.col("component") != F.col("component_b")))
    both = both.where((1 + F.least(F.col("size") - F.col("nth"), F.col("size_b") - F.col("nth_b")) >= needed) & (bound >= needed))
    keys = {"node": "a", "node_b": "b", "component": "ca", "component_b": "cb"}
    near = both.groupBy(*(F.col(k).alias(v) for k, v in keys.items())).agg(F.max(bound - needed).alias("spare"))
    return written(near, "near")


def classes(docs: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class) and class_size for each row of ``docs`` with an id.

    Classes are the components of the graph of texts whose shingle multisets have a Jaccard similarity of at least
    ``threshold``; words are what white space separates, in lower case. Equal word sequences are always of one class.
    Texts without words (null, empty) are copies of nothing: each such document is a class of its own. Rows without an
    id are left out; repeated rows count as copies. An empty table gives no rows.
    """
    rows_in = texts(docs, id_col, text_col).where(F.col("doc_id").isNotNull())

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start, part in in_parts(pdf["text"].tolist()):
                for at in range(0, len(part), 4096):
                    some = part[at : at + 4096]
                    doc, shingle, weight, keys = multisets(some, width)
                    sig = signatures(doc, shingle, weight, len(some), bands * rows).astype(np.uint64).reshape(len(some), bands, rows)
                    h = np.tile(np.arange(bands, dtype=np.uint64), (len(some), 1))
                    for k in range(rows):
                        h = mix(h * STEP + sig[:, :, k])
                    yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[start + at : start + at + len(some)].to_numpy(), "node": keys, "buckets": list(h.astype(np.int64))})

    signed = written(rows_in.mapInPandas(sign, "doc_id long, node binary, buckets array<long>"), "signed")
    nodes = signed.where(F.col("node").isNotNull())
    # equal texts have equal buckets, so one row of a node is enough; copies are combined before the shuffle
    members = written(nodes.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("buckets").alias("buckets")), "members")
    bucket = members.select("node", F.explode("buckets").alias("bucket"), F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt"))
    sizes = bucket.groupBy("bucket", "salt").agg(F.count("*").alias("m")).withColumn("n", F.sum("m").over(Window.partitionBy("bucket"))).where("n > 1")
    shared = bucket.join(sizes.drop("m"), ["bucket", "salt"])
    shared = written(shared.select("bucket", F.when(F.col("n") > HOT, F.col("salt")).otherwise(0).alias("salt"), "n", "node"), "buckets")

    wanted = shared.select("node").distinct().join(members, "node").select("node", F.col("first").alias("doc_id"))
    parity = [f"w{i}" for i in range(PARITY // 64)]

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start, part in in_parts(pdf["text"].tolist()):
                for at in range(0, len(part), 4096):
                    some = part[at : at + 4096]
                    doc, shingle, weight, keys = multisets(some, width)
                    cuts = np.searchsorted(doc, np.arange(1, len(some)))
                    items = [occurrences(s, w) for s, w in zip(np.split(shingle, cuts), np.split(weight, cuts), strict=True)]
                    here = pdf["node"].iloc[start + at : start + at + len(some)].tolist()
                    own = [k for k, (a, b) in enumerate(zip(here, keys, strict=True)) if a == b]  # a repeated id may have other texts
                    words_ = np.stack([parities(items[k]) for k in own]) if own else np.zeros((0, len(parity)), np.int64)
                    yield pd.DataFrame({"node": [here[k] for k in own], "items": [items[k] for k in own], **dict(zip(parity, words_.T, strict=True))})

    schema = "node binary, items array<int>, " + ", ".join(f"{c} long" for c in parity)
    sets = written(rows_in.join(wanted, "doc_id").mapInPandas(collect, schema).dropDuplicates(["node"]), "sets")

    label, open_ = None, shared.withColumn("component", F.col("node"))
    for turn, each in enumerate(([], [], ["other"], ["other"])):  # at last with a pivot of each component that is near
        label = _contracted(label, _verified(_with_pivots(open_, each, turn), sets, threshold))
        open_ = _still_open(open_.drop("component"), label)
    near = _across(open_.select("node", "component").distinct(), sets, threshold)
    for _ in range(TURNS):  # one pair, the likeliest, of each two components
        best = near.groupBy("ca", "cb").agg(F.max(F.struct("spare", "a", "b")).alias("p")).select("p.a", "p.b")
        label = _contracted(label, _verified(best, sets, threshold))
        left = near.drop("ca", "cb").join(best, ["a", "b"], "left_anti")
        for c in ("a", "b"):
            left = left.join(label.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")), c, "left").withColumn(f"c{c}", F.coalesce(f"c{c}", c))
        near = written(left.where("ca <> cb"), "near")
    final = _contracted(label, _verified(near, sets, threshold))

    named = members.join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    groups = named.groupBy("component").agg(F.min("first").alias("class_id"), F.sum("copies").alias("class_size"))
    by_node = written(named.join(groups, "component").select("node", "class_id", "class_size"), "classes")
    found = nodes.select("doc_id", "node").join(by_node, "node").select("doc_id", "class_id", "class_size")
    alone = signed.where(F.col("node").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return found.unionByName(alone)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: object) -> DataFrame:
    """``docs`` with one row of each class of rows: its smallest id's, and one of those without an id, if there are any.

    Different texts of one id are rows of their own. Rows without an id and without words all stay.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    unnamed = F.col(id_col).isNull() & F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", "").eqNullSafe("")
    key = F.xxhash64(id_col, F.col(id_col).isNull(), text)
    rows = docs.where(~unnamed).withColumns({"_row": key, "_row2": F.xxhash64(text, id_col)})
    found = classes(rows.select("_row", text_col), id_col="_row", text_col=text_col, **how).select(F.col("doc_id").alias("_row"), "class_id").distinct()
    named = rows.select("_row", "_row2", F.col(id_col).alias("_id")).distinct()
    first = named.join(found, "_row").groupBy("class_id", F.col("_id").isNull()).agg(F.min(F.struct("_id", "_row", "_row2")).alias("first"))
    kept = rows.join(first.select("first._row", "first._row2").distinct(), ["_row", "_row2"], "left_semi").dropDuplicates(["_row", "_row2"])
    return kept.select(*docs.columns).unionByName(docs.where(unnamed))
