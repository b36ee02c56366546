"""Language-model scoring by cross-entropy difference.

A target and a background bigram model, alike in order, smoothing and vocabulary, are counted over whole tables. Each
document's score is the mean over its words of the target model's loss less the background model's, its own words being
taken out of both models first. Words are lower-case runs between white space; rare ones are one unknown word. The
vocabulary is that of the background: its words that occur at least LEAST_COUNT times, and the unknown one.

Documents are gathered in blocks of bounded size. A block sends its distinct words and word pairs, as sorted hashes with
their counts, to ranges of hashes; each range adds up the counts and answers each block. There are so many ranges that
one holds about KEYS_PER_RANGE keys, whatever the input's size. The table of blocks is bucketed by block, so that the
texts' own words are never shuffled, and no model is held in one place. Words and pairs are told apart by hashes of 47
bits: of a billion different ones, about one in 140,000 shares its hash with another, and their counts are then added.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.llm.common import blocks_for, let_go, shared_dir, written
from stockflow.llm.near_dup import STEP, hashes, mix
from stockflow.llm.tokens import parts_of

BLOCK_CHARS = 3_000_000
KEY_BITS = 48
KEYS_PER_RANGE = 1_000_000
LEAST_COUNT = 2
WEIGHT = 0.7
SMOOTH = 0.1
START = np.uint64(0x5354415254)


def planes(x: np.ndarray, n: int) -> list[bytes]:
    """The n low bytes of whole numbers, each in a run of its own, so that runs of zeros compress."""
    b = np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return [b[:, i].tobytes() for i in range(n)]


def from_planes(runs: list[bytes]) -> np.ndarray:
    """What ``planes`` was given."""
    out = np.zeros((len(runs[0]), 8), np.uint8)
    for i, run in enumerate(runs):
        out[:, i] = np.frombuffer(run, np.uint8)
    return out.view("<u8").reshape(-1).astype(np.uint64)


def own_keys(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct keys, ascending, and for each word the places of its own key (even) and of its pair's with the word before it (odd); ``first`` marks words that begin a document."""
    before = np.roll(hashes, 1)
    before[first] = START
    cut, one = np.uint64(64 - KEY_BITS), np.uint64(1)
    both = np.concatenate([hashes >> cut & ~one, mix(mix(before) * STEP + hashes) >> cut | one])
    keys, at = np.unique(both, return_inverse=True)
    at = at.astype(np.int32)
    return keys, at[: len(hashes)], at[len(hashes) :]


def losses(c_word: np.ndarray, c_pair: np.ndarray, c_before: np.ndarray, known: np.ndarray, c_unknown: np.ndarray, total: np.ndarray, vocabulary: int) -> np.ndarray:
    """Minus log probability of each word: the pair's share of the word before it, mixed with the word's smoothed share.

    The smoothed shares of all words of the vocabulary, the unknown one included, add up to 1.
    """
    single = (np.where(known, c_word, c_unknown) + SMOOTH) / (total + SMOOTH * vocabulary)
    pair = np.where(known & (c_before > 0), c_pair / np.maximum(c_before, 1), 0)
    return -np.log(np.where(c_before > 0, WEIGHT * pair + (1 - WEIGHT) * single, single))


def _ranges(groups: int) -> np.ndarray:
    return np.array([(g << KEY_BITS) // groups for g in range(1, groups)], np.uint64)


def word_blocks(docs: DataFrame) -> DataFrame:
    """block, n, n_target and data (documents and words) of blocks of (doc_id, text, target, scored)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, k, table, held, chars = TaskContext.get().partitionId(), 0, hashes(), [], 0

        def full() -> pd.DataFrame:
            value, counts = np.concatenate([h for h, _, _ in held]), np.concatenate([c for _, c, _ in held])
            rows_ = pd.concat([r for *_, r in held])
            distinct, number, often = np.unique(value, return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")
            rank = np.zeros(len(distinct), np.int64)
            rank[order] = np.arange(len(distinct))
            target, scored = rows_["target"].to_numpy(bool), rows_["scored"].to_numpy(bool)
            head = [rows_["doc_id"].isna().to_numpy(np.uint8).tobytes(), rows_["doc_id"].fillna(0).to_numpy("<i8").tobytes(), counts.astype("<i8").tobytes(), scored.astype(np.uint8).tobytes(), target.astype(np.uint8).tobytes()]
            row = (part << 32 | k, int(counts[scored].sum()), int(counts[target].sum()), [*head, distinct[order].astype("<u8").tobytes(), *planes(rank[number], 4)])
            return pd.DataFrame([row], columns=["block", "n", "n_target", "data"])

        for pdf in batches:
            at = 0
            for texts_ in parts_of(pdf["text"].tolist()):
                value, counts = table.of(texts_)
                held.append((value, counts, pdf.iloc[at : at + len(counts)][["doc_id", "target", "scored"]]))
                at, chars = at + len(counts), chars + sum(map(len, texts_))
                if chars >= BLOCK_CHARS:
                    yield full()
                    k, held, chars = k + 1, [], 0
        if held:
            yield full()

    return docs.mapInPandas(run, "block long, n long, n_target long, data array<binary>")


class Block:
    """The words of one row of ``word_blocks``, with the keys of words and pairs."""

    def __init__(self, data: list[bytes]) -> None:
        null, ids, counts, scored, target, distinct, *runs = data
        self.counts, self.scored, self.target = np.frombuffer(counts, "<i8"), np.frombuffer(scored, np.uint8), np.frombuffer(target, np.uint8)
        self.ids = pd.array(np.frombuffer(ids, "<i8").copy(), "Int64")
        self.ids[np.frombuffer(null, np.uint8) > 0] = pd.NA
        value = np.frombuffer(distinct, "<u8")[from_planes(runs).astype(np.int64)]
        first = np.zeros(len(value) + 1, bool)
        first[np.cumsum(self.counts) - self.counts] = True
        self.first = first[:-1]
        self.doc = np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)
        self.keys, self.own, self.pair = own_keys(value, self.first)


def key_ranges(blocks: DataFrame, groups: int) -> DataFrame:
    """block, grp, data: each block's keys of each range of hashes, with their counts in background and target."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        cuts = _ranges(groups)
        for pdf in batches:
            for block, data in zip(pdf["block"], pdf["data"], strict=True):
                b, rows = Block(list(data)), []
                n = [np.bincount(b.own[m], minlength=len(b.keys)) + np.bincount(b.pair[m], minlength=len(b.keys)) for m in (b.scored[b.doc] > 0, b.target[b.doc] > 0)]
                at = [0, *np.searchsorted(b.keys, cuts).tolist(), len(b.keys)]
                for g, (i, j) in enumerate(zip(at, at[1:], strict=False)):
                    if j > i:
                        rows.append((block, g, [*planes(np.diff(b.keys[i:j], prepend=np.uint64(0)), 6), *planes(n[0][i:j], 4), *planes(n[1][i:j], 4)]))
                yield pd.DataFrame(rows, columns=["block", "grp", "data"])

    return blocks.select("block", "data").mapInPandas(run, "block long, grp int, data array<binary>")


def score(docs: DataFrame, target: Column | None = None, target_docs: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, h_target, h_background and score (their difference; lower is nearer to the target) of every row of ``docs``.

    The background is ``docs``; the target is the rows where ``target`` holds (null: no), or ``target_docs`` with the
    same columns, which then count for the target alone and are not scored. A null or empty text has no words and null
    losses; rows with a null id and repeated rows are scored like others. Other columns are not read. An empty table
    gives no rows; without a target, its losses are those of the smoothing.
    """
    spark = docs.sparkSession
    row = lambda d, t, s: d.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(t, F.lit(False)).alias("target"), F.lit(s).alias("scored"))
    rows = row(docs, F.lit(False) if target is None else target, True)
    if target_docs is not None:
        rows = rows.unionByName(row(target_docs, F.lit(True), False))
    name = f"lm_blocks_{uuid.uuid4().hex}"
    word_blocks(rows).write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    table = spark.table(name)
    totals = table.agg(F.sum("n").alias("n"), F.sum("n_target").alias("t")).first()
    n_all, n_target = int(totals["n"] or 0), int(totals["t"] or 0)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        """The counts over all blocks, for each block's keys; and, once, how many words of the vocabulary are in the range, with their counts."""
        let_go()
        keys = [np.cumsum(from_planes(list(d[:6]))) for d in pdf["data"]]
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        at = at.astype(np.int32)
        sums = [np.bincount(at, np.concatenate([from_planes(list(d[i : i + 4])).astype(np.uint32) for d in pdf["data"]])).astype(np.uint32) for i in (6, 10)]
        words = (distinct & np.uint64(1) == 0) & (sums[0] >= LEAST_COUNT)
        once = np.arange(len(pdf)) == 0
        a, b = (np.split(s[at], cuts) for s in sums)
        found = {"n_words": int(words.sum()), "n_known": int(sums[0][words].sum()), "n_known_target": int(sums[1][words].sum())}
        return pd.DataFrame({"block": pdf["block"], "grp": pdf["grp"], **{k: once * v for k, v in found.items()}, "data": [[*planes(x, 4), *planes(y, 4)] for x, y in zip(a, b, strict=True)]})

    groups = blocks_for(2 * (n_all + n_target), KEYS_PER_RANGE)
    sums = key_ranges(table, groups).groupBy("grp").applyInPandas(add, "block long, grp int, n_words long, n_known long, n_known_target long, data array<binary>")
    sums = written(sums, "lm-sums")
    own = sums.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_words", "n_known", "n_known_target"))).first()
    vocabulary = own["n_words"] + 1
    models = (("h_target", n_target, n_target - own["n_known_target"]), ("h_background", n_all, n_all - own["n_known"]))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        for pdf in batches:
            for words, parts in zip(pdf["words"], pdf["parts"], strict=True):
                b = Block(list(words))
                doc, d = b.doc, len(b.counts)
                _, inverse, times = np.unique(np.concatenate([doc, doc]).astype(np.int64) * len(b.keys) + np.concatenate([b.own, b.pair]), return_inverse=True, return_counts=True)
                mine_own, mine_pair = np.split(times[inverse].astype(np.int32), 2)
                del inverse, times
                parts = sorted([] if parts is None else parts, key=lambda x: x["grp"])
                target_n, all_n = (np.concatenate([from_planes(list(x["data"][i : i + 4])) for x in parts] or [np.zeros(0, np.uint64)]).astype(np.int64) for i in (4, 0))
                known = all_n[b.own] >= LEAST_COUNT
                unknown = np.bincount(doc, ~known, d).astype(np.int64)
                out: dict[str, object] = {"n_words": b.counts}
                for (name_, total, n_unknown), n, member in zip(models, (target_n, all_n), (b.target, b.scored), strict=True):
                    less = member.astype(np.int64)  # the document's own words, where the model has counted them
                    c_word = n[b.own] - less[doc] * mine_own
                    h = losses(c_word, n[b.pair] - less[doc] * mine_pair, np.where(b.first, 0, np.roll(c_word, 1)), known, (n_unknown - less * unknown)[doc], (total - less * b.counts)[doc], vocabulary)
                    with np.errstate(invalid="ignore"):
                        out[name_] = np.bincount(doc, h, d) / b.counts
                yield pd.DataFrame({"doc_id": b.ids, **out})[b.scored > 0]

    back = sums.groupBy("block").agg(F.collect_list(F.struct("grp", "data")).alias("parts"))
    blocks = table.select("block", F.col("data").alias("words")).join(back, "block", "left")
    found = blocks.mapInPandas(measure, "doc_id long, n_words long, h_target double, h_background double")
    real = lambda c: F.when(F.col("n_words") > 0, F.col(c)).alias(c)
    return found.select("doc_id", "n_words", real("h_target"), real("h_background"), F.when(F.col("n_words") > 0, F.col("h_target") - F.col("h_background")).alias("score"))
