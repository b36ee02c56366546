"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Per-coordinate learning rates and the L1 term leave few weights other than 0; these alone go to the executors, where
they score every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.llm import words
from stockflow.llm.common import one_text_each, texts

BITS = 20
ALPHA, BETA, L1, L2 = 1.5, 1.0, 4.0, 0.5
EPOCHS = 8
POSITIVE = 2.0
MOST_TRAINED = 12_000


def ftrl(sets: list[np.ndarray], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias learnt from sets of slots in the order given, so many times over.

    The bias has no L1 term; label 1, the rarer one, weighs POSITIVE.
    """
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0

    def weight(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    for _ in range(epochs):
        for x, y in zip(sets, labels, strict=True):
            zx, nx = z[x], n[x]
            w, b = weight(zx, nx), -zb / ((BETA + nb**0.5) / ALPHA + L2)
            g = (1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y) * (POSITIVE if y else 1.0)
            z[x] = zx + g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / ALPHA * w
            n[x] = nx + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / ALPHA * b
            nb += g * g
    return weight(z, n), -zb / ((BETA + nb**0.5) / ALPHA + L2)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether labels of this document are kept from learning: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", bits: int = BITS, most: int = MOST_TRAINED) -> tuple[np.ndarray, np.ndarray, float]:
    """(slots, weights, bias) learnt from at most ``most`` labelled documents, chosen by a hash of their ids.

    A document with several labels has the largest, and an id with several texts trains with the one of the least hash,
    so that ids and rows are bounded alike. Texts are turned into sets of slots in parallel; one task goes through these
    sets. Without labelled documents the weights are none and the bias is 0.
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    chosen = chosen.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first, part in words.in_parts(pdf["text"].tolist()):
                at = pdf.iloc[first : first + len(part)]
                yield pd.DataFrame({"one": 1, "doc_id": at["doc_id"].to_numpy(), "label": at["label"].to_numpy(), "slots": [x.astype("<i4").tobytes() for x in words.gram_sets(part, bits)]})

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(order=pdf["doc_id"] * 2654435761 % (1 << 32)).sort_values(["order", "doc_id", "slots"])
        w, b = ftrl([np.frombuffer(x, "<i4").astype(np.int64) for x in pdf["slots"]], pdf["label"].to_numpy(), bits)
        some = np.flatnonzero(w)
        return pd.DataFrame({"slot": np.append(some, -1), "weight": np.append(w[some], b)})

    rows = one_text_each(texts(docs).join(F.broadcast(chosen), "doc_id"), "label").mapInPandas(sets, "one int, doc_id long, label int, slots binary")
    found = rows.groupBy("one").applyInPandas(train, "slot long, weight double").toPandas()
    slots, weights = found["slot"].to_numpy(np.int64), found["weight"].to_numpy(np.float64)
    return slots[slots >= 0], weights[slots >= 0], float(weights[slots < 0].sum())


def scorer(model: tuple[np.ndarray, np.ndarray, float], bits: int = BITS):
    """A function of a text column: the score, as ``score`` gives it."""
    slots, weights, bias = model

    @F.pandas_udf("double")
    def of_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = np.zeros(1 << bits)
        w[slots] = weights
        for s in batches:
            out = [words.gram_scores(part, w, bias, bits) for _, part in words.in_parts(s.fillna("").tolist())]
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.concatenate(out), -35, 35))) if out else np.zeros(0))

    return of_text


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], bits: int = BITS, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from ``threshold`` on) of every row.

    Texts are scored whole; a null or empty text has no features and gets the bias's score. Every row gives one row,
    repeated ones and null ids too; only the text is an input of the score.
    """
    slots, weights, bias = model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = np.zeros(1 << bits)
        w[slots] = weights
        for pdf in batches:
            out = [1 / (1 + np.exp(-np.clip(words.gram_scores(part, w, bias, bits), -35, 35))) for _, part in words.in_parts(pdf["text"].tolist())]
            yield pdf[["doc_id"]].assign(score=np.concatenate(out) if out else np.zeros(0))

    out = texts(docs, id_col, text_col).mapInPandas(run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
