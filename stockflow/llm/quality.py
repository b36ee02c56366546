"""Quality by weak labels: heuristic labellers vote, expectation-maximisation weighs them, and a hashed linear scorer learns.

No labels are read. The labellers overlap and may abstain; votes are counted over all documents, by pattern, and the
estimation runs on these counts, of which there are at most 3 to the power of the number of labellers. The posterior
labels of a bounded sample train a linear scorer over hashed word shapes and the labellers' binned shares, which then
scores every text whole. The sample holds examples of rare vote patterns first, so that each labeller is learnt at any size.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.llm import words
from stockflow.llm.common import held, one_text_each, texts

#: Labellers: a document is bad above (for "distinct": below) the first share and good at or below (above) the second; between them, or with fewer words than the third, the labeller abstains.
LABELLERS = {
    "marks": (0.15, 0.05, 1),
    "capitals": (0.3, 0.15, 8),
    "separators": (0.1, 0.03, 1),
    "repeats": (0.25, 0.17, 8),
    "distinct": (0.05, 0.2, 50),
    "same_lines": (0.5, 0.35, 20),
    "digits": (0.6, 0.3, 8),
    "long_words": (0.3, 0.1, 8),
}
KINDS = 4
FALSE_ALARM, PRIOR, KIND_PRIOR = 0.001, 500, 0.5
BITS = 16
MOST_TRAINED = 12_000
EXAMPLES = 8
EPOCHS = 12
RATE = 0.5
MOST_WORDS = 300_000

MARKED = re.compile(r"[^\w\s.,;:!?'\"()\[\]-]{2,}$|!{2,}$")
SEPARATOR = re.compile(r"[|+=*_~/\\-]+$")
LETTERS = re.compile(r"[^\W\d_]+")
LETTERS_ALONE = (zlib.crc32(b"a"), zlib.crc32(b"A"))


class Shapes(dict):
    """Word -> number in ``shape`` (a hash of its case, digits and marks) and ``flags`` (bits: marks, capitals, separators, digits, long)."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[tuple[int, int]] = []
        self.shape = self.flags = np.zeros(0, np.uint64)

    def __missing__(self, word: str) -> int:
        upper = len(word) > 1 and word.isupper() and word.upper() == word
        flags = upper << 1 | (len(word) > 30) << 4
        if word.isalpha():
            crc = LETTERS_ALONE[upper]
        else:
            shape = re.sub(r"\d+", "9", LETTERS.sub("A" if upper else "a", word))[:12]
            crc = zlib.crc32(shape.encode())
            flags |= bool(MARKED.search(word)) | bool(SEPARATOR.match(word)) << 2 | any(map(str.isdigit, word)) << 3
        self.new.append((crc, flags))
        self[word] = n = len(self)
        return n

    def numbers(self, texts_: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts, and their count for each text."""
        if len(self) > MOST_WORDS:
            self.clear()
            self.shape = self.flags = np.zeros(0, np.uint64)
        get, out = self.__getitem__, []
        for text in texts_:
            parts = text.split()
            out.append(np.fromiter(map(get, parts), np.int64, len(parts)))
        if self.new:
            new = np.array(self.new, np.uint64).T
            self.new = []
            self.shape, self.flags = np.concatenate([self.shape, new[0]]), np.concatenate([self.flags, new[1]])
        return np.concatenate(out) if out else np.zeros(0, np.int64), np.array([len(x) for x in out], np.int64)


def shapes() -> Shapes:
    """The worker's table."""
    return held(Shapes, Shapes)


class Parts:
    """Word numbers of some texts, and each labeller's share of each text."""

    def __init__(self, texts_: list[str]) -> None:
        table = shapes()
        n, self.counts = table.numbers(texts_)
        d = len(texts_)
        self.doc, self.size = np.repeat(np.arange(d), self.counts), np.maximum(self.counts, 1)
        self.shape, flags = table.shape[n], table.flags[n]
        marked = np.flatnonzero(flags)
        flags, of = flags[marked], self.doc[marked]
        share = lambda k: np.bincount(of[(flags >> np.uint64(k) & np.uint64(1)) > 0], minlength=d) / self.size
        self.same = np.zeros(len(n), bool)
        self.same[1:] = (n[1:] == n[:-1]) & (self.doc[1:] == self.doc[:-1])
        distinct = np.array([len(set(x)) for x in np.split(n, np.cumsum(self.counts)[:-1])] if d else [], float)
        lines = []
        for t in texts_:
            own = [x for x in t.split("\n") if x.strip()] if "\n" in t else [t]
            lines.append(1 - len(set(own)) / len(own) if own else 0.0)
        self.shares = {"marks": share(0), "capitals": share(1), "separators": share(2), "repeats": np.bincount(self.doc[self.same], minlength=d) / self.size, "distinct": distinct / self.size, "same_lines": np.array(lines), "digits": share(3), "long_words": share(4)}

    def votes(self) -> np.ndarray:
        """Texts x labellers: 1 good, 0 bad, -1 abstains."""
        out = np.full((len(self.counts), len(LABELLERS)), -1, np.int8)
        for k, (name, (bad, good, least)) in enumerate(LABELLERS.items()):
            s, sign = self.shares[name], -1 if name == "distinct" else 1
            enough = self.counts >= least
            out[enough & (sign * s <= sign * good), k] = 1
            out[enough & (sign * s > sign * bad), k] = 0
        return out

    def features(self, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text numbers, slots and values of the scorer: shares of word shapes, of shape pairs and of repeated words, and the bounds that a labeller's share passes; slots may repeat."""
        mix, doc, shape = words._slot, self.doc, self.shape
        pair = np.zeros(len(doc), bool)
        pair[1:] = doc[1:] == doc[:-1]
        both = shape * np.uint64(0xC2B2AE3D27D4EB4F)
        docs, slots = [doc, doc[pair], doc[self.same]], [mix(shape, 1, bits), mix((np.roll(both, 1) ^ shape)[pair], 2, bits), mix(np.zeros(int(self.same.sum()), np.uint64), 3, bits)]
        values = [1 / self.size[x] for x in docs]
        for name, (bad, good, least) in LABELLERS.items():
            s, sign = self.shares[name], -1 if name == "distinct" else 1
            for c, bound in enumerate((good, (good + bad) / 2, bad)):
                docs.append(np.flatnonzero((self.counts >= least) & (sign * s > sign * bound)))
                slots.append(np.full(len(docs[-1]), mix(np.full(1, zlib.crc32(f"{name} {c}".encode()), np.uint64), 4, bits)[0]))
                values.append(np.ones(len(docs[-1])))
        return np.concatenate(docs), np.concatenate(slots), np.concatenate(values)


def read(texts_: list[str], bits: int = BITS) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Votes, and for each text its slots, ascending, with their values."""
    parts = Parts(texts_)
    doc, slot, value = parts.features(bits)
    key, at = np.unique(doc << bits | slot, return_inverse=True)
    cut = np.searchsorted(key >> bits, np.arange(1, len(texts_)))
    rows = zip(np.split(key & ((1 << bits) - 1), cut), np.split(np.bincount(at, value, len(key)), cut), strict=True)
    return parts.votes(), list(rows) if texts_ else []


def linear_scores(parts: Parts, weights: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Bias and the weights of each text's slots, times their values."""
    doc, slot, value = parts.features(bits)
    return weights[-1] + np.bincount(doc, weights[slot] * value, len(parts.counts))


def estimate(votes: np.ndarray, counts: np.ndarray, kinds: int = KINDS, rounds: int = 300) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of good for each vote pattern, each labeller's chance of a bad vote where it votes (class x labeller), and the classes' shares; class 0 is good.

    Bad documents are of several kinds, so that labellers may overlap: votes are independent given the kind, and
    abstaining says nothing. At first a kind is what one labeller sees; kinds that the data does not need empty out or
    take single labellers' false alarms. The priors are a fixed number of votes (PRIOR of them on good documents,
    FALSE_ALARM of these bad; one on each kind), so they weigh less the more documents there are. They decide only between
    a false alarm of one labeller and a kind that no other sees, which votes cannot tell apart. Without documents the
    posterior is that of the start.
    """
    bad, good = (votes == 0).astype(float), (votes == 1).astype(float)
    any_bad, n, seen = bad.any(axis=1), float(counts.sum()), np.arange(kinds) % votes.shape[1]
    first = bad[:, seen] + 0.02
    r = np.concatenate([np.where(any_bad, 0.1, 0.98)[:, None], np.where(any_bad, 0.9, 0.02)[:, None] * first / first.sum(axis=1, keepdims=True)], axis=1)
    more = np.r_[FALSE_ALARM * PRIOR, np.full(kinds, KIND_PRIOR)][:, None], np.r_[(1 - FALSE_ALARM) * PRIOR, np.full(kinds, KIND_PRIOR)][:, None]
    for _ in range(rounds):
        w = counts[:, None] * r
        share = (w.sum(axis=0) + np.r_[5.0, np.ones(kinds)]) / (n + 5 + kinds)
        table = np.clip((w.T @ bad + more[0]) / (w.T @ (bad + good) + more[0] + more[1]), 1e-9, 1 - 1e-9)
        log = np.log(share) + bad @ np.log(table).T + good @ np.log(1 - table).T
        log = np.exp(log - log.max(axis=1, keepdims=True))
        before, r = r, log / log.sum(axis=1, keepdims=True)
        if np.abs(r - before).max() < 1e-6:
            break
    return r[:, 0], table, share


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Weights of the scorer (the last is the bias): logistic loss against soft labels, per-coordinate rates."""
    w, g2 = np.zeros((1 << bits) + 1), np.full((1 << bits) + 1, 1e-3)
    for _ in range(EPOCHS):
        for (slot, value), y in zip(rows, target, strict=True):
            x, at = np.append(value, 1.0), np.append(slot, 1 << bits)
            g = (1 / (1 + np.exp(-np.clip(w[at] @ x, -35, 35))) - y) * x
            g2[at] += g * g
            w[at] -= RATE * g / np.sqrt(g2[at])
    return w


class Model:
    """What learning gives: posteriors by vote pattern, labellers' accuracies, and the scorer's weights other than 0."""

    def __init__(self, posterior: dict[bytes, float], accuracy: dict[str, float], prior: float, weights: np.ndarray) -> None:
        self.posterior, self.accuracy, self.prior = posterior, accuracy, prior
        self.slots = np.flatnonzero(weights)
        self.values, self.size = weights[self.slots], len(weights)

    def weights(self) -> np.ndarray:
        w = np.zeros(self.size)
        w[self.slots] = self.values
        return w


def learn(docs: DataFrame, bits: int = BITS, most: int = MOST_TRAINED, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Votes of all documents give the labellers' accuracies; at most ``most`` documents train the scorer.

    First come up to EXAMPLES documents of each vote pattern, rare patterns first, up to half of ``most``; the rest is
    chosen by a hash of the ids. An id with several texts trains with the one of the least hash, so that ids and rows
    are bounded alike.
    """
    rows = texts(docs, id_col, text_col).withColumn("h", F.xxhash64("doc_id"))

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first, part in words.in_parts(pdf["text"].tolist()):
                v, at = np.unique(Parts(part).votes(), axis=0, return_inverse=True)
                h = pdf["h"].iloc[first : first + len(part)].to_numpy()
                of = pd.DataFrame({"v": at, "part": h % EXAMPLES, "h": h}).groupby(["v", "part"])["h"].agg(["size", "min"]).reset_index()
                yield pd.DataFrame({"votes": [v[i].tobytes() for i in of["v"]], "part": of["part"], "n": of["size"], "h": of["min"]})

    parts = rows.mapInPandas(vote, "votes binary, part int, n long, h long").groupBy("votes", "part").agg(F.sum("n").alias("n"), F.min("h").alias("h")).toPandas()
    parts["votes"] = [bytes(x) for x in parts["votes"]]
    found = parts.groupby("votes", as_index=False)["n"].sum().sort_values("votes")
    patterns = np.stack([np.frombuffer(x, np.int8) for x in found["votes"]]) if len(found) else np.full((1, len(LABELLERS)), -1, np.int8)
    p, table, share = estimate(patterns, found["n"].to_numpy(float) if len(found) else np.ones(1))
    prior = float(share[0])
    posterior = {x.tobytes(): float(y) for x, y in zip(patterns, p, strict=True)}
    right = (1 - table[0]) * prior + share[1:] @ table[1:]
    rare = parts.assign(whole=parts.groupby("votes")["n"].transform("sum")).sort_values(["whole", "votes", "h"])["h"].iloc[: most // 2]
    known = rows.where(F.col("doc_id").isNotNull())
    chosen = known.select("h").distinct().orderBy("h").limit(most - len(rare)).unionByName(docs.sparkSession.createDataFrame([(int(h),) for h in rare], "h long")).distinct()

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first, part in words.in_parts(pdf["text"].tolist()):
                v, x = read(part, bits)
                at = pdf["doc_id"].iloc[first : first + len(part)].to_numpy()
                yield pd.DataFrame({"one": 1, "doc_id": at, "target": [posterior.get(r.tobytes(), prior) for r in v], "slots": [s.astype("<i4").tobytes() for s, _ in x], "shares": [s.astype("<f4").tobytes() for _, s in x]})

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(order=pdf["doc_id"] * 2654435761 % (1 << 32)).sort_values(["order", "doc_id", "slots"])
        w = train([(np.frombuffer(a, "<i4"), np.frombuffer(b, "<f4").astype(float)) for a, b in zip(pdf["slots"], pdf["shares"], strict=True)], pdf["target"].to_numpy(), bits)
        some = np.flatnonzero(w)
        return pd.DataFrame({"slot": some, "weight": w[some]})

    sample = one_text_each(known.join(F.broadcast(chosen), "h")).mapInPandas(features, "one int, doc_id long, target double, slots binary, shares binary")
    learnt = sample.groupBy("one").applyInPandas(fit, "slot long, weight double").toPandas()
    w = np.zeros((1 << bits) + 1)
    w[learnt["slot"].to_numpy(np.int64)] = learnt["weight"].to_numpy(float)
    return Model(posterior, dict(zip(LABELLERS, right.tolist(), strict=True)), prior, w)


def scorer(model: Model, bits: int = BITS):
    """A function of a text column: the score, as ``score`` gives it."""

    @F.pandas_udf("double")
    def of_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = model.weights()
        for s in batches:
            out = [linear_scores(Parts(part), w, bits) for _, part in words.in_parts(s.fillna("").tolist())]
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.concatenate(out) if out else np.zeros(0), -35, 35))))

    return of_text


def score(docs: DataFrame, model: Model, bits: int = BITS, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, votes (array, in the order of LABELLERS), weak_label (posterior), score (0 to 1) and keep (score >= threshold) of every row.

    A null or empty text has no words: no labeller but those that need none votes, and its score is the bias's. Every
    row gives one row, repeated ones and null ids too. Texts are read whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = model.weights()
        for pdf in batches:
            for first, part in words.in_parts(pdf["text"].tolist()):
                parts = Parts(part)
                votes, s = parts.votes(), linear_scores(parts, w, bits)
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[first : first + len(part)].to_numpy(), "votes": list(votes.astype(np.int32)), "weak_label": [model.posterior.get(v.tobytes(), model.prior) for v in votes], "score": 1 / (1 + np.exp(-np.clip(s, -35, 35)))})

    out = texts(docs, id_col, text_col).mapInPandas(run, "doc_id long, votes array<int>, weak_label double, score double")
    return out.withColumn("keep", F.col("score") >= threshold)
