"""Periodic runs of words by seeds on diagonals.

A run of smallest period q and at least max(SHORTEST, 2q) words holds, at lag q, a diagonal of at least max(q,
SHORTEST - q) pairs of equal words. So lags below 12 are sure to have equal 6-grams, and lags from k to 2k - 1 equal
k-grams, for k = 12, 24, 48 and so on. Grams are named exactly, twice as long ones by pairs of names; one that stands
once in its document has no name, so few are left from level to level, and none end the ladder.

Pairs of places of a name are seeds. A name's places that are at most k/2 apart are a chain with one step, its own
smallest period: pairs within it have lags that are multiples of that period, which is another run's. Of two chains
each lag needs one seed, with the first place of one of them; at most three chains are near enough. So seeds grow with
the words, not with the square of a gram's places. A table of the furthest place that a lag's seeds have covered drops
seeds within it; the others are extended both ways by the ladder of names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.llm.common import texts, thrifty

SHORTEST = 12
SPACES = r"[\x20\x09-\x0D]+"
NEAR_CHAINS = 3
PART_BYTES = 2_000_000


def words_of(part: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """How many words each text has, the numbers of all words one after another, and the words by number. Words are stretches without space, tab, line feed, vertical tab, form feed or carriage return."""
    split = pc.split_pattern_regex(part, SPACES)
    words, offsets = split.flatten(), split.offsets.to_numpy()
    filled = pc.not_equal(pc.binary_length(words), 0)
    before = np.append(0, np.cumsum(filled.to_numpy(zero_copy_only=False)))
    found = words.filter(filled).dictionary_encode()
    return np.diff(before[offsets]), found.indices.to_numpy(), found.dictionary


def _name(key: np.ndarray) -> np.ndarray:
    """A number for each key that occurs twice, -1 for others."""
    order = np.argsort(key)
    twin = np.diff(key[order], append=-1) == 0  # as the next one; no key is -1
    also = np.append(False, twin[:-1])
    out = np.empty(len(key), np.int32)
    out[order] = np.where(twin | also, np.cumsum(twin & ~also, dtype=np.int32) - 1, -1)
    return out


def ladder(w: np.ndarray, doc: np.ndarray) -> dict[int, np.ndarray]:
    """Names of the 1-, 2-, 3-, 6-, 12-, 24-grams and so on at each place, as long as any gram stands twice in a document."""
    names = {1: _name(doc * np.int64(int(w.max(initial=0)) + 1) + w)}

    def longer(first: int, second: int) -> np.ndarray:
        a, b, out = names[first], names[second], np.full(len(w), -1, np.int32)
        at = np.flatnonzero((a[: len(w) - first] >= 0) & (b[first:] >= 0) & (doc[: len(w) - first] == doc[first:])) if len(w) > first else np.zeros(0, np.int64)
        if len(at):
            out[at] = _name(a[at] * np.int64(int(b.max()) + 1) + b[at + first])
        return out

    k = 1
    for k, parts in ((2, (1, 1)), (3, (2, 1)), (6, (3, 3))):
        names[k] = longer(*parts)
    while (names[k] >= 0).any():
        names[2 * k] = longer(k, k)
        k *= 2
    return names


def _near_heads(name: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all pairs of places of a name with lags below 2k, a small constant, those that no pair before them on their lag covers."""
    a, lags = [], []
    for lag in range(1, min(2 * k, len(name))):
        at = np.flatnonzero((name[:-lag] == name[lag:]) & (name[lag:] >= 0))
        a.append(at[np.append(True, at[1:] >= at[:-1] + k)[: len(at)]])
        lags.append(np.full(len(a[-1]), lag))
    return np.concatenate([*a, np.zeros(0, np.int64)]), np.concatenate([*lags, np.zeros(0, np.int64)])


def _by_name(name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names, and their places, of all places with a name, by both."""
    p = np.flatnonzero(name >= 0)
    key = name[p].astype(np.int64)
    key <<= 32
    key |= p
    key.sort()
    return (key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32)


def _chain_pairs(g: np.ndarray, p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """One pair for each lag from k to 2k - 1 of each two chains of a name."""
    begins = np.append(True, (g[1:] != g[:-1]) | (p[1:] - p[:-1] > k // 2))
    chain, first = np.cumsum(begins, dtype=np.int32) - 1, np.flatnonzero(begins).astype(np.int32)
    a, b = [p[:0]], [p[:0]]
    for c in range(1, NEAR_CHAINS + 1):
        for before, mine in ((chain - c, False), (chain + c, True)):
            ok = (before >= 0) & (before < len(first))
            other = first[before[ok]]
            same = g[other] == g[ok]
            left, right = (p[ok], p[other]) if mine else (p[other], p[ok])
            near = same & (right - left >= k) & (right - left < 2 * k)
            a.append(left[near])
            b.append(right[near])
    return np.concatenate(a), np.concatenate(b)


def _heads(a: np.ndarray, lag: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The seeds that no seed before them on their lag has covered (a seed covers its k words)."""
    key = lag.astype(np.int64)
    key <<= 32
    key |= a
    key.sort()
    head = np.append(True, np.diff(key) >= k)  # another lag is further away than any place
    key = key[head]
    return key & 0xFFFFFFFF, key >> 32


def _extended(names: dict[int, np.ndarray], a: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and end of the diagonal that each seed lies on."""
    n, sizes = len(names[1]), sorted(names, reverse=True)
    start, end = a.copy(), a.copy()
    for k in sizes:  # a level matches once at most: were it twice, the one above would have matched
        name = names[k]
        fits = np.flatnonzero(end + lag < n)
        x = name[end[fits]]
        end[fits[(x >= 0) & (x == name[end[fits] + lag[fits]])]] += k
        fits = np.flatnonzero(start >= k)
        x = name[start[fits] - k]
        start[fits[(x >= 0) & (x == name[start[fits] + lag[fits] - k])]] -= k
    return start, end


def runs_of(w: np.ndarray, doc: np.ndarray, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of all runs of word numbers ``w``, documents one after another, by start and period."""
    if shortest < SHORTEST:
        raise ValueError(f"runs of at least {SHORTEST} words have seeds")
    if not len(w):
        return (np.zeros(0, np.int64),) * 3
    names, parts = ladder(w, doc), []
    for k in [x for x in names if x >= 6]:
        if k == 6:
            a, lag = _near_heads(names[k], k)
        else:
            g, p = _by_name(names[k])
            if not len(p):
                break
            a, b = _chain_pairs(g, p, k)
            a, lag = _heads(a, b - a, k) if len(a) else (a, b)
        if len(a):
            start, end = _extended(names, a, lag)
            enough = end - start >= np.maximum(lag, shortest - lag)
            parts.append((start[enough], end[enough] + lag[enough], lag[enough]))
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    start, end, period = (np.concatenate([x[i] for x in parts]) for i in range(3))
    order = np.lexsort((period, end, start))  # one stretch, several periods: multiples of the smallest
    start, end, period = start[order], end[order], period[order]
    new = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))[: len(start)]  # seeds need not make a run
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _of_texts(part: pa.Array, ids: pa.Array, shortest: int, places: Callable[[list, np.ndarray], np.ndarray] | None) -> list[pa.Array]:
    """Of each text the starts, lengths and periods of its runs, and the text without repeated words."""
    sizes, w, words = words_of(part)
    first = np.cumsum(sizes) - sizes
    if places is not None:
        w = w[places(ids.to_pylist(), sizes)]
    doc = np.repeat(np.arange(len(part), dtype=np.int32), sizes)
    start, end, period = runs_of(w, doc, shortest)
    of = doc[start]
    gone = np.zeros(len(w) + 1, np.int32)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, end, -1)
    kept = np.cumsum(gone[:-1], dtype=np.int32) == 0
    before = np.append(0, np.cumsum(kept))[np.append(first, len(w))]
    left = pc.binary_join(pa.ListArray.from_arrays(pa.array(before, pa.int32()), words.take(pa.array(w[kept]))), " ")
    at = pa.array(np.searchsorted(of, np.arange(len(part) + 1)), pa.int32())
    return [*(pa.ListArray.from_arrays(at, pa.array(x, pa.int64())) for x in (start - first[of], end - start, period)), left]


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST, id_col: str = "doc_id", text_col: str = "text", places: Callable[[list, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """doc_id, runs (array of start, length, period; in words from 0, by start and period) and collapsed of every row.

    Words are stretches without ASCII white space. A run is a stretch with smallest period q and at least
    max(shortest, 2q) words that no neighbouring word extends; ``collapsed`` has each run's first q words and those
    outside runs, joined by one space. Null and empty texts have no runs and an empty ``collapsed``. Every row gives one row,
    repeated ones and null ids too; texts are read whole, each in one task, which takes memory by its words times the
    levels of its repeats (at most the logarithm of their number): 4 bytes a word and level, and some 140 bytes a word.

    ``places`` may put other words in a word's place before runs are looked for: of the ids of some texts and their numbers
    of words it makes, for all their words one after another, the number among these words of the one that comes to stand there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text = batch.column("doc_id"), batch.column("text")
            first, total = 0, 0
            for i, size in enumerate(pc.binary_length(text).to_pylist()):
                total += size
                if total >= PART_BYTES or i + 1 == len(text):
                    mine = ids.slice(first, i + 1 - first)
                    found = _of_texts(text.slice(first, len(mine)), mine, shortest, places)
                    yield pa.RecordBatch.from_arrays([mine, *found], ["doc_id", "start", "length", "period", "collapsed"])
                    first, total = i + 1, 0

    found = texts(docs, id_col, text_col).mapInArrow(thrifty(run), "doc_id long, start array<long>, length array<long>, period array<long>, collapsed string")
    return found.select("doc_id", F.arrays_zip("start", "length", "period").alias("runs"), "collapsed")


def planted_tails(ids: list[int | None], sizes: np.ndarray) -> np.ndarray:
    """Places that make the tail of every tenth text periodic: with h the crc32 of its id in decimals, g = floor(h / 10) and n words, where h is divisible by 10 each word i from a = g % n on becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)). Others, and those without words or id, stay."""
    at = np.arange(int(sizes.sum()))
    for i, n, end in zip(ids, sizes.tolist(), np.cumsum(sizes).tolist(), strict=True):
        h = 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            at[end - n + a : end] = end - n + a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return at
