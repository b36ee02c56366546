"""Best-fit packing of documents into token sequences by a grouping genetic algorithm.

Pieces are dealt by hash into shards of bounded size. Each shard has a few islands, which evolve populations of whole
packings in epochs: a crossover injects well-filled bins of one parent into the other, removes the bins that hold the
same pieces, lets displaced pieces take the place of smaller ones in bins with room, and best-fits what is left; a
mutation breaks some bins up in the same way. After each epoch but the last, each island's elite migrates to the next
island. A shard is done at the bound that its lengths' sum sets; one that is far from it evolves for longer. The bins that
stay loose in the best packings, with as many full ones of small pieces, are dealt into new shards and evolved again, until
one shard is left or nothing shrinks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockflow.llm.common import blocks_for, dealt, texts, written
from stockflow.llm.tokens import encoder

PER_SHARD = 4096
ISLANDS = 3
EPOCHS = 3
GENERATIONS = 3
HARD, HARD_GENERATIONS = 0.002, 30
POPULATION = 4
LOOSE = 0.995
SHRINKS = 0.9


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): each row's text as token ids with the end id.

    Documents of more than ``capacity`` ids are cut into pieces of that length, the first being what is left over. A
    null text is empty; every row is a document of its own, repeated ids and rows included.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        for pdf in batches:
            for first, ids, counts in e.in_parts(pdf["text"].tolist()):
                out: list[tuple] = []
                end = np.array([end_id], np.uint32)
                for doc_id, own in zip(pdf["doc_id"].iloc[first : first + len(counts)], np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                    own = np.concatenate([own, end]).astype("<u4")
                    n = len(own)
                    cut = n if n <= capacity else n % capacity or capacity
                    for k, (a, b) in enumerate([(0, cut), *((x, x + capacity) for x in range(cut, n, capacity))]):
                        out.append((None if pd.isna(doc_id) else int(doc_id), k, a, b - a, zlib.crc32(own[a:b].tobytes()), own[a:b].tobytes() if with_ids else None))
                pdf_out = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
                yield pdf_out.astype({"doc_id": "Int64"})

    out = texts(docs, id_col, text_col).mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")
    return out if with_ids else out.drop("ids")


class Bins:
    """Bins of one capacity with best fit: the fullest bin that a piece still fits into, else a new one."""

    def __init__(self, capacity: int, load: np.ndarray) -> None:
        self.capacity, self.load = capacity, load.tolist()
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.rooms = 0  # bit r: some bin has room r
        for b, x in enumerate(self.load):
            if x < capacity:
                self._open(b, capacity - x)

    def _open(self, b: int, room: int) -> None:
        self.by_room[room].append(b)
        self.rooms |= 1 << room

    def put(self, length: int) -> int:
        fits = self.rooms >> length
        if not fits:
            b, room = len(self.load), self.capacity
            self.load.append(0)
        else:
            room = length + (fits & -fits).bit_length() - 1
            b = self.by_room[room].pop()
            if not self.by_room[room]:
                self.rooms &= ~(1 << room)
        self.load[b] += length
        if room > length:
            self._open(b, room - length)
        return b


def best_fit(lengths: np.ndarray, capacity: int, order: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Bin of each piece; pieces with a bin in ``start`` (-1: none) keep it, the others are placed in ``order``."""
    bins = np.full(len(lengths), -1, np.int64) if start is None else start.copy()
    kept = bins >= 0
    _, bins[kept] = np.unique(bins[kept], return_inverse=True)
    box = Bins(capacity, np.bincount(bins[kept], lengths[kept]).astype(np.int64))
    for i, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        bins[i] = box.put(length)
    return bins


def fitness(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> float:
    """Mean squared fill, less one for each bin: fewer bins first, then fuller ones beside emptier ones."""
    fill = np.bincount(bins, lengths) / capacity
    return float((fill * fill).mean() - len(fill))


def replaced(lengths: np.ndarray, capacity: int, start: np.ndarray) -> None:
    """Displaced pieces (-1 in ``start``) take the place of one or two smaller ones in bins with room, so that bins get fuller and what is displaced smaller."""
    free = np.flatnonzero(start < 0)
    if not len(free):
        return
    size = lengths.tolist()
    pool = sorted(zip(lengths[free].tolist(), free.tolist(), strict=True))
    kept = np.flatnonzero(start >= 0)
    order = kept[np.argsort(start[kept], kind="stable")]
    load = np.bincount(start[kept], lengths[kept])
    cuts = np.flatnonzero(np.diff(start[order])) + 1
    for own in np.split(order, cuts):
        if not len(own):
            continue
        bin_, own = start[own[0]], own.tolist()
        room = capacity - int(load[bin_])
        for out in [*((i,) for i in own), *((i, j) for k, i in enumerate(own) for j in own[k + 1 :])] if room and len(own) <= 12 else ():
            taken = sum(size[i] for i in out)
            at = bisect_right(pool, (taken + room, len(size))) - 1
            if at >= 0 and pool[at][0] > taken:
                _, new = pool.pop(at)
                start[new] = bin_
                for i in out:
                    start[i] = -1
                    insort(pool, (size[i], i))
                break


def rebuilt(lengths: np.ndarray, capacity: int, start: np.ndarray) -> np.ndarray:
    """A whole packing from one with displaced pieces: replacements, then best fit by decreasing length."""
    replaced(lengths, capacity, start)
    free = np.flatnonzero(start < 0)
    return best_fit(lengths, capacity, free[np.argsort(-lengths[free], kind="stable")], start)


def crossover(lengths: np.ndarray, capacity: int, a: np.ndarray, b: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Some of b's well-filled bins go into a; a's bins with the same pieces go, and so do its loosest; the displaced are placed anew."""
    load_a, load_b = np.bincount(a, lengths), np.bincount(b, lengths)
    good = np.flatnonzero(load_b >= np.quantile(load_b, 0.7))
    chosen = rng.choice(good, max(1, len(good) // 6), replace=False)
    injected = np.isin(b, chosen)
    gone = np.zeros(len(load_a), bool)
    gone[np.unique(a[injected])] = True
    gone[np.argsort(load_a)[: max(1, len(load_a) // 50)]] = True
    start = np.where(gone[a], -1, a)
    start[injected] = len(load_a) + b[injected]
    return rebuilt(lengths, capacity, start)


def mutated(lengths: np.ndarray, capacity: int, a: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The loosest bins and a few others are broken up; their pieces are placed anew."""
    load = np.bincount(a, lengths)
    gone = np.zeros(len(load), bool)
    gone[np.argsort(load)[: max(1, len(load) // 30)]] = True
    gone[rng.choice(len(load), max(1, len(load) // 30), replace=False)] = True
    return rebuilt(lengths, capacity, np.where(gone[a], -1, a))


def evolve(lengths: np.ndarray, capacity: int, population: list[np.ndarray], rng: np.random.Generator, generations: int) -> list[np.ndarray]:
    """The population after so many generations (HARD_GENERATIONS while the best is further than HARD from the bound that the lengths' sum sets), best first; it stops early at the bound."""
    least = -(-int(lengths.sum()) // capacity)
    scored = sorted(((fitness(lengths, x, capacity), i, x) for i, x in enumerate(population)), reverse=True)
    serial = len(scored)
    for generation in range(HARD_GENERATIONS):
        bins = int(scored[0][2].max(initial=-1)) + 1
        if bins <= least or generation >= generations and bins - least <= HARD * least:
            break
        children = []
        for _ in range(max(1, len(population) // 2)):
            i, j = sorted(rng.choice(len(scored), 2, replace=False)) if len(scored) > 1 else (0, 0)
            children += [crossover(lengths, capacity, scored[i][2], scored[j][2], rng), mutated(lengths, capacity, scored[i][2], rng)]
        for child in children:
            serial += 1
            scored.append((fitness(lengths, child, capacity), serial, child))
        scored = sorted(scored, reverse=True)[: len(population)]
    return [x for *_, x in scored]


def first_population(lengths: np.ndarray, capacity: int, size: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Best fit by decreasing length, and by lengths with some noise."""
    noise = [np.zeros(len(lengths))] + [rng.normal(0, capacity / 40, len(lengths)) for _ in range(size - 1)]
    return [best_fit(lengths, capacity, np.argsort(-(lengths + x), kind="stable")) for x in noise]


def _islands(items: DataFrame, capacity: int, seed: int, islands: int, epochs: int) -> DataFrame:
    """item, length, shard, bin, loose, offset: the best packing of each shard of ``items`` (item, length, shard).

    Loose are the bins below LOOSE of the capacity, and as many full ones of the most pieces: small pieces are what large
    ones lack.
    """

    def gather(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item")
        return pd.DataFrame({"shard": [key[0]], "items": [pdf["item"].to_numpy("<i8").tobytes()], "lengths": [pdf["length"].to_numpy("<i4").tobytes()], "population": [b""], "elite": [b""], "score": [0.0]})

    def epoch(number: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = pdf[["shard", "island", "items", "lengths"]].copy()
                population, elite, score = [], [], []
                for r in pdf.itertuples(index=False):
                    lengths = np.frombuffer(r.lengths, "<i4").astype(np.int64)
                    rng = np.random.default_rng([seed, r.shard, r.island, number])
                    if number:
                        start = list(np.frombuffer(r.population, "<i4").astype(np.int64).reshape(-1, len(lengths)))
                        start[-1] = np.frombuffer(r.elite, "<i4").astype(np.int64)
                    else:
                        start = first_population(lengths, capacity, POPULATION, rng)
                    found = evolve(lengths, capacity, start, rng, GENERATIONS)
                    population.append(np.stack(found).astype("<i4").tobytes())
                    elite.append(found[0].astype("<i4").tobytes())
                    score.append(fitness(lengths, found[0], capacity))
                yield out.assign(population=population, elite=elite, score=score)

        return run

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                lengths, bins = np.frombuffer(r.lengths, "<i4").astype(np.int64), np.frombuffer(r.elite, "<i4").astype(np.int64)
                order, fill = np.argsort(bins, kind="stable"), np.bincount(bins, lengths).astype(np.int64)
                before = np.zeros(len(lengths), np.int64)
                before[order] = np.cumsum(lengths[order]) - lengths[order] - (np.cumsum(fill) - fill)[bins[order]]
                loose = fill < LOOSE * capacity
                full = np.flatnonzero(~loose)
                loose[full[np.argsort(-np.bincount(bins)[full], kind="stable")[: loose.sum()]]] = True
                yield pd.DataFrame({"item": np.frombuffer(r.items, "<i8"), "length": lengths, "shard": r.shard, "bin": bins, "loose": loose[bins], "offset": before})

    schema = "shard long, items binary, lengths binary, population binary, elite binary, score double"
    state = items.groupBy("shard").applyInPandas(gather, schema).withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    ring = Window.partitionBy("shard").orderBy("island")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for number in range(epochs):
        if number:  # elites migrate to the next island; the first gets the last one's
            state = state.withColumn("elite", F.coalesce(F.lag("elite").over(ring), F.last("elite").over(whole)))
        state = state.mapInPandas(epoch(number), "shard long, island int, items binary, lengths binary, population binary, elite binary, score double")
    best = state.withColumn("n", F.row_number().over(Window.partitionBy("shard").orderBy(F.desc("score"), "island"))).where("n = 1")
    return best.select("shard", "items", "lengths", "elite").mapInPandas(placed, "item long, length long, shard long, bin long, loose boolean, offset long")


def pack(items: DataFrame, capacity: int, seed: int = 11, per_shard: int = PER_SHARD, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """item, sequence_id, offset for each of ``items`` (item long, unique; length from 1 to ``capacity``).

    Sequences hold at most ``capacity`` and their offsets are gapless from 0. Full pieces make sequences of their own. No
    task holds more than about ``per_shard`` pieces; ties are broken by item. What is loose is packed again while it shrinks. An empty table gives no rows.
    """
    full = items.where(F.col("length") == capacity).select("item", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = items.where(F.col("length") < capacity).select("item", F.col("length").cast("long").alias("length"))
    count = rest.count()
    shards = blocks_for(count, per_shard)
    rest, done, level = rest.withColumn("shard", dealt("item", shards).cast("long")), [full], 0
    while True:
        found = written(_islands(rest, capacity, seed + level, islands, epochs), "packed")
        loose = found.where("loose")
        before, count = count, loose.count()
        last = shards == 1 or count > SHRINKS * before
        final = found if last else found.where("NOT loose")
        done.append(final.select("item", (F.lit(level) * (1 << 58) + F.col("shard") * (1 << 24) + F.col("bin")).alias("sequence_id"), "offset"))
        if last:
            break
        level, shards = level + 1, blocks_for(count, per_shard)
        rest = loose.select("item", "length").withColumn("shard", dealt("item", shards).cast("long"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document (see ``pieces``) with its sequence_id and offset."""
    rows = written(pieces(docs, path, capacity, end_id, with_ids, id_col, text_col).withColumn("item", F.monotonically_increasing_id()), "pieces")
    return rows.join(pack(rows, capacity), "item").drop("item")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids, lengths: the token sequences that ``pack_documents(..., with_ids=True)`` describes."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id", "length"))).alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return parts.select("sequence_id", ids.alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"), F.transform("p", lambda x: x["length"]).alias("lengths"))
