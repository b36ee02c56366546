"""Token-id files: range asymmetric numeral system with a static, shared frequency table.

File format. A file set is a folder with two Parquet tables that Spark writes: ``frequencies`` (id, frequency; all ids of
the vocabulary, summing to 2**20) and ``blocks``, in ascending document order: part, block (its number there), before
(ids before it in the part), n_ids, docs (ids and token counts of its documents) and payload. A payload decodes alone,
given the frequencies; it is, little-endian,
  magic "SFRANS02", ids, lanes, steps, checkpoints, words (each 4 bytes unsigned), crc32 of the ids as unsigned 32 bits,
  crc32 of all that follows; then the checkpoints' first words (4 bytes each), their lane states (8 bytes each), words.
Lane l of step s codes id number s * lanes + l. A checkpoint holds all lane states before its step, every
CHECKPOINT steps, so that ranges of steps decode independently: a whole block decodes from all its checkpoints side by
side, and a range of ids from those that it touches.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.llm.common import let_go, shared_dir, texts, written
from stockflow.llm.tokens import encoder

MAGIC = b"SFRANS02"
HEAD = struct.Struct("<8s7I")
BITS = 20
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
CHECKPOINT = 256
LANES = 2048
BLOCK_IDS = 1 << 20


class Table:
    """Frequencies that sum to 2**BITS, every id of the vocabulary having at least 1."""

    def __init__(self, freq: np.ndarray) -> None:
        self.freq = freq.astype(np.uint64)
        self.first = np.cumsum(self.freq, dtype=np.uint64) - self.freq
        self._symbols: np.ndarray | None = None

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        """The frequencies nearest to how often the ids occur."""
        if len(counts) > 1 << (BITS - 1):
            raise ValueError("the vocabulary is too large for the table")
        free = (1 << BITS) - len(counts)
        f = 1 + (counts.astype(np.float64) * free / max(1, int(counts.sum()))).astype(np.int64)
        f[int(np.argmax(counts))] += (1 << BITS) - int(f.sum())
        return cls(f)

    @property
    def symbols(self) -> np.ndarray:
        """The id of each of the 2**BITS slots."""
        if self._symbols is None:
            self._symbols = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._symbols


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES) -> bytes:
    """The payload of a run of ids."""
    lanes = max(1, min(lanes, len(ids) // 64 or 1))
    steps = -(-len(ids) // lanes)
    padded = np.zeros(steps * lanes, np.int64)
    padded[: len(ids)] = ids
    padded = padded.reshape(steps, lanes)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = [np.zeros(0, np.uint32)] * steps
    marks: dict[int, np.ndarray] = {}
    shift = np.uint64(63 - BITS)
    for s in range(steps - 1, -1, -1):
        f = table.freq[padded[s]]
        full = state >= f << shift
        words[s] = state[full].astype(np.uint32)
        state = np.where(full, state >> WORD, state)
        high = state // f
        state = (high << np.uint64(BITS)) + (state - high * f) + table.first[padded[s]]
        if s % CHECKPOINT == 0:
            marks[s] = state
    sizes = np.cumsum([0, *(len(w) for w in words)])
    at = sorted(marks)
    stream = np.concatenate(words) if steps else np.zeros(0, np.uint32)
    body = sizes[at].astype("<u4").tobytes() + b"".join(marks[s].astype("<u8").tobytes() for s in at) + stream.astype("<u4").tobytes()
    return HEAD.pack(MAGIC, len(ids), lanes, steps, len(at), len(stream), zlib.crc32(np.asarray(ids, "<u4").tobytes()), zlib.crc32(body)) + body


def ids_per_checkpoint(payload: bytes) -> int:
    return HEAD.unpack_from(payload)[2] * CHECKPOINT


def decode_block(payload: bytes, table: Table, marks: tuple[int, int] | None = None) -> np.ndarray:
    """The ids of a payload, or only those from one checkpoint up to another; a damaged payload is refused.

    All checkpoints are decoded side by side, a step of each at a time.
    """
    magic, n, lanes, steps, n_marks, n_words, crc_ids, crc_body = HEAD.unpack_from(payload)
    if magic != MAGIC or zlib.crc32(payload[HEAD.size :]) != crc_body:
        raise ValueError("damaged block")
    first, last = marks or (0, n_marks)
    first, last = min(first, n_marks), min(last, n_marks)
    if first >= last:
        return np.zeros(0, np.uint32)
    at = np.frombuffer(payload, "<u4", n_marks, HEAD.size)[first:last].astype(np.int64)
    state = np.frombuffer(payload, "<u8", n_marks * lanes, HEAD.size + 4 * n_marks).reshape(n_marks, lanes)[first:last].astype(np.uint64)
    words = np.frombuffer(payload, "<u4", n_words, HEAD.size + 4 * n_marks + 8 * n_marks * lanes).astype(np.uint64)
    end = min(steps, last * CHECKPOINT)
    rest = end - (last - 1) * CHECKPOINT  # steps of the last checkpoint
    out = np.zeros((last - first, CHECKPOINT, lanes), np.uint32)
    mask, bits = np.uint64((1 << BITS) - 1), np.uint64(BITS)
    for s in range(CHECKPOINT if last - first > 1 else rest):
        if s == rest:
            state, at = state[:-1], at[:-1]
        slot = state & mask
        sym = table.symbols[slot.astype(np.int64)]
        out[: len(state), s] = sym
        state >>= bits
        state *= table.freq[sym]
        state += slot
        state -= table.first[sym]
        low = state < LOW
        size = low.sum(axis=1)
        where = np.flatnonzero(low)
        flat = state.reshape(-1)
        flat[where] = (flat[where] << WORD) | words[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(len(where))]
        at = at + size
    ids = out.reshape(-1)[: min(n, end * lanes) - first * CHECKPOINT * lanes]
    if (first, last) == (0, n_marks) and zlib.crc32(ids.astype("<u4").tobytes()) != crc_ids:
        raise ValueError("damaged ids")
    return ids


def raw_blocks(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, block, before, n_ids, docs, ids (2 bytes each where the vocabulary allows, else 4) of runs of whole documents, and with the last one of a part counts (id, n) of all its ids.

    Documents are in ascending order of id, null ids first; those of one id are in the order of a hash of their texts.
    Parts are ranges of both, dealt by sampling, so they are even whatever the ids; a block is full at BLOCK_IDS ids and
    its memory is bounded by that and the longest document.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        size = max(e.size, end_id + 1)
        kind = "<u2" if size <= 1 << 16 else "<u4"
        part, block, before, held, n, total = TaskContext.get().partitionId(), 0, 0, [], 0, np.zeros(size, np.int64)

        def full(counts: bytes | None = None) -> pd.DataFrame:
            nonlocal block, before, held, n
            doc, null, sizes, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            docs_ = struct.pack("<I", len(doc)) + null.astype("u1").tobytes() + doc.astype("<i8").tobytes() + sizes.astype("<i8").tobytes()
            out = pd.DataFrame({"part": [part], "block": [block], "before": [before], "n_ids": [n], "docs": [docs_], "ids": [ids.tobytes()], "counts": [counts]})
            block, before, held, n = block + 1, before + n, [], 0
            return out

        for pdf in batches:
            null = pdf["null"].to_numpy()
            for first, ids, counts in e.in_parts(pdf["text"].tolist()):
                ids = np.insert(ids.astype(kind), np.cumsum(counts), end_id)
                total += np.bincount(ids, minlength=size)
                doc, own = pdf["doc_id"].to_numpy()[first : first + len(counts)], null[first : first + len(counts)]
                if n >= BLOCK_IDS:
                    yield full()
                held.append((doc, own, counts + 1, ids))
                n += len(ids)
        if held:
            seen = np.flatnonzero(total)
            yield full(np.stack([seen, total[seen]]).astype("<i8").tobytes())

    rows = texts(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    rows = rows.select(F.col("doc_id").isNull().alias("null"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "text")
    return rows.mapInPandas(run, "part int, block int, before long, n_ids long, docs binary, ids binary, counts binary")


def write_ids(docs: DataFrame, path: str, end_id: int, out: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Tokenize whole texts (null: empty), write the file set (to the folder ``out``, or one in the shared folder) and give its folder.

    Every row is a document, repeated ids and rows included; other columns are not read. An empty table gives no block.
    """
    spark = docs.sparkSession
    out = out or f"{shared_dir(spark)}/rans-{uuid.uuid4().hex}"
    raw = written(raw_blocks(docs, path, end_id, id_col, text_col), "ids")
    size = max(encoder(path).size, end_id + 1)

    def per_id(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x in pdf["counts"]:
                yield pd.DataFrame(np.frombuffer(x, "<i8").reshape(2, -1).T, columns=["id", "n"])

    # its size is the vocabulary's
    found = raw.where(F.col("counts").isNotNull()).select("counts").mapInPandas(per_id, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size, np.int64)
    counts[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    table = Table.of_counts(counts)
    spark.createDataFrame(pd.DataFrame({"id": np.arange(size), "frequency": table.freq.astype(np.int64)})).coalesce(1).write.parquet(f"{out}/frequencies")

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        kind = "<u2" if size <= 1 << 16 else "<u4"
        for pdf in batches:
            for i in range(len(pdf)):
                row = pdf.iloc[i : i + 1]
                yield row.drop(columns="ids").assign(payload=[encode_block(np.frombuffer(row["ids"].iloc[0], kind), table)])

    blocks = raw.drop("counts").mapInPandas(coded, "part int, block int, before long, n_ids long, docs binary, payload binary")
    blocks.write.option("compression", "uncompressed").parquet(f"{out}/blocks")
    return out


def _opened(spark: SparkSession, folder: str) -> tuple[DataFrame, Table, dict[int, int]]:
    """Blocks, frequencies and the parts' first positions of a file set: of the size of the vocabulary, and one number a part."""
    f = spark.read.schema("id long, frequency long").parquet(f"{folder}/frequencies").toPandas().sort_values("id")
    blocks = spark.read.schema("part int, block int, before long, n_ids long, docs binary, payload binary").parquet(f"{folder}/blocks")
    starts, total = {}, 0
    for part, n in sorted(blocks.groupBy("part").agg(F.max(F.col("before") + F.col("n_ids")).alias("n")).collect()):
        starts[part] = total
        total += n
    return blocks, Table(f["frequency"].to_numpy()), starts


def read_ids(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """Per document of a file set doc_id, start (ids of all documents before it), n_tokens, and its ids (array), or their crc32 for ``digest``.

    Blocks are decoded in parallel where they lie, each from all its checkpoints at once.
    """
    blocks, table, starts = _opened(spark, folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ids = decode_block(r.payload, table)
                n = struct.unpack_from("<I", r.docs)[0]
                null, doc, size = np.frombuffer(r.docs, "u1", n, 4), np.frombuffer(r.docs, "<i8", n, 4 + n), np.frombuffer(r.docs, "<i8", n, 4 + 9 * n)
                ends = np.cumsum(size)
                runs = np.split(ids.astype("<u4", copy=False), ends[:-1])
                what = [zlib.crc32(x) for x in runs] if digest else [x.astype(np.int64) for x in runs]
                doc = pd.array(doc.copy(), "Int64")
                doc[null > 0] = pd.NA
                yield pd.DataFrame({"doc_id": doc, "start": starts[r.part] + r.before + ends - size, "n_tokens": size, "ids": what})

    out = blocks.select("part", "before", "docs", "payload").mapInPandas(run, f"doc_id long, start long, n_tokens long, ids {'long' if digest else 'array<long>'}")
    return out.withColumnRenamed("ids", "ids_crc32") if digest else out


def read_range(spark: SparkSession, folder: str, first: int, last: int) -> DataFrame:
    """start and ids (array) of the parts of a file set from position ``first`` up to ``last``: only blocks that hold some are read, and only checkpoints that hold some are decoded."""
    blocks, table, starts = _opened(spark, folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                at = starts[r.part] + r.before
                a, b = max(first - at, 0), min(last - at, r.n_ids)
                if a < b:
                    per = ids_per_checkpoint(r.payload)
                    ids = decode_block(r.payload, table, (a // per, -(-b // per)))
                    yield pd.DataFrame({"start": [at + a], "ids": [ids[a - a // per * per : b - a // per * per].astype(np.int64)]})

    near = [p for p, s in starts.items() if s < last]
    near = [p for i, p in enumerate(near) if i + 1 == len(near) or starts[near[i + 1]] > first]
    some = blocks.where(F.col("part").isin(near)) if near else blocks.where("false")
    return some.select("part", "before", "n_ids", "payload").mapInPandas(run, "start long, ids array<long>")
