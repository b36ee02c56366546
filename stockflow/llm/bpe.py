"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

Documents are gathered in blocks of bounded size. A block keeps its pre-tokens' positions as runs of numbers into its own
list of distinct words, and the lists are shuffled by word: each task sees all blocks' entries of a word and merges its
bytes once. The ids go back to the blocks, where texts are put together by position. The table of blocks is bucketed by
block, so that the runs themselves are never shuffled. Decoding joins a block's distinct ids with the token-byte table and
puts the bytes together by position: a block's ids go ahead of its documents through a join that is broadcast, hence
without a shuffle and in order. Should they ever come apart, that is an error.
"""

from __future__ import annotations

import base64
import heapq
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.llm.common import shared_dir, texts, thrifty, written
from stockflow.llm.tokens import ChunkTable, parts_of

BLOCK_CHARS = 10_000_000
MOST_CHUNKS = 400_000
MOST_WORDS = 2_000_000
#: Runs of letters of several kinds and lengths.
LETTER_RUNS = ["a", "Word", "WORD", "camelCase", "été", "ßß", "Ǆǅ", "ªº", "слово", "漢字", "ʰa", "אב", "letters" * 40]


@lru_cache(maxsize=2)
def ranks_of(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, which is the id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of neighbours with the lowest rank, the first of equals, is merged until none is left."""
    if word in ranks:
        return [ranks[word]]
    get = ranks.get
    if len(word) <= 48:
        parts = [word[i : i + 1] for i in range(len(word))]
        pair = [get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            best, at = None, -1
            for i, r in enumerate(pair):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return [ranks[x] for x in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pair[at]
            if at < len(pair):
                pair[at] = get(parts[at] + parts[at + 1])
            if at:
                pair[at - 1] = get(parts[at - 1] + parts[at])
    # long ones: a heap of pairs over a linked list
    ends, left = [i + 1 for i in range(len(word))], [i - 1 for i in range(len(word))]
    n = len(word)
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, mid, end = heapq.heappop(heap)
        if ends[i] != mid or mid >= n or ends[mid] != end:
            continue
        ends[i], ends[mid] = end, -1
        if end < n:
            left[end] = i
            if (r := get(word[i : ends[end]])) is not None:
                heapq.heappush(heap, (r, i, end, ends[end]))
        if left[i] >= 0 and (r := get(word[left[i] : end])) is not None:
            heapq.heappush(heap, (r, left[i], i, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : ends[i]]])
        i = ends[i]
    return out


class _Numbered(dict):
    """Key -> number in order of first use; the keys are kept in ``seen``."""

    def __init__(self) -> None:
        super().__init__()
        self.seen: list = []

    def __missing__(self, key: object) -> int:
        self[key] = n = len(self)
        self.seen.append(key)
        return n


class WordNumbers(ChunkTable):
    """Whole texts to numbers of their pre-tokens, by the pattern; ``trim`` empties it between blocks once it is large."""

    empties = False

    def __init__(self, pattern: str) -> None:
        import regex

        self.find = regex.compile(pattern).findall
        # whether letters after a space are one pre-token of this pattern
        self.letters_whole = all(self.find(x) == [x] for x in (" " + w for w in LETTER_RUNS))
        super().__init__()

    def reset(self) -> None:
        super().reset()
        self.words, self.raw, self.size, self.hash = _Numbered(), [], np.zeros(0, np.int64), np.zeros(0, np.int64)

    def trim(self) -> None:
        if len(self.chunks) > MOST_CHUNKS:
            self.reset()

    def measure(self) -> None:
        """Bytes, sizes and hashes of the words that are new."""
        new = [w.encode() for w in self.words.seen[len(self.raw) :]]
        self.raw += new
        self.size = np.concatenate([self.size, np.array([len(w) for w in new], np.int64)])
        self.hash = np.concatenate([self.hash, np.array([zlib.crc32(w) for w in new], np.int64)])

    def of_texts(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array([self.words[w] for w in self.find(x)], np.uint32) for x in texts]

    def of_chunks(self, new: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat: list[int] = []
        sizes = np.ones(len(new), np.int64)
        number = self.words.__getitem__
        for i, x in enumerate(new):
            if self.letters_whole and x.isalpha():
                flat.append(number(" " + x))
            else:
                found = self.find(x[1:] if x[0] == " " else " " + x)
                sizes[i] = len(found)
                flat += map(number, found)
        return np.array(flat, np.uint32), np.cumsum(sizes) - sizes, sizes


def short(sizes: np.ndarray) -> tuple[bytes, bytes]:
    """Sizes in a byte each, those from 255 on as 255 and again apart in four bytes."""
    return np.minimum(sizes, 255).astype(np.uint8).tobytes(), sizes[sizes >= 255].astype("<u4").tobytes()


def from_short(small: bytes, large: bytes) -> np.ndarray:
    """What ``short`` was given."""
    out = np.frombuffer(small, np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(large, "<u4")
    return out


def word_blocks(docs: DataFrame, pattern: str, groups: int, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of two kinds. grp < 0: a block's documents with the numbers of their pre-tokens, in order. Else: the block's distinct words that hash to group grp, with their numbers.

    A block numbers its words by group and then by their bytes, so that a group's numbers follow each other and its list
    compresses. Numbers are stored in four planes of bytes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, k, table, held, chars = TaskContext.get().partitionId(), 0, WordNumbers(pattern), [], 0

        def full() -> pd.DataFrame:
            table.measure()
            numbers = np.concatenate([n for _, _, n, _ in held])
            often = np.bincount(numbers, minlength=len(table.raw))
            used = np.flatnonzero(often)
            groups_of = table.hash[used] % groups
            listed = sorted(zip(groups_of.tolist(), [table.raw[i] for i in used.tolist()], used.tolist(), strict=True))
            rank = np.zeros(len(table.raw), np.uint32)
            rank[[i for *_, i in listed]] = np.arange(len(used))
            planes = rank[numbers].astype("<u4").view(np.uint8).reshape(-1, 4)
            ids, null = ([d for h in held for d in h[j]] for j in (0, 3))
            block = part << 32 | k
            rows = [(block, -1, np.array(null, np.uint8).tobytes(), np.array(ids, "<i8").tobytes(), np.concatenate([c for _, c, _, _ in held]).astype("<i8").tobytes(), *(planes[:, p].tobytes() for p in range(4)))]
            ends = np.cumsum(np.bincount(groups_of, minlength=groups)).tolist()
            for g, (first, last) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                if first < last:
                    words = [w for _, w, _ in listed[first:last]]
                    small, large = short(np.array([len(w) for w in words]))
                    rows.append((block, g, first.to_bytes(8, "big"), small, b"".join(words), large, b"", b"", b""))
            return pd.DataFrame(rows, columns=["block", "grp", "a", "b", "c", "p0", "p1", "p2", "p3"])

        for pdf in batches:
            at = 0
            for part_texts in parts_of(pdf["text"].tolist()):
                numbers, counts = table.encode(part_texts)
                own = slice(at, at + len(counts))
                held.append((pdf["doc_id"].iloc[own].tolist(), counts, numbers, pdf["no_id"].iloc[own].tolist()))
                at += len(counts)
                chars += sum(map(len, part_texts))
                if chars >= block_chars:
                    yield full()
                    k, held, chars = k + 1, [], 0
                    table.trim()
        if held:
            yield full()

    # pandas would turn whole numbers beside nulls into floats
    known = docs.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text")
    return known.mapInPandas(thrifty(run), "block long, grp int, a binary, b binary, c binary, p0 binary, p1 binary, p2 binary, p3 binary")


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, most_words: int = MOST_WORDS, with_decoded: bool = False) -> DataFrame:
    """doc_id and ids (array of int) of every row: the whole text, without special tokens.

    ``with_decoded`` adds decoded, the bytes that the ids stand for, as ``decode`` would.

    A null or empty text has no ids; each row gives one row, repeated ones and null ids too; other columns are not read.
    Memory is bounded by ``block_chars``, the longest text and ``most_words``: a task that holds more distinct words than
    that begins anew, and merges again those that it meets again. An empty table gives no rows.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"word_blocks_{uuid.uuid4().hex}"
    (word_blocks(texts(docs, id_col, text_col), pattern, n, block_chars).write.bucketBy(n, "block").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name))
    table = spark.table(name)
    kind = "<u2" if max(ranks_of(ranks_path).values()) < 1 << 16 else "<u4"

    def words_to_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks, known = ranks_of(ranks_path), _Numbered()
        empty = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        flat, start, length = empty
        for pdf in batches:
            out = []
            for block, first, small, blob, large in zip(pdf["block"], pdf["a"], pdf["b"], pdf["c"], pdf["p0"], strict=True):
                if len(known) > most_words:
                    known = _Numbered()
                    flat, start, length = empty
                ends = np.cumsum(from_short(small, large)).tolist()
                words = [blob[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                n = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                if known.seen:  # each distinct word is merged once
                    new = [merged(w, ranks) for w in known.seen]
                    known.seen = []
                    more = np.array([len(x) for x in new], np.int64)
                    start, length = np.concatenate([start, len(flat) + np.cumsum(more) - more]), np.concatenate([length, more])
                    flat = np.concatenate([flat, np.array([i for x in new for i in x], "<u4")])
                size = length[n]
                ids = flat[np.repeat(start[n] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                out.append((block, first, *short(size), ids.astype(kind).tobytes()))
            yield pd.DataFrame(out, columns=["block", "first", "small", "large", "ids"])

    def put_together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                null, doc_ids, counts = np.frombuffer(r.a, np.uint8), np.frombuffer(r.b, "<i8"), np.frombuffer(r.c, "<i8")
                numbers = np.stack([np.frombuffer(p, np.uint8) for p in (r.p0, r.p1, r.p2, r.p3)], axis=1).copy().view("<u4").reshape(-1)
                parts = sorted([] if r.parts is None else r.parts, key=lambda x: x["first"])
                length = np.concatenate([from_short(x["small"], x["large"]) for x in parts] or [np.zeros(0, np.int64)])
                start = np.cumsum(length) - length
                flat = np.concatenate([np.frombuffer(x["ids"], kind) for x in parts] or [np.zeros(0, kind)]).astype(np.int32)
                if with_decoded and len(flat):
                    used = np.unique(flat)
                    yield pd.DataFrame({"block": r.block, "token": used, "doc_id": 0, "no_id": True, "ids": None})
                ends, first = np.cumsum(counts), 0
                while first < len(counts):  # documents of about 200,000 words at a time
                    base = ends[first] - counts[first]
                    last = max(first + 1, int(np.searchsorted(ends, base + 200_000)))
                    own = numbers[base : ends[last - 1]]
                    size = length[own]
                    ids = flat[np.repeat(start[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                    per_doc = np.add.reduceat(np.append(size, 0), np.minimum(ends[first:last] - counts[first:last] - base, len(size))) * (counts[first:last] > 0)
                    split = np.split(ids, np.cumsum(per_doc)[:-1])
                    if with_decoded:
                        yield pd.DataFrame({"block": r.block, "token": -1, "doc_id": doc_ids[first:last], "no_id": null[first:last] > 0, "ids": split})
                    else:
                        yield pd.DataFrame({"doc_id": _nullable(doc_ids[first:last], null[first:last] > 0), "ids": split})
                    first = last

    words = table.where("grp >= 0").select("block", "grp", "a", "b", "c", "p0").repartition(n, "grp")
    back = words.mapInPandas(thrifty(words_to_ids), "block long, first binary, small binary, large binary, ids binary")
    back = back.groupBy("block").agg(F.collect_list(F.struct("first", "small", "large", "ids")).alias("parts"))
    blocks = table.where("grp < 0").join(back, "block", "left")
    if not with_decoded:
        return blocks.mapInPandas(thrifty(put_together), "doc_id long, ids array<int>")

    def to_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Documents (token -1) with their bytes, from rows of a block's tokens and then of its documents."""
        current, token = None, {}
        for pdf in batches:
            of_doc = (pdf["token"] < 0).to_numpy()
            for block, at in pdf.groupby("block", sort=False).indices.items():
                docs_, tokens = pdf.iloc[at[of_doc[at]]], pdf.iloc[at[~of_doc[at]]]
                if block != current:
                    current, token = block, {}
                token.update(zip(tokens["token"].tolist(), tokens["bytes"], strict=True))
                for i in range(0, len(docs_), 1000):
                    some = docs_.iloc[i : i + 1000]
                    doc = _nullable(some["doc_id"].to_numpy(), some["no_id"].to_numpy())
                    yield pd.DataFrame({"doc_id": doc, "ids": some["ids"].tolist(), "decoded": [_bytes_of(x, token) for x in some["ids"]]})

    both = _with_bytes(blocks.mapInPandas(thrifty(put_together), "block long, token int, doc_id long, no_id boolean, ids array<int>"), ranks_path)
    return both.select("block", "token", "bytes", "doc_id", "no_id", "ids").mapInPandas(thrifty(to_bytes), "doc_id long, ids array<int>, decoded binary")


def token_bytes(spark: SparkSession, ranks_path: str) -> DataFrame:
    """The token-byte table: token and bytes, a row for each entry of the rank file."""
    return spark.createDataFrame([(i, b) for b, i in ranks_of(ranks_path).items()], "token int, bytes binary")


def _with_bytes(rows: DataFrame, ranks_path: str) -> DataFrame:
    """``rows`` with the bytes of their token. The table is broadcast: its size is the vocabulary's, whatever the input's."""
    return rows.join(F.broadcast(token_bytes(rows.sparkSession, ranks_path)), "token", "left")


def _nullable(values: np.ndarray, null: np.ndarray) -> pd.api.extensions.ExtensionArray:
    """Whole numbers, null where ``null``."""
    out = pd.array(values.copy(), "Int64")
    out[null] = pd.NA
    return out


def _bytes_of(ids: np.ndarray | None, token: dict[int, bytes]) -> bytes:
    return b"" if ids is None else b"".join(map(token.__getitem__, ids.tolist()))


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with decoded (binary): the bytes of its ids in order, by a join of each row's distinct ids with the token-byte table.

    No or null ids give no bytes; an id outside the table, or a null one, is an error. Other columns stay as they are,
    but for one of the name decoded, which is replaced. An empty table gives no rows.
    """
    row = f"row_{uuid.uuid4().hex}"  # numbers are written, so that they stay the same
    kept = written(encoded.drop("decoded").withColumn(row, F.monotonically_increasing_id()), "encoded")
    used = kept.select(F.col(row).alias("row"), F.explode(F.array_distinct(ids_col)).alias("token"))
    found = _with_bytes(used, ranks_path)
    unknown = F.raise_error(F.concat(F.lit("no token has the id "), F.coalesce(F.col("token").cast("string"), F.lit("null")))).cast("binary")
    found = found.withColumn("bytes", F.coalesce("bytes", unknown)).groupBy("row").agg(F.collect_list(F.struct("token", "bytes")).alias("known"))

    @F.pandas_udf("binary")
    def put_together(ids: pd.Series, tokens: pd.Series, bytes_: pd.Series) -> pd.Series:
        return pd.Series([b"" if t is None else _bytes_of(x, dict(zip(t.tolist(), b, strict=True))) for x, t, b in zip(ids, tokens, bytes_, strict=True)], dtype=object)

    both = kept.join(found.withColumnsRenamed({"row": row, "known": f"known_{row}"}), row, "left")
    return both.withColumn("decoded", put_together(ids_col, f"known_{row}.token", f"known_{row}.bytes")).drop(row, f"known_{row}")
