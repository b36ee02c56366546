"""Token ids of whole texts by the tokenizers library, for byte-level BPE vocabularies.

A text is cut before each space that a non-space follows: no merge of these vocabularies crosses such a place, so equal
chunks have equal ids and the library sees each distinct chunk once for each worker's table. A text that has other white
space beside a space, or a token that the vocabulary's file adds to the model's, goes to the library whole. A mark at a chunk's end is cut off after an ASCII letter where the
vocabulary has no token with such a letter before that mark, so that no merge can cross there either.
"""

from __future__ import annotations

import os
from string import ascii_letters

import numpy as np

from stockflow.llm.common import held

MOST_CHUNKS = 1_200_000
GROUP = 1000
MARKS, LETTERS = ".,;:!?", frozenset(ascii_letters)


class _Chunks(dict):
    """Chunk -> number; unseen chunks are numbered and noted. A first chunk has a space before it in here, others none."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        if not chunk or chunk[0] != " " and chunk[0].isspace():
            return -1  # the place before it is no cut
        self[chunk] = n = len(self)
        self.new.append(chunk)
        return n


def parts_of(texts: list[str], chars: int = 2_000_000):
    """Runs of texts of about so many characters."""
    first, total = 0, 0
    for i, text in enumerate(texts):
        total += len(text)
        if total >= chars or i + 1 == len(texts):
            yield texts[first : i + 1]
            first, total = i + 1, 0


class ChunkTable:
    """Whole texts to runs of numbers, each distinct chunk being looked up once; emptied at MOST_CHUNKS, which bounds its memory."""

    empties = True  # else its user does so, where numbers may change
    added: tuple[str, ...] = ()  # a text that holds one of these goes to the library whole
    marks: dict[str, np.ndarray] = {}  # marks that are cut off at the end of chunks, with their numbers

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.chunks, self.ids, self.start, self.length = _Chunks(), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def of_chunks(self, new: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of new chunks: all in one array, then first place and count of each chunk."""
        raise NotImplementedError

    def of_texts(self, texts: list[str]) -> list[np.ndarray]:
        """Numbers of whole texts."""
        raise NotImplementedError

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All numbers in one array, and their count for each text."""
        if self.empties and len(self.chunks) > MOST_CHUNKS:
            self.reset()
        get, numbers, whole = self.chunks.__getitem__, [], []
        for i, text in enumerate(texts):
            if any(x in text for x in self.added):
                whole.append(i)
                numbers.append(np.zeros(0, np.int64))
                continue
            parts = text.split(" ")
            parts[0] = " " + parts[0]
            n = np.fromiter(map(get, parts), np.int64, len(parts))
            if n.min() < 0:
                whole.append(i)
                n = n[:0]
            numbers.append(n)
        if self.chunks.new:
            self._learn()
        all_n = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        size = self.length[all_n]
        ids = self.ids[np.repeat(self.start[all_n] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        doc = np.repeat(np.arange(len(texts)), [len(n) for n in numbers])
        counts = np.bincount(doc, size, len(texts)).astype(np.int64)
        if whole:
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i, x in zip(whole, self.of_texts([texts[i] for i in whole]), strict=True):
                parts[i], counts[i] = x, len(x)
            ids = np.concatenate(parts)
        return ids, counts

    def _learn(self) -> None:
        """Numbers of the chunks that are new: what is left before a mark is a chunk of its own."""
        new, marks, get = self.chunks.new, self.marks, self.chunks.__getitem__
        whole, cut, before = [], [], []
        for i, x in enumerate(new):  # it grows by chunks before marks
            if x[-1] in marks and x[-2:-1] in LETTERS:
                cut.append(i)
                before.append(get(x[:-1]))
            else:
                whole.append(i)
        self.chunks.new = []
        ids, start, length = self.of_chunks([new[i] for i in whole])
        first = len(self.start)
        self.start, self.length = (np.concatenate([x, np.zeros(len(new), np.int64)]) for x in (self.start, self.length))
        self.start[np.array(whole, np.int64) + first], self.length[np.array(whole, np.int64) + first] = start + len(self.ids), length
        self.ids = np.concatenate([self.ids, ids])
        if cut:
            base, tail = np.array(before), [marks[new[i][-1]] for i in cut]
            of_tail, size = np.array([len(x) for x in tail]), self.length[base]
            end = np.cumsum(size + of_tail)
            out = np.zeros(int(end[-1]), self.ids.dtype)
            at = end - size - of_tail
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            out[np.repeat(at, size) + step] = self.ids[np.repeat(self.start[base], size) + step]
            out[np.repeat(at + size, of_tail) + np.arange(of_tail.sum()) - np.repeat(np.cumsum(of_tail) - of_tail, of_tail)] = np.concatenate(tail)
            self.start[np.array(cut) + first], self.length[np.array(cut) + first] = at + len(self.ids), size + of_tail
            self.ids = np.concatenate([self.ids, out])

    def in_parts(self, texts: list[str], chars: int = 2_000_000):
        """(first, ids, counts) for runs of texts of about so many characters: what is held at once stays small."""
        first = 0
        for part in parts_of(texts, chars):
            yield first, *self.encode(part)
            first += len(part)


class Encoder(ChunkTable):
    """Whole texts to the ids of a vocabulary file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.added = tuple(added) if not any(c.isspace() for x in added for c in x) else ("",)  # texts beside each other may make one with a space
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.n_bytes = np.zeros(self.size, np.int64)
        for token, i in vocab.items():
            self.n_bytes[i] = len(token)  # each character stands for a byte
        joined = {b for token in vocab for a, b in zip(token, token[1:], strict=False) if b in MARKS and a in LETTERS}
        self.marks = {m: x for m, x in zip(MARKS, self.of_texts(list(MARKS)), strict=True) if m not in joined}

    def of_texts(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def of_chunks(self, new: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunks go to the library joined and are told apart by their bytes; those that begin a text go alone."""
        first = np.fromiter((x[0] == " " for x in new), bool, len(new))
        rest = [x for x in new if x[0] != " "]
        ids, sizes = [], []
        for at in range(0, len(rest), GROUP):
            group = rest[at : at + GROUP]
            found = self.of_texts([" " + " ".join(group)])[0]
            ends = np.cumsum(np.fromiter((len(x.encode()) for x in group), np.int64, len(group)) + 1)
            sizes.append(np.diff(np.searchsorted(np.cumsum(self.n_bytes[found]), ends, "left") + 1, prepend=0))
            ids.append(found)
        alone = self.of_texts([x[1:] for x in new if x[0] == " "])
        in_order = np.concatenate([*sizes, np.array([len(x) for x in alone], np.int64)])
        starts, start, length = np.cumsum(in_order) - in_order, np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        length[~first], length[first] = in_order[: len(rest)], in_order[len(rest) :]
        start[~first], start[first] = starts[: len(rest)], starts[len(rest) :]
        return np.concatenate([*ids, *alone]), start, length


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    return held((Encoder, path), lambda: Encoder(path))
