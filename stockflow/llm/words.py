"""Hashed word features: each distinct word is normalised and hashed once for each worker's table."""

from __future__ import annotations

import zlib

import numpy as np

from stockflow.llm.common import held

MOST_WORDS = 250_000
EDGE = ".,;:!?\"'()[]{}<>*#&$%|/\\-_~`^+=@"
STEM = 4
MIX = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Word as written -> number in ``full`` and ``stem``, hashes of its lower-case form without edge marks and of that form's first letters (0: nothing left)."""

    def __init__(self) -> None:
        super().__init__()
        self.full_new: list[int] = []
        self.stem_new: list[int] = []
        self.full = self.stem = np.zeros(0, np.uint64)

    def __missing__(self, word: str) -> int:
        plain = word.strip(EDGE).lower()
        self.full_new.append(zlib.crc32(plain.encode()) + 1 if plain else 0)
        self.stem_new.append(zlib.crc32(plain[:STEM].encode()) + 1 if plain else 0)
        self[word] = n = len(self)
        return n

    def hashes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all words with something left: text number, full hash, stem hash."""
        if len(self) > MOST_WORDS:
            self.clear()
            self.full = self.stem = np.zeros(0, np.uint64)
        get, numbers = self.__getitem__, []
        for text in texts:
            parts = text.split()
            numbers.append(np.fromiter(map(get, parts), np.int64, len(parts)))
        self.full = np.concatenate([self.full, np.array(self.full_new, np.uint64)])
        self.stem = np.concatenate([self.stem, np.array(self.stem_new, np.uint64)])
        self.full_new, self.stem_new = [], []
        n = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        doc, full, stem = np.repeat(np.arange(len(texts)), [len(x) for x in numbers]), self.full[n], self.stem[n]
        some = full > 0
        return doc[some], full[some], stem[some]


def words() -> Words:
    """The worker's table."""
    return held(Words, Words)


def in_parts(texts: list[str], chars: int = 1_000_000):
    """(first, texts) runs of about so many characters."""
    first, total = 0, 0
    for i, text in enumerate(texts):
        total += len(text)
        if total >= chars or i + 1 == len(texts):
            yield first, texts[first : i + 1]
            first, total = i + 1, 0


def _slot(h: np.ndarray, kind: int, bits: int) -> np.ndarray:
    return ((h + np.uint64(kind)) * MIX >> np.uint64(64 - bits)).astype(np.int64)


def grams(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, slot) of hashed words and stems, and of pairs and skip pairs (one word between) of words and of stems; slots may repeat."""
    doc, full, stem = words().hashes(texts)
    docs, slots = [doc, doc], [_slot(full, 1, bits), _slot(stem, 2, bits)]
    for gap, kinds in ((1, (3, 5)), (2, (4, 6))):
        together = doc[:-gap] == doc[gap:]
        for word, kind in zip((stem, full), kinds, strict=True):
            pair = (word[:-gap] * np.uint64(0xC2B2AE3D27D4EB4F) ^ word[gap:] * np.uint64(0x165667B19E3779F9))[together]
            docs.append(doc[:-gap][together])
            slots.append(_slot(pair, kind, bits))
    return np.concatenate(docs), np.concatenate(slots)


def gram_sets(texts: list[str], bits: int) -> list[np.ndarray]:
    """The set of slots of each text, ascending."""
    doc, slot = grams(texts, bits)
    both = np.unique(doc << bits | slot)
    return np.split(both & ((1 << bits) - 1), np.searchsorted(both >> bits, np.arange(1, len(texts))))


def gram_scores(texts: list[str], weights: np.ndarray, bias: float, bits: int) -> np.ndarray:
    """Linear score of each text: bias and the weights of its set of slots."""
    doc, slot = grams(texts, bits)
    used = weights[slot] != 0
    both = np.unique(doc[used] << bits | slot[used])
    return bias + np.bincount(both >> bits, weights[both & ((1 << bits) - 1)], len(texts))
