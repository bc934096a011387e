"""Words of whole texts as 64-bit hashes, by numpy over the bytes of an Arrow batch.

A word is a longest run of characters other than ``[\\x20\\x09-\\x0D]``. Its hash is a polynomial over random numbers that
stand for its bytes, then scrambled. Texts are taken in chunks of bounded size; the power tables cover one segment, so
a very long text needs memory for its words but not for powers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed together, and bytes that one table of powers covers.
CHUNK, SEGMENT = 1 << 20, 1 << 18
_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers; different ones stay different."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
        h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
        return h ^ (h >> _U(32))


class Hasher:
    """Word hashes for one seed; ``lower`` reads A-Z as a-z."""

    def __init__(self, seed: int, lower: bool):
        random = np.random.Generator(np.random.PCG64(seed))
        self.of_byte = random.integers(0, 2 ** 64, 256, np.uint64)
        if lower:
            self.of_byte[65:91] = self.of_byte[97:123]
        self.base = int(random.integers(0, 2 ** 61)) * 8 + 3
        self.space = np.zeros(256, bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        self._grow(SEGMENT)

    def _grow(self, n: int) -> None:
        inverse = pow(self.base, -1, 2 ** 64)
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.full(n, self.base, np.uint64))
            self.inverse = np.cumprod(np.full(n, inverse, np.uint64))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, number of words before each text and at the end); text i is data[offsets[i]:offsets[i + 1]]."""
        if not len(data):
            return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
        inside = ~self.space[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | cut[1:-1]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | cut[1:-1]
        starts, stops = np.flatnonzero(begin), np.flatnonzero(end) + 1
        out = np.empty(len(starts), np.uint64)
        at = 0
        with np.errstate(over="ignore"):
            while at < len(starts):
                first = starts[at]
                upto = max(int(np.searchsorted(stops, first + SEGMENT, "right")), at + 1)
                length = int(stops[upto - 1] - first)
                if length > len(self.power):
                    self._grow(length)
                sums = np.zeros(length + 1, np.uint64)
                np.cumsum(self.of_byte[data[first:first + length]] * self.power[:length], out=sums[1:])
                a, b = starts[at:upto] - first, stops[at:upto] - first
                out[at:upto] = (sums[b] - sums[a]) * self.inverse[a]
                at = upto
        return mix(out), np.searchsorted(starts, offsets)


@dataclass
class Chunk:
    """Texts ``first`` to ``first + len(ends) - 1`` of a batch: word hashes, and where each text's words begin and end."""

    first: int
    words: np.ndarray
    begins: np.ndarray
    ends: np.ndarray

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ends)), self.ends - self.begins)


def chunks(texts: pa.Array, hasher: Hasher) -> Iterator[Chunk]:
    """Word hashes of all texts of an Arrow string array; null counts as empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        upto = max(int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1, row + 1)
        part = offsets[row:upto + 1]
        words, places = hasher(data[part[0]:part[-1]], part - part[0])
        yield Chunk(row, words, places[:-1], places[1:])
        row = upto


def grams(words: np.ndarray, n: int, multiplier: int) -> np.ndarray:
    """Hash of the n words from each place on; ``len(words) - n + 1`` of them, also across texts."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    size = len(words) - n + 1
    with np.errstate(over="ignore"):
        h = words[:size].copy()
        for j in range(1, n):
            h *= _U(multiplier)
            h += words[j:j + size]
    return mix(h)


def whole(chunk: Chunk, n: int, size: int) -> np.ndarray:
    """Which of the first ``size`` places begin n words of one text."""
    ends = np.repeat(chunk.ends, chunk.ends - chunk.begins)[:size]
    return np.arange(size) + n <= ends
