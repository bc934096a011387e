"""Byte-level BPE: text to token ids and back.

Encoding looks up in two tiers. A pre-token that is itself a vocabulary entry is found with a minimal perfect hash;
any other one is merged from its bytes with a heap over a linked list, lowest rank first and leftmost on ties.
Both are the same for every row, so each operator is one narrow pass: the vocabulary (tens of thousands of entries,
size checked) is broadcast and nothing is shuffled.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

#: Most vocabulary bytes that are broadcast.
MAX_VOCABULARY_BYTES = 64 << 20
#: Pre-tokens a worker remembers, and the longest (in characters) that it does; beyond them it only computes again.
MEMO_ENTRIES, MEMO_CHARS = 400_000, 64
#: Rows of one Arrow batch that a task returns.
OUT_ROWS = 512


class PerfectHash:
    """Minimal perfect hash of byte strings: n keys fill exactly n slots.

    Keys are grouped by one half of a 128-bit hash. Groups are placed largest first, each with the first displacement
    that sends all its keys to free slots; groups of one key name their slot directly.
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.groups = n // 3 + 1
        hashes = [self._halves(k) for k in keys]
        members: list[list[int]] = [[] for _ in range(self.groups)]
        for i, (low, high) in enumerate(hashes):
            members[high % self.groups].append(i)
        self.displacement = [0] * self.groups
        slots: list[int | None] = [None] * n
        single = []
        for group in sorted(range(self.groups), key=lambda g: (-len(members[g]), g)):
            inside = members[group]
            if len(inside) < 2:
                single += [(group, inside[0])] if inside else []
                continue
            step = 0
            while True:
                placed = {(hashes[i][0] + step * (hashes[i][1] | 1)) % n: i for i in inside}
                if len(placed) == len(inside) and all(slots[s] is None for s in placed):
                    break
                step += 1
            self.displacement[group] = step
            for s, i in placed.items():
                slots[s] = i
        free = (s for s in range(n) if slots[s] is None)
        for group, i in single:
            s = next(free)
            slots[s], self.displacement[group] = i, -s - 1
        self.index = slots
        self.keys = [keys[i] for i in slots]

    @staticmethod
    def _halves(key: bytes) -> tuple[int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        return h & 0xFFFFFFFFFFFFFFFF, h >> 64

    def get(self, key: bytes) -> int | None:
        """Place of ``key`` in the list the hash was built from, or None."""
        if not self.n:
            return None
        low, high = self._halves(key)
        d = self.displacement[high % self.groups]
        slot = -d - 1 if d < 0 else (low + d * (high | 1)) % self.n
        return self.index[slot] if self.keys[slot] == key else None


class Vocabulary:
    """Ranks of a vocabulary file with one ``base64 rank`` pair a line, and the pattern that cuts pre-tokens."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.pattern = pattern
        self.ids = [int(rank) for _, rank in pairs]
        tokens = [base64.b64decode(token) for token, _ in pairs]
        if sum(map(len, tokens)) > MAX_VOCABULARY_BYTES:
            raise ValueError("the vocabulary is too large to be broadcast")
        self.hash = PerfectHash(tokens)
        self.ranks = dict(zip(tokens, self.ids))
        self.tokens = dict(zip(self.ids, tokens))

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        place = self.hash.get(piece)
        return [self.ids[place]] if place is not None else merge(piece, self.ranks)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of ``piece`` by merges: a heap of (rank, left part), the parts being a linked list over the bytes."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, left, stop = heapq.heappop(heap)
        middle = end[left]
        if middle <= left or middle >= n or end[middle] != stop:
            continue  # one of the two parts has been merged since
        end[left], end[middle] = stop, -1
        if stop < n:
            before[stop] = left
            if (r := ranks.get(piece[left:end[stop]])) is not None:
                heapq.heappush(heap, (r, left, end[stop]))
        if left and (r := ranks.get(piece[before[left]:stop])) is not None:
            heapq.heappush(heap, (r, before[left], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class _Memo(dict):
    """Pre-token to the bytes of its ids (int32), filled on demand and bounded."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.vocabulary.encode_piece(piece.encode()), np.int32).tobytes()
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids


def _lists(values: list[bytes], width: int) -> tuple[np.ndarray, bytes]:
    return np.cumsum([0] + [len(v) // width for v in values], dtype=np.int32), b"".join(values)


def encode(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``ids`` array<int>) for every row; ``ids`` are those of the whole text without special tokens.

    Null and empty texts give an empty array; null ids and repeated rows stay as they are; other columns are left out.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, memo = regex.compile(shared.value.pattern).findall, _Memo(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(start, OUT_ROWS)
                rows = [b"".join(map(memo.__getitem__, cut(text))) if text else b"" for text in part.column(1).to_pylist()]
                offsets, data = _lists(rows, 4)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(data, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(df: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``decoded`` binary, the bytes that the ids stand for.

    A null array gives null and an empty one no bytes; an id that the vocabulary does not hold is an error.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary.tokens)
    schema = df.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.__getitem__
        for batch in batches:
            for start in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(start, OUT_ROWS)
                ids = part.column(part.num_columns - 1)
                flat, ends, valid = ids.values.to_numpy(), ids.offsets.to_numpy(), ids.is_valid().to_pylist()
                out = [b"".join(map(token, flat[ends[i]:ends[i + 1]].tolist())) if valid[i] else None for i in range(len(ids))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(out, pa.binary())], names=[*keep, "decoded"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return df.select(*keep, ids_col).mapInArrow(run, f"{ddl}, decoded binary")
