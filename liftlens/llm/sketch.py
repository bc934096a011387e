"""Which hashed items occur often: bit maps of bounded size, merged from partitions.

Each task counts the fine cells of its own items and sends the counts off in rows, one for each range of cells, so rows follow
the items and not items times cells. The rows of one range meet in one group, which adds them up one batch at a time in a table
of bounded size. Only then are ``FINE`` neighbours taken together: a cell of the result says for each level whether a fine cell
in it reaches it. So items that occur once fill no cell, and a map is as full as the items that occur often make it. Items that
share a fine cell are overestimated, none is ever underestimated. The number of cells follows the input up to ``MAX_CELLS``,
which bounds what is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_CELLS, MAX_CELLS = 1 << 20, 1 << 31
#: Fine cells, in which items are counted, of one cell.
FINE = 16
#: Levels above the first are rarer: so many cells share one of theirs.
RARER = 16
#: Fine cells whose places fit in two bytes.
BLOCK = 1 << 16
#: Ranges of cells at the least, where there are blocks enough, and cells of one range at the most.
RANGES, MOST = 64, 1 << 21
#: Items that a task holds before it counts them and sends the counts off.
HELD = 1 << 20
#: Counts stop here; levels are not above it.
TOP = 255


def cells_for(items: int) -> int:
    """A power of two of about two cells for each item, within the bounds."""
    return min(max(1 << max(2 * items - 1, 1).bit_length(), MIN_CELLS), MAX_CELLS)


def text_bytes(df: DataFrame, text_col: str) -> int:
    """Bytes of all texts, by which sketches are sized."""
    return df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


class Levels:
    """Bit maps, one for each level: does an item in the cell reach the level?"""

    def __init__(self, cells: int, levels: Sequence[int]):
        self.levels = tuple(levels)
        self.cells = [cells if k == 0 else cells // RARER for k in range(len(levels))]
        self.maps = [np.zeros(n // 8, np.uint8) for n in self.cells]

    def reached(self, hashes: np.ndarray) -> np.ndarray:
        """Number of levels, from the first on, that the cells of each hash reach."""
        out, still = np.zeros(len(hashes), np.uint8), np.ones(len(hashes), np.uint8)
        for cells, bits in zip(self.cells, self.maps):
            cell = hashes >> np.uint64(64 - cells.bit_length() + 1)
            place, bit = (cell >> np.uint64(3)).astype(np.int64), (np.uint64(7) - (cell & np.uint64(7))).astype(np.uint8)
            still &= (bits[place] >> bit) & np.uint8(1)
            out += still
        return out


def count(df: DataFrame, items: Callable[[pa.RecordBatch], Iterable[np.ndarray]], cells: int, levels: Sequence[int]) -> Levels:
    """Maps of all hashes that ``items`` yields for the batches of ``df``; give ``df`` only the columns it needs."""
    out = Levels(cells, levels)
    shift = np.uint64(64 - (cells * FINE).bit_length() + 1)
    size = min(max(cells // RANGES, BLOCK // FINE), MOST) * FINE
    blocks = size // BLOCK

    def sent_off(parts: list[np.ndarray]) -> pa.RecordBatch:
        cell, n = np.unique(np.concatenate(parts), return_counts=True)
        n = np.minimum(n, TOP).astype(np.uint8)
        ranges = np.unique(cell // size)
        bounds = np.searchsorted(cell, np.append(ranges, ranges[-1:] + 1) * size)
        squeeze = zstandard.ZstdCompressor(level=1).compress
        filled, places, counts = [], [], []
        for first, a, b in zip(ranges.tolist(), bounds[:-1], bounds[1:]):
            own = cell[a:b] - first * size
            filled.append(squeeze(np.bincount(own // BLOCK, minlength=blocks).astype(np.int32).tobytes()))
            places.append((own % BLOCK).astype(np.uint16).tobytes())
            counts.append(squeeze(n[a:b].tobytes()))
        return pa.RecordBatch.from_arrays(
            [pa.array(ranges.astype(np.int32)), pa.array(filled, pa.binary()), pa.array(places, pa.binary()), pa.array(counts, pa.binary())],
            names=["cells", "filled", "places", "counts"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for h in (h for batch in batches for h in items(batch)):
            parts.append((h >> shift).astype(np.int64))
            held += len(h)
            if held >= HELD:
                yield sent_off(parts)
                parts, held = [], 0
        if held:
            yield sent_off(parts)

    def added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        total, starts = np.zeros(size, np.uint8), np.arange(blocks) * BLOCK
        for batch in batches:
            for filled, places, counts in zip(batch.column("filled"), batch.column("places"), batch.column("counts")):
                at = np.repeat(starts, np.frombuffer(expand(filled.as_buffer()), np.int32)) + np.frombuffer(places.as_buffer(), np.uint16)
                total[at] = np.minimum(total[at].astype(np.uint16) + np.frombuffer(expand(counts.as_buffer()), np.uint8), TOP)
        maps = []
        for k, level in enumerate(levels):
            bits = together(np.packbits(total >= level), FINE)
            maps.append((bits if k == 0 else together(bits, RARER)).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([maps], pa.list_(pa.binary()))], names=["cells", "maps"])

    sent = df.mapInArrow(counted, "cells int, filled binary, places binary, counts binary")
    merged = sent.groupBy("cells").applyInArrow(added, "cells int, maps array<binary>").toArrow()
    for at, maps in zip(merged["cells"].to_pylist(), merged["maps"]):
        for bits, own in zip(out.maps, maps.values):
            own = np.frombuffer(own.as_buffer(), np.uint8)
            bits[at * len(own):(at + 1) * len(own)] = own
    return out


def together(bits: np.ndarray, n: int) -> np.ndarray:
    """Bit map in which one bit stands for n neighbours (8, 16, 32 or 64), and is set if one of theirs is."""
    return np.packbits(bits.view(f"u{n // 8}") != 0)
