"""Removal of lines that many documents share.

The key of a line is the line without blanks at its ends, A-Z as a-z. Keys are hashed (128 bits), range-partitioned by hash
and sorted by hash, document (largest id first) and position, so each task streams over whole groups: the first document of
a group keeps its lines, the later ones lose theirs once a third document has been met. Ranges are cut by hash *and*
document, so a line in a third of all documents is spread over many tasks. Only the first and the last group of a task can
go on in another one; their rows are told by the least and the largest document of their key, at most two keys a task.
What comes back to the documents is one compressed bitmap of kept lines each, never text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftlens.session import materialize, small_batches

BLANK = b" \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 20, 3
#: Line rows, and bytes of texts, that a task gathers before it hands them on.
ROWS, BYTES = 20_000, 32 << 20
DROP, OPEN, WITNESS = 0, 1, 2
ROW = ["h1", "h2", "known", "doc", "f1", "f2", "pos"]
_TYPES = "h1 long, h2 long, known int, doc long, f1 long, f2 long, pos int"


def _identity(id_col: str, text_col: str) -> list[Column]:
    """A row is known by its id and 123 bits of its text; a null id is a document of its own, before all others."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.col(id_col).isNotNull().cast("int").alias("known"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("doc"),
            F.xxhash64(text).alias("f1"), F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long").alias("f2")]


def line_key(line: bytes) -> bytes:
    return line.strip(BLANK).lower()


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)


def line_rows(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """One row for each line whose key has ``min_chars`` characters: key hash, document, row and position."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, owners, positions = [], [], []

        def table():
            h = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            own = np.array(owners, np.int64).reshape(-1, 4)
            return pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(own[:, 0].astype(np.int32)), pa.array(own[:, 1]), pa.array(own[:, 2]),
                 pa.array(own[:, 3]), pa.array(positions, pa.int32())], names=ROW)

        for batch in batches:
            own = list(zip(*[c.to_pylist() for c in batch.columns[:4]]))
            for who, text in zip(own, batch.column(4)):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                for at, line in enumerate(data.split(b"\n")):
                    key = line_key(line)
                    if long_enough(key, min_chars):
                        hashes.append(hashlib.blake2b(key, digest_size=16).digest())
                        owners.append(who)
                        positions.append(at)
                if len(positions) >= ROWS:
                    yield table()
                    hashes, owners, positions = [], [], []
        if positions:
            yield table()

    return df.select(*_identity(id_col, text_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _TYPES)


class _Stream:
    """Walks the sorted rows of one task; holds rows of one document at the most."""

    def __init__(self):
        self.last = None          # the last row seen
        self.head = True          # still in the first group of the task
        self.ordinal = -1         # documents met in the open group, less one
        self.held: list[np.ndarray] = []
        self.seen: list[np.ndarray] = []

    def take(self, rows: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Decided and open rows after ``rows`` (columns as ROW) have been read."""
        first = self.last is None
        before = np.vstack([rows[:1] if first else self.last, rows[:-1]])
        new_key = (rows[:, :2] != before[:, :2]).any(axis=1)
        new_key[0] |= first
        new_doc = new_key | (rows[:, 2:4] != before[:, 2:4]).any(axis=1)
        fresh = new_doc | (rows[:, 4:] != before[:, 4:]).any(axis=1)
        self.last = rows[-1:]
        docs, group, starts = np.cumsum(new_doc), np.cumsum(new_key), np.flatnonzero(new_key)
        ordinal = docs - np.concatenate([[-self.ordinal], docs[starts]])[group]
        ends = np.append(starts, len(rows)) - 1   # last row of each group; group 0 is the one that was open
        enough = np.where(ends >= 0, ordinal[ends], self.ordinal) >= MIN_DOCS - 1
        head = fresh & (group == int(first)) & self.head
        self.head &= bool(group[-1] == int(first))
        decided = ~head & fresh & (ordinal >= 1) & enough[group]
        out = [(OPEN, rows[head]), (DROP, rows[decided])]
        if enough[0]:
            out += [(DROP, part) for part in self.held]
        if len(starts) or enough[0]:
            self.held = []
        if len(starts):
            self.seen = []
        if not self.head:
            tail = ~head & fresh & (group == group[-1])
            if not enough[-1]:
                self.held.append(rows[tail & (ordinal >= 1)])
            for k in range(len(self.seen), MIN_DOCS):
                found = np.flatnonzero(tail & (ordinal == k))
                if not len(found):
                    break
                self.seen.append(rows[found[0]:found[0] + 1])
        self.ordinal = int(ordinal[-1])
        return [(kind, part) for kind, part in out if len(part)]

    def finish(self) -> list[tuple[int, np.ndarray]]:
        """The last group may go on elsewhere: its undecided rows, and witnesses of its first documents."""
        if self.head:
            return []
        return [(kind, np.vstack(parts)) for kind, parts in ((OPEN, [p for p in self.held if len(p)]), (WITNESS, self.seen)) if parts]


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def table(kind, rows):
        cols = [pa.array(rows[:, k].astype(np.int32) if name in ("known", "pos") else rows[:, k]) for k, name in enumerate(ROW)]
        return pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(rows), kind, np.int32))], names=[*ROW, "kind"])

    walk = _Stream()
    for batch in batches:
        if batch.num_rows:
            rows = np.column_stack([c.to_numpy().astype(np.int64) for c in batch.columns])
            for part in walk.take(rows):
                yield table(*part)
    for part in walk.finish():
        yield table(*part)


def dropped_lines(rows: DataFrame) -> DataFrame:
    """(known, doc, f1, f2, pos) of every line that goes; a line of equal rows may come more than once."""
    order = [F.col("h1"), F.col("h2"), F.col("known").desc(), F.col("doc").desc(), F.col("f1"), F.col("f2"), F.col("pos")]
    marks = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stream, _TYPES + ", kind int"), "line_marks")
    place = F.struct("known", "doc")
    edge = marks.where(F.col("kind") != DROP)
    ends = edge.groupBy("h1", "h2").agg(F.min(place).alias("least"), F.max(place).alias("most"))
    between = (edge.join(F.broadcast(ends), ["h1", "h2"])
               .groupBy("h1", "h2").agg(F.max("most").alias("most"),
                                        F.bool_or((place > F.col("least")) & (place < F.col("most"))).alias("many")).where("many"))
    open_rows = (marks.where(F.col("kind") == OPEN).join(F.broadcast(between), ["h1", "h2"]).where(place < F.col("most")))
    names = ROW[2:]
    return marks.where(F.col("kind") == DROP).select(*names).unionByName(open_rows.select(*names))


def keep_bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(known, doc, f1, f2, n_dropped, keep) of every row that loses a line.

    ``keep`` is a zlib-compressed bitmap, first line first: a set bit keeps the line, lines beyond the last bit stay.
    """
    small_batches(df.sparkSession)
    rows = materialize(line_rows(df, id_col, text_col, min_chars), "line_rows")
    gone = dropped_lines(rows).groupBy("known", "doc", "f1", "f2").agg(F.collect_set("pos").alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps, counts = [], []
            for positions in batch.column(4):
                at = positions.values.to_numpy()
                bits = np.ones((int(at.max()) // 8 + 1) * 8, np.uint8)
                bits[at] = 0
                maps.append(zlib.compress(np.packbits(bits).tobytes()))
                counts.append(len(at))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(counts, pa.int64()), pa.array(maps, pa.binary())],
                                             names=["known", "doc", "f1", "f2", "n_dropped", "keep"])

    return gone.mapInArrow(run, "known int, doc long, f1 long, f2 long, n_dropped long, keep binary")


def apply_bitmaps(df: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(id, ``keep`` columns, ``n_lines``, ``n_dropped``, ``kept`` text): each text without the lines its bitmap drops.

    Texts travel to their bitmaps compressed (zstd).
    """
    names = [id_col, *keep]
    plain = [F.col(c).alias(f"c{i}") for i, c in enumerate(names)]
    own = df.select(*plain, *_identity(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    fields = [(f"c{i}", df.schema[c].dataType.simpleString()) for i, c in enumerate(names)]
    carried = ", ".join(f"{n} {t}" for n, t in fields)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array((squeeze(t.as_buffer()) for t in batch.column(batch.num_columns - 1)), pa.binary())],
                                             names=[*batch.schema.names[:-1], "packed"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        width = len(names)

        def table(part, lines, texts):
            return pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(lines, pa.int64()), part.column(width).fill_null(0),
                                               pa.array(texts, pa.binary()).cast(pa.string())],
                                              names=[*part.schema.names[:width], "n_lines", "n_dropped", "kept"])

        for batch in batches:
            first, lines, texts, held = 0, [], [], 0
            for i, (packed, bitmap) in enumerate(zip(batch.column(width + 1), batch.column(width + 2))):
                data = expand(packed.as_buffer()) if len(packed.as_buffer()) else b""
                if bitmap.is_valid:
                    own_lines = data.split(b"\n")
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap.as_py()), np.uint8))
                    lines.append(len(own_lines))
                    data = b"\n".join([x for k, x in enumerate(own_lines) if k >= len(bits) or bits[k]])
                else:
                    lines.append(data.count(b"\n") + 1)
                texts.append(data)
                held += len(data)
                if held >= BYTES:
                    yield table(batch.slice(first, i + 1 - first), lines, texts)
                    first, lines, texts, held = i + 1, [], [], 0
            if texts:
                yield table(batch.slice(first), lines, texts)

    packed = own.mapInArrow(pack, f"{carried}, known int, doc long, f1 long, f2 long, packed binary")
    joined = packed.join(bitmaps, ["known", "doc", "f1", "f2"], "left").select(*[n for n, _ in fields], "n_dropped", "packed", F.col("keep").alias("bitmap"))
    out = joined.mapInArrow(cut, f"{carried}, n_lines long, n_dropped long, kept string")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "n_lines", "n_dropped", "kept")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, ``keep`` columns, ``n_lines``, ``n_dropped``, ``kept`` text) of every row.

    A key of ``min_chars`` characters or more that three documents hold loses all its lines but those in the document with
    the largest id. Lines are what lies between line feeds; a null or empty text is one empty line. Rows that share an id are
    one document: they lose or keep a line together, each at its own places. Rows without an id together are one document that
    comes before all others. Ids are whole numbers. An empty table gives an empty one. Columns outside ``keep`` are left
    out, so their names cannot clash.
    """
    bitmaps = materialize(keep_bitmaps(df, id_col, text_col, min_chars), "line_bitmaps")
    return apply_bitmaps(df, bitmaps, id_col, text_col, keep)
