"""Removal of repeated passages: every word covered by a window of words that also starts elsewhere.

Each window is known by its leader, the least hash among the short n-grams inside it. Equal windows have equal leaders, and
one place of a leader serves a whole run of windows, so leaders are few (a tenth of the windows). A count-min sketch of
leader places, merged from partitions, overestimates how often each occurs; runs whose leader is estimated once cannot be
repeated and are dropped for good. The second pass groups the others by leader and by a hash of the whole run (together
128 bits): a run that occurs twice is repeated in all its windows, one that has its leader for itself in none. Only runs
that share a leader with other runs, and occur once themselves, need their windows; a third pass makes these for their
leaders and groups them exactly, by leader and window hash (together 128 bits). So windows are neither stored nor shuffled
for copies, nor for what the sketch lets through.

Hot passages: equal runs of one batch become one row with their number, and places stay in a table of their own, so the
exact grouping sees at most one row of a run for some ten thousands of places. Texts travel compressed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftlens.llm import sketch, words
from liftlens.session import materialize, small_batches

WINDOW, LEADER = 35, 18
SEED, LEADER_MULTIPLIER, WINDOW_MULTIPLIER = 6, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
#: Suspect places that a task holds before it sends them off.
HELD = 50_000
#: About so many bytes of text for each leader place, to size the sketch.
BYTES_A_PLACE = 60


def runs(chunk: words.Chunk, window: int, leader: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leader hash, first window, end of windows) of each run of windows with one leader place; places count words of the chunk.

    The leader of a window is the leftmost of its least n-grams, so its place depends on the window's words only. Least hashes
    are small numbers, so they are scrambled again: a sketch takes its cells from the upper bits.
    """
    least = words.grams(chunk.words, leader, LEADER_MULTIPLIER)
    n, span = len(chunk.words) - window + 1, window - leader + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    place, width = np.arange(len(least)), 1
    while width < span:
        step = min(width, span - width)
        left, right = place[:-step], place[step:]
        place = np.where(least[left] <= least[right], left, right)
        width += step
    fit = np.flatnonzero(words.whole(chunk, window, n))
    if not len(fit):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    at = place[fit]
    cut = np.flatnonzero((np.diff(at) != 0) | (np.diff(fit) != 1)) + 1
    begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(fit)]])
    return words.mix(least[at[begin]]), fit[begin], fit[end - 1] + 1


def contents(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each run's words; its first and last window overlap, so the two stand for the whole run."""
    return words.mix(words.mix(hashes[begin]) + hashes[end - 1])


def suspects(df: DataFrame, id_col: str, text_col: str, window: int, leader: int) -> DataFrame:
    """Runs whose leader is estimated repeated: (``run``, ``leader``, ``content``, number of windows as ``width``, and the
    places ``ids``, ``keys``, ``starts``)."""
    spark = df.sparkSession
    small_batches(spark)
    texts = df.select(text_col)
    cells = sketch.cells_for(sketch.text_bytes(texts, text_col) // BYTES_A_PLACE)

    def items(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for chunk in words.chunks(batch.column(0), words.Hasher(SEED, False)):
            yield runs(chunk, window, leader)[0]

    seen = spark.sparkContext.broadcast(sketch.count(texts, items, cells, (2,)))

    def table(batch: pa.RecordBatch, rows: dict[tuple[int, int, int], list[tuple[int, int]]]) -> pa.RecordBatch:
        of = np.fromiter((t for places in rows.values() for t, _ in places), np.int64)
        starts = pa.array([s for places in rows.values() for _, s in places], pa.int32())
        ends = pa.array(np.cumsum([0] + [len(places) for places in rows.values()], dtype=np.int32))
        listed = lambda values: pa.ListArray.from_arrays(ends, values)
        return pa.RecordBatch.from_arrays(
            [*(pa.array(np.array([r[k] for r in rows], np.uint64).view(np.int64)) for k in (0, 1)), pa.array([r[2] for r in rows], pa.int32()),
             listed(batch.column(0).take(pa.array(of))), listed(batch.column(1).take(pa.array(of))), listed(starts)],
            names=["leader", "content", "width", "ids", "keys", "starts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = words.Hasher(SEED, False)
        for batch in batches:
            rows: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
            held = 0
            for chunk in words.chunks(batch.column(2), hasher):
                lead, begin, end = runs(chunk, window, leader)
                keep = np.flatnonzero(seen.value.reached(lead))
                if not len(keep):
                    continue
                lead, begin, end = lead[keep], begin[keep], end[keep]
                content = contents(words.grams(chunk.words, window, WINDOW_MULTIPLIER), begin, end)
                text = np.searchsorted(chunk.ends, begin, "right")
                start = begin - chunk.begins[text]
                for value, own, width, t, s in zip(lead.tolist(), content.tolist(), (end - begin).tolist(),
                                                   (text + chunk.first).tolist(), start.tolist()):
                    rows.setdefault((value, own, width), []).append((t, s))
                held += len(keep)
                if held >= HELD:
                    yield table(batch, rows)
                    rows, held = {}, 0
            if rows:
                yield table(batch, rows)

    kind = df.schema[id_col].dataType.simpleString()
    made = df.select(id_col, F.xxhash64(text_col).alias("key"), text_col).mapInArrow(
        run, f"leader long, content long, width int, ids array<{kind}>, keys array<long>, starts array<int>")
    return materialize(made.select(F.monotonically_increasing_id().alias("run"), "*"), "substring_runs")


def judged(found: DataFrame) -> DataFrame:
    """Runs that may be repeated: (``run``, ``mask``) of those that occur twice or more as a whole, (``run``, ``leader``,
    ``content``) of those that occur once but share their leader with others."""
    by_leader, by_content = Window.partitionBy("leader"), Window.partitionBy("leader", "content")
    counted = found.select("run", "leader", "content", "width", F.cardinality("starts").alias("n")).repartition("leader").select(
        "*", F.sum("n").over(by_content).alias("total"), F.min("content").over(by_leader).alias("low"),
        F.max("content").over(by_leader).alias("high"))
    once = F.col("total") == 1
    return materialize(counted.where("total > 1 OR low < high").select(
        "run", F.when(once, F.col("leader")).alias("leader"), F.when(once, F.col("content")).alias("content"),
        F.when(~once, F.expr("shiftleft(1L, width) - 1")).alias("mask")), "substring_judged")


def windows_of(texts: DataFrame, leaders: DataFrame, window: int, leader: int) -> DataFrame:
    """(``leader``, ``content``, hashes of the ``windows``) of all runs with one of the ``leaders``, and some with another one.

    A run comes once for each batch that holds it. ``texts`` and ``leaders`` have one column each.
    """
    def items(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)

    wanted = texts.sparkSession.sparkContext.broadcast(sketch.count(leaders, items, sketch.cells_for(leaders.count() * 4), (1,)))

    def table(rows: dict[tuple[int, int], bytes]) -> pa.RecordBatch:
        widths = pa.array(np.cumsum([0] + [len(w) // 8 for w in rows.values()], dtype=np.int32))
        return pa.RecordBatch.from_arrays(
            [*(pa.array(np.array([r[k] for r in rows], np.uint64).view(np.int64)) for k in (0, 1)),
             pa.ListArray.from_arrays(widths, pa.array(np.frombuffer(b"".join(rows.values()), np.int64)))],
            names=["leader", "content", "windows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = words.Hasher(SEED, False)
        for batch in batches:
            rows: dict[tuple[int, int], bytes] = {}
            for chunk in words.chunks(batch.column(0), hasher):
                lead, begin, end = runs(chunk, window, leader)
                keep = np.flatnonzero(wanted.value.reached(lead))
                if not len(keep):
                    continue
                lead, begin, end = lead[keep], begin[keep], end[keep]
                hashes = words.grams(chunk.words, window, WINDOW_MULTIPLIER)
                for value, own, a, b in zip(lead.tolist(), contents(hashes, begin, end).tolist(), begin.tolist(), end.tolist()):
                    if (value, own) not in rows:
                        rows[value, own] = hashes[a:b].tobytes()
                if len(rows) >= HELD:
                    yield table(rows)
                    rows = {}
            if rows:
                yield table(rows)

    return texts.mapInArrow(run, "leader long, content long, windows array<long>")


def repeated(found: DataFrame, texts: DataFrame, window: int, leader: int) -> DataFrame:
    """(``run``, ``mask``): bit i is set when window i of the run occurs twice or more in all places together."""
    known = judged(found)
    unsettled = known.where("mask IS NULL").select("run", "leader", "content")
    each = windows_of(texts, unsettled.select("leader"), window, leader).repartition("leader").select(
        "leader", "content", F.posexplode("windows").alias("at", "window"))
    by_window = Window.partitionBy("leader", "window")
    shared = each.select("*", F.min("content").over(by_window).alias("low"), F.max("content").over(by_window).alias("high"))
    masks = shared.where("low < high").groupBy("leader", "content").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("mask"))
    return known.where("mask IS NOT NULL").select("run", "mask").unionByName(
        unsettled.join(masks, ["leader", "content"]).select("run", "mask"))


def packed(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with the text column compressed (zstd) as ``_text``, for its way to the marks."""
    kept = [c for c in df.columns if c != text_col]
    schema = df.select(*kept).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = (b"" if t is None else pack(t.encode()) for t in batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.binary())], names=[*kept, "_text"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return df.select(*kept, text_col).mapInArrow(run, f"{ddl}, _text binary")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), window: int = WINDOW,
          verbatim: bool = False) -> DataFrame:
    """(id, ``keep`` columns, ``n_words``, ``n_removed``, ``kept`` text) of every row.

    ``kept`` has the words that are left, joined by one space; with ``verbatim``, a text that loses none stays as it is.
    Windows are judged on the input; a window that starts twice in one text, or in two equal rows, is repeated too. Null,
    empty and short texts have no window and lose nothing (a null text becomes an empty one); null ids are allowed.
    Columns that are not in ``keep`` are left out; put ones with clashing names into a struct.
    """
    found = suspects(df, id_col, text_col, window, LEADER)
    places = (found.join(repeated(found, df.select(text_col), window, LEADER), "run")
              .select("mask", F.explode(F.arrays_zip("ids", "keys", "starts")).alias("p"))
              .groupBy(F.col("p.ids").alias("at_id"), F.col("p.keys").alias("at_key"))
              .agg(F.collect_list(F.struct(F.col("p.starts").alias("start"), "mask")).alias("marks")))
    names = [id_col, *keep]
    docs = packed(df.select(*names, F.xxhash64(text_col).alias("_key"), F.col(text_col).alias("_plain")), "_plain")
    marked = docs.join(places, F.col(id_col).eqNullSafe(F.col("at_id")) & (F.col("_key") == F.col("at_key")), "left").select(
        *names, "_text", F.col("marks.start").alias("_starts"), F.col("marks.mask").alias("_masks"))
    schema = docs.select(*names).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                text, starts, masks = (part.column(part.num_columns - k) for k in (3, 2, 1))
                total, removed, kept = [], [], []
                for t, s, m in zip(text, starts, masks):
                    data = unpack(t.as_buffer()) if len(t.as_buffer()) else b""
                    own = data.split()
                    total.append(len(own))
                    if s.is_valid:
                        gone = covered(s.values.to_numpy(), m.values.to_numpy(), len(own), window)
                        own = [own[i] for i in np.flatnonzero(~gone).tolist()]
                    removed.append(total[-1] - len(own))
                    kept.append(data if verbatim and not removed[-1] else b" ".join(own))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-3], pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(kept, pa.binary()).cast(pa.string())], names=[*names, "n_words", "n_removed", "kept"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return marked.mapInArrow(run, f"{ddl}, n_words long, n_removed long, kept string")


def covered(starts: np.ndarray, masks: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of n words lie in a window whose bit is set; ``starts`` are the first windows of the runs."""
    edges = np.zeros(n + 1, np.int64)
    for bit in range(int(masks.max()).bit_length()):
        at = starts[(masks >> bit) & 1 == 1] + bit
        np.add.at(edges, at, 1)
        np.add.at(edges, np.minimum(at + window, n), -1)
    return np.cumsum(edges[:n]) > 0
