"""Language-model scores from a log-frequency Bloom filter in blocks.

Counts of words and word pairs of the training texts are quantised: a count n becomes the level 1 + floor(log_1.5 n), and
the filter holds (n-gram, 1), ..., (n-gram, level). A probe for rising levels until one is missing gives the count back,
never too low. Each unit of texts sends its distinct n-grams, with their counts in training texts, to their blocks; the
block's task builds its part of the filter, with ``BITS_AN_ENTRY`` bits for every entry, and sends back the levels of the
n-grams in the same order. So the filter grows with the corpus, its blocks do not, no part of it is broadcast, and the
rate of errors is the same at any size.

Probabilities are those of a pair model smoothed with the word model: (c(v, w) + mu p(w)) / (c(v) + mu).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftlens.llm import sketch, words
from liftlens.session import materialize, small_batches

SEED, PAIR_MULTIPLIER = 9, 0x9FB21C651E98DF25
#: Marks of a text's end (a token) and beginning (context of its first token).
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
BASE, PROBES, MU, ADD = 1.5, 3, 8.0, 0.1
#: Bits for each (n-gram, level) in the filter: an n-gram that is not there passes a level with p = (1 - e^(-3/20))^3 = 0.0027.
BITS_AN_ENTRY, LEVELS = 20, 100
WORDS_A_BLOCK, MIN_BLOCKS = 400_000, 64
#: Bytes of text (and for each row so many more) whose n-grams are sent together.
UNIT, BYTES_A_ROW = 1 << 23, 64
#: N-grams that a task holds before it counts them and sends the counts off.
HELD = 2_000_000
#: The most frequent words, at most so many, are looked up in a broadcast table; the others by a join.
HEAD = 1 << 20
BYTES_A_WORD = 6
_U = np.uint64


def levels_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64)


def typical_counts() -> np.ndarray:
    """For each level the middle of the counts that have it; level 0 is no occurrence."""
    low = np.ceil(BASE ** np.arange(0, LEVELS) - 1e-9)
    return np.concatenate([[0.0], np.where(low[1:] > low[:-1], (low[:-1] + np.maximum(low[1:] - 1, low[:-1])) / 2, low[:-1])])


def split(keys: np.ndarray, block_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A key's block comes from its first bits, its places there from 40 bits more."""
    block = (keys >> _U(64 - block_bits)).astype(np.int64)
    return block, (keys >> _U(24 - block_bits)) & _U((1 << 40) - 1)


class Filter:
    """Blocked Bloom filter with room for so many entries; ``top`` is the highest level that was entered."""

    def __init__(self, entries: int, blocks: int = MIN_BLOCKS):
        self.block_bits = (blocks - 1).bit_length()
        self.room = max(-(-entries * BITS_AN_ENTRY >> self.block_bits + 3) * 8, 64)
        self.data, self.top = None, LEVELS - 1

    def split(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return split(keys, self.block_bits)

    def places(self, rest: np.ndarray, level: np.ndarray | int, probe: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = words.mix(rest * _U(0x9E3779B97F4A7C15) + _U(PROBES) * np.asarray(level, np.uint64) + _U(probe + 1))
        return (h % _U(self.room)).astype(np.int64)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        return self.found(*self.split(keys))

    def found(self, block: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Level of each key, found by probing level after level up to ``top``."""
        out = np.zeros(len(rest), np.int64)
        left, level = np.arange(len(rest)), 0
        while len(left) and level < self.top:
            level += 1
            for probe in range(PROBES):
                at = block[left] * self.room + self.places(rest[left], level, probe)
                left = left[(self.data[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1]
            out[left] = level
        return out


def block_of(rest: np.ndarray, n: np.ndarray) -> Filter:
    """The filter of one block: distinct ``rest`` with their counts."""
    level = levels_of(n)
    out = Filter(int(level.sum()), 1)
    out.top, bits = int(level.max(initial=0)), np.zeros(out.room, bool)
    for step in range(1, out.top + 1):
        reach = rest[level >= step]
        for probe in range(PROBES):
            bits[out.places(reach, step, probe)] = True
    out.data = np.packbits(bits)
    return out


def five_bytes(rest: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def from_five(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel().astype(np.uint64)


def tokens(chunk: words.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, token before it, text) of all texts of a chunk, each closed by the end mark."""
    token, before = np.insert(chunk.words, chunk.ends, END), np.insert(chunk.words, chunk.begins, START)
    return token, before, np.repeat(np.arange(len(chunk.ends)), chunk.ends - chunk.begins + 1)


def pair_keys(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return words.mix(before * _U(PAIR_MULTIPLIER) + token)


def word_keys(token: np.ndarray) -> np.ndarray:
    return words.mix(token ^ _U(0xA0761D6478BD642F))


def word_counts(texts: DataFrame) -> DataFrame:
    """Exact counts (``word`` hash, ``n``) of all tokens of ``texts``, a table of one text column."""

    def sent_off(parts: list[np.ndarray]) -> pa.RecordBatch:
        word, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n, pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, parts, held = words.Hasher(SEED, True), [], 0
        for chunk in (c for batch in batches for c in words.chunks(batch.column(0), hasher)):
            parts.append(tokens(chunk)[0])
            held += len(parts[-1])
            if held >= HELD:
                yield sent_off(parts)
                parts, held = [], 0
        if parts:
            yield sent_off(parts)

    return materialize(texts.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm_words")


def in_units(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(``unit``, ``at`` in the table's part, id, ``held_out``, ``_text`` compressed) of every row; a unit is some rows that follow one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        first, size, done = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(2).to_pylist()]
            upto = size + np.cumsum([len(t) + BYTES_A_ROW for t in texts], dtype=np.int64)
            size = int(upto[-1]) if len(texts) else size
            yield pa.RecordBatch.from_arrays(
                [pa.array(first + upto // UNIT, pa.int64()), pa.array(done + np.arange(len(texts)), pa.int64()), batch.column(0), batch.column(1), pa.array([pack(t) for t in texts], pa.binary())],
                names=["unit", "at", id_col, "held_out", "_text"])
            done += len(texts)

    kind = df.schema[id_col].dataType.simpleString()
    return materialize(df.select(id_col, held_out(id_col).alias("held_out"), text_col).mapInArrow(
        run, f"unit long, at long, `{id_col}` {kind}, held_out boolean, _text binary"), "lm_units")


def plain(packed: pa.Array) -> pa.Array:
    unpack = zstandard.ZstdDecompressor().decompress
    return pa.array([unpack(t.as_buffer()) if len(t.as_buffer()) else b"" for t in packed], pa.binary())


def ngrams(chunk: words.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(key, text) of all pairs, words and beginnings of a chunk."""
    token, before, text = tokens(chunk)
    begin = before == START
    return (np.concatenate([pair_keys(before, token), word_keys(token), word_keys(before[begin])]),
            np.concatenate([text, text, text[begin]]))


def sent(rows: DataFrame, block_bits: int) -> DataFrame:
    """(``unit``, ``first`` and ``last`` row of the part, ``block``, ``keys``, ``counts`` in training texts, 0 where only others have it)."""

    def packed(unit: int, first: int, last: int, keys: list[np.ndarray], learnt: list[np.ndarray]) -> pa.RecordBatch:
        key, of = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(of, weights=np.concatenate(learnt)).astype(np.int64)
        times = np.maximum((n + 254) // 255, 1)
        key, end = np.repeat(key, times), np.cumsum(times) - 1
        small = np.full(len(key), 255, np.uint8)
        small[end] = n - 255 * (times - 1)
        block, rest = split(key, block_bits)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
        five, spans = five_bytes(rest), list(zip(cuts[:-1], cuts[1:]))
        return pa.RecordBatch.from_arrays(
            [*(pa.array(np.full(len(spans), v), pa.int64()) for v in (unit, first, last)), pa.array(block[cuts[:-1]], pa.int64()),
             pa.array([five[a:b].tobytes() for a, b in spans], pa.binary()),
             pa.array([small[a:b].tobytes() for a, b in spans], pa.binary())],
            names=["unit", "first", "last", "block", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, now, keys, learnt = words.Hasher(SEED, True), None, [], []
        for batch in batches:
            unit, place = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            train = ~batch.column(2).to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(unit) != 0) | (np.diff(place) != 1)) + 1, [len(unit)]])
            for a, b in ((a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if a < b):
                if now is not None and (now[0], now[2] + 1) != (unit[a], place[a]):
                    yield packed(*now, keys, learnt)
                    now, keys, learnt = None, [], []
                now = (int(unit[a]), now[1] if now else int(place[a]), int(place[b - 1]))
                for chunk in words.chunks(plain(batch.column(3).slice(a, b - a)), hasher):
                    key, text = ngrams(chunk)
                    keys.append(key)
                    learnt.append(train[a + chunk.first + text])
        if now is not None:
            yield packed(*now, keys, learnt)

    return rows.select("unit", "at", "held_out", "_text").mapInArrow(
        run, "unit long, first long, last long, block long, keys binary, counts binary")


def answers(rows: DataFrame, block_bits: int) -> DataFrame:
    """(``unit``, ``first``, ``last``, ``block``, ``levels`` of the part's n-grams in order), by the filter of the training texts."""

    def run(group: pa.Table) -> pa.Table:
        keys = [from_five(k) for k in group["keys"].to_pylist()]
        rest, of = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(of, weights=np.frombuffer(b"".join(group["counts"].to_pylist()), np.uint8))
        made = block_of(rest[n > 0], n[n > 0])
        level = made.found(np.zeros(len(rest), np.int64), rest).astype(np.uint8)
        cuts = np.cumsum([0] + [len(k) for k in keys])
        levels = [level[np.unique(of[a:b])].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.table({**{c: group[c] for c in ("unit", "first", "last", "block")}, "levels": pa.array(levels, pa.binary())})

    return sent(rows, block_bits).groupBy("block").applyInArrow(run, "unit long, first long, last long, block long, levels binary")


def frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, counts) of the most frequent words, sorted by hash: whole count classes, at most ``HEAD`` words."""
    group = F.floor(F.log2("n") * 8)
    classes = sorted(((r["c"], r["words"]) for r in counts.groupBy(group.alias("c")).agg(F.count("*").alias("words")).collect()), reverse=True)
    total, least = 0, None
    for c, n in classes:
        total += n
        if total > HEAD:
            break
        least = c
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    head = counts.where(group >= least).toArrow()
    word, n = head["word"].to_numpy().view(np.uint64), head["n"].to_numpy()
    order = np.argsort(word)
    return word[order], n[order]


def held_out(id_col: str) -> Column:
    """Rows that the model does not learn from: crc32 of the id's text, mod 10, is 0. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 10 == 0


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``) of every row.

    Null, empty and word-less texts have one token, their end. Rows are told apart by place, so repeated rows and null ids
    each get a result. Without training texts nothing is known, ``train_tokens`` is 0 and both scores come from the added
    counts alone. Other columns are left out.
    """
    spark = df.sparkSession
    small_batches(spark)
    train = df.where(~held_out(id_col)).select(text_col)
    counts = word_counts(train)
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_all, denominator = total["n"] or 0, (total["n"] or 0) + ADD * (total["v"] + 1)
    shared = spark.sparkContext.broadcast(frequent(counts))
    size = sketch.text_bytes(df, text_col) // BYTES_A_WORD // WORDS_A_BLOCK
    block_bits = (max(size, MIN_BLOCKS) - 1).bit_length()
    units = in_units(df, id_col, text_col)

    def run(own: pa.Table, levels: pa.Table) -> pa.Table:
        known_words, known_counts = shared.value
        hasher, typical, made = words.Hasher(SEED, True), typical_counts(), []
        own, parts = own.sort_by("at").combine_chunks(), {}
        for r in levels.to_pylist():
            parts.setdefault((r["first"], r["last"]), {})[r["block"]] = r["levels"]
        place = own["at"].to_numpy()
        for (first, last), found in parts.items():
            a, b = np.searchsorted(place, [first, last + 1]).tolist()
            batch = own.slice(a, b - a).combine_chunks().to_batches()[0]
            texts = plain(batch.column(4))
            key = np.unique(np.concatenate([ngrams(c)[0] for c in words.chunks(texts, hasher)]) >> _U(24 - block_bits))
            level = np.frombuffer(b"".join(found[k] for k in sorted(found)), np.uint8)
            assert len(key) == len(level)
            count = lambda keys: typical[level[np.searchsorted(key, keys >> _U(24 - block_bits))]]
            for chunk in words.chunks(texts, hasher):
                token, before, text = tokens(chunk)
                size = len(chunk.ends)
                word, of = np.unique(token, return_inverse=True)
                at = np.minimum(np.searchsorted(known_words, word), max(len(known_words) - 1, 0))
                inside = known_words[at] == word if len(known_words) else np.zeros(len(word), bool)
                n = np.where(inside, known_counts[at] if len(known_words) else 0, 0)
                base = np.where(inside, np.log10((n + ADD) / denominator), 0.0)
                single = count(word_keys(word))
                context, back = np.unique(before, return_inverse=True)
                seen_before = count(word_keys(context))
                pair = count(pair_keys(before, token))
                likely = (single[of] + ADD) / denominator
                p = (pair + MU * likely) / (np.maximum(seen_before[back], pair) + MU)
                away = np.flatnonzero(~inside[of])
                where, times = np.unique(np.stack([text[away], of[away]]), axis=1, return_counts=True) if len(away) else (
                    np.empty((2, 0), np.int64), np.empty(0, np.int64))
                ends = pa.array(np.searchsorted(where[0], np.arange(size + 1)).astype(np.int32))
                add = lambda values: pa.array(np.bincount(text, weights=values, minlength=size), pa.float64())
                part = batch.slice(chunk.first, size)
                made.append(pa.RecordBatch.from_arrays(
                    [part.column(2), part.column(3), pa.array(chunk.ends - chunk.begins + 1, pa.int64()),
                     pa.array(np.bincount(text, weights=inside[of], minlength=size).astype(np.int64)), add(base[of]),
                     add(np.minimum(np.log10(p), 0.0)),
                     pa.ListArray.from_arrays(ends, pa.array(word[where[1]].view(np.int64))),
                     pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))],
                    names=[id_col, "held_out", "n_tokens", "known", "base", "score", "words", "times"]))
        return pa.Table.from_batches(made)

    kind = df.schema[id_col].dataType.simpleString()
    scored = units.groupBy("unit").cogroup(answers(units, block_bits).groupBy("unit")).applyInArrow(
        run, f"`{id_col}` {kind}, held_out boolean, n_tokens long, known long, base double, score double, "
             "words array<long>, times array<long>")
    rows = materialize(scored.select(F.monotonically_increasing_id().alias("row"), "*"), "lm_scores")
    rare = (rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("x"))
            .select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times")).join(counts, "word", "left"))
    n = F.coalesce("n", F.lit(0))
    more = rare.groupBy("row").agg(F.sum(F.col("times") * F.log10((n + ADD) / denominator)).alias("more"),
                                   F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more_known"))
    return rows.join(more, "row", "left").select(
        id_col, "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")
