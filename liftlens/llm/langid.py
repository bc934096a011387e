"""Language of a text as a mixture of languages.

Each language has a model of letter trigrams (a letter with its neighbours; what is no letter counts as an edge), hashed
to a fixed number of places. A word's likelihood in a language is the product over its letters. For each text
expectation-maximisation finds the proportions of languages that its words are drawn from; the set of languages is then
chosen by penalised likelihood, so that most texts end up with one. Prediction is a narrow pass with a small broadcast
table; training adds up counts of a bounded, documented sample of labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACES = 1 << 16
#: Texts of each language that the model is fitted on (expected number, picked by hash), and the most languages.
TEXTS_A_LANGUAGE, MAX_LANGUAGES = 3000, 500
SMOOTH, ROUNDS, MOST = 0.1, 12, 4
#: Characters handled together; longer texts are taken in pieces that end at a space where there is one.
PIECE = 1 << 19
UNKNOWN = "und"


def letters() -> np.ndarray:
    """Which code points are letters."""
    out = np.zeros(0x110000, bool)
    out[:0x32000] = [chr(c).isalpha() for c in range(0x32000)]
    return out


def pieces(texts: Sequence[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """(numbers of the texts, lower-case parts) of about ``PIECE`` characters together."""
    rows, parts, size = [], [], 0
    for row, text in enumerate(texts):
        text = (text or "").lower()
        at = 0
        while at < len(text):
            stop = at + PIECE
            if stop < len(text):
                stop = max(text.rfind(" ", at, stop) + 1, 0) or stop
            rows.append(row)
            parts.append(text[at:stop])
            size += stop - at
            at = stop
            if size >= PIECE:
                yield rows, parts
                rows, parts, size = [], [], 0
    if rows:
        yield rows, parts


def trigrams(parts: Sequence[str], letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each letter's trigram, where words begin among them, part of each word)."""
    codes = np.frombuffer(("\n" + "\n".join(parts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(letter[np.minimum(codes, 0x10FFFF)], codes, 0).astype(np.uint64)
    at = np.flatnonzero(codes)
    with np.errstate(over="ignore"):
        h = ((codes[at - 1] * np.uint64(0x9E3779B97F4A7C15) + codes[at]) * np.uint64(0xC2B2AE3D27D4EB4F) + codes[at + 1]) * np.uint64(0x165667B19E3779F9)
    place = ((h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64)
    begin = np.flatnonzero(codes[at - 1] == 0)
    ends = np.cumsum([len(p) + 1 for p in parts])
    return place, begin, np.searchsorted(ends, at[begin] - 1, "right")


def learn(df: DataFrame, lang_col: str, text_col: str, id_col: str) -> tuple[list[str], np.ndarray]:
    """(languages in order, log probability of each place in each of them as places x languages)."""
    labelled = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    found = {r["lang"]: r["n"] for r in labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n"))
             .limit(MAX_LANGUAGES + 1).collect()}
    if len(found) > MAX_LANGUAGES:
        raise ValueError("more languages than the model has room for")
    names = sorted(found)
    if not names:
        return [], np.zeros((PLACES, 0), np.float32)
    rate = F.lit(0)
    for name in names:
        rate = F.when(F.col(lang_col) == name, int(1_000_000 * min(1.0, TEXTS_A_LANGUAGE / found[name]))).otherwise(rate)
    sample = labelled.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(1_000_000)) < rate).select(lang_col, text_col)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = letters()
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for rows, parts in pieces(batch.column(1).to_pylist()):
                for name in sorted({langs[r] for r in rows}):
                    place, _, _ = trigrams([p for r, p in zip(rows, parts) if langs[r] == name], letter)
                    place, n = np.unique(place, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(place), pa.string()), pa.array(place), pa.array(n, pa.int64())],
                                                     names=["lang", "place", "n"])

    sums = sample.mapInArrow(counted, "lang string, place long, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((PLACES, len(names)))
    column = {name: i for i, name in enumerate(names)}
    counts[sums["place"].to_numpy(), [column[x] for x in sums["lang"].to_pylist()]] = sums["n"].to_numpy()
    return names, np.log((counts + SMOOTH) / (counts.sum(0) + SMOOTH * PLACES)).astype(np.float32)


def expect(like: np.ndarray, begin: np.ndarray, of: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log likelihood) of each text by expectation-maximisation over the languages that ``allowed`` names.

    ``like`` is words x languages; the words of text i are those from ``begin[i]`` on, ``of`` is each word's text.
    """
    n = np.diff(np.append(begin, len(like)))[:, None]
    share = allowed / allowed.sum(1, keepdims=True)
    for _ in range(ROUNDS):
        part = like * share[of]
        part /= part.sum(1, keepdims=True)
        share = np.add.reduceat(part, begin, axis=0) / n
    return share, np.add.reduceat(np.log((like * share[of]).sum(1)), begin)


def choose(logs: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language, proportion) of each text 0, 1, ...; ``logs`` is words x languages, ``of`` each word's text, ascending.

    The languages are ordered by their proportions in the full mixture; of the sets of the first one, two, ... up to
    ``MOST`` of them, the one with the highest likelihood less ``log(words) / 2`` for each further language is taken.
    """
    top = logs.max(1, keepdims=True)
    like = np.exp(np.maximum(logs - top, -60.0)).astype(np.float64)
    begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    words = np.diff(np.append(begin, len(of)))
    share, full = expect(like, begin, of, np.ones((len(begin), logs.shape[1])))
    single = np.add.reduceat(np.maximum(logs - top, -60.0), begin, axis=0)
    best, weight = single.argmax(1), np.ones(len(begin))
    value, penalty = single.max(1).astype(np.float64), 0.5 * np.log(words)
    open_ = np.flatnonzero(full - penalty > value)
    rank = np.argsort(-share, axis=1, kind="stable")
    for size in range(2, min(MOST, logs.shape[1]) + 1):
        if not len(open_):
            break
        rows = np.isin(of, open_)
        allowed = np.zeros((len(open_), logs.shape[1]))
        np.put_along_axis(allowed, rank[open_, :size], 1.0, axis=1)
        own = np.searchsorted(open_, of[rows])
        start = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        part, reached = expect(like[rows], start, own, allowed)
        gain = reached - (size - 1) * penalty[open_]
        better = gain > value[open_]
        at = open_[better]
        value[at], best[at] = gain[better], part[better].argmax(1)
        weight[at] = part[better].max(1)
    return best, weight


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text",
            keep: Sequence[Column] = ()) -> DataFrame:
    """(id, ``keep`` columns, ``lang_pred``, ``score``) of every row; the score is the proportion of the language.

    ``und`` with score 0 where the text is null or has no letter, or where nothing could be learned. Row by row, so null ids
    and repeated rows stay as they are; other columns are left out.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    chosen = df.select(id_col, *keep, text_col)
    kept = chosen.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (names, table), letter = shared.value, letters()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            logs, owner = [], []

            def settle() -> None:
                if logs and names:
                    of = np.concatenate(owner)
                    row, own = np.unique(of, return_inverse=True)
                    best, weight = choose(np.concatenate(logs), own)
                    score[row] = weight
                    for r, b in zip(row.tolist(), best.tolist()):
                        lang[r] = names[b]

            for rows, parts in pieces(texts):
                place, begin, part = trigrams(parts, letter)
                row = np.array(rows)[part]
                if owner and len(rows) and rows[0] != owner[-1][-1]:
                    settle()
                    logs, owner = [], []
                if len(begin):
                    logs.append(np.add.reduceat(table[place], begin, axis=0))
                    owner.append(row)
            settle()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score)],
                                             names=[*kept, "lang_pred", "score"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[:-1])
    return chosen.mapInArrow(run, f"{ddl}, lang_pred string, score double")


def held_out(id_col: str) -> Column:
    """Rows that are not learned from: crc32 of the id's text, mod 4, is 2. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, ``held_out``, ``lang_pred``, ``score``): learn from the rows that are not held out, predict all by their text."""
    model = learn(df.where(~held_out(id_col)), lang_col, text_col, id_col)
    return predict(df, model, id_col, text_col, (held_out(id_col).alias("held_out"),))
