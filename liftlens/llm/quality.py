"""Quality rules by weak supervision.

Each rule votes good, bad or abstains on a document. Expectation-maximisation over the counts of vote patterns estimates
how often each rule is right, without labels, and a document's posterior probability of being good replaces the demand
that it pass every rule. All text work is column expressions in one narrow pass; what is brought together are the counts
of vote patterns, at most 3 to the number of rules.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftlens.session import materialize

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Starting values: the share of good documents and the log odds that a vote adds for good.
SHARE, START = 0.8, {"+": 0.3, "0": 0.0, "-": -2.3}
#: Bounds of what one vote adds: a rule that does not object says little, and none decides alone against the others.
BOUNDS = {"+": (0.0, 0.7), "0": (-0.7, 0.7), "-": (-3.5, 0.0)}
SHARE_RANGE = (0.05, 0.995)
ROUNDS, TOLERANCE = 200, 1e-9


@dataclass(frozen=True)
class Rule:
    """``bad`` and ``good`` are SQL conditions over the counts; where neither holds, the rule abstains.

    Rules that look for one defect only never vote good: its absence says nothing of other defects.
    """

    name: str
    bad: str
    good: str = "false"


RULES = [
    Rule("length", "n_words < 15", "n_words >= 30"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 14 * n_words",
         "word_chars BETWEEN 3 * n_words AND 12 * n_words"),
    Rule("letters", "10 * n_letters < 8 * word_chars", "10 * n_letters >= 9 * word_chars AND n_letters > 0"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("many_symbols", "2 * n_symbols > n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("capitals", "10 * n_upper > 4 * n_letters"),
    Rule("exclamations", "10 * n_bangs > 3 * n_words"),
]


def _left(text: Column, chars: str) -> Column:
    """Number of code points of ``text`` that are in the character class ``chars``."""
    return F.char_length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def measure(df: DataFrame, text_col: str, keep: Sequence[str]) -> DataFrame:
    """The ``keep`` columns and the counts of every whole text; a null text counts as an empty one.

    Windows that occur twice are looked for by hash first. Only where two hashes agree, the windows themselves are
    sorted with their places, which settles it exactly.
    """
    base = df.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    split = base.select(
        *keep, "_text", F.array_remove(F.split("_text", SPACE, -1), "").alias("_words"),
        F.filter(F.split("_text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    last = F.size("_words") - (WINDOW - 1)
    sized = split.select(
        *keep, "_words", F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("_text", SPACE, "")).cast("long").alias("word_chars"),
        _left(F.col("_text"), "#*$%&|<>").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _left(F.col("_text"), r"\p{Lu}").alias("n_upper"), _left(F.col("_text"), r"\p{L}").alias("n_letters"),
        _left(F.col("_text"), "!").alias("n_bangs"),
        F.when(last > 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice("_words", i, WINDOW))))
        .alias("_hashes"))
    suspect = sized.withColumn("_windows", F.when(
        F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
        F.sort_array(F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(
            F.array_join(F.slice("_words", i, WINDOW), " ").alias("window"), i.alias("place"))))))
    placed = suspect.withColumn("_places", F.sort_array(F.transform(
        F.filter("_windows", lambda x, i: (x["window"] == F.get("_windows", i - 1)["window"])
                 | (x["window"] == F.get("_windows", i + 1)["window"])), lambda x: x["place"])))
    covered = F.aggregate(
        F.transform("_places", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_places", i + 1) - p, F.lit(WINDOW)))),
        F.lit(0), lambda total, x: total + x)
    return placed.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop(
        "_words", "_hashes", "_windows", "_places")


def votes(rules: Sequence[Rule]) -> Column:
    """One character for each rule: ``+``, ``-`` or ``0``."""
    return F.concat(*[F.when(F.expr(r.bad), "-").when(F.expr(r.good), "+").otherwise("0") for r in rules])


def _within(value: float, bounds: tuple[float, float]) -> float:
    return min(max(value, bounds[0]), bounds[1])


def estimate(patterns: dict[str, int]) -> tuple[float, list[dict[str, float]]]:
    """(share of good documents, log odds for good of each vote of each rule) from vote patterns.

    ``patterns`` holds the count of each pattern; they are taken in sorted order, so that reruns give the same numbers.
    The log odds stand for a rule's accuracy: how often it votes so on good documents against on bad ones. Without
    documents the starting values are returned.
    """
    rows = sorted(patterns.items())
    width = len(rows[0][0]) if rows else 0
    share, adds = SHARE, [dict(START) for _ in range(width)]
    total = sum(n for _, n in rows)
    for _ in range(ROUNDS if total else 0):
        good, cast = 0.0, [{v: [0.5, 0.5] for v in "+0-"} for _ in range(width)]
        for pattern, n in rows:
            p = posterior(pattern, share, adds)
            good += n * p
            for j, vote in enumerate(pattern):
                cast[j][vote][0] += n * p
                cast[j][vote][1] += n * (1 - p)
        new_share = _within(good / total, SHARE_RANGE)
        new = [{v: _within(math.log(c[v][0] / (good + 1.5)) - math.log(c[v][1] / (total - good + 1.5)), BOUNDS[v])
                for v in "+0-"} for c in cast]
        moved = max([abs(new_share - share), *(abs(a[v] - b[v]) for a, b in zip(new, adds) for v in "+0-")])
        share, adds = new_share, new
        if moved < TOLERANCE:
            break
    return share, adds


def posterior(pattern: str, share: float, adds: Sequence[dict[str, float]]) -> float:
    return 1 / (1 + math.exp(-math.log(share / (1 - share)) - sum(a[v] for v, a in zip(pattern, adds))))


def score(df: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",), rules: Sequence[Rule] = RULES,
          threshold: float = 0.5) -> DataFrame:
    """The ``keep`` columns, the counts, ``base_failed``, ``quality`` (posterior) and ``kept`` of every row.

    Row by row but for the estimates, so null ids and repeated rows stay as they are. Null, empty and word-less texts
    have fewer than ten words and fail; an empty table gives no rows; columns that are not in ``keep`` are left out.
    Names of ``keep`` must differ from the counts; put clashing ones into a struct.
    """
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    counted = materialize(measure(df, text_col, keep).select(
        *keep, *COUNTS, failed.alias("base_failed"), votes(rules).alias("votes")), "quality_votes")
    patterns = {r["votes"]: r["n"] for r in counted.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    share, adds = estimate(patterns)
    odds = F.lit(math.log(share / (1 - share)))
    for j, of in enumerate(adds):
        vote = F.substring("votes", j + 1, 1)
        odds = odds + F.when(vote == "+", of["+"]).when(vote == "-", of["-"]).otherwise(of["0"])
    quality = 1 / (1 + F.exp(-odds))
    return counted.select(*keep, *COUNTS, "base_failed", (~F.col("base_failed") & (quality >= threshold)).alias("kept"),
                          quality.alias("quality"))
