"""License scans by ordered signature rules.

Texts are read as words. A rule has a keyword; a document that passes the keyword prefilter is cut into words, and each
keyword met opens the rules that belong to it, with a pattern for the words from the keyword on and one for the words
before it. Overlapping detections are settled per document: one that lies inside another of the same or a higher
priority is suppressed. All steps are column expressions; the rules (some hundreds, checked) are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from liftlens.session import materialize

BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Every rule, base phrases included, needs one of these somewhere in the raw text.
GATE = r"(?i)licen[cs]e|creative|(?<![a-z0-9])cc(?:0|[^a-z0-9])"
#: Words of context before and from the keyword on.
BEFORE, AFTER = 7, 16
MAX_RULES = 5000
NAME, VERSION, GRANT, TAG = 1, 2, 3, 4
CONFIDENCE = {NAME: 0.7, VERSION: 0.85, GRANT: 0.95, TAG: 1.0}

#: Phrases and labels of the base columns, as fixed by the contract.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]


@dataclass(frozen=True)
class Family:
    """Written by hand: label, keyword, pattern of the name from the keyword on, short tag and known versions."""

    label: str
    keyword: str
    name: str
    tag: str
    versions: tuple[str, ...] = ()


FAMILIES = [
    Family("gpl", "gnu", "gnu (?:general public|gpl) licen[cs]e", "gpl", ("1.0", "2.0", "3.0")),
    Family("lgpl", "gnu", "gnu (?:lesser|library) general public licen[cs]e", "lgpl", ("2.0", "2.1", "3.0")),
    Family("agpl", "gnu", "gnu affero general public licen[cs]e", "agpl", ("1.0", "3.0")),
    Family("gfdl", "gnu", "gnu free documentation licen[cs]e", "gfdl", ("1.1", "1.2", "1.3")),
    Family("apache", "apache", "apache (?:software )?licen[cs]e", "apache", ("1.0", "1.1", "2.0")),
    Family("mit", "mit", "mit licen[cs]e", "mit"),
    Family("x11", "x11", "x11 licen[cs]e", "x11"),
    Family("bsd", "bsd", "bsd (?:style )?licen[cs]e", "bsd"),
    Family("bsd-2-clause", "bsd", "bsd (?:2|two) clause licen[cs]e", "bsd 2 clause"),
    Family("bsd-2-clause", "simplified", "simplified bsd licen[cs]e", "bsd 2 clause freebsd"),
    Family("bsd-3-clause", "bsd", "bsd (?:3|three) clause licen[cs]e", "bsd 3 clause"),
    Family("bsd-3-clause", "modified", "modified bsd licen[cs]e", "bsd 3 clause clear"),
    Family("bsd-4-clause", "bsd", "bsd (?:4|four) clause licen[cs]e", "bsd 4 clause"),
    Family("isc", "isc", "isc licen[cs]e", "isc"),
    Family("0bsd", "zero", "zero clause bsd licen[cs]e", "0bsd"),
    Family("mpl", "mozilla", "mozilla public licen[cs]e", "mpl", ("1.0", "1.1", "2.0")),
    Family("epl", "eclipse", "eclipse public licen[cs]e", "epl", ("1.0", "2.0")),
    Family("edl", "eclipse", "eclipse distribution licen[cs]e", "edl", ("1.0",)),
    Family("cddl", "common", "common development and distribution licen[cs]e", "cddl", ("1.0", "1.1")),
    Family("cpl", "common", "common public licen[cs]e", "cpl", ("1.0",)),
    Family("ipl", "ibm", "ibm public licen[cs]e", "ipl", ("1.0",)),
    Family("eupl", "european", "european union public licen[cs]e", "eupl", ("1.0", "1.1", "1.2")),
    Family("cecill", "cecill", "cecill (?:free software )?licen[cs]e", "cecill", ("1.0", "1.1", "2.0", "2.1")),
    Family("artistic", "artistic", "artistic licen[cs]e", "artistic", ("1.0", "2.0")),
    Family("bsl", "boost", "boost software licen[cs]e", "bsl", ("1.0",)),
    Family("zlib", "zlib", "zlib (?:libpng )?licen[cs]e", "zlib"),
    Family("libpng", "libpng", "libpng licen[cs]e", "libpng", ("2.0",)),
    Family("ofl", "sil", "sil open font licen[cs]e", "ofl", ("1.0", "1.1")),
    Family("ms-pl", "microsoft", "microsoft public licen[cs]e", "ms pl"),
    Family("ms-rl", "microsoft", "microsoft reciprocal licen[cs]e", "ms rl"),
    Family("psf", "python", "python software foundation licen[cs]e", "psf", ("2.0",)),
    Family("python", "python", "python licen[cs]e", "python", ("2.0",)),
    Family("php", "php", "php licen[cs]e", "php", ("3.0", "3.01")),
    Family("ruby", "ruby", "ruby licen[cs]e", "ruby"),
    Family("perl", "perl", "perl licen[cs]e", "perl"),
    Family("postgresql", "postgresql", "postgresql licen[cs]e", "postgresql"),
    Family("openssl", "openssl", "openssl licen[cs]e", "openssl"),
    Family("w3c", "w3c", "w3c (?:software|document) (?:notice and )?licen[cs]e", "w3c"),
    Family("osl", "open", "open software licen[cs]e", "osl", ("1.0", "1.1", "2.0", "2.1", "3.0")),
    Family("afl", "academic", "academic free licen[cs]e", "afl", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    Family("rpl", "reciprocal", "reciprocal public licen[cs]e", "rpl", ("1.1", "1.5")),
    Family("apsl", "apple", "apple public source licen[cs]e", "apsl", ("1.0", "1.1", "1.2", "2.0")),
    Family("ncsa", "ncsa", "ncsa open source licen[cs]e", "ncsa"),
    Family("ecl", "educational", "educational community licen[cs]e", "ecl", ("1.0", "2.0")),
    Family("sspl", "server", "server side public licen[cs]e", "sspl", ("1.0",)),
    Family("busl", "business", "business source licen[cs]e", "busl", ("1.0", "1.1")),
    Family("elastic", "elastic", "elastic licen[cs]e", "elastic", ("2.0",)),
    Family("unlicense", "unlicense", "unlicense", "unlicense"),
    Family("vim", "vim", "vim licen[cs]e", "vim"),
    Family("tcl", "tcl", "tcl tk licen[cs]e", "tcl"),
    Family("upl", "universal", "universal permissive licen[cs]e", "upl", ("1.0",)),
    Family("lppl", "latex", "latex project public licen[cs]e", "lppl", ("1.0", "1.1", "1.2", "1.3")),
    Family("qpl", "q", "q public licen[cs]e", "qpl", ("1.0",)),
    Family("cern-ohl", "cern", "cern open hardware licen[cs]e", "cern ohl", ("1.1", "1.2", "2.0")),
    Family("odbl", "open", "open (?:data commons )?(?:open )?database licen[cs]e", "odbl", ("1.0",)),
    Family("odc-by", "open", "open data commons attribution licen[cs]e", "odc by", ("1.0",)),
    Family("cc0", "cc0", "cc0", "cc0", ("1.0",)),
    Family("cc-by", "cc", "cc by", "cc by", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    Family("cc-by-sa", "cc", "cc by sa", "cc by sa", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    Family("cc-by-nd", "cc", "cc by nd", "cc by nd", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    Family("cc-by-nc", "cc", "cc by nc", "cc by nc", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    Family("cc-by-nc-sa", "cc", "cc by nc sa", "cc by nc sa", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    Family("cc-by-nc-nd", "cc", "cc by nc nd", "cc by nc nd", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    Family("cc-by", "creative", "creative commons attribution", "creative commons by", ("2.0", "3.0", "4.0")),
    Family("cc-by-sa", "creative", "creative commons attribution share ?alike", "creative commons by sa", ("2.0", "3.0", "4.0")),
    Family("cc-by-nc", "creative", "creative commons attribution non ?commercial", "creative commons by nc", ("2.0", "3.0", "4.0")),
    Family("cc-by-nd", "creative", "creative commons attribution no ?deriv(?:s|atives)", "creative commons by nd",
           ("2.0", "3.0", "4.0")),
]

GRANTED = ("(?:licensed|released|distributed|available|provided|published|covered) (?:under|by|subject to) "
           "(?:the )?(?:terms (?:and conditions )?of )?(?:the )?$")


def rules() -> list[dict]:
    """The signature rules: for each family its name, its name as a grant, its tag, and name and tag with each version."""
    end, found = "(?= |$)", []
    for f in FAMILIES:
        of = lambda label, right, priority, left="", keyword=f.keyword: found.append(
            {"label": label, "keyword": keyword, "right": f"^{right}{end}", "left": left, "priority": priority})
        of(f.label, f.name, NAME)
        of(f.label, f.name, GRANT, GRANTED)
        of(f.label, f"spdx licen[cs]e identifier {f.tag}(?: only| or later)?", TAG, keyword="spdx")
        for version in f.versions:
            whole, words = version.removesuffix(".0"), version.replace(".", " ")
            number = f"(?:{words}|{whole})" if "." not in whole else words
            of(f"{f.label}-{version}", f"{f.name}(?: version)? v?{number}(?: or (?:any )?later(?: version)?)?", VERSION)
            of(f"{f.label}-{version}", f"spdx licen[cs]e identifier {f.tag} {words}(?: only| or later)?", TAG, keyword="spdx")
    return found


def rule_table(spark: SparkSession, found: Sequence[dict]) -> DataFrame:
    """The rules as a table, in order; ``base`` marks the phrases of the base columns."""
    if len(found) > MAX_RULES:
        raise ValueError("too many rules to be broadcast")
    rows = [dict(r, base=False) for r in found] + [
        {"label": label, "keyword": phrase.split()[0], "right": f"^{phrase}(?= |$)", "left": "", "priority": NAME, "base": True}
        for phrase, label in BASE]
    cells = [F.struct(F.lit(i).alias("rule"), F.lit(r["label"]).alias("label"), F.lit(r["keyword"]).alias("keyword"),
                      F.lit(r["right"]).alias("right"), F.lit(r["left"]).alias("left"),
                      F.lit(r["priority"]).alias("priority"), F.lit(CONFIDENCE[r["priority"]]).alias("confidence"),
                      F.lit(r["base"]).alias("base")) for i, r in enumerate(rows)]
    return spark.range(1).select(F.inline(F.array(*cells)))


def cut(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(``row``, id, ``n_words``, ``words``): words only of the documents that pass the prefilter."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    pieces = lambda t: F.array_remove(F.split(t, BREAK, -1), "")
    return df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col),
                     F.size(pieces(text)).cast("long").alias("n_words"),
                     F.when(text.rlike(GATE), pieces(F.translate(text, UPPER, LOWER))).alias("words"))


def detect(words: DataFrame, found: Sequence[dict]) -> DataFrame:
    """Detections (``row``, ``start``, ``stop``, rule columns), before suppression; words count from 0."""
    opened = (words.where("words IS NOT NULL").select("row", "words", F.posexplode("words").alias("at", "keyword"))
              .join(F.broadcast(rule_table(words.sparkSession, found)), "keyword"))
    first = F.greatest(F.col("at") - BEFORE, F.lit(0))
    context = opened.select(
        "row", "at", "rule", "label", "priority", "confidence", "base", "left", "right",
        F.array_join(F.slice("words", F.col("at") + 1, F.lit(AFTER)), " ").alias("onward"),
        F.concat(F.array_join(F.slice("words", first + 1, F.col("at") - first), " "), F.lit(" ")).alias("before"))
    matched = context.withColumns({
        "m": F.expr("regexp_extract(onward, right, 0)"),
        "l": F.expr("CASE WHEN left = '' THEN '' ELSE regexp_extract(before, left, 0) END"),
    }).where("m != '' AND (left = '' OR l != '')")
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    return matched.select("row", (F.col("at") - spaces(F.col("l"))).cast("long").alias("start"),
                          (F.col("at") + spaces(F.col("m")) + 1).cast("long").alias("stop"),
                          "rule", "label", "priority", "confidence", "base")


def suppress(detections: DataFrame) -> DataFrame:
    """Without those inside another detection of the same row with the same or a higher priority (first rule on ties)."""
    earlier = (Window.partitionBy("row").orderBy("start", F.desc("stop"), F.desc("priority"), "rule")
               .rowsBetween(Window.unboundedPreceding, -1))
    reach = F.lit(None).cast("long")
    for level in sorted(CONFIDENCE, reverse=True):
        reach = F.when(F.col("priority") == level, F.max(F.when(F.col("priority") >= level, F.col("stop"))).over(earlier)).otherwise(reach)
    return detections.withColumn("reach", reach).where("reach IS NULL OR reach < stop").drop("reach")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", found: Sequence[dict] | None = None) -> DataFrame:
    """One row for each row of ``df``: id, n_words, base counts and labels, ``labels`` and ``score``.

    Rows are told apart by place, so null ids and repeated rows each get their own result. A null text counts as empty.
    Without a detection the labels are empty texts, the places null and the score 0. Other columns are left out.
    """
    words = materialize(cut(df, id_col, text_col), "license_words")
    seen = detect(words, rules() if found is None else found)
    both = seen.where("base").unionByName(suppress(seen.where("NOT base")))
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    per_row = both.groupBy("row").agg(
        F.count_if("base").alias("n_base"), F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
        joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"), joined("label").alias("labels"),
        F.max("confidence").alias("score"))
    return words.select("row", id_col, "n_words").join(per_row, "row", "left").select(
        id_col, "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
