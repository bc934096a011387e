"""Small tables that hold the awkward cases: nulls, empty and long texts, repeated rows and ids, clashing columns."""

import random
import string

import pytest
from conftest import frame

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = {name: "string" for name in ("row", "ids", "n_words", "size", "key", "score", "kept", "words", "node", "label",
                                     "component_id", "copies", "votes", "marks", "slot", "shard")}
LETTERS = {"en": "etaoinshrdlu", "de": "enisratdhulcgmäöüß"}


def vocabulary(lang, n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(LETTERS[lang], k=rng.randint(2, 9))) for _ in range(n)]


def corpus(seed=7):
    """(doc_id, text, lang, source, n_chars) rows with near copies, copies, shared passages and awkward texts."""
    rng, rows = random.Random(seed), []
    words = {lang: vocabulary(lang, 400, lang) for lang in LETTERS}
    passage = " ".join(rng.choices(words["en"], k=60))
    for i in range(60):
        lang = "de" if i % 3 == 0 else "en"
        own = rng.choices(words[lang], k=rng.randint(3, 150))
        if i % 7 == 0:
            own[len(own) // 2:len(own) // 2] = passage.split()
        if i % 11 == 0:
            own += ["Licensed", "under", "the", "GNU", "General", "Public", "License,", "version", "3."]
        if i % 13 == 0:
            own += own[:20]
        rows.append([i, " ".join(own[:20]) + "\n" + " ".join(own[20:]), lang, f"s{i % 4}" if i % 5 else None])
    for i in range(60, 90):  # near copies, in growing distance
        own = rows[i - 60][1].split(" ")
        for _ in range(i % 4):
            own[rng.randrange(len(own))] = "changed"
        rows.append([i, " ".join(own), rows[i - 60][2], "s1"])
    rows += [[100 + i, rows[8][1], "en", "s0"] for i in range(12)]
    long = rng.choices(words["en"], k=30_000)
    rows += [[120, " ".join(long), "en", "s2"], [121, " ".join(long[:15_000]), "en", "s2"], [122, "x" * 3000, "en", "s2"],
             [123, "a a " * 60, None, "s3"], [124, "MIT License, CC-BY and cc by; Apache\tLicense", "en", "s3"],
             [125, "\x00\x1c\x85   Ünïcode ﬁ 𝒳 \U0001F600 'll 12 34\r\n\r\n  end ", "en", "s3"],
             [126, None, "en", "s3"], [127, "", "de", None], [128, " \n\t\v\f\r ", None, None], [129, "12345 !!", "en", "s3"],
             [None, rows[3][1], "en", "s0"], [None, "text without an id " * 12, None, None],
             [130, rows[4][1], "en", "s0"], [130, rows[4][1], "en", "s0"]]
    return [(a, b, c, d, len(b) if b is not None else None) for a, b, c, d in rows]


@pytest.fixture(scope="session")
def corpus_rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, corpus_rows, tmp_path_factory):
    """The corpus as a stored table, with extra columns whose names the operators use inside."""
    extra = ", ".join(f"{n} {t}" for n, t in CLASH.items())
    rows = [(*r, *[string.ascii_letters[i] for i, _ in enumerate(CLASH)]) for r in corpus_rows]
    path = str(tmp_path_factory.mktemp("corpus") / "documents.parquet")
    frame(spark, rows, f"{DOCS}, {extra}").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
