"""Line dedup, whitening and ranked search against plain versions of their contracts."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from compare import connect, differences
from conftest import frame
from corpus_tables import CLASH, corpus_rows, docs, empty  # noqa: F401
from pyspark.sql import functions as F

from liftlens.llm import lines, queries, search, whitening

BLANKS = " \t\n\x0b\x0c\r"


@pytest.mark.parametrize("name", ["op11_lines", "op13_search"])
def test_query_equals_its_sql(spark, small_dir, name):
    assert differences(connect(small_dir), queries.LLM_QUERIES[name](spark, small_dir), queries.LLM_ORACLE_SQL[name]) == ""


# Line dedup.

def plain_lines(rows):
    place = lambda key: (key is not None, key or 0)
    holders = defaultdict(set)
    own = [(key, (text or "").split("\n")) for key, text in rows]
    keys = [[x.strip(BLANKS).translate(brute.LOWER) for x in parts] for _, parts in own]
    for (key, _), ks in zip(own, keys):
        for k in ks:
            if len(k) >= 20:
                holders[k].add(place(key))
    out = []
    for (key, parts), ks in zip(own, keys):
        kept = [x for x, k in zip(parts, ks) if len(holders[k]) < 3 or place(key) == max(holders[k])]
        out.append((key, len(parts), len(parts) - len(kept), brute.sha("\n".join(kept).encode())))
    return sorted(out, key=repr)


def digests(df):
    left = lines.dedup(df).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256))
    return sorted((tuple(r) for r in left.collect()), key=repr)


def line_corpus(seed, docs=80):
    rng, rows = random.Random(seed), []
    shared = [f"A line number {i} that several documents hold" for i in range(12)]
    shared += ["ÄÖÜ ein gemeinsamer Satz über Zeilen", "x" * 19, "y" * 20, "é" * 19, "é" * 20, "z" * 400]
    for i in range(docs):
        own = [f"only document {i} says {rng.random()}"] + rng.choices(shared, k=rng.randint(0, 9))
        own += ["in a great many documents, and so hot"] * (i % 3)
        rng.shuffle(own)
        rows.append((i // 2 if i % 9 == 0 else i, "\n".join(rng.choice(["", " ", "\t"]) + x.upper() + "\r" if i % 4 == 0 else x for x in own)))
    rows += [(None, "\n".join(shared)), (None, shared[0]), (3, None), (500, ""), (501, "\n\n"), (502, shared[1] + "\n" + shared[1]),
             (502, shared[1] + "\n" + shared[1]), (503, "\n".join(f"a long document has line {k}" for k in range(5000)) + "\n" + shared[0])]
    return rows


@pytest.mark.parametrize("parts", [1, 7])
def test_lines_as_in_the_plain_version(spark, parts):
    rows = line_corpus(parts)
    df = frame(spark, rows, "doc_id long, text string").repartition(parts)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")  # groups go on over several ranges
    try:
        assert digests(df) == plain_lines(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_lines_of_awkward_rows_and_of_no_rows(docs, corpus_rows, empty):
    assert digests(docs) == plain_lines([r[:2] for r in corpus_rows])
    assert digests(empty) == []


def test_bitmaps_say_which_lines_stay(spark):
    text = "first line of its own\nthe line that all of them hold\nlast line of its own"
    rows = [(i, text.replace("own", str(i))) for i in range(4)]
    maps = lines.keep_bitmaps(frame(spark, rows, "doc_id long, text string")).orderBy("doc").collect()
    assert [(r.doc, r.n_dropped) for r in maps] == [(0, 1), (1, 1), (2, 1)]
    assert all(list(np.unpackbits(np.frombuffer(zlib.decompress(r.keep), np.uint8))[:3]) == [1, 0, 1] for r in maps)


# Whitening.

def plain_whitening(rows, by_count=False):
    """{(id, component): (n, deviation, |whitened|, explained)} of vectors of one length."""
    ids = [i for i, _ in rows]
    x = np.floor(256 * np.array([v for _, v in rows], float)).astype(np.int64)
    own, times = np.unique(x, axis=0, return_counts=True)
    w = times if by_count else np.ones(len(own), int)
    n, total = int(w.sum()), (own * w[:, None]).sum(0)
    c = own - total / n
    values, vectors = np.linalg.eigh((c * w[:, None]).T @ c / n)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    z = np.abs((x - total / n) @ vectors / np.sqrt(values))
    dev = ((n * x - total) ** 2).sum(1)
    share = values / np.trace((c * w[:, None]).T @ c / n)
    return sorted((i, k + 1, n, int(d), round(float(row[k]), 6), round(float(share[k]), 6)) for i, row, d in zip(ids, z, dev) for k in range(len(values)))


def whitened(df, **more):
    out = whitening.whiten(df, **more).collect()
    assert all(r.identity_error <= 1e-4 for r in out)
    return sorted((r.vec_id, r.component, r.n, r.deviation, round(abs(r.whitened), 6), round(r.explained, 6)) for r in out)


def vector_rows(seed=3, n=200, d=7):
    rng = np.random.default_rng(seed)
    x = np.float32(rng.normal(size=(n, d)) * np.linspace(3, 0.5, d) + rng.normal(size=d) * 5)
    return [(i, [float(v) for v in row]) for i, row in enumerate(x)]


@pytest.mark.parametrize("by_count", [False, True])
def test_whitening_as_in_the_plain_version(spark, monkeypatch, by_count):
    rows = vector_rows()
    rows += [(1000 + i, rows[5][1]) for i in range(150)] + [(7, rows[9][1])]  # a hot vector, and an id used twice
    monkeypatch.setattr(whitening, "COLD_ROWS", 10)
    df = frame(spark, rows, "vec_id long, embedding array<float>").repartition(5)
    assert whitened(df, by_count=by_count) == plain_whitening(rows, by_count)


def test_whitening_leaves_out_what_has_no_numbers(spark):
    rows = vector_rows(4, 50, 3)
    odd = [(900, None), (901, [1.0, None, 2.0]), (902, [float("nan"), 1.0, 2.0]), (903, [float("inf"), 1.0, 2.0]), (904, [])]
    extra = [(905, [0.0, 0.0, 0.0]), (906, [-0.0, 0.0, 0.0])]
    names = ("x", "h1", "dim", "copies", "z", "salt", "component", "n", "whitened")
    schema = "vec_id long, embedding array<float>, " + ", ".join(f"{n} string" for n in names)
    df = frame(spark, [(*r, *names) for r in rows + odd + extra], schema)
    assert whitened(df) == plain_whitening(rows + extra)
    assert whitening.whiten(df.limit(0)).collect() == []


def test_whitening_of_other_lengths_and_without_variance(spark):
    rows = vector_rows(5, 40, 5)
    df = frame(spark, [*rows, (800, [1.0, 2.0]), (801, [1.0, 2.0]), (802, [3e38, -3e38, 1.0])], "vec_id long, embedding array<float>")
    out = whitening.whiten(df).collect()
    alone = [r for r in out if r.vec_id in (800, 801)]
    assert len(alone) == 4 and all((r.n, r.deviation, r.whitened, r.explained) == (1, 0, None, None) for r in alone)
    assert sorted(r.component for r in out if r.vec_id == 802) == [1, 2, 3]
    assert {(r.vec_id, r.n) for r in out if r.vec_id < 800} == {(i, 40) for i, _ in rows}


# Ranked search.

def terms_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(brute.LOWER))


def plain_search(rows, items, k=10):
    own = [(key, Counter(terms_of(text))) for key, text in rows]
    own = [(key, c) for key, c in own if c]
    n, words = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        found = []
        for key, c in own:
            m = 100 - 75 + (75 * sum(c.values()) * n) // words
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
                        for t, times in Counter(terms_of(text)).items() if c[t])
            if score > 0:
                found.append((-score, key is not None, key))
        found.sort(key=lambda f: (f[0], f[1], f[2] or 0))
        out += [(item, rank, key, -score) for rank, (score, _, key) in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


def searched(docs, items, **more):
    return sorted((tuple(r) for r in search.search(docs, items, **more).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def search_items(rows, seed=2):
    rng = random.Random(seed)
    own = [terms_of(t) for _, t in rows if t and len(terms_of(t)) > 5]
    items = [(i, " ".join(rng.sample(w, min(len(w), rng.randint(1, 25))))) for i, w in enumerate(rng.choices(own, k=25))]
    return items + [(50, None), (51, ""), (52, "?!"), (53, "nowhere-to-be-found"), (54, items[0][1] * 3), (54, items[0][1]), (None, items[1][1]),
                    (55, " ".join(own[0]).upper())]


def test_search_as_in_the_plain_version(spark, docs, corpus_rows):
    rows = [r[:2] for r in corpus_rows]
    items = search_items(rows)
    asked = frame(spark, items, "item_id long, text string").withColumns({n: F.lit("x") for n in CLASH})
    assert searched(docs, asked) == plain_search(rows, items)
    assert searched(docs, asked, k=3) == plain_search(rows, items, 3)


def test_search_in_small_blocks_and_groups_of_items(spark, docs, corpus_rows, monkeypatch):
    rows = [r[:2] for r in corpus_rows]
    items = search_items(rows, 9)
    monkeypatch.setattr(search, "QUERY_BYTES", 1500)
    assert searched(docs, frame(spark, items, "item_id long, text string")) == plain_search(rows, items)


def test_search_without_documents_or_items(spark, docs, empty):
    items = frame(spark, [(1, "text")], "item_id long, text string")
    assert searched(empty, items) == [] and searched(docs, items.limit(0)) == []


def test_bounds_are_never_below_the_scores(spark, docs, corpus_rows):
    blocks = search.index(docs)
    total = blocks.agg(F.sum(F.octet_length("sizes") / 8).cast("long").alias("docs"), F.sum("terms").alias("words")).first()
    asked = search._read_queries([t for _, t in search_items([r[:2] for r in corpus_rows])])
    asked.docs, asked.words = total["docs"], total["words"]
    search._weigh(blocks, asked)
    scorer, pairs, excluded = search._Scorer(asked), 0, 0
    for row in [r.asDict() for r in blocks.collect()]:
        sizes = np.frombuffer(row["sizes"], np.int64)
        parts = [scorer.parts(t, int(n)) for t, n in zip(row["texts"], sizes)]
        bounds = dict(search._bounds(row, asked))
        for item in range(len(asked.places)):
            for at, own in enumerate(parts):
                score, bound = scorer.score(item, own), bounds[item][at] if item in bounds else 0
                assert score <= bound
                pairs, excluded = pairs + 1, excluded + (bound == 0)
    assert excluded > 0.1 * pairs
