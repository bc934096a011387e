"""Operators of the training-data pipeline against plain versions of their contracts."""

import math
import os
import zlib
from collections import defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import frame
from corpus_tables import corpus_rows, docs, empty  # noqa: F401
from pyspark.sql import functions as F

from liftlens.llm import bpe, jaccard, langid, licenses, lm, mixing, neighbours, quality, queries, sharding, sketch, substrings, words
from liftlens.session import written


def sorted_rows(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def vocab():
    return queries.vocabulary()


@pytest.fixture(scope="module")
def tiktoken_encode(vocab):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=vocab.pattern, mergeable_ranks=vocab.ranks, special_tokens={}).encode_ordinary


def test_tokens_equal_the_library_and_decode_to_the_text(docs, corpus_rows, vocab, tiktoken_encode):
    got = queries.token_digests(docs, vocab).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    want = []
    for key, text, *_ in corpus_rows:
        ids = tiktoken_encode(text or "")
        want.append((key, len(ids), brute.sha(" ".join(map(str, ids)).encode()), brute.sha((text or "").encode())))
    assert sorted_rows(got) == sorted_rows(want)


def test_perfect_hash_fills_every_slot_and_knows_strangers():
    keys = [f"k{i}".encode() for i in range(5000)]
    table = bpe.PerfectHash(keys)
    assert sorted(table.index) == list(range(5000))
    assert all(table.get(k) == i for i, k in enumerate(keys))
    assert table.get(b"stranger") is None and bpe.PerfectHash([]).get(b"x") is None and bpe.PerfectHash([b"a"]).get(b"a") == 0


def test_merges_of_long_and_odd_pieces(vocab, tiktoken_encode):
    for piece in (" ", "a", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab", "x" * 5000, "ähnlich" * 40, "　" * 7, "😀" * 30):
        assert [i for p in [piece] for i in vocab.encode_piece(p.encode())] == tiktoken_encode(piece)


def test_every_character_is_cut_as_by_the_library(vocab, tiktoken_encode):
    import regex
    for low in range(0, 0x30000, 0x1000):
        text = "".join(f"a{chr(c)}1{chr(c)} " for c in range(low, low + 0x1000) if not 0xD800 <= c < 0xE000)
        assert [i for p in regex.findall(vocab.pattern, text) for i in vocab.encode_piece(p.encode())] == tiktoken_encode(text)


def test_sharding_is_even_stable_and_total(spark, docs, corpus_rows):
    names = [f"n{i}" for i in range(7)]
    table = sharding.fill_table(names, 1009)
    owned = np.bincount(table)
    assert owned.max() - owned.min() <= 1 and table == sharding.fill_table(names[::-1], 1009)
    fewer = sharding.fill_table(names[:-1], 1009)
    moved = sum(names[a] != names[b] for a, b in zip(table, fewer))
    assert owned[6] <= moved < 2.5 * owned[6]
    placed = sharding.assign(docs, "doc_id", names, 1009).collect()
    assert len(placed) == len(corpus_rows) and all(r.shard == names[table[r.slot]] for r in placed)
    with pytest.raises(ValueError):
        sharding.fill_table(names, 1000)


def test_quality_counts_are_exact(docs, corpus_rows):
    got = quality.score(docs).select("doc_id", *quality.COUNTS, "base_failed").collect()
    assert sorted_rows(got) == sorted_rows((r[0], *brute.quality(r[1])) for r in corpus_rows)


def test_estimated_rules_reject_junk_and_keep_the_rest():
    patterns = {"+++000000": 900, "0++000000": 60, "-++000000": 12, "++---0000": 40, "++-00----": 30, "+++000000"[:3] + "0-0000": 0}
    share, adds = quality.estimate({k: n for k, n in patterns.items() if n})
    assert quality.posterior("++---0000", share, adds) < 0.5 and quality.posterior("++-00----", share, adds) < 0.5
    assert all(quality.posterior(p, share, adds) > 0.5 for p in ("+++000000", "0++000000", "-++000000"))
    assert quality.estimate({}) == (quality.SHARE, [])


def test_quality_keeps_documents_of_the_tables(spark, small_dir):
    scored = quality.score(queries.table(spark, small_dir, "documents")).join(queries.table(spark, small_dir, "labels"), "doc_id")
    lost = scored.where("NOT kept AND NOT base_failed AND labels.quality = 1" if "labels.quality" in scored.columns else
                        "NOT kept AND NOT base_failed").count()
    assert lost <= 0.1 * scored.count()


def test_license_base_columns_are_exact(docs, corpus_rows):
    got = licenses.scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert sorted_rows(got) == sorted_rows((r[0], *brute.licenses(r[1])) for r in corpus_rows)


def test_license_rules_prefer_the_fuller_detection(spark):
    texts = ["released under the terms of the Mozilla Public License v2.0", "SPDX-License-Identifier: GPL-2.0-or-later",
             "CC BY-NC 4.0", "BSD 3-Clause License. And the zlib license", "nothing here", "licence"]
    found = licenses.scan(frame(spark, list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.labels for r in found] == ["mpl,mpl-2.0", "gpl-2.0", "cc-by,cc-by-nc-4.0", "bsd-3-clause,zlib", "", ""]
    assert all((r.score > 0) == bool(r.labels) and r.score <= 1 for r in found)
    assert 200 < len(licenses.rules()) < licenses.MAX_RULES


def test_substrings_are_exact(docs, corpus_rows):
    got = substrings.dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert sorted_rows(got) == sorted_rows((r[0], *x) for r, x in zip(corpus_rows, brute.substrings([r[1] for r in corpus_rows])))


def numbered_texts(n, size, seed):
    return [" ".join(f"w{x}" for x in row) for row in np.random.Generator(np.random.PCG64(seed)).integers(0, 10 ** 6, (n, size)).tolist()]


def test_leaders_of_windows_spread_over_the_sketch():
    chunk, = words.chunks(pa.array(numbered_texts(1, 100_000, 1)), words.Hasher(substrings.SEED, False))
    lead, begin, end = substrings.runs(chunk, substrings.WINDOW, substrings.LEADER)
    ranges = np.bincount((lead >> np.uint64(58)).astype(np.int64), minlength=64)
    assert (end - begin).sum() == 100_000 - 34 and ranges.max() < 2 * ranges.min()


def test_substrings_of_copies_store_no_windows(spark):
    texts = numbered_texts(200, 500, 2)
    before = set(written())
    left = substrings.dedup(frame(spark, list(enumerate(texts + texts)), "doc_id long, text string").repartition(3))
    assert left.agg(F.sum("n_removed")).first()[0] == 400 * 500
    stored = [os.path.join(at, f) for path in set(written()) - before for at, _, files in os.walk(path.removeprefix("file:")) for f in files]
    assert stored and sum(map(os.path.getsize, stored)) < 5 * 400 * 500


def test_substrings_of_near_copies_are_exact_behind_a_full_sketch(spark, monkeypatch):
    """Copies changed here and there, some of them twice, so that leaders meet in equal runs, in others and in both."""
    random = np.random.Generator(np.random.PCG64(3))
    texts = numbered_texts(150, 600, 4)
    for base in texts[:6]:
        for changes in (1, 2, 5, 12, 30):
            own = base.split()
            for at in random.integers(0, len(own), changes).tolist():
                own[at:at + 1] = [["other"], [], ["one", "more"]][at % 3]
            cut = int(random.integers(0, 100))
            texts += [" ".join(own)] * (1 + changes % 2) + [" ".join(own[cut:cut + 90])]
    monkeypatch.setattr(sketch, "MIN_CELLS", 1 << 16)
    monkeypatch.setattr(sketch, "MAX_CELLS", 1 << 16)
    docs = frame(spark, list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = substrings.dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert sorted_rows(got) == sorted_rows((i, *x) for i, x in enumerate(brute.substrings(texts)))


def test_jaccard_join_is_exact(docs, corpus_rows):
    got = jaccard.join(docs).collect()
    assert sorted_rows(got) == sorted_rows(brute.jaccard([r[:2] for r in corpus_rows]))


def test_jaccard_join_splits_large_clusters(docs, corpus_rows, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 100)
    assert sorted_rows(jaccard.join(docs).collect()) == sorted_rows(brute.jaccard([r[:2] for r in corpus_rows]))


def test_sketch_is_not_filled_by_items_that_occur_once(spark):
    random = np.random.Generator(np.random.PCG64(5))
    once, twice, often = (random.integers(0, 2 ** 64, n, np.uint64) for n in (200_000, 2_000, 50))
    mixed = random.permutation(np.concatenate([once, np.repeat(twice, 2), np.repeat(often, 300)])).view(np.int64)
    rows = spark.createDataFrame(pa.table({"h": pa.array(mixed)})).repartition(3)
    made = sketch.count(rows, lambda batch: [batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)], 1 << 18, (2, 16))
    assert (made.reached(often) == 2).all() and (made.reached(twice) >= 1).all()
    assert (made.reached(once) > 0).mean() < 0.1 and (made.reached(twice) > 1).mean() < 0.05


def test_jaccard_join_behind_a_bounded_sketch_passes_on_few_documents(spark, monkeypatch):
    texts = numbered_texts(400, 300, 6)
    texts += [f"{t} end {i}" for i, t in enumerate(texts[:20])] + texts[20:30]
    monkeypatch.setattr(sketch, "MIN_CELLS", 1 << 16)
    monkeypatch.setattr(sketch, "MAX_CELLS", 1 << 16)
    docs = frame(spark, list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted_rows(jaccard.join(docs).collect()) == sorted_rows(brute.jaccard(list(enumerate(texts))))
    passed = jaccard.profiles(docs, "doc_id", "text", jaccard.N).where("cardinality(lead) > 0")
    assert 60 <= passed.count() < 120 and passed.where("cardinality(grams) = size").count() == passed.count()


def test_language_model_base_is_exact_and_the_model_is_a_probability(docs, corpus_rows, monkeypatch):
    held = lambda key: zlib.crc32(str(key if key is not None else "").encode()) % 10 == 0
    want = sorted_rows((r[0], *(round(v, 6) for v in x)) for r, x in zip(corpus_rows, brute.base_scores([r[:2] for r in corpus_rows], held)))
    for head in (1 << 20, 40, 0):
        monkeypatch.setattr(lm, "HEAD", head)
        got = lm.score(docs).collect()
        assert sorted_rows((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(r.score <= 0 and math.isfinite(r.score) and r.held_out == held(r.doc_id) for r in got)
        known = [r for r in got if not r.held_out]
        assert sum(r.score for r in known) > sum(r.base_score for r in known)


def test_filter_never_underestimates(spark):
    rng = np.random.default_rng(5)
    keys, counts = rng.integers(0, 2 ** 64, 3000, np.uint64), rng.integers(1, 400, 3000)
    made = lm.Filter(30_000)
    made.data = np.zeros((made.room << made.block_bits) // 8, np.uint8)
    block, rest = made.split(keys)
    for step in range(1, 40):
        at = lm.levels_of(counts) >= step
        for probe in range(lm.PROBES):
            place = block[at] * made.room + made.places(rest[at], step, probe)
            np.bitwise_or.at(made.data, place >> 3, (128 >> (place & 7)).astype(np.uint8))
    got = made.levels(keys)
    assert (got >= lm.levels_of(counts)).all() and (got == lm.levels_of(counts)).mean() > 0.95


def test_language_of_held_out_texts(docs, corpus_rows):
    got = langid.identify(docs).collect()
    assert len(got) == len(corpus_rows)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 90 and r.doc_id % 60 % 7]
    lang = {r[0]: r[2] for r in corpus_rows}
    assert len(held) > 10 and all(r.lang_pred == lang[r.doc_id] for r in held)
    none = {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id in (126, 127, 128, 129)}
    assert set(none.values()) == {("und", 0.0)}
    assert all(0 <= r.score <= 1 for r in got)


def test_mixture_of_two_languages(docs, spark):
    model = langid.learn(docs, "lang", "text", "doc_id")
    de, en = (" ".join(r.text for r in docs.where(f"lang = '{x}' AND doc_id < 60 AND doc_id % 7 != 0").orderBy("doc_id").limit(9).collect()) for x in ("de", "en"))
    both = frame(spark, [(1, de + " " + en + " " + en), (2, de)], "doc_id long, text string")
    mixed, single = langid.predict(both, model).orderBy("doc_id").collect()
    assert mixed.lang_pred == "en" and 0.4 < mixed.score < 0.95
    assert single.lang_pred == "de" and single.score > 0.95


def nearest_by_hand(rows, n):
    ok = {i: v for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = []
    for q in sorted(i for i in ok if i % 20 == 0):
        score = {i: sum(a * b for a, b in zip(ok[q], v)) for i, v in ok.items() if i != q}
        out += [(q, k + 1, i) for k, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:n])]
    return out


def test_neighbours_of_few_awkward_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(90)]
    rows += [(100 + i, rows[20][1]) for i in range(30)] + [(140, None), (160, [0.0] * 4), (161, [1.0, None, 0.0, 1.0]),
                                                           (162, [float("nan")] * 4), (163, [float("inf")] * 4), (None, [1.0] * 4)]
    vectors = frame(spark, [(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = neighbours.nearest(vectors, F.col("vec_id") % 20 == 0, 20).select("query_id", "rank", "vec_id").collect()
    want = nearest_by_hand(rows, 20)
    assert sorted((r.query_id, r["rank"]) for r in got) == sorted((q, k) for q, k, _ in want)
    hot = lambda found: [x for x in sorted(found) if x[0] in (20, 100, 120)]  # noqa: E731  the nearest are copies: ties by id
    assert hot(map(tuple, got)) == hot(want)
    both = {(r.query_id, r.vec_id) for r in got} & {(q, i) for q, _, i in want}
    assert len(both) >= 0.95 * len(want)


def test_neighbours_recall(spark, small_dir):
    rows = [(r.vec_id, list(r.embedding)) for r in queries.table(spark, small_dir, "embeddings").collect()]
    want = defaultdict(set)
    for q, _, i in nearest_by_hand(rows, 20):
        want[q].add(i)
    got = defaultdict(set)
    for r in queries.op4_neighbours(spark, small_dir).collect():
        got[r.query_id].add(r.vec_id)
    assert np.mean([len(want[q] & got[q]) / len(want[q]) for q in want]) >= 0.9


def test_targets_follow_weights_and_stop_at_twice_the_source():
    assert mixing.targets([100, 100, 100]) == [200.0, 2 / 3 * 250, 1 / 3 * 250]
    assert mixing.targets([]) == [] and mixing.targets([0, 10]) == [0.0, 15.0]
    sizes = [7, 1000, 30, 0, 500, 2, 90]
    goal = mixing.targets(sizes)
    assert abs(sum(goal) - 1.5 * sum(sizes)) < 1e-6 and all(g <= 2 * s + 1e-9 for g, s in zip(goal, sizes))


def test_mix_meets_its_targets_and_repeats(docs, corpus_rows):
    got = mixing.mix(docs).collect()
    assert sorted_rows((r.doc_id, r.size) for r in got) == sorted_rows((r[0], len(brute.words(r[1]))) for r in corpus_rows)
    total, taken, goal = defaultdict(int), defaultdict(int), {}
    for r in got:
        total[r.source] += r.size
        taken[r.source] += r.size * r.copies
        goal[r.source] = r.target
        assert 0 <= r.copies <= 2
    order = sorted(total, key=lambda s: (s is None, s or ""))
    assert [goal[s] for s in order] == pytest.approx(mixing.targets([total[s] for s in order]))
    largest = max(r.size for r in got if r.size < 10_000)
    assert all(abs(taken[s] - goal[s]) <= largest for s in order if s != "s2")
    assert sorted_rows(got) == sorted_rows(mixing.mix(docs.repartition(5)).collect())


def test_rates_meet_token_targets_in_expectation(spark, small_dir):
    rows = mixing.mix(queries.table(spark, small_dir, "documents")).groupBy("source").agg(
        F.sum(F.col("size") * F.col("rate")).alias("expected"), F.first("target").alias("target")).collect()
    assert all(abs(r.expected - r.target) <= 1e-5 * r.target + 1e-6 for r in rows)


@pytest.mark.parametrize("apply", [
    lambda d: queries.token_digests(d, queries.vocabulary()), lambda d: sharding.assign(d, "doc_id", ["a", "b"]), quality.score,
    licenses.scan, substrings.dedup, langid.identify, jaccard.join, lm.score, mixing.mix],
    ids=["bpe", "sharding", "quality", "licenses", "substrings", "langid", "jaccard", "lm", "mixing"])
def test_empty_tables_give_no_rows(empty, apply):
    assert apply(empty).collect() == []


def test_no_vectors_give_no_rows(spark):
    nothing = frame(spark, [], "vec_id long, embedding array<float>")
    assert neighbours.nearest(nothing, F.col("vec_id") % 20 == 0, 20).collect() == []


def test_filter_grows_with_the_corpus_and_ends_at_its_highest_level():
    rng = np.random.default_rng(6)
    for n in (1_000, 400_000):
        rest = np.unique(rng.integers(0, 2 ** 40, n).astype(np.uint64))
        made = lm.block_of(rest, np.full(len(rest), 2))
        strangers = rng.integers(2 ** 40, 2 ** 41, 200_000).astype(np.uint64)
        assert (made.found(np.zeros(len(rest), np.int64), rest) == 2).all()
        assert (made.found(np.zeros(len(strangers), np.int64), strangers) > 0).mean() < 0.005
    assert lm.Filter(1 << 32).room << 6 >= lm.BITS_AN_ENTRY << 32
    full = lm.Filter(1000)
    full.data = np.full((full.room << full.block_bits) // 8, 255, np.uint8)
    assert lm.typical_counts()[full.levels(rng.integers(0, 2 ** 64, 50, np.uint64))].max() > 0


def test_language_model_scores_do_not_depend_on_blocks_and_units(docs, monkeypatch):
    want = sorted_rows((r.doc_id, round(r.score, 6)) for r in lm.score(docs).collect())
    monkeypatch.setattr(lm, "WORDS_A_BLOCK", 100)
    monkeypatch.setattr(lm, "UNIT", 2000)
    got = sorted_rows((r.doc_id, round(r.score, 6)) for r in lm.score(docs).collect())
    assert [k for k, _ in got] == [k for k, _ in want]
    assert np.mean([abs(a - b) < 0.02 * abs(b) + 1e-6 for (_, a), (_, b) in zip(got, want)]) > 0.9
