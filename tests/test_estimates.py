"""Effects, draws, decisions and their parts on small sites whose results follow from plain formulas."""

import importlib
import itertools
import math
import re
from bisect import bisect_right
from datetime import date
from statistics import mean

import numpy as np
import pytest
from compare import connect, differences
from conftest import TURN, Plot, frame, garden, settings
from pyspark.sql import functions as F

from liftlens import Hypothesis
from liftlens import constants as C
from liftlens.functions.stats import ctr_bin, decide, effect_transform, general_number, percent
from liftlens.operators import bootstrap as B
from liftlens.operators import evaluation as E
from liftlens.operators import windows as W
from liftlens.oracle import sql
from liftlens.plans.queries import QUERIES

K1 = Hypothesis("K1", "did", "content", "position", threshold=0.1)
RANKS = {"fern": (12, 9), "moss": (30, 24), "reed": (5, 5), "ash": (10, 10.5), "oak": (40, 44), "elm": (6, 6)}
KINDS = dict.fromkeys(("fern", "moss", "reed"), "content") | dict.fromkeys(("ash", "oak", "elm"), "control")


def bed(page, **more):
    early, late = RANKS[page]
    return Plot(KINDS[page], {"position": early}, {"position": late}, TURN if KINDS[page] == "content" else None, **more)


BEDS = {page: bed(page) for page in RANKS}
LOGS = {kind: [math.log(late / early) for p, (early, late) in RANKS.items() if KINDS[p] == kind] for kind in ("content", "control")}


def gain(treated, control):
    """Relative gain in position from mean log ratios."""
    return 1 - math.exp(mean(treated) - mean(control))


@pytest.fixture(scope="module")
def ranked(spark):
    return garden(spark, settings(K1), BEDS)


def estimates(study):
    return {r.model: r.estimate for r in study.point_effects().collect()}


def test_position_effect_is_the_ratio_of_geometric_means(ranked):
    assert estimates(ranked) == pytest.approx({"did": gain(LOGS["content"], LOGS["control"]), "naive_prepost": gain(LOGS["content"], [0])})


def test_draws_follow_the_distribution_of_resampled_pages(ranked):
    every = [gain(t, c) for t in itertools.product(LOGS["content"], repeat=3) for c in itertools.product(LOGS["control"], repeat=3)]
    rows = ranked.draws(["did"]).collect()
    drawn = np.array([r.draw for r in rows])
    assert sorted(r.rep for r in rows) == list(range(150))
    assert np.abs(np.subtract.outer(drawn, every)).min(axis=1).max() < 1e-9
    assert abs(drawn.mean() - mean(every)) < 4 * np.std(every) / math.sqrt(150)
    assert 0.7 < drawn.std() / np.std(every) < 1.3


def test_binomial_draws_have_their_mean_and_variance(spark):
    whole = lambda n: F.lit(n).cast("bigint")
    name = F.col("id").cast("string")
    for trials, part, of in ((150, 37, 100), (7, 1, 3), (61, 1, 2)):
        drawn = np.array([r.k for r in spark.range(3000).select(B.binomial(whole(trials), whole(part), whole(of), name).alias("k")).collect()])
        p = part / of
        assert drawn.min() >= 0 and drawn.max() <= trials
        assert abs(drawn.mean() - trials * p) < 4 * math.sqrt(trials * p * (1 - p) / 3000)
        assert 0.85 < drawn.var() / (trials * p * (1 - p)) < 1.15
    edges = spark.range(1).select(B.binomial(whole(9), whole(4), whole(4), name).alias("all"), B.binomial(whole(0), whole(1), whole(4), name).alias("none")).first()
    assert (edges.all, edges.none) == (9, 0)


def test_a_repetition_splits_all_its_draws_over_the_blocks(spark):
    p = settings(K1, bootstrap_reps=400)
    sizes = frame(spark, [("K1", "did", 11)], "hypothesis_id string, model string, n bigint")
    rows = B.split_draws(sizes, p, "", F.lit("control"), 2, 3).collect()
    assert {r["block"]: r["size"] for r in rows} == {0: 2, 1: 2, 2: 2, 3: 2, 4: 2, 5: 1}
    for rep in range(400):
        assert sum(r.drawn for r in rows if r.rep == rep) == 11
    for block, size in ((0, 2), (3, 2), (5, 1)):
        share = sum(r.drawn for r in rows if r["block"] == block) / (400 * 11)
        assert abs(share - size / 11) < 4 * math.sqrt(size / 11 * (1 - size / 11) / 4400)


def test_draws_are_made_by_many_tasks_however_small_their_input(spark):
    slots = spark.range(2000).select(F.expr("'K' || (1 + id % 1)").alias("hypothesis_id"), F.expr("substr('position', 1 + id % 1)").alias("metric"),
                                     F.col("id").alias("slot"),
                                     F.lit(2000).cast("bigint").alias("n"), F.rand(1).alias("delta"))
    pairs = frame(spark, [("K1", "did", "position")], "hypothesis_id string, model string, metric string")
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = B.resampled(slots, pairs, ["hypothesis_id", "metric"], F.col("delta"), settings(K1, bootstrap_reps=100), "", F.lit("control"), 64)
        shares = [r.n for r in made.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    assert sum(shares) == 100 * 2000 and len(shares) >= 4 and max(shares) < sum(shares) / 2


def test_small_blocks_draw_as_their_twin_and_send_no_drawn_rows(spark, small_dir, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_SLOTS", 3)
    twin = importlib.reload(sql).ORACLE_SQL["bootstrap_draws"]
    drawn = QUERIES["bootstrap_draws"](spark, small_dir)
    assert differences(connect(small_dir), drawn, twin) == ""
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"Exchange .*?\n\s*[:+\- ]*(.*)", plan)
    assert "Generate explode(sequence(1, drawn" in plan
    assert exchanges and not any("explode(sequence(1, drawn" in x or x.startswith("Project") and "draw#" in x for x in exchanges)
    monkeypatch.undo()
    importlib.reload(sql)


def test_draws_are_the_same_for_any_layout_of_the_data(spark, ranked):
    dealt = garden(spark, settings(K1), dict(reversed(BEDS.items())))
    dealt.gsc = dealt.gsc.repartition(7, "date")
    assert {r.rep: r.draw for r in dealt.draws(["did"]).collect()} == pytest.approx({r.rep: r.draw for r in ranked.draws(["did"]).collect()})


def test_interval_and_decision_come_from_the_draws(ranked):
    row = next(r for r in ranked.evaluation().collect())
    low, high = np.percentile([r.draw for r in ranked.draws(["did"]).collect()], [2.5, 97.5])
    assert (row.ci_low, row.ci_high) == pytest.approx((low, high))
    assert row.decision == (C.SUPPORTED if low >= 0.1 else C.REJECTED if high < 0.1 else C.UNDECIDED)
    assert (row.status, row.n_treated, row.n_control, row.min_window_days) == ("estimated", 3, 3, 28)


def test_click_rate_effect_at_an_unchanged_position(spark):
    k2 = Hypothesis("K2", "did", "technical", "ctr_adjusted")
    many = lambda clicks: {"clicks": clicks, "impressions": 90_000.0}
    plots = {"ivy": Plot("technical", many(2_000), many(3_000), TURN), "yew": Plot("technical", many(8_000), many(12_000), TURN),
             "fir": Plot("control", many(6_000), many(6_000)), "box": Plot("control", many(700), many(700))}
    found = estimates(garden(spark, settings(k2), plots))
    assert set(found) == {"did", "naive_prepost", "did_raw_ctr"} and all(v == pytest.approx(0.5, abs=1e-3) for v in found.values())


def test_one_arm_is_compared_with_another(spark):
    k3 = Hypothesis("K3", "did_difference", "accessibility", "clicks", segment="local", compare_to="technical")
    clicks = {"ivy": ("accessibility", 1.3), "yew": ("accessibility", 1.3), "bay": ("technical", 1.1), "fig": ("technical", 1.1),
              "fir": ("control", 1.0), "box": ("control", 1.0)}
    plots = {p: Plot(g, {"clicks": 9_000.0}, {"clicks": 9_000.0 * k}, None if g == "control" else TURN) for p, (g, k) in clicks.items()}
    assert estimates(garden(spark, settings(k3), plots, segment="local"))["did"] == pytest.approx(0.2, abs=1e-3)


@pytest.mark.parametrize("short, status", [(["moss"], "estimated"), (["moss", "reed"], "insufficient_data")])
def test_pages_without_enough_days_are_left_out(spark, short, status):
    cut = {p: bed(p, ends=date(2025, 3, 24)) if p in short else bed(p) for p in RANKS}
    study = garden(spark, settings(K1), cut)
    assert {r.page for r in study.predictions.collect()} == {"fern", "moss", "reed"} - set(short)
    row = study.evaluation().first()
    assert (row.status, row.estimate is None) == (status, status != "estimated")
    if row.estimate is None:
        assert row.decision == C.NO_DATA and row.note == "treated per arm {'a': 1}, control 3"


def test_values_of_window_sums(spark):
    sums = frame(spark, [("position", 5, 4, 70.0, 70.0, 400.0, 1234.0, 20.0), ("clicks", 9, 6, 7.0, 7.0, 50.0, 60.0, 2.0),
                         ("ctr_adjusted", 3, 3, 12.0, 11.0, 80.0, 90.0, 4.5), ("ctr_adjusted", 3, 0, 12.0, None, None, None, None)],
                 "metric string, rows int, shown_days int, clicks double, shown_clicks double, shown_impressions double, "
                 "position_weight double, expected_clicks double")
    ten = sums.withColumns({"start": F.lit(date(2025, 4, 1)), "end": F.lit(date(2025, 4, 11))})
    got = [(r.n_days, r.value) for r in W.window_values(ten).collect()]
    assert got == [(4, pytest.approx(math.log(3.085))), (6, pytest.approx(math.log(0.75))), (3, pytest.approx(math.log(2.3))), (0, None)]


def test_scalar_rules(spark):
    places = [0.2, 1.0, 2.99, 7.0, 12.34, 19.999, 20.0, 29.5, 30.0, 412.0]
    bins = [r[0] for r in frame(spark, [(x,) for x in places], "x double").select(ctr_bin(F.col("x"))).collect()]
    assert bins == [max(bisect_right(C.CTR_EDGES, x) - 1, 0) for x in places]
    lit, one = F.lit, spark.range(1)
    assert one.select(effect_transform(lit(math.log(0.64)), lit("position")), effect_transform(lit(math.log(2.5)), lit("ctr_adjusted"))
                      ).first()[:] == pytest.approx((0.36, 1.5))
    for low, high, verdict in ((0.5, 0.6, C.SUPPORTED), (0.3, 0.3, C.SUPPORTED), (0.1, 0.3, C.UNDECIDED), (-1.0, 0.29, C.REJECTED)):
        assert one.select(decide(lit(low), lit(high), lit(0.3))).first()[0] == verdict
    assert one.select(percent(lit(-0.0456)), percent(lit(2.0)), percent(lit(None).cast("double"))).first()[:] == ("-4.6 %", "+200.0 %", "—")
    for value in (8.0, 0.00125, 98765.4, 2 / 7, 650000.0):
        assert one.select(general_number(lit(value))).first()[0] == f"{value:g}"


def test_curve_pools_bins_borrows_for_empty_ones_and_stops_in_time(spark):
    rows = [(date(2025, 1, 5), "fern", 20, 400, 6.1), (date(2025, 1, 6), "moss", 40, 400, 6.9), (date(2025, 1, 6), "reed", 1, 100, 17.0),
            (date(2025, 3, 1), "fern", 99, 100, 6.5)]
    panel = frame(spark, rows, "date date, page string, clicks long, impressions long, position double")
    stop = frame(spark, [(date(2025, 2, 1),)], "train_end date")
    curve = {r.bin: r.ctr for r in W.fit_ctr_curve(panel, stop, settings(K1)).collect()}
    assert curve[5] == pytest.approx(0.075) and curve[10] == pytest.approx(0.01) and len(curve) == len(C.CTR_EDGES)
    assert set(curve.values()) == {curve[5], curve[10]}
    assert {r.ctr for r in W.fit_ctr_curve(panel.where("page = 'nobody'"), stop, settings(K1)).collect()} == {0.0}


def test_trend_reads_the_latest_value_known_at_each_date(spark):
    k5 = Hypothesis("K5", "descriptive", "links", "domain_authority", threshold=6, horizon_days=60)
    study = garden(spark, settings(k5), BEDS, [("*", "links", date(2025, 2, 1)), ("*", "links", date(2025, 3, 1))])
    points = [(date(2025, 1, 20), 20.0), (date(2025, 2, 3), 21.0), (date(2025, 3, 30), 27.0), (date(2025, 4, 9), 50.0)]
    known = frame(spark, [(d, "domain_authority", "tool", v) for d, v in points], "date date, metric string, source string, value double")

    def trend(authority, **changes):
        return E.trend_asof(authority, study.interventions, study.hyp, settings(k5, **changes)).first()

    assert (trend(known).estimate, trend(known).decision) == (7.0, C.TREND_REACHED)
    early = trend(known, analysis_cutoff=date(2025, 3, 15))
    assert (early.estimate, early.decision) == (1.0, C.TREND_RUNNING)
    assert trend(known.where("value < 25")).decision == C.TREND_NOT_REACHED
    assert trend(known.where("value > 20")).status == "insufficient_data"
