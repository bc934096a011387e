"""Windows around changes: bounds, cut-offs and what may not leak into them."""

from datetime import date, timedelta

import pytest
from conftest import TURN, Plot, garden, settings
from pyspark.sql import functions as F
from test_estimates import BEDS, K1

from liftlens.operators.windows import pre_post

DAY = timedelta(1)


def windows(rows):
    return {(r.page, r.period): (r.start, r.end) for r in rows}


def test_windows_keep_their_distance_from_each_change(spark):
    later = Plot("content", {}, {}, TURN + 9 * DAY)
    s = garden(spark, settings(K1), {**BEDS, "lily": later})
    rows = s.design().collect()
    for page, day in (("fern", TURN), ("lily", TURN + 9 * DAY)):
        own = windows(r for r in rows if r.page == page)
        assert own == {(page, "pre"): (day - 31 * DAY, day - 3 * DAY), (page, "post"): (day + 7 * DAY, day + 35 * DAY)}
    for page in ("ash", "oak", "elm"):  # control pages have the windows of both dates
        assert {r.window_key for r in rows if r.page == page and r.role == "control"} == {TURN, TURN + 9 * DAY}
    assert {r.role for r in rows if r.page in ("fern", "lily")} == {"treated"}


@pytest.mark.parametrize("cutoff, days, fits", [(date(2025, 4, 30), 28, True), (date(2025, 4, 10), 22, True), (date(2025, 4, 5), 17, False),
                                                (date(2025, 3, 12), 0, False)])
def test_post_windows_use_final_days_only(spark, cutoff, days, fits):
    rows = garden(spark, settings(K1, analysis_cutoff=cutoff), BEDS).design().where("period = 'post'").collect()
    assert {(r.post_days_effective, r.window_eligible, (r.end - r.start).days) for r in rows} == {(days, fits, days)}


def test_placebo_windows_lie_before_the_change(spark):
    s = garden(spark, settings(K1), BEDS)
    rows = s.design(s.p.placebo_shift_days).collect()
    assert all(r.end <= TURN - 3 * DAY and r.intervention_date == TURN - 40 * DAY and r.window_key == TURN for r in rows)


def values(study, period):
    return {(r.page, r.role): (r.n_days, r.value) for r in study.page_windows().collect() if r.period == period}


def test_days_after_the_last_final_one_have_no_effect(spark):
    s, t = (garden(spark, settings(K1, analysis_cutoff=date(2025, 4, 10)), BEDS) for _ in range(2))
    t.gsc = t.gsc.where("date <= '2025-04-07'")
    assert values(s, "post") == values(t, "post") and s.curve.orderBy("bin").collect() == t.curve.orderBy("bin").collect()


def test_what_follows_a_change_reaches_post_windows_only(spark):
    s, t = garden(spark, settings(K1), BEDS), garden(spark, settings(K1), BEDS)
    t.gsc = t.gsc.withColumn("position", F.when(F.col("date") >= TURN - 3 * DAY, F.col("position") + 11).otherwise(F.col("position")))
    assert values(s, "pre") == values(t, "pre") and s.curve.orderBy("bin").collect() == t.curve.orderBy("bin").collect()
    assert all(values(t, "post")[k][1] > v for k, (_, v) in values(s, "post").items())


def test_windows_and_pivot_share_one_partitioning(spark):
    s = garden(spark, settings(K1), BEDS)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = pre_post(s.page_windows())._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan.split("SortMergeJoin")[0]
    assert not any(bad in plan for bad in ("CartesianProduct", "BroadcastNestedLoop"))
