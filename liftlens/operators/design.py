"""Pre and post windows around dated changes, with treated and control pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlens import constants as C
from liftlens.params import Params, arms

DESIGN_COLUMNS = ["hypothesis_id", "arm", "window_key", "page", "role", "period", "start", "end",
                  "intervention_date", "label_cutoff", "post_days_effective", "window_eligible"]


def treatment_dates(interventions: DataFrame) -> DataFrame:
    """First date of each page-level type on each page; site-wide changes treat no page."""
    return (interventions.where(~F.col("type").isin(C.SITE_WIDE_TYPES))
            .groupBy("type", "page").agg(F.min("date").alias("treated_on")))


def ctr_training_end(interventions: DataFrame, p: Params) -> DataFrame:
    """One row: exclusive end of the training days, before the first change of any type."""
    return interventions.agg(F.date_sub(F.min("date"), p.buffer_days).alias("train_end"))


def cohort_windows(hyp: DataFrame, interventions: DataFrame, p: Params, shift_days: int = 0) -> DataFrame:
    """One row per hypothesis, arm, cohort and period, with the window bounds.

    A cohort is one treatment date of one type, so the table has at most (arms of the hypotheses) x
    (distinct change dates) x 2 rows. It does not grow with pages or panel days, which makes it
    safe to broadcast.
    """
    cohorts = treatment_dates(interventions).select("type", F.col("treated_on").alias("window_key")).distinct()
    anchor = F.date_sub("window_key", shift_days)
    pre_end = F.date_sub(anchor, p.buffer_days)
    post_start = F.date_add(anchor, p.ramp_days)
    limits = [F.date_add(post_start, p.post_days), F.date_add(F.lit(p.available_until), 1)]
    if shift_days:
        limits.append(F.date_sub("window_key", p.buffer_days))
    post_end = F.least(*limits)
    effective = F.greatest(F.datediff(post_end, post_start), F.lit(0))
    periods = F.array(
        F.struct(F.lit("pre").alias("period"), F.date_sub(pre_end, p.pre_days).alias("start"),
                 pre_end.alias("end")),
        F.struct(F.lit("post").alias("period"), post_start.alias("start"),
                 F.greatest(post_end, post_start).alias("end")))
    return (arms(hyp).join(F.broadcast(cohorts), "type")
            .select("hypothesis_id", "arm", "type", "metric", "segment", "window_key",
                    anchor.alias("intervention_date"), F.lit(p.available_until).alias("label_cutoff"),
                    effective.alias("post_days_effective"),
                    (effective >= p.min_post_days).alias("window_eligible"),
                    F.inline(periods)))


def build_design(windows: DataFrame, pages: DataFrame, interventions: DataFrame, p: Params) -> DataFrame:
    """Windows of every treated and control page, with the metric and segment of the hypothesis.

    Treated pages meet the cohort of their own date by a broadcast join. Control pages take part in
    every cohort, so each one carries the bounded window list, read as a scalar subquery, and unfolds
    it in place: no shuffle and no join of the control pages.
    """
    treated = (treatment_dates(interventions).withColumnRenamed("treated_on", "window_key")
               .join(F.broadcast(windows), ["type", "window_key"])
               .withColumn("role", F.lit("treated")))
    window_list = windows.agg(F.collect_list(F.struct(*windows.columns)).alias("windows")).select("windows").scalar()
    control = (pages.where(F.col("design_group") == p.control_group)
               .select("page", F.lit("control").alias("role"), F.inline(window_list)))
    columns = [*DESIGN_COLUMNS, "metric", "segment"]
    return treated.select(columns).unionByName(control.select(columns))
