"""Evaluation tables: estimates with intervals and decisions, and the descriptive trend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlens import constants as C
from liftlens.functions.stats import decide, general_number
from liftlens.operators.bootstrap import draws, intervals
from liftlens.operators.predictions import point_effects
from liftlens.params import Params, arms, models

METRIC_COLUMNS = ["run_id", "hypothesis_id", "kind", "model", "model_version", "metric", "segment", "intervention",
                  "compare_to", "estimate", "ci_low", "ci_high", "ci_level", "ci_low_adj", "ci_high_adj",
                  "ci_level_adj", "threshold", "decision", "decision_unadjusted", "n_treated", "n_control",
                  "min_window_days", "bootstrap_reps", "status", "note"]


def sample_sizes(windows: DataFrame, pred: DataFrame, hyp: DataFrame) -> DataFrame:
    """Pages behind each hypothesis and model, and whether they suffice for an estimate.

    Page counts are distinct counts over (group, page) pairs; everything after them has one row per
    hypothesis, model and arm.
    """
    about = models(hyp).select("hypothesis_id", "kind", "model", F.col("model_metric").alias("metric"))
    controls = (windows.where("eligible").groupBy("hypothesis_id", "metric")
                .agg(F.countDistinct(F.when(F.col("role") == "control", F.col("page"))).cast("int").alias("n_control"),
                     F.min("n_days").alias("min_window_days")))
    per_arm = (pred.groupBy("hypothesis_id", "model", "arm")
               .agg(F.countDistinct("page").cast("int").alias("pages")))
    every_arm = about.join(F.broadcast(arms(hyp).select("hypothesis_id", "arm")), "hypothesis_id")
    listed = F.concat(F.lit("'"), F.col("arm"), F.lit("': "), F.col("pages").cast("string"))
    treated = (every_arm.join(F.broadcast(per_arm), ["hypothesis_id", "model", "arm"], "left")
               .groupBy("hypothesis_id", "kind", "model", "metric")
               .agg(F.coalesce(F.sum("pages"), F.lit(0)).cast("int").alias("n_treated"),
                    F.min(F.coalesce("pages", F.lit(0))).alias("smallest_arm"),
                    F.array_join(F.array_sort(F.collect_list(listed)), ", ").alias("listed")))
    sized = (treated.join(F.broadcast(controls), ["hypothesis_id", "metric"], "left")
             .fillna(0, ["n_control", "min_window_days"]))
    enough = (F.col("n_control") >= 2) & (F.col("smallest_arm") >= 2)
    note = F.concat(F.lit("treated per arm {"), F.col("listed"), F.lit("}, control "), F.col("n_control").cast("string"))
    return sized.select("hypothesis_id", "kind", "model", "metric", "n_treated", "n_control", "min_window_days",
                        enough.alias("enough"), F.when(enough, "").otherwise(note).alias("note"))


def usable_models(sizes: DataFrame, wanted: list[str]) -> DataFrame:
    """Hypotheses and models with enough pages, with their kind and the metric the model reads."""
    return (sizes.where(F.col("enough") & F.col("model").isin(wanted))
            .select("hypothesis_id", "model", "kind", "metric"))


def evaluate(sizes: DataFrame, effects: DataFrame, bounds: DataFrame, hyp: DataFrame, p: Params,
             run_id: str, wanted: list[str]) -> DataFrame:
    """One row per inferential hypothesis and wanted model. All inputs hold a few rows each."""
    keys = ["hypothesis_id", "model"]
    about = hyp.select("hypothesis_id", "segment", "intervention", "compare_to", "threshold")
    rows = (sizes.where(F.col("model").isin(wanted))
            .join(F.broadcast(about), "hypothesis_id")
            .join(F.broadcast(effects.select(*keys, "estimate")), keys, "left")
            .join(F.broadcast(bounds), keys, "left"))
    enough = F.col("enough")

    def known(name):
        return F.when(enough, F.col(name))

    def decision(low, high):
        return F.when(enough, decide(F.col(low), F.col(high), F.col("threshold"))).otherwise(C.NO_DATA)

    return rows.withColumns({
        "run_id": F.lit(run_id), "model_version": F.lit(C.EFFECT_MODEL), "estimate": known("estimate"),
        "ci_low": known("ci_low"), "ci_high": known("ci_high"), "ci_level": F.lit(p.ci_level),
        "ci_low_adj": known("ci_low_adj"), "ci_high_adj": known("ci_high_adj"),
        "ci_level_adj": F.lit(p.ci_level_adj),
        "decision": decision("ci_low_adj", "ci_high_adj"), "decision_unadjusted": decision("ci_low", "ci_high"),
        "bootstrap_reps": F.lit(p.bootstrap_reps),
        "status": F.when(enough, "estimated").otherwise("insufficient_data")}).select(METRIC_COLUMNS)


def evaluate_models(sizes: DataFrame, changes: DataFrame, pred: DataFrame, hyp: DataFrame, p: Params,
                    run_id: str, wanted: list[str], tag: str = "") -> DataFrame:
    """Effects, draws and intervals of the wanted models put together."""
    drawn = draws(changes, usable_models(sizes, wanted), p, tag)
    return evaluate(sizes, point_effects(pred, hyp), intervals(drawn, p), hyp, p, run_id, wanted)


def trend_asof(authority: DataFrame, interventions: DataFrame, hyp: DataFrame, p: Params) -> DataFrame:
    """Change of a site score from its last value on or before the start of a change type to its
    last value on or before the horizon; one pass keeps the latest (date, value) of each."""
    available = F.lit(p.available_until)
    starts = interventions.groupBy(F.col("type").alias("intervention")).agg(F.min("date").alias("start"))
    wanted = (hyp.where(F.col("kind") == "descriptive").join(F.broadcast(starts), "intervention", "left")
              .withColumn("horizon_end", F.date_add("start", F.col("horizon_days"))))
    point = F.struct(F.col("date"), F.col("value").cast("double").alias("value"))
    within = F.least(F.col("horizon_end"), available)
    points = (authority.where(F.col("date") <= available).join(F.broadcast(wanted), "metric")
              .groupBy("hypothesis_id")
              .agg(F.max(F.when(F.col("date") <= F.col("start"), point)).alias("base"),
                   F.max(F.when(F.col("date") <= within, point)).alias("latest")))
    last = wanted.join(F.broadcast(points), "hypothesis_id", "left")
    found = F.col("base").isNotNull() & F.col("latest").isNotNull()
    change = F.col("latest.value") - F.col("base.value")
    complete = available >= F.col("horizon_end")
    decision = (F.when(~found, C.NO_DATA).when(change >= F.col("threshold"), C.TREND_REACHED)
                .when(complete, C.TREND_NOT_REACHED).otherwise(C.TREND_RUNNING))
    note = F.concat(F.lit("baseline "), F.col("base.date").cast("string"), F.lit("="), general_number(F.col("base.value")),
                    F.lit("; last "), F.col("latest.date").cast("string"), F.lit("="),
                    general_number(F.col("latest.value")), F.lit("; horizon ends "),
                    F.col("horizon_end").cast("string"), F.lit("; complete="),
                    F.when(complete, "True").otherwise("False"))
    return last.select(
        "hypothesis_id", "kind", "metric", "segment", "intervention", "compare_to", "threshold",
        F.when(found, change).alias("estimate"), decision.alias("decision"),
        F.when(found, "descriptive").otherwise("insufficient_data").alias("status"),
        F.when(found, note).otherwise(C.TREND_NO_BASELINE).alias("note"))


def trend_rows(trend: DataFrame, p: Params, run_id: str) -> DataFrame:
    """The descriptive trend in the shape of the evaluation table."""
    empty = {name: F.lit(None).cast("double") for name in ("ci_low", "ci_high", "ci_low_adj", "ci_high_adj")}
    counts = {name: F.lit(None).cast("int") for name in ("n_treated", "n_control", "min_window_days")}
    return trend.withColumns({
        **empty, **counts, "run_id": F.lit(run_id), "model": F.lit("descriptive"),
        "model_version": F.lit(C.EFFECT_MODEL), "ci_level": F.lit(p.ci_level),
        "ci_level_adj": F.lit(p.ci_level_adj), "decision_unadjusted": F.col("decision"),
        "bootstrap_reps": F.lit(p.bootstrap_reps)}).select(METRIC_COLUMNS)
