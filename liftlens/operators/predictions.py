"""Counterfactual predictions per treated page and the point effects they imply."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlens import constants as C
from liftlens.functions.stats import effect_transform
from liftlens.params import Params, models

PREDICTION_COLUMNS = ["run_id", "hypothesis_id", "model", "model_version", "arm", "window_key", "page",
                      "role", "split", "target_name", "target", "prediction", "issued_at",
                      "intervention_date", "target_start", "target_end", "label_cutoff"]
PREDICTION_KEY = ["run_id", "hypothesis_id", "model", "arm", "window_key", "page"]


def control_deltas(changes: DataFrame) -> DataFrame:
    """Mean change of the control pages per hypothesis, metric, arm and cohort."""
    return (changes.where(F.col("role") == "control")
            .groupBy("hypothesis_id", "metric", "arm", "window_key")
            .agg(F.avg("delta").alias("control_delta")))


def predictions(changes: DataFrame, windows: DataFrame, hyp: DataFrame, p: Params, run_id: str) -> DataFrame:
    """Expected post value of each treated page under each model of its hypothesis.

    The control means and the window bounds hold a few rows per cohort, so both lookups are
    broadcast and the treated pages are never shuffled.
    """
    model_rows = models(hyp).select("hypothesis_id", "model", F.col("model_metric").alias("metric"))
    bounds = (windows.where(F.col("period") == "post")
              .select("hypothesis_id", "arm", "window_key", "intervention_date", "label_cutoff",
                      F.col("start").alias("target_start"), F.col("end").alias("target_end")))
    treated = (changes.where(F.col("role") == "treated")
               .join(F.broadcast(control_deltas(changes)), ["hypothesis_id", "metric", "arm", "window_key"])
               .join(F.broadcast(model_rows), ["hypothesis_id", "metric"])
               .join(F.broadcast(bounds), ["hypothesis_id", "arm", "window_key"], "left"))
    expected = F.when(F.col("model") == "naive_prepost", F.col("pre")).otherwise(F.col("pre") + F.col("control_delta"))
    return (treated.withColumns({
        "run_id": F.lit(run_id), "model_version": F.lit(C.EFFECT_MODEL), "split": F.lit("post"),
        "target_name": F.concat(F.lit("log_"), F.col("metric")), "target": F.col("post"),
        "prediction": expected, "issued_at": F.lit(p.analysis_cutoff)}).select(PREDICTION_COLUMNS))


def duplicate_keys(pred: DataFrame) -> DataFrame:
    return pred.groupBy(*PREDICTION_KEY).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def arm_difference(per_arm: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Effect of arm a, minus the effect of arm b for a two-arm hypothesis."""
    def of(arm):
        return F.max(F.when(F.col("arm") == arm, F.col(value)))

    return (per_arm.groupBy(*keys, "kind")
            .agg(F.when(F.col("kind") == "did_difference", of("a") - of("b")).otherwise(of("a")).alias(out))
            .drop("kind"))


def point_effects(pred: DataFrame, hyp: DataFrame) -> DataFrame:
    """Effect per hypothesis and model: the mean prediction error of each arm, transformed back."""
    about = models(hyp).select("hypothesis_id", "model", "kind", F.col("model_metric").alias("metric"))
    per_arm = (pred.groupBy("hypothesis_id", "model", "arm")
               .agg(F.avg(F.col("target") - F.col("prediction")).alias("error"))
               .join(F.broadcast(about), ["hypothesis_id", "model"])
               .withColumn("effect", effect_transform(F.col("error"), F.col("metric"))))
    return arm_difference(per_arm, ["hypothesis_id", "model", "metric"], "effect", "estimate")
