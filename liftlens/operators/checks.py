"""Independent checks of finished result tables; every check is one row (name, ok, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftlens.operators.predictions import duplicate_keys, point_effects
from liftlens.params import Params

TOLERANCE = 1e-9


def _check(rows: DataFrame, name: str, ok: Column, detail: Column | None = None) -> DataFrame:
    """Aggregate ``rows`` to a verdict; no rows means nothing is wrong."""
    verdict = F.coalesce(ok, F.lit(True))
    text = F.lit("") if detail is None else F.when(verdict, F.lit("")).otherwise(detail)
    return rows.agg(F.lit(name).alias("name"), verdict.alias("ok"), text.alias("detail"))


def _all(condition: Column) -> Column:
    return F.bool_and(F.coalesce(condition, F.lit(False)))


def _none(rows: DataFrame, name: str, label: Column) -> DataFrame:
    """Nothing may be left in ``rows``, a table of a few offending groups."""
    listed = F.array_join(F.array_sort(F.collect_set(label)), "; ")
    return _check(rows, name, F.count("*") == 0, listed)


def differs(left: Column, right: Column) -> Column:
    """Values differ beyond the tolerance, or only one of them is missing."""
    return (left.isNull() != right.isNull()) | F.coalesce(F.abs(left - right) > TOLERANCE, F.lit(False))


def prediction_checks(pred: DataFrame, design: DataFrame, p: Params, run_id: str) -> list[DataFrame]:
    until, last = F.lit(p.available_until), F.date_add(F.lit(p.available_until), 1)
    in_time = pred.select(((F.col("target_end") <= last) & (F.col("label_cutoff") == until)).alias("ok"))
    in_design = design.where(F.col("period") == "post").select((F.col("end") <= last).alias("ok"))
    overlap = (design.groupBy("hypothesis_id", "arm", "window_key", "page")
               .agg((F.min("role") != F.max("role")).alias("both")).where("both")
               .groupBy("hypothesis_id", "arm", "window_key").agg(F.count("*").alias("pages")))
    return [
        _check(pred, "prediction_run_id", _all(F.col("run_id") == run_id)),
        _check(duplicate_keys(pred), "prediction_keys_unique", F.count("*") == 0,
               F.concat(F.count("*").cast("string"), F.lit(" duplicated keys"))),
        _check(in_time.unionByName(in_design), "labels_available_at_cutoff", _all(F.col("ok")),
               F.concat(F.lit("a window ends after "), until.cast("string"))),
        _check(design.where(F.col("period") == "pre"), "pre_windows_before_intervention",
               _all(F.col("end") <= F.date_sub("intervention_date", p.buffer_days))),
        _none(overlap, "treated_control_disjoint", F.concat_ws("/", "hypothesis_id", "arm", "window_key"))]


def model_coverage(pred: DataFrame) -> DataFrame:
    """All models of a hypothesis must predict the same page windows."""
    present = pred.select("hypothesis_id", "model").distinct().groupBy("hypothesis_id").agg(F.count("*").alias("models"))
    uneven = (pred.groupBy("hypothesis_id", "arm", "window_key", "page")
              .agg(F.countDistinct("model").alias("covered"))
              .join(F.broadcast(present), "hypothesis_id")
              .where(F.col("covered") != F.col("models")))
    return _none(uneven.select("hypothesis_id").distinct(), "equal_model_coverage", F.col("hypothesis_id"))


def recomputed(tables: dict[str, tuple[DataFrame, DataFrame]], metrics: DataFrame, trend: DataFrame,
               hyp: DataFrame) -> DataFrame:
    """Stored estimates against estimates recomputed from stored predictions, and the trend."""
    keys = ["hypothesis_id", "model"]
    bad = []
    for label, (table, pred) in tables.items():
        stored = table.where(F.col("status") == "estimated").select(*keys, F.col("estimate").alias("stored"))
        again = point_effects(pred, hyp).select(*keys, F.col("estimate").alias("again"))
        bad.append(stored.join(F.broadcast(again), keys, "left").where(differs(F.col("stored"), F.col("again")))
                   .select(F.concat(F.lit(f"{label}:"), F.concat_ws("/", *keys)).alias("problem")))
    described = metrics.where(F.col("kind") == "descriptive").select("hypothesis_id", F.col("estimate").alias("stored"))
    bad.append(described.join(F.broadcast(trend.select("hypothesis_id", "estimate")), "hypothesis_id", "left")
               .where(differs(F.col("stored"), F.col("estimate")))
               .select(F.concat(F.lit("descriptive:"), "hypothesis_id").alias("problem")))
    return _none(reduce(DataFrame.unionByName, bad), "metrics_recomputed_from_predictions", F.col("problem"))


def ablation_matches(metrics: DataFrame, ablation: DataFrame) -> DataFrame:
    """The main model of the ablation is the main evaluation."""
    columns = ["estimate", "ci_low", "ci_high", "ci_low_adj", "ci_high_adj"]

    def did(table, prefix):
        return table.where(F.col("model") == "did").select("hypothesis_id", F.lit(1).alias(f"{prefix}_here"),
                                                           *[F.col(c).alias(f"{prefix}_{c}") for c in columns])

    unequal = reduce(lambda a, b: a | b, [differs(F.col(f"m_{c}"), F.col(f"a_{c}")) for c in columns],
                     F.col("m_here").isNull() | F.col("a_here").isNull())
    return _none(did(metrics, "m").join(did(ablation, "a"), "hypothesis_id", "full_outer").where(unequal),
                 "ablation_reference_matches_metrics", F.col("hypothesis_id"))


def claims_match(claims: DataFrame, metrics: DataFrame, summary: DataFrame, run_id: str) -> DataFrame:
    """Each claim carries the value its table has now."""
    now = (metrics.where(F.col("model").isin("did", "descriptive"))
           .select(F.concat(F.lit("C-"), "hypothesis_id").alias("claim_id"), F.col("estimate").alias("now"))
           .unionByName(summary.agg(F.lit("C-AUDIT").alias("claim_id"),
                                    F.coalesce(F.sum("before"), F.lit(0)).cast("double").alias("now"))))
    wrong = (claims.join(F.broadcast(now.withColumn("here", F.lit(1))), "claim_id", "left")
             .where((F.col("run_id") != run_id) | F.col("here").isNull() | differs(F.col("value"), F.col("now"))))
    return _none(wrong, "claims_match_run", F.col("claim_id"))


def export_matches(export: DataFrame, metrics: DataFrame, run_id: str) -> DataFrame:
    """The result document repeats the evaluation table."""
    schema = ("struct<run_id:string,hypotheses:array<struct<hypothesis_id:string,estimate:double,ci_low_adj:double,"
              "ci_high_adj:double,decision:string>>>")
    columns = ["estimate", "ci_low_adj", "ci_high_adj"]
    told = (export.select(F.from_json("document", schema).alias("d"))
            .select(F.col("d.run_id").alias("told_run"), F.explode("d.hypotheses").alias("h"))
            .select("told_run", "h.hypothesis_id", F.col("h.decision").alias("told_decision"),
                    *[F.col(f"h.{c}").alias(f"told_{c}") for c in columns]))
    both = metrics.select("hypothesis_id", "decision", *columns).join(F.broadcast(told), "hypothesis_id", "left")
    wrong = reduce(lambda a, b: a | b, [differs(F.col(c), F.col(f"told_{c}")) for c in columns],
                   ~F.col("told_run").eqNullSafe(F.lit(run_id)) | ~F.col("decision").eqNullSafe(F.col("told_decision")))
    return _none(both.where(wrong), "export_matches_metrics", F.col("hypothesis_id"))


def hash_matches(actual: DataFrame, column: str, recorded: str, name: str) -> DataFrame:
    """A recomputed hash equals the recorded one."""
    return _check(actual, name, _all(F.col(column) == recorded))


def run_checks(checks: list[DataFrame]) -> DataFrame:
    """All checks and a last row ``passed`` that holds when every one of them does."""
    table = reduce(DataFrame.unionByName, checks)
    failed = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("name")))), "; ")
    return table.unionByName(table.agg(F.lit("passed").alias("name"), F.bool_and("ok").alias("ok"), failed.alias("detail")))
