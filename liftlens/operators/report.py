"""Summary tables, claims and the result document."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftlens import constants as C
from liftlens.functions.binding import constant_map
from liftlens.functions.stats import percent
from liftlens.params import Params, small_table


def audit_summary(issues: DataFrame) -> DataFrame:
    """Issue counts before and after."""
    return issues.groupBy("category", "issue").agg(
        *[F.count_if(F.col("label") == label).alias(label) for label in C.SNAPSHOTS])


def category_totals(summary: DataFrame) -> DataFrame:
    """Before and after totals of each category, zero where nothing was found."""
    listed = small_table(summary.sparkSession, [{"category": c} for c in C.CATEGORIES],
                         pa.schema([("category", pa.string())]))
    totals = summary.groupBy("category").agg(*[F.sum(s).alias(s) for s in C.SNAPSHOTS])
    return listed.join(F.broadcast(totals), "category", "left").fillna(0, C.SNAPSHOTS)


def lighthouse_summary(lighthouse: DataFrame, pages: DataFrame) -> DataFrame:
    """Exact median of every measure by design group and snapshot.

    Equal values are counted first, so a group's median sees each measured value once with its
    frequency and not one entry per page.
    """
    measured = (lighthouse.join(pages.select("page", "design_group"), "page")
                .select("design_group", "snapshot", F.inline(F.array(*[
                    F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in C.MEASURES])))
                .where(F.col("value").isNotNull())
                .groupBy("design_group", "snapshot", "measure", "value").agg(F.count("*").alias("pages")))
    medians = measured.groupBy("design_group", "snapshot", "measure").agg(
        F.percentile("value", 0.5, F.col("pages")).alias("median"))
    return medians.groupBy("design_group", "snapshot").agg(
        *[F.max(F.when(F.col("measure") == m, F.col("median"))).alias(m) for m in C.MEASURES])


def hypothesis_table(metrics: DataFrame, hyp: DataFrame) -> DataFrame:
    """Evaluation rows with the statement of their hypothesis."""
    return metrics.join(F.broadcast(hyp.select("hypothesis_id", "statement")), "hypothesis_id", "left")


def effect_rows(metrics: DataFrame) -> DataFrame:
    """Estimated effects and intervals in percent."""
    values = ["estimate", "ci_low", "ci_high", "ci_low_adj", "ci_high_adj", "threshold"]
    return (metrics.where((F.col("kind") != "descriptive") & (F.col("status") == "estimated"))
            .select("hypothesis_id", "model", "metric", "decision", *[(F.col(v) * 100).alias(v) for v in values]))


def claims(metrics: DataFrame, summary: DataFrame, hyp: DataFrame, p: Params, run_id: str) -> DataFrame:
    """One checkable sentence per evaluation row, and one on the audit totals."""
    c = F.col
    estimated = c("status") == "estimated"
    text = F.when(estimated, F.format_string(
        C.CLAIM_ESTIMATED, c("hypothesis_id"), percent(c("estimate")), c("ci_level_adj") * 100,
        percent(c("ci_low_adj")), percent(c("ci_high_adj")), c("decision"))).otherwise(
        F.format_string(C.CLAIM_OTHER, c("hypothesis_id"), c("decision"), c("note")))
    interval = F.when(estimated, F.format_string("[%.6f; %.6f]", c("ci_low_adj"), c("ci_high_adj"))).otherwise("")
    synthetic = C.CLAIM_SYNTHETIC_LIMIT if p.mode == "synthetic" else ""
    limits = F.array_join(F.filter(F.array(c("limitation"), F.lit(synthetic)), lambda x: x != ""), "; ")
    section = F.coalesce(constant_map(C.CLAIM_SECTIONS)[c("hypothesis_id")], F.lit(C.CLAIM_OTHER_SECTION))
    condition = F.format_string("hypothesis_id == '%s' and model == '%s'", c("hypothesis_id"), c("model"))
    rows = (metrics.join(F.broadcast(hyp.select("hypothesis_id", "limitation")), "hypothesis_id")
            .select(F.concat(F.lit("C-"), "hypothesis_id").alias("claim_id"), section.alias("section"),
                    text.alias("statement"), F.lit(run_id).alias("run_id"),
                    F.lit(C.CLAIM_METRICS_FILE).alias("file"), condition.alias("filter"),
                    F.lit("estimate").alias("metric"), c("estimate").alias("value"), interval.alias("interval"),
                    limits.alias("limitation")))
    totals = summary.agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in C.SNAPSHOTS])
    audit = totals.select(
        F.lit("C-AUDIT").alias("claim_id"), F.lit(C.CLAIM_AUDIT_SECTION).alias("section"),
        F.format_string(C.CLAIM_AUDIT, "before", "after").alias("statement"), F.lit(run_id).alias("run_id"),
        F.lit(C.CLAIM_AUDIT_FILE).alias("file"), F.lit("all rows").alias("filter"),
        F.lit("sum(before)").alias("metric"), c("before").cast("double").alias("value"), F.lit("").alias("interval"),
        F.lit(C.CLAIM_AUDIT_LIMIT).alias("limitation"))
    return rows.unionByName(audit)


def _records(table: DataFrame, *order: str) -> Column:
    """A small table as a sorted list of records, read as a scalar subquery."""
    keys = F.struct(*[F.col(c) for c in order])
    entries = F.array_sort(F.collect_list(F.struct(keys.alias("order"), F.struct(*table.columns).alias("row"))))
    return table.agg(F.transform(entries, lambda e: e["row"]).alias("records")).select("records").scalar()


def series_records(series: DataFrame, hyp: DataFrame, p: Params) -> DataFrame:
    """One record per hypothesis series: what it measures, and its values in week order."""
    points = F.array_sort(F.collect_list(F.struct("week", "value")))
    grouped = series.groupBy("hypothesis_id", "name", "role").agg(points.alias("points"))
    return grouped.join(F.broadcast(hyp.select("hypothesis_id", "metric")), "hypothesis_id").select(
        "hypothesis_id", "name", "role", "metric", constant_map(C.METRIC_LABELS)[F.col("metric")].alias("metric_label"),
        (F.col("metric") == "position").alias("lower_is_better"), F.lit(-(-p.ramp_days // 7)).alias("ramp_weeks"),
        F.transform("points", lambda x: x["week"]).alias("weeks"), F.transform("points", lambda x: x["value"]).alias("values"))


def result_export(metrics: DataFrame, series: DataFrame, ablation: DataFrame, placebo: DataFrame, summary: DataFrame,
                  lighthouse: DataFrame, authority: DataFrame, curve: DataFrame, train_end: DataFrame, period: DataFrame, hyp: DataFrame,
                  p: Params, run_id: str, data_sha256: str | None = None,
                  truth: dict[str, float] | None = None) -> DataFrame:
    """One row with the result document as JSON; missing numbers are null.

    Every part is a report table, bounded by the hypotheses, weeks, issue names, design groups and the
    site-level score series. ``truth`` holds known effects of a synthetic scenario, if any.
    """
    model_label = constant_map(C.MODEL_LABELS)[F.col("model")]
    spark = metrics.sparkSession
    document = F.struct(
        F.lit(1).alias("schema_version"), F.lit(p.mode).alias("mode"), F.lit(C.MODE_LABELS[p.mode]).alias("mode_label"),
        F.lit(run_id).alias("run_id"), F.lit(C.EFFECT_MODEL).alias("model_version"),
        period.select(F.struct("start", "end").alias("period")).scalar().alias("data_period"),
        F.lit(p.analysis_cutoff).alias("analysis_cutoff"), F.lit(p.available_until).alias("available_until"),
        F.lit(data_sha256).cast("string").alias("data_sha256"), F.lit(p.bootstrap_reps).alias("bootstrap_reps"),
        _records(hypothesis_table(metrics, hyp), "hypothesis_id").alias("hypotheses"),
        _records(series_records(series, hyp, p), "hypothesis_id", "role", "name").alias("series"),
        _records(ablation.withColumn("model_label", model_label), "hypothesis_id", "model").alias("ablation"),
        _records(placebo, "hypothesis_id").alias("placebo"),
        _records(summary, "category", "issue").alias("audit"),
        _records(lighthouse, "design_group", "snapshot").alias("lighthouse"),
        _records(authority, "date", "metric", "source").alias("authority"),
        _records(curve, "bin").alias("ctr_curve"),
        F.struct(F.lit(C.CTR_MODEL).alias("model_version"), train_end.select("train_end").scalar().alias("train_end_exclusive"),
                 F.lit(p.available_until).alias("available_until")).alias("ctr_model"),
        F.from_json(F.lit(json.dumps(truth)), "map<string,double>").alias("truth"))
    return spark.range(1).select(F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))


#: Levels of the document below its root: parts, records, their fields, and the entries of lists in them.
DOCUMENT_DEPTH = 4


def document_fields(export: DataFrame) -> DataFrame:
    """(path, number, text) of every leaf of result documents: ``audit[3].issue``, ``series[0].weeks[2]``.

    Numbers stand in ``number``; texts, dates and truth values in ``text``; both are null for a null. An empty list has no row.
    """
    rows = export.select(F.lit("").alias("path"), F.parse_json("document").alias("v"))
    out = None
    for _ in range(DOCUMENT_DEPTH):
        each = rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("v").outer())).select(
            F.concat("path", F.when(F.col("key").isNull(), F.format_string("[%d]", "pos"))
                     .when(F.col("path") == "", F.col("key")).otherwise(F.concat(F.lit("."), "key"))).alias("path"), F.col("value").alias("v"))
        kind = F.schema_of_variant("v")
        nested = kind.startswith("ARRAY") | kind.startswith("OBJECT")
        numeric = kind.startswith("BIGINT") | kind.startswith("DECIMAL") | kind.startswith("DOUBLE")
        leaves = each.where(~nested).select(
            "path", F.when(numeric, F.try_variant_get("v", "$", "double")).alias("number"),
            F.when(~numeric, F.try_variant_get("v", "$", "string")).alias("text"))
        out = leaves if out is None else out.unionByName(leaves)
        rows = each.where(nested)
    return out


def document_differences(left: DataFrame, right: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(path, left, right) of the leaves in which two tables of document fields differ, or that only one of them has."""
    def told(fields, side):
        return fields.select("path", F.struct("number", "text").alias(side))

    number = F.coalesce(F.abs(F.col("left.number") - F.col("right.number")) <= tolerance,
                        F.col("left.number").isNull() & F.col("right.number").isNull())
    same = number & F.col("left.text").eqNullSafe(F.col("right.text")) & F.col("left").isNotNull() & F.col("right").isNotNull()
    return told(left, "left").join(told(right, "right"), "path", "full_outer").where(~same)
