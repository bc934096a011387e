"""Data-quality rules on a snapshot; every finding is one row (severity, code, file, detail)."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liftlens import constants as C
from liftlens.params import Params, arms, inferential, small_table
from liftlens.session import materialize

ISSUE_COLUMNS = ["severity", "code", "file", "detail"]


def _number(name: str) -> Column:
    """Numeric value of a column; text that is no number becomes null."""
    return F.col(name).try_cast("double")


def _bad_date(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.try_to_date(F.col(name), "yyyy-MM-dd").isNull()
    return F.col(name).isNull()


def _issues(df: DataFrame, code: str, file: str, detail: Column) -> DataFrame:
    return df.select(F.lit("error").alias("severity"), F.lit(code).alias("code"), F.lit(file).alias("file"),
                     detail.cast("string").alias("detail"))


def _found(rows: DataFrame, code: str, file: str, detail: str) -> DataFrame:
    """One finding when there is any row; reading stops at the first."""
    return _issues(rows.limit(1), code, file, F.lit(detail))


def _rule_counts(grouped: GroupedData, rules: list[tuple[str, Column, str]]) -> DataFrame:
    """Rows that break each rule, per group; counting combines before the shuffle."""
    return grouped.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(f"n{i}") for i, (_, bad, _) in enumerate(rules)])


def _counted(counts: DataFrame, file: str, rules: list[tuple[str, Column, str]]) -> DataFrame:
    """Findings of row rules from their counts."""
    totals = counts.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"n{i}") for i in range(len(rules))])
    found = [F.when(F.col(f"n{i}") > 0, F.struct(F.lit("error").alias("severity"), F.lit(code).alias("code"),
                                                  F.lit(file).alias("file"),
                                                  F.format_string(detail, F.col(f"n{i}")).alias("detail")))
             for i, (code, _, detail) in enumerate(rules)]
    return totals.select(F.inline(F.filter(F.array(*found), lambda x: x.isNotNull())))


def _listed(values: DataFrame, code: str, file: str) -> DataFrame:
    """One finding for each distinct unknown value (column ``value``)."""
    return _issues(values.distinct(), code, file, F.coalesce("value", F.lit("")))


def _duplicate(df: DataFrame, keys: list[str], file: str, detail: str) -> DataFrame:
    repeated = df.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)
    return _found(repeated, "duplicate_key", file, detail)


def missing_tables(tables: dict[str, DataFrame]) -> list[dict]:
    """Study tables that are not there; the crawl indexes are checked as files."""
    return [{"severity": "error", "code": "missing_file", "file": name, "detail": "required file is absent"}
            for name in C.SNAPSHOT_FILES if name not in tables and not name.startswith("crawl/")]


def missing_columns(tables: dict[str, DataFrame]) -> list[dict]:
    """Schema check on the driver: columns each table lacks."""
    found = []
    for name, columns in C.SNAPSHOT_FILES.items():
        missing = [c for c in columns if name in tables and c not in tables[name].columns]
        if missing:
            found.append({"severity": "error", "code": "missing_columns", "file": name,
                          "detail": f"missing columns {missing}"})
    return found


def missing_files(spark: SparkSession, hashes: DataFrame, has_hash_list: bool = True) -> DataFrame:
    """Required files that are absent; the hash list is no part of the hashes and is told apart."""
    expected = small_table(spark, [{"path": f} for f in C.REQUIRED_FILES if f != C.HASH_LIST or not has_hash_list],
                           pa.schema([("path", pa.string())]))
    absent = F.broadcast(expected).join(hashes.select("path"), "path", "left_anti")
    return absent.select(F.lit("error").alias("severity"), F.lit("missing_file").alias("code"),
                         F.col("path").alias("file"), F.lit("required file is absent").alias("detail"))


def checksum_issues(actual: DataFrame, declared: DataFrame) -> DataFrame:
    """Full outer difference of actual and declared hashes."""
    both = (actual.withColumnRenamed("sha256", "actual")
            .join(declared.withColumnRenamed("sha256", "declared"), "path", "full_outer"))
    code = (F.when(F.col("declared").isNull(), "checksum_missing")
            .when(F.col("actual").isNull(), "checksum_extra")
            .when(F.col("actual") != F.col("declared"), "checksum_mismatch"))
    detail = (F.when(F.col("declared").isNull(), "file not listed in SHA256SUMS")
              .when(F.col("actual").isNull(), "listed file does not exist")
              .otherwise("content differs from SHA256SUMS"))
    return (both.select(F.lit("error").alias("severity"), code.alias("code"), F.col("path").alias("file"),
                        detail.alias("detail")).where(F.col("code").isNotNull()))


def page_rules(pages: DataFrame, p: Params) -> list[DataFrame]:
    unknown = pages.where(~F.col("design_group").isin([*C.DESIGN_GROUPS, p.control_group]))
    return [_duplicate(pages, ["page"], "pages.csv", "page ids must be unique"),
            _listed(unknown.select(F.col("design_group").alias("value")), "unknown_design_group", "pages.csv")]


def panel_rules(gsc: DataFrame, pages: DataFrame) -> list[DataFrame]:
    """Rules on the daily panel. One pass counts broken rows per page and segment; the row counts and
    the unknown pages and segments are read from that small table. Duplicates take a second pass."""
    file = "gsc_daily.csv"
    clicks, impressions, position = (_number(c) for c in ("clicks", "impressions", "position"))

    def no_count(value):
        return value.isNull() | (value < 0) | (value % 1 != 0)

    rules = [
        ("bad_date", _bad_date(gsc, "date"), "%d rows"),
        ("negative_or_non_integer", no_count(clicks), "clicks: %d rows"),
        ("negative_or_non_integer", no_count(impressions), "impressions: %d rows"),
        ("clicks_gt_impressions", clicks > impressions, "%d rows"),
        ("position_out_of_range", (impressions > 0) & (position.isNull() | (position < 1)), "%d rows"),
        ("position_without_impressions", (impressions == 0) & position.isNotNull(), "%d rows")]
    by_page = materialize(_rule_counts(gsc.groupBy("page", "segment"), rules), "panel_rules")
    unknown_pages = by_page.select("page").distinct().join(pages.select("page"), "page", "left_anti")
    unknown_segments = by_page.where(~F.col("segment").isin(C.SEGMENTS)).select(F.col("segment").alias("value"))
    return [_counted(by_page, file, rules),
            _duplicate(gsc, ["date", "page", "segment"], file, "date/page/segment must be unique"),
            _listed(unknown_pages.select(F.col("page").alias("value")), "unknown_page", file),
            _listed(unknown_segments, "unknown_segment", file)]


def intervention_rules(interventions: DataFrame, pages: DataFrame, p: Params) -> list[DataFrame]:
    file = "interventions.csv"
    unknown = interventions.where(~F.col("type").isin(C.INTERVENTION_TYPES)).select(F.col("type").alias("value"))
    groups = pages.groupBy("page").agg(F.max("design_group").alias("group"))
    site_wide = F.col("type").isin(C.SITE_WIDE_TYPES)
    page_level = interventions.where(~site_wide).join(groups, "page", "left")
    code = (F.when(F.col("group").isNull(), "unknown_page")
            .when(F.col("group") == p.control_group, "control_page_intervened")
            .when(F.col("group") != F.col("type"), "type_group_mismatch"))
    about = F.when(F.col("code") == "type_group_mismatch",
                   F.concat(F.col("type"), F.lit(" on "), F.col("group"), F.lit(" page"))).otherwise(F.col("page"))
    judged = (page_level.withColumn("code", code).where(F.col("code").isNotNull())
              .select(F.lit("error").alias("severity"), "code", F.lit(file).alias("file"),
                      F.concat("intervention_id", F.lit(": "), about).alias("detail")))
    misplaced = interventions.where(site_wide & (F.col("page") != "*"))
    return [_duplicate(interventions, ["intervention_id"], file, "intervention_id must be unique"),
            _found(interventions.where(_bad_date(interventions, "date")), "bad_date", file, "unparseable dates"),
            _listed(unknown, "unknown_type", file),
            _issues(misplaced, "site_wide_page", file, F.concat("intervention_id", F.lit(": use page '*'"))),
            judged]


def lighthouse_rules(lighthouse: DataFrame) -> list[DataFrame]:
    file = "lighthouse.csv"

    def outside(name):
        value = _number(name)
        return value.isNull() | (value < 0) | (value > 100)

    rules = [("score_out_of_range", outside(name), f"{name} must be within 0..100") for name in C.SCORES]
    rules.append(("unknown_snapshot", ~F.col("snapshot").isin(C.SNAPSHOTS), "snapshot must be before/after"))
    return [_flagged(lighthouse, file, rules)]


def _flagged(df: DataFrame, file: str, rules: list[tuple[str, Column, str]]) -> DataFrame:
    """Findings that only say a rule was broken somewhere, all from a single scan."""
    flags = df.agg(*[F.bool_or(F.coalesce(bad, F.lit(False))).alias(f"f{i}") for i, (_, bad, _) in enumerate(rules)])
    found = [F.when(F.col(f"f{i}"), F.struct(F.lit("error").alias("severity"), F.lit(code).alias("code"),
                                              F.lit(file).alias("file"), F.lit(detail).alias("detail")))
             for i, (code, _, detail) in enumerate(rules)]
    return flags.select(F.inline(F.filter(F.array(*found), lambda x: x.isNotNull())))


def authority_rules(authority: DataFrame) -> list[DataFrame]:
    return [_flagged(authority, "authority.csv", [
        ("bad_date", _bad_date(authority, "date"), "unparseable dates"),
        ("non_numeric", _number("value").isNull(), "value must be numeric")])]


def missing_bodies(index: DataFrame, hashes: DataFrame, label: str) -> DataFrame:
    """Crawl index rows that name a body file which is absent."""
    files = hashes.select(F.col("path").alias("body"))
    named = (index.where(F.coalesce(F.col("file"), F.lit("")) != "")
             .withColumn("body", F.concat(F.lit(f"crawl/{label}/"), "file")))
    return _issues(named.join(files, "body", "left_anti"), "missing_file", f"crawl/{label}/index.csv", F.col("file"))


def sample_rules(interventions: DataFrame, pages: DataFrame, hyp: DataFrame, p: Params) -> list[DataFrame]:
    """Each arm and the control group need at least two pages."""
    treated = (interventions.where(~F.col("type").isin(C.SITE_WIDE_TYPES))
               .groupBy("type").agg(F.countDistinct("page").alias("pages")))
    few = (arms(hyp).join(F.broadcast(treated), "type", "left")
           .withColumn("pages", F.coalesce("pages", F.lit(0))).where(F.col("pages") < 2))
    controls = pages.agg(F.count_if(F.col("design_group") == p.control_group).alias("n")).select("n").scalar()
    uncontrolled = inferential(hyp).withColumn("pages", controls).where(F.col("pages") < 2)
    return [_issues(few, "too_few_pages", "interventions.csv",
                    F.format_string("%s: %s has %d treated pages (need >= 2)", "hypothesis_id", "type", "pages")),
            _issues(uncontrolled, "too_few_pages", "pages.csv",
                    F.format_string("%s: control has %d pages", "hypothesis_id", "pages"))]


def validate(tables: dict[str, DataFrame], hyp: DataFrame, p: Params, hashes: DataFrame | None = None,
             declared: DataFrame | None = None) -> DataFrame:
    """All findings on the tables of a snapshot, keyed by their file names.

    File and hash rules apply when the hashes are given; then a missing hash list is a finding too.
    Missing tables or columns end the check early.
    """
    spark = hyp.sparkSession
    absent = missing_tables(tables) or missing_columns(tables)
    if absent:
        return small_table(spark, absent, pa.schema([(c, pa.string()) for c in ISSUE_COLUMNS]))
    pages, gsc, interventions = (tables[f"{n}.csv"] for n in ("pages", "gsc_daily", "interventions"))
    rules = [*page_rules(pages, p), *panel_rules(gsc, pages), *intervention_rules(interventions, pages, p),
             *lighthouse_rules(tables["lighthouse.csv"]), *authority_rules(tables["authority.csv"]),
             *sample_rules(interventions, pages, hyp, p)]
    if hashes is not None:
        rules.append(missing_files(spark, hashes, declared is not None))
        rules += [missing_bodies(tables[f"crawl/{label}/index.csv"], hashes, label)
                  for label in C.SNAPSHOTS if f"crawl/{label}/index.csv" in tables]
    if hashes is not None and declared is not None:
        rules.append(checksum_issues(hashes, declared))
    return reduce(DataFrame.unionByName, rules)
