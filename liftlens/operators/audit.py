"""Audit issues: rules on single pages, and rules across pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftlens import constants as C
from liftlens.functions.binding import constant_map
from liftlens.functions.urls import normalize_url
from liftlens.operators.joins import salted_join

ISSUE_COLUMNS = ["label", "url", "issue", "category", "detail"]


def _with_category(rows: DataFrame) -> DataFrame:
    known = constant_map({issue: category for category, issues in C.ISSUES_BY_CATEGORY.items() for issue in issues})
    return rows.withColumn("category", known[F.col("issue")]).select(ISSUE_COLUMNS)


def _issue(condition: Column, name: str, detail: Column | None = None) -> Column:
    text = F.lit("") if detail is None else detail.cast("string")
    return F.when(condition, F.struct(F.lit(name).alias("issue"), text.alias("detail")))


def _first(*rules: Column) -> Column:
    """The first rule that applies."""
    return F.coalesce(*rules)


def page_issues(facts: DataFrame) -> DataFrame:
    """Issues read from the facts of one page; of rules about one subject only the first counts."""
    c = F.col
    rules = [
        _first(_issue(c("title_length") == 0, "missing_title"),
               _issue(c("title_length") < C.TITLE_MIN, "title_too_short", c("title_length")),
               _issue(c("title_length") > C.TITLE_MAX, "title_too_long", c("title_length"))),
        _first(_issue(c("meta_description_length") == 0, "missing_meta_description"),
               _issue(c("meta_description_length") > C.META_DESCRIPTION_MAX, "meta_description_too_long",
                      c("meta_description_length"))),
        _first(_issue(c("h1_count") == 0, "missing_h1"), _issue(c("h1_count") > 1, "multiple_h1", c("h1_count"))),
        _issue(~c("has_canonical"), "missing_canonical"),
        _issue(~c("has_viewport"), "missing_viewport"),
        _issue(c("noindex"), "noindex"),
        _issue(c("lang") == "", "missing_lang"),
        _issue(c("img_missing_alt") > 0, "img_missing_alt", c("img_missing_alt")),
        _issue(c("heading_level_skips") > 0, "heading_level_skip", c("heading_level_skips")),
        _issue(c("inputs_without_label") > 0, "input_missing_label", c("inputs_without_label")),
        _issue(c("empty_link_text") > 0, "empty_link_text", c("empty_link_text")),
        _first(_issue(c("invalid_structured_data") > 0, "invalid_structured_data", c("invalid_structured_data")),
               _issue(c("structured_data_types") == "", "missing_structured_data")),
    ]
    return _with_category(facts.select("label", "url", F.inline(F.filter(F.array(*rules), lambda r: r.isNotNull()))))


def http_errors(crawl: DataFrame) -> DataFrame:
    return _with_category(crawl.where(F.col("status") >= 400).select(
        "label", normalize_url(F.col("url")).alias("url"), F.lit("http_error").alias("issue"),
        F.col("status").cast("string").alias("detail")))


def crawled_status(crawl: DataFrame) -> DataFrame:
    """Status per label and normalized url; of repeated urls the last in crawl order counts."""
    order = F.coalesce(F.col("seq"), F.lit(0)) if "seq" in crawl.columns else F.lit(0)
    return (crawl.groupBy("label", normalize_url(F.col("url")).alias("url"))
            .agg(F.max_by("status", F.struct(order, F.col("status"))).alias("status")))


def broken_links(facts: DataFrame, crawl: DataFrame) -> DataFrame:
    """Internal links whose target was crawled with an error; targets never crawled are fine.

    Only the error rows of the crawl enter the join. A broken link in a site-wide footer makes one
    target hot, so the join is salted by the linking page.
    """
    links = facts.select("label", "url", F.explode("links").alias("target"))
    failed = (crawled_status(crawl).where(F.col("status") >= 400)
              .select("label", F.col("url").alias("target")))
    return _with_category(salted_join(links, failed, ["label", "target"], ["url"])
                          .select("label", "url", F.lit("broken_internal_link").alias("issue"),
                                  F.col("target").alias("detail")))


def duplicates(facts: DataFrame, column: str, issue: str) -> DataFrame:
    """Pages that share a value with another indexable page, one row per page.

    Counts combine before their shuffle, and the join back is salted: a title shared by a third of
    all pages is split over many tasks.
    """
    indexable = facts.where(~F.col("noindex") & (F.col(column) != "")).select("label", "url", F.col(column).alias("shared"))
    counts = indexable.groupBy("label", "shared").agg(F.count("*").alias("pages")).where(F.col("pages") > 1)
    return _with_category(salted_join(indexable, counts, ["label", "shared"], ["url"])
                          .select("label", "url", F.lit(issue).alias("issue"),
                                  F.concat(F.lit("shared by "), F.col("pages").cast("string"), F.lit(" pages")).alias("detail")))


def site_issues(facts: DataFrame, crawl: DataFrame) -> DataFrame:
    """All issues of a crawl."""
    return (http_errors(crawl)
            .unionByName(page_issues(facts))
            .unionByName(broken_links(facts, crawl))
            .unionByName(duplicates(facts, "title", "duplicate_title"))
            .unionByName(duplicates(facts, "meta_description", "duplicate_meta_description")))


def attach_page(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Page id by url, empty when the url is not a listed page."""
    listed = pages.groupBy("url").agg(F.max("page").alias("page"))
    return (rows.join(listed, "url", "left")
            .withColumn("page", F.coalesce("page", F.lit("")))
            .select("page", *rows.columns))
