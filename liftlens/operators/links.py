"""Link graph of a crawl: edges, and the pages reached from a start page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftlens.functions import html as H
from liftlens.functions.urls import normalize_url, page_base
from liftlens.operators.audit import crawled_status
from liftlens.operators.joins import salted_join
from liftlens.operators.page_facts import page_links, with_content
from liftlens.session import BucketedTable, materialize


def edges(crawl: DataFrame) -> DataFrame:
    """Internal links (label, src, dst, anchor_pos) of the pages with content, in anchor order."""
    parsed = (with_content(crawl)
              .select("label", normalize_url(F.col("url")).alias("src"), page_base(F.col("url")).alias("base"),
                      H.start_tags(H.tokens(F.col("html")), "a").alias("anchors"))
              .select("label", "src", "base", H.tags_with_attributes(F.col("anchors")).alias("anchors")))
    return parsed.select("label", "src", F.posexplode(page_links(F.col("anchors"), F.col("base"))).alias("anchor_pos", "dst"))


WALK = ["label", "start"]


def _numbered(rows: DataFrame) -> DataFrame:
    """(label, start, url, at): rows of each walk numbered from 0 in the order of ``place``, and by url where a page that was
    crawled twice has two links at one place.

    Rows are sorted by ranges over all walks; a range numbers its own rows, and what the ranges before it hold of the same
    walk is added, one number for each range and walk in it.
    """
    order = [*WALK, "place", "url"]
    ranges = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("id", F.monotonically_increasing_id()).withColumn("part", F.shiftright("id", 33)), "ranges")
    pieces = ranges.groupBy("part", *WALK).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = Window.partitionBy(*WALK).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = pieces.select("part", *WALK, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return ranges.join(shifts, ["part", *WALK]).select(*WALK, "url", (F.col("id") + F.col("shift")).alias("at"))


def found_next(links: DataFrame, frontier: DataFrame, visited: DataFrame) -> DataFrame:
    """(label, start, url, place): targets of the frontier's pages that their walk has not seen, with the first way to them.

    ``links`` is bucketed by (label, src) and ``visited`` by (label, start, url): only the frontier and what it links to move.
    """
    return (links.join(frontier.select(*WALK, F.col("url").alias("src"), "at"), ["label", "src"])
            .groupBy(*WALK, F.col("dst").alias("url")).agg(F.min(F.struct("at", "anchor_pos")).alias("place"))
            .join(visited.select(*WALK, "url"), [*WALK, "url"], "left_anti"))


def walks(edge_rows: DataFrame, starts: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Breadth-first walks (label, start, url, level, crawl_order) from every row (label, url) of ``starts``, all at once.

    A round takes every walk one level further: targets not seen by their walk are numbered in (parent order, anchor) order and
    appended to the table of pages seen. Only the number of new rows comes to the driver. ``max_pages`` keeps the first pages
    of each walk. A start without links is a walk of one page; repeated starts are one walk.
    """
    spark = edge_rows.sparkSession
    links = BucketedTable(spark, "links", ["label", "src"])
    links.append(edge_rows.select("label", "src", "dst", "anchor_pos"))
    visited = BucketedTable(spark, "visited", [*WALK, "url"])
    begun = starts.select("label", normalize_url(F.col("url")).alias("start")).distinct()
    frontier = materialize(begun.select(*WALK, F.col("start").alias("url"), F.lit(0).cast("long").alias("at")), "frontier")
    level, new = 0, 1
    while new:
        visited.append(frontier.withColumn("level", F.lit(level)))
        if max_pages is not None:
            full = visited.read().groupBy(*WALK).agg(F.count("*").alias("n")).where(F.col("n") >= max_pages)
            frontier = frontier.join(full, WALK, "left_anti")
        level += 1
        frontier = materialize(_numbered(found_next(links.read(), frontier, visited.read())), "frontier")
        new = frontier.count()
    seen = visited.read()
    sizes = seen.groupBy(*WALK, "level").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*WALK).orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*WALK, "level", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    out = salted_join(seen, shifts, [*WALK, "level"], ["url"]).select(
        *WALK, "url", "level", (F.col("at") + F.col("shift")).cast("int").alias("crawl_order"))
    return out if max_pages is None else out.where(F.col("crawl_order") < max_pages)


def with_status(pages: DataFrame, crawl: DataFrame) -> DataFrame:
    """Pages (label, url, ...) with the status of the crawl; unknown urls count as 404."""
    found = salted_join(pages, crawled_status(crawl), ["label", "url"], ["start"], "left")
    return found.withColumn("status", F.coalesce("status", F.lit(404)))


def reachable(edge_rows: DataFrame, crawl: DataFrame, start_url: str, max_pages: int | None = None) -> DataFrame:
    """Pages reached from ``start_url`` in each label of the crawl, in breadth-first order; unknown urls are not followed."""
    starts = crawl.select("label").distinct().withColumn("url", F.lit(start_url))
    return with_status(walks(edge_rows, starts, max_pages), crawl).select("label", "crawl_order", "url", "level", "status")
