"""Study tables derived from the driver's ``events`` and ``pages`` tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from liftlens import constants as C
from liftlens.functions.urls import normalize_url, page_base, resolve_link, url_parts
from liftlens.params import Hypothesis, Params

STUDY = Params(
    analysis_cutoff=date(2024, 1, 30), gsc_lag_days=3, pre_days=8, buffer_days=1, ramp_days=2, post_days=8,
    min_post_days=5, min_days_per_window=4, placebo_shift_days=8, bootstrap_reps=200,
    hypotheses=(
        Hypothesis("H1", "did", "technical", "position", threshold=0.20, statement="Technical changes help"),
        Hypothesis("H2", "did", "content", "ctr_adjusted", threshold=0.15, statement="Content changes help"),
        Hypothesis("H3", "did_difference", "local", "clicks", segment="local", compare_to="content",
                   threshold=0.0, statement="Local beats content"),
        Hypothesis("H4", "did", "accessibility", "position", threshold=0.0, statement="Accessibility helps"),
        Hypothesis("H5", "descriptive", "links", "domain_authority", threshold=10.0, horizon_days=183,
                   statement="Links raise authority", limitation="one site"),
    ))


#: A further hypothesis, on a kind of change that no page has.
RARE = Hypothesis("H6", "did", "links", "position", threshold=0.0, statement="Links help pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _page_id(user: F.Column) -> F.Column:
    digits = user.cast("string")
    return F.concat(F.lit("U"), F.lpad(digits, F.greatest(F.length(digits), F.lit(6)), F.lit("0")))


def users(events: DataFrame) -> DataFrame:
    """The users seen in the events; each one stands for a page of the site."""
    return events.select("user_id").distinct()


def pages(users: DataFrame) -> DataFrame:
    group = F.element_at(F.array(*[F.lit(g) for g in [*C.DESIGN_GROUPS, STUDY.control_group]]),
                         (F.col("user_id") % 5 + 1).cast("int"))
    return users.select(_page_id(F.col("user_id")).alias("page"),
                        F.concat(F.lit("https://site.test/u/"), F.col("user_id").cast("string"), F.lit("/")).alias("url"),
                        group.alias("design_group"))


def gsc_daily(events: DataFrame, users: DataFrame) -> DataFrame:
    """Daily rows for every page, segment and day. The empty grid joins the raw rows before the
    grouping, so map-side partial sums absorb hot users and one shuffle does all."""
    day = F.to_date("ts")
    segment = F.when(F.get_json_object("props", "$.k").cast("int") < 50, "local").otherwise("general")
    seen = events.select(day.alias("date"), _page_id(F.col("user_id")).alias("page"), segment.alias("segment"),
                         (F.col("event_type") == "click").cast("bigint").alias("clicks"),
                         F.lit(1).cast("bigint").alias("impressions"),
                         (1 + F.col("value") / 5).alias("position"))
    span = events.agg(F.min(day).alias("first"), F.max(day).alias("last"))
    days = F.sequence(span.select("first").scalar(), span.select("last").scalar())
    grid = (users.select(_page_id(F.col("user_id")).alias("page"), F.explode(days).alias("date"))
            .select("date", "page", F.explode(F.array(*[F.lit(s) for s in C.SEGMENTS])).alias("segment"),
                    F.lit(0).cast("bigint").alias("clicks"), F.lit(0).cast("bigint").alias("impressions"),
                    F.lit(None).cast("double").alias("position")))
    return (seen.unionByName(grid).groupBy("date", "page", "segment")
            .agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"),
                 F.avg("position").alias("position")))


def interventions(users: DataFrame) -> DataFrame:
    user = F.col("user_id")
    changed = users.where(user % 5 < 4)
    kinds = F.array(*[F.lit(g) for g in C.DESIGN_GROUPS])
    shift = (user % 5 + F.floor(user / 10) % 2).cast("int")
    page_level = changed.select(
        F.concat(F.lit("I"), user.cast("string")).alias("intervention_id"), _page_id(user).alias("page"),
        F.element_at(kinds, (user % 5 + 1).cast("int")).alias("type"),
        F.date_add(F.lit(date(2024, 1, 18)), shift).alias("date"), F.lit("").alias("description"))
    site_wide = users.sparkSession.range(1).select(
        F.lit("L01").alias("intervention_id"), F.lit("*").alias("page"), F.lit("links").alias("type"),
        F.lit(date(2024, 1, 20)).alias("date"), F.lit("").alias("description"))
    return page_level.unionByName(site_wide)


def authority(events: DataFrame) -> DataFrame:
    """A slowly growing site score; the running total is over daily counts, one row per day."""
    daily = (events.groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias("n"))
             .withColumn("metric", F.lit("domain_authority")))
    running = Window.partitionBy("metric").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(Window.partitionBy("metric"))
    value = F.floor(F.sum("n").over(running) / (total / 30)).cast("double")
    return daily.select("date", "metric", F.lit("events").alias("source"), value.alias("value"))


def _hashed(text: F.Column, modulus: int) -> F.Column:
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % modulus).cast("int")


def lighthouse(users: DataFrame) -> DataFrame:
    def drawn(measure, modulus):
        return _hashed(F.concat_ws("|", F.col("user_id").cast("string"), "snapshot", F.lit(measure)), modulus)

    rows = users.select("user_id", F.explode(F.array(*[F.lit(s) for s in C.SNAPSHOTS])).alias("snapshot"))
    return rows.select(
        _page_id(F.col("user_id")).alias("page"), "snapshot",
        F.when(F.col("snapshot") == "before", F.lit(date(2024, 1, 10))).otherwise(F.lit(date(2024, 1, 28))).alias("date"),
        *[drawn(m, 101).alias(m) for m in C.SCORES], (drawn("lcp_ms", 4000) + 500).alias("lcp_ms"),
        (drawn("cls", 300) / 1000).alias("cls"), drawn("inp_ms", 400).alias("inp_ms"))


# Markup added to stored pages by page number, so that every audit rule meets pages that break it and pages
# that keep it: {(modulus, remainder): text}, before the end of the head and after the start of the body.
HEAD_PARTS = {
    (7, 3): '<meta name="robots" content="noindex">',
    (7, 4): '<script type="application/ld+json">[{"@type":"Article"},{"@type":["Shop","Place"]},3]</script>',
    (7, 5): '<script type="application/ld+json">{"@type":</script>',
    (7, 6): '<script type="application/ld+json">{"@type":"Offer"}</script>',
    (13, 7): '<meta name="description" content="' + "many words " * 16 + '">',
}
BODY_PARTS = {
    (6, 1): '<img src="a.png"><img src="b.png" alt="">',
    (6, 2): "<h1>Once more</h1>",
    (6, 3): "<h2>Part</h2><h4>Detail</h4>",
    (6, 4): '<a href="/silent"> </a>',
    (6, 5): '<form><input type="text" name="a"><label>Name <input type="text"></label><input type="hidden" name="b">'
            '<select aria-label="size"></select></form>',
}
SHORT_TITLE = "<title>Short</title>"
LONG_TITLE = "<title>A title that goes on and on until nobody can read all of it in a list of results</title>"


def shaped(key: F.Column, html: F.Column) -> F.Column:
    """The html of a stored page with its markup parts; some pages lose their language, first heading or title."""
    def part(parts):
        return F.concat(*[F.when(key % m == r, text).otherwise("") for (m, r), text in parts.items()])

    html = F.when(key % 11 == 5, F.regexp_replace(html, '<html lang="[^"]*">', "<html>")).otherwise(html)
    html = F.when(key % 13 == 4, F.regexp_replace(html, "<(/?)h1>", "<$1h2>")).otherwise(html)
    html = F.when((key % 13).isin(5, 6, 8), F.regexp_replace(html, "(?s)<title>.*?</title>",
                                                          F.when(key % 13 == 6, LONG_TITLE).when(key % 13 == 8, SHORT_TITLE).otherwise(""))).otherwise(html)
    html = F.concat(F.substring_index(html, "</head>", 1), part(HEAD_PARTS), F.lit("</head>"),
                    F.substring_index(html, "</head>", -1))
    return F.concat(F.substring_index(html, "<body>", 1), F.lit("<body>"), part(BODY_PARTS), F.substring_index(html, "<body>", -1))


def _origin(url: F.Column) -> F.Column:
    parts = url_parts(url)
    return F.concat(parts["scheme"], F.lit("://"), parts["host"])


def first_pages(raw_pages: DataFrame) -> DataFrame:
    """(label, url) of the page with the smallest id of each origin, in both crawls: where walks over the site start."""
    first = raw_pages.groupBy(_origin(F.col("url")).alias("origin")).agg(F.min_by("url", "page_id").alias("url"))
    return first.select(F.explode(F.array(*[F.lit(s) for s in C.SNAPSHOTS])).alias("label"), "url")


def doors(raw_pages: DataFrame) -> DataFrame:
    """(src, dst, n): page n of an origin, by id, opens on its pages 2n and 2n + 1; pages that share a url share their doors."""
    order = Window.partitionBy("origin").orderBy("page_id")
    listed = (raw_pages.select("page_id", normalize_url(F.col("url")).alias("url"), _origin(F.col("url")).alias("origin"))
              .withColumn("n", F.row_number().over(order)))
    opened = listed.where("n > 1").select("origin", F.expr("cast(n div 2 as int)").alias("own"), F.col("url").alias("dst"), "n")
    return listed.select("origin", F.col("n").alias("own"), F.col("url").alias("src")).join(opened, ["origin", "own"]).select("src", "dst", "n")


def crawl(raw_pages: DataFrame) -> DataFrame:
    """Before and after crawls of the stored pages, plus the statuses of the linked targets."""
    key = F.col("page_id")
    raw_pages = raw_pages.select("page_id", "url", shaped(key, F.col("html")).alias("html"))
    gone = key % 23 == 0
    head = F.concat(
        F.lit("<head>"),
        F.when(key % 5 < 2, F.concat(F.lit('<meta name="viewport" content="w"><link rel="canonical" href="'),
                                     F.col("url"), F.lit('">'))).otherwise(""),
        F.when((key % 5).isin(1, 2), F.concat(F.lit('<meta name="description" content="Page '),
                                              (key % 40).cast("string"), F.lit('">'))).otherwise(""))
    labels = F.explode(F.array(*[F.lit(s) for s in C.SNAPSHOTS]))
    after = F.concat(F.substring_index("html", "<head>", 1), head,
                     F.expr("substring(html, instr(html, '<head>') + 6)"))
    base = (raw_pages.select("page_id", "url", "html", labels.alias("label"))
            .select("label", "url", F.when(gone, 404).otherwise(200).alias("status"),
                    F.lit("text/html").alias("content_type"),
                    F.when(gone, "").when(F.col("label") == "after", after).otherwise(F.col("html")).alias("html"),
                    key.alias("seq")))
    hrefs = F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)))
    own = base.select("label", normalize_url(F.col("url")).alias("url")).distinct()
    targets = (base.where(F.length("html") > 0)
               .select("label", page_base(F.col("url")).alias("base"), hrefs.alias("href"))
               .select("label", "base", "href", resolve_link(F.col("base"), F.col("href")).alias("link"))
               .where(F.col("link.host") == F.col("base.host"))
               .groupBy("label", F.col("link.url").alias("url")).agg(F.max(F.length("href")).alias("size"))
               .join(own, ["label", "url"], "left_anti")
               .select("label", "url", F.when(F.col("size") % 7 == 0, 404).otherwise(200).alias("status"),
                       F.lit("text/html").alias("content_type"), F.lit("").alias("html"),
                       F.lit(None).cast("bigint").alias("seq")))
    return base.unionByName(targets)


def query_rows(events: DataFrame) -> DataFrame:
    """Query-level rows: the event type and its number stand in for the search text."""
    return events.select(
        F.to_date("ts").alias("date"), _page_id(F.col("user_id")).alias("page"),
        F.concat_ws(" ", "event_type", F.get_json_object("props", "$.k")).alias("query"),
        (F.col("event_type") == "click").cast("bigint").alias("clicks"), F.lit(1).cast("bigint").alias("impressions"),
        (1 + F.col("value") / 5).alias("position"))


def _at(day: int, user: int, segment: str | None = None) -> F.Column:
    here = (F.col("date") == F.lit(date(2024, 1, day))) & (F.col("page") == _page_id(F.lit(user)))
    return here if segment is None else here & (F.col("segment") == segment)


def damaged_tables(gsc: DataFrame, users: DataFrame, site: DataFrame) -> dict[str, DataFrame]:
    """Whole study tables with a few broken rows, at least one per rule."""
    again = gsc.where(_at(8, 7, "local"))
    number = F.col("clicks").cast("double")
    broken = gsc.unionByName(again).select(
        F.when(_at(7, 6), "soon").otherwise(F.col("date").cast("string")).alias("date"),
        F.when(_at(4, 3, "local"), "P99").otherwise(F.col("page")).alias("page"),
        F.when(_at(6, 5, "local"), "brand").otherwise(F.col("segment")).alias("segment"),
        F.when(_at(2, 1, "local"), F.col("impressions") + 1).when(_at(9, 8, "local"), 0)
        .when(_at(10, 9, "general"), 1.5).otherwise(number).alias("clicks"),
        F.when(_at(3, 2, "general"), -1).when(_at(5, 4, "local"), F.greatest("impressions", F.lit(1)))
        .when(_at(9, 8, "local"), 0).otherwise(F.col("impressions")).alias("impressions"),
        F.when(_at(5, 4, "local"), 0.5).when(_at(9, 8, "local"), 3.0).otherwise(F.col("position")).alias("position"))
    spark = users.sparkSession
    extra = [("IX1", "U000004", "technical", "2024-01-18"), ("IX2", "P98", "content", "2024-01-18"),
             ("IX3", "U000000", "content", "2024-01-18"), ("IX4", "U000001", "links", "2024-01-18"),
             ("IX5", "U000002", "brand", "2024-01-18"), ("I0", "U000000", "technical", "2024-01-18"),
             ("IX6", "U000000", "technical", "soon")]
    rows = spark.range(1).select(F.inline(F.array(*[F.struct(
        *[F.lit(v).alias(n) for n, v in zip(("intervention_id", "page", "type", "date"), row)]) for row in extra])))
    changes = (interventions(users)
               .select("intervention_id", "page", "type", F.col("date").cast("string").alias("date"), "description")
               .unionByName(rows.withColumn("description", F.lit(""))))
    listed = pages(users)
    odd = spark.range(1).select(F.lit("P77").alias("page"), F.lit("https://site.test/x/").alias("url"),
                                F.lit("mystery").alias("design_group"))
    before = F.col("snapshot") == "before"
    scores = lighthouse(users).select(
        "page", F.when(before & (F.col("page") == "U000001"), "mid").otherwise(F.col("snapshot")).alias("snapshot"), "date",
        F.when(before & (F.col("page") == "U000000"), 101).otherwise(F.col("performance")).alias("performance"),
        "accessibility", F.when(~(before & (F.col("page") == "U000002")), F.col("seo")).alias("seo"),
        "lcp_ms", "cls", "inp_ms")
    site = site.select(F.col("date").cast("string").alias("date"), "metric", "source",
                                    F.col("value").cast("string").alias("value"))
    bad = site.limit(0).unionByName(spark.range(1).select(
        F.lit("soon").alias("date"), F.lit("domain_authority").alias("metric"), F.lit("events").alias("source"),
        F.lit("n/a").alias("value")))
    return {"pages.csv": listed.unionByName(listed.where(F.col("page") == "U000000")).unionByName(odd),
            "gsc_daily.csv": broken, "interventions.csv": changes, "lighthouse.csv": scores,
            "authority.csv": site.unionByName(bad)}
