"""On-page facts of crawled HTML: one row per page with content, as one narrow pass over the crawl."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftlens import constants as C
from liftlens.functions import html as H
from liftlens.functions.binding import let, record
from liftlens.functions.urls import normalize_url, page_base, resolve_link

FACT_COLUMNS = ["label", "url", "title", "title_length", "meta_description", "meta_description_length", "h1_count",
                "heading_level_skips", "has_canonical", "has_viewport", "noindex", "lang", "img_count",
                "img_missing_alt", "structured_data_types", "invalid_structured_data", "internal_links",
                "empty_link_text", "inputs_without_label"]
_READ_TAGS = ["html", "title", "meta", "link", "h[1-6]", "img", "a", "label", *C.CONTROL_TAGS]
_ANCHOR = r"(?is)<a(?=[\s/>])(?:(?!<a[\s/>]|</a[\s>]).)*+"


def with_content(crawl: DataFrame) -> DataFrame:
    """Pages that can be audited: no error status and a body."""
    return crawl.where((F.col("status") < 400) & (F.length("html") > 0))


def _count(items: Column) -> Column:
    return F.size(items).cast("int")


def _meta(metas: Column, name: str) -> Column:
    """Content of the first meta tag called ``name`` in any case; null when there is none."""
    found = F.filter(metas, lambda m: F.lower(H.attribute(m["attrs"], "name")) == name)
    first = F.try_element_at(found, F.lit(1))
    return F.when(F.size(found) > 0, F.coalesce(H.attribute_text(first["attrs"], "content"), F.lit("")))


def page_links(html_tags: Column, base: Column) -> Column:
    """Internal targets of the anchors in document order, normalized."""
    hrefs = F.filter(
        F.transform(html_tags, lambda a: H.strip(H.attribute_text(a["attrs"], "href"))),
        lambda h: h.isNotNull() & ~h.rlike("^(?:" + "|".join(C.NON_PAGE_LINK_PREFIXES) + ")"))
    resolved = F.filter(F.transform(hrefs, lambda h: resolve_link(base, h)), lambda link: link["host"] == base["host"])
    return F.transform(resolved, lambda link: link["url"])


def _has_no_text(anchor: Column) -> Column:
    """A link with a target, but without text, own name and alternative text of its images. The text,
    which nearly every link has, is tested first."""
    attrs = H.attributes(anchor)
    images = H.tags_with_attributes(H.start_tags(H.tokens(anchor), "img"))
    alts = F.transform(images, lambda i: H.strip(F.coalesce(H.attribute_text(i["attrs"], "alt"), F.lit(""))))
    return ((H.text_of(anchor) == "")
            & let(attrs, lambda a: H.attribute(a, "href").isNotNull()
                  & (H.strip(F.coalesce(H.attribute_text(a, "aria-label"), F.lit(""))) == ""))
            & (H.strip(F.array_join(alts, " ")) == ""))


def _unlabelled(form_tokens: Column, label_ids: Column) -> Column:
    """Form controls outside any label, without an own name and without a label that points at them."""
    start = record(depth=F.lit(0), loose=F.array().cast("array<string>"))

    def step(state, token):
        depth = (F.when(H.is_tag(token, "label"), state["depth"] + 1)
                 .when(H.is_end_tag(token, "label"), F.greatest(state["depth"] - 1, F.lit(0)))
                 .otherwise(state["depth"]))
        is_loose = H.is_tag(token, *C.CONTROL_TAGS) & (state["depth"] == 0)
        return record(depth=depth,
                      loose=F.when(is_loose, F.concat(state["loose"], F.array(token))).otherwise(state["loose"]))

    loose = H.tags_with_attributes(F.aggregate(form_tokens, start, step, lambda state: state["loose"]))

    def bare(control):
        attrs = control["attrs"]

        def empty(name):
            return F.coalesce(H.attribute(attrs, name), F.lit("")) == ""

        kind = F.lower(F.coalesce(H.attribute(attrs, "type"), F.lit("")))
        return (~kind.isin(C.SELF_LABELLED_INPUT_TYPES) & empty("aria-label") & empty("aria-labelledby")
                & (empty("id") | ~F.array_contains(label_ids, F.coalesce(H.attribute(attrs, "id"), F.lit("")))))

    return _count(F.filter(loose, bare))


def _level_skips(heading_tags: Column) -> Column:
    """Steps from one heading to the next that go down more than one level."""
    levels = F.transform(heading_tags, lambda t: F.substring(t, 3, 1).cast("int"))
    start = record(last=F.lit(9), skips=F.lit(0))
    return F.aggregate(levels, start,
                       lambda s, level: record(last=level, skips=s["skips"] + (level > s["last"] + 1).cast("int")),
                       lambda s: s["skips"])


def _json_bodies(scripts: Column) -> Column:
    linked = F.filter(scripts, lambda s: H.attribute(H.attributes(s), "type") == C.JSON_LD)
    return F.transform(linked, lambda s: F.regexp_replace(F.regexp_replace(s, "(?i)^<script" + H.ATTRIBUTES + ">", ""),
                                                          r"(?i)</script[^>]*+>\z", ""))


def _is_json(body: Column) -> Column:
    """Exactly one JSON value: it must stay whole both as a list element and as an object member."""
    as_item = F.concat(F.lit("["), body, F.lit("]"))
    as_member = F.concat(F.lit('{"k":'), body, F.lit("}"))
    return (F.coalesce(F.json_array_length(as_item) == 1, F.lit(False))
            & F.coalesce(F.json_object_keys(as_member) == F.array(F.lit("k")), F.lit(False)))


def _schema_types(bodies: Column) -> Column:
    """Sorted ``@type`` values of the objects in valid bodies, top-level lists included."""
    def of(body):
        listed = F.ltrim(F.regexp_replace(body, r"^[\s]+", "")).startswith("[")
        items = F.when(listed, F.from_json(body, "array<string>")).otherwise(F.array(body))
        kinds = F.transform(F.filter(items, lambda i: i.isNotNull()), lambda i: F.get_json_object(i, "$['@type']"))
        return F.flatten(F.transform(
            F.filter(kinds, lambda k: k.isNotNull() & (k != "")),
            lambda k: F.when(k.startswith("[") & F.json_array_length(k).isNotNull(), F.from_json(k, "array<string>"))
            .otherwise(F.array(k))))

    return F.array_sort(F.flatten(F.transform(bodies, of)))


def page_facts(crawl: DataFrame) -> DataFrame:
    """Facts of every page with content. Each projection reads the arrays of the one before, so the
    page text is tokenized once; nothing is shuffled. ``links`` keeps the sorted internal targets."""
    parsed = (with_content(crawl)
              .select("label", page_base(F.col("url")).alias("base"), normalize_url(F.col("url")).alias("url"),
                      H.tokens(F.col("html")).alias("tokens"))
              .select("label", "base", "url", H.markup(F.col("tokens")).alias("markup"),
                      H.start_tags(F.col("tokens"), "script").alias("scripts"),
                      F.filter("tokens", lambda t: H.is_tag(t, *_READ_TAGS) | H.is_end_tag(t, "label")).alias("tags")))

    def tags(*names):
        return H.start_tags(F.col("tags"), *names)

    split = parsed.select(
        "label", "url", "base",
        F.regexp_extract("markup", r"(?is)<title(?=[\s/>])" + H.ATTRIBUTES + r">(.*?)</title(?=[\s/>])", 1).alias("title"),
        F.regexp_extract_all("markup", F.lit(_ANCHOR), F.lit(0)).alias("anchors"),
        H.tags_with_attributes(tags("meta")).alias("metas"),
        H.tags_with_attributes(tags("link")).alias("link_tags"),
        H.tags_with_attributes(tags("img")).alias("images"),
        H.tags_with_attributes(tags("a")).alias("anchor_tags"),
        tags("h[1-6]").alias("headings"),
        F.try_element_at(H.tags_with_attributes(tags("html")), F.lit(1)).alias("root"),
        F.filter("tags", lambda t: H.is_tag(t, "label", *C.CONTROL_TAGS) | H.is_end_tag(t, "label")).alias("form"),
        _json_bodies(F.col("scripts")).alias("json"))
    label_ids = F.transform(F.filter(H.tags_with_attributes(H.start_tags(F.col("form"), "label")),
                                     lambda t: H.attribute(t["attrs"], "for").isNotNull()),
                            lambda t: H.attribute(t["attrs"], "for"))
    read = split.select(
        "label", "url", H.text_of(F.col("title")).alias("title"),
        H.strip(F.coalesce(_meta(F.col("metas"), "description"), F.lit(""))).alias("meta_description"),
        _count(F.filter("headings", lambda t: H.is_tag(t, "h1"))).alias("h1_count"),
        _level_skips(F.col("headings")).alias("heading_level_skips"),
        F.exists("link_tags", lambda t: F.array_contains(
            F.split(F.coalesce(H.attribute(t["attrs"], "rel"), F.lit("")), r"\s+"), "canonical")).alias("has_canonical"),
        F.exists("metas", lambda m: F.coalesce(H.attribute(m["attrs"], "name") == "viewport", F.lit(False))).alias("has_viewport"),
        F.coalesce(F.lower(_meta(F.col("metas"), "robots")).contains("noindex"), F.lit(False)).alias("noindex"),
        H.strip(F.coalesce(H.attribute_text(F.col("root.attrs"), "lang"), F.lit(""))).alias("lang"),
        _count(F.col("images")).alias("img_count"),
        _count(F.filter("images", lambda i: H.attribute(i["attrs"], "alt").isNull())).alias("img_missing_alt"),
        F.array_join(_schema_types(F.filter("json", _is_json)), "|").alias("structured_data_types"),
        _count(F.filter("json", lambda b: ~_is_json(b))).alias("invalid_structured_data"),
        F.array_sort(F.array_distinct(page_links(F.col("anchor_tags"), F.col("base")))).alias("links"),
        _count(F.filter("anchors", _has_no_text)).alias("empty_link_text"),
        _unlabelled(F.col("form"), label_ids).alias("inputs_without_label"))
    return (read.withColumns({"title_length": F.length("title"), "meta_description_length": F.length("meta_description"),
                              "internal_links": _count(F.col("links"))})
            .select(*FACT_COLUMNS, "links"))
