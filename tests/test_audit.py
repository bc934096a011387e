import random
import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit, urlunsplit

import duckdb
import pytest
from compare import differences
from conftest import frame
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from liftlens import constants as C
from liftlens.functions import html as H
from liftlens.functions.urls import normalize_url, page_base, resolve_link
from liftlens.operators import audit as A
from liftlens.operators import links as L
from liftlens.operators import report as R
from liftlens.operators.page_facts import page_facts
from liftlens.session import BucketedTable
from liftlens.sources import fixtures as X

BASE = "https://shop.test"
#: A recipe page with many faults: no canonical, robots noindex, headings 2 -> 5, no h1, long title, images, controls of all kinds.
RECIPE = """<html LANG=""><head><title>Slow bread with walnuts, rye flour, a little honey and three days of patience in the cold</title>
<meta name=robots content="NOINDEX, follow"><meta content="width=device-width" name=viewport>
<style>h1:after{content:"<h1>"}</style></head><body>
<h2>Dough</h2><h5>Water</h5><h3>Salt</h3><!-- <h1>hidden</h1><img> -->
<figure><img src=crumb.jpg alt><img src=crust.jpg><img alt="Oven" src=oven.jpg></figure>
<p><a href="../tools/?sort=price#knives">Tools</a> <a href=//shop.test/oven>Oven</a> <a href="tel:123"></a>
<a href="https://shop.test:443/else">Port</a> <a href="/tools/?sort=price"><img src=t.png alt=" "></a> <a href="/lost">lost</a></p>
<form><select name=size><option>1</select><input name=q aria-label=Search><textarea id=t></textarea><input type=submit>
<input type=image><label for=mail>Mail</label><input id=mail type=email><label>Agree <input type=checkbox></label></form>
<script type="application/ld+json">{"@type": "Recipe", "author": {"@type": "Person"}}</script>
<script type="application/ld+json">{"@type": </script></body></html>"""
#: A clean contact page with a list of data; its description is too long.
CONTACT = """<!doctype html><html lang=en><head><title>Contact &amp; opening hours</title>
<link rel=canonical href=/contact><meta name=viewport content=x><meta name=description content="%s">
<script type="application/ld+json">[{"@type": "Place"}, {"@type": ["Shop", "Bakery"]}, {"@type": "[sic"}, "text", 4]</script></head>
<body><h1>Contact</h1><h2>Hours</h2><h3>Summer</h3><h2>Way</h2><a href="/recipes/bread">Bread</a>
<a href="/contact" aria-label="Again"></a></body></html>""" % ("We bake. " * 25)
#: Two bare pages that share title and description.
BARE = """<html lang=de><head><title>Angebot der Woche</title><meta name=description content=Brot><link rel=canonical href=x>
<meta name=viewport content=x><script type="application/ld+json">{"@type":"Offer"}</script></head><body><h1>A</h1><h1>B</h1>%s</body></html>"""


@pytest.fixture(scope="module")
def crawl(spark):
    pages = {"/recipes/bread": (200, RECIPE), "/contact": (200, CONTACT), "/a": (200, BARE % "<a href=b>b</a>"), "/b": (200, BARE % ""),
             "/untitled": (200, "<html lang=fr><body><h1>x</h1></body></html>"), "/lost": (410, ""), "/nothing": (200, "")}
    rows = [("after", BASE + path, status, html, n) for n, (path, (status, html)) in enumerate(pages.items())]
    return frame(spark, rows, "label string, url string, status int, html string, seq long")


@pytest.fixture(scope="module")
def facts(crawl):
    return {r.url.removeprefix(BASE): r for r in page_facts(crawl).collect()}


def test_facts_of_the_faulty_page(facts):
    page = facts["/recipes/bread"]
    assert set(facts) == {"/recipes/bread", "/contact", "/a", "/b", "/untitled"}
    assert (page.title_length, page.h1_count, page.heading_level_skips, page.noindex, page.lang) == (89, 0, 1, True, "")
    assert (page.has_canonical, page.has_viewport, page.meta_description) == (False, True, "")
    assert (page.img_count, page.img_missing_alt) == (4, 1)
    assert page.inputs_without_label == 2  # the select and the text area
    assert page.empty_link_text == 2  # the telephone link and the image with a blank alt
    assert (page.invalid_structured_data, page.structured_data_types) == (1, "Recipe")
    assert page.links == [f"{BASE}/lost", f"{BASE}/oven", f"{BASE}/tools/?sort=price"]


def test_facts_of_the_clean_page(facts):
    page = facts["/contact"]
    assert (page.title, page.lang, page.h1_count, page.heading_level_skips) == ("Contact & opening hours", "en", 1, 0)
    assert (page.structured_data_types, page.invalid_structured_data, page.img_count) == ("Bakery|Place|Shop|[sic", 0, 0)
    assert page.has_canonical and page.has_viewport and not page.noindex and page.meta_description_length > 160


#: What each page must be told; the duplicates and the lost page come from the site as a whole.
EXPECTED = {
    "/recipes/bread": {"title_too_long", "missing_meta_description", "missing_h1", "missing_canonical", "noindex", "missing_lang",
                       "img_missing_alt", "heading_level_skip", "input_missing_label", "empty_link_text", "invalid_structured_data",
                       "broken_internal_link"},
    "/contact": {"meta_description_too_long"},
    "/a": {"multiple_h1", "duplicate_title", "duplicate_meta_description"},
    "/b": {"multiple_h1", "duplicate_title", "duplicate_meta_description"},
    "/untitled": {"missing_title", "missing_meta_description", "missing_canonical", "missing_viewport", "missing_structured_data"},
    "/lost": {"http_error"},
}


def test_issues_of_the_site(crawl):
    found = {}
    for r in A.site_issues(page_facts(crawl), crawl).collect():
        found.setdefault(r.url.removeprefix(BASE), set()).add(r.issue)
    assert found == EXPECTED


def test_summary_counts_and_page_ids(spark, crawl):
    issues = A.site_issues(page_facts(crawl), crawl)
    summary = R.audit_summary(issues)
    count = {r.issue: (r.before, r.after) for r in summary.collect()}
    codes = [code for page in EXPECTED.values() for code in page]
    assert count == {code: (0, codes.count(code)) for code in codes}
    totals = {r.category: r.after for r in R.category_totals(summary).collect()}
    assert totals == {category: sum(c in names for c in codes) for category, names in C.ISSUES_BY_CATEGORY.items()}
    listed = frame(spark, [("P7", f"{BASE}/a"), ("P8", f"{BASE}/lost")], "page string, url string")
    ids = {r.url.removeprefix(BASE): r.page for r in A.attach_page(issues, listed).collect()}
    assert ids == {path: {"/a": "P7", "/lost": "P8"}.get(path, "") for path in EXPECTED}


def test_last_status_of_a_repeated_url_counts(spark):
    crawl = frame(spark, [("before", f"{BASE}/x/", 404, "", 1), ("before", f"{BASE}/x/#a", 200, "", 2)],
                                  "label string, url string, status int, html string, seq long")
    assert [r.status for r in A.crawled_status(crawl).collect()] == [200]


URLS = ["HTTPS://Example.TEST/a/#top", "https://example.test", "http://h.test/p?q=1#f", "https://H.test:8080?x", "http://u@H.test/A%20b/",
        "https://h.test/?", " https://h.test/a\tb"]
HREFS = ["/a/b", "/a/../b/./c", "b", "./b", "../b", "../../../b", "?q=2", "", "//Other.test/x", "https://H.test/z#f", "http://h.test",
         "a//b", "/a//b", "..", ".", "/x/..", "/x/.", "c/d/../e/", "#frag", "ftp://h.test/f", "data:text/plain,x", "/a?b=/../c",
         "/.hidden", "/a.b/c", "g;x=1", "/the,", "  /sp  ", "/É"]


def _normal(url):
    parts = urlsplit(url)
    return urlunsplit((parts.scheme.lower(), parts.netloc.lower(), parts.path or "/", parts.query, ""))


def test_normalized_urls_equal_the_standard_library(spark):
    df = frame(spark, [(u,) for u in URLS], "u string")
    assert [r[0] for r in df.select(normalize_url(F.col("u"))).collect()] == [_normal(u) for u in URLS]


def test_resolved_links_equal_the_standard_library(spark):
    bases = ["https://h.test/dir/page?q=1", "https://h.test/", "https://h.test/dir/sub/", "http://h.test/x"]
    pairs = [(b, h) for b in bases for h in HREFS]
    df = frame(spark, [(i, b, h) for i, (b, h) in enumerate(pairs)], "i int, b string, h string")
    got = (df.select("i", page_base(F.col("b")).alias("base"), H.strip(F.col("h")).alias("h"))
           .select("i", resolve_link(F.col("base"), F.col("h")).alias("x")).select("i", "x.host", "x.url").orderBy("i").collect())
    for row, (base, href) in zip(got, pairs):
        expected = _normal(urljoin(base, href.strip()))
        assert row.host == urlsplit(expected).netloc, (base, href)
        if row.host:
            assert row.url == expected, (base, href)


def test_entities(spark):
    cases = [("a &amp; b", "a & b"), ("&#269;&#x10D;&eacute;", "ččé"), ("&unknown; &", "&unknown; &"), ("R&amp D", "R& D"), ("x", "x")]
    df = frame(spark, [(c,) for c, _ in cases], "c string")
    assert [r[0] for r in df.select(H.decode_entities(F.col("c"))).collect()] == [e for _, e in cases]
    attribute = frame(spark, [("?a=1&copy=2&amp;b",)], "c string")
    assert attribute.select(H.decode_entities(F.col("c"), True)).first()[0] == "?a=1&copy=2&b"


def test_json_bodies(spark):
    bodies = ['{"@type": "A"}', "", "{bad", '{"a":1} x', '{"a":1}] x [', '1} x {', "[1,2]", "1,2", ' {"a": [1, {}]}\n', "null", '{"a":1,"a":2}']
    from liftlens.operators.page_facts import _is_json
    df = frame(spark, [(b,) for b in bodies], "b string")
    assert [r[0] for r in df.select(_is_json(F.col("b"))).collect()] == [
        True, False, False, False, False, False, True, False, True, True, True]


class _Tags(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        self.found.append((tag, [(k, v or "") for k, v in attrs]))

    handle_startendtag = handle_starttag


def test_tags_of_all_pages_equal_the_standard_parser(spark, small_dir):
    extra = [(-1, "u", RECIPE), (-2, "u", CONTACT), (-3, "u", "<p a=1 b='x>y' c=\"&amp;\" d / ><br/><img alt>"),
             (-4, "u", "<style>a<b</style><p><!-- <p> --><!x><?y?>1 < 2 <a\nhref = '/x' >t</a >")]
    pages = X.table(spark, small_dir, "pages").unionByName(frame(spark, extra, "page_id long, url string, html string"))
    tags = H.tags_with_attributes(H.start_tags(H.tokens(F.col("html")), r"[a-z][^\s/>]*"))
    tags = F.transform(tags, lambda t: F.named_struct(F.lit("tag"), t["tag"], F.lit("attrs"), F.transform(
        t["attrs"], lambda a: F.named_struct(F.lit("k"), a["name"], F.lit("v"), H.decode_entities(a["value"], True)))))
    for row in pages.select("page_id", "html", tags.alias("tags")).collect():
        parser = _Tags()
        parser.feed(row.html)
        assert [(t.tag.rstrip(">"), [(a.k, a.v) for a in t.attrs]) for t in row.tags] == parser.found, row.page_id


def test_reachable_pages_by_levels(spark):
    """A ring of rooms, each with two doors further on and one back, and a corridor at its end."""
    def doors(*names):
        return "".join(f"<p><a href='/{n}'>go</a>" for n in names)

    rooms = 40
    plan = {f"room{i}": doors(f"room{(2 * i + 2) % rooms}", f"room{(2 * i + 1) % rooms}", "room0") for i in range(rooms)}
    plan |= {"room39": doors("hall", "https://else.test/"), "hall": doors("yard", "void"), "yard": "", "cellar": doors("room0")}
    rows = [("after", f"{BASE}/{name}", 503 if name == "yard" else 200, html) for name, html in plan.items()]
    crawl = frame(spark, rows, "label string, url string, status int, html string")
    order, level = ["room0"], {"room0": 0}
    for name in order:  # grows while it is read
        for target in re.findall("href='/([^']*)'", plan.get(name, "")):
            if target not in level:
                level[target] = level[name] + 1
                order.append(target)
    status = lambda n: 503 if n == "yard" else 200 if n in plan else 404
    edges = L.edges(crawl)
    got = [(r.crawl_order, r.url.removeprefix(BASE + "/"), r.level, r.status) for r in
           L.reachable(edges, crawl, f"{BASE}/room0").orderBy("crawl_order").collect()]
    assert got == [(i, n, level[n], status(n)) for i, n in enumerate(order)] and max(level.values()) > 5
    first = L.reachable(edges, crawl, f"{BASE}/room0", max_pages=5).orderBy("crawl_order").collect()
    assert [r.url.removeprefix(BASE + "/") for r in first] == order[:5]


def test_walks_from_many_starts_at_once(spark):
    """Every walk sees its own pages, label by label; what a bucketed table holds is not moved."""
    rng = random.Random(4)
    graph = {label: {f"{BASE}/{i}": [f"{BASE}/{rng.randrange(60)}" for _ in range(rng.choice([0, 1, 2, 5]))] for i in range(50)}
             for label in ("before", "after")}
    rows = [(label, src, dst, at) for label, own in graph.items() for src, targets in own.items() for at, dst in enumerate(targets)]
    starts = [(label, f"{BASE}/{i}") for label in graph for i in range(0, 55, 3)] + [("after", f"{BASE}/0#again")]
    want = []
    for label, start in set(starts[:-1]):
        order, level = [start], {start: 0}
        for page in order:  # grows while it is read
            for target in graph[label].get(page, []):
                if target not in level:
                    level[target] = level[page] + 1
                    order.append(target)
        want += [(label, start, url, level[url], i) for i, url in enumerate(order)]
    edges = frame(spark, rows, "label string, src string, dst string, anchor_pos int").repartition(5)
    begin = frame(spark, starts, "label string, url string")
    assert sorted(map(tuple, L.walks(edges, begin).collect())) == sorted(want) and max(w[3] for w in want) >= 4
    assert sorted(map(tuple, L.walks(edges, begin, 7).collect())) == sorted(w for w in want if w[4] < 7)
    assert L.walks(edges, begin.limit(0)).collect() == []


def test_a_round_moves_neither_links_nor_pages_seen(spark):
    links, seen = BucketedTable(spark, "links", ["label", "src"]), BucketedTable(spark, "visited", [*L.WALK, "url"])
    links.append(frame(spark, [("after", "a", "b", 0)], "label string, src string, dst string, anchor_pos int"))
    seen.append(frame(spark, [("after", "a", "a", 0, 0)], "label string, start string, url string, at long, level int"))
    frontier = frame(spark, [("after", "a", "a", 0)], "label string, start string, url string, at long")
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = L.found_next(links.read(), frontier, seen.read())
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert [r.url for r in found.collect()] == ["b"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Bucketed: true") == 2


def test_pages_of_one_url_share_their_doors(spark, tmp_path):
    """Copies of a page: one is gone, one has fewer links; the twin opens each url on the doors of all of them."""
    rows = []
    for n in range(1, 24):
        url = f"https://o.example/{ {2: 'twin', 3: 'twin', 23: 'twin', 4: 'pair', 9: 'pair'}.get(n, f'p{n}') }"
        links = "".join(f'<p><a href="/far/{(n * k) % 11}">x</a></p>' for k in range(1, n % 4 + 2))
        rows.append((n, url, f"<html lang=\"en\"><head><title>Page {n}</title></head><body><h1>t</h1>{links}</body></html>"))
    frame(spark, rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert differences(db, queries()["reachable_pages"](spark, str(tmp_path)), oracle_sql()["reachable_pages"]) == ""
