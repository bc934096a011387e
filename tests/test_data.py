import hashlib
from datetime import date

import pytest
from conftest import frame, garden, settings
from pyspark.sql import Row
from pyspark.sql import functions as F
from test_estimates import BEDS, K1

from liftlens import Hypothesis
from liftlens import constants as C
from liftlens.operators import checks as Q
from liftlens.operators import panel as P
from liftlens.operators import quality
from liftlens.operators import report as R
from liftlens.operators.joins import salted_join
from liftlens.operators.ranking import spread_rank
from liftlens.params import arms, hypotheses, models
from liftlens.session import materialize
from liftlens.sources import files as FL
from liftlens.sources import hashes as HS
from liftlens.sources import snapshot as S

GROUPS = {"T1": "technical", "T2": "technical", "C1": "control", "C2": "control"}
H1 = Hypothesis("H1", "did", "technical", "position", threshold=0.2)
PAGES = "page,url,design_group\n" + "".join(f"{p},https://x.test/{p}/,{g}\n" for p, g in GROUPS.items())
GSC = "date,page,segment,clicks,impressions,position\n" + "".join(
    f"2026-05-0{d},{p},{s},{d},{10 * d},{d}.5\n" for d in range(1, 4) for p in GROUPS for s in C.SEGMENTS)
FILES = {
    "SNAPSHOT.yaml": "name: x\n", "pages.csv": PAGES, "gsc_daily.csv": GSC,
    "interventions.csv": "intervention_id,page,type,date,description\nI1,T1,technical,2026-06-22,\"a, b\"\n"
                         "I2,T2,technical,2026-06-22,\nL1,*,links,2026-06-01,\n",
    "lighthouse.csv": "page,snapshot,date,performance,accessibility,seo,lcp_ms,cls,inp_ms\nT1,before,2026-06-01,59,90,85,3617,0.143,158\n",
    "authority.csv": "date,metric,source,value\n2026-02-01,domain_authority,s,11\n",
    "crawl/before/index.csv": "url,file,status,content_type\nhttps://x.test/,a.html,200,text/html\nhttps://x.test/no,,404,text/html\n",
    "crawl/after/index.csv": "url,file,status,content_type\nhttps://x.test/,a.html,200,text/html\n",
    "crawl/before/a.html": "<title>A</title>\n", "crawl/after/a.html": "<title>B</title>\n",
}


def write(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text, encoding="utf-8")
    lines = [f"{hashlib.sha256(t.encode()).hexdigest()}  {n}\n" for n, t in sorted(files.items())]
    (root / C.HASH_LIST).write_text("".join(lines))
    return str(root)


def codes(spark, root, with_hashes=True):
    tables = S.read_snapshot(spark, root)
    h = HS.file_hashes(spark, root)
    found = quality.validate(tables, hypotheses(spark, settings(H1)), settings(H1), h,
                             HS.declared_hashes(spark, f"{root}/{C.HASH_LIST}"))
    return {(r.code, r.file, r.detail) for r in found.collect()}


def test_clean_snapshot_has_no_findings_and_types(spark, tmp_path):
    root = write(tmp_path, FILES)
    assert codes(spark, root) == set()
    typed = S.typed_tables(S.read_snapshot(spark, root))
    assert dict(typed["gsc_daily"].dtypes)["impressions"] == "bigint"
    assert typed["interventions"].where("page = 'T1'").first().description == "a, b"
    lines = "".join(f"{hashlib.sha256(t.encode()).hexdigest()}  {n}\n" for n, t in sorted(FILES.items()))
    assert HS.tree_hash(HS.file_hashes(spark, root)).first()[0] == hashlib.sha256(lines.encode()).hexdigest()


DAMAGE = [
    ("gsc_daily.csv", "2026-05-01,T1,local,1,10,1.5", "2026-05-01,T1,local,11,10,1.5", "clicks_gt_impressions"),
    ("gsc_daily.csv", "2026-05-01,T2,local,1,10,1.5", "2026-05-01,T2,local,1.5,10,1.5", "negative_or_non_integer"),
    ("gsc_daily.csv", "2026-05-01,T2,general,1,10,1.5", "2026-05-01,T2,general,1,10,", "position_out_of_range"),
    ("gsc_daily.csv", "2026-05-01,C1,local,1,10,1.5", "2026-05-01,C1,local,0,0,1.5", "position_without_impressions"),
    ("gsc_daily.csv", "2026-05-01,C1,general", "2026-05-01,P99,general", "unknown_page"),
    ("gsc_daily.csv", "2026-05-01,C2,general", "2026-05-01,C2,brand", "unknown_segment"),
    ("gsc_daily.csv", "2026-05-02,T1,local", "2026-05-03,T1,local", "duplicate_key"),
    ("gsc_daily.csv", "2026-05-02,T2,local", "soon,T2,local", "bad_date"),
    ("pages.csv", "T2/,technical", "T2/,odd", "unknown_design_group"),
    ("interventions.csv", "I1,T1", "I1,C1", "control_page_intervened"),
    ("interventions.csv", "I2,T2", "I2,P98", "unknown_page"),
    ("interventions.csv", "L1,*", "L1,T1", "site_wide_page"),
    ("lighthouse.csv", "59,90", "101,90", "score_out_of_range"),
    ("lighthouse.csv", "before", "mid", "unknown_snapshot"),
    ("authority.csv", ",11", ",many", "non_numeric"),
    ("crawl/before/index.csv", "a.html", "b.html", "missing_file"),
]
OTHER_DAMAGE = [
    ("gsc_daily.csv", "2026-05-01,T1,local,1,10,1.5", "2026-05-01,T1,local,0,-1,", "negative_or_non_integer"),
    ("pages.csv", "T2,https", "T1,https", "duplicate_key"),
    ("interventions.csv", "I1,T1,technical", "I2,T1,content", "type_group_mismatch"),
    ("interventions.csv", "L1,*", "L1,T1", "site_wide_page"),
    ("interventions.csv", "I2,T2,technical,2026-06-22", "I2,T2,technical,soon", "bad_date"),
    ("interventions.csv", "I1,T1,technical", "I2,T1,content", "too_few_pages"),
    ("interventions.csv", "I1,T1,technical", "I2,T1,content", "duplicate_key"),
    ("authority.csv", "2026-02-01", "2026-02-31", "bad_date"),
]


@pytest.mark.parametrize("damage", [DAMAGE, OTHER_DAMAGE])
def test_each_rule_finds_its_damage(spark, tmp_path, damage):
    files = dict(FILES)
    for file, old, new, _ in damage:
        assert old in FILES[file]
        files[file] = files[file].replace(old, new, 1)
    found = {(c, f) for c, f, _ in codes(spark, write(tmp_path, files))}
    assert {(code, file) for file, _, _, code in damage} <= found


def test_hash_and_file_rules(spark, tmp_path):
    root = write(tmp_path, FILES)
    (tmp_path / "authority.csv").write_text(FILES["authority.csv"].replace(",11", ",12"))
    (tmp_path / "extra.txt").write_text("x")
    (tmp_path / "crawl/after/a.html").unlink()
    (tmp_path / "SNAPSHOT.yaml").unlink()
    found = {(c, f) for c, f, _ in codes(spark, root)}
    assert found == {("checksum_mismatch", "authority.csv"), ("checksum_missing", "extra.txt"),
                     ("checksum_extra", "crawl/after/a.html"), ("checksum_extra", "SNAPSHOT.yaml"),
                     ("missing_file", "crawl/after/index.csv"), ("missing_file", "SNAPSHOT.yaml")}


def test_missing_columns_end_the_check(spark, tmp_path):
    root = write(tmp_path, {**FILES, "authority.csv": FILES["authority.csv"].replace("source", "origin")})
    assert codes(spark, root) == {("missing_columns", "authority.csv", "missing columns ['source']")}


def test_missing_table_ends_the_check(spark, tmp_path):
    root = write(tmp_path, FILES)
    (tmp_path / "authority.csv").unlink()
    tables = S.read_snapshot(spark, root)
    rows = quality.validate(tables, hypotheses(spark, settings(H1)), settings(H1)).collect()
    assert [(r.code, r.file) for r in rows] == [("missing_file", "authority.csv")]
    listed = quality.missing_files(spark, HS.file_hashes(spark, root), has_hash_list=False).collect()
    assert {r.file for r in listed} == {"authority.csv", C.HASH_LIST}


def test_every_unknown_value_is_a_finding(spark):
    values = spark.range(4000).select(F.format_string("v%05d", F.col("id") % 1300).alias("value"))
    rows = quality._listed(values, "unknown_segment", "gsc_daily.csv").collect()
    assert sorted(r.detail for r in rows) == [f"v{i:05d}" for i in range(1300)]


def test_whole_numbers_with_decimals_and_cells_with_line_breaks(spark, tmp_path):
    files = {**FILES, "gsc_daily.csv": GSC.replace("2026-05-01,T1,local,1,10,1.5", "2026-05-01,T1,local,1.0,10.0,1.5"),
             "interventions.csv": FILES["interventions.csv"].replace('"a, b"', '"first line\nsecond, line"')}
    root = write(tmp_path, files)
    assert codes(spark, root) == set()
    typed = S.typed_tables(S.read_snapshot(spark, root))
    assert typed["gsc_daily"].where("page = 'T1' AND segment = 'local'").orderBy("date").first()[3:5] == (1, 10)
    assert [r.description for r in typed["interventions"].orderBy("intervention_id").collect()] == ["first line\nsecond, line", "", ""]
    broken = S.read_snapshot(spark, write(tmp_path / "b", {**FILES, "authority.csv": FILES["authority.csv"].replace(",11", ",many")}))
    with pytest.raises(Exception, match="value is no double: many"):
        S.typed_tables(broken)["authority"].collect()


def test_bodies_of_any_name_and_place_are_read(spark, tmp_path):
    index = "url,file,status,content_type\n" + "".join(f"https://x.test/{i},{f},200,text/html\n" for i, f in enumerate(
        ["a.html", "old.htm", "deep/er/b.html", "with space+plus.html", "absent.html"]))
    root = write(tmp_path, {"crawl/before/index.csv": index, "crawl/before/a.html": "A", "crawl/before/old.htm": "B",
                            "crawl/before/deep/er/b.html": "C", "crawl/before/with space+plus.html": "D"})
    rows = S.read_crawl(spark, f"{root}/crawl/before", "before").orderBy("url").collect()
    assert [r.html for r in rows] == ["A", "B", "C", "D", ""]


def test_crawl_folder_and_stored_crawl(spark, tmp_path):
    root = write(tmp_path / "raw", FILES)
    crawl = S.read_crawl(spark, f"{root}/crawl/before", "before")
    rows = {r.url: (r.status, r.html) for r in crawl.collect()}
    assert rows == {"https://x.test/": (200, "<title>A</title>\n"), "https://x.test/no": (404, "")}
    out = str(tmp_path / "stored")
    FL.write_crawl(crawl, out)
    back = S.read_crawl(spark, out, "before")
    assert {tuple(r) for r in back.drop("seq").collect()} == {tuple(r) for r in crawl.drop("seq").collect()}
    assert sorted(p.name for p in (tmp_path / "stored").iterdir()) == ["index.csv", "page_0001.html"]
    assert [p.name for p in tmp_path.iterdir() if "writing" in p.name] == []
    with pytest.raises(FileExistsError, match="exists already"):
        FL.write_crawl(crawl, out)


def test_written_crawl_is_numbered_by_url_and_quotes_its_cells(spark, tmp_path):
    rows = [("https://x.test/b", 200, None, "second, copy", 2), ("https://x.test/b", 200, "text/html", "B\n", 1), ('https://x.test/a,"q"', 404, "t", "", 3),
            ("https://x.test/c", None, "text/html", "Ü", 4)]
    crawl = frame(spark, rows, "url string, status int, content_type string, html string, seq bigint").repartition(3)
    FL.write_crawl(crawl, str(tmp_path / "c"))
    assert (tmp_path / "c/index.csv").read_bytes().decode() == (
        'url,file,status,content_type\n"https://x.test/a,""q""",,404,t\nhttps://x.test/b,page_0002.html,200,text/html\n'
        "https://x.test/b,page_0003.html,200,\nhttps://x.test/c,page_0004.html,,text/html\n")
    assert [(tmp_path / f"c/page_000{n}.html").read_bytes().decode() for n in (2, 3, 4)] == ["B\n", "second, copy", "Ü"]
    FL.write_crawl(crawl.limit(0), str(tmp_path / "none"))
    assert (tmp_path / "none/index.csv").read_text() == "url,file,status,content_type\n"


def test_aborted_crawl_leaves_no_body_and_no_index(spark, tmp_path):
    crawl = spark.range(6).select(F.col("id").cast("string").alias("url"), F.lit(200).alias("status"), F.lit("t").alias("content_type"),
                                  F.lit("x").alias("html"), F.col("id").alias("seq"))
    writer = FL.CrawlWriter(str(tmp_path / "c"))
    done = writer.write(iter([Row(number=1, url="u", status=200, content_type="t", html="x")]))
    assert (tmp_path / "c/page_0001.html").exists()
    writer.abort([done, None])
    assert list((tmp_path / "c").iterdir()) == []
    FL.write_crawl(crawl, str(tmp_path / "c"))
    assert len(list((tmp_path / "c").iterdir())) == 7


def test_hidden_looking_names_and_long_files_are_read_and_hashed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(FL, "GROUP_NAMES", 2)
    long = "y" * (FL.PIECE + 5)
    root = write(tmp_path, {"c/index.csv": "url,file,status,content_type\nu,_x.html,200,t\nv,_d/.h.html,200,t\nw,long.html,200,t\n",
                            "c/_x.html": "X", "c/_d/.h.html": "H", "c/long.html": long})
    assert {r.url: r.html for r in S.read_crawl(spark, f"{root}/c", "before").collect()} == {"u": "X", "v": "H", "w": long}
    found = {r.path: r.sha256 for r in HS.file_hashes(spark, f"{root}/c").collect()}
    assert found.keys() == {"index.csv", "_x.html", "long.html"}
    assert found["long.html"] == hashlib.sha256(long.encode()).hexdigest()
    assert {r.path for r in HS.file_hashes(spark, f"file:{root}/c").collect()} == found.keys()


def test_tree_hash_of_many_lines_does_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(HS, "LINES_BYTES", 1000)
    hashes = spark.range(3000).select(F.format_string("f%d", "id").alias("path"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
    names = {f"f{i}": hashlib.sha256(str(i).encode()).hexdigest() for i in range(3000)}
    expected = hashlib.sha256("".join(f"{h}  {n}\n" for n, h in sorted(names.items())).encode()).hexdigest()
    assert HS.tree_hash(hashes.repartition(5)).first()[0] == expected == HS.tree_hash(hashes.coalesce(1)).first()[0]
    assert HS.tree_hash(hashes.limit(0)).first()[0] == hashlib.sha256(b"").hexdigest()


def test_tables_survive_storage(spark, tmp_path):
    df = frame(spark, [(date(2026, 1, 31), "a", True), (date(2026, 2, 1), "b", False)], "date date, page string, eligible boolean")
    S.write_table(df, str(tmp_path / "t"), monthly=True)
    back = S.read_table(spark, str(tmp_path / "t")).select(df.columns)
    assert {(r.date, r.page, r.eligible) for r in back.collect()} == {tuple(r) for r in df.collect()}
    assert sorted(x.name for x in (tmp_path / "t").glob("month=*")) == ["month=2026-01-01", "month=2026-02-01"]
    assert HS.table_hash(df).first() == HS.table_hash(df.orderBy(F.desc("page"))).first()
    assert HS.table_hash(df).first() != HS.table_hash(df.limit(1)).first()
    recorded = HS.table_hash(df).first().table_hash
    assert Q.hash_matches(HS.table_hash(back), "table_hash", recorded, "design_hash").first().ok
    assert not Q.hash_matches(HS.table_hash(df.limit(1)), "table_hash", recorded, "design_hash").first().ok


def test_page_panel_weights_by_impressions(spark):
    rows = [(date(2026, 1, 1), "A", "local", 9, 90, 2.0), (date(2026, 1, 1), "A", "general", 1, 10, 10.0),
            (date(2026, 1, 2), "A", "local", 0, 0, None), (date(2026, 1, 2), "A", "general", 0, 0, None)]
    seg = frame(spark, rows, "date date, page string, segment string, clicks long, impressions long, position double")
    got = {r.date.day: (r.clicks, r.impressions, r.position) for r in P.page_day(P.segment_day(seg)).collect()}
    assert got == {1: (10, 100, 2.8), 2: (0, 0, None)}
    view = P.segment_view(P.segment_day(seg), ["all", "local"]).collect()
    assert sorted((r.segment, r.date.day, r.position) for r in view if r.position) == [("all", 1, 2.8), ("local", 1, 2.0)]
    assert len(P.segment_view(P.segment_day(seg), ["general"]).collect()) == 2


def test_hypothesis_tables(spark):
    h3 = Hypothesis("H3", "did_difference", "local", "clicks", segment="local", compare_to="content")
    h2 = Hypothesis("H2", "did", "content", "ctr_adjusted")
    h5 = Hypothesis("H5", "descriptive", "links", "domain_authority", threshold=10, horizon_days=9)
    p = settings(h2, h3, h5)
    hyp = hypotheses(spark, p)
    assert {(r.hypothesis_id, r.arm, r.type) for r in arms(hyp).collect()} == {
        ("H2", "a", "content"), ("H3", "a", "local"), ("H3", "b", "content")}
    assert {(r.hypothesis_id, r.model, r.model_metric) for r in models(hyp).collect()} == {
        ("H2", "did", "ctr_adjusted"), ("H2", "naive_prepost", "ctr_adjusted"), ("H2", "did_raw_ctr", "ctr_raw"),
        ("H3", "did", "clicks"), ("H3", "naive_prepost", "clicks")}
    assert p.ci_level_adj == pytest.approx(0.975) and p.with_(multiplicity="none").ci_level_adj == 0.95
    with pytest.raises(ValueError):
        Hypothesis("X", "did", "links", "domain_authority")


def test_spread_rank_numbers_every_row_once(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.format_string("P%05d", "id").alias("page"))
    rows = spread_rank(df, ["g"], ["page"]).collect()
    for g in range(3):
        slots = sorted(r.slot for r in rows if r.g == g)
        assert slots == list(range(len(slots))) and {r.n for r in rows if r.g == g} == {len(slots)}


def test_salted_join_equals_plain_join(spark):
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    lookup = frame(spark, [("hot", 1), ("7", 2), ("nobody", 3)], "k string, v int")
    for how in ("inner", "left"):
        plain = {tuple(r) for r in big.join(lookup, "k", how).select("k", "id", "v").collect()}
        assert {tuple(r) for r in salted_join(big, lookup, ["k"], ["id"], how).select("k", "id", "v").collect()} == plain


def test_checks_notice_damage(spark):
    s = garden(spark, settings(K1), BEDS)
    pred, design = materialize(s.predictions, "predictions"), materialize(s.design(), "design")
    s.predictions = pred

    def failed(pred, design):
        rows = Q.run_checks([*Q.prediction_checks(pred, design, s.p, "run"), Q.model_coverage(pred)]).collect()
        return {r.name for r in rows if not r.ok}

    assert failed(pred, design) == set()
    assert failed(pred.unionByName(pred.where("page = 'fern'")), design) == {"prediction_keys_unique", "passed"}
    assert failed(pred.where("page != 'fern' or model != 'did'"), design) == {"equal_model_coverage", "passed"}
    assert failed(pred.withColumn("run_id", F.lit("other")), design) == {"prediction_run_id", "passed"}
    late = pred.withColumn("target_end", F.date_add("target_end", 90))
    assert failed(late, design) == {"labels_available_at_cutoff", "passed"}
    mixed = design.unionByName(design.where("page = 'fern'").withColumn("role", F.lit("control")))
    assert failed(pred, mixed) == {"treated_control_disjoint", "passed"}
    early = design.withColumn("end", F.when(F.col("period") == "pre", F.date_add("end", 1)).otherwise(F.col("end")))
    assert failed(pred, early) == {"pre_windows_before_intervention", "passed"}
    stored = materialize(s.evaluation(), "evaluation")
    assert Q.recomputed({"metrics": (stored, pred)}, stored, s.trend, s.hyp).first().ok
    bent = stored.withColumn("estimate", F.col("estimate") + 0.01)
    bad = Q.recomputed({"metrics": (bent, pred)}, bent, s.trend, s.hyp).first()
    assert not bad.ok and bad.detail == "metrics:K1/did"
    assert not Q.ablation_matches(stored, bent).first().ok and Q.ablation_matches(stored, stored).first().ok


def test_document_fields_and_their_differences(spark):
    text = '{"run": "a", "none": null, "on": true, "list": [{"n": 1.5, "w": [1, 2]}, {"n": -2, "w": []}], "part": {"day": "2024-01-01"}}'
    document = spark.range(1).select(F.lit(text).alias("document"))
    fields = R.document_fields(document)
    assert sorted(map(tuple, fields.collect())) == sorted([
        ("run", None, "a"), ("none", None, None), ("on", None, "true"), ("list[0].n", 1.5, None), ("list[0].w[0]", 1.0, None),
        ("list[0].w[1]", 2.0, None), ("list[1].n", -2.0, None), ("part.day", None, "2024-01-01")])
    assert R.document_differences(fields, fields).collect() == []
    other = spark.range(1).select(F.lit(text.replace("-2", "-2.1").replace(', "none": null', "").replace('"a"', '"b"')).alias("document"))
    assert {r.path for r in R.document_differences(fields, R.document_fields(other)).collect()} == {"run", "none", "list[1].n"}


def test_checks_notice_damage_to_claims_and_document(spark):
    claims = frame(spark, [("C-K1", "run", 0.5), ("C-AUDIT", "run", 3.0)], "claim_id string, run_id string, value double")
    metrics = frame(spark, [("K1", "did", "yes", 0.5, 0.1, 0.9)],
                    "hypothesis_id string, model string, decision string, estimate double, ci_low_adj double, ci_high_adj double")
    summary = frame(spark, [("technical", 1), ("content", 2)], "category string, before long")
    record = '{"hypothesis_id": "K1", "estimate": 0.5, "ci_low_adj": 0.1, "ci_high_adj": 0.9, "decision": "yes"}'
    export = spark.range(1).select(F.lit(f'{{"run_id": "run", "hypotheses": [{record}]}}').alias("document"))
    digest = spark.range(1).select(F.lit("abc").alias("sha256"))

    def failed(claims=claims, metrics=metrics, summary=summary, export=export, recorded="abc"):
        rows = Q.run_checks([Q.claims_match(claims, metrics, summary, "run"), Q.export_matches(export, metrics, "run"),
                             Q.hash_matches(digest, "sha256", recorded, "data_hash")]).collect()
        return {r.name: r.detail for r in rows if not r.ok}

    assert failed() == {}
    assert failed(recorded="abd").keys() == {"data_hash", "passed"}
    bent = claims.withColumn("value", F.col("value") + F.when(F.col("claim_id") == "C-K1", 0.01).otherwise(0))
    assert failed(claims=bent) == {"claims_match_run": "C-K1", "passed": "claims_match_run"}
    assert failed(summary=summary.limit(1))["claims_match_run"] == "C-AUDIT"
    told = export.select(F.replace("document", F.lit('"yes"'), F.lit('"no"')).alias("document"))
    assert failed(export=told) == {"export_matches_metrics": "K1", "passed": "export_matches_metrics"}
    assert failed(metrics=metrics.withColumn("estimate", F.lit(0.7))).keys() == {"claims_match_run", "export_matches_metrics", "passed"}


def test_reading_a_crawl_moves_no_body_and_lists_no_folder(spark, tmp_path):
    root = tmp_path / "c"
    (root / "deep").mkdir(parents=True)
    (root / "index.csv").write_text("url,file,status,content_type\nu,_a.html,200,t\nv,deep/b.html,200,t\nw,gone.html,200,t\n"
                                    "x,../out.html,200,t\ny,deep,200,t\nz,,404,t\nu2,_a.html,200,t\n")
    for name, text in (("c/_a.html", "A\r\n"), ("c/deep/b.html", "B"), ("out.html", "no")):
        (tmp_path / name).write_text(text, newline="")
    crawl = S.read_crawl(spark, str(root), "before")
    assert [(r.url, r.html) for r in crawl.orderBy("seq").collect()] == [
        ("u", "A\n"), ("v", "B"), ("w", ""), ("x", ""), ("y", ""), ("z", ""), ("u2", "A\n")]
    plan = crawl._jdf.queryExecution().executedPlan().toString()
    assert "exact_folder" not in plan and "Join" not in plan
