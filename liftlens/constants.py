"""Names, thresholds, labels and text formats every result depends on."""

# Table columns.
PAGE_COLUMNS = ["page", "url", "design_group"]
GSC_COLUMNS = ["date", "page", "segment", "clicks", "impressions", "position"]
INTERVENTION_COLUMNS = ["intervention_id", "page", "type", "date", "description"]
LIGHTHOUSE_COLUMNS = ["page", "snapshot", "date", "performance", "accessibility", "seo", "lcp_ms", "cls", "inp_ms"]
AUTHORITY_COLUMNS = ["date", "metric", "source", "value"]
CRAWL_INDEX_COLUMNS = ["url", "file", "status", "content_type"]
SNAPSHOT_FILES = {
    "pages.csv": PAGE_COLUMNS,
    "gsc_daily.csv": GSC_COLUMNS,
    "interventions.csv": INTERVENTION_COLUMNS,
    "lighthouse.csv": LIGHTHOUSE_COLUMNS,
    "authority.csv": AUTHORITY_COLUMNS,
    "crawl/before/index.csv": CRAWL_INDEX_COLUMNS,
    "crawl/after/index.csv": CRAWL_INDEX_COLUMNS,
}
HASH_LIST = "SHA256SUMS"
REQUIRED_FILES = ["SNAPSHOT.yaml", HASH_LIST, *SNAPSHOT_FILES]

# Domains.
SEGMENTS = ["local", "general"]
ALL_SEGMENTS = "all"
INTERVENTION_TYPES = ["technical", "content", "local", "accessibility", "links"]
SITE_WIDE_TYPES = ["links"]
DESIGN_GROUPS = ["technical", "content", "local", "accessibility"]
SNAPSHOTS = ["before", "after"]
SCORES = ["performance", "accessibility", "seo"]
MEASURES = ["performance", "accessibility", "seo", "lcp_ms", "cls", "inp_ms"]
KINDS = ["did", "did_difference", "descriptive"]
METRICS = ["position", "ctr_adjusted", "clicks", "domain_authority"]

# Click-rate bins by position, left-closed lower edges.
CTR_EDGES = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 15, 20, 30]
CTR_MODEL = "ctr-bins-v1"
EFFECT_MODEL = "did-v2"
MODELS = ["did", "naive_prepost", "did_raw_ctr"]

# Audit thresholds.
TITLE_MIN = 10
TITLE_MAX = 60
META_DESCRIPTION_MAX = 160

# Audit issues by category.
ISSUES_BY_CATEGORY = {
    "technical": ["http_error", "missing_viewport", "missing_canonical", "noindex", "broken_internal_link"],
    "content": ["missing_title", "title_too_short", "title_too_long", "duplicate_title",
                "missing_meta_description", "meta_description_too_long", "duplicate_meta_description",
                "missing_h1", "multiple_h1", "missing_structured_data", "invalid_structured_data"],
    "accessibility": ["img_missing_alt", "missing_lang", "heading_level_skip", "input_missing_label",
                      "empty_link_text"],
}
CATEGORIES = list(ISSUES_BY_CATEGORY)

# Html names the audit looks at.
NON_PAGE_LINK_PREFIXES = ["mailto:", "tel:", "javascript:", "#"]
CONTROL_TAGS = ["input", "select", "textarea"]
SELF_LABELLED_INPUT_TYPES = ["hidden", "submit", "button", "image", "reset"]
JSON_LD = "application/ld+json"

# Decisions and their descriptive variants.
SUPPORTED = "podprta"
REJECTED = "ni podprta"
UNDECIDED = "neodločeno"
NO_DATA = "ni dovolj podatkov"
TREND_REACHED = "prag dosežen (opisno)"
TREND_NOT_REACHED = "prag ni dosežen (opisno)"
TREND_RUNNING = "neodločeno – obdobje še traja"
TREND_NO_BASELINE = "no authority value before the link-building start"

# Labels and sentences of the report tables.
TREATED_SERIES = "Obravnavane strani – "
CONTROL_SERIES = "Kontrolne strani"
INTERVENTION_LABELS = {"technical": "tehnična", "content": "vsebinska", "local": "lokalna",
                       "accessibility": "dostopnost", "links": "povratne povezave"}
METRIC_LABELS = {"position": "povprečni položaj", "ctr_adjusted": "CTR, prilagojen položaju", "clicks": "kliki",
                 "domain_authority": "Domain Authority", "ctr_raw": "neprilagojen CTR"}
MODEL_LABELS = {"did": "razlika razlik (glavni model)", "naive_prepost": "pred/po brez kontrolne skupine",
                "did_raw_ctr": "razlika razlik brez prilagoditve položaju", "descriptive": "opisno"}
MODE_LABELS = {"synthetic": "Sintetični scenarij: fiktivno spletišče z znanimi vnesenimi učinki",
               "snapshot": "Shranjen posnetek podatkov resničnega spletišča"}
CLAIM_SECTIONS = {"H1": "3.3", "H2": "3.3", "H3": "3.3", "H4": "3.4", "H5": "3.3"}
CLAIM_OTHER_SECTION = "3"
CLAIM_AUDIT_SECTION = "3.2"
CLAIM_ESTIMATED = "%s: ocenjeni učinek %s (Bonferroni %.2f%% IZ %s do %s); odločitev: %s."
CLAIM_OTHER = "%s: %s (%s)."
CLAIM_AUDIT = "Revizija je našla %d težav pred in %d po optimizaciji."
CLAIM_SYNTHETIC_LIMIT = "sintetični podatki, ni dokaz za resnično spletišče"
CLAIM_AUDIT_LIMIT = "hevristični pregled HTML; ne nadomešča Lighthouse/WAVE"
CLAIM_METRICS_FILE = "metrics/metrics.csv"
CLAIM_AUDIT_FILE = "report/tables/audit_summary.csv"
NO_PERCENT = "—"
