"""SQL twins of the registered queries, for DuckDB over the driver tables.

Each twin is a final select over named common table expressions; only the expressions it needs, and
the ones those need, are put in front of it.
"""

from __future__ import annotations

import re

from liftlens import constants as C
from liftlens.operators.bootstrap import BLOCK_SLOTS
from liftlens.operators.design import DESIGN_COLUMNS
from liftlens.sources.fixtures import BODY_PARTS, HEAD_PARTS, LONG_TITLE, SHORT_TITLE, STUDY

P = STUDY
_TAIL, _TAIL_ADJ = (1 - P.ci_level) / 2, (1 - P.ci_level_adj) / 2
_AVAIL = f"DATE '{P.available_until}'"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _values(rows: list[tuple], columns: str) -> str:
    def cell(v):
        return "NULL" if v is None else _text(v) if isinstance(v, str) else repr(v)
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows) + f") t({columns})"


CTES: dict[str, str] = {}

# Study tables.
CTES["ev"] = """
SELECT CAST(ts AS DATE) AS d, user_id AS u, printf('U%06d', user_id) AS page, event_type, value,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
FROM events"""
CTES["users"] = "SELECT DISTINCT u, page FROM ev"
CTES["site_pages"] = """
SELECT page, 'https://site.test/u/' || u || '/' AS url,
       list_extract(['technical', 'content', 'local', 'accessibility', 'control'], u % 5 + 1) AS design_group
FROM users"""
CTES["gsc"] = """
SELECT g.d AS date, g.page, g.segment, CAST(coalesce(o.clicks, 0) AS BIGINT) AS clicks,
       CAST(coalesce(o.impressions, 0) AS BIGINT) AS impressions, o.position
FROM (SELECT CAST(day AS DATE) AS d, page, segment
      FROM (SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS day FROM ev), users,
           (VALUES ('local'), ('general')) s(segment)) g
LEFT JOIN (SELECT d, page, CASE WHEN k < 50 THEN 'local' ELSE 'general' END AS segment,
                  count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) AS impressions,
                  avg(1 + value / 5) AS position
           FROM ev GROUP BY ALL) o USING (d, page, segment)"""
CTES["page_panel"] = """
SELECT date, page, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions,
       CASE WHEN sum(impressions) > 0
            THEN sum(coalesce(position, 0) * impressions) / sum(impressions) END AS position
FROM gsc GROUP BY date, page"""
CTES["view"] = f"""
SELECT 'all' AS segment, date, page, clicks, impressions, position FROM page_panel WHERE date <= {_AVAIL}
UNION ALL SELECT segment, date, page, clicks, impressions, position FROM gsc WHERE date <= {_AVAIL}"""
CTES["changes"] = """
SELECT 'I' || u AS intervention_id, page, list_extract(['technical', 'content', 'local', 'accessibility'], u % 5 + 1) AS type,
       CAST(DATE '2024-01-18' + CAST(u % 5 + (u // 10) % 2 AS INTEGER) AS DATE) AS date, '' AS description
FROM users WHERE u % 5 < 4
UNION ALL SELECT 'L01', '*', 'links', DATE '2024-01-20', ''"""
CTES["authority_site"] = """
SELECT d AS date, 'domain_authority' AS metric, 'events' AS source, floor(running / (total / 30)) AS value
FROM (SELECT d, sum(n) OVER (ORDER BY d) AS running, sum(n) OVER () AS total
      FROM (SELECT d, count(*) AS n FROM ev GROUP BY d))"""
CTES["scores"] = """
SELECT page, snapshot, CASE WHEN snapshot = 'before' THEN DATE '2024-01-10' ELSE DATE '2024-01-28' END AS date,
""" + ",\n".join(
    f"CAST(CAST('0x' || substr(md5(u || '|' || snapshot || '|{m}'), 1, 8) AS BIGINT) % {modulus} AS INTEGER){rest} AS {m}"
    for m, modulus, rest in (("performance", 101, ""), ("accessibility", 101, ""), ("seo", 101, ""),
                             ("lcp_ms", 4000, " + 500"), ("cls", 300, " / 1000"), ("inp_ms", 400, ""))) + """
FROM users, (VALUES ('before'), ('after')) s(snapshot)"""
CTES["hyp"] = _values(
    [(i, h.id, h.kind, h.intervention, h.compare_to, h.metric, h.segment, float(h.threshold), h.horizon_days,
      h.statement, h.limitation) for i, h in enumerate(P.hypotheses)],
    "ordinal, hypothesis_id, kind, intervention, compare_to, metric, segment, threshold, horizon_days, statement, limitation")
CTES["arms"] = """
SELECT hypothesis_id, metric, segment, 'a' AS arm, intervention AS type FROM hyp WHERE kind <> 'descriptive'
UNION ALL SELECT hypothesis_id, metric, segment, 'b', compare_to FROM hyp WHERE kind = 'did_difference'"""
CTES["models"] = """
SELECT hypothesis_id, kind, model, CASE WHEN model = 'did_raw_ctr' THEN 'ctr_raw' ELSE metric END AS metric
FROM hyp, (VALUES ('did'), ('naive_prepost'), ('did_raw_ctr')) m(model)
WHERE kind <> 'descriptive' AND (model <> 'did_raw_ctr' OR metric = 'ctr_adjusted')"""
CTES["treated_dates"] = """
SELECT type, page, min(date) AS treated_on FROM changes WHERE type <> 'links' GROUP BY type, page"""
CTES["train_end"] = f"SELECT CAST(min(date) - {P.buffer_days} AS DATE) AS train_end FROM changes"

# Click-rate curve.
_BIN = "greatest(0, " + " + ".join(f"CAST(position >= {e} AS INTEGER)" for e in C.CTR_EDGES) + " - 1)"
CTES["curve"] = f"""
SELECT b.bin, b.edge, clicks, impressions,
       round(coalesce(last_value(own IGNORE NULLS) OVER (ORDER BY b.bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                      first_value(own IGNORE NULLS) OVER (ORDER BY b.bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
                      sum(clicks) OVER () / nullif(sum(impressions) OVER (), 0), 0), 12) AS ctr,
       CAST(sum(training_rows) OVER () AS BIGINT) AS training_rows
FROM (SELECT bins.bin, bins.edge, CAST(coalesce(clicks, 0) AS BIGINT) AS clicks,
             CAST(coalesce(impressions, 0) AS BIGINT) AS impressions, coalesce(training_rows, 0) AS training_rows,
             CASE WHEN impressions > 0 THEN clicks / impressions END AS own
      FROM ({_values([(i, float(e)) for i, e in enumerate(C.CTR_EDGES)], "bin, edge")}) bins
      LEFT JOIN (SELECT {_BIN} AS bin, sum(clicks) AS clicks, sum(impressions) AS impressions, count(*) AS training_rows
                 FROM page_panel, train_end
                 WHERE date < train_end AND date <= {_AVAIL} AND impressions > 0 GROUP BY 1) s USING (bin)) b"""


def _study(tag: str, shift: int) -> None:
    """Windows, values and changes of the real (``tag`` empty) or the placebo design."""
    placebo_end = f", window_key - {P.buffer_days}" if shift else ""
    CTES["cohorts" + tag] = f"""
SELECT hypothesis_id, arm, type, metric, segment, window_key, CAST(anchor AS DATE) AS intervention_date,
       {_AVAIL} AS label_cutoff, CAST(greatest(post_end - post_start, 0) AS INTEGER) AS post_days_effective,
       greatest(post_end - post_start, 0) >= {P.min_post_days} AS window_eligible, period,
       CASE WHEN period = 'pre' THEN pre_end - {P.pre_days} ELSE post_start END AS start,
       CASE WHEN period = 'pre' THEN pre_end ELSE greatest(post_end, post_start) END AS "end"
FROM (SELECT *, anchor - {P.buffer_days} AS pre_end, anchor + {P.ramp_days} AS post_start,
             least(anchor + {P.ramp_days} + {P.post_days}, {_AVAIL} + 1{placebo_end}) AS post_end
      FROM (SELECT *, window_key - {shift} AS anchor
            FROM arms JOIN (SELECT DISTINCT type, treated_on AS window_key FROM treated_dates) USING (type))),
     (VALUES ('pre'), ('post')) x(period)"""
    CTES["design" + tag] = f"""
SELECT hypothesis_id, arm, window_key, page, 'treated' AS role, period, start, "end", intervention_date, label_cutoff,
       post_days_effective, window_eligible, metric, segment
FROM cohorts{tag} c JOIN treated_dates t ON t.type = c.type AND t.treated_on = c.window_key
UNION ALL
SELECT hypothesis_id, arm, window_key, page, 'control', period, start, "end", intervention_date, label_cutoff,
       post_days_effective, window_eligible, metric, segment
FROM cohorts{tag}, site_pages WHERE design_group = 'control'"""
    CTES["sums" + tag] = f"""
SELECT d.hypothesis_id, d.arm, d.window_key, d.page, d.role, d.period, d.metric, d.window_eligible,
       d."end" - d.start AS days, count(v.date) AS n, count(*) FILTER (WHERE v.impressions > 0) AS shown,
       sum(v.clicks) AS clicks, sum(v.clicks) FILTER (WHERE v.impressions > 0) AS shown_clicks,
       sum(v.impressions) FILTER (WHERE v.impressions > 0) AS imps,
       sum(v.position * v.impressions) FILTER (WHERE v.impressions > 0) AS weight,
       sum(v.impressions * v.expected_ctr) FILTER (WHERE v.impressions > 0) AS expected
FROM design{tag} d
LEFT JOIN (SELECT view.*, c.ctr AS expected_ctr
           FROM (SELECT *, {_BIN} AS bin FROM view) view LEFT JOIN (SELECT bin, ctr FROM curve) c USING (bin)) v
  ON v.page = d.page AND v.segment = d.segment AND v.date >= d.start AND v.date < d."end" AND v.date <= d.label_cutoff
GROUP BY ALL"""
    CTES["windows" + tag] = f"""
SELECT hypothesis_id, arm, window_key, page, role, period, m.metric AS metric, CAST(m.n_days AS INTEGER) AS n_days,
       m.value AS value, eligible
FROM (SELECT *, CASE WHEN role = 'treated' THEN ok ELSE window_eligible AND coalesce(
                  bool_and(CASE WHEN role = 'control' AND window_eligible THEN ok END)
                    OVER (PARTITION BY hypothesis_id, page), false) END AS eligible,
             unnest(CASE WHEN metric = 'ctr_adjusted'
                         THEN [{{'metric': metric, 'n_days': n_days, 'value': main}},
                               {{'metric': 'ctr_raw', 'n_days': shown, 'value': raw}}]
                         ELSE [{{'metric': metric, 'n_days': n_days, 'value': main}}] END) AS m
      FROM (SELECT *, min(n_days) OVER (PARTITION BY hypothesis_id, arm, window_key, page, role)
                        >= {P.min_days_per_window} AND window_eligible AS ok
            FROM (SELECT *, CASE WHEN metric = 'clicks' AND NOT (n > 0 AND days > 0) THEN 0 ELSE shown END AS n_days,
                         CASE WHEN shown > 0 THEN ln((shown_clicks + 0.5) / (imps + 0.5)) END AS raw,
                         CASE WHEN metric = 'position' AND shown > 0 THEN ln(weight / imps)
                              WHEN metric = 'clicks' AND n > 0 AND days > 0 THEN ln((clicks + 0.5) / days)
                              WHEN metric = 'ctr_adjusted' AND shown > 0
                              THEN ln((shown_clicks + 0.5) / (expected + 0.5)) END AS main
                  FROM sums{tag})))"""
    CTES["deltas" + tag] = f"""
SELECT *, post - pre AS delta
FROM (SELECT hypothesis_id, metric, arm, window_key, page, role, max(value) FILTER (WHERE period = 'pre') AS pre,
             max(value) FILTER (WHERE period = 'post') AS post
      FROM windows{tag} WHERE eligible GROUP BY ALL)
WHERE pre IS NOT NULL AND post IS NOT NULL"""
    CTES["predictions" + tag] = f"""
SELECT 'run' AS run_id, d.hypothesis_id, m.model, '{C.EFFECT_MODEL}' AS model_version, d.arm, d.window_key, d.page,
       'treated' AS role, 'post' AS split, 'log_' || d.metric AS target_name, d.post AS target,
       CASE WHEN m.model = 'naive_prepost' THEN d.pre ELSE d.pre + c.control_delta END AS prediction,
       DATE '{P.analysis_cutoff}' AS issued_at, w.intervention_date, w.start AS target_start, w."end" AS target_end,
       w.label_cutoff
FROM deltas{tag} d
JOIN (SELECT hypothesis_id, metric, arm, window_key, avg(delta) AS control_delta
      FROM deltas{tag} WHERE role = 'control' GROUP BY ALL) c USING (hypothesis_id, metric, arm, window_key)
JOIN models m ON m.hypothesis_id = d.hypothesis_id AND m.metric = d.metric
LEFT JOIN cohorts{tag} w ON w.hypothesis_id = d.hypothesis_id AND w.arm = d.arm AND w.window_key = d.window_key
  AND w.period = 'post'
WHERE d.role = 'treated'""" + (" AND m.model = 'did'" if shift else "")
    CTES["effects" + tag] = f"""
SELECT hypothesis_id, model, metric,
       max(effect) FILTER (WHERE arm = 'a')
         - CASE WHEN kind = 'did_difference' THEN max(effect) FILTER (WHERE arm = 'b') ELSE 0 END AS estimate
FROM (SELECT p.hypothesis_id, p.model, p.arm, m.metric, m.kind,
             (exp(avg(target - prediction)) - 1) * CASE WHEN m.metric = 'position' THEN -1 ELSE 1 END AS effect
      FROM predictions{tag} p JOIN models m USING (hypothesis_id, model)
      GROUP BY p.hypothesis_id, p.model, p.arm, m.metric, m.kind)
GROUP BY hypothesis_id, model, metric, kind"""
    CTES["sizes" + tag] = f"""
SELECT *, n_control >= 2 AND smallest >= 2 AS enough
FROM (SELECT m.hypothesis_id, m.model, m.metric, CAST(coalesce(sum(pages), 0) AS INTEGER) AS n_treated,
             min(coalesce(pages, 0)) AS smallest,
             coalesce(string_agg('''' || a.arm || ''': ' || pages, ', ' ORDER BY a.arm), '') AS listed
      FROM models m JOIN arms a USING (hypothesis_id)
      LEFT JOIN (SELECT hypothesis_id, model, arm, count(DISTINCT page) AS pages FROM predictions{tag} GROUP BY ALL) x
        USING (hypothesis_id, model, arm)
      GROUP BY ALL)
JOIN (SELECT m.hypothesis_id, m.model, CAST(count(DISTINCT CASE WHEN role = 'control' THEN page END) AS INTEGER) AS n_control,
             coalesce(min(n_days), 0) AS min_window_days
      FROM models m LEFT JOIN (SELECT * FROM windows{tag} WHERE eligible) w
        ON w.hypothesis_id = m.hypothesis_id AND w.metric = m.metric GROUP BY ALL) USING (hypothesis_id, model)"""
    CTES["control_rank" + tag] = f"""
SELECT hypothesis_id, metric, page, count(*) OVER g AS n,
       row_number() OVER (PARTITION BY hypothesis_id, metric ORDER BY substr(md5(page), 1, 3), page) - 1 AS slot
FROM (SELECT hypothesis_id, metric, page, count(*) AS cells FROM deltas{tag} WHERE role = 'control' GROUP BY ALL)
JOIN (SELECT hypothesis_id, metric, count(DISTINCT arm || window_key) AS cohorts
      FROM deltas{tag} WHERE role = 'control' GROUP BY ALL) USING (hypothesis_id, metric)
WHERE cells = cohorts
WINDOW g AS (PARTITION BY hypothesis_id, metric)"""
    CTES["treated_rank" + tag] = f"""
SELECT hypothesis_id, metric, arm, page, window_key, delta, count(*) OVER (PARTITION BY hypothesis_id, metric, arm) AS n,
       row_number() OVER (PARTITION BY hypothesis_id, metric, arm
                          ORDER BY substr(md5(page || '|' || window_key), 1, 3), page, window_key) - 1 AS slot
FROM deltas{tag} WHERE role = 'treated'"""
    usable = (f"(SELECT m.* FROM models m JOIN sizes{tag} USING (hypothesis_id, model) WHERE enough"
              + (" AND m.model = 'did'" if shift else "") + ") m")
    for side, rank, of, by, role, which in (
            ("control", "control_rank", "", "hypothesis_id, metric", "'control'", "m.model <> 'naive_prepost'"),
            ("treated", "treated_rank", ", s.arm", "hypothesis_id, metric, arm", "arm", "true")):
        name, plain = f"{side}_split{tag}", of.replace("s.", "")
        text = (f"({P.seed} || '|' || hypothesis_id || '|' || model || '|{'placebo' if shift else ''}|' || {role} || '|' || rep)")
        columns = f"hypothesis_id, model, kind, metric{plain}, rep, n, low, high"
        thrown = (f"list_sum(list_transform(range(0, (undecided + 59) // 60), lambda j: bit_count(CAST('0x' || substr(md5({text}"
                  " || '|' || low || '|' || high || '|' || place || '|' || j), 1, 15) AS BIGINT) >> (60 - least(60, undecided - 60 * j)))))")
        # Each step decides one place of the binary expansion of a range's left share, or halves a range whose draws are decided.
        CTES[name] = f"""
WITH RECURSIVE tree AS (
  SELECT m.hypothesis_id, m.model, m.kind, m.metric{of}, rep, CAST(n AS BIGINT) AS n, CAST(0 AS BIGINT) AS low,
         CAST((n + {BLOCK_SLOTS - 1}) // {BLOCK_SLOTS} AS BIGINT) AS high, CAST(n AS BIGINT) AS drawn, CAST(n AS BIGINT) AS undecided,
         CAST(0 AS BIGINT) AS won, least(n, {BLOCK_SLOTS} * (((n + {BLOCK_SLOTS - 1}) // {BLOCK_SLOTS} + 1) // 2))::BIGINT AS rest, 1 AS place
  FROM {usable} JOIN {rank}{tag} s ON s.hypothesis_id = m.hypothesis_id AND s.metric = m.metric AND s.slot = 0,
       range({P.bootstrap_reps}) reps(rep)
  WHERE {which}
  UNION ALL
  (SELECT {columns}, drawn, CASE WHEN one THEN ones ELSE undecided - ones END,
         CASE WHEN one THEN won + undecided - ones ELSE won END, rest * 2 - CASE WHEN one THEN whole ELSE 0 END, place + 1
  FROM (SELECT *, {thrown}::BIGINT AS ones, rest * 2 >= whole AS one
        FROM (SELECT *, least(high * {BLOCK_SLOTS}, n) - low * {BLOCK_SLOTS} AS whole FROM tree
              WHERE high - low > 1 AND undecided > 0 AND place <= 60))
  UNION ALL
  SELECT hypothesis_id, model, kind, metric{plain}, rep, n, below, above, part, part, 0,
         least((below + (above - below + 1) // 2) * {BLOCK_SLOTS}, n) - below * {BLOCK_SLOTS}, 1
  FROM (SELECT *, CASE side WHEN 0 THEN low ELSE middle END AS below, CASE side WHEN 0 THEN middle ELSE high END AS above,
               CASE side WHEN 0 THEN won ELSE drawn - won END AS part
        FROM (SELECT *, low + (high - low + 1) // 2 AS middle FROM tree
              WHERE high - low > 1 AND (undecided = 0 OR place > 60)), range(2) sides(side))
  WHERE part > 0))
SELECT hypothesis_id, model, kind, metric{plain}, rep,
       low * {BLOCK_SLOTS} + CAST('0x' || substr(md5({text} || '|' || low || '|in|' || draw), 1, 15) AS BIGINT)
         % least({BLOCK_SLOTS}, n - low * {BLOCK_SLOTS}) AS slot
FROM tree, range(1, drawn + 1) drawing(draw) WHERE high - low = 1"""
    CTES["draws" + tag] = f"""
SELECT hypothesis_id, model, rep,
       max(effect) FILTER (WHERE arm = 'a')
         - CASE WHEN kind = 'did_difference' THEN max(effect) FILTER (WHERE arm = 'b') ELSE 0 END AS draw
FROM (SELECT t.hypothesis_id, t.model, t.kind, t.rep, t.arm,
             (exp(sum(total - CASE WHEN t.model = 'naive_prepost' THEN 0 ELSE picked * control_mean END) / sum(picked)) - 1)
               * CASE WHEN t.metric = 'position' THEN -1 ELSE 1 END AS effect
      FROM (SELECT x.hypothesis_id, x.model, x.kind, x.metric, x.rep, x.arm, r.window_key, sum(r.delta) AS total,
                   count(*) AS picked
            FROM treated_split{tag} x
            JOIN treated_rank{tag} r USING (hypothesis_id, metric, arm, slot) GROUP BY ALL) t
      LEFT JOIN (SELECT x.hypothesis_id, x.model, x.rep, d.arm, d.window_key, avg(d.delta) AS control_mean
                 FROM control_split{tag} x
                 JOIN control_rank{tag} r USING (hypothesis_id, metric, slot)
                 JOIN deltas{tag} d ON d.hypothesis_id = r.hypothesis_id AND d.metric = r.metric AND d.page = r.page
                   AND d.role = 'control'
                 GROUP BY ALL) c USING (hypothesis_id, model, rep, arm, window_key)
      GROUP BY t.hypothesis_id, t.model, t.kind, t.metric, t.rep, t.arm)
GROUP BY hypothesis_id, model, kind, rep"""
    CTES["bounds" + tag] = f"""
SELECT hypothesis_id, model, """ + ", ".join(
        f"quantile_cont(draw, {q:.17e}) AS {name}" for name, q in (
            ("ci_low", _TAIL), ("ci_high", 1 - _TAIL), ("ci_low_adj", _TAIL_ADJ), ("ci_high_adj", 1 - _TAIL_ADJ))) + f"""
FROM draws{tag} GROUP BY hypothesis_id, model"""

    def decided(low, high):
        return (f"CASE WHEN NOT enough THEN {_text(C.NO_DATA)} WHEN {low} >= threshold THEN {_text(C.SUPPORTED)} "
                f"WHEN {high} < threshold THEN {_text(C.REJECTED)} ELSE {_text(C.UNDECIDED)} END")

    CTES["metrics" + tag] = f"""
SELECT 'run' AS run_id, s.hypothesis_id, h.kind, s.model, '{C.EFFECT_MODEL}' AS model_version, s.metric, h.segment,
       h.intervention, h.compare_to, CASE WHEN enough THEN estimate END AS estimate,
       ci_low, ci_high, CAST({P.ci_level} AS DOUBLE) AS ci_level, ci_low_adj, ci_high_adj,
       CAST({P.ci_level_adj} AS DOUBLE) AS ci_level_adj, CAST(threshold AS DOUBLE) AS threshold,
       {decided("ci_low_adj", "ci_high_adj")} AS decision, {decided("ci_low", "ci_high")} AS decision_unadjusted,
       n_treated, n_control, min_window_days, {P.bootstrap_reps} AS bootstrap_reps,
       CASE WHEN enough THEN 'estimated' ELSE 'insufficient_data' END AS status,
       CASE WHEN enough THEN '' ELSE 'treated per arm {{' || listed || '}}, control ' || n_control END AS note
FROM sizes{tag} s JOIN hyp h USING (hypothesis_id)
LEFT JOIN (SELECT hypothesis_id, model, estimate FROM effects{tag}) e USING (hypothesis_id, model)
LEFT JOIN bounds{tag} USING (hypothesis_id, model)"""


_study("", 0)
_study("_p", P.placebo_shift_days)

CTES["trend"] = f"""
SELECT hypothesis_id, kind, metric, segment, intervention, compare_to, CAST(threshold AS DOUBLE) AS threshold,
       latest.value - base.value AS estimate,
       CASE WHEN base IS NULL OR latest IS NULL THEN {_text(C.NO_DATA)}
            WHEN latest.value - base.value >= threshold THEN {_text(C.TREND_REACHED)}
            WHEN {_AVAIL} >= horizon_end THEN {_text(C.TREND_NOT_REACHED)} ELSE {_text(C.TREND_RUNNING)} END AS decision,
       CASE WHEN base IS NULL OR latest IS NULL THEN 'insufficient_data' ELSE 'descriptive' END AS status,
       CASE WHEN base IS NULL OR latest IS NULL THEN {_text(C.TREND_NO_BASELINE)}
            ELSE 'baseline ' || base.date || '=' || CAST(base.value AS BIGINT) || '; last ' || latest.date || '='
                 || CAST(latest.value AS BIGINT) || '; horizon ends ' || horizon_end || '; complete='
                 || CASE WHEN {_AVAIL} >= horizon_end THEN 'True' ELSE 'False' END END AS note
FROM (SELECT h.hypothesis_id, h.kind, h.metric, h.segment, h.intervention, h.compare_to, h.threshold, horizon_end,
             max_by({{'date': a.date, 'value': a.value}}, a.date) FILTER (WHERE a.date <= h.start) AS base,
             max_by({{'date': a.date, 'value': a.value}}, a.date) FILTER (WHERE a.date <= least(horizon_end, {_AVAIL})) AS latest
      FROM (SELECT hyp.*, s.start, CAST(s.start + CAST(horizon_days AS INTEGER) AS DATE) AS horizon_end
            FROM hyp LEFT JOIN (SELECT type, min(date) AS start FROM changes GROUP BY type) s ON s.type = hyp.intervention
            WHERE kind = 'descriptive') h
      LEFT JOIN authority_site a ON a.metric = h.metric AND a.date <= {_AVAIL}
      GROUP BY ALL)"""
_METRIC_NAMES = ["run_id", "hypothesis_id", "kind", "model", "model_version", "metric", "segment", "intervention", "compare_to",
                 "estimate", "ci_low", "ci_high", "ci_level", "ci_low_adj", "ci_high_adj", "ci_level_adj", "threshold",
                 "decision", "decision_unadjusted", "n_treated", "n_control", "min_window_days", "bootstrap_reps", "status",
                 "note"]
CTES["evaluation"] = f"""
SELECT {", ".join(_METRIC_NAMES)} FROM metrics WHERE model = 'did'
UNION ALL
SELECT 'run', hypothesis_id, kind, 'descriptive', '{C.EFFECT_MODEL}', metric, segment, intervention, compare_to, estimate,
       NULL, NULL, CAST({P.ci_level} AS DOUBLE), NULL, NULL, CAST({P.ci_level_adj} AS DOUBLE), threshold, decision, decision,
       NULL, NULL, NULL, {P.bootstrap_reps}, status, note
FROM trend"""

_LO = -((P.buffer_days + P.pre_days + 6) // 7)
_END = (P.ramp_days + P.post_days + 6) // 7
_BASE = (-P.buffer_days - 1) // 7
CTES["series"] = f"""
WITH pieces AS (
  SELECT DISTINCT w.hypothesis_id, w.metric, w.arm, w.window_key, w.page, w.role, a.segment,
         CASE WHEN w.role = 'control' THEN {_text(C.CONTROL_SERIES)} ELSE {_text(C.TREATED_SERIES)} || l.label END AS name
  FROM windows w JOIN arms a ON a.hypothesis_id = w.hypothesis_id AND a.arm = w.arm AND a.metric = w.metric
  JOIN ({_values(list(C.INTERVENTION_LABELS.items()), "type, label")}) l ON l.type = a.type
  WHERE eligible AND (w.role = 'treated' OR w.arm = 'a')),
weekly AS (
  SELECT p.hypothesis_id, p.metric, p.arm, p.window_key, p.page, p.role, p.name,
         CAST(floor((v.date - p.window_key) / 7) AS INTEGER) AS week,
         CASE WHEN p.metric = 'position' THEN avg(v.position) FILTER (WHERE v.impressions > 0)
              WHEN p.metric = 'clicks' THEN avg(v.clicks)
              ELSE sum(v.clicks) FILTER (WHERE v.impressions > 0)
                   / sum(v.impressions * v.expected_ctr) FILTER (WHERE v.impressions > 0) END AS weekly
  FROM pieces p
  JOIN (SELECT view.*, c.ctr AS expected_ctr FROM (SELECT *, {_BIN.replace("position", "coalesce(position, 1)")} AS bin FROM view) view
        JOIN (SELECT bin, ctr FROM curve) c USING (bin)) v
    ON v.page = p.page AND v.segment = p.segment AND v.date >= p.window_key + 7 * {_LO} AND v.date < p.window_key + 7 * {_END}
  GROUP BY p.hypothesis_id, p.metric, p.arm, p.window_key, p.page, p.role, p.name, 8),
indexed AS (
  SELECT hypothesis_id, name, role, week, avg(100 * weekly / base) AS value
  FROM (SELECT *, avg(weekly) FILTER (WHERE week <= {_BASE})
                    OVER (PARTITION BY hypothesis_id, metric, arm, window_key, page, role, name) AS base
        FROM weekly WHERE weekly IS NOT NULL)
  WHERE base <> 0 GROUP BY ALL)
SELECT g.hypothesis_id, g.name, g.role, CAST(g.week AS INTEGER) AS week, round(i.value, 3) AS value
FROM (SELECT DISTINCT hypothesis_id, name, role, unnest(range({_LO}, {_END})) AS week FROM indexed) g
LEFT JOIN indexed i ON i.hypothesis_id = g.hypothesis_id AND i.name = g.name AND i.role = g.role AND i.week = g.week"""

# Crawl and audit.
_URL = r"^([a-zA-Z][a-zA-Z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]+)?"


def _normal(url: str) -> str:
    return (f"lower(regexp_extract({url}, '{_URL}', 1)) || '://' || lower(regexp_extract({url}, '{_URL}', 2)) || "
            f"CASE WHEN regexp_extract({url}, '{_URL}', 3) = '' THEN '/' ELSE regexp_extract({url}, '{_URL}', 3) END || "
            f"regexp_extract({url}, '{_URL}', 4)")


_CLEAN = r"""regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g')"""
def _parts(parts: dict) -> str:
    return " || ".join(f"CASE WHEN page_id % {m} = {r} THEN {_text(text)} ELSE '' END" for (m, r), text in parts.items())


CTES["shaped"] = f"""
SELECT page_id, url, replace(replace(html, '</head>', {_parts(HEAD_PARTS)} || '</head>'), '<body>', '<body>' || {_parts(BODY_PARTS)}) AS html
FROM (SELECT page_id, url, CASE WHEN page_id % 13 IN (5, 6, 8)
                                THEN regexp_replace(html, '(?s)<title>.*?</title>', CASE page_id % 13 WHEN 6 THEN {_text(LONG_TITLE)} WHEN 8 THEN {_text(SHORT_TITLE)} ELSE '' END)
                                ELSE html END AS html
      FROM (SELECT page_id, url, CASE WHEN page_id % 13 = 4 THEN replace(replace(html, '<h1>', '<h2>'), '</h1>', '</h2>') ELSE html END AS html
            FROM (SELECT page_id, url, CASE WHEN page_id % 11 = 5 THEN regexp_replace(html, '<html lang="[^"]*">', '<html>') ELSE html END AS html
                  FROM pages)))"""
CTES["crawl_pages"] = """
SELECT label, url, page_id, CASE WHEN page_id % 23 = 0 THEN 404 ELSE 200 END AS status,
       CASE WHEN page_id % 23 = 0 THEN ''
            WHEN label = 'before' THEN html
            ELSE regexp_replace(html, '<head>', '<head>'
              || CASE WHEN page_id % 5 < 2
                      THEN '<meta name="viewport" content="w"><link rel="canonical" href="' || url || '">' ELSE '' END
              || CASE WHEN page_id % 5 IN (1, 2)
                      THEN '<meta name="description" content="Page ' || page_id % 40 || '">' ELSE '' END) END AS html
FROM shaped, (VALUES ('before'), ('after')) s(label)"""
CTES["stored"] = """
SELECT label, url, status, html, 'crawl/' || label || '/' AS folder,
       CASE WHEN html <> '' THEN 'page_' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END || '.html'
            ELSE '' END AS file, n
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY url, page_id) AS n FROM crawl_pages)"""
CTES["stored_files"] = r"""
SELECT folder || file AS path, sha256(html) AS sha256 FROM stored WHERE file <> ''
UNION ALL
SELECT folder || 'index.csv', sha256('url,file,status,content_type' || chr(10) || string_agg(
         CASE WHEN regexp_matches(url, '[,"\n\r]') THEN '"' || replace(url, '"', '""') || '"' ELSE url END
         || ',' || file || ',' || status || ',text/html' || chr(10), '' ORDER BY n))
FROM stored GROUP BY folder"""
CTES["parsed"] = f"""
SELECT label, page_id, {_normal("url")} AS url, lower(regexp_extract(url, '{_URL}', 1)) || '://' || lower(regexp_extract(url, '{_URL}', 2)) AS origin,
       html, {_CLEAN} AS clean
FROM crawl_pages WHERE status < 400 AND html <> ''"""
CTES["edges"] = r"""
SELECT label, page_id, src, CAST(anchor_pos - 1 AS INTEGER) AS anchor_pos, origin || href AS dst, href
FROM (SELECT label, page_id, url AS src, origin, unnest(hrefs) AS href, unnest(range(1, len(hrefs) + 1)) AS anchor_pos
      FROM (SELECT *, list_filter(regexp_extract_all(clean, '(?i)<a [^>]*?href="([^"]*)"', 1),
                                  lambda h: starts_with(h, '/') AND NOT starts_with(h, '//')) AS hrefs FROM parsed))"""
CTES["status_of"] = f"""
SELECT label, url, max_by(status, page_id) AS status FROM (SELECT label, {_normal("url")} AS url, status, page_id FROM crawl_pages) GROUP BY ALL
UNION ALL
SELECT label, dst, CASE WHEN max(length(href)) % 7 = 0 THEN 404 ELSE 200 END
FROM edges WHERE (label, dst) NOT IN (SELECT (label, {_normal("url")}) FROM crawl_pages) GROUP BY ALL"""
CTES["numbered"] = f"""
SELECT url, origin, row_number() OVER (PARTITION BY origin ORDER BY page_id) AS n
FROM (SELECT page_id, {_normal("url")} AS url, lower(regexp_extract(url, '{_URL}', 1)) || '://' || lower(regexp_extract(url, '{_URL}', 2)) AS origin
      FROM pages)"""
CTES["ways"] = """
SELECT label, src, dst, 0 AS kind, anchor_pos FROM edges
UNION ALL
SELECT p.label, p.url, door.url, 1, door.n
FROM parsed p JOIN numbered own ON own.url = p.url JOIN numbered door ON door.origin = own.origin AND door.n // 2 = own.n"""
CTES["errors"] = f"""
SELECT label, {_normal("url")} AS url, status FROM crawl_pages WHERE status >= 400
UNION ALL SELECT label, url, status FROM status_of WHERE status >= 400
  AND (label, url) NOT IN (SELECT (label, {_normal("url")}) FROM crawl_pages)"""
CTES["facts"] = r"""
SELECT p.label, p.url, title, CAST(length(title) AS INTEGER) AS title_length, description AS meta_description,
       CAST(length(description) AS INTEGER) AS meta_description_length,
       CAST(len(regexp_extract_all(clean, '(?i)<h1[\s/>]')) AS INTEGER) AS h1_count,
       CAST(len(list_filter(range(1, len(levels)), lambda i: levels[i + 1] > levels[i] + 1)) AS INTEGER) AS heading_level_skips,
       regexp_matches(clean, '(?i)<link [^>]*rel="canonical"') AS has_canonical,
       regexp_matches(clean, '(?i)<meta [^>]*name="viewport"') AS has_viewport,
       regexp_matches(clean, '(?i)<meta [^>]*name="robots"[^>]*content="[^"]*noindex') AS noindex,
       trim(regexp_extract(clean, '(?i)<html [^>]*lang="([^"]*)"', 1)) AS lang,
       CAST(len(regexp_extract_all(clean, '(?i)<img[\s/>]')) AS INTEGER) AS img_count,
       CAST(len(list_filter(regexp_extract_all(clean, '(?i)<img[\s/>][^>]*>'), lambda t: NOT contains(t, 'alt='))) AS INTEGER) AS img_missing_alt,
       array_to_string(list_sort(flatten(list_transform(
         flatten(list_transform(list_filter(bodies, lambda b: json_valid(b)),
                                lambda b: CASE WHEN json_type(b) = 'ARRAY' THEN json_extract(b, '$[*]') ELSE [CAST(b AS JSON)] END)),
         lambda o: CASE json_type(o, '$."@type"') WHEN 'ARRAY' THEN from_json(json_extract(o, '$."@type"'), '["VARCHAR"]')
                   WHEN 'VARCHAR' THEN [json_extract_string(o, '$."@type"')] ELSE CAST([] AS VARCHAR[]) END))), '|') AS structured_data_types,
       CAST(len(list_filter(bodies, lambda b: NOT json_valid(b))) AS INTEGER) AS invalid_structured_data,
       CAST(coalesce(n, 0) AS INTEGER) AS internal_links,
       CAST(len(list_filter(regexp_extract_all(clean, '(?is)<a [^>]*href=[^>]*>(.*?)</a>', 1),
                            lambda t: trim(regexp_replace(t, '<[^>]*>', '', 'g')) = '')) AS INTEGER) AS empty_link_text,
       CAST(len(list_filter(regexp_extract_all(regexp_replace(clean, '(?is)<label[^>]*>.*?</label>', '', 'g'), '(?i)<(?:input|select|textarea)[\s/>][^>]*'),
                            lambda t: NOT contains(t, 'aria-label') AND NOT contains(t, 'type="hidden"'))) AS INTEGER) AS inputs_without_label
FROM (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(clean, '(?is)<title[^>]*>(.*?)</title>', 1),
               '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g')) AS title,
             trim(regexp_extract(clean, '(?i)<meta name="description" content="([^"]*)"', 1)) AS description,
             list_transform(regexp_extract_all(clean, '(?i)<h([1-6])[\s/>]', 1), lambda x: CAST(x AS INTEGER)) AS levels,
             regexp_extract_all(html, '(?s)<script type="application/ld.json">(.*?)</script>', 1) AS bodies
      FROM parsed) p
LEFT JOIN (SELECT label, page_id, count(DISTINCT dst) AS n FROM edges GROUP BY ALL) USING (label, page_id)"""
_RULES = [
    ("title_length = 0", "missing_title", "''"),
    (f"title_length BETWEEN 1 AND {C.TITLE_MIN - 1}", "title_too_short", "title_length"),
    (f"title_length > {C.TITLE_MAX}", "title_too_long", "title_length"),
    ("meta_description_length = 0", "missing_meta_description", "''"),
    (f"meta_description_length > {C.META_DESCRIPTION_MAX}", "meta_description_too_long", "meta_description_length"),
    ("h1_count = 0", "missing_h1", "''"), ("h1_count > 1", "multiple_h1", "h1_count"),
    ("NOT has_canonical", "missing_canonical", "''"), ("NOT has_viewport", "missing_viewport", "''"),
    ("noindex", "noindex", "''"), ("lang = ''", "missing_lang", "''"),
    ("img_missing_alt > 0", "img_missing_alt", "img_missing_alt"),
    ("heading_level_skips > 0", "heading_level_skip", "heading_level_skips"),
    ("inputs_without_label > 0", "input_missing_label", "inputs_without_label"),
    ("empty_link_text > 0", "empty_link_text", "empty_link_text"),
    ("invalid_structured_data > 0", "invalid_structured_data", "invalid_structured_data"),
    ("invalid_structured_data = 0 AND structured_data_types = ''", "missing_structured_data", "''"),
]
CTES["fact_issues"] = "\nUNION ALL ".join(
    f"SELECT label, url, '{issue}' AS issue, CAST({detail} AS VARCHAR) AS detail FROM facts WHERE {condition}"
    for condition, issue, detail in _RULES)
CTES["broken"] = """
SELECT e.label, e.src AS url, 'broken_internal_link' AS issue, e.dst AS detail
FROM (SELECT DISTINCT label, page_id, src, dst FROM edges) e
JOIN status_of s ON s.label = e.label AND s.url = e.dst AND s.status >= 400"""
for _column, _name in (("title", "duplicate_title"), ("meta_description", "duplicate_meta_description")):
    CTES[_name + "s"] = f"""
SELECT label, url, '{_name}' AS issue, 'shared by ' || n || ' pages' AS detail
FROM (SELECT label, url, count(*) OVER (PARTITION BY label, {_column}) AS n FROM facts WHERE NOT noindex AND {_column} <> '')
WHERE n > 1"""
CTES["categories"] = _values([(issue, category) for category, issues in C.ISSUES_BY_CATEGORY.items() for issue in issues],
                             "issue, category")
CTES["issues"] = """
SELECT * FROM (SELECT label, url, 'http_error' AS issue, CAST(status AS VARCHAR) AS detail FROM errors
               UNION ALL SELECT * FROM fact_issues UNION ALL SELECT * FROM broken
               UNION ALL SELECT * FROM duplicate_titles UNION ALL SELECT * FROM duplicate_meta_descriptions)
JOIN categories USING (issue)"""
CTES["summary"] = """
SELECT category, issue, count(*) FILTER (WHERE label = 'before') AS before, count(*) FILTER (WHERE label = 'after') AS "after"
FROM issues GROUP BY ALL"""

# Damaged tables and the findings on them.


def _at(day: int, user: int, segment: str = "") -> str:
    more = f" AND segment = '{segment}'" if segment else ""
    return f"date = DATE '2024-01-{day:02d}' AND page = 'U{user:06d}'{more}"


CTES["bad_gsc"] = f"""
SELECT CASE WHEN {_at(7, 6)} THEN 'soon' ELSE CAST(date AS VARCHAR) END AS date,
       CASE WHEN {_at(4, 3, "local")} THEN 'P99' ELSE page END AS page,
       CASE WHEN {_at(6, 5, "local")} THEN 'brand' ELSE segment END AS segment,
       CASE WHEN {_at(2, 1, "local")} THEN impressions + 1 WHEN {_at(9, 8, "local")} THEN 0
            WHEN {_at(10, 9, "general")} THEN 1.5 ELSE clicks END AS clicks,
       CASE WHEN {_at(3, 2, "general")} THEN -1 WHEN {_at(5, 4, "local")} THEN greatest(impressions, 1)
            WHEN {_at(9, 8, "local")} THEN 0 ELSE impressions END AS impressions,
       CASE WHEN {_at(5, 4, "local")} THEN 0.5 WHEN {_at(9, 8, "local")} THEN 3.0 ELSE position END AS position
FROM (SELECT * FROM gsc UNION ALL SELECT * FROM gsc WHERE {_at(8, 7, "local")})"""
CTES["bad_changes"] = """
SELECT intervention_id, page, type, CAST(date AS VARCHAR) AS date FROM changes
UNION ALL """ + _values([
    ("IX1", "U000004", "technical", "2024-01-18"), ("IX2", "P98", "content", "2024-01-18"),
    ("IX3", "U000000", "content", "2024-01-18"), ("IX4", "U000001", "links", "2024-01-18"),
    ("IX5", "U000002", "brand", "2024-01-18"), ("I0", "U000000", "technical", "2024-01-18"),
    ("IX6", "U000000", "technical", "soon")], "intervention_id, page, type, date")
CTES["bad_pages"] = """
SELECT page, design_group FROM site_pages UNION ALL SELECT page, design_group FROM site_pages WHERE page = 'U000000'
UNION ALL SELECT 'P77', 'mystery'"""
CTES["bad_scores"] = """
SELECT page, CASE WHEN snapshot = 'before' AND page = 'U000001' THEN 'mid' ELSE snapshot END AS snapshot,
       CASE WHEN snapshot = 'before' AND page = 'U000000' THEN 101 ELSE performance END AS performance, accessibility,
       CASE WHEN snapshot = 'before' AND page = 'U000002' THEN NULL ELSE seo END AS seo
FROM scores"""
CTES["bad_authority"] = """
SELECT CAST(date AS VARCHAR) AS date, CAST(value AS VARCHAR) AS value FROM authority_site UNION ALL SELECT 'soon', 'n/a'"""
CTES["judged"] = """
SELECT c.intervention_id, c.page, c.type, g.grp,
       CASE WHEN g.grp IS NULL THEN 'unknown_page' WHEN g.grp = 'control' THEN 'control_page_intervened'
            WHEN g.grp <> c.type THEN 'type_group_mismatch' END AS code
FROM bad_changes c LEFT JOIN (SELECT page, max(design_group) AS grp FROM bad_pages GROUP BY page) g USING (page)
WHERE c.type <> 'links'"""


def _rows_rule(code: str, condition: str, prefix: str = "") -> str:
    return (f"SELECT '{code}' AS code, 'gsc_daily.csv' AS file, '{prefix}' || count(*) || ' rows' AS detail "
            f"FROM bad_gsc WHERE {condition} HAVING count(*) > 0")


def _once(code: str, file: str, detail: str, rows: str) -> str:
    return f"SELECT '{code}', '{file}', {_text(detail)} WHERE EXISTS ({rows})"


def _listing(code: str, file: str, column: str, rows: str) -> str:
    return f"SELECT DISTINCT '{code}', '{file}', {column} FROM {rows}"


_GSC_DATE = "TRY_CAST(date AS DATE) IS NULL"
CTES["findings"] = "\nUNION ALL ".join([
    _rows_rule("bad_date", _GSC_DATE),
    _rows_rule("negative_or_non_integer", "clicks < 0 OR clicks % 1 <> 0", "clicks: "),
    _rows_rule("negative_or_non_integer", "impressions < 0 OR impressions % 1 <> 0", "impressions: "),
    _rows_rule("clicks_gt_impressions", "clicks > impressions"),
    _rows_rule("position_out_of_range", "impressions > 0 AND (position IS NULL OR position < 1)"),
    _rows_rule("position_without_impressions", "impressions = 0 AND position IS NOT NULL"),
    _once("duplicate_key", "gsc_daily.csv", "date/page/segment must be unique",
          "SELECT 1 FROM bad_gsc GROUP BY date, page, segment HAVING count(*) > 1"),
    _once("duplicate_key", "pages.csv", "page ids must be unique", "SELECT 1 FROM bad_pages GROUP BY page HAVING count(*) > 1"),
    _once("duplicate_key", "interventions.csv", "intervention_id must be unique",
          "SELECT 1 FROM bad_changes GROUP BY intervention_id HAVING count(*) > 1"),
    _listing("unknown_design_group", "pages.csv", "design_group",
             "bad_pages WHERE design_group NOT IN ('technical', 'content', 'local', 'accessibility', 'control')"),
    _listing("unknown_page", "gsc_daily.csv", "page",
             "bad_gsc WHERE page NOT IN (SELECT page FROM bad_pages)"),
    _listing("unknown_segment", "gsc_daily.csv", "segment", "bad_gsc WHERE segment NOT IN ('local', 'general')"),
    _listing("unknown_type", "interventions.csv", "type",
             "bad_changes WHERE type NOT IN ('technical', 'content', 'local', 'accessibility', 'links')"),
    _once("bad_date", "interventions.csv", "unparseable dates", f"SELECT 1 FROM bad_changes WHERE {_GSC_DATE}"),
    "SELECT 'site_wide_page', 'interventions.csv', intervention_id || ': use page ''*''' FROM bad_changes "
    "WHERE type = 'links' AND page <> '*'",
    "SELECT code, 'interventions.csv', intervention_id || ': ' || CASE WHEN code = 'type_group_mismatch' "
    "THEN type || ' on ' || grp || ' page' ELSE page END FROM judged WHERE code IS NOT NULL",
    *[_once("score_out_of_range", "lighthouse.csv", f"{m} must be within 0..100",
            f"SELECT 1 FROM bad_scores WHERE {m} IS NULL OR {m} NOT BETWEEN 0 AND 100") for m in C.SCORES],
    _once("unknown_snapshot", "lighthouse.csv", "snapshot must be before/after",
          "SELECT 1 FROM bad_scores WHERE snapshot NOT IN ('before', 'after')"),
    _once("bad_date", "authority.csv", "unparseable dates", f"SELECT 1 FROM bad_authority WHERE {_GSC_DATE}"),
    _once("non_numeric", "authority.csv", "value must be numeric",
          "SELECT 1 FROM bad_authority WHERE TRY_CAST(value AS DOUBLE) IS NULL"),
    "SELECT 'too_few_pages', 'interventions.csv', hypothesis_id || ': ' || type || ' has ' || n || ' treated pages (need >= 2)' "
    "FROM (SELECT a.hypothesis_id, a.type, count(DISTINCT c.page) AS n FROM (SELECT hypothesis_id, type FROM arms UNION ALL SELECT 'H6', 'links') a LEFT JOIN bad_changes c ON c.type = a.type AND c.type <> 'links' GROUP BY ALL) WHERE n < 2",
    "SELECT 'too_few_pages', 'pages.csv', hypothesis_id || ': control has ' || n || ' pages' "
    "FROM hyp, (SELECT count(*) AS n FROM bad_pages WHERE design_group = 'control') WHERE kind <> 'descriptive' AND n < 2",
])


def _query(final: str) -> str:
    """``final`` with the expressions it needs, in order of definition."""
    needed: set[str] = set()

    def need(sql: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"(?:\bFROM|\bJOIN|,)\s+\(*{name}\b", sql):
                needed.add(name)
                need(CTES[name])

    need(final)
    if not needed:
        return final
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n]})" for n in CTES if n in needed) + "\n" + final


def _rounded(columns: str, *doubles: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" if c in doubles else c for c in columns.split())


_WINDOW = "hypothesis_id arm window_key page role period metric n_days value eligible"
_DESIGN = ('hypothesis_id, arm, window_key, page, role, period, CAST(start AS DATE) AS start, CAST("end" AS DATE) AS "end", '
           "intervention_date, label_cutoff, post_days_effective, window_eligible")
_METRIC_DOUBLES = ["estimate", "ci_low", "ci_high", "ci_level", "ci_low_adj", "ci_high_adj", "ci_level_adj", "threshold"]
_METRICS = _rounded(" ".join(_METRIC_NAMES), *_METRIC_DOUBLES)
_PANEL = "round(position, 6) AS position"


def _percent(column: str) -> str:
    return f"coalesce(printf('%+.1f %%', {column} * 100), {_text(C.NO_PERCENT)})"


_CLAIM_HEAD = f"printf({_text(C.CLAIM_ESTIMATED)}, hypothesis_id, {_percent('estimate')}, ci_level_adj * 100, {_percent('ci_low_adj')}, {_percent('ci_high_adj')}, decision)"

FINALS: dict[str, str] = {
    "panel_segment_day": f"SELECT date, page, segment, clicks, impressions, {_PANEL} FROM gsc",
    "panel_page_day": f"SELECT date, page, clicks, impressions, {_PANEL} FROM page_panel",
    "data_period": 'SELECT min(date) AS start, max(date) AS "end" FROM gsc',
    "segment_view": f"SELECT page, segment, date, clicks, impressions, {_PANEL} FROM view",
    "query_segments": """SELECT d AS date, page,
       CASE WHEN regexp_matches(event_type || ' ' || k, '^(click|view) [0-4]') THEN 'local' ELSE 'general' END AS segment,
       CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS clicks, count(*) AS impressions,
       round(sum(1 + value / 5) / count(*), 6) AS position
FROM ev GROUP BY ALL""",
    "treatment_dates": "SELECT type, page, treated_on FROM treated_dates",
    "ctr_training_end": "SELECT train_end FROM train_end",
    "window_design": f"SELECT {_DESIGN} FROM design",
    "placebo_design": f"SELECT {_DESIGN} FROM design_p",
    "ctr_curve": "SELECT bin, CAST(edge AS DOUBLE) AS edge, clicks, impressions, round(ctr, 6) AS ctr, training_rows FROM curve",
    "ctr_expected": f"""SELECT date, page, {_PANEL}, round(ctr, 6) AS expected_ctr
FROM (SELECT *, {_BIN} AS bin FROM page_panel WHERE impressions > 0) JOIN (SELECT bin, ctr FROM curve) c USING (bin)""",
    "page_windows": f"SELECT {_rounded(_WINDOW, 'value')} FROM windows",
    "placebo_page_windows": f"SELECT {_rounded(_WINDOW, 'value')} FROM windows_p",
    "pre_post_delta": f"SELECT {_rounded('hypothesis_id metric arm window_key page role pre post delta', 'pre', 'post', 'delta')} FROM deltas",
    "predictions": """SELECT run_id, hypothesis_id, model, model_version, arm, window_key, page, role, split, target_name,
       round(target, 6) AS target, round(prediction, 6) AS prediction, issued_at, intervention_date,
       CAST(target_start AS DATE) AS target_start, CAST(target_end AS DATE) AS target_end, label_cutoff FROM predictions""",
    "point_effects": f"SELECT {_rounded('hypothesis_id model metric estimate', 'estimate')} FROM effects",
    "bootstrap_draws": "SELECT hypothesis_id, model, CAST(rep AS INTEGER) AS rep, round(draw, 6) AS draw FROM draws",
    "effect_intervals": f"SELECT {_rounded('hypothesis_id model ci_low ci_high ci_low_adj ci_high_adj', 'ci_low', 'ci_high', 'ci_low_adj', 'ci_high_adj')} FROM bounds",
    "evaluation": f"SELECT {_METRICS} FROM evaluation",
    "ablation": f"SELECT {_METRICS} FROM metrics",
    "placebo_test": f"SELECT {_METRICS}, coalesce(ci_low <= 0 AND ci_high >= 0, false) AS contains_zero FROM metrics_p WHERE model = 'did'",
    "trend_asof": f"SELECT {_rounded('hypothesis_id kind metric segment intervention compare_to threshold estimate decision status note', 'threshold', 'estimate')} FROM trend",
    "event_time_series": "SELECT hypothesis_id, name, role, week, value FROM series",
    "effect_rows": "SELECT hypothesis_id, model, metric, decision, " + ", ".join(
        f"round({c} * 100, 6) AS {c}" for c in ("estimate", "ci_low", "ci_high", "ci_low_adj", "ci_high_adj", "threshold"))
    + " FROM evaluation WHERE kind <> 'descriptive' AND status = 'estimated'",
    "hypothesis_table": """SELECT e.hypothesis_id, e.model, e.metric, round(e.estimate, 6) AS estimate, e.decision, e.status, h.statement
FROM evaluation e JOIN hyp h USING (hypothesis_id)""",
    "page_facts": "SELECT * FROM facts",
    "page_issues": "SELECT label, url, issue, category, detail FROM issues",
    "duplicate_titles": "SELECT label, url, issue, 'content' AS category, detail FROM duplicate_titles",
    "broken_links": "SELECT label, url, issue, 'technical' AS category, detail FROM broken",
    "pages_with_issues": f"""SELECT coalesce(l.page, '') AS page, i.label, i.url, i.issue, i.category, i.detail
FROM issues i LEFT JOIN (SELECT {_normal("url")} AS url, max('P' || page_id) AS page FROM pages GROUP BY 1) l USING (url)""",
    "audit_summary": 'SELECT category, issue, before, "after" FROM summary',
    "audit_category_totals": f"""SELECT category, CAST(coalesce(sum(before), 0) AS BIGINT) AS before, CAST(coalesce(sum("after"), 0) AS BIGINT) AS "after"
FROM ({_values([(c,) for c in C.CATEGORIES], "category")}) LEFT JOIN summary USING (category) GROUP BY category""",
    "url_normalized": f"SELECT page_id, {_normal('url')} AS url, lower(regexp_extract(url, '{_URL}', 2)) AS host FROM pages",
    "link_edges": "SELECT label, src, anchor_pos, dst FROM edges",
    "crawl_files": "SELECT path, sha256 FROM stored_files",
    "crawl_records": """SELECT label, url, CAST(status AS INTEGER) AS status, 'text/html' AS content_type,
       sha256(regexp_replace(html, '\r\n?', chr(10), 'g')) AS html_sha256 FROM stored""",
    "data_hash": "SELECT sha256(string_agg(sha256 || '  ' || path || chr(10), '' ORDER BY path)) AS tree_sha256 FROM stored_files",
    "design_hash": "SELECT CAST(sum(CAST('0x' || substr(md5(" + " || '|' || ".join(
        f"""coalesce(length(CAST("{c}" AS VARCHAR)) || ':' || CAST("{c}" AS VARCHAR), '-')""" for c in sorted([*DESIGN_COLUMNS, "metric", "segment"]))
        + """), 1, 15) AS HUGEINT)) AS VARCHAR) AS table_hash, count(*) AS rows FROM design""",
    "file_findings": """
SELECT 'error' AS severity, 'checksum_missing' AS code, path AS file, 'file not listed in SHA256SUMS' AS detail
FROM stored_files WHERE path LIKE 'crawl/after/page%'
UNION ALL SELECT 'error', 'checksum_mismatch', 'crawl/before/index.csv', 'content differs from SHA256SUMS'
FROM stored_files WHERE path = 'crawl/before/index.csv' AND sha256 <> sha256('')
UNION ALL SELECT 'error', 'checksum_extra', 'crawl/before/lost.html', 'listed file does not exist'
UNION ALL SELECT 'error', 'missing_file', f, 'required file is absent'
FROM (VALUES """ + ", ".join(f"('{name}')" for name in C.REQUIRED_FILES if name != C.HASH_LIST) + """) required(f)
WHERE f NOT IN (SELECT path FROM stored_files)""",
    "lighthouse_summary": "SELECT design_group, snapshot, " + ", ".join(
        f"round(median(CAST({m} AS DOUBLE)), 6) AS {m}" for m in C.MEASURES)
    + " FROM scores JOIN site_pages USING (page) GROUP BY ALL",
    "dq_issues": "SELECT 'error' AS severity, code, file, detail FROM findings",
    "claims": f"""SELECT 'C-' || e.hypothesis_id AS claim_id,
       CASE e.hypothesis_id {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.CLAIM_SECTIONS.items())} ELSE '{C.CLAIM_OTHER_SECTION}' END AS section,
       CASE WHEN e.status = 'estimated' THEN {_CLAIM_HEAD}
            ELSE printf({_text(C.CLAIM_OTHER)}, e.hypothesis_id, e.decision, e.note) END AS statement,
       'run' AS run_id, '{C.CLAIM_METRICS_FILE}' AS file,
       'hypothesis_id == ''' || e.hypothesis_id || ''' and model == ''' || e.model || '''' AS filter, 'estimate' AS metric,
       round(estimate, 6) AS value,
       CASE WHEN e.status = 'estimated' THEN printf('[%.6f; %.6f]', ci_low_adj, ci_high_adj) ELSE '' END AS "interval",
       h.limitation AS limitation
FROM evaluation e JOIN (SELECT hypothesis_id, limitation FROM hyp) h USING (hypothesis_id)
UNION ALL
SELECT 'C-AUDIT', '{C.CLAIM_AUDIT_SECTION}', printf({_text(C.CLAIM_AUDIT)}, CAST(sum(before) AS BIGINT), CAST(sum("after") AS BIGINT)), 'run',
       '{C.CLAIM_AUDIT_FILE}', 'all rows', 'sum(before)', CAST(sum(before) AS DOUBLE), '', {_text(C.CLAIM_AUDIT_LIMIT)}
FROM summary""",
    "reachable_pages": """, reach AS (
  SELECT label, url AS start, 0 AS level, [url] AS visited, [url] AS frontier FROM numbered, (VALUES ('before'), ('after')) s(label) WHERE n = 1
  UNION ALL
  SELECT label, start, level + 1, list_concat(visited, found), found
  FROM (SELECT label, start, level, visited, list(dst ORDER BY place, dst) AS found
        FROM (SELECT r.label, r.start, r.level, r.visited, e.dst, min((list_position(r.frontier, e.src), e.kind, e.anchor_pos)) AS place
              FROM reach r JOIN ways e ON e.label = r.label AND list_contains(r.frontier, e.src)
              WHERE NOT list_contains(r.visited, e.dst) GROUP BY r.label, r.start, r.level, r.visited, e.dst)
        GROUP BY label, start, level, visited)),
ordered AS (SELECT label, start, level, unnest(frontier) AS url, generate_subscripts(frontier, 1) AS place FROM reach)
SELECT CAST(row_number() OVER (PARTITION BY o.label, o.start ORDER BY level, place) - 1 AS INTEGER) AS crawl_order, o.label, o.start, o.url,
       CAST(level AS INTEGER) AS level, coalesce(s.status, 404) AS status
FROM ordered o LEFT JOIN status_of s ON s.url = o.url AND s.label = o.label""",
}
FINALS["result_checks"] = f"""SELECT name, ok, CASE WHEN ok THEN '' ELSE 'failed' END AS detail FROM (
  SELECT 'prediction_run_id' AS name, bool_and(run_id = 'run') AS ok FROM predictions
  UNION ALL SELECT 'prediction_keys_unique', count(*) = count(DISTINCT (hypothesis_id, model, arm, window_key, page)) FROM predictions
  UNION ALL SELECT 'labels_available_at_cutoff', bool_and(target_end <= {_AVAIL} + 1) FROM predictions
  UNION ALL SELECT 'pre_windows_before_intervention', bool_and("end" <= intervention_date - {P.buffer_days}) FROM design WHERE period = 'pre'
  UNION ALL SELECT 'treated_control_disjoint', count(*) = 0
    FROM (SELECT 1 FROM design GROUP BY hypothesis_id, arm, window_key, page HAVING count(DISTINCT role) > 1)
  UNION ALL SELECT 'equal_model_coverage', max(models) = min(models)
    FROM (SELECT count(DISTINCT model) - CASE WHEN hypothesis_id = 'H2' THEN 1 ELSE 0 END AS models
          FROM predictions GROUP BY hypothesis_id, arm, window_key, page)
  UNION ALL SELECT 'metrics_recomputed_from_predictions', bool_and(abs(m.estimate - e.estimate) <= 1e-9)
    FROM metrics m JOIN effects e ON e.hypothesis_id = m.hypothesis_id AND e.model = m.model
  UNION ALL SELECT 'ablation_reference_matches_metrics', bool_and(abs(m.estimate - e.estimate) <= 1e-9)
    FROM metrics m JOIN evaluation e ON e.hypothesis_id = m.hypothesis_id AND e.model = m.model
  UNION ALL SELECT 'claims_match_run', count(*) > 0 FROM summary
  UNION ALL SELECT 'export_matches_metrics', count(*) = 5 FROM evaluation
  UNION ALL SELECT 'passed', count(*) > 0 FROM predictions)"""


def _leaves(part: str, rows: str, order: str, numbers: str, texts: str) -> str:
    """(path, number, text) of the records of one part of the result document, in ``order``; columns are written ``name`` or ``name=sql``."""
    fields = [(*(c.split("=", 1) if "=" in c else (c, c)), kind) for kind, columns in (("n", numbers), ("t", texts)) for c in columns.split(", ") if c]
    listed = ", ".join(
        f"{{'field': '{name}', 'number': {f'CAST({sql} AS DOUBLE)' if kind == 'n' else 'CAST(NULL AS DOUBLE)'}, "
        f"'text': {f'CAST({sql} AS VARCHAR)' if kind == 't' else 'CAST(NULL AS VARCHAR)'}}}" for name, sql, kind in fields)
    place = f"'{part}[' || (row_number() OVER (ORDER BY {order}) - 1) || '].'" if order else f"'{part}'"
    return (f"SELECT place || leaf.field AS path, round(leaf.number, 6) AS number, leaf.text AS text "
            f"FROM (SELECT {place} AS place, unnest([{listed}]) AS leaf FROM {rows})")


_NUMBERS = [*_METRIC_DOUBLES, "n_treated", "n_control", "min_window_days", "bootstrap_reps"]
_TEXTS = ", ".join(c for c in _METRIC_NAMES if c not in _NUMBERS)
_NUMBERS = ", ".join(_NUMBERS)
_SERIES = f"""(SELECT s.*, h.metric, l.label FROM (SELECT hypothesis_id, name, role, list(week ORDER BY week) AS weeks, list(value ORDER BY week) AS points
                    FROM series GROUP BY hypothesis_id, name, role) s
 JOIN hyp h USING (hypothesis_id) JOIN ({_values(list(C.METRIC_LABELS.items()), "metric, label")}) l USING (metric))"""


def _entries(name: str, column: str) -> str:
    return (f"SELECT place || '{name}[' || (i - 1) || ']', round(CAST({column}[i] AS DOUBLE), 6), NULL "
            f"FROM (SELECT 'series[' || (row_number() OVER (ORDER BY hypothesis_id, role, name) - 1) || '].' AS place, {column}, "
            f"unnest(range(1, len({column}) + 1)) AS i FROM {_SERIES})")


FINALS["result_fields"] = "\nUNION ALL ".join([
    _leaves("", "train_end", "", f"schema_version=1, bootstrap_reps={P.bootstrap_reps}",
            f"mode='{P.mode}', mode_label={_text(C.MODE_LABELS[P.mode])}, run_id='run', model_version='{C.EFFECT_MODEL}', "
            f"analysis_cutoff='{P.analysis_cutoff}', available_until='{P.available_until}', data_sha256=NULL, truth=NULL, "
            f"ctr_model.model_version='{C.CTR_MODEL}', ctr_model.train_end_exclusive=train_end, ctr_model.available_until='{P.available_until}'"),
    _leaves("data_period.", '(SELECT min(date) AS first, max(date) AS last FROM gsc)', "", "", "start=first, end=last"),
    _leaves("hypotheses", "(SELECT e.*, h.statement FROM evaluation e JOIN hyp h USING (hypothesis_id))", "hypothesis_id", _NUMBERS, _TEXTS + ", statement"),
    _leaves("ablation", f"(SELECT * FROM metrics JOIN ({_values(list(C.MODEL_LABELS.items()), 'model, model_label')}) USING (model))",
            "hypothesis_id, model", _NUMBERS, _TEXTS + ", model_label"),
    _leaves("placebo", "(SELECT *, coalesce(ci_low <= 0 AND ci_high >= 0, false) AS contains_zero FROM metrics_p WHERE model = 'did')",
            "hypothesis_id", _NUMBERS, _TEXTS + ", contains_zero"),
    _leaves("audit", "summary", "category, issue", 'before, after="after"', "category, issue"),
    _leaves("lighthouse", f"({FINALS['lighthouse_summary']})", "design_group, snapshot", ", ".join(C.MEASURES), "design_group, snapshot"),
    _leaves("authority", "authority_site", "date, metric, source", "value", "date, metric, source"),
    _leaves("ctr_curve", "curve", "bin", "bin, edge, clicks, impressions, ctr, training_rows", ""),
    _leaves("series", _SERIES, "hypothesis_id, role, name", f"ramp_weeks={-(-P.ramp_days // 7)}",
            "hypothesis_id, name, role, metric, metric_label=label, lower_is_better=(metric = 'position')"),
    _entries("weeks", "weeks"), _entries("values", "points")])


def _assemble(final: str) -> str:
    if not final.startswith(","):
        return _query(final)
    recursive, body = final[1:].rsplit("\nSELECT CAST(row_number()", 1)
    needed = _query("SELECT 1 FROM ways, status_of")
    return needed.rsplit("\nSELECT 1", 1)[0] + ",\n" + recursive + "\nSELECT CAST(row_number()" + body


ORACLE_SQL: dict[str, str] = {name: _assemble(final) for name, final in FINALS.items()}
