"""The views of `views.py` as SQL, for the checks."""

from __future__ import annotations

A = "TIMESTAMP '2024-01-31 00:00:00'"
W = r"[\p{L}\p{N}_]"


def r(x: str, digits: int) -> str:
    """Decimal rounding after cutting to ten digits."""
    return f"CAST(round(CAST({x} AS DECIMAL(18, 10)), {digits}) AS DOUBLE)"


# name -> (views it needs, query)
SQL_VIEWS: dict[str, tuple[str, str]] = {
    "docs": ("", f"""
SELECT d.doc_id, 'doc:' || d.doc_id AS uid, left(d.text, 120) AS title, d.text,
  'https://' || d.source || '.example.org/d/' || d.doc_id AS url, d.source, d.lang,
  CAST(d.doc_id % 4 + 1 AS INTEGER) AS ias_tier, CAST(e.ts AS TIMESTAMP) + to_days(CAST(d.doc_id % 24 AS INTEGER)) AS published_at,
  CASE WHEN l.doc_id IS NULL THEN 'pending' ELSE 'processed' END AS status, CAST(e.ts AS TIMESTAMP) + to_days(CAST(d.doc_id % 24 AS INTEGER)) AS ingested_at,
  '{{"lang":"' || d.lang || '"}}' AS metadata
FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id"""),
    "concepts": ("", """
SELECT 'C-' || item_id AS id, 'Material' AS label, w[1] || ' ' || w[2] AS name, list_filter(w, lambda x, i: list_position(w, x) = i) AS aliases,
  left(text, 80) AS description, item_id
FROM (SELECT *, regexp_extract_all(text, '[A-Za-z]{3,}') AS w FROM benchmark)"""),
    "nodes": ("", """
SELECT 'GEO-R' || r_regionkey AS node_id, r_name AS name, 'Geography' AS label, CAST(NULL AS DOUBLE) AS criticality FROM region
UNION ALL SELECT 'GEO-N' || n_nationkey, n_name, 'Geography', NULL FROM nation
UNION ALL SELECT 'COMP-' || s_suppkey, s_name, 'Company', (s_acctbal + 1000) / 11000 FROM supplier
UNION ALL SELECT 'TECH-' || p_brand, p_brand, 'Technology', NULL FROM (SELECT DISTINCT p_brand FROM part)
UNION ALL SELECT 'PROC-' || p_type, p_type, 'Process', NULL FROM (SELECT DISTINCT p_type FROM part)"""),
    "edges": ("", """
SELECT 'COMP-' || s_suppkey AS src, 'GEO-N' || s_nationkey AS dst, 'LOCATED_IN' AS relation FROM supplier
UNION ALL SELECT 'GEO-N' || n_nationkey, 'GEO-R' || n_regionkey, 'LOCATED_IN' FROM nation
UNION ALL SELECT 'COMP-' || l_suppkey, 'TECH-' || p_brand, 'PRODUCES' FROM (
  SELECT l_suppkey, p_brand, row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(l_extendedprice) DESC, p_brand) AS r
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2) WHERE r = 1
UNION ALL SELECT 'TECH-' || p_brand, 'PROC-' || p_type, 'USES' FROM (
  SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS r
  FROM part GROUP BY 1, 2) WHERE r = 1"""),
    "adj": ("edges nodes", """
SELECT DISTINCT a AS src, b AS dst FROM (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges)
WHERE a IN (SELECT node_id FROM nodes) AND b IN (SELECT node_id FROM nodes)"""),
    "hyps": ("", f"""
SELECT 'H-' || s_suppkey AS id, 'COMP-' || s_suppkey AS node_id, s_name AS node_name,
  'Output of ' || s_name || ' limits ' || upper(left(w[1], 1)) || lower(substr(w[1], 2)) || ' and ' || upper(left(w[2], 1)) || lower(substr(w[2], 2))
    || ' supply in ' || n_name AS statement,
  round(0.40::DOUBLE + 0.5::DOUBLE * ((s_suppkey * 37) % 100) / 100.0::DOUBLE, 3) AS confidence,
  CASE WHEN s_suppkey % 10 = 9 THEN 'confirmed' WHEN s_suppkey % 10 = 8 THEN 'stale' ELSE 'active' END AS status,
  CAST(s_suppkey % 4 + 1 AS INTEGER) AS awareness_layer, CAST(s_suppkey % 5 AS INTEGER) AS n_criteria,
  (s_acctbal + 1000) / 11000 AS srs_score_at_creation, s_suppkey % 3 = 0 AS ach_reviewed,
  {A} - to_days(CAST((s_suppkey * 7) % 45 AS INTEGER)) AS created_at,
  CASE WHEN s_suppkey % 11 <> 0 THEN {A} - to_days(CAST((s_suppkey * 5) % 40 AS INTEGER)) END AS updated_at, s_suppkey
FROM supplier JOIN nation ON s_nationkey = n_nationkey
JOIN (SELECT item_id, regexp_extract_all(text, '[A-Za-z]{{3,}}') AS w FROM benchmark) b ON s_suppkey % (SELECT count(*) FROM benchmark) = b.item_id"""),
    "evidence": ("hyps", """
SELECT hypothesis_id, doc_uid, ts, supports, '[' || left(doc_uid, 12) || '] ' || event_type || ' of user ' || user_id AS line FROM (
  SELECT 'H-' || (user_id % (SELECT count(*) FROM supplier)) AS hypothesis_id, CASE event_id % 6 WHEN 0 THEN 'github:' WHEN 1 THEN 'arxiv:' WHEN 2 THEN 'hn:'
    WHEN 3 THEN 'rss_nyt:' WHEN 4 THEN 'jobs_x:' ELSE 'zz:' END || event_id AS doc_uid, CAST(ts AS TIMESTAMP) AS ts,
    event_type <> 'error' AS supports, event_type, user_id FROM events)
WHERE hypothesis_id IN (SELECT id FROM hyps)"""),
    "hyps_counted": ("hyps evidence", """
SELECT h.*, coalesce(f, 0) AS evidence_for, coalesce(g, 0) AS evidence_against FROM hyps h LEFT JOIN (
  SELECT hypothesis_id, count(*) FILTER (supports) AS f, count(*) FILTER (NOT supports) AS g FROM evidence GROUP BY 1) e
ON e.hypothesis_id = h.id"""),
    "cells": ("", """
SELECT 'H-' || l_suppkey AS hypothesis_id, CAST(l_partkey % 4 AS INTEGER) AS alt_no,
  l_orderkey % (100 + 120 * (l_suppkey % 20)) AS evidence_no,
  min(CASE l_returnflag WHEN 'A' THEN 'C' WHEN 'R' THEN 'I' ELSE 'N' END) AS class
FROM lineitem GROUP BY 1, 2, 3"""),
    "robust": ("cells", """
SELECT hypothesis_id, count(*) AS evidence_count, sum(hit) / count(*)::DOUBLE AS robustness FROM (
  SELECT hypothesis_id, evidence_no, max(CASE WHEN class = 'I' THEN 1 ELSE 0 END) AS hit FROM cells GROUP BY 1, 2) GROUP BY 1"""),
    "reviews": ("robust hyps", f"""
SELECT r.hypothesis_id, robustness, robustness >= 0.40 AS passed,
  {A} - to_days(CAST(s_suppkey % 20 AS INTEGER)) AS reviewed_at, s_suppkey % 2 = 0 AS human_approved
FROM robust r JOIN hyps h ON h.id = r.hypothesis_id WHERE h.ach_reviewed"""),
    "scored": ("hyps_counted reviews", f"""
SELECT id, node_id, node_name, statement, {r('c', 3)} AS confidence, layer AS awareness_layer, {r('s', 3)} AS srs_score,
  {r('g', 3)} AS ias, {r('p', 3)} AS specificity, {r('v', 3)} AS validation, {r('t', 3)} AS recency, {r('b', 3)} AS robustness_ach,
  {r('raw', 4)} AS ops_raw, {r('raw * b', 4)} AS ops_final,
  CASE WHEN raw * b >= 0.60 THEN 1 WHEN raw * b >= 0.35 THEN 2 ELSE 3 END AS tier, ach_reviewed,
  evidence_for AS evidence_for_count, evidence_against AS evidence_against_count, n_criteria, status, created_at, updated_at
FROM (SELECT *, s * g * 0.40::DOUBLE + p * 0.20::DOUBLE + c * 0.15::DOUBLE + v * 0.15::DOUBLE + t * 0.10::DOUBLE AS raw FROM (
  SELECT h.*, coalesce(nullif(srs_score_at_creation, 0), 0.5) AS s, coalesce(nullif(awareness_layer, 0), 1) AS layer,
    coalesce(nullif(confidence, 0), 0.5) AS c, least(n_criteria / 3.0::DOUBLE, 1.0::DOUBLE) AS p,
    evidence_for / greatest(1, evidence_for + evidence_against)::DOUBLE AS v,
    CASE awareness_layer WHEN 1 THEN 0.75::DOUBLE WHEN 2 THEN 0.5::DOUBLE WHEN 3 THEN 0.25::DOUBLE WHEN 4 THEN 0.0::DOUBLE ELSE 0.25::DOUBLE END AS g,
    CASE WHEN floor(epoch({A} - coalesce(updated_at, created_at)) / 86400) < 7 THEN 1.0::DOUBLE
         WHEN floor(epoch({A} - coalesce(updated_at, created_at)) / 86400) < 30 THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END AS t,
    coalesce(r.robustness, 1.0::DOUBLE) AS b
  FROM hyps_counted h LEFT JOIN reviews r ON r.hypothesis_id = h.id))"""),
    "sims": ("", """
SELECT * FROM (SELECT 'doc:' || d.vec_id AS doc_uid, 'COMP-' || (n.vec_id // 5) AS node_id, d.vec_id,
  list_cosine_similarity(CAST(d.embedding AS DOUBLE[]), CAST(n.embedding AS DOUBLE[])) AS sim
FROM embeddings d, embeddings n WHERE d.vec_id % 5 <> 0 AND n.vec_id % 5 = 0) WHERE sim > 0"""),
    "topk": ("sims", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_uid ORDER BY sim DESC, node_id) AS r FROM sims) WHERE r <= 10"""),
    "routed": ("topk", """
SELECT 'doc:' || e.vec_id AS doc_uid, e.vec_id, t.node_id AS best_node, coalesce(t.sim, 0) AS best_similarity,
  CASE WHEN t.sim IS NULL THEN 'no_candidates' WHEN t.sim >= 0.36 THEN 'auto' WHEN t.sim >= 0.30 THEN 'choose'
    ELSE 'below_threshold' END AS route
FROM embeddings e LEFT JOIN topk t ON t.doc_uid = 'doc:' || e.vec_id AND t.r = 1 WHERE e.vec_id % 5 <> 0"""),
    "mentions": ("topk", "SELECT doc_uid, node_id, sim AS confidence FROM topk WHERE sim >= 0.36"),
    "choices": ("routed topk", """
SELECT doc_uid, node_id, confidence FROM (
  SELECT doc_uid, vec_id, route, CASE WHEN vec_id % 11 = 0 THEN NULL WHEN vec_id % 5 = 2 THEN 'COMP-' || (vec_id * 13 % 100) ELSE best_node END AS node_id,
    CASE WHEN vec_id % 7 = 0 THEN 0.55 ELSE 0.9 END AS confidence FROM routed) c
WHERE route = 'choose' AND confidence >= 0.6 AND EXISTS (SELECT 1 FROM topk t WHERE t.doc_uid = c.doc_uid AND t.node_id = c.node_id)"""),
    "orphaned": ("routed choices", """
SELECT 'orphan:' || doc_uid AS uid, doc_uid, vec_id, best_node, best_similarity,
  CASE route WHEN 'choose' THEN 'mistral_undecided' ELSE route END AS reason
FROM routed WHERE route <> 'auto' AND doc_uid NOT IN (SELECT doc_uid FROM choices)"""),
    "news": ("docs", """
SELECT uid, title, url, source, (doc_id % 10) / 10.0::DOUBLE AS sentiment_score,
  CASE WHEN doc_id % 2 = 0 THEN 'positive' ELSE 'negative' END AS sentiment_label,
  CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '["Tech","Energy"]' WHEN 3 THEN 'Tech, Energy,,' ELSE '{"a":1}' END AS topics,
  published_at AS first_seen, doc_id FROM docs"""),
    "news_ledger": ("", "SELECT 'doc:' || doc_id AS uid FROM labels"),
    "alert_ledger": ("hyps", f"""
SELECT id AS hypothesis_id, 4 AS layer FROM hyps WHERE s_suppkey % 7 = 0 UNION ALL
SELECT id, 98 FROM hyps WHERE s_suppkey % 6 = 0 UNION ALL SELECT id, 99 FROM hyps WHERE s_suppkey % 5 = 0"""),
    "results": ("", """
SELECT *, CASE WHEN NOT parse_error THEN round(0.15::DOUBLE * (s1 + s2 + s3 + s4) + 0.10::DOUBLE * (s5 + s6 + s7) + 0.05::DOUBLE * (s8 + s9), 2) END AS supply_stress_score
FROM (SELECT run_date, commodity, q % 17 = 0 AS parse_error, CAST(q % 5 + 1 AS INTEGER) AS confidence, CAST(split_part(commodity, '#', 2) AS INTEGER) AS position,
  CAST(least(100, q % 121) AS INTEGER) AS s1, CAST(least(100, n * 7 % 121) AS INTEGER) AS s2, CAST(least(100, (q + n) % 101) AS INTEGER) AS s3,
  CAST(q * 3 % 101 AS INTEGER) AS s4, CAST(r * 5 % 101 AS INTEGER) AS s5, CAST(a * 11 % 101 AS INTEGER) AS s6, CAST(l * 3 % 101 AS INTEGER) AS s7,
  CAST(n % 101 AS INTEGER) AS s8, CAST((q // 10) % 101 AS INTEGER) AS s9
 FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS run_date, p_brand AS commodity, CAST(sum(l_quantity) AS BIGINT) AS q, count(*) AS n,
   count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_returnflag = 'A') AS a, CAST(sum(l_linenumber) AS BIGINT) AS l
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2))"""),
    "rankings": ("results", """
SELECT x.*, coalesce(round(x.supply_stress_score - coalesce(CASE WHEN o.commodity IS NOT NULL THEN coalesce(o.supply_stress_score, 0) END, x.supply_stress_score), 2), 0) AS score_delta
FROM (SELECT c.*, d.prev, CASE WHEN supply_stress_score IS NOT NULL THEN
    row_number() OVER (PARTITION BY c.run_date, supply_stress_score IS NULL ORDER BY supply_stress_score DESC, position) END AS rank
  FROM results c JOIN (SELECT run_date, lag(run_date) OVER (ORDER BY run_date) AS prev FROM (SELECT DISTINCT run_date FROM results)) d USING (run_date)) x
LEFT JOIN results o ON o.run_date = x.prev AND o.commodity = x.commodity"""),
}


def _betweenness(levels: int = 24) -> dict[str, tuple[str, str]]:
    """Shortest-path counts level by level over all sources, then dependencies back up."""
    views = {"lv0": ("adj", "SELECT DISTINCT src AS s, src AS v, 1.0::DOUBLE AS sg FROM adj")}
    for i in range(1, levels + 1):
        older = f" AND NOT EXISTS (SELECT 1 FROM lv{i - 2} q WHERE q.s = p.s AND q.v = a.dst)" if i > 1 else ""
        views[f"lv{i}"] = (f"lv{i - 1} adj", f"""
SELECT p.s, a.dst AS v, sum(p.sg) AS sg FROM lv{i - 1} p JOIN adj a ON a.src = p.v
WHERE NOT EXISTS (SELECT 1 FROM lv{i - 1} q WHERE q.s = p.s AND q.v = a.dst){older} GROUP BY 1, 2""")
    views[f"dp{levels}"] = (f"lv{levels}", f"SELECT s, v, sg, 0.0::DOUBLE AS dl FROM lv{levels}")
    for i in range(levels - 1, 0, -1):
        views[f"dp{i}"] = (f"lv{i} dp{i + 1} adj", f"""
SELECT l.s, l.v, l.sg, coalesce(sum(l.sg / d.sg * (1 + d.dl)), 0) AS dl FROM lv{i} l
LEFT JOIN (adj a JOIN dp{i + 1} d ON d.v = a.dst) ON a.src = l.v AND d.s = l.s GROUP BY 1, 2, 3""")
    every = " UNION ALL ".join(f"SELECT v, dl FROM dp{i}" for i in range(1, levels + 1))
    views["between"] = (" ".join(f"dp{i}" for i in range(1, levels + 1)) + " nodes", f"""
SELECT node_id, round(coalesce(t, 0) / ((SELECT count(*) FROM nodes) - 1)::DOUBLE / ((SELECT count(*) FROM nodes) - 2)::DOUBLE, 10) AS betweenness
FROM nodes LEFT JOIN (SELECT v, sum(dl) AS t FROM ({every}) GROUP BY 1) ON v = node_id""")
    return views


SQL_VIEWS.update(_betweenness())
SQL_VIEWS["apoints"] = ("adj nodes", """
SELECT x AS node_id FROM (
  WITH RECURSIVE start AS (SELECT src AS x, min(dst) AS s FROM adj WHERE src <> dst GROUP BY 1),
  reach AS (SELECT x, s AS v FROM start UNION SELECT r.x, a.dst FROM reach r JOIN adj a ON a.src = r.v WHERE a.dst <> r.x)
  SELECT x, count(*) AS n FROM reach GROUP BY 1) r
JOIN (WITH RECURSIVE comp AS (SELECT src AS x, src AS v FROM adj UNION SELECT c.x, a.dst FROM comp c JOIN adj a ON a.src = c.v)
  SELECT x, count(*) AS m FROM comp GROUP BY 1) USING (x) WHERE n < m - 1""")
_SRS = ("least(b.betweenness * 0.40::DOUBLE + (1 - 1.0::DOUBLE / k) * 0.35::DOUBLE + coalesce(nullif(criticality, 0), 0.5) * 0.25::DOUBLE "
        "+ CASE WHEN ap THEN 0.20::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE)")
SQL_VIEWS["scores"] = ("between apoints nodes edges", f"""
SELECT n.node_id, n.name, n.label, {r(_SRS, 4)} AS srs_score, {r('b.betweenness', 4)} AS betweenness,
  {r('1 - 1.0::DOUBLE / k', 4)} AS concentration, {r('coalesce(nullif(criticality, 0), 0.5)', 4)} AS criticality,
  k AS num_suppliers, ap AS is_articulation_point
FROM nodes n JOIN between b USING (node_id)
JOIN (SELECT node_id, greatest(1, coalesce(c, 0)) AS k FROM nodes LEFT JOIN (SELECT dst, count(DISTINCT src) AS c FROM edges GROUP BY 1) ON dst = node_id) USING (node_id)
JOIN (SELECT node_id, node_id IN (SELECT node_id FROM apoints) AS ap FROM nodes) USING (node_id)""")


EXCLUDED = "GEO-N3"


def _without_node(excluded: str) -> dict[str, tuple[str, str]]:
    """The score views again over the graph without one node; their names end in _x."""
    import re

    names = [n for n in _closure(["scores"])]
    pattern = re.compile(r"\b(" + "|".join(names) + r")\b")
    out = {
        "nodes_x": ("nodes", f"SELECT * FROM nodes WHERE node_id <> '{excluded}'"),
        "edges_x": ("edges", f"SELECT * FROM edges WHERE src <> '{excluded}' AND dst <> '{excluded}'"),
    }
    for name in names:
        if name not in ("nodes", "edges"):
            needs, sql = SQL_VIEWS[name]
            out[f"{name}_x"] = (" ".join(f"{n}_x" for n in needs.split()), pattern.sub(r"\1_x", sql))
    return out


def _closure(names: list[str]) -> list[str]:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for need in SQL_VIEWS[name][0].split():
            visit(need)
        order.append(name)

    for name in names:
        visit(name)
    return order


SQL_VIEWS.update(_without_node(EXCLUDED))


def with_views(sql: str, names: list[str]) -> str:
    """`sql` preceded by the views it needs as common table expressions."""
    order = _closure(names)
    if not order:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({SQL_VIEWS[n][1].strip()})" for n in order)
    return f"WITH {ctes}\nSELECT * FROM (\n{sql.strip()}\n)"
