"""Registered queries of section J."""

from __future__ import annotations

from pyspark.sql import functions as F

from pinchgraph.functions import scores
from pinchgraph.operators import commodities as com
from pinchgraph.operators import reports, resolution
from pinchgraph.workload.q_graph import _CMP, _comparison
from pinchgraph.workload.registry import query
from pinchgraph.workload.sqlviews import A
from pinchgraph.workload.views import as_of


@query("j1_kpis", f"""SELECT (SELECT count(*) FROM (SELECT * FROM scores ORDER BY srs_score DESC, node_id LIMIT 20)) AS bottlenecks,
(SELECT count(*) FROM (SELECT * FROM scores ORDER BY srs_score DESC, node_id LIMIT 20) WHERE srs_score > 0.8) AS critical,
count(*) FILTER (date_diff('day', created_at, {A}) <= 7) AS new_this_week,
round(avg(date_diff('day', created_at, {A})) FILTER (status = 'active'), 6) AS avg_days_active FROM hyps""", "scores hyps")
def j1(v):
    return reports.kpis(v.node_scores(), v.hyps, as_of()).withColumn("avg_days_active", F.round("avg_days_active", 6))


_EV = """(SELECT e.hypothesis_id, s.node_name AS entity, 'COMP' AS type, CAST(round(CAST(s.ops_final AS DECIMAL(10, 4)), 3) AS DOUBLE) AS severity,
CASE split_part(doc_uid, ':', 1) WHEN 'github' THEN 'GitHub' WHEN 'arxiv' THEN 'arXiv' WHEN 'hn' THEN 'Hacker News' WHEN 'rss_nyt' THEN 'NYT' WHEN 'jobs_x' THEN 'Job Posting' ELSE 'Unknown' END AS source,
CASE WHEN supports THEN 'supports' ELSE 'against' END AS direction, strftime(s.created_at, '%Y-%m-%d') AS detected_at, e.line AS snippet
FROM evidence e JOIN scored s ON s.id = e.hypothesis_id)"""


@query("j2_evidence_rows", f"SELECT * FROM {_EV}", "evidence scored")
def j2(v):
    return reports.evidence_rows(v.evidence, v.scored)


@query("j3_filter_evidence", f"SELECT * FROM {_EV} WHERE source IN ('GitHub', 'NYT') AND direction = 'against'", "evidence scored")
def j3(v):
    rows = reports.evidence_rows(v.evidence, v.scored)
    return reports.filter_evidence(rows, sources=["GitHub", "NYT"], direction="against")


_BORN = f"""(SELECT CAST(ts AS TIMESTAMP) AS t FROM events WHERE event_type = 'signup' UNION ALL SELECT created_at FROM hyps)"""


@query("j4_risk_trend", f"""SELECT CAST(day AS VARCHAR) AS day, coalesce(n, 0) AS new_daily,
CAST((SELECT count(*) FROM {_BORN} WHERE floor(epoch({A} - t) / 86400) > 30) + sum(coalesce(n, 0)) OVER (ORDER BY day) AS BIGINT) AS cumulative
FROM (SELECT CAST(unnest(generate_series({A} - INTERVAL 30 DAY, {A}, INTERVAL 1 DAY)) AS DATE) AS day)
LEFT JOIN (SELECT CAST(t AS DATE) AS day, count(*) AS n FROM {_BORN} WHERE floor(epoch({A} - t) / 86400) <= 30 GROUP BY 1) USING (day)""", "hyps")
def j4(v):
    """Sign-ups and hypotheses by day."""
    born = v.table("events").where("event_type = 'signup'").select(F.col("ts").cast("timestamp").alias("created_at")).unionByName(v.hyps.select("created_at"))
    return reports.risk_trend(born, as_of()).withColumn("day", F.col("day").cast("string"))


@query("j5_briefing", """SELECT s.id, s.tier, s.ops_final, e.node_id IS NOT NULL AS explained FROM scored s
LEFT JOIN (SELECT node_id FROM scores ORDER BY srs_score DESC, node_id LIMIT 20) e ON e.node_id = s.node_id WHERE s.status = 'active'""", "scored scores")
def j5(v):
    return reports.briefing(v.scored, v.node_scores()).select("id", "tier", "ops_final", F.col("explanation").isNotNull().alias("explained"))


@query("j6_ranked_nodes", "SELECT node_id, srs_score, CAST(row_number() OVER (ORDER BY srs_score DESC, node_id) AS INTEGER) AS position FROM scores ORDER BY position LIMIT 20", "scores")
def j6(v):
    return reports.ranked_nodes(v.node_scores()).select("node_id", "srs_score", "position")


@query("j7_what_if_changes", f"SELECT node_id, delta, was_ap, now_ap FROM {_CMP} WHERE abs(delta) > 0.001 ORDER BY abs(delta) DESC, node_id LIMIT 20", "scores scores_x")
def j7(v):
    return reports.what_if_changes(_comparison(v)).select("node_id", "delta", "was_ap", "now_ap")


@query("j7_what_if_top", f"""SELECT 'srs_before' AS side, node_id, srs_before AS srs, CAST(r AS INTEGER) AS position FROM (SELECT *, row_number() OVER (ORDER BY srs_before DESC, node_id) AS r FROM {_CMP}) WHERE r <= 5
UNION ALL SELECT 'srs_after', node_id, srs_after, CAST(r AS INTEGER) FROM (SELECT *, row_number() OVER (ORDER BY srs_after DESC, node_id) AS r FROM {_CMP}) WHERE r <= 5""", "scores scores_x")
def j7_top(v):
    return reports.what_if_top(_comparison(v))


_LATEST = "(SELECT * FROM rankings WHERE run_date = (SELECT max(run_date) FROM rankings))"


@query("j8_commodity_overview", f"""SELECT count(supply_stress_score) AS scored, count(*) AS total, round(sum(supply_stress_score) / greatest(1, count(supply_stress_score)), 2) AS avg_score,
arg_min(commodity, rank) AS top_commodity FROM {_LATEST}""", "rankings")
def j8(v):
    return reports.commodity_overview(com.latest_ranking(v.rankings))


_BAND = "CASE WHEN {0} >= 70 THEN 'high' WHEN {0} >= 40 THEN 'elevated' ELSE 'low' END"


@query("j9_commodity_table", f"""SELECT CAST(rank AS INTEGER) AS rank, commodity, supply_stress_score, {_BAND.format('supply_stress_score')} AS band,
CASE WHEN abs(score_delta) < 0.05 THEN '—' ELSE printf('%+.1f', score_delta + CASE WHEN score_delta > 0 THEN 1e-9 ELSE -1e-9 END) || CASE WHEN score_delta > 0 THEN ' ▲' ELSE ' ▼' END END AS change,
repeat('★', confidence) || repeat('☆', 5 - confidence) AS stars FROM {_LATEST} WHERE rank IS NOT NULL ORDER BY rank LIMIT 20""", "rankings")
def j9(v):
    return reports.commodity_table(com.latest_ranking(v.rankings))


_PAIRS = [("supply_growth_score", "s1", "Supply Growth (15%)"), ("demand_growth_score", "s2", "Demand Growth (15%)"),
          ("inventory_depletion_score", "s3", "Inventory Depletion (15%)"), ("geographic_concentration_score", "s4", "Geographic Concentration (15%)"),
          ("refining_concentration_score", "s5", "Refining Concentration (10%)"), ("geopolitical_risk_score", "s6", "Geopolitical Risk (10%)"),
          ("export_restriction_score", "s7", "Export Restrictions (10%)"), ("replacement_difficulty_score", "s8", "Replacement Difficulty (5%)"),
          ("production_lead_time_score", "s9", "Production Lead Time (5%)")]


@query("j10_sub_scores", " UNION ALL ".join(
    f"SELECT CAST(run_date AS VARCHAR) AS run_date, commodity, '{c}' AS component, CAST({s} AS DOUBLE) AS score, '{label}' AS label, {_BAND.format(s)} AS band FROM results"
    for c, s, label in _PAIRS), "results")
def j10(v):
    return reports.sub_score_breakdown(v.commodity_results).withColumn("run_date", F.col("run_date").cast("string"))


@query("j11_system_status", """SELECT 'documents' AS area, 'total' AS metric, '' AS key, count(*) AS n FROM docs UNION ALL SELECT 'documents', 'pending', '', count(*) FROM docs WHERE status = 'pending'
UNION ALL SELECT 'documents', 'source', source, count(*) FROM docs GROUP BY source
UNION ALL SELECT 'resolution', 'resolve_backlog', '', count(*) FROM docs WHERE status = 'processed' AND uid NOT IN (SELECT doc_uid FROM mentions UNION SELECT doc_uid FROM orphaned)
UNION ALL SELECT 'hypotheses', 'total', '', count(*) FROM hyps UNION ALL SELECT 'hypotheses', 'needs_ach_review', '', count(*) FROM hyps WHERE status = 'active' AND confidence >= 0.8 AND NOT ach_reviewed
UNION ALL SELECT 'hypotheses', 'status', status, count(*) FROM hyps GROUP BY status
UNION ALL SELECT 'reviews', 'pending_approval', '', count(*) FROM reviews WHERE passed AND NOT human_approved""", "docs mentions orphaned hyps reviews")
def j11(v):
    orphans = resolution.orphans(v.routed, resolution.valid_choices(v.routed, v.choices_raw), v.docs, as_of())
    return reports.system_status(v.docs, v.mentions, orphans, v.hyps, v.reviews)


@query("j12_confidence_band", "SELECT id, CASE WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM hyps", "hyps")
def j12(v):
    return v.hyps.select("id", scores.confidence_band(F.col("confidence")).alias("band"))
