"""Registered queries of section G."""

from __future__ import annotations

from pyspark.sql import functions as F

from pinchgraph.functions import scores
from pinchgraph.operators import scoring
from pinchgraph.workload.registry import query
from pinchgraph.workload.sqlviews import A
from pinchgraph.workload.views import as_of

_OUT = ["id", "node_id", "confidence", "awareness_layer", "srs_score", "ias", "specificity", "validation", "recency",
        "robustness_ach", "ops_raw", "ops_final", "tier", "ach_reviewed", "evidence_for_count", "evidence_against_count"]
_COLS = ", ".join(_OUT)


@query("g1_asymmetry", "SELECT id, awareness_layer, CASE awareness_layer WHEN 1 THEN 0.75::DOUBLE WHEN 2 THEN 0.5::DOUBLE WHEN 3 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS ias FROM hyps", "hyps")
def g1(v):
    return v.hyps.select("id", "awareness_layer", scores.asymmetry(F.col("awareness_layer")).alias("ias"))


@query("g2_recency", f"""SELECT id, CASE WHEN d < 7 THEN 1.0::DOUBLE WHEN d < 30 THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END AS recency FROM (
SELECT id, date_diff('day', coalesce(updated_at, created_at), {A}) AS d FROM hyps)""", "hyps")
def g2(v):
    return v.hyps.select("id", scores.recency(F.coalesce("updated_at", "created_at"), as_of()).alias("recency"))


@query("g3_specificity_validation", "SELECT id, specificity, validation FROM scored", "scored")
def g3(v):
    return v.scored.select("id", "specificity", "validation")


@query("g4_opportunity_score", "SELECT id, ops_raw, ops_final, robustness_ach FROM scored", "scored")
def g4(v):
    return v.scored.select("id", "ops_raw", "ops_final", "robustness_ach")


@query("g5_tiers", f"SELECT {_COLS} FROM scored", "scored")
def g5(v):
    return v.scored.select(*_OUT)


@query("g6_ranked_opportunities", f"SELECT {_COLS} FROM scored WHERE status = 'active' AND tier <= 3 ORDER BY ops_final DESC, id", "scored")
def g6(v):
    return scoring.ranked(v.scored).select(*_OUT)


@query("g7_summary", """SELECT count(*) AS total, count(*) FILTER (tier = 1) AS tier1, count(*) FILTER (tier = 2) AS tier2, count(*) FILTER (tier = 3) AS tier3,
(SELECT id FROM scored WHERE status = 'active' ORDER BY ops_final DESC, id LIMIT 1) AS top_id, max(ops_final) AS top_ops
FROM scored WHERE status = 'active'""", "scored")
def g7(v):
    return scoring.summary(v.scored)
