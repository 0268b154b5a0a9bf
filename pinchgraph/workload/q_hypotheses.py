"""Registered queries of sections E and F."""

from __future__ import annotations

from pyspark.sql import functions as F

from pinchgraph.operators import ach
from pinchgraph.operators import hypotheses as hyp
from pinchgraph.workload.registry import query
from pinchgraph.workload.sqlviews import A
from pinchgraph.workload.views import as_of

_H = "id, node_id, confidence, status, awareness_layer"


def _h(df):
    return df.select("id", "node_id", "confidence", "status", "awareness_layer")


@query("e1_create", f"""SELECT left(sha256(node_id || '|' || statement), 32) AS id, node_id, statement, coalesce(confidence, 0.5) AS confidence,
'active' AS status, 1 AS awareness_layer, FALSE AS ach_reviewed, strftime({A}, '%Y-%m-%d') AS created FROM hyps""", "hyps")
def e1(v):
    made = hyp.create(v.hyps.withColumn("falsification_criteria", F.array().cast("array<string>")).withColumn(
        "srs_score", F.col("srs_score_at_creation")), as_of())
    return made.select("id", "node_id", "statement", "confidence", "status", "awareness_layer", "ach_reviewed",
                       F.date_format("created_at", "yyyy-MM-dd").alias("created"))


# the fold walks the numbered evidence of every hypothesis, one row per recursion
_FOLD = """
WITH RECURSIVE numbered AS (SELECT hypothesis_id, supports, row_number() OVER (PARTITION BY hypothesis_id ORDER BY ts, doc_uid) AS r FROM {evidence}),
walk AS (SELECT id, CAST(0 AS BIGINT) AS r, confidence AS c FROM hyps UNION ALL
  SELECT w.id, n.r, CASE WHEN n.supports THEN least(w.c + 0.05::DOUBLE, 0.95::DOUBLE) ELSE greatest(w.c - 0.08::DOUBLE, 0.05::DOUBLE) END
  FROM walk w JOIN numbered n ON n.hypothesis_id = w.id AND n.r = w.r + 1),
counted AS (SELECT hypothesis_id, count(*) FILTER (supports) AS f, count(*) FILTER (NOT supports) AS g FROM {evidence} GROUP BY 1)
SELECT id, round(arg_max(c, r), 6) AS confidence, coalesce(max(f), 0) AS evidence_for, coalesce(max(g), 0) AS evidence_against
FROM walk LEFT JOIN counted ON hypothesis_id = id GROUP BY id"""


@query("e2_fold_evidence", _FOLD.format(evidence="evidence"), "hyps evidence")
def e2(v):
    return hyp.apply_evidence(v.hyps, v.evidence).select("id", "confidence", "evidence_for", "evidence_against")


@query("e3_status_change", f"""SELECT id, CASE WHEN s_suppkey % 4 = 1 THEN 'falsified' ELSE status END AS status,
ach_reviewed OR s_suppkey % 8 = 1 AS ach_reviewed,
strftime(CASE WHEN s_suppkey % 4 = 1 THEN {A} ELSE updated_at END, '%Y-%m-%d') AS updated FROM hyps""", "hyps")
def e3(v):
    k = F.col("s_suppkey")
    decisions = v.hyps.where(k % 4 == 1).select("id", F.lit("falsified").alias("new_status"), (k % 8 == 1).alias("reviewed"))
    return hyp.set_status(v.hyps, decisions, as_of()).select("id", "status", "ach_reviewed", F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


@query("e4_active", f"SELECT {_H} FROM hyps WHERE status = 'active' AND confidence >= 0.6", "hyps")
def e4(v):
    return _h(hyp.by_confidence(hyp.active(v.hyps, 0.6)))


@query("e4_for_node", f"SELECT {_H} FROM hyps WHERE node_id = 'COMP-7'", "hyps")
def e4_node(v):
    return _h(hyp.for_node(v.hyps, "COMP-7"))


@query("e4_list_all", f"SELECT {_H} FROM hyps ORDER BY confidence DESC, id LIMIT 50", "hyps")
def e4_all(v):
    return _h(hyp.by_confidence(v.hyps, 50))


@query("e5_counts", """SELECT 'total' AS metric, '' AS key, count(*) AS n FROM hyps UNION ALL
SELECT 'needs_ach_review', '', count(*) FROM hyps WHERE status = 'active' AND confidence >= 0.8 AND NOT ach_reviewed UNION ALL
SELECT 'status', status, count(*) FROM hyps GROUP BY status""", "hyps")
def e5(v):
    return hyp.counts(v.hyps)


_TONE = """CASE WHEN (length(t) >= 0) THEN list_sum(list_transform(['shortage','delay','disruption','bottleneck','constrained','sole source','single source','export control','ban','restriction','sanctions','tariff','capacity constraint','lead time','backlog','allocation','rationing'], lambda x: CAST(contains(t, x) AS INTEGER))) END"""
_CALM = """list_sum(list_transform(['expansion','new fab','alternative supplier','qualification','diversif','investment','capacity increase','second source','partnership'], lambda x: CAST(contains(t, x) AS INTEGER)))"""


@query("e6_document_evidence", f"""SELECT h.id AS hypothesis_id, m.doc_uid, {_TONE} - {_CALM} >= 0 AS supports,
'[' || left(m.doc_uid, 12) || '] ' || left(d.title, 120) AS line
FROM (SELECT DISTINCT doc_uid, node_id FROM mentions) m JOIN (SELECT *, lower(title || ' ' || text) AS t FROM docs) d ON d.uid = m.doc_uid
JOIN hyps h ON h.node_id = m.node_id AND h.status = 'active'""", "mentions docs hyps")
def e6(v):
    return hyp.document_evidence(v.hyps, v.mentions, v.docs).select("hypothesis_id", "doc_uid", "supports", "line")


# documents of even number count as applied already
_E7 = """SELECT h.id AS hypothesis_id, m.doc_uid FROM (SELECT m.doc_uid, m.node_id FROM mentions m JOIN docs d ON d.uid = m.doc_uid
WHERE d.published_at >= {0} - INTERVAL 30 DAY {1}) m JOIN hyps h ON h.node_id = m.node_id AND h.status = 'active'
WHERE CAST(substr(m.doc_uid, 5) AS BIGINT) % 2 = 1"""


def _unapplied(v, newest):
    applied = v.mentions.where(F.substring("doc_uid", 5, 20).cast("long") % 2 == 0).join(
        v.hyps.select("node_id", F.col("id").alias("hypothesis_id")), "node_id").select("hypothesis_id", "doc_uid")
    return hyp.unapplied_evidence(v.hyps, v.mentions, v.docs, applied, as_of(), newest=newest).select("hypothesis_id", "doc_uid")


@query("e7_reconcile", _E7.format(A, ""), "mentions docs hyps")
def e7(v):
    return _unapplied(v, None)


@query("e7_reconcile_newest", _E7.format(A, "ORDER BY d.published_at DESC, m.doc_uid, m.node_id LIMIT 2000"), "mentions docs hyps")
def e7_newest(v):
    """One work batch: the newest 2000 mentions."""
    return _unapplied(v, 2000)


@query("e7_exactly_once", """SELECT id, confidence FROM (""" + _FOLD.format(evidence="evidence") + ")", "hyps evidence")
def e7_once(v):
    """Evidence delivered twice changes nothing."""
    twice = v.evidence.unionByName(v.evidence)
    return hyp.apply_evidence(v.hyps, twice).select("id", "confidence")


@query("e8_windows_at_risk", f"SELECT {_H} FROM hyps WHERE status = 'active' AND confidence >= 0.7 AND awareness_layer <= 2", "hyps")
def e8(v):
    return _h(hyp.windows_at_risk(v.hyps))


@query("e9_candidates", """SELECT node_id, srs_score FROM (SELECT * FROM (SELECT * FROM scores ORDER BY srs_score DESC, node_id LIMIT 20)
WHERE srs_score >= 0.4 ORDER BY srs_score DESC, node_id LIMIT 10) WHERE node_id NOT IN (SELECT node_id FROM hyps WHERE status = 'active')""", "scores hyps")
def e9(v):
    return hyp.select_candidates(v.node_scores(), v.hyps).select("node_id", "srs_score")


def _generated(v):
    """Raw answers per hypothesis node: complete, too few criteria, no statement, or no object."""
    k = F.col("s_suppkey")
    crit = F.when(k % 3 == 0, '["a", "b", "c", "d"]').when(k % 3 == 1, '["a"]').otherwise('["x", "y"]')
    conf = F.when(k % 2 == 0, F.lit(', "confidence": 0.99')).otherwise(F.lit(""))
    body = F.concat(F.lit('Sure. {"statement": "'), F.when(k % 7 == 0, F.lit("  ")).otherwise(F.concat(F.lit("claim on "), "node_name")),
                    F.lit('", "falsification_criteria": '), crit, conf, F.lit("} done"))
    return v.hyps.select("node_id", "node_name", F.col("srs_score_at_creation").alias("srs_score"),
                         F.when(k % 11 == 0, F.lit("I cannot.")).otherwise(body).alias("response"))


_GEN = """SELECT node_id, 'claim on ' || node_name AS statement, CASE WHEN s_suppkey % 3 = 0 THEN 'a|b|c' ELSE 'x|y' END AS criteria,
least(CASE WHEN s_suppkey % 2 = 0 THEN 0.99::DOUBLE ELSE srs_score_at_creation END, 0.85::DOUBLE) AS confidence
FROM hyps WHERE s_suppkey % 11 <> 0 AND s_suppkey % 7 <> 0 AND s_suppkey % 3 <> 1"""


@query("e10_parse_generated", _GEN, "hyps")
def e10(v):
    return hyp.parse_generated(_generated(v)).select(
        "node_id", "statement", F.array_join("falsification_criteria", "|").alias("criteria"), "confidence")


@query("e11_generation_counts", f"SELECT (SELECT count(*) FROM ({_GEN})) AS generated, count(*) - (SELECT count(*) FROM ({_GEN})) AS skipped FROM hyps", "hyps")
def e11(v):
    raw = _generated(v)
    return hyp.generation_counts(raw, hyp.parse_generated(raw))


@query("f1_review_candidates", f"SELECT {_H} FROM hyps WHERE status = 'active' AND confidence >= 0.8 AND NOT ach_reviewed", "hyps")
def f1(v):
    return _h(ach.review_candidates(v.hyps))


@query("f2_evidence_list", """SELECT hypothesis_id, row_number() OVER (PARTITION BY hypothesis_id ORDER BY supports DESC, ts, doc_uid) AS evidence_no, line
FROM evidence UNION ALL SELECT id, 1, 'Structural risk: SRS=' || printf('%.2f', coalesce(nullif(srs_score_at_creation, 0), 0.5)) || ' (graph topology)'
FROM hyps WHERE id NOT IN (SELECT hypothesis_id FROM evidence)""", "evidence hyps")
def f2(v):
    return ach.evidence_list(v.hyps, v.evidence).select("hypothesis_id", "evidence_no", "line")


@query("f3_alternatives", """SELECT hypothesis_id, CAST(unnest(range(1, len(alts) + 1)) AS INTEGER) AS alt_no, unnest(alts) AS alternative FROM (
SELECT id AS hypothesis_id, CASE WHEN s_suppkey % 3 = 0 THEN ['alt one', 'alt two', 'alt three'] WHEN s_suppkey % 3 = 1 THEN ['only ' || node_name]
ELSE [node_name || ' supply risk is overstated due to existing alternatives', 'Market forces will resolve the ' || node_name || ' bottleneck within 18 months'] END AS alts FROM hyps)""", "hyps")
def f3(v):
    k = F.col("s_suppkey")
    raw = (F.when(k % 3 == 0, F.lit('List: ["alt one", " alt two ", "", "alt three", "alt four"] end'))
           .when(k % 3 == 1, F.concat(F.lit('["only '), "node_name", F.lit('"]'))).otherwise(F.lit("none")))
    return ach.alternatives(v.hyps.select(F.col("id").alias("hypothesis_id"), "node_name", raw.alias("response")))


@query("f4_classify", """SELECT h.id AS hypothesis_id, CAST(0 AS INTEGER) AS alt_no, e.evidence_no,
CASE WHEN s_suppkey % 2 = 0 AND e.evidence_no = 1 THEN 'C' WHEN s_suppkey % 2 = 0 AND e.evidence_no = 2 THEN 'I' ELSE 'N' END AS class
FROM hyps h JOIN (SELECT hypothesis_id, row_number() OVER (PARTITION BY hypothesis_id ORDER BY ts, doc_uid) AS evidence_no FROM evidence) e ON e.hypothesis_id = h.id""", "hyps evidence")
def f4(v):
    """Every supplier's answer names a few classes; the rest of its evidence is padded."""
    items = ach.evidence_list(v.hyps, v.evidence).join(v.evidence.select("hypothesis_id").distinct(), "hypothesis_id", "left_semi")
    raw = F.when(F.col("s_suppkey") % 2 == 0, F.lit('["c", " I ", "maybe"]')).otherwise(F.lit("no list"))
    return ach.classify(v.hyps.select(F.col("id").alias("hypothesis_id"), F.lit(0).alias("alt_no"), raw.alias("response")), items)


@query("f5_matrix_cells", "SELECT * FROM cells", "cells")
def f5(v):
    return ach.one_class_per_cell(v.cells)


@query("f6_robustness", "SELECT hypothesis_id, evidence_count, round(robustness, 6) AS robustness FROM robust", "robust")
def f6(v):
    return ach.robustness(v.cells).withColumn("robustness", F.round("robustness", 6))


@query("f7_review_result", """SELECT id AS hypothesis_id, round(coalesce(robustness, 0), 6) AS robustness, coalesce(robustness, 0) >= 0.4 AS passed,
round(CASE WHEN coalesce(robustness, 0) >= 0.4 THEN confidence ELSE greatest(confidence - 0.08::DOUBLE, 0.05::DOUBLE) END, 6) AS confidence
FROM hyps LEFT JOIN robust ON hypothesis_id = id WHERE status = 'active' AND confidence >= 0.8 AND NOT ach_reviewed""", "hyps robust")
def f7(v):
    cand = ach.review_candidates(v.hyps)
    reviews = ach.review(cand, v.cells, as_of())
    after = hyp.apply_evidence(cand, ach.failed_review_evidence(reviews)).select(F.col("id").alias("hypothesis_id"), "confidence")
    return reviews.select("hypothesis_id", F.round("robustness", 6).alias("robustness"), "passed").join(after, "hypothesis_id")


def _new_reviews(v):
    return ach.review(ach.review_candidates(v.hyps), v.cells, as_of()).select("hypothesis_id", "robustness", "passed", "reviewed_at", "human_approved")


_NEW = f"""SELECT id AS hypothesis_id, coalesce(robustness, 0) AS robustness, coalesce(robustness, 0) >= 0.4 AS passed, {A} AS reviewed_at, FALSE AS human_approved
FROM hyps LEFT JOIN robust ON hypothesis_id = id WHERE status = 'active' AND confidence >= 0.8 AND NOT ach_reviewed"""


@query("f8_save_reviews", f"""SELECT hypothesis_id, round(robustness, 6) AS robustness, passed, human_approved FROM ({_NEW} UNION ALL
SELECT * FROM reviews WHERE hypothesis_id NOT IN (SELECT hypothesis_id FROM ({_NEW})))""", "hyps robust reviews")
def f8(v):
    return ach.save_reviews(v.reviews, _new_reviews(v)).select(
        "hypothesis_id", F.round("robustness", 6).alias("robustness"), "passed", "human_approved")


@query("f9_pending_approval", "SELECT hypothesis_id, strftime(reviewed_at, '%Y-%m-%d') AS reviewed FROM reviews WHERE passed AND NOT human_approved", "reviews")
def f9(v):
    return ach.pending_approval(v.reviews).select("hypothesis_id", F.date_format("reviewed_at", "yyyy-MM-dd").alias("reviewed"))


@query("f9_approve", """SELECT r.hypothesis_id, human_approved OR coalesce(h.awareness_layer = 4, FALSE) AS human_approved
FROM reviews r JOIN hyps h ON h.id = r.hypothesis_id""", "reviews hyps")
def f9_approve(v):
    chosen = v.hyps.where("awareness_layer = 4").select(F.col("id").alias("hypothesis_id"))
    return ach.approve(v.reviews, chosen).select("hypothesis_id", "human_approved")


@query("f10_run_summary", f"""SELECT count(*) AS reviewed, count(*) FILTER (passed) AS passed, (SELECT count(*) FROM (
SELECT passed, human_approved FROM ({_NEW}) UNION ALL SELECT passed, human_approved FROM reviews WHERE hypothesis_id NOT IN (SELECT hypothesis_id FROM ({_NEW})))
WHERE passed AND NOT human_approved) AS pending_human_review FROM ({_NEW})""", "hyps robust reviews")
def f10(v):
    fresh = _new_reviews(v)
    return ach.run_summary(fresh, ach.save_reviews(v.reviews, fresh))


@query("f11_matrix_view", """SELECT hypothesis_id, evidence_no, coalesce(min(class) FILTER (alt_no = 0), 'N') AS h0, coalesce(min(class) FILTER (alt_no = 1), 'N') AS h1,
coalesce(min(class) FILTER (alt_no = 2), 'N') AS h2, coalesce(min(class) FILTER (alt_no = 3), 'N') AS h3 FROM cells GROUP BY 1, 2""", "cells")
def f11(v):
    return ach.matrix_view(v.cells)
