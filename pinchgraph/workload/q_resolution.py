"""Registered queries of section C."""

from __future__ import annotations

from pyspark.sql import functions as F

from pinchgraph.operators import pruned_vectors, vectors
from pinchgraph.operators import resolution as res
from pinchgraph.workload.registry import query
from pinchgraph.workload.views import HIGH, as_of

_E = "embeddings"


@query("c1_cosine", f"""SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity
FROM {_E} a JOIN {_E} b ON b.vec_id = a.vec_id + 1""")
def c1(v):
    """Each vector with its successor."""
    a = v.table("embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return a.join(b, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("next")), 6).alias("similarity"))


@query("c2_top_k", "SELECT doc_uid, CAST(r AS INTEGER) AS position, node_id, round(sim, 6) AS similarity FROM topk", "topk")
def c2(v):
    top = vectors.top_k_nodes(v.doc_vectors, v.node_vectors, 10)
    return top.select("doc_uid", F.posexplode("candidates").alias("p", "c")).select(
        "doc_uid", (F.col("p") + 1).alias("position"), F.col("c.node_id").alias("node_id"), F.round("c.similarity", 6).alias("similarity"))


@query("c2_top_k_grid", "SELECT doc_uid, CAST(r AS INTEGER) AS position, node_id, round(sim, 6) AS similarity FROM topk", "topk")
def c2_grid(v):
    """The same through the block grid that serves node sets too large to broadcast."""
    top = vectors.top_k_nodes(v.doc_vectors, v.node_vectors, 10, max_node_bytes=0)
    return top.select("doc_uid", F.posexplode("candidates").alias("p", "c")).select(
        "doc_uid", (F.col("p") + 1).alias("position"), F.col("c.node_id").alias("node_id"), F.round("c.similarity", 6).alias("similarity"))


@query("c2_top_k_pruned", "SELECT doc_uid, CAST(r AS INTEGER) AS position, node_id, round(sim, 6) AS similarity FROM topk", "topk")
def c2_pruned(v):
    """The same with clusters of nodes skipped by their angle bound."""
    top, _, _ = pruned_vectors.top_k_pruned(v.doc_vectors, v.node_vectors, 10)
    return top.select("doc_uid", F.posexplode("candidates").alias("p", "c")).select(
        "doc_uid", (F.col("p") + 1).alias("position"), F.col("c.node_id").alias("node_id"), F.round("c.similarity", 6).alias("similarity"))


@query("c3_route", "SELECT doc_uid, best_node, round(best_similarity, 6) AS best_similarity, route FROM routed", "routed")
def c3(v):
    return v.routed.select("doc_uid", "best_node", F.round("best_similarity", 6).alias("best_similarity"), "route")


@query("c3_auto_mentions", "SELECT doc_uid, node_id, round(confidence, 6) AS confidence, 'vector_auto' AS method FROM mentions", "mentions")
def c3_mentions(v):
    return v.mentions.select("doc_uid", "node_id", F.round("confidence", 6).alias("confidence"), "method")


@query("c4_valid_choices", "SELECT doc_uid, node_id, CAST(confidence AS DOUBLE) AS confidence, 'closest' AS reason FROM choices", "choices")
def c4(v):
    return res.valid_choices(v.routed, v.choices_raw)


def _orphans(v):
    vectors_ = v.doc_vectors.select(F.col("doc_uid").alias("uid"), "embedding")
    return res.orphans(v.routed, res.valid_choices(v.routed, v.choices_raw), v.docs.join(vectors_, "uid", "left"), as_of())


@query("c5_orphans", """SELECT o.uid, o.doc_uid, d.title, left(d.text, 500) AS text_excerpt, best_node, round(best_similarity, 6) AS best_similarity, reason,
(SELECT string_agg(node_id, ' ' ORDER BY r) FROM topk t WHERE t.doc_uid = o.doc_uid) AS candidates, round(list_sum(CAST(e.embedding AS DOUBLE[])), 3) AS vector_sum
FROM orphaned o LEFT JOIN docs d ON d.uid = o.doc_uid JOIN embeddings e ON e.vec_id = o.vec_id""", "orphaned docs topk")
def c5(v):
    return _orphans(v).select("uid", "doc_uid", "title", "text_excerpt", "best_node", F.round("best_similarity", 6).alias("best_similarity"), "reason",
                              F.nullif(F.array_join("candidate_entities", " "), F.lit("")).alias("candidates"),
                              F.round(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 3).alias("vector_sum"))


@query("c6_upsert_documents", "SELECT uid, CASE WHEN lang = 'fr' THEN 'new' ELSE source END AS source FROM docs WHERE ias_tier <= 2 OR lang = 'fr'", "docs")
def c6(v):
    stored = v.docs.where("ias_tier <= 2").select("uid", "source")
    incoming = v.docs.where("lang = 'fr'").select("uid", F.lit("new").alias("source"))
    return res.upsert_documents(stored, incoming)


@query("c7_upsert_mentions", """SELECT doc_uid, node_id, CASE WHEN CAST(substr(node_id, 6) AS INTEGER) % 2 = 0 THEN 1.0 ELSE round(confidence, 6) END AS confidence,
CASE WHEN CAST(substr(node_id, 6) AS INTEGER) % 2 = 0 THEN 'mistral' ELSE 'vector_auto' END AS method FROM mentions""", "mentions")
def c7(v):
    """Mentions of even nodes are resolved again later by choice."""
    later = v.mentions.where(F.substring("node_id", 6, 10).cast("int") % 2 == 0).withColumn("confidence", F.lit(1.0)).withColumn(
        "method", F.lit("mistral")).withColumn("resolved_at", as_of() + F.expr("INTERVAL 1 DAY"))
    return res.upsert_mentions(v.mentions, later).select("doc_uid", "node_id", F.round("confidence", 6).alias("confidence"), "method")


@query("c8_add_orphans", "SELECT uid, CASE WHEN vec_id % 2 = 0 THEN 'old' ELSE reason END AS reason FROM orphaned", "orphaned")
def c8(v):
    """Half of the orphans are known already and keep their stored row."""
    found = _orphans(v).select("uid", "reason")
    known = found.where(F.substring("uid", 12, 20).cast("long") % 2 == 0).withColumn("reason", F.lit("old"))
    return res.add_orphans(known, found)


def stored_orphans(v):
    """Orphans of even documents were stored up to a month ago, a part is resolved; all of them arrive again."""
    found = _orphans(v)
    n = F.substring("uid", 12, 20).cast("long")
    known = found.where(n % 2 == 0).withColumn("status", F.when(n % 4 == 0, "resolved").otherwise("pending")).withColumn(
        "created_at", as_of() - F.make_dt_interval(days=(n % 30).cast("int")))
    return res.add_orphans(known, found)


@query("c9_pending_orphans", """SELECT uid, best_node FROM orphaned WHERE vec_id % 4 <> 0 ORDER BY CASE WHEN vec_id % 2 = 0 THEN vec_id % 30 ELSE 0 END DESC, uid LIMIT 50""", "orphaned")
def c9(v):
    return res.pending_orphans(stored_orphans(v)).select("uid", "best_node")


@query("c10_decide_orphans", """SELECT uid, CASE WHEN vec_id % 3 = 0 THEN 'COMP-1' ELSE best_node END AS best_node,
CASE WHEN vec_id % 3 = 0 THEN 'resolved' WHEN vec_id % 3 = 1 THEN 'dismissed' WHEN vec_id % 4 = 0 THEN 'resolved' ELSE 'pending' END AS status FROM orphaned""", "orphaned")
def c10(v):
    stored = stored_orphans(v)
    n = F.substring("uid", 12, 20).cast("long")
    decisions = stored.where(n % 3 < 2).select("uid", F.when(n % 3 == 0, "resolve").otherwise("dismiss").alias("decision"),
                                               F.lit("COMP-1").alias("node_id"))
    return res.decide_orphans(stored, decisions).select("uid", "best_node", "status")


@query("c11_orphan_counts", """SELECT count(*) AS total, count(*) FILTER (vec_id % 4 <> 0) AS pending, count(*) FILTER (vec_id % 4 = 0) AS resolved FROM orphaned""", "orphaned")
def c11(v):
    return res.orphan_counts(stored_orphans(v))


@query("c12_outcomes", """SELECT count(*) FILTER (route = 'auto') AS auto_routed, (SELECT count(*) FROM choices) AS choice_routed,
(SELECT count(*) FROM orphaned) AS orphaned, count(*) AS processed FROM routed""", "routed choices orphaned")
def c12(v):
    return res.outcomes(v.routed, res.valid_choices(v.routed, v.choices_raw))
