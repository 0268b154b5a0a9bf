"""Routing of documents to nodes, choice validation, mentions and orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinchgraph.functions.jsontext import field, flat_object
from pinchgraph.storage import insert_ignore, keep_last, replace_rows

SIMILARITY_HIGH = 0.80
SIMILARITY_LOW = 0.55
MIN_CHOICE_CONFIDENCE = 0.60


def route(scored: DataFrame, high: float = SIMILARITY_HIGH, low: float = SIMILARITY_LOW) -> DataFrame:
    """Adds best node, best similarity and `route` from the candidate array; no shuffle.

    `auto` at or above `high`, `choose` at or above `low`, else `below_threshold`, or
    `no_candidates` when the array is empty.
    """
    best = F.try_element_at("candidates", F.lit(1))
    return (
        scored.withColumn("best_node", best["node_id"])
        .withColumn("best_similarity", F.coalesce(best["similarity"], F.lit(0.0)))
        .withColumn("route", F.when(F.size("candidates") == 0, "no_candidates")
                    .when(F.col("best_similarity") >= high, "auto")
                    .when(F.col("best_similarity") >= low, "choose")
                    .otherwise("below_threshold"))
    )


def auto_mentions(routed: DataFrame, as_of: Column, high: float = SIMILARITY_HIGH) -> DataFrame:
    """One mention for every candidate at or above `high`."""
    return routed.where(F.col("route") == "auto").select(
        "doc_uid", F.explode(F.filter("candidates", lambda c: c["similarity"] >= high)).alias("c")).select(
        "doc_uid", F.col("c.node_id").alias("node_id"), F.col("c.similarity").alias("confidence"),
        F.lit("vector_auto").alias("method"), as_of.alias("resolved_at"))


def valid_choices(routed: DataFrame, responses: DataFrame) -> DataFrame:
    """C4: choices that name a candidate with enough confidence.

    `responses` has doc_uid and the raw `response` text.  A leading `id=` is removed and the
    words null and none count as no choice.
    """
    parsed = responses.select("doc_uid", flat_object(F.col("response")).alias("_doc"))
    stripped = F.regexp_replace(field(F.col("_doc"), "node_id"), "^id=", "")
    chosen = parsed.select(
        "doc_uid",
        F.when(~F.lower(stripped).isin("null", "none", ""), stripped).alias("node_id"),
        F.coalesce(field(F.col("_doc"), "confidence").try_cast("double"), F.lit(0.0)).alias("confidence"),
        F.left(F.coalesce(field(F.col("_doc"), "reason"), F.lit("")), F.lit(200)).alias("reason"),
    ).where(F.col("node_id").isNotNull() & (F.col("confidence") >= MIN_CHOICE_CONFIDENCE))
    open_ = routed.where(F.col("route") == "choose").select(
        "doc_uid", F.transform("candidates", lambda c: c["node_id"]).alias("_ids"))
    return chosen.join(open_, "doc_uid").where(F.array_contains("_ids", F.col("node_id"))).drop("_ids")


def chosen_mentions(choices: DataFrame, as_of: Column) -> DataFrame:
    """Mentions made by valid choices."""
    return choices.select("doc_uid", "node_id", "confidence", F.lit("mistral").alias("method"), as_of.alias("resolved_at"))


def orphans(routed: DataFrame, choices: DataFrame, docs: DataFrame, as_of: Column) -> DataFrame:
    """Documents left without a node and why, with the stored excerpt lengths.

    A review needs the candidates they had (`candidate_entities`, node ids by falling similarity), the time they
    were set aside (`created_at`) and their vector (`embedding`, null where `docs` has none).
    """
    decided = choices.select("doc_uid").distinct().withColumn("_decided", F.lit(True))
    left = routed.join(decided, "doc_uid", "left").where(
        F.col("route").isin("no_candidates", "below_threshold")
        | ((F.col("route") == "choose") & F.col("_decided").isNull()))
    reason = F.when(F.col("route") == "choose", "mistral_undecided").otherwise(F.col("route"))
    text = docs.select(F.col("uid").alias("doc_uid"), F.left("title", F.lit(512)).alias("title"),
                       F.left("text", F.lit(500)).alias("text_excerpt"),
                       F.col("embedding") if "embedding" in docs.columns else F.lit(None).cast("array<float>").alias("embedding"))
    candidates = F.coalesce(F.transform("candidates", lambda c: c["node_id"]), F.array().cast("array<string>"))
    return left.select("doc_uid", "best_node", "best_similarity", reason.alias("reason"), candidates.alias("candidate_entities")).join(
        text, "doc_uid", "left").select(
        F.concat(F.lit("orphan:"), "doc_uid").alias("uid"), "doc_uid", "title", "text_excerpt", "embedding", "candidate_entities", "best_node",
        "best_similarity", "reason", F.lit("pending").alias("status"), as_of.alias("created_at"))


def upsert_documents(stored: DataFrame, docs: DataFrame) -> DataFrame:
    """Replace document rows by uid."""
    return replace_rows(stored, docs.select(*stored.columns), ["uid"])


def upsert_mentions(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Per (document, node) the latest resolution wins."""
    every = stored.select("doc_uid", "node_id", "confidence", "method", "resolved_at").unionByName(
        found.select("doc_uid", "node_id", "confidence", "method", "resolved_at"))
    order = ["resolved_at", "method", "confidence"]
    return keep_last(every, ["doc_uid", "node_id"], order).distinct()


def add_orphans(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Insert orphans not yet known."""
    return insert_ignore(stored, found.dropDuplicates(["uid"]), ["uid"])


def pending_orphans(stored: DataFrame, limit: int = 50) -> DataFrame:
    """Oldest pending first, at most `limit` for review."""
    return stored.where(F.col("status") == "pending").orderBy("created_at", "uid").limit(limit)


def decide_orphans(stored: DataFrame, decisions: DataFrame) -> DataFrame:
    """`decisions` (uid, decision, node_id): `resolve` sets the node, `dismiss` keeps it."""
    d = decisions.select("uid", "decision", F.col("node_id").alias("_node"))
    resolved = F.col("decision") == "resolve"
    return (
        stored.join(d, "uid", "left")
        .withColumn("best_node", F.when(resolved, F.col("_node")).otherwise(F.col("best_node")))
        .withColumn("status", F.when(resolved, "resolved").when(F.col("decision") == "dismiss", "dismissed")
                    .otherwise(F.col("status")))
        .drop("decision", "_node")
    )


def orphan_counts(stored: DataFrame) -> DataFrame:
    """C11."""
    return stored.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "pending").alias("pending"),
                      F.count_if(F.col("status") == "resolved").alias("resolved"))


def outcomes(routed: DataFrame, choices: DataFrame) -> DataFrame:
    """Documents auto-routed, routed by choice, and orphaned."""
    decided = choices.select("doc_uid").distinct().withColumn("_decided", F.lit(True))
    auto = F.col("route") == "auto"
    chosen = (F.col("route") == "choose") & F.col("_decided").isNotNull()
    return routed.select("doc_uid", "route").join(decided, "doc_uid", "left").agg(
        F.count_if(auto).alias("auto_routed"), F.count_if(chosen).alias("choice_routed"),
        F.count_if(~auto & ~chosen).alias("orphaned"), F.count(F.lit(1)).alias("processed"))
