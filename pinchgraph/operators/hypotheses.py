"""Hypotheses and the evidence folded into their confidence.

Evidence is a long table (hypothesis_id, doc_uid, ts, supports); lists are never kept in rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinchgraph.functions.jsontext import field, greedy_object, string_list
from pinchgraph.functions.text import evidence_line, evidence_tone

# Effect of one piece of evidence on confidence.
SUPPORT_STEP, SUPPORT_CAP = 0.05, 0.95
AGAINST_STEP, AGAINST_FLOOR = 0.08, 0.05
MIN_SRS = 0.40
MAX_START_CONFIDENCE = 0.85
#: Evidence rows folded in one array.
CHUNK = 4096


def create(candidates: DataFrame, as_of: Column) -> DataFrame:
    """New active hypotheses; the id is a hash of node and statement, so a rerun makes the same row."""
    return candidates.select(
        F.left(F.sha2(F.concat_ws("|", "node_id", "statement"), 256), F.lit(32)).alias("id"),
        "node_id", "node_name", "statement", F.coalesce("confidence", F.lit(0.5)).alias("confidence"),
        F.lit("active").alias("status"), F.lit(1).alias("awareness_layer"), "falsification_criteria",
        F.col("srs_score").alias("srs_score_at_creation"), F.lit(False).alias("ach_reviewed"),
        as_of.alias("created_at"), as_of.alias("updated_at"))


def _compose(items: Column) -> Column:
    """Compose clamp-adds x -> min(max(x + add, low), high) given in order.

    Such functions are closed under composition, so any run of evidence shrinks to one of them.
    """
    def bound(x: Column, low: Column, high: Column) -> Column:
        return F.least(F.greatest(x, low), high)

    start = F.struct(F.lit(0.0).alias("add"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
    return F.aggregate(items, start, lambda acc, s: F.struct(
        (acc["add"] + s["add"]).alias("add"),
        bound(acc["low"] + s["add"], s["low"], s["high"]).alias("low"),
        bound(acc["high"] + s["add"], s["low"], s["high"]).alias("high")))


def _fold(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Fold the steps of each group, in `order`, to one step."""
    items = F.array_sort(F.collect_list(F.struct(*order, "add", "low", "high")))
    return df.groupBy(*keys).agg(_compose(items).alias("_f"), F.sum("n_for").alias("n_for"),
                                 F.sum("n_against").alias("n_against")).select(
        *keys, "_f.add", "_f.low", "_f.high", "n_for", "n_against")


def fold_evidence(evidence: DataFrame) -> DataFrame:
    """One step (add, low, high) per hypothesis, with counts for and against.

    Support: min(c + .05, .95); against: max(c - .08, .05), in order of (ts, doc_uid).  Rows are
    range-partitioned by (hypothesis, ts, uid), so even a hypothesis owning most rows spreads
    over many tasks; runs of at most `CHUNK` rows are folded, then the runs of a partition,
    then the partitions.
    """
    inf = float("inf")
    steps = evidence.select(
        "hypothesis_id", "ts", "doc_uid",
        F.when(F.col("supports"), SUPPORT_STEP).otherwise(-AGAINST_STEP).alias("add"),
        F.when(F.col("supports"), -inf).otherwise(AGAINST_FLOOR).alias("low"),
        F.when(F.col("supports"), SUPPORT_CAP).otherwise(inf).alias("high"),
        F.col("supports").cast("long").alias("n_for"), (~F.col("supports")).cast("long").alias("n_against"))
    order = ["hypothesis_id", "ts", "doc_uid"]
    placed = steps.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "_row", F.monotonically_increasing_id())
    # the upper bits of _row are the partition, the lower 33 the position in it
    runs = _fold(placed.withColumn("_run", F.floor(F.col("_row") / CHUNK)), ["hypothesis_id", "_run"], ["ts", "doc_uid"])
    parts = _fold(runs.withColumn("_part", F.shiftright("_run", 33 - 12)), ["hypothesis_id", "_part"], ["_run"])
    return _fold(parts, ["hypothesis_id"], ["_part"])


def apply_evidence(hypotheses: DataFrame, evidence: DataFrame) -> DataFrame:
    """`hypotheses` with confidence after `evidence` (six digits) and counts for and against added.

    Evidence is taken exactly once per (hypothesis_id, doc_uid) (S13, S14).
    """
    once = evidence.groupBy("hypothesis_id", "doc_uid").agg(F.min(F.struct("ts", "supports")).alias("e")).select(
        "hypothesis_id", "doc_uid", "e.ts", "e.supports")
    effect = fold_evidence(once).withColumnRenamed("hypothesis_id", "id")
    after = F.least(F.greatest(F.col("confidence") + F.col("add"), F.col("low")), F.col("high"))
    zero = F.lit(0).cast("long")
    return hypotheses.join(effect, "id", "left").withColumn(
        "confidence", F.round(F.coalesce(after, F.col("confidence")), 6)).withColumn(
        "evidence_for", F.coalesce("n_for", zero)).withColumn("evidence_against", F.coalesce("n_against", zero)).drop(
        "add", "low", "high", "n_for", "n_against")


def set_status(hypotheses: DataFrame, decisions: DataFrame, as_of: Column) -> DataFrame:
    """`decisions` (id, new_status, reviewed): status and review mark; touched rows get a new time."""
    d = decisions.select("id", "new_status", "reviewed", F.lit(True).alias("_hit"))
    return hypotheses.join(d, "id", "left").withColumn("status", F.coalesce("new_status", "status")).withColumn(
        "ach_reviewed", F.coalesce("reviewed", F.lit(False)) | F.coalesce("ach_reviewed", F.lit(False))).withColumn(
        "updated_at", F.when(F.col("_hit"), as_of).otherwise(F.col("updated_at"))).drop("new_status", "reviewed", "_hit")


def active(hypotheses: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """Active rows at or above a confidence; order them with `by_confidence` for display."""
    return hypotheses.where((F.col("status") == "active") & (F.col("confidence") >= min_confidence))


def by_confidence(hypotheses: DataFrame, limit: int | None = None) -> DataFrame:
    """Highest confidence first, ties by id; `limit` gives the top list."""
    ordered = hypotheses.orderBy(F.desc("confidence"), "id")
    return ordered if limit is None else ordered.limit(limit)


def for_node(hypotheses: DataFrame, node_id: str) -> DataFrame:
    """Hypotheses of one node, highest confidence first."""
    return by_confidence(hypotheses.where(F.col("node_id") == node_id))


def needs_review(min_confidence: float = 0.80) -> Column:
    """active, confident and not reviewed."""
    return (F.col("status") == "active") & (F.col("confidence") >= min_confidence) & ~F.coalesce(
        "ach_reviewed", F.lit(False))


def counts(hypotheses: DataFrame) -> DataFrame:
    """E5: total, per status and awaiting review, as (metric, key, n)."""
    by_status = hypotheses.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(needs_review()).alias("r"))
    totals = by_status.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("r"), F.lit(0)).alias("r"))
    head = totals.select(F.inline(F.array(
        F.struct(F.lit("total").alias("metric"), F.lit("").alias("key"), F.col("n").alias("n")),
        F.struct(F.lit("needs_ach_review").alias("metric"), F.lit("").alias("key"), F.col("r").alias("n")))))
    return head.unionByName(by_status.select(F.lit("status").alias("metric"), F.col("status").alias("key"), "n"))


def document_evidence(hypotheses: DataFrame, mentions: DataFrame, docs: DataFrame, text_col: str | None = "text") -> DataFrame:
    """Each mentioned document as evidence for the active hypotheses of its node.

    Tone is computed once per document, before the joins multiply it; `text_col=None` uses the
    title only (S15).  Neutral documents support (S11).
    """
    body = F.col(text_col) if text_col else F.lit("")
    toned = docs.select(F.col("uid").alias("doc_uid"), F.col("published_at").alias("ts"), "title",
                        (evidence_tone("title", body) >= 0).alias("supports"))
    found = mentions.select("doc_uid", "node_id").distinct().join(toned, "doc_uid")
    act = active(hypotheses).select(F.col("id").alias("hypothesis_id"), "node_id")
    return found.join(act, "node_id").select(
        "hypothesis_id", "doc_uid", "ts", "supports", evidence_line("doc_uid", "title").alias("line"))


def unapplied_evidence(hypotheses: DataFrame, mentions: DataFrame, docs: DataFrame, applied: DataFrame, as_of: Column,
                       days: int = 30, newest: int | None = None, text_col: str | None = None) -> DataFrame:
    """Mentions of the last `days` days not yet applied to their hypotheses.

    `newest` limits one reconciliation to a work batch of the newest mentions; None takes all.
    """
    recent = docs.where(F.col("published_at") >= as_of - F.expr(f"INTERVAL {days} DAYS"))
    pairs = mentions.select("doc_uid", "node_id").distinct().join(
        recent.select(F.col("uid").alias("doc_uid"), "published_at"), "doc_uid")
    if newest is not None:
        pairs = pairs.orderBy(F.desc("published_at"), "doc_uid", "node_id").limit(newest)
    fresh = document_evidence(hypotheses, pairs.select("doc_uid", "node_id"), recent, text_col)
    return fresh.join(applied.select("hypothesis_id", "doc_uid"), ["hypothesis_id", "doc_uid"], "left_anti")


def windows_at_risk(hypotheses: DataFrame) -> DataFrame:
    """Confident hypotheses still at an early awareness layer."""
    return active(hypotheses, 0.70).where(F.coalesce("awareness_layer", F.lit(1)) <= 2)


def select_candidates(scores: DataFrame, hypotheses: DataFrame, top_n: int = 10) -> DataFrame:
    """Of the 2n highest scores, those at or above .40, the first n, without an active hypothesis."""
    ranked = scores.where(F.col("srs_score").isNotNull()).orderBy(F.desc("srs_score"), "node_id").limit(2 * top_n)
    chosen = ranked.where(F.col("srs_score") >= MIN_SRS).orderBy(F.desc("srs_score"), "node_id").limit(top_n)
    return chosen.join(active(hypotheses).select("node_id"), "node_id", "left_anti")


def parse_generated(responses: DataFrame) -> DataFrame:
    """Raw `response` per node (node_id, node_name, srs_score) to rows for E1; incomplete ones are dropped."""
    d = responses.withColumn("_doc", greedy_object(F.col("response")))
    listed = string_list(F.try_variant_get("_doc", "$.falsification_criteria", "variant"))
    start = F.coalesce(field(F.col("_doc"), "confidence").try_cast("double"), F.nullif("srs_score", F.lit(0.0)), F.lit(0.5))
    return d.select(
        "node_id", "node_name", F.trim(field(F.col("_doc"), "statement")).alias("statement"),
        listed.alias("_criteria"), F.least(start, F.lit(MAX_START_CONFIDENCE)).alias("confidence"), "srs_score",
    ).where((F.coalesce("statement", F.lit("")) != "") & (F.size("_criteria") >= 2)).withColumn(
        "falsification_criteria", F.slice("_criteria", 1, 3)).drop("_criteria")


def generation_counts(attempted: DataFrame, created: DataFrame) -> DataFrame:
    """Nodes that got a hypothesis and nodes skipped."""
    made = created.select("node_id").distinct().withColumn("_made", F.lit(True))
    return attempted.select("node_id").join(made, "node_id", "left").agg(
        F.count_if(F.col("_made").isNotNull()).alias("generated"), F.count_if(F.col("_made").isNull()).alias("skipped"))
