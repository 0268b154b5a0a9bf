"""Opportunity score, tier and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinchgraph.functions.scores import asymmetry, or_default, recency, round_half_up, tier


def score(hypotheses: DataFrame, reviews: DataFrame, as_of: Column) -> DataFrame:
    """Every hypothesis with its score parts, `ops_raw`, `ops_final` and tier.

    `hypotheses` carries counts `n_criteria`, `evidence_for`, `evidence_against`; `reviews` has
    hypothesis_id and robustness (missing review counts 1).
    """
    srs = or_default(F.col("srs_score_at_creation"), 0.5)
    layer = F.coalesce(F.nullif("awareness_layer", F.lit(0)), F.lit(1))
    confidence = or_default(F.col("confidence"), 0.5)
    specificity = F.least(F.coalesce("n_criteria", F.lit(0)) / 3.0, F.lit(1.0))
    n_for, n_against = F.coalesce("evidence_for", F.lit(0)), F.coalesce("evidence_against", F.lit(0))
    validation = n_for / F.greatest(F.lit(1), n_for + n_against)
    fresh = recency(F.coalesce("updated_at", "created_at"), as_of)
    gap = asymmetry(layer)
    parts = hypotheses.join(reviews.select(F.col("hypothesis_id").alias("id"), "robustness"), "id", "left").select(
        "id", "node_id", "node_name", "statement", "status", "created_at", "updated_at", "n_criteria",
        F.coalesce("ach_reviewed", F.lit(False)).alias("ach_reviewed"), n_for.alias("evidence_for_count"),
        n_against.alias("evidence_against_count"), confidence.alias("_c"), layer.alias("awareness_layer"), srs.alias("_s"),
        gap.alias("_g"), specificity.alias("_p"), validation.alias("_v"), fresh.alias("_r"),
        F.coalesce("robustness", F.lit(1.0)).alias("_b"))
    raw = (F.col("_s") * F.col("_g") * 0.40 + F.col("_p") * 0.20 + F.col("_c") * 0.15 + F.col("_v") * 0.15
           + F.col("_r") * 0.10)
    totals = parts.withColumn("_raw", raw).withColumn("_ops", F.col("_raw") * F.col("_b"))
    return totals.select(
        "id", "node_id", "node_name", "statement", round_half_up(F.col("_c"), 3).alias("confidence"), "awareness_layer",
        round_half_up(F.col("_s"), 3).alias("srs_score"), round_half_up(F.col("_g"), 3).alias("ias"), round_half_up(F.col("_p"), 3).alias("specificity"),
        round_half_up(F.col("_v"), 3).alias("validation"), round_half_up(F.col("_r"), 3).alias("recency"), round_half_up(F.col("_b"), 3).alias("robustness_ach"),
        round_half_up(F.col("_raw"), 4).alias("ops_raw"), round_half_up(F.col("_ops"), 4).alias("ops_final"), tier(F.col("_ops")).alias("tier"),
        "ach_reviewed", "evidence_for_count", "evidence_against_count", "n_criteria", "status", "created_at", "updated_at")


def opportunities(scored: DataFrame, min_tier: int = 3) -> DataFrame:
    """G6 without the display order: active rows up to a tier."""
    return scored.where((F.col("status") == "active") & (F.col("tier") <= min_tier))


def ranked(scored: DataFrame, min_tier: int = 3) -> DataFrame:
    """Highest score first, ties by id (a range-partitioned sort)."""
    return opportunities(scored, min_tier).orderBy(F.desc("ops_final"), "id")


def summary(scored: DataFrame) -> DataFrame:
    """Rows per tier and the top row (ties by id), in one aggregation."""
    lowest_first = F.struct((-F.col("ops_final")).alias("neg"), "id")
    return opportunities(scored).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("tier") == t).alias(f"tier{t}") for t in (1, 2, 3)],
        F.min(lowest_first).alias("_top")).select(
        "total", "tier1", "tier2", "tier3", F.col("_top.id").alias("top_id"), (-F.col("_top.neg")).alias("top_ops"))
