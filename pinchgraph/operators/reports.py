"""Report queries over scores, hypotheses, evidence and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pinchgraph.functions.scores import delta_text, round_half_up, stars, stress_band
from pinchgraph.functions.text import days_since, explain_node, node_type, source_class
from pinchgraph.functions.vocab import STRESS_LABELS
from pinchgraph.operators.risk import top_nodes
from pinchgraph.operators.scoring import opportunities


def kpis(scores: DataFrame, hypotheses: DataFrame, as_of: Column) -> DataFrame:
    """Bottlenecks and critical ones among the top 20, new in a week, mean days active."""
    top = top_nodes(scores, 20).agg(F.count(F.lit(1)).alias("bottlenecks"), F.count_if(F.col("srs_score") > 0.8).alias("critical"))
    age = days_since("created_at", as_of)
    h = hypotheses.agg(F.count_if(age <= 7).alias("new_this_week"),
                       F.coalesce(F.avg(F.when(F.col("status") == "active", age)), F.lit(0.0)).alias("avg_days_active"))
    left = top.select("bottlenecks", "critical", F.lit(0).cast("long").alias("new_this_week"), F.lit(0.0).alias("avg_days_active"))
    right = h.select(F.lit(0).cast("long").alias("bottlenecks"), F.lit(0).cast("long").alias("critical"), "new_this_week", "avg_days_active")
    return left.unionByName(right).agg(*[F.sum(c).alias(c) for c in left.columns])


def evidence_rows(evidence: DataFrame, scored: DataFrame) -> DataFrame:
    """Every evidence line with entity, type, severity, source and direction; order by severity for display."""
    s = scored.select(F.col("id").alias("hypothesis_id"), "node_name", "node_id", "ops_final", "created_at")
    return evidence.join(s, "hypothesis_id").select(
        "hypothesis_id", F.coalesce("node_name", F.lit("")).alias("entity"), node_type("node_id").alias("type"),
        round_half_up(F.col("ops_final"), 3).alias("severity"), source_class("line").alias("source"),
        F.when(F.col("supports"), "supports").otherwise("against").alias("direction"),
        F.date_format("created_at", "yyyy-MM-dd").alias("detected_at"), F.col("line").alias("snippet"))


def filter_evidence(rows: DataFrame, entity: str | None = None, sources: list[str] | None = None,
                    direction: str | None = None) -> DataFrame:
    """Optional filters; without sources all are shown."""
    if entity is not None:
        rows = rows.where(F.col("entity") == entity)
    if sources:
        rows = rows.where(F.col("source").isin(sources))
    if direction is not None:
        rows = rows.where(F.col("direction") == direction)
    return rows


def risk_trend(created: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Per day of the window the new rows and the running total, starting from all older rows.

    `created` has column created_at.  Rows are counted per day first, so the running sum is
    over `days`+1 rows.
    """
    age = days_since("created_at", as_of)
    known = created.where(F.col("created_at").isNotNull())
    daily = known.where(age <= days).groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    older = known.where(age > days).agg(F.count(F.lit(1)).alias("baseline"))
    today = F.to_date(as_of)
    spine = older.select("baseline", F.explode(F.sequence(F.date_sub(today, days), today)).alias("day"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    new = F.coalesce("n", F.lit(0))
    return spine.join(daily, "day", "left").select(
        "day", new.alias("new_daily"), (F.col("baseline") + F.sum(new).over(w)).alias("cumulative"))


def briefing(scored: DataFrame, scores: DataFrame) -> DataFrame:
    """Opportunities with the explanation of their node when it is among the top 20."""
    n = top_nodes(scores, 20).select(
        "node_id", explain_node(F.col("name"), F.col("label"), F.coalesce("srs_score", F.lit(0.0)),
                                F.coalesce("betweenness", F.lit(0.0)), F.coalesce("concentration", F.lit(0.0)),
                                F.coalesce("is_articulation_point", F.lit(False))).alias("explanation"))
    return opportunities(scored).join(F.broadcast(n), "node_id", "left").select(  # at most 20 rows
        "id", "node_id", "node_name", "tier", "ops_final", "confidence", "evidence_for_count", "evidence_against_count",
        "ach_reviewed", "explanation")


def ranked_nodes(scores: DataFrame, n: int = 20) -> DataFrame:
    """The top table with positions (a window over n rows)."""
    return top_nodes(scores, n).withColumn(
        "position", F.row_number().over(Window.orderBy(F.desc("srs_score"), "node_id")))


def what_if_changes(comparison: DataFrame, n: int = 20) -> DataFrame:
    """Changes above .001 among the largest."""
    return comparison.where(F.abs("delta") > 0.001).orderBy(F.desc(F.abs("delta")), "node_id").limit(n)


def what_if_top(comparison: DataFrame, n: int = 5) -> DataFrame:
    """The five highest before and after."""
    def side(column: str) -> DataFrame:
        top = comparison.orderBy(F.desc(column), "node_id").limit(n)
        return top.select(F.lit(column).alias("side"), "node_id", F.col(column).alias("srs"),
                          F.row_number().over(Window.orderBy(F.desc(column), "node_id")).alias("position"))

    return side("srs_before").unionByName(side("srs_after"))


def commodity_overview(latest: DataFrame) -> DataFrame:
    """Scored and all rows, mean score, and the top commodity."""
    ok = F.col("supply_stress_score").isNotNull() & ~F.coalesce("parse_error", F.lit(False))
    return latest.agg(
        F.count_if(ok).alias("scored"), F.count(F.lit(1)).alias("total"),
        F.round(F.sum(F.when(ok, F.col("supply_stress_score"))) / F.greatest(F.lit(1), F.count_if(ok)), 2).alias("avg_score"),
        F.min_by("commodity", F.col("rank")).alias("top_commodity"))


def commodity_table(latest: DataFrame, n: int = 20) -> DataFrame:
    """The top table with bands, change text and stars."""
    return latest.where(F.col("rank").isNotNull()).orderBy("rank").limit(n).select(
        "rank", "commodity", "supply_stress_score", stress_band(F.col("supply_stress_score")).alias("band"),
        delta_text(F.col("score_delta")).alias("change"), stars(F.col("confidence")).alias("stars"))


def sub_score_breakdown(rankings: DataFrame) -> DataFrame:
    """The nine sub-scores as labelled rows with their bands; missing counts 0."""
    long = rankings.select("run_date", "commodity", *[
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in STRESS_LABELS]).unpivot(
        ["run_date", "commodity"], list(STRESS_LABELS), "component", "score")
    names = F.create_map(*[F.lit(x) for pair in STRESS_LABELS.items() for x in pair])
    return long.withColumn("label", names[F.col("component")]).withColumn("band", stress_band(F.col("score")))


def system_status(docs: DataFrame, mentions: DataFrame, orphans: DataFrame, hypotheses: DataFrame,
                  reviews: DataFrame) -> DataFrame:
    """Document counts, resolution backlog, hypothesis counts and reviews awaiting approval, as (area, metric, key, n)."""
    from pinchgraph.operators import hypotheses as hyp
    from pinchgraph.sources import documents

    backlog = documents.work_state(docs, mentions, orphans).select(
        F.lit("resolve_backlog").alias("metric"), F.lit("").alias("key"), F.col("resolve_backlog").alias("n"))
    waiting = reviews.agg(F.count_if(F.col("passed") & ~F.col("human_approved")).alias("n")).select(
        F.lit("pending_approval").alias("metric"), F.lit("").alias("key"), "n")
    parts = [("documents", documents.counts(docs)), ("resolution", backlog), ("hypotheses", hyp.counts(hypotheses)),
             ("reviews", waiting)]
    out = None
    for area, df in parts:
        rows = df.select(F.lit(area).alias("area"), "metric", "key", F.col("n").cast("long").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out
