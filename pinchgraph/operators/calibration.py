"""Calibration, evidence quality, concentration and orphan review (K1-K5).

The system studied states these in prose only; the definitions here are this library's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pinchgraph.operators.similarity import similar_clusters

#: Shares of the three largest that warn, and that mark a chokepoint.
CR3_WARNING, CR3_CHOKEPOINT = 0.70, 0.90
#: Cosine from which two orphans count as one topic.
TOPIC_SIMILARITY = 0.85
#: Weight of a source that is not listed for a domain.
UNLISTED_WEIGHT = 0.5


def brier_by_month(log: DataFrame, as_of: Column) -> DataFrame:
    """K1: (month, n, brier) of `log(confidence_at_log, predicted_recognition_date, actual_recognition_date)`.

    The outcome is 1 when recognition came by the predicted date, else 0; a prediction whose date has not
    come and that is not recognised yet is left out.  The month is that of the predicted date.
    """
    actual, predicted = F.col("actual_recognition_date"), F.col("predicted_recognition_date")
    outcome = F.when(actual <= predicted, 1.0).when(predicted < as_of, 0.0)
    known = log.select(F.date_trunc("month", predicted).cast("date").alias("month"), (F.col("confidence_at_log") - outcome).alias("_miss"))
    return known.where("_miss is not null").groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("_miss") * F.col("_miss")).alias("brier"))


def correlated_weights(evidence: DataFrame) -> DataFrame:
    """K2: `evidence(node_id, url, published_at, ...)` with `event_key` and `weight`.

    One event is one source domain on one day; its weight at each of the n nodes it reaches is 1/n.  A row
    without domain or date is an event of its own, with weight 1.
    """
    domain = F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:www\.)?([^/:?#]+)", 1)
    key = F.when((domain != "") & F.col("published_at").isNotNull(), F.xxhash64(domain, F.to_date("published_at")))
    keyed = evidence.withColumn("event_key", key)
    nodes = keyed.where("event_key is not null").select("event_key", "node_id").distinct().groupBy("event_key").agg(F.count(F.lit(1)).alias("_n"))
    return keyed.join(nodes, "event_key", "left").withColumn("weight", F.coalesce(1.0 / F.col("_n"), F.lit(1.0))).drop("_n")


def source_weights(evidence: DataFrame, weights: DataFrame, unlisted: float = UNLISTED_WEIGHT) -> DataFrame:
    """K3: `evidence(source, domain, ...)` with the `source_weight` of its source in its domain, from `weights(source, domain, weight)`."""
    listed = weights.groupBy("source", "domain").agg(F.max("weight").alias("source_weight"))
    return evidence.join(listed, ["source", "domain"], "left").withColumn("source_weight", F.coalesce("source_weight", F.lit(unlisted)))


def concentration_ratio(supply: DataFrame) -> DataFrame:
    """K4: (item, suppliers, cr3, level) of `supply(item, supplier, amount)`: the share of the three largest suppliers.

    Amounts of a supplier are added up; level is chokepoint, warning or none.  An item whose amounts add up to 0 has a null ratio.
    """
    per = supply.groupBy("item", "supplier").agg(F.sum("amount").alias("amount"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("amount"), "supplier"))
    top = per.withColumn("_r", rank).where("_r <= 3").groupBy("item").agg(F.sum("amount").alias("_top"))
    total = per.groupBy("item").agg(F.sum("amount").alias("_all"), F.count(F.lit(1)).alias("suppliers"))
    ratio = F.when(F.col("_all") != 0, F.col("_top") / F.col("_all"))
    level = F.when(F.col("cr3") >= CR3_CHOKEPOINT, "chokepoint").when(F.col("cr3") >= CR3_WARNING, "warning").otherwise("none")
    return total.join(top, "item").select("item", "suppliers", ratio.alias("cr3")).withColumn("level", level)


def orphan_clusters(orphans: DataFrame) -> DataFrame:
    """K5: pending orphans of a week by their nearest node: (week, best_node, n, mean_similarity, oldest_uid), for review.

    Orphans that no node is near to form one cluster a week, with a null node.
    """
    pending = orphans.where("status = 'pending'").withColumn("week", F.date_trunc("week", "created_at").cast("date"))
    return pending.groupBy("week", "best_node").agg(
        F.count(F.lit(1)).alias("n"), F.avg("best_similarity").alias("mean_similarity"), F.min(F.struct("created_at", "uid"))["uid"].alias("oldest_uid"))


def orphan_topics(orphans: DataFrame, threshold: float = TOPIC_SIMILARITY, recall: float = 0.999) -> DataFrame:
    """K5: clusters of pending orphans by the likeness of their own vectors, for the weekly review of topics that no node covers.

    (cluster, n, nodes, oldest_uid, first_seen, last_seen): `orphans(uid, status, created_at, best_node, embedding)` in clusters of
    two or more (`similarity.similar_clusters`), named by their smallest uid; `nodes` counts the different nearest nodes.
    """
    pending = orphans.where("status = 'pending'")
    clusters = similar_clusters(pending.select("uid", "embedding"), "uid", threshold, recall)
    return pending.join(clusters, "uid").groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("best_node").alias("nodes"), F.min(F.struct("created_at", "uid"))["uid"].alias("oldest_uid"),
        F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen")).where("n > 1")
