"""The common document table: normalise, dedup insert, status, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinchgraph.model import DOCUMENT, TEXT_CHARS, TITLE_CHARS
from pinchgraph.storage import keep_first


def normalise(docs: DataFrame, as_of: Column) -> DataFrame:
    """A1: missing uid becomes 16 hex digits of the url's SHA-256; missing time becomes `as_of`."""
    return docs.select(
        F.coalesce(F.nullif(F.col("uid"), F.lit("")), F.left(F.sha2("url", 256), F.lit(16))).alias("uid"),
        *[F.col(f.name) for f in DOCUMENT.fields if f.name not in ("uid", "published_at")],
        F.coalesce("published_at", as_of).alias("published_at"),
    )


def dedup_insert(known: DataFrame, incoming: DataFrame, arrival: str) -> DataFrame:
    """A2: the rows of `incoming` to append: unknown uid, first arrival per uid, cut to the stored lengths.

    `arrival` must be unique per row.  The number of rows is the number inserted (S27).
    """
    first = incoming.groupBy("uid").agg(F.min(arrival).alias(arrival))
    fresh = first.join(known.select("uid"), "uid", "left_anti")
    return (
        incoming.join(fresh, ["uid", arrival], "left_semi")
        .withColumn("title", F.left("title", F.lit(TITLE_CHARS)))
        .withColumn("text", F.left("text", F.lit(TEXT_CHARS)))
    )


def dedup_in_order(incoming: DataFrame, arrival: str) -> DataFrame:
    """First row per uid."""
    return keep_first(incoming, ["uid"], [arrival])


def known_only(keys: DataFrame, stored: DataFrame) -> DataFrame:
    """A3: the keys already stored."""
    return keys.join(stored.select("uid"), "uid", "left_semi")


def pending(docs: DataFrame, limit: int = 100) -> DataFrame:
    """A4: oldest pending rows first, at most `limit` (a work batch)."""
    return docs.where(F.col("status") == "pending").orderBy("ingested_at", "uid").limit(limit)


def mark_processed(docs: DataFrame, done: DataFrame) -> DataFrame:
    """A5: snapshot with status `processed` for the uids in `done`."""
    hits = done.select("uid").distinct().withColumn("_hit", F.lit(True))
    return (
        docs.join(hits, "uid", "left")
        .withColumn("status", F.when(F.col("_hit"), F.lit("processed")).otherwise(F.col("status")))
        .drop("_hit")
    )


def counts(docs: DataFrame) -> DataFrame:
    """One row per figure: total, pending, and each source (largest first)."""
    by_source = docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "pending").alias("waiting"))
    # totals come from the per-source rows, so the table is read and shuffled once per branch
    totals = by_source.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
                           F.coalesce(F.sum("waiting"), F.lit(0)).alias("pending"))
    figures = totals.select(F.inline(F.array(
        F.struct(F.lit("total").alias("metric"), F.lit("").alias("key"), F.col("total").alias("n")),
        F.struct(F.lit("pending").alias("metric"), F.lit("").alias("key"), F.col("pending").alias("n")))))
    rows = by_source.select(F.lit("source").alias("metric"), F.col("source").alias("key"), "n")
    return figures.unionByName(rows).orderBy(F.desc("metric"), F.desc("n"), "key")


def work_state(docs: DataFrame, mentions: DataFrame, orphans: DataFrame) -> DataFrame:
    """Stored, still to process, and processed documents not yet resolved either way."""
    resolved = mentions.select(F.col("doc_uid").alias("uid")).union(
        orphans.select(F.col("doc_uid").alias("uid"))).distinct().withColumn("_done", F.lit(True))
    return docs.select("uid", "status").join(resolved, "uid", "left").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_if((F.col("status") == "processed") & F.col("_done").isNull()).alias("resolve_backlog"),
    )
