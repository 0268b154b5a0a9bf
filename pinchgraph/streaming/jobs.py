"""Streaming forms of the periodic jobs (L1-L3); each equals its batch twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pinchgraph.functions.text import clean_text
from pinchgraph.functions.vocab import COVERAGE_LAYER
from pinchgraph.operators import hypotheses, monitor, resolution, vectors
from pinchgraph.sources.documents import dedup_insert
from pinchgraph.storage import bounded_broadcast, keep_first, materialize
from pinchgraph.streaming.batches import BatchKey, BatchTable, KeyIndex, query_id

STORED_DOCUMENT = ("uid string, title string, text string, url string, source string, ias_tier int, "
                   "published_at timestamp, metadata string")
MENTION = "doc_uid string, node_id string, confidence double, method string, resolved_at timestamp"
EVIDENCE = "hypothesis_id string, doc_uid string, ts timestamp, supports boolean, line string"
LEDGER = "hypothesis_id string, layer int, alerted_at timestamp"
ALERT = "hypothesis_id string, n_articles bigint, titles string, sources string, more string"


def recent_duplicates_dropped(stream: DataFrame, lateness: str) -> DataFrame:
    """L1, bounded state: one row per uid within `lateness` of its published_at; later copies need the ledger."""
    return stream.withWatermark("published_at", lateness).dropDuplicatesWithinWatermark(["uid"])


#: "Now" of a job: fixed, or told by each micro-batch.
AsOf = Column | Callable[[DataFrame], Column]


def newest_of(column: str) -> Callable[[DataFrame], Column]:
    """The greatest `column` of a micro-batch as its "now"; a replayed batch has the same rows, so the same "now"."""
    return lambda batch: F.lit(batch.agg(F.max(column)).first()[0]).cast("timestamp")


def _now(as_of: AsOf, batch: DataFrame) -> Column:
    return as_of if isinstance(as_of, Column) else as_of(batch)


def _start(stream: DataFrame, each: Callable[[DataFrame, BatchKey], None], checkpoint: str, available_now: bool) -> StreamingQuery:
    def run(batch: DataFrame, batch_id: int) -> None:
        each(batch, BatchKey(query_id(batch.sparkSession, checkpoint), batch_id))

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def ingest(stream: DataFrame, table: BatchTable, arrival: str, checkpoint: str, available_now: bool = False,
           index: KeyIndex | None = None) -> StreamingQuery:
    """L1: append documents with a uid never stored before (A2 per micro-batch).

    The stored table is the ledger, so the dedup is permanent and no state is kept.  Its uids are looked up by
    hash bucket (`KeyIndex`): a batch reads the buckets of its own uids.  The batch's uids go there while they
    are few, so stored uids are scanned in place and never shuffled.
    """
    index = index or KeyIndex(table, "uid")

    def each(batch: DataFrame, key: BatchKey) -> None:
        index.gather(key)
        here = bounded_broadcast(batch.select("uid").distinct())
        known = index.known(here, key).join(here, "uid", "left_semi")
        table.write(dedup_insert(known, batch, arrival), key)

    return _start(stream, each, checkpoint, available_now)


def resolve(stream: DataFrame, nodes: DataFrame, hyps: DataFrame, mentions: BatchTable, applied: BatchTable, as_of: AsOf,
            checkpoint: str, high: float = resolution.SIMILARITY_HIGH, low: float = resolution.SIMILARITY_LOW,
            available_now: bool = False) -> StreamingQuery:
    """L2: clean, route by vector, store mentions, and append evidence not applied before.

    `stream` has the document columns and `embedding`; of copies in one batch the earliest counts.  Late documents change a fold; the
    confidence is recomputed from the evidence table (E2), never updated in place.
    """
    def each(batch: DataFrame, key: BatchKey) -> None:
        once = keep_first(batch, ["uid"], ["published_at"]).dropDuplicates(["uid"])
        docs = once.withColumn("text", clean_text(F.coalesce(F.nullif("text", F.lit("")), "title", F.lit(""))))
        scored = vectors.top_k_nodes(docs.select(F.col("uid").alias("doc_uid"), "embedding"), nodes, 10)
        found = materialize(resolution.auto_mentions(resolution.route(scored, high, low), _now(as_of, batch), high), "batch-mentions").df
        mentions.write(found.join(mentions.read(before=key).select("doc_uid", "node_id"), ["doc_uid", "node_id"], "left_anti"), key)
        fresh = hypotheses.document_evidence(hyps, found, docs)
        known = applied.read(before=key).select("hypothesis_id", "doc_uid")
        applied.write(fresh.join(known, ["hypothesis_id", "doc_uid"], "left_anti"), key)

    return _start(stream, each, checkpoint, available_now)


def alert(stream: DataFrame, watched: DataFrame, alerts: BatchTable, ledger: BatchTable, as_of: AsOf, checkpoint: str,
          lookback_hours: int = 24, available_now: bool = False) -> StreamingQuery:
    """L3: coverage alerts, once per hypothesis, over the news that arrives (H6 per micro-batch)."""
    def each(batch: DataFrame, key: BatchKey) -> None:
        now = _now(as_of, batch)
        # an alert whose ledger row was lost with its run counts as well
        told = alerts.read(before=key).select("hypothesis_id", F.lit(COVERAGE_LAYER).alias("layer"), now.alias("alerted_at"))
        rows, _ = monitor.monitoring_cycle(watched, batch, ledger.read(before=key).unionByName(told), now, lookback_hours)
        alerts.write(rows, key)
        alerted = alerts.read_batch(key).select(F.col("hypothesis_id").alias("id"))
        ledger.write(monitor.ledger_rows(alerted, COVERAGE_LAYER, now), key)

    return _start(stream, each, checkpoint, available_now)
