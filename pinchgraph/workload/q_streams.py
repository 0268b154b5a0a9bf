"""Registered queries of section L: streams over the driver's tables, drained once."""

from __future__ import annotations

from pyspark.sql import functions as F

from pinchgraph.operators import hypotheses as hyp
from pinchgraph.operators import monitor
from pinchgraph.storage import scratch_path
from pinchgraph.streaming import jobs
from pinchgraph.streaming.batches import BatchTable, KeyIndex
from pinchgraph.workload.q_hypotheses import _FOLD
from pinchgraph.workload.q_monitor import _ALERT, HOURS
from pinchgraph.workload.registry import query
from pinchgraph.workload.views import HIGH, LOW, Views, as_of


#: Files that a streamed table lands in.
MICRO_BATCHES = 3


class _Streamed(Views):
    """The views with one table read as a stream."""

    def __init__(self, base: Views, streamed: str, files_per_batch: int = 1):
        super().__init__(base.spark, base.dir)
        self.streamed, self.files_per_batch = streamed, files_per_batch

    def table(self, name):
        static = super().table(name)
        if name != self.streamed:
            return static
        path = scratch_path(self.spark, "landed")  # the table as it lands: several files, one micro-batch each
        static.repartition(MICRO_BATCHES, static.columns[0]).write.parquet(path)
        return self.spark.readStream.schema(static.schema).option("maxFilesPerTrigger", self.files_per_batch).parquet(path)


@query("l1_ingest_stream", "SELECT DISTINCT sha256(text) AS uid, md5(left(text, 8000)) AS text_md5 FROM documents")
def l1(v):
    """Documents named by their text arrive as a stream; copies are stored once."""
    stream = _Streamed(v, "documents").docs.withColumn("uid", F.sha2("text", 256))
    table = BatchTable(v.spark, scratch_path(v.spark, "ingested"), jobs.STORED_DOCUMENT)
    index = KeyIndex(table, "uid", buckets=16, every=2)  # so that the last batch already reads buckets
    jobs.ingest(stream, table, "doc_id", scratch_path(v.spark, "ingest-checkpoint"), available_now=True, index=index).awaitTermination()
    return table.read().select("uid", F.md5("text").alias("text_md5"))


@query("l1_recent_duplicates", "SELECT DISTINCT sha256(text) AS uid FROM documents")
def l1_recent(v):
    """The same with bounded state; the lateness covers the month, so no copy is missed."""
    stream = _Streamed(v, "documents").docs.select(F.sha2("text", 256).alias("uid"), "published_at")
    path = scratch_path(v.spark, "recent")
    jobs.recent_duplicates_dropped(stream, "60 days").select("uid").writeStream.format("parquet").option("path", path).option(
        "checkpointLocation", scratch_path(v.spark, "recent-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return v.spark.read.schema("uid string").parquet(path)


# documents with a vector: the evidence of their automatic mentions, folded
_L2_EVIDENCE = """(SELECT h.id AS hypothesis_id, d.published_at AS ts, m.doc_uid, d.r - d.c >= 0 AS supports FROM (SELECT DISTINCT doc_uid, node_id FROM mentions) m
JOIN (SELECT *, {risk} AS r, {calm} AS c FROM (SELECT *, lower(title || ' ' || {clean}) AS t FROM docs)) d ON d.uid = m.doc_uid
JOIN hyps h ON h.node_id = m.node_id AND h.status = 'active')"""


def _l2_sql():
    from pinchgraph.workload import q_text

    return _FOLD.format(evidence=_L2_EVIDENCE.format(
        risk=q_text._hits(q_text.vocab.RISK_TERMS), calm=q_text._hits(q_text.vocab.MITIGATING_TERMS), clean=q_text._clean("text")))


@query("l2_resolve_stream", _l2_sql(), "mentions docs hyps")
def l2(v):
    """Documents stream in with their vectors; mentions and evidence follow, and the fold gives the confidence."""
    vecs = v.table("embeddings").where("vec_id % 5 <> 0").select(F.concat(F.lit("doc:"), F.col("vec_id").cast("string")).alias("uid"), "embedding")
    stream = _Streamed(v, "documents").docs.join(vecs, "uid")
    mentions = BatchTable(v.spark, scratch_path(v.spark, "mentions"), jobs.MENTION)
    applied = BatchTable(v.spark, scratch_path(v.spark, "applied"), jobs.EVIDENCE)
    jobs.resolve(stream, v.node_vectors, v.hyps, mentions, applied, as_of(), scratch_path(v.spark, "resolve-checkpoint"), HIGH, LOW,
                 available_now=True).awaitTermination()
    return hyp.apply_evidence(v.hyps, applied.read()).select("id", "confidence", "evidence_for", "evidence_against")


@query("l3_alert_stream", _ALERT.format("hits"), "hits")
def l3(v):
    """News streams in; every watched hypothesis with coverage is alerted once.

    One micro-batch, as an alert tells the articles of its batch and SQL knows no batches; tests cover several.
    """
    watched = monitor.watched(v.hyps, v.scored)
    alerts = BatchTable(v.spark, scratch_path(v.spark, "alerts"), jobs.ALERT)
    ledger = BatchTable(v.spark, scratch_path(v.spark, "alert-ledger"), jobs.LEDGER)
    jobs.alert(_Streamed(v, "documents", MICRO_BATCHES).news, watched, alerts, ledger, as_of(), scratch_path(v.spark, "alert-checkpoint"), HOURS,
               available_now=True).awaitTermination()
    return alerts.read()
