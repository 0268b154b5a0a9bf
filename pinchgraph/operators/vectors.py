"""Cosine similarity, exact top-k nodes per document, and pooling of chunk vectors."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CANDIDATES = "array<struct<node_id: string, label: string, similarity: double>>"
#: Node vectors up to this many bytes are sent to every executor; more go through the block grid.
MAX_NODE_BYTES = 128 * 1024 * 1024
NODES_PER_BLOCK = 20_000
DOCS_PER_BLOCK = 20_000
#: Scores held at once: 512 x 4,096, 16 MB.
NODES_PER_TILE = 4_096
DOCS_PER_TILE = 512


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 when either vector has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                      lambda acc, x: acc + x)
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot / size)


def mean_pool(chunk_vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Per key the mean of its chunk vectors, scaled to length 1.

    A key with one chunk keeps its vector as it is; a zero mean stays zero.  Positions are
    averaged with map-side combine, so a key with very many chunks is not gathered.
    """
    cells = chunk_vectors.select(key, F.posexplode(vector).alias("_pos", "_x"))
    means = cells.groupBy(key, "_pos").agg(F.avg(F.col("_x").cast("double")).alias("_m"), F.count(F.lit(1)).alias("_n"))
    pooled = means.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_m"))), lambda s: s["_m"]).alias("_v"),
        F.max("_n").alias("_n"))
    length = norm(F.col("_v"))
    scaled = F.when((F.col("_n") > 1) & (length > 0), F.transform("_v", lambda x: x / length)).otherwise(F.col("_v"))
    return pooled.select(key, scaled.alias(vector))


def _unit_rows(column: pa.ListArray) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    rows = flat.reshape(len(column), -1)
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def _merged(rows: np.ndarray, scores: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest scores of each row, best first, ties by position."""
    order = np.lexsort((at, -scores, rows))
    rows, scores, at = rows[order], scores[order], at[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    keep = rank < k
    return rows[keep], scores[keep], at[keep]


def _best(docs: np.ndarray, nodes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, score, position) of the k highest positive scores per row of `docs`, ties by position.

    Nodes come in tiles, so memory does not grow with their number; past the first tiles only scores above the k-th so far are looked at.
    """
    found = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    least = np.zeros(len(docs))
    for start in range(0, len(nodes), NODES_PER_TILE):
        scores = docs @ nodes[start:start + NODES_PER_TILE].T
        hits = scores > least[:, None]
        width = scores.shape[1]
        if width > 4 * k and hits.sum() > 4 * k * len(docs):
            hits &= scores >= np.partition(scores, width - k, axis=1)[:, width - k, None]
        row, at = np.nonzero(hits)
        if not len(row):
            continue
        found = _merged(np.r_[found[0], row], np.r_[found[1], scores[row, at]], np.r_[found[2], at + start], k)
        ends = np.flatnonzero(np.r_[found[0][1:] != found[0][:-1], True])
        full = ends[np.diff(np.r_[-1, ends]) == k]
        least[found[0][full]] = found[1][full]
    return found


def _candidate_column(docs: np.ndarray, nodes: np.ndarray, ids: pa.Array, labels: pa.Array, k: int) -> pa.Array:
    sizes, scores, picked = [np.zeros(1, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
    for start in range(0, len(docs), DOCS_PER_TILE):
        part = docs[start:start + DOCS_PER_TILE]
        row, score, at = _best(part, nodes, k)
        sizes.append(np.bincount(row, minlength=len(part)))
        scores.append(score)
        picked.append(at)
    at = pa.array(np.concatenate(picked))
    rows = pa.StructArray.from_arrays([ids.take(at), labels.take(at), pa.array(np.concatenate(scores))], names=["node_id", "label", "similarity"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)), pa.int32()), rows)


def _strings(column: pa.ChunkedArray) -> pa.Array:
    return column.cast(pa.string()).combine_chunks()


def top_k_nodes(docs: DataFrame, nodes: DataFrame, k: int = 10, key: str = "doc_uid",
                max_node_bytes: int = MAX_NODE_BYTES) -> DataFrame:
    """Adds `candidates`, the k most similar nodes with similarity > 0, best first, ties by node_id.

    `docs` has `key` and `embedding`, `nodes` has node_id, label, embedding, all of one
    dimension.  Exact.  While the node vectors fit `max_node_bytes` they are broadcast and the
    documents are scored where they lie, without a shuffle.  Larger node sets are scored in a
    grid of document blocks x node blocks, and the partial winners (k per block) are merged.
    """
    docs = docs.select(key, "embedding").where(F.col("embedding").isNotNull())
    nodes = nodes.select("node_id", "label", "embedding").where(F.col("embedding").isNotNull())
    shape = nodes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    if not shape["n"]:
        return docs.select(key, F.array().cast(CANDIDATES).alias("candidates"))
    if shape["n"] * shape["dim"] * 8 <= max_node_bytes:
        return _top_k_broadcast(docs, nodes, k, key)
    return _top_k_grid(docs, nodes, k, key, shape["n"])


def _top_k_broadcast(docs: DataFrame, nodes: DataFrame, k: int, key: str) -> DataFrame:
    table = nodes.orderBy("node_id").toArrow()  # bounded by the caller's check
    shared = docs.sparkSession.sparkContext.broadcast((
        _strings(table.column("node_id")), _strings(table.column("label")),
        _unit_rows(table.column("embedding").combine_chunks())))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, matrix = shared.value
        for batch in batches:
            found = _candidate_column(_unit_rows(batch.column(1)), matrix, ids, labels, k) if batch.num_rows else \
                _candidate_column(np.zeros((0, matrix.shape[1])), matrix, ids, labels, k)
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=[key, "candidates"])

    key_type = docs.schema[key].dataType.simpleString()
    return docs.mapInArrow(score, f"{key} {key_type}, candidates {CANDIDATES}")


def _top_k_grid(docs: DataFrame, nodes: DataFrame, k: int, key: str, n_nodes: int) -> DataFrame:
    node_blocks = max(1, ceil(n_nodes / NODES_PER_BLOCK))
    doc_blocks = max(1, ceil(docs.count() / DOCS_PER_BLOCK))
    every_node_block = F.sequence(F.lit(0), F.lit(node_blocks - 1))
    every_doc_block = F.sequence(F.lit(0), F.lit(doc_blocks - 1))
    d = docs.withColumn("_d", F.pmod(F.xxhash64(key), F.lit(doc_blocks)).cast("int")).withColumn(
        "_n", F.explode(every_node_block))
    n = nodes.withColumn("_n", F.pmod(F.xxhash64("node_id"), F.lit(node_blocks)).cast("int")).withColumn(
        "_d", F.explode(every_doc_block))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = pa.list_(pa.struct([("node_id", pa.string()), ("label", pa.string()), ("similarity", pa.float64())]))
        if not left.num_rows or not right.num_rows:
            return pa.table({key: left.column(key).slice(0, 0), "partial": pa.array([], type=kind)})
        right = right.sort_by("node_id")
        found = _candidate_column(
            _unit_rows(left.column("embedding").combine_chunks()), _unit_rows(right.column("embedding").combine_chunks()),
            _strings(right.column("node_id")), _strings(right.column("label")), k)
        return pa.table({key: left.column(key), "partial": found})

    key_type = docs.schema[key].dataType.simpleString()
    partial = d.groupBy("_d", "_n").cogroup(n.groupBy("_d", "_n")).applyInArrow(
        score, f"{key} {key_type}, partial {CANDIDATES}")
    ordered = F.array_sort(
        F.flatten(F.collect_list("partial")),  # at most k per node block
        lambda a, b: F.when(a["similarity"] > b["similarity"], -1).when(a["similarity"] < b["similarity"], 1)
        .when(a["node_id"] < b["node_id"], -1).when(a["node_id"] > b["node_id"], 1).otherwise(0))
    return partial.groupBy(key).agg(F.slice(ordered, 1, k).alias("candidates"))
