"""Clusters of similar vectors: sign-random-projection keys, exact cosine inside buckets, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinchgraph.operators.contraction import components
from pinchgraph.storage import materialize

#: A bucket is meant to hold so many vectors; the number of bits of a key follows from it.
PER_BUCKET = 256
#: Vectors of one side of a comparison; larger buckets are compared tile by tile.
TILE = 2_048


def key_plan(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits, tables): keys of `bits` signs leave about PER_BUCKET vectors per bucket, and with `tables` keys a pair at the threshold shares one with chance `recall`.

    Two vectors at angle a agree in the sign of a random projection with chance 1 - a / pi; pairs above the threshold agree more often.
    """
    bits = max(1, int(log2(max(1, n) / PER_BUCKET))) if n > PER_BUCKET else 0
    if not bits:
        return 0, 1
    agree = (1 - acos(max(-1.0, min(1.0, threshold))) / pi) ** bits
    return bits, max(1, ceil(log(1 - recall) / log(1 - agree)))


def _links_of(u: np.ndarray, v: np.ndarray | None, threshold: float) -> np.ndarray:
    """Component label of each row of u (and then v) under cosines that reach the threshold: the smallest row number."""
    whole = u if v is None else np.concatenate([u, v])
    near = (u @ u.T if v is None else u @ v.T) >= threshold
    if v is not None:
        cross, near = near, np.zeros((len(whole), len(whole)), bool)
        near[: len(u), len(u):] = cross
        near[len(u):, : len(u)] = cross.T
    label = np.arange(len(whole))
    near[label, label] = True
    while True:
        lower = np.where(near, label[None, :], len(whole)).min(1)
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def similar_clusters(vectors: DataFrame, key: str, threshold: float, recall: float = 0.999, seed: int = 5, tile: int = TILE, per_table: tuple[int, int] | None = None) -> DataFrame:
    """(key, cluster): the cluster of each row of `vectors(key, embedding)`, named by its smallest key.

    Rows are linked when the cosine of their vectors is `threshold` or more; clusters are what links connect.  A link between different
    directions is looked at if both share a key of signs (`key_plan`), which misses a pair at the threshold with chance 1 - recall
    and nearer ones less often; what is looked at is compared exactly, in double precision.  Equal directions are one class first,
    so any number of copies costs no comparison, and a bucket of any size is compared in tiles, from which only the links
    that connect are handed on.  A null vector, one without length and one with a null element are clusters of their own.  Keys must be unique
    and not null; all vectors have one dimension.  `per_table` fixes (bits, tables).
    """
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()) & F.exists("embedding", lambda x: x != 0)
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    units = vectors.where(whole & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.transform("embedding", lambda x: x.cast("double") / size).alias("unit"))
    classes = materialize(units.groupBy("unit").agg(F.min("key").alias("rep")), "classes")
    bits, tables = per_table or key_plan(classes.rows, threshold, recall)

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for batch in batches:
            if not batch.num_rows:
                continue
            u = batch.column("unit").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            if planes is None:
                planes = np.random.default_rng(seed).standard_normal((u.shape[1], tables * bits))
            signs = (u @ planes > 0).reshape(len(u), tables, bits) if bits else np.zeros((len(u), tables, 0), bool)
            number = (signs * (1 << np.arange(bits, dtype=np.int64))).sum(2).astype(np.int64) + (np.arange(tables, dtype=np.int64) << bits)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.ListArray.from_arrays(np.arange(len(u) + 1, dtype=np.int32) * tables, number.ravel())], names=["rep", "buckets"])

    kind = classes.df.schema["rep"].dataType.simpleString()
    keyed = materialize(classes.df.select("rep", "unit").mapInArrow(keys, f"rep {kind}, buckets array<bigint>"), "keys").df
    held = keyed.select("rep", F.explode("buckets").alias("bucket"))
    crowds = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    mine = F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, mine).alias("x"), F.greatest(t, mine).alias("y")))
    sent = held.join(crowds, "bucket").select("bucket", "rep", mine.alias("tile"), F.explode(others).alias("t"))
    rows = sent.join(classes.df, "rep").select("bucket", "t.x", "t.y", "tile", "rep", "unit")

    def compare(group: tuple, table: pa.Table) -> pa.Table:
        x, y = group[1].as_py(), group[2].as_py()
        unit = table.column("unit").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        tiles = table.column("tile").to_numpy()
        order = np.argsort(tiles, kind="stable")
        split = int((tiles == x).sum())
        label = _links_of(unit[order][:split], unit[order][split:] if x != y else None, threshold)
        moved = np.flatnonzero(label != np.arange(len(label)))
        reps = table.column("rep").combine_chunks()
        return pa.table([reps.take(pa.array(order[label[moved]])), reps.take(pa.array(order[moved]))], names=["a", "b"])

    links = rows.groupBy("bucket", "x", "y").applyInArrow(compare, f"a {kind}, b {kind}").distinct()
    roots = components(links, "a", "b").select(F.col("node").alias("rep"), "root")
    named = classes.df.join(roots, "rep", "left").select("unit", F.coalesce("root", "rep").alias("cluster"))
    found = units.join(named, "unit").select(F.col("key").alias(key), "cluster")
    return vectors.where(F.col(key).isNotNull()).select(key).join(found, key, "left").select(key, F.coalesce("cluster", key).alias("cluster"))
