"""Shared scratch tables, snapshot merges and ledgers.

Spark ships no lakehouse format here, so an upsert is a new snapshot computed from
the old one; nothing is changed in place.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType


def shared_root(spark: SparkSession) -> str:
    """The folder named in `spark.checkpoint.dir`.

    A local session without the setting gets a fresh temporary folder; on a cluster the
    setting is required, because a driver-local folder is lost with the machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path under the shared root, removed when the session's file system closes."""
    path = f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    for names in _RECORDED:
        names.append(path)
    return path


#: Lists that get the name of every scratch path made meanwhile.
_RECORDED: list[list[str]] = []


@contextmanager
def recorded_scratch() -> Iterator[list[str]]:
    """The scratch paths made inside the block, for `drop_scratch` once what was computed from them is written."""
    names: list[str] = []
    _RECORDED.append(names)
    try:
        yield names
    finally:
        _RECORDED[:] = [held for held in _RECORDED if held is not names]  # equal lists are told apart


def drop_scratch(spark: SparkSession, paths: Sequence[str]) -> None:
    for path in paths:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


@dataclass(frozen=True)
class Step:
    """A written intermediate table with the counters observed while it was written."""

    df: DataFrame
    rows: int
    metrics: dict


def materialize(df: DataFrame, tag: str, **metrics: Column) -> Step:
    """Write `df` to the shared folder and read it back.

    Cuts the lineage of an iterative job so that a lost executor costs one step, and gives
    the optimiser real file sizes.  Row count and extra `metrics` come from the write itself.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    watch = Observation()
    aggregates = [F.count(F.lit(1)).alias("rows")] + [c.alias(n) for n, c in metrics.items()]
    df.observe(watch, *aggregates).write.mode("overwrite").parquet(path)
    seen = watch.get
    return Step(spark.read.schema(df.schema).parquet(path), int(seen.get("rows") or 0), seen)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of an input with fewer splits than cores round-robin over the cores.

    For per-row heavy text work on one or a few files.  An input with enough splits, as any
    large one, is returned unchanged and nothing is shuffled.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: 16 per column and the length of texts and binaries, and of others' JSON."""
    size = F.lit(16 * len(df.columns))
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif kind in ("array", "map", "struct"):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0))
    return size.cast("long")


def bounded_broadcast(df: DataFrame, max_bytes: int = 128 << 20) -> DataFrame:
    """Hint a broadcast only after adding up that the side has at most `max_bytes`.

    Past it the frame is returned unchanged and the join shuffles, with adaptive skew handling.
    The sum runs over all rows, per task first; a `limit` would pull its rows into a single task.
    """
    if (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= max_bytes:
        return F.broadcast(df)
    return df


def _winners(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    if len(order) == 1:  # a plain column stays in the hash aggregate
        return df.groupBy(*keys).agg(pick(order[0]).alias(order[0]))
    best = df.groupBy(*keys).agg(pick(F.struct(*order)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in order])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows holding the first `order` value of their key: one per key when `order` is unique there.

    Winners are found on narrow columns with map-side combine, then picked by a semi join on
    key *and* order, so a key holding a third of the rows is never gathered in one task.
    """
    return df.join(_winners(df, keys, order, F.min), [*keys, *order], "left_semi")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """As `keep_first`, for the last row."""
    return df.join(_winners(df, keys, order, F.max), [*keys, *order], "left_semi")


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Snapshot after inserting `new` rows whose key is absent; `new` must be unique by key."""
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti").select(*old.columns))


def replace_rows(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Snapshot after replacing rows by key; `new` must be unique by key."""
    kept = old.join(new.select(*keys), list(keys), "left_anti")
    return kept.unionByName(new.select(*old.columns))


def _merged_maps(older: Column, newer: Column) -> Column:
    """Both maps' entries; the newer value counts where it is not null, a null map has none."""
    both = F.map_zip_with(older, newer, lambda _, a, b: F.coalesce(b, a))
    return F.coalesce(both, newer, older)


def merge_columns(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """Property-wise upsert: values of `new` win where they are not null, maps are merged key by key.

    Repeated keys in `new` are one row first: the last value by the column `order` counts for each
    property, or the greatest one without an order.  `order` is not stored.
    """
    values = [c for c in old.columns if c not in keys]
    maps = {f.name for f in old.schema.fields if isinstance(f.dataType, MapType)}
    at = F.col(order) if order else F.lit(0)

    def last(c: str) -> Column:
        if c in maps:
            kind = old.schema[c].dataType.simpleString()
            layers = F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.array_sort(F.map_entries(c)).alias("e")))))
            return F.aggregate(layers, F.lit(None).cast(kind), lambda acc, x: _merged_maps(acc, F.map_from_entries(x["e"]).cast(kind)))
        return F.max(F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("v"))))["v"]

    one = new.groupBy(*keys).agg(*[last(c).alias(c) for c in values]) if values else new.select(*keys).distinct()
    joined = old.alias("o").join(one.alias("n"), list(keys), "full_outer")
    merged = [(_merged_maps if c in maps else lambda a, b: F.coalesce(b, a))(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) for c in values]
    return joined.select(*keys, *merged)


def append_run(df: DataFrame, path: str, run_column: str) -> None:
    """Write one run of a versioned table, replacing only the partitions present in `df`."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(run_column)
        .parquet(path)
    )


def running_offsets(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Exclusive running sum of `value` per key, in the order of (`_salt`, `_tie`).

    `df` carries `_salt`, a coarse part of the order with a limited number of values per key,
    and `_tie`, unique within key and salt.  Totals per (key, salt) are accumulated first and
    added to the running sum inside each salt, so a key holding most rows is spread over as
    many tasks as it has salts.
    """
    per_salt = df.groupBy(*keys, "_salt").agg(F.sum(value).alias("_total"))
    across = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_salt.select(*keys, "_salt", F.coalesce(F.sum("_total").over(across), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_salt").orderBy("_tie").rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_before", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(offsets, [*keys, "_salt"])
        .withColumn(out, F.col("_before") + F.col("_offset"))
        .drop("_before", "_offset")
    )
