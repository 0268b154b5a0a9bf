"""What several operators share: session settings for text work and whole-partition Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pinchgraph.session import configure

#: Texts differ in size by five orders of magnitude, so batches are bounded by bytes as well as by rows.
BATCH_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def prepare(spark: SparkSession) -> SparkSession:
    """Set what the jobs rely on at the session they are given."""
    configure(spark)
    for key, value in BATCH_CONF.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8(c: Column) -> Column:
    """The bytes of a text, empty for null."""
    return F.coalesce(c.cast("binary"), F.lit(b""))


def rows_of(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples of the named columns."""
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names))


def batches_of(rows: Iterable[tuple], schema: pa.Schema, at_once: int = 20_000, max_bytes: int = 16 << 20, weigh=None) -> Iterator[pa.RecordBatch]:
    """Arrow batches from tuples; `weigh(row)` gives the bytes of a row where rows are large."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        if weigh:
            size += weigh(row)
        if len(held) >= at_once or size >= max_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def blocks_for(rows: int, per_block: int = 65_536, least: int = 16) -> int:
    """A power of two of hash blocks, so that each holds about `per_block` rows at most."""
    n = least
    while n * per_block < rows:
        n *= 2
    return n


def rank_in_blocks(df: DataFrame, group: list[str], order: list[Column], rows: int, out: str) -> DataFrame:
    """Gapless rank from 0 inside each group, in an order that is fixed but otherwise free.

    A group may hold any share of the rows: its rows are dealt over hash blocks of bounded size,
    ranked inside their block, and blocks are laid one after the other.
    """
    from pyspark.sql import Window

    n = blocks_for(rows)
    dealt = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    inside = Window.partitionBy(*group, "_block").orderBy(*order)
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(*group, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ranked = dealt.withColumn("_inner", F.row_number().over(inside) - 1)
    return ranked.join(offsets, [*group, "_block"]).withColumn(out, (F.col("_start") + F.col("_inner")).cast("long")).drop("_block", "_start", "_inner")
