"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows are dealt over P hash blocks, the input partitions of the exchange.  The matrix says how many
rows each block sends to each shard; it is drawn from the multivariate hypergeometric law, which
is the law of the counts under a uniform permutation.  The draw follows a binary tree over the
blocks: a node's counts per shard are split between its halves, so each level is one narrow
projection over all nodes and P draws run in parallel.  Blocks are then permuted locally, each row
goes to the shard its place falls to, and shards are permuted once more.  All randomness is a hash
of the seed and the row, so a lost task repeats its own draws.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from pinchgraph.llm.common import blocks_for
from pinchgraph.storage import materialize

#: Standard deviations around the mean that a draw covers; what lies beyond has a chance below 1e-18, under the resolution of the uniform number.
SPAN = 9


def uniform(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") / F.lit(float(1 << 53))


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once, also where the body repeats it in a lambda."""
    return F.transform(F.array(value), body)[0]


def hypergeometric(u: Column, good: Column, bad: Column, draws: Column) -> Column:
    """How many of `draws` taken from good + bad are good, by inversion of the law at `u`.

    Weights start at 1 at the low end and follow the ratio of neighbouring terms, so no factorial
    is needed and only their sum scales them.
    """
    total = (good + bad).cast("double")
    mean = F.when(total > 0, draws * good / total).otherwise(0.0)
    spread = F.when(total > 1, F.sqrt(mean * (bad / total) * (total - draws) / (total - 1))).otherwise(0.0)
    lo = F.greatest(F.lit(0).cast("long"), draws - bad, F.floor(mean - SPAN * spread).cast("long") - SPAN)
    hi = F.least(good, draws, F.ceil(mean + SPAN * spread).cast("long") + SPAN)
    given = F.struct(u.alias("u"), good.cast("double").alias("g"), bad.cast("double").alias("b"), draws.cast("double").alias("d"), lo.alias("lo"), F.greatest(lo, hi).alias("hi"))
    start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("k"))

    def step(v: Column, acc: Column, x: Column, below: Column) -> Column:
        grown = acc["sum"] + acc["w"]
        ratio = (v["g"] - x) * (v["d"] - x) / ((x + 1) * (v["b"] - v["d"] + x + 1))
        return F.struct((acc["w"] * ratio).alias("w"), grown.alias("sum"), (acc["k"] + F.when(grown <= below, 1).otherwise(0)).cast("long").alias("k"))

    def place(v: Column) -> Column:
        xs = F.sequence(v["lo"], v["hi"])
        sought = v["u"] * F.aggregate(xs, start, lambda acc, x: step(v, acc, x, F.lit(-1.0)))["sum"]
        passed = let(sought, lambda t: F.aggregate(xs, start, lambda acc, x: step(v, acc, x, t))["k"])
        return F.least(v["hi"], v["lo"] + passed)

    return let(given, place)


def _split(counts: Column, left: Column, shards: int, seed: int, *key: Column) -> Column:
    """How many of each shard's rows lie in the left half, which has `left` rows: one conditional draw per shard."""
    whole = F.aggregate(counts, F.lit(0).cast("long"), lambda acc, x: acc + x)
    start = F.struct(F.array().cast("array<bigint>").alias("out"), whole.alias("rest"), left.alias("open"))

    def draw(acc: Column, s: Column) -> Column:
        here = F.element_at(counts, s + 1)
        got = hypergeometric(uniform(seed, s, *key), here, acc["rest"] - here, acc["open"])
        return let(got, lambda n: F.struct(F.concat(acc["out"], F.array(n)).alias("out"), (acc["rest"] - here).alias("rest"), (acc["open"] - n).alias("open")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(shards - 1)), start, draw)["out"]


def communication_matrix(spark: SparkSession, sizes: DataFrame, depth: int, capacities: list[int], seed: int) -> DataFrame:
    """(block, counts): rows that each of the 2**depth blocks of `sizes(block, n)` sends to each shard.

    Row sums are the block sizes and column sums the capacities, exactly.
    """
    shards = len(capacities)
    nodes = spark.range(1).select(F.col("id").alias("block"), F.array(*[F.lit(c).cast("long") for c in capacities]).alias("counts"))
    for level in range(depth):
        below = depth - level - 1
        half = F.shiftright("block", below)
        left = sizes.where(half.bitwiseAND(F.lit(1)) == 0).groupBy(F.shiftright("block", below + 1).alias("block")).agg(F.sum("n").alias("left"))
        taken = nodes.join(left, "block", "left").withColumn("left", F.coalesce("left", F.lit(0).cast("long")))
        taken = taken.withColumn("taken", _split(F.col("counts"), F.col("left"), shards, seed, F.lit(level), F.col("block")))
        children = F.array(
            F.struct((F.col("block") * 2).alias("block"), F.col("taken").alias("counts")),
            F.struct((F.col("block") * 2 + 1).alias("block"), F.zip_with("counts", "taken", lambda a, b: a - b).alias("counts")),
        )
        nodes = taken.select(F.inline(children))
        if level % 4 == 3 or below == 0:
            nodes = materialize(nodes, "matrix").df
    return nodes


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 11) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row: a uniform random shuffle, shard sizes at most one apart.

    size is the UTF-8 length of the text (null: none) plus 1.  slot counts from 0 without gaps inside
    the shard.  Equal rows get places of their own; rows with null ids are placed like others; no rows
    give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = materialize(narrow, "rows")
    if not rows.rows:
        return rows.df.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    n = blocks_for(rows.rows)
    identity = [F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    key = lambda k: F.xxhash64(F.lit(seed * 1000 + k), *identity)
    dealt = rows.df.withColumn("block", F.pmod(key(1), F.lit(n)))
    sizes = materialize(dealt.groupBy("block").agg(F.count(F.lit(1)).alias("n")), "sizes").df
    even, more = divmod(rows.rows, shards)
    matrix = communication_matrix(spark, sizes, int(math.log2(n)), [even + (s < more) for s in range(shards)], seed)
    upto = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda i: F.aggregate(F.slice("counts", 1, i), F.lit(0).cast("long"), lambda acc, x: acc + x))
    local = Window.partitionBy("block").orderBy(key(2), *identity)
    placed = dealt.withColumn("_place", F.row_number().over(local) - 1).join(matrix.select("block", upto.alias("_upto")), "block")
    sent = placed.select(*identity, F.size(F.filter("_upto", lambda c: c <= F.col("_place"))).alias("shard"), F.pmod(key(3), F.lit(n)).alias("block"))
    sent = materialize(sent, "sent").df
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sent.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("_n")).select("shard", "block", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_start"))
    again = Window.partitionBy("shard", "block").orderBy(key(4), *identity)
    ranked = sent.withColumn("_place", F.row_number().over(again) - 1).join(offsets, ["shard", "block"])
    return ranked.select(*identity, "shard", (F.col("_start") + F.col("_place")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 11) -> None:
    """Write the texts in shard order: one folder per shard, files sorted by slot.

    doc_id must be unique.  A shard is written by several tasks, each a range of slots.
    """
    placed = shard_rows(docs, shards, seed).select("doc_id", "shard", "slot")
    whole = docs.join(placed, "doc_id").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    whole.write.mode("overwrite").partitionBy("shard").parquet(path)
