"""Exact duplicates with a heavy-hitter split.

A Misra-Gries summary of the digests names every digest that many rows share.  Its candidates are
recounted exactly, and the verified ones travel to the rows as a small broadcast table, so rows of a
heavy text are decided where they lie and never meet in one task.  All other digests take an ordinary
shuffle of narrow rows.  Texts are read once; only ids and digests move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinchgraph.storage import materialize

#: Counters of a summary.  Spark's frequent-item sketch is Misra-Gries with the median of the counters taken off
#: when it is full; it holds at least 4/3 of the counters as slots, rounded up to a power of two, here 8,192,
#: and is wrong by 3.5 / 8,192 of the rows at most, so each digest in more than a thousandth of the rows is found.
COUNTERS = 4_096
#: Summaries merged into one per level: 2**8.
FAN_IN_BITS = 8
#: Levels until one summary is left, for up to 2**24 input partitions.
LEVELS = 3
#: A digest is heavy if this many rows share it; rarer candidates gain nothing from the broadcast.
LEAST_HEAVY = 3


def normalised(text: Column) -> Column:
    """The text with each run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text in lowercase hex."""
    return F.sha2(normalised(text).cast("binary"), 256)


def frequent(keyed: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest): at most `counters` candidates, among them each digest in more than 7 / (2 * counters) of the rows.

    One summary per input partition of `keyed(digest, row)`, merged along a tree of fan-in 256, so no task
    merges more than 256 summaries of at most `counters` entries.
    """
    block = F.shiftright("row", 33).cast("int")  # the partition in which the row was numbered
    level = keyed.groupBy(block.alias("block")).agg(F.expr(f"approx_top_k_accumulate(digest, {counters})").alias("summary"))
    for _ in range(LEVELS):
        level = level.groupBy(F.shiftright("block", FAN_IN_BITS).alias("block")).agg(F.expr(f"approx_top_k_combine(summary, {counters})").alias("summary"))
    top = level.select(F.expr(f"approx_top_k_estimate(summary, {counters})").alias("top"))
    return top.select(F.explode("top").alias("t")).select(F.col("t.item").alias("digest"))


def _winners(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_row, group_size), merged before the shuffle.  Null ids come last."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    return rows.groupBy("digest").agg(first.alias("f"), F.count(F.lit(1)).alias("group_size")).select(
        "digest", F.col("f.doc_id").alias("keep_id"), F.col("f.row").alias("keep_row"), "group_size")


def exact_groups(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of `docs(doc_id, text)`.

    Texts are equal when they are identical after each run of white space became one space; a null text
    counts as empty, so null and empty texts are copies.  Of a group the row with the smallest id stays;
    a null id comes after all others; of repeated rows with that id one stays, whichever was read first.
    No rows give no rows; other columns are ignored.
    """
    keyed = materialize(docs.select("doc_id", digest(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")
    rows = keyed.df
    candidates = frequent(rows, counters)  # at most `counters` rows
    heavy = materialize(_winners(rows.join(F.broadcast(candidates), "digest", "left_semi")).where(F.col("group_size") >= LEAST_HEAVY), "heavy").df
    here = rows.join(F.broadcast(heavy), "digest").select(*rows.columns, "keep_id", "keep_row", "group_size")
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    there = rest.join(_winners(rest), "digest").select(*rows.columns, "keep_id", "keep_row", "group_size")
    return here.unionByName(there).select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("digest").alias("text_sha256"))


def without_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of `docs` that stay, with all their columns.

    Copies of a heavy text fall out where they lie.  Of repeated rows with the id that stays, one stays.
    """
    groups = materialize(exact_groups(docs, counters), "groups").df
    stay = groups.where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_digest"))
    repeated = groups.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_digest")).count().where("count > 1")
    marked = docs.withColumn("_digest_of", digest(F.col("text")))
    same = (F.col("_digest_of") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    once = marked.join(stay.join(repeated, ["_id", "_digest"], "left_anti"), same, "left_semi")
    twice = marked.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "_digest_of"])
    return once.unionByName(twice).drop("_digest_of")
