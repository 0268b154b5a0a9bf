"""Prefix trie of conversations with subtree totals by centroid decomposition.

Conversations are sequences of turns.  A prefix is known by its length and a sum of 120 bits of hashes
of (place, turn), so prefixes of any length come from running sums and no sequence is ever gathered.
A node is named by its smallest conversation and its depth; the path of that conversation therefore lists
all ancestors of the node, and one join tells on which side of another node it lies.

Totals over subtrees are rolled up by centroid decomposition of the parent edges.  Each round takes the
centroid of every component, adds up the component's weights below it, adds that total along the path from
the centroid to the component's top, and splits the component there, so the rounds are logarithmic however
deep the trie is.  Balance is by turns: a node weighs as many turns as conversations pass through it, and then
the weight below a node is a plain sum over its conversations.  Components that are small enough are
finished whole inside a task, in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pinchgraph.llm.common import rows_of
from pinchgraph.storage import bounded_broadcast, materialize

#: Every FAMILY-th conversation lends its first turns to those after it.
FAMILY = 20
#: Turns per salt of a conversation: 2**12.
SALT_BITS = 12
#: Components with more nodes are split by rounds, others inside a task.
SMALL = 32_768
#: Nodes with this share of all turns or more are few and reach the turns by broadcast.
HOT_SHARE = 1 / 10_000


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, item, words): the turns of each conversation numbered from 0, ordered by turn, nulls first.

    Equal turn numbers are ordered by the digest of role and text.  A conversation may hold any share of the
    rows: its turns are dealt over ranges and numbered inside each.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    item = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn"), item.alias("item"), F.monotonically_increasing_id().alias("row")).alias("at"), words.alias("words"))
    rows = materialize(rows, "turns").df
    ranged = materialize(rows.repartitionByRange("conv_id", "at").withColumn("salt", F.spark_partition_id()), "ranged").df
    before = Window.partitionBy("conv_id").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("conv_id", "salt").agg(F.count(F.lit(1)).alias("n")).select("conv_id", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "salt").orderBy("at")) - 1
    return ranged.withColumn("inside", inside).join(starts, ["conv_id", "salt"]).select(
        "conv_id", (F.col("start") + F.col("inside")).cast("long").alias("place"), F.col("at.item").alias("item"), "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, item, words) with depth from 1, and (conv_id, length): each conversation with borrowed first turns.

    Conversation c takes the first h turns of c - c % FAMILY, all if it has fewer, and then its own after its first h,
    with h = crc32(c) % 4.
    """
    lent = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4))
    lender = F.col("conv_id") - F.col("conv_id") % FAMILY
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).select("conv_id", "own", lent.alias("h"), lender.alias("lender"))
    convs = materialize(convs, "convs").df
    known = convs.select(F.col("conv_id").alias("lender"), F.col("own").alias("has"))
    convs = convs.join(known, "lender", "left").withColumn("taken", F.least("h", F.coalesce("has", F.lit(0).cast("long"))))
    convs = materialize(convs.withColumn("length", F.col("taken") + F.greatest(F.lit(0), F.col("own") - F.col("h"))), "families").df
    # at most 3 turns of a lender, for at most FAMILY conversations
    heads = turns.where("place < 3").select(F.col("conv_id").alias("lender"), "place", "item", "words")
    first = convs.join(heads, "lender").where(F.col("place") < F.col("taken")).select("conv_id", (F.col("place") + 1).alias("depth"), "item", "words")
    shift = convs.select("conv_id", "h", "taken")
    own = turns.where("place >= 0").join(shift, "conv_id").where(F.col("place") >= F.col("h")).select(
        "conv_id", (F.col("place") - F.col("h") + F.col("taken") + 1).alias("depth"), "item", "words")
    return first.unionByName(own), convs.select("conv_id", "length")


def prefixes(turns: DataFrame) -> DataFrame:
    """`turns` with (h1, h2), 60 bits each: the prefix that ends there, as a running sum of hashes of (depth, item)."""
    mixed = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), "item").cast("binary"), 256)
    part = lambda at: F.conv(F.substring(mixed, at, 15), 16, 10).cast("decimal(38,0)")
    salted = turns.select("conv_id", "depth", "words", F.shiftright("depth", SALT_BITS).alias("salt"), part(1).alias("p1"), part(16).alias("p2"))
    salted = materialize(salted, "hashed").df
    inside = Window.partitionBy("conv_id", "salt").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(38,0)")
    sums = salted.groupBy("conv_id", "salt").agg(F.sum("p1").cast("decimal(38,0)").alias("s1"), F.sum("p2").cast("decimal(38,0)").alias("s2"))
    sums = sums.select("conv_id", "salt", *[F.coalesce(F.sum(f"s{i}").over(before), zero).alias(f"b{i}") for i in (1, 2)])
    run = salted.select("*", F.sum("p1").over(inside).alias("r1"), F.sum("p2").over(inside).alias("r2")).join(sums, ["conv_id", "salt"])
    low = lambda i: F.pmod((F.col(f"r{i}") + F.col(f"b{i}")).cast("decimal(38,0)"), F.lit(1 << 60).cast("decimal(38,0)")).cast("long")
    return run.select("conv_id", "depth", "words", low(1).alias("h1"), low(2).alias("h2"))


def _owners(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, owner) of every rebuilt turn and of depth 0, and the nodes (owner, depth, n_convs, weight, words).

    `weight` is the number of turns below the node and at it, over all its conversations.
    """
    step = materialize(turns.join(convs, "conv_id"), "prefixes")
    key = ["depth", "h1", "h2"]
    nodes = step.df.groupBy(*key).agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"),
                                      F.sum(F.col("length") - F.col("depth") + 1).alias("weight"), F.max("words").alias("words"))
    nodes = materialize(nodes, "nodes").df
    hot = nodes.where(F.col("n_convs") > max(1, int(step.rows * HOT_SHARE)))  # at most 1 / HOT_SHARE nodes, since their conversations add up to all turns
    narrow = lambda df: df.select(*key, "owner")
    by_hot = step.df.join(F.broadcast(narrow(hot)), key, "left")
    rest = by_hot.where("owner is null").drop("owner").join(narrow(nodes), key)
    path = by_hot.where("owner is not null").select("conv_id", "depth", "owner").unionByName(rest.select("conv_id", "depth", "owner"))
    root = convs.agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("length") + 1).alias("weight")).where("n_convs > 0")
    path = path.unionByName(convs.select("conv_id", F.lit(0).cast("long").alias("depth")).crossJoin(F.broadcast(root.select("owner"))))  # one row
    top = root.select("owner", F.lit(0).cast("long").alias("depth"), "n_convs", "weight", F.lit(0).cast("long").alias("words"))
    return materialize(path, "paths").df, nodes.select("owner", "depth", "n_convs", "weight", "words").unionByName(top)


def _blocks_of(start: Column, end: Column) -> Column:
    """The salts that the depths start..end fall into."""
    return F.sequence(F.shiftright(start, SALT_BITS), F.shiftright(end, SALT_BITS))


def _round(pieces: DataFrame, large: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One centroid in each component of `large`: the pieces that are left, and (owner, depth, leaves, saved) to be added.

    `pieces` has owner, depth, weight (what is left below the node in its component), leaves and saved (the node's own), and the top of its
    component as top_owner, top_depth.
    """
    top = ["top_owner", "top_depth"]
    open_ = pieces.join(bounded_broadcast(large.select(*top, "total")), top)
    centroids = open_.where(2 * F.col("weight") >= F.col("total")).groupBy(*top).agg(F.max(F.struct("depth", "owner", "weight")).alias("x"))
    centroids = materialize(centroids.select(*top, F.col("x.owner").alias("x_owner"), F.col("x.depth").alias("x_depth"), F.col("x.weight").alias("x_weight")), "centroids").df
    few = bounded_broadcast(centroids)
    # where each conversation's part of a component lies: a row per component, conversation and salt
    marked = open_.join(few, top).withColumn("salt", F.shiftright("depth", SALT_BITS))
    runs = marked.groupBy(*top, "owner", "salt", "x_owner", "x_depth").agg(F.max("depth").alias("deepest")).where(F.col("deepest") >= F.col("x_depth"))
    asked = runs.select(*top, F.col("owner").alias("conv_id"), "salt", "x_owner", "x_depth", F.explode(F.array(F.col("x_depth"), F.col("x_depth") + 1)).alias("depth"))
    answers = asked.join(paths.withColumnRenamed("owner", "met"), ["conv_id", "depth"]).groupBy(*top, F.col("conv_id").alias("owner"), "salt").agg(
        F.max(F.when((F.col("depth") == F.col("x_depth")) & (F.col("met") == F.col("x_owner")), 1)).alias("under"),
        F.max(F.when(F.col("depth") > F.col("x_depth"), F.col("met"))).alias("child"))
    sides = marked.join(answers, [*top, "owner", "salt"], "left").withColumn("below", (F.coalesce("under", F.lit(0)) == 1) & (F.col("depth") >= F.col("x_depth")))
    sides = materialize(sides, "sides").df
    sums = sides.where("below").groupBy(*top).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    totals = materialize(centroids.join(sums, top), "totals").df
    # the way from the centroid to the top of its component, itself included
    ways = totals.withColumn("salt", F.explode(_blocks_of(F.col("top_depth"), F.col("x_depth"))))
    on_way = paths.withColumn("salt", F.shiftright("depth", SALT_BITS)).join(ways, (F.col("conv_id") == F.col("x_owner")) & (paths["depth"] >= F.col("top_depth")) & (paths["depth"] <= F.col("x_depth")) & (F.shiftright(paths["depth"], SALT_BITS) == ways["salt"]))
    added = materialize(on_way.select("owner", "depth", "leaves", "saved", "x_weight"), "added").df
    is_x = (F.col("owner") == F.col("x_owner")) & (F.col("depth") == F.col("x_depth"))
    moved = F.col("below") & (F.col("depth") > F.col("x_depth"))
    left = sides.where(~is_x).join(added.select("owner", "depth", F.col("x_weight").alias("lost")), ["owner", "depth"], "left").select(
        "owner", "depth", "parent", (F.col("weight") - F.coalesce("lost", F.lit(0).cast("long"))).alias("weight"), "leaves", "saved",
        F.when(moved, F.col("child")).otherwise(F.col("top_owner")).alias("top_owner"), F.when(moved, F.col("x_depth") + 1).otherwise(F.col("top_depth")).alias("top_depth"))
    return materialize(left, "pieces").df, added.select("owner", "depth", "leaves", "saved")


def decompose(parent: np.ndarray, weight: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Subtree sums of `values` over a tree in arrays: parents come before children, the top has parent -1.

    Splits at centroids by `weight` until nothing is left; the sum below a centroid goes to all nodes on its way to the top.
    """
    out = [np.zeros(len(parent), np.int64) for _ in values]
    if len(parent) == 1:
        for o, v in zip(out, values):
            o += v
        return out
    up, own, plain = parent.tolist(), weight.tolist(), [v.tolist() for v in values]
    side = [0] * len(parent)  # component of each node
    stack, names = [(0, list(range(len(parent))))], 1
    below = [0] * len(parent)
    while stack:
        name, members = stack.pop()
        for v in members:
            below[v] = own[v]
        top = members[0]
        for v in reversed(members):
            if v != top:
                below[up[v]] += below[v]
        half, x = below[top], top
        for v in members:  # the last one in this order is the deepest: nodes of at least half lie on one way
            if 2 * below[v] >= half:
                x = v
        fresh: dict[int, list[int]] = {}
        upper, totals = [], [p[x] for p in plain]
        for v in members:
            if v == x:
                side[v] = -1
                continue
            p = up[v]
            if v != top and p == x:
                side[v] = names
                fresh[names] = [v]
                names += 1
            elif v != top and side[p] in fresh:
                side[v] = side[p]
                fresh[side[p]].append(v)
            else:
                upper.append(v)
                continue
            for k, q in enumerate(plain):
                totals[k] += q[v]
        at = x
        while True:
            for o, t in zip(out, totals):
                o[at] += t
            if at == top:
                break
            at = up[at]
        if upper:
            stack.append((name, upper))
        stack.extend(fresh.items())
    return out


def _finish(pieces: DataFrame) -> DataFrame:
    """(owner, depth, leaves, saved): subtree sums inside components that fit a task."""
    out = pa.schema([("owner", pa.int64()), ("depth", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64())])
    columns = ("top_owner", "top_depth", "owner", "depth", "parent", "weight", "leaves", "saved")

    def roll(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, done = [], None, []
        for row in rows_of(batches, *columns):
            if row[:2] != now:
                done += close(held)
                if len(done) > 50_000:
                    yield batch_of(done)
                    done = []
                held, now = [], row[:2]
            held.append(row[2:])
        done += close(held)
        if done:
            yield batch_of(done)

    def close(held: list) -> list:
        if not held:
            return []
        at = {(owner, depth): i for i, (owner, depth, *_) in enumerate(held)}
        parent = np.array([at.get((p, depth - 1), -1) if i else -1 for i, (_, depth, p, *_) in enumerate(held)], np.int64)
        # the weight of a node itself, from what is left below it
        weight = np.array([r[3] for r in held], np.int64)
        own = weight.copy()
        np.subtract.at(own, parent[1:], weight[1:])
        leaves, saved = decompose(parent, own, np.array([r[4] for r in held], np.int64), np.array([r[5] for r in held], np.int64))
        return [(r[0], r[1], a, b) for r, a, b in zip(held, leaves.tolist(), saved.tolist())]

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=out)

    ordered = pieces.select(*columns).repartition("top_owner", "top_depth").sortWithinPartitions("top_owner", "top_depth", "depth")
    return ordered.mapInArrow(roll, "owner long, depth long, leaves long, saved long")


def subtree_sums(nodes: DataFrame, paths: DataFrame, small: int = SMALL) -> DataFrame:
    """(owner, depth, n_leaves, saved_tokens) from `nodes(owner, depth, parent, weight, leaves, saved)`."""
    top = nodes.where("depth = 0").select(F.col("owner").alias("top_owner"), F.col("depth").alias("top_depth"))
    pieces = nodes.crossJoin(F.broadcast(top))  # one row
    parts = []
    while True:
        comps = pieces.groupBy("top_owner", "top_depth").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("total"))
        step = materialize(comps, "components", large=F.count_if(F.col("n") > small))
        if not step.metrics.get("large"):
            break
        large = step.df.where(F.col("n") > small)
        done = pieces.join(bounded_broadcast(large.select("top_owner", "top_depth")), ["top_owner", "top_depth"], "left_anti")
        parts.append(materialize(_finish(done), "finished").df)
        pieces, added = _round(pieces, large, paths)
        parts.append(added)
    parts.append(_finish(pieces))
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return every.groupBy("owner", "depth").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def _end_hashes(convs: DataFrame, paths: DataFrame) -> DataFrame:
    """(owner, depth, ends_sha256) of nodes where conversations end: the digest of their ids in order, comma-joined.

    Ids of 4,096 numbers in a row are joined first; a digest then runs over a node's joined strings as they
    stream by, one string in memory at a time.
    """
    ends = paths.join(convs.select("conv_id", F.col("length").alias("depth")), ["conv_id", "depth"])
    strings = ends.groupBy("owner", "depth", F.shiftright("conv_id", 12).alias("block")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    out = pa.schema([("owner", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now, digest = [], None, None
        for owner, depth, ids in rows_of(batches, "owner", "depth", "ids"):
            if (owner, depth) != now:
                if digest:
                    done.append((*now, digest.hexdigest()))
                now, digest = (owner, depth), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
            if len(done) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), out)], schema=out)
                done = []
        if digest:
            done.append((*now, digest.hexdigest()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), out)], schema=out)

    return strings.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "block").mapInArrow(run, "owner long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, small: int = SMALL) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for every node.

    Null role and text are empty, a null turn comes first, equal turn numbers are ordered by a digest of role and text, so
    repeated rows are turns of their own.  Rows without a conv_id belong to no conversation and are left out.
    No conversations give no rows, not even a root.  Other columns are ignored.
    """
    turns = materialize(turns_of(conversations.select("conv_id", "turn", "role", "text")), "placed").df
    rows, convs = rebuilt(turns)
    paths, nodes = _owners(prefixes(rows), convs)
    above = paths.select(F.col("conv_id").alias("owner"), (F.col("depth") + 1).alias("depth"), F.col("owner").alias("parent"))
    nodes = materialize(nodes.join(above, ["owner", "depth"], "left"), "edges").df
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("owner"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, ["owner", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = nodes.withColumn("leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words"))
    nodes = materialize(nodes, "trie").df
    sums = materialize(subtree_sums(nodes.select("owner", "depth", "parent", "weight", "leaves", "saved"), paths, small), "sums").df
    ends = materialize(_end_hashes(convs, paths), "ends").df
    return nodes.join(sums, ["owner", "depth"]).join(ends, ["owner", "depth"], "left").select(
        F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
