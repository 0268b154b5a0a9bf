"""Betweenness from sampled sources with a stated error (D4 for graphs where n searches are too many)."""

from __future__ import annotations

from functools import reduce
from math import ceil, log, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinchgraph.operators.contraction import components
from pinchgraph.operators.graph import _class_betweenness, twins
from pinchgraph.operators.graph_blocks import MAX_NEIGHBOUR_ROWS, Walker
from pinchgraph.storage import materialize, running_offsets

#: Sources of the first round; every further round doubles their number.
FIRST = 64
#: Hash buckets in which nodes are numbered.
BUCKETS = 256


def _numbered(nodes: DataFrame) -> DataFrame:
    """(no, node_id): nodes numbered from 0 without gaps, in a fixed order."""
    salted = nodes.select("node_id", F.lit(0).alias("_all"), F.lit(1).cast("long").alias("_one"), F.pmod(F.xxhash64("node_id"), F.lit(BUCKETS)).alias("_salt"), F.col("node_id").alias("_tie"))
    return running_offsets(salted, ["_all"], "_one", "no").select("no", "node_id")


def _ids(nodes: DataFrame):
    """A function from a column of node names to 64-bit ids, null for null, that gives no two of `nodes` the same one.

    Ids are hashes, so no join is needed to set them in; a hash that meets twice is given up for another.
    """
    seed = 0
    while True:
        of = lambda name, seed=seed: F.when(F.col(name).isNotNull(), F.xxhash64(F.lit("node"), F.lit(seed), F.col(name)))
        meets = nodes.groupBy(of("node_id").alias("id")).agg((F.min("node_id") != F.max("node_id")).alias("meets")).agg(F.max("meets")).first()[0]
        if not meets:
            return of
        seed += 1


def _draws(numbered: DataFrame, n: int, first: int, last: int, seed: int) -> DataFrame:
    """(pair, s, t): draws first..last-1 of two different nodes, uniform and with replacement of the pair; a draw depends on its number alone."""
    def below(most: int, part: int) -> Column:
        spin = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id", F.lit(part)), 11).cast("double") / F.lit(float(1 << 53))
        return F.floor(spin * most).cast("long")

    drawn = numbered.sparkSession.range(first, last).select(F.col("id").alias("pair"), below(n, 0).alias("a"), below(n - 1, 1).alias("b"))
    drawn = drawn.withColumn("b", F.col("b") + (F.col("b") >= F.col("a")).cast("long"))
    of = lambda no, end: numbered.select(F.col("no").alias(no), F.col("node_id").alias(end))
    return drawn.join(of("a", "s"), "a").join(of("b", "t"), "b").select("pair", "s", "t")


def path_shares(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, node, share): the share of the shortest paths between the ends of each of `pairs(pair, s, t)` that pass a member of each class, by joins.

    `edges` are those of `Twins`, s and t are classes; if s is t, the ends are two of its members.  All pairs are searched at once, each level by level
    from both ends, the end whose next level has fewer neighbours first, until its searches meet or one has nothing left.
    So a pair costs the neighbours of two small balls and not all rows of `edges`.
    """
    near = edges.select(F.col("src").alias("node"), F.col("dst").alias("to"), F.col("size").alias("to_size"))
    wide = materialize(near.groupBy("node").agg(F.count(F.lit(1)).alias("width"), F.sum("to_size").alias("degree")), "widths").df
    twin = pairs.where("s = t").select("pair", F.col("s").alias("node")).join(wide, "node").join(near, "node").select("pair", F.col("to").alias("node"), (F.lit(1.0) / F.col("degree")).alias("share"))
    start = pairs.where("s <> t").select("pair", F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("s").alias("node")), F.struct(F.lit(1).alias("side"), F.col("t").alias("node")))))
    columns = ["pair", "side", "depth", "node", "sigma", "size", "width"]
    fronts = materialize(start.join(wide, "node").select("pair", "side", F.lit(0).alias("depth"), "node", F.lit(1.0).alias("sigma"), F.lit(1).cast("long").alias("size"), "width"), "pair-ends")
    levels, met, older = [fronts.df], [], fronts.df.limit(0)
    while fronts.rows:
        load = fronts.df.groupBy("pair").agg(*[F.sum(F.when(F.col("side") == i, F.col("width"))).alias(f"w{i}") for i in range(2)])
        turn = materialize(load.select("pair", (F.col("w1") < F.col("w0")).cast("int").alias("side")), "turns").df
        moving, waiting = (fronts.df.join(turn, ["pair", "side"], how) for how in ("left_semi", "left_anti"))
        reached = moving.join(near, "node").select("pair", "side", (F.col("depth") + 1).alias("depth"), F.col("to").alias("node"), (F.col("sigma") * F.col("size")).alias("sigma"), F.col("to_size").alias("size"), F.lit(0).alias("seen"))
        for behind in (moving, older.join(turn, ["pair", "side"], "left_semi")):
            reached = reached.unionByName(behind.select("pair", "side", "depth", "node", F.lit(0.0).alias("sigma"), "size", F.lit(1).alias("seen")))
        grown = reached.groupBy("pair", "side", "node").agg(F.max("depth").alias("depth"), F.sum("sigma").alias("sigma"), F.max("size").alias("size"), F.max("seen").alias("seen")).where("seen = 0")
        grown = materialize(grown.join(wide, "node").select(*columns), "pair-level").df
        other = waiting.select("pair", "node", F.col("depth").alias("other_depth"), F.col("sigma").alias("other_sigma"), F.col("size").alias("other_size"))
        meet = materialize(grown.join(other, ["pair", "node"]).select("pair", "side", "node", "depth", "sigma", "other_depth", "other_sigma", F.least("size", "other_size").alias("size")), "pair-meets").df
        open_ = materialize(grown.select("pair").distinct().join(meet.select("pair").distinct(), "pair", "left_anti"), "pairs-open").df
        older = materialize(older.join(turn, ["pair", "side"], "left_anti").unionByName(moving).join(open_, "pair", "left_semi").select(*columns), "pair-older").df
        fronts = materialize(waiting.unionByName(grown).join(open_, "pair", "left_semi").select(*columns), "pair-fronts")
        levels.append(grown)
        met.append(meet)
    if not met:
        return twin
    meet, seen = (materialize(reduce(DataFrame.unionByName, parts), tag).df for parts, tag in ((met, "meets"), (levels, "levels")))
    both = F.col("sigma") * F.col("other_sigma")
    total = materialize(meet.groupBy("pair").agg(F.sum(both * F.col("size")).alias("total")), "totals").df
    inner = meet.where("depth > 0 and other_depth > 0").join(total, "pair").select("pair", "node", (both / F.col("total")).alias("share"))
    ends = meet.select("pair", "node", "size", F.inline(F.array(
        F.struct("side", "depth", F.col("other_sigma").alias("tail")), F.struct((F.lit(1) - F.col("side")).alias("side"), F.col("other_depth").alias("depth"), F.col("sigma").alias("tail")))))
    below, shares = materialize(ends.where("depth > 1"), "pair-back"), [twin, inner]
    while below.rows:
        given = below.df.join(near, "node").groupBy("pair", "side", (F.col("depth") - 1).alias("depth"), F.col("to").alias("node")).agg(F.sum(F.col("tail") * F.col("size")).alias("tail"))
        back = materialize(given.join(seen, ["pair", "side", "depth", "node"]).select("pair", "side", "depth", "node", "sigma", "size", "tail"), "pair-back").df
        shares.append(back.join(total, "pair").select("pair", "node", (F.col("sigma") * F.col("tail") / F.col("total")).alias("share")))
        below = materialize(back.where("depth > 1"), "pair-back")
    return reduce(DataFrame.unionByName, shares)


def sampled_betweenness(nodes: DataFrame, adj: DataFrame, error: float = 0.05, risk: float = 0.05, first: int = FIRST, seed: int = 7,
                        max_rows: int = MAX_NEIGHBOUR_ROWS) -> DataFrame:
    """(node_id, betweenness, error_bound, sources): estimates that are all within their bounds with probability 1 - risk.

    Sources are drawn uniformly, each with a target, in rounds of doubling size until the largest bound is at most `error`.  A pair gives
    node v the share of its shortest paths that pass v, a number in [0, 1] whose mean is the betweenness times (n - 2) / n.  The bound is that of
    Audibert, Munos and Szepesvari, sqrt(2 V L / t) + 3 L / t for t draws of variance V, with L = ln(3 n rounds / risk) for
    all nodes and rounds at once; so t grows with log n and with the variance, not with n.  Rounds whose 3 L / t alone
    is above `error` are not looked at.  A pair is searched from both ends until they meet, which leaves most
    of the graph unread; pairs in two components are not searched.  When t would pass n all sources are taken, the result is exact and its bound is 0.

    `adj` has both directions of each pair.  Names are replaced by 64-bit ids (`_ids`), so what is compared, joined and read again is numbers.
    Nodes with the same neighbours are one class (`graph.Twins`).  At most `max_rows` rows of neighbouring classes are broadcast and
    pairs are spread over tasks (`Walker`); with more all pairs are searched by joins (`path_shares`).
    Nodes without edges have betweenness 0; loops and repeated neighbours do not count.
    """
    id_of = _ids(nodes)
    pairs = materialize(adj.select(id_of("src").alias("a"), id_of("dst").alias("b")).where("a < b").distinct(), "sample-edges")  # `adj` has both directions
    edges = pairs.df.select(F.inline(F.array(*[F.struct(F.col(x).alias("src"), F.col(y).alias("dst")) for x, y in (("a", "b"), ("b", "a"))])))
    numbered = materialize(_numbered(nodes), "sample-nodes")
    named = nodes.select(F.col("node_id").alias("name"), id_of("node_id").alias("node_id"))
    n = numbered.rows
    if n < 3 or not pairs.rows:
        return nodes.select("node_id", F.lit(0.0).alias("betweenness"), F.lit(0.0).alias("error_bound"), F.lit(0).cast("long").alias("sources"))
    classes = twins(edges)
    small = classes.edges.rows <= max_rows
    walker = Walker(classes.edges.df) if small else None
    rounds = max(1, ceil(log2(max(2.0, n / first))) + 1)
    wide, scale = log(3.0 * n * rounds / risk), n / (n - 2.0)
    parts, done, t = [], 0, first
    while t < n and 3 * wide / t * scale > error:
        t *= 2
    if t < n and not small:
        roots = materialize(components(classes.edges.df.where("src < dst"), "src", "dst", unique=True), "sample-roots").df
    while t < n:
        drawn = materialize(_draws(numbered.df, n, done, t, seed), "draws").df
        drawn = drawn.select("pair", id_of("s").alias("s"), id_of("t").alias("t"))
        for end in ("s", "t"):
            drawn = drawn.join(classes.members.select(F.col("node_id").alias(end), F.col("class").alias(f"{end}_class")), end)
        pairs = drawn.select("pair", F.col("s_class").alias("s"), F.col("t_class").alias("t"))
        if small:
            sums = walker.shares(pairs.select(F.col("s").cast("string"), F.col("t").cast("string"))).withColumn("class", F.col("class").cast("long"))
        else:
            for end in ("s", "t"):
                pairs = pairs.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end)
            within = materialize(pairs.where("s_root = t_root").select("pair", "s", "t"), "pairs").df
            sums = path_shares(classes.edges.df, within).groupBy(F.col("node").alias("class")).agg(F.sum("share").alias("s1"), F.sum(F.col("share") ** 2).alias("s2"))
        parts.append(materialize(sums, "sums").df)
        mean, square = F.col("s1") / float(t), F.col("s2") / float(t)
        bound = F.sqrt(2 * F.greatest(F.lit(0.0), square - mean * mean) * wide / t) + 3 * wide / t
        both = reduce(DataFrame.unionByName, parts).groupBy("class").agg(F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
        step = materialize(both.select("class", (mean * scale).alias("estimate"), (bound * scale).alias("bound")), "estimates", worst=F.max("bound"))
        untouched = 3 * wide / t * scale
        if max(untouched, step.metrics.get("worst") or 0.0) <= error:
            return classes.expanded(named, step.df).select(
                F.col("name").alias("node_id"), F.round(F.coalesce("estimate", F.lit(0.0)), 10).alias("betweenness"), F.coalesce("bound", F.lit(untouched)).alias("error_bound"), F.lit(t).cast("long").alias("sources"))
        done, t = t, 2 * t
    if not small:
        exact = _class_betweenness(named, classes, carry=("name",))
        return exact.select(F.col("name").alias("node_id"), "betweenness", F.lit(0.0).alias("error_bound"), F.lit(n).cast("long").alias("sources"))
    every = walker.sums(classes.classes().select(F.col("class").cast("string"), F.col("size").cast("double").alias("times"))).withColumn("class", F.col("class").cast("long"))
    return classes.expanded(named, every).select(
        F.col("name").alias("node_id"), F.round(F.coalesce("s1", F.lit(0.0)) / ((n - 1.0) * (n - 2.0)), 10).alias("betweenness"), F.lit(0.0).alias("error_bound"), F.lit(n).cast("long").alias("sources"))
