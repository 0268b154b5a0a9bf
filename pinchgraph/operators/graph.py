"""Graph loading, adjacency, suppliers, components, betweenness and articulation points.

Iterations are driven by the row counts of the tables each step writes; only those counters
reach the driver.  Node keys are strings; adjacency rows are (src, dst).
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinchgraph.model import NODE_LABELS, RELATIONS
from pinchgraph.operators.graph_blocks import MAX_NEIGHBOUR_ROWS, block_metrics
from pinchgraph.operators import contraction
from pinchgraph.storage import Step, materialize, running_offsets


def load_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes of the seven labels."""
    return nodes.where(F.col("label").isin(NODE_LABELS) & F.col("node_id").isNotNull())


def load_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of the ten relations with both ends among `nodes`."""
    ids = nodes.select("node_id")
    e = edges.where(F.col("relation").isin(RELATIONS) & F.col("src").isNotNull() & F.col("dst").isNotNull())
    return e.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")


def adjacency(edges: DataFrame) -> DataFrame:
    """Undirected distinct neighbour pairs, both directions; a self-loop is one row."""
    first = F.coalesce(F.col("src") <= F.col("dst"), F.col("src").isNull())  # one of the two directions, so `edges` is read once and half as many rows are compared
    pairs = edges.select(F.when(first, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("b")).distinct()
    there, back = (F.struct(F.col(x).alias("src"), F.col(y).alias("dst")) for x, y in (("a", "b"), ("b", "a")))
    return pairs.select(F.inline(F.when(F.col("a").eqNullSafe(F.col("b")), F.array(there)).otherwise(F.array(there, back))))


def supplier_counts(edges: DataFrame) -> DataFrame:
    """D3: distinct in-neighbours over all relations, self-loops included (S3)."""
    return edges.groupBy("dst").agg(F.count_distinct("src").alias("num_suppliers")).select(
        F.col("dst").alias("node_id"), F.greatest(F.lit(1).cast("long"), "num_suppliers").alias("num_suppliers"))


def _no_loops(adj: DataFrame) -> DataFrame:
    return adj.where(F.col("src") != F.col("dst"))


def components(nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """(node_id, component), the component named by its smallest node id.

    The graph is contracted round by round, so a component that holds most nodes is never a join key of
    all its edges; a node without edges is its own component.
    """
    roots = contraction.components(adj, "src", "dst").withColumnRenamed("node", "node_id")
    return nodes.select("node_id").join(roots, "node_id", "left").select("node_id", F.coalesce("root", "node_id").alias("component"))


@dataclass(frozen=True)
class Twins:
    """Nodes with the same neighbours, as one class each, named by its smallest node.

    `members` (node_id, class, size, degree): `size` nodes in the class, each with `degree` neighbours.  `edges`
    (src, dst, size): neighbouring classes in both directions, with the size of `dst`.  Twins are never neighbours, so a class
    has all members of a neighbouring class as neighbours: shortest paths are counted on classes, without loss.
    """

    members: DataFrame
    edges: Step

    def classes(self) -> DataFrame:
        """One row per class: class, size, degree."""
        return self.members.where(F.col("node_id") == F.col("class")).select("class", "size", "degree")

    def expanded(self, nodes: DataFrame, values: DataFrame) -> DataFrame:
        """`nodes` with the `values` of their class, null without one."""
        return nodes.join(self.members.select("node_id", "class").join(values, "class"), "node_id", "left")


def twins(adj: DataFrame) -> Twins:
    """The classes of `adj` (src, dst): both directions, distinct, no loops.  Sets of neighbours are compared by number and 128 bits of hash."""
    sets = adj.groupBy("src").agg(F.bit_xor(F.xxhash64("dst")).alias("_a"), F.bit_xor(F.xxhash64(F.lit(1), "dst")).alias("_b"), F.count(F.lit(1)).alias("degree"))
    sets = materialize(sets, "neighbour-sets").df
    found = sets.groupBy("_a", "_b", "degree").agg(F.min("src").alias("class"), F.count(F.lit(1)).alias("size"))
    step = materialize(sets.join(found, ["_a", "_b", "degree"]).select(F.col("src").alias("node_id"), "class", "size", "degree"), "twins", largest=F.max("size"), edges=F.sum("degree"))
    members = step.df
    if (step.metrics.get("largest") or 0) <= 1:  # no twins: the edges as they are
        return Twins(members, Step(adj.select("src", "dst", F.lit(1).cast("long").alias("size")), int(step.metrics.get("edges") or 0), {}))
    first = members.where(F.col("node_id") == F.col("class"))
    edges = adj.join(first.select(F.col("node_id").alias("src")), "src", "left_semi").join(
        first.select(F.col("node_id").alias("dst"), "size"), "dst").select("src", "dst", "size")
    return Twins(members, materialize(edges, "twin-edges"))


def node_centrality(nodes: DataFrame, adj: DataFrame, max_rows: int = MAX_NEIGHBOUR_ROWS, error: float | None = None) -> DataFrame:
    """D4 and D5 together: (node_id, betweenness, is_articulation_point).

    Nodes with the same neighbours are one class (`Twins`).  A list of neighbouring classes of at most `max_rows` rows,
    counted first, is broadcast and walked from blocks of start classes; a larger one goes through joins.  With `error`, betweenness
    comes from sampled sources and is off by at most that much (`sampling.sampled_betweenness`), and articulation points from
    blocks, so no step searches the graph once per class.
    """
    if error is not None:
        from pinchgraph.operators.sampling import sampled_betweenness

        points = articulation_points(nodes, adj).withColumn("_ap", F.lit(True))
        return sampled_betweenness(nodes, adj, error, max_rows=max_rows).join(points, "node_id", "left").select(
            "node_id", "betweenness", F.coalesce("_ap", F.lit(False)).alias("is_articulation_point"))
    whole = materialize(_no_loops(adj), "centrality-edges")
    if not whole.rows:
        return nodes.select("node_id", F.lit(0.0).alias("betweenness"), F.lit(False).alias("is_articulation_point"))
    classes = twins(whole.df)
    if classes.edges.rows > max_rows:
        points = articulation_points(nodes, whole.df).withColumn("_ap", F.lit(True))
        return _class_betweenness(nodes, classes).join(points, "node_id", "left").select(
            "node_id", "betweenness", F.coalesce("_ap", F.lit(False)).alias("is_articulation_point"))
    found = materialize(block_metrics(classes.edges.df), "centrality").df
    return classes.expanded(nodes.select("node_id"), found).select(
        "node_id", _normalised(F.col("total"), nodes.count()).alias("betweenness"),
        F.coalesce("is_ap", F.lit(False)).alias("is_articulation_point"))


def _normalised(total: Column, n: int, scale: float = 1.0) -> Column:
    # ten digits remove the noise of the summation order, so later roundings are stable
    return F.round(F.coalesce(total, F.lit(0.0)) * F.lit(scale / ((n - 1) * (n - 2) if n > 2 else 1)), 10)


def dependencies(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, delta): how much the shortest paths from a member of each class `source` depend on a member of each other class they pass, ends left out.

    `edges` are those of `Twins`, `sources` has class, size and degree.
    Breadth-first searches run from all sources at once: a level is one join with the
    neighbours and one aggregation by (source, node), in which the two previous levels take
    part to drop nodes already reached (in an undirected graph no other level can occur).
    The way back adds each node's share to its predecessors in the same form.  A path may pass any member of a class, so
    both ways weigh by its size; a source's own twins are two steps away, and each shares one dependency among its neighbours.
    Work is sources x rows of `edges`, spread by (source, node).
    """
    level = materialize(sources.select(F.col("class").alias("source"), F.col("class").alias("node"), F.lit(1.0).alias("sigma"), F.lit(1).cast("long").alias("size")), "bc-start")
    levels: list[DataFrame] = [level.df]
    near = edges.select("src", "dst", F.col("size").alias("dst_size"))
    while level.rows:
        reached = levels[-1].join(near, F.col("node") == F.col("src")).select(
            "source", F.col("dst").alias("node"), (F.col("sigma") * F.col("size")).alias("sigma"), F.col("dst_size").alias("size"), F.lit(0).alias("seen"))
        for older in levels[-2:]:
            reached = reached.unionByName(older.select("source", "node", F.lit(0.0).alias("sigma"), "size", F.lit(1).alias("seen")))
        grown = reached.groupBy("source", "node").agg(F.sum("sigma").alias("sigma"), F.max("size").alias("size"), F.max("seen").alias("seen")).where(
            F.col("seen") == 0).drop("seen")
        level = materialize(grown, "bc-level")
        if level.rows:
            levels.append(level.df)
    shares: list[DataFrame] = []
    below = levels[-1].withColumn("delta", F.lit(0.0))
    for depth in range(len(levels) - 1, 0, -1):
        if depth == 1:
            own = sources.select(F.col("class").alias("source"), ((F.col("size") - 1) / F.col("degree")).alias("own"))
            shares.append(below.join(own, "source").select("source", "node", (F.col("delta") + F.col("own")).alias("delta")))
            break
        shares.append(below.select("source", "node", "delta"))
        given = below.join(near, F.col("node") == F.col("src")).select(
            "source", F.col("dst").alias("node"), F.lit(None).cast("double").alias("sigma"), F.lit(None).cast("long").alias("size"),
            (F.col("size") * (F.lit(1.0) + F.col("delta")) / F.col("sigma")).alias("part"))
        own = levels[depth - 1].select("source", "node", "sigma", "size", F.lit(0.0).alias("part"))
        summed = own.unionByName(given).groupBy("source", "node").agg(
            F.max("sigma").alias("sigma"), F.max("size").alias("size"), F.sum("part").alias("part")).where(F.col("sigma").isNotNull())
        below = materialize(summed.select("source", "node", "sigma", "size", (F.col("sigma") * F.col("part")).alias("delta")),
                            "bc-back").df
    if not shares:
        return levels[0].select("source", "node", F.lit(0.0).alias("delta")).where(F.lit(False))
    return _union(shares)


def _class_betweenness(nodes: DataFrame, classes: Twins, times: DataFrame | None = None, scale: float = 1.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """(node_id, betweenness, and the columns `carry` of `nodes`) with as many sources per class as `times(class, times)` says, all members without it."""
    sources = classes.classes()
    times = times if times is not None else sources.select("class", F.col("size").cast("double").alias("times"))
    sources = materialize(sources.join(times, "class"), "bc-sources").df
    each = dependencies(classes.edges.df, sources).join(sources.select(F.col("class").alias("source"), "times"), "source")
    total = each.groupBy(F.col("node").alias("class")).agg(F.sum(F.col("delta") * F.col("times")).alias("total"))
    return classes.expanded(nodes.select("node_id", *carry), total).select("node_id", *carry, _normalised(F.col("total"), nodes.count(), scale).alias("betweenness"))


def betweenness(nodes: DataFrame, adj: DataFrame, pivots: DataFrame | None = None) -> DataFrame:
    """D4 by joins: (node_id, betweenness), exact and unweighted, divided by (n-1)(n-2); see `dependencies`.

    Work is a search per class of nodes with the same neighbours.  `pivots` (node_id) restricts the sources and scales the
    result by n / pivots; `sampling.sampled_betweenness` chooses sources until a stated error is reached.
    """
    classes = twins(materialize(_no_loops(adj), "bc-edges").df)
    if pivots is None:
        return _class_betweenness(nodes, classes)
    times = pivots.join(classes.members, "node_id").groupBy("class").agg(F.count(F.lit(1)).cast("double").alias("times"))
    return _class_betweenness(nodes, classes, times, nodes.count() / max(1, pivots.count()))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _bfs_forest(comps: DataFrame, adj: DataFrame) -> list[Step]:
    """Levels of a breadth-first forest rooted at each component's smallest node: (node, parent)."""
    level = materialize(comps.where(F.col("node_id") == F.col("component")).select(
        F.col("node_id").alias("node"), F.lit(None).cast("string").alias("parent")), "ap-root")
    levels = [level]
    while True:
        reached = levels[-1].df.select("node").join(adj, F.col("node") == F.col("src")).select(
            F.col("dst").alias("node"), F.col("src").alias("parent"), F.lit(0).alias("seen"))
        for older in levels[-2:]:
            reached = reached.unionByName(older.df.select("node", F.lit(None).cast("string").alias("parent"), F.lit(1).alias("seen")))
        grown = reached.groupBy("node").agg(F.min("parent").alias("parent"), F.max("seen").alias("seen")).where(
            F.col("seen") == 0).drop("seen")
        level = materialize(grown, "ap-level")
        if not level.rows:
            return levels
        levels.append(level)


def _tree_blocks(nodes: DataFrame, adj: DataFrame, rows_per_salt: int) -> DataFrame | None:
    """(node, parent, component): the block of each edge of a spanning forest; None without edges.  `adj` has no loops.

    Tarjan and Vishkin's biconnectivity over a breadth-first forest: subtree sizes bottom-up,
    preorder numbers top-down, smallest and largest preorder reachable from each subtree
    bottom-up, then blocks as components of the graph whose vertices are tree edges (named by
    their lower node).  Every level is read once; sibling offsets are salted, so a hub is not one task.
    """
    touched = adj.select(F.col("src").alias("node_id")).distinct()
    comps = components(nodes.select("node_id").join(touched, "node_id", "left_semi"), adj)
    levels = _bfs_forest(comps, adj)
    if len(levels) == 1:
        return None
    salts = max(1, ceil(sum(s.rows for s in levels) / rows_per_salt))

    sized: list[DataFrame] = [None] * len(levels)
    for d in range(len(levels) - 1, -1, -1):
        part = levels[d].df
        if d == len(levels) - 1:
            sized[d] = part.withColumn("size", F.lit(1).cast("long"))
            continue
        under = sized[d + 1].groupBy(F.col("parent").alias("node")).agg(F.sum("size").alias("under"))
        sized[d] = materialize(part.join(under, "node", "left").select(
            "node", "parent", (F.lit(1) + F.coalesce("under", F.lit(0))).cast("long").alias("size")), "ap-size").df

    placed: list[DataFrame] = [sized[0].withColumn("pre", F.lit(0).cast("long"))]
    for d in range(1, len(levels)):
        kids = sized[d].withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int")).withColumn(
            "_tie", F.col("node"))
        kids = running_offsets(kids, ["parent"], "size", "before").drop("_salt", "_tie")
        tops = placed[d - 1].select(F.col("node").alias("parent"), F.col("pre").alias("_top"))
        placed.append(materialize(kids.join(tops, "parent").select(
            "node", "parent", "size", (F.col("_top") + 1 + F.col("before")).alias("pre")), "ap-pre").df)
    tree = _union(placed)

    left = tree.select(F.col("node").alias("src"), F.col("parent").alias("src_parent"))
    right = tree.select(F.col("node").alias("dst"), F.col("parent").alias("dst_parent"), F.col("pre").alias("dst_pre"))
    cross = materialize(adj.join(left, "src").join(right, "dst").where(
        ~F.col("src_parent").eqNullSafe(F.col("dst")) & ~F.col("dst_parent").eqNullSafe(F.col("src"))).select(
        "src", "dst", "dst_pre"), "ap-cross").df
    local = materialize(cross.groupBy(F.col("src").alias("node")).agg(
        F.min("dst_pre").alias("lo"), F.max("dst_pre").alias("hi")), "ap-local").df

    reach: list[DataFrame] = [None] * len(levels)
    for d in range(len(levels) - 1, 0, -1):
        part = placed[d].join(local, "node", "left")
        low, high = F.least("pre", F.coalesce("lo", "pre")), F.greatest("pre", F.coalesce("hi", "pre"))
        if d < len(levels) - 1:
            under = reach[d + 1].groupBy(F.col("parent").alias("node")).agg(
                F.min("low").alias("klow"), F.max("high").alias("khigh"))
            part = part.join(under, "node", "left")
            low, high = F.least(low, F.coalesce("klow", "pre")), F.greatest(high, F.coalesce("khigh", "pre"))
        reach[d] = materialize(part.select("node", "parent", low.alias("low"), high.alias("high")), "ap-reach").df

    edges = _union(reach[1:])  # one row per tree edge, named by its lower node
    over = tree.where(F.col("parent").isNotNull()).select(
        F.col("node").alias("parent"), F.col("pre").alias("ppre"), F.col("size").alias("psize"))
    chain = edges.join(over, "parent").where(
        (F.col("low") < F.col("ppre")) | (F.col("high") >= F.col("ppre") + F.col("psize"))).select(
        F.col("parent").alias("src"), F.col("node").alias("dst"))
    links = adjacency(cross.select("src", "dst").unionByName(chain))
    blocks = components(edges.select(F.col("node").alias("node_id")), links)
    return edges.join(blocks, F.col("node") == F.col("node_id")).select("node", "parent", "component")


def articulation_points(nodes: DataFrame, adj: DataFrame, rows_per_salt: int = 1_000_000) -> DataFrame:
    """D5 by joins: nodes whose removal splits their component, those whose tree edges lie in two blocks (`_tree_blocks`)."""
    edges = _tree_blocks(nodes, materialize(_no_loops(adj), "ap-edges").df, rows_per_salt)
    if edges is None:
        return nodes.select("node_id").where(F.lit(False))
    ends = edges.select(F.explode(F.array("node", "parent")).alias("node_id"), "component")
    return ends.groupBy("node_id").agg(F.min("component").alias("a"), F.max("component").alias("b")).where(
        F.col("a") != F.col("b")).select("node_id")


@dataclass(frozen=True)
class BlockCutTree:
    """Biconnected blocks: `members` (block, node_id) and `edges` (block, src, dst), both directions of each edge.

    A node in two blocks is an articulation point; together blocks and such nodes form a forest.  `rows` is the
    number of neighbour rows that were searched to build it.
    """

    members: DataFrame
    edges: DataFrame
    rows: int

    def articulation_points(self) -> DataFrame:
        """(node_id) of the nodes in more than one block."""
        return self.members.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node_id")

    def without(self, excluded: str, rows_per_salt: int = 1_000_000) -> BlockCutTree:
        """The blocks after removing one node.  Only the blocks it lies in are searched again; all others are carried over as they are."""
        touched = materialize(self.members.where(F.col("node_id") == excluded).select("block"), "touched").df
        inner = self.edges.join(touched, "block", "left_semi").where((F.col("src") != excluded) & (F.col("dst") != excluded))
        again = block_cut_tree(inner.select(F.col("src").alias("node_id")).distinct(), inner.select("src", "dst"), rows_per_salt, f"-{excluded}:")
        kept = lambda df: df.join(touched, "block", "left_anti")
        return BlockCutTree(materialize(kept(self.members).unionByName(again.members), "members").df,
                            materialize(kept(self.edges).unionByName(again.edges), "block-edges").df, again.rows)


def block_cut_tree(nodes: DataFrame, adj: DataFrame, rows_per_salt: int = 1_000_000, prefix: str = "") -> BlockCutTree:
    """The biconnected blocks of a graph.  Nodes without neighbours are in no block; `prefix` starts the blocks' names.

    A tree edge lies in the block of its lower node.  Any other edge joins nodes of which none is above the
    other, and their tree edges share its block.
    """
    step = materialize(_no_loops(adj), "block-adj")
    found = _tree_blocks(nodes, step.df, rows_per_salt)
    if found is None:
        none = step.df.where(F.lit(False))
        return BlockCutTree(none.select(F.lit("").alias("block"), F.col("src").alias("node_id")), none.select(F.lit("").alias("block"), "src", "dst"), step.rows)
    tree = materialize(found.select("node", "parent", F.concat(F.lit(prefix), "component").alias("block")), "tree-blocks").df
    members = tree.select("block", F.explode(F.array("node", "parent")).alias("node_id")).distinct()
    of_src = tree.select(F.col("node").alias("src"), F.col("block").alias("src_block"))
    of_dst = tree.select(F.col("node").alias("dst"), F.col("parent").alias("dst_parent"), F.col("block").alias("dst_block"))
    block = F.when(F.col("dst_parent") == F.col("src"), F.col("dst_block")).otherwise(F.col("src_block"))
    edges = step.df.join(of_src, "src", "left").join(of_dst, "dst", "left").select(block.alias("block"), "src", "dst")
    return BlockCutTree(materialize(members, "members").df, materialize(edges, "block-edges").df, step.rows)
