"""Connected components of a graph by hooking and contraction.

Each round hooks every node to its smallest neighbour, resolves the hooks to roots by pointer
jumping and contracts the edges to the roots, so the graph shrinks until no edge is left.  Every
step is a written table: a lost executor costs one step and nothing is gathered on the driver
but row counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinchgraph.storage import materialize


def _jump(hooks: DataFrame) -> DataFrame:
    up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
    return hooks.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))


def _roots(hooks: DataFrame) -> DataFrame:
    """`hooks(node, root)` with root < node, resolved until no root is hooked itself; a step follows two hooks, then four."""
    while True:
        once = _jump(hooks).select("node", "root")
        step = materialize(_jump(once), "roots", moved=F.max(F.col("moved").cast("int")))
        hooks = step.df.select("node", "root")
        if not step.metrics.get("moved"):
            return hooks


def components(edges: DataFrame, a: str, b: str, unique: bool = False) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of the component.

    Hooks lead to smaller nodes only, so the smallest one stays a root in every round.  Nulls and self
    edges are ignored; repeated edges do no harm.  No edges give no rows.  With `unique` the edges are known to be few more than distinct ones.
    """
    pairs = edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    step, maps = materialize(pairs if unique else pairs.distinct(), "edges"), []
    while step.rows:
        hooks = materialize(step.df.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")), "hooks").df
        roots = _roots(hooks)
        maps.append(roots)
        at = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
        moved = step.df.join(at("lo"), "lo", "left").join(at("hi"), "hi", "left")
        lo, hi = F.coalesce("lo_root", "lo"), F.coalesce("hi_root", "hi")
        step = materialize(moved.where(lo != hi).select(F.least(lo, hi).alias("lo"), F.greatest(lo, hi).alias("hi")).distinct(), "edges")
    if not maps:
        return step.df.select(F.col("lo").alias("node"), F.col("hi").alias("root"))
    whole = maps[-1]
    for earlier in reversed(maps[:-1]):
        up = whole.select(F.col("node").alias("root"), F.col("root").alias("above"))
        whole = earlier.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root")).unionByName(whole)
    whole = materialize(whole, "labels").df
    tops = whole.select(F.col("root").alias("node"), "root").distinct()
    return whole.unionByName(tops)
