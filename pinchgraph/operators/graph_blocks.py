"""Betweenness and articulation points by blocks of start nodes, for graphs of a checked size.

Nodes are classes of `graph.Twins`, each with its number of members.  The list of neighbouring classes is
broadcast and Spark spreads the start classes; a task walks breadth-first from a block of them at once.
Nothing is shuffled but one partial sum per class and task.  Larger graphs take the joins in `graph`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Directed neighbour rows (two per edge) that may be broadcast: 2M x 16 bytes.
MAX_NEIGHBOUR_ROWS = 2_000_000
BLOCK_CELLS = 4_000_000


class _Spread:
    """Sums (or ors) of neighbour values for every node, for a block of rows at once."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, n: int):
        order = np.argsort(dst, kind="stable")
        self.src, self.n = src[order], n
        self.nodes, self.starts = np.unique(dst[order], return_index=True)

    def add(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((len(values), self.n))
        out[:, self.nodes] = np.add.reduceat(values[:, self.src], self.starts, axis=1)
        return out

    def any(self, flags: np.ndarray) -> np.ndarray:
        out = np.zeros((len(flags), self.n), dtype=bool)
        out[:, self.nodes] = np.logical_or.reduceat(flags[:, self.src], self.starts, axis=1)
        return out


def _dependencies(graph: _Spread, starts: np.ndarray, size: np.ndarray, degree: np.ndarray) -> np.ndarray:
    """Pair dependencies of a member of every class on one member of each start class, a row per start.

    A path may pass any member of a class, so path numbers are weighed by `size`.  The start's own twins are two steps
    away and lead nowhere else: each shares one dependency among its `degree` neighbours.
    """
    rows = np.arange(len(starts))
    paths = np.zeros((len(starts), graph.n))
    paths[rows, starts] = 1.0
    depth = np.full(paths.shape, -1, dtype=np.int32)
    depth[rows, starts] = 0
    front, level = paths.copy(), 0
    while True:
        front = np.where(depth < 0, graph.add(front), 0.0)
        hit = front > 0
        if not hit.any():
            break
        level += 1
        depth[hit] = level
        paths += front
        front *= size
    share = np.zeros(paths.shape)
    for at in range(level, 1, -1):
        given = np.divide(size * (1.0 + share), paths, out=np.zeros(paths.shape), where=depth == at)
        share += np.where(depth == at - 1, paths * graph.add(given), 0.0)
    twins = size[starts] - 1.0
    if twins.any():
        own = np.zeros(paths.shape)
        own[rows, starts] = twins / degree[starts]
        share += graph.add(own)
    return share


def _splits(graph: _Spread, first: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Which of `nodes` leave a neighbour unreachable from their first neighbour when removed."""
    rows = np.arange(len(nodes))
    seen = np.zeros((len(nodes), graph.n), dtype=bool)
    seen[rows, nodes] = True
    front = np.zeros(seen.shape, dtype=bool)
    front[rows, first[nodes]] = True
    seen |= front
    while front.any():
        front = graph.any(front) & ~seen
        seen |= front
    near = np.zeros(seen.shape, dtype=bool)
    near[rows, nodes] = True
    return (graph.any(near) & ~seen).any(axis=1)


def _arrays(edges: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(names in order, src, dst, size of each name) of `edges(src, dst, size)`, of a number of rows the caller has checked."""
    table = edges.select("src", "dst", "size").toArrow()
    both = pa.chunked_array([c for name in ("src", "dst") for c in table.column(name).cast(pa.string()).chunks], pa.string()).combine_chunks().dictionary_encode()
    order = pc.sort_indices(both.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    src, dst = np.split(rank[both.indices.to_numpy()], 2)
    size = np.ones(len(order))
    size[dst] = table.column("size").to_numpy()
    return np.asarray(both.dictionary.take(pa.array(order)).to_pylist(), dtype=object), src, dst, size


def _step(rows: int) -> int:
    return int(max(1, min(256, BLOCK_CELLS // max(1, rows))))


def block_metrics(edges: DataFrame) -> DataFrame:
    """(class, total, is_ap): summed dependencies of a member, and articulation flag, of every class in `edges`.

    `edges(src, dst, size)` are those of `graph.Twins`, at most `MAX_NEIGHBOUR_ROWS` rows, which the caller has checked.
    A node with a twin is no articulation point; one with two neighbours that have no other neighbour is.
    """
    spark = edges.sparkSession
    arrays = _arrays(edges)
    shared = spark.sparkContext.broadcast(arrays)
    n, step = len(arrays[0]), _step(len(arrays[1]))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, a, b, size = shared.value
        graph = _Spread(a, b, len(names))
        degree = graph.add(size[None])[0]
        first = np.zeros(len(names), dtype=np.int64)
        first[b[::-1]] = a[::-1]
        leaves = graph.any(((degree == 1) & (size > 1))[None])[0]
        total, flags = np.zeros(len(names)), np.zeros(len(names), dtype=bool)
        for batch in batches:
            every = batch.column(0).to_numpy()
            for at in range(0, len(every), step):
                block = every[at:at + step]
                total += size[block] @ _dependencies(graph, block, size, degree)
                flags[block] = (size[block] == 1) & (_splits(graph, first, block) | leaves[block])
        used = np.flatnonzero((total != 0) | flags)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[used], type=pa.string()), pa.array(total[used]), pa.array(flags[used])],
            names=["class", "total", "is_ap"])

    tasks = max(1, min(n, 4 * spark.sparkContext.defaultParallelism))
    parts = spark.range(0, n, numPartitions=tasks).mapInArrow(walk, "class string, total double, is_ap boolean")
    return parts.groupBy("class").agg(F.sum("total").alias("total"), F.max("is_ap").alias("is_ap"))


class _Pairs:
    """Shortest paths between two classes, searched level by level from both ends until the searches meet."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, size: np.ndarray):
        self.near, self.size = dst[np.argsort(src, kind="stable")], size
        self.at = np.r_[0, np.cumsum(np.bincount(src, minlength=len(size)))]
        self.depth = [np.full(len(size), -1, np.int32) for _ in range(2)]
        self.paths = [np.zeros(len(size)) for _ in range(2)]
        self.part = np.arange(len(size))  # component of each class: its smallest one
        graph = _Spread(src, dst, len(size))
        while True:
            lower = self.part.copy()
            lower[graph.nodes] = np.minimum(lower[graph.nodes], np.minimum.reduceat(self.part[graph.src], graph.starts))
            lower = lower[lower]
            if (lower == self.part).all():
                break
            self.part = lower

    def _given(self, nodes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All neighbours of `nodes`, each with the value of the node it was reached from."""
        count = self.at[nodes + 1] - self.at[nodes]
        ends = np.cumsum(count)
        return self.near[np.arange(ends[-1]) + np.repeat(self.at[nodes] - ends + count, count)], np.repeat(values, count)

    @staticmethod
    def _summed(nodes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, place = np.unique(nodes, return_inverse=True)
        return found, np.bincount(place, values, len(found))

    def shares(self, s: int, t: int) -> tuple[np.ndarray, np.ndarray]:
        """(classes, share): the share of the shortest paths from a member of s to one of t, another one if s is t, that pass a member of each class; ends left out."""
        none = np.zeros(0, np.int64), np.zeros(0)
        if s == t:
            to = self.near[self.at[s]:self.at[s + 1]]
            return to, np.full(len(to), 1.0 / self.size[to].sum())
        if self.part[s] != self.part[t]:
            return none
        levels = [[np.array([end])] for end in (s, t)]
        for side, end in enumerate((s, t)):
            self.depth[side][end], self.paths[side][end] = 0, 1.0
        try:
            meet = none[0]
            while not len(meet):
                wide = [(self.at[fronts[-1] + 1] - self.at[fronts[-1]]).sum() for fronts in levels]
                side = int(wide[1] < wide[0])
                depth, paths, front = self.depth[side], self.paths[side], levels[side][-1]
                to, given = self._given(front, paths[front] * (self.size[front] if len(levels[side]) > 1 else 1.0))
                fresh = depth[to] < 0
                level, summed = self._summed(to[fresh], given[fresh])
                depth[level], paths[level] = len(levels[side]), summed
                levels[side].append(level)
                meet = level[self.depth[1 - side][level] >= 0]
            size = np.where((meet == s) | (meet == t), 1.0, self.size[meet])
            both = self.paths[0][meet] * self.paths[1][meet]
            total = (both * size).sum()
            found = [(meet, both / total)]
            for side in range(2):
                nodes, tail = meet, self.paths[1 - side][meet] * size
                for at in range(len(levels[side]) - 2, 0, -1):
                    to, given = self._given(nodes, tail)
                    back = self.depth[side][to] == at
                    nodes, tail = self._summed(to[back], given[back])
                    found.append((nodes, self.paths[side][nodes] * tail / total))
                    tail = tail * self.size[nodes]
            nodes, share = (np.concatenate(x) for x in zip(*found))
            inner = (nodes != s) & (nodes != t)
            return nodes[inner], share[inner]
        finally:
            for side in range(2):
                self.depth[side][np.concatenate(levels[side])] = -1


class Walker:
    """Searches from chosen classes over a broadcast list of `edges(src, dst, size)`, checked as for `block_metrics` and sent once."""

    def __init__(self, edges: DataFrame):
        arrays = _arrays(edges)
        self.shared = edges.sparkSession.sparkContext.broadcast(arrays)
        self.step = _step(len(arrays[1]))

    def shares(self, pairs: DataFrame) -> DataFrame:
        """(class, s1, s2): shares of the shortest paths that pass a member, and their squares, summed over `pairs(s, t)` of classes."""
        shared = self.shared

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, a, b, size = shared.value
            graph, one, two = None, np.zeros(len(names)), np.zeros(len(names))
            for batch in batches:
                ends = [np.searchsorted(names, np.asarray(batch.column(c).to_pylist(), dtype=object)) for c in ("s", "t")] if batch.num_rows else [[], []]
                for s, t in zip(*ends):
                    graph = graph or _Pairs(a, b, size)
                    nodes, share = graph.shares(s, t)
                    one[nodes] += share
                    two[nodes] += share**2
            used = np.flatnonzero(one)
            yield pa.RecordBatch.from_arrays([pa.array(names[used], type=pa.string()), pa.array(one[used]), pa.array(two[used])], names=["class", "s1", "s2"])

        parts = pairs.repartition(2 * pairs.sparkSession.sparkContext.defaultParallelism).mapInArrow(walk, "class string, s1 double, s2 double")
        return parts.groupBy("class").agg(F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))

    def sums(self, starts: DataFrame) -> DataFrame:
        """(class, s1): dependencies of a member, summed over `starts(class, times)`."""
        shared, step = self.shared, self.step

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, a, b, size = shared.value
            graph, one = None, np.zeros(len(names))
            for batch in batches:
                wanted = np.asarray(batch.column("class").to_pylist(), dtype=object)
                at = np.searchsorted(names, wanted) if len(wanted) else np.zeros(0, np.int64)
                times = batch.column("times").to_numpy()
                if len(at) and graph is None:
                    graph = _Spread(a, b, len(names))
                    degree = graph.add(size[None])[0]
                for i in range(0, len(at), step):
                    one += times[i:i + step] @ _dependencies(graph, at[i:i + step], size, degree)
            used = np.flatnonzero(one)
            yield pa.RecordBatch.from_arrays([pa.array(names[used], type=pa.string()), pa.array(one[used])], names=["class", "s1"])

        tasks = 4 * starts.sparkSession.sparkContext.defaultParallelism
        parts = starts.repartition(tasks).mapInArrow(walk, "class string, s1 double")
        return parts.groupBy("class").agg(F.sum("s1").alias("s1"))
