"""Graph metrics against brute force on small graphs, for the block form and the join form."""

import itertools
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from pinchgraph.operators import graph, risk

MICRO = {
    "path": (["a", "b", "c", "d"], [("a", "b"), ("b", "c"), ("c", "d")]),
    "cycle": (list("abcde"), [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "a")]),
    "star": (list("abcde"), [("a", x) for x in "bcde"]),
    "two_triangles_and_more": (
        list("abcdefghij"),
        [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "c"), ("f", "g"), ("g", "h"), ("i", "i")]),
    "random": (
        [f"n{i:02d}" for i in range(14)],
        sorted({tuple(random.Random(5).sample([f"n{i:02d}" for i in range(14)], 2)) for _ in range(1)} |
               {(f"n{a:02d}", f"n{b:02d}") for a, b in itertools.combinations(range(14), 2) if random.Random(a * 31 + b).random() < 0.16})),
}


def neighbours(nodes, edges):
    adj = {n: set() for n in nodes}
    for a, b in edges:
        if a != b:
            adj[a].add(b)
            adj[b].add(a)
    return adj


def bfs(adj, s, gone=None):
    dist, sigma, q = {s: 0}, {s: 1}, deque([s])
    while q:
        v = q.popleft()
        for w in adj[v]:
            if w == gone:
                continue
            if w not in dist:
                dist[w], sigma[w] = dist[v] + 1, 0
                q.append(w)
            if dist[w] == dist[v] + 1:
                sigma[w] += sigma[v]
    return dist, sigma


def brute_betweenness(nodes, edges):
    adj = neighbours(nodes, edges)
    info = {s: bfs(adj, s) for s in nodes}
    out = {}
    for v in nodes:
        total = 0.0
        for s, t in itertools.permutations(nodes, 2):
            if v in (s, t) or t not in info[s][0] or v not in info[s][0]:
                continue
            if info[s][0][v] + info[v][0].get(t, 10**9) == info[s][0][t]:
                total += info[s][1][v] * info[v][1][t] / info[s][1][t]
        out[v] = total / ((len(nodes) - 1) * (len(nodes) - 2))
    return out


def brute_points(nodes, edges):
    adj = neighbours(nodes, edges)

    def parts(left):
        left, n = set(left), 0
        while left:
            s = left.pop()
            seen, stack = {s}, [s]
            while stack:
                for w in adj[stack.pop()]:
                    if w in left and w not in seen:
                        seen.add(w)
                        stack.append(w)
            left -= seen
            n += 1
        return n

    whole = parts(nodes)
    return {v for v in nodes if parts(set(nodes) - {v}) > whole}


def frames(spark, nodes, edges):
    n = spark.createDataFrame([(x,) for x in nodes], "node_id string")
    e = spark.createDataFrame(edges, "src string, dst string")
    return n, graph.adjacency(e)


@pytest.mark.parametrize("name", list(MICRO))
def test_block_form(spark, name):
    nodes, edges = MICRO[name]
    n, adj = frames(spark, nodes, edges)
    got = {r.node_id: r for r in graph.node_centrality(n, adj).collect()}
    want = brute_betweenness(nodes, edges)
    assert set(got) == set(nodes)
    for v in nodes:
        assert got[v].betweenness == pytest.approx(want[v], abs=1e-9)
    assert {v for v in nodes if got[v].is_articulation_point} == brute_points(nodes, edges)


@pytest.mark.parametrize("name", ["two_triangles_and_more", "random"])
def test_join_form(spark, name):
    nodes, edges = MICRO[name]
    n, adj = frames(spark, nodes, edges)
    got = {r.node_id: r for r in graph.node_centrality(n, adj, max_rows=0).collect()}
    want = brute_betweenness(nodes, edges)
    for v in nodes:
        assert got[v].betweenness == pytest.approx(want[v], abs=1e-9)
    assert {v for v in nodes if got[v].is_articulation_point} == brute_points(nodes, edges)


def test_components(spark):
    nodes, edges = MICRO["two_triangles_and_more"]
    n, adj = frames(spark, nodes, edges)
    got = {r.node_id: r.component for r in graph.components(n, adj).collect()}
    assert got == {**{x: "a" for x in "abcde"}, **{x: "f" for x in "fgh"}, "i": "i", "j": "j"}


def test_no_edges(spark):
    n = spark.createDataFrame([("a",), ("b",)], "node_id string")
    adj = graph.adjacency(spark.createDataFrame([], "src string, dst string"))
    assert {(r.betweenness, r.is_articulation_point) for r in graph.node_centrality(n, adj).collect()} == {(0.0, False)}


def test_suppliers_count_self_loops_and_relations_once(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "b"), ("c", "b")], "src string, dst string")
    assert {(r.node_id, r.num_suppliers) for r in graph.supplier_counts(e).collect()} == {("b", 3)}


def test_risk_score_of_a_star(spark):
    nodes = spark.createDataFrame(
        [("a", "A", "Company", 0.0), ("b", "B", "Company", 1.0), ("c", "C", "Material", None), ("x", "X", "Person", 1.0)],
        "node_id string, name string, label string, criticality double")
    edges = spark.createDataFrame(
        [("b", "a", "PRODUCES"), ("c", "a", "USES"), ("b", "a", "USES"), ("a", "x", "USES"), ("b", "c", "LIKES")],
        "src string, dst string, relation string")
    got = {r.node_id: r for r in risk.node_metrics(nodes, edges).collect()}
    assert set(got) == {"a", "b", "c"}
    a = got["a"]  # betweenness 1 of the path b-a-c, two suppliers, zero criticality counts 0.5, articulation point
    assert (a.betweenness, a.num_suppliers, a.concentration, a.is_articulation_point) == (1.0, 2, 0.5, True)
    assert a.srs_score == pytest.approx(min(1.0, 0.4 + 0.175 + 0.125 + 0.2))
    assert got["b"].srs_score == pytest.approx(0.25)
    assert got["c"].srs_score == pytest.approx(0.125)


def test_what_if_compares_remaining_nodes(spark):
    nodes = spark.createDataFrame([(x, x, "Company", 0.5) for x in "abcd"], "node_id string, name string, label string, criticality double")
    edges = spark.createDataFrame([("a", "b", "USES"), ("b", "c", "USES"), ("c", "d", "USES")], "src string, dst string, relation string")
    before = risk.node_metrics(nodes, edges)
    got = {r.node_id: r for r in risk.what_if(nodes, edges, before, "b").collect()}
    assert set(got) == {"a", "c", "d"}
    assert got["c"].was_ap and not got["c"].now_ap
    assert got["c"].delta < 0
    s = risk.what_if_summary(risk.what_if(nodes, edges, before, "b")).first()
    assert (s.nodes_remaining, s.old_ap_count, s.new_ap_count) == (3, 1, 0)


def test_pivots_over_all_nodes_equal_exact(spark):
    nodes, edges = MICRO["cycle"]
    n, adj = frames(spark, nodes, edges)
    exact = {r.node_id: r.betweenness for r in graph.betweenness(n, adj).collect()}
    assert exact == {r.node_id: r.betweenness for r in graph.betweenness(n, adj, pivots=n.select(F.col("node_id"))).collect()}


def blocks_by_brute_force(nodes, edges):
    """Blocks as classes of edges: two edges share a block if removing any one node leaves them joined."""
    import itertools

    edges = sorted({tuple(sorted(e)) for e in edges if e[0] != e[1]})
    parts = []
    for e in edges:
        for p in parts:
            if any(_together(e, f, edges) for f in p):
                p.append(e)
                break
        else:
            parts.append([e])
    merged = True
    while merged:
        merged = False
        for p, q in itertools.combinations(parts, 2):
            if any(_together(e, f, edges) for e in p for f in q):
                p += q
                parts.remove(q)
                merged = True
                break
    return {frozenset(v for e in p for v in e) for p in parts}


def _together(e, f, edges):
    """Whether edges e and f lie on a common cycle: two paths without a common node join their ends."""
    if e == f:
        return True
    shared = set(e) & set(f)
    if shared:
        (v,) = shared
        a, b = (set(e) - shared).pop(), (set(f) - shared).pop()
        return _reach(a, b, [x for x in edges if v not in x])
    return all(_reach_sets(set(e) - {v}, set(f) - {v}, [x for x in edges if v not in x and x not in (e, f)]) for v in {u for x in edges for u in x})


def _reach_sets(a, b, edges):
    return any(_reach(x, y, edges) for x in a for y in b)


def _reach(a, b, edges):
    seen, todo = {a}, [a]
    while todo:
        v = todo.pop()
        for x, y in edges:
            for p, q in ((x, y), (y, x)):
                if p == v and q not in seen:
                    seen.add(q)
                    todo.append(q)
    return b in seen


LADDER = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "d"), ("f", "g"), ("h", "i"), ("i", "i"), ("e", "k"), ("k", "l"), ("l", "e"), ("d", "k")]


def test_block_cut_tree_before_and_after_removals(spark):
    names = sorted({v for e in LADDER for v in e} | {"alone"})
    n = spark.createDataFrame([(v,) for v in names], "node_id string")
    adj = graph.adjacency(spark.createDataFrame(LADDER, "src string, dst string"))
    tree = graph.block_cut_tree(n, adj)
    of = lambda t: {frozenset(r.nodes) for r in t.members.groupBy("block").agg(F.collect_set("node_id").alias("nodes")).collect()}
    assert of(tree) == blocks_by_brute_force(names, LADDER)
    assert tree.edges.count() == tree.rows == 2 * 13 and tree.edges.where("block is null").count() == 0
    for gone in ("d", "a", "i", "alone"):
        left = [e for e in LADDER if gone not in e]
        after = tree.without(gone)
        assert of(after) == blocks_by_brute_force(names, left)
        touched = tree.edges.join(tree.members.where(F.col("node_id") == gone), "block", "left_semi").where((F.col("src") != gone) & (F.col("dst") != gone)).count()
        assert after.rows == touched < tree.rows  # rows searched again: those of the node's own blocks
        points = {r.node_id for r in after.articulation_points().collect()}
        assert points == {r.node_id for r in graph.articulation_points(n.where(F.col("node_id") != gone), graph.adjacency(spark.createDataFrame(left, "src string, dst string"))).collect()}
    assert graph.block_cut_tree(n, adj.limit(0)).articulation_points().count() == 0


@pytest.mark.parametrize("max_rows", [2_000_000, 0])
def test_sampled_betweenness_keeps_its_bound(spark, max_rows):
    """Two hubs, a chain between them, and many leaves: far fewer sources than nodes, all errors within their bounds."""
    from pinchgraph.operators import sampling

    many = 1_500 if max_rows else 700
    edges = [("hub0", "m1"), ("m1", "m2"), ("m2", "hub1"), *[(f"hub{i % 2}", f"leaf{i}") for i in range(many)], ("leaf0", "leaf0"), ("leaf0", "leaf2")]
    names = sorted({v for e in edges for v in e} | {"alone"})
    n = spark.createDataFrame([(v,) for v in names], "node_id string")
    adj = graph.adjacency(spark.createDataFrame(edges, "src string, dst string"))
    exact = {r.node_id: r.betweenness for r in graph.node_centrality(n, adj).collect()}
    got = sampling.sampled_betweenness(n, adj, error=0.3, first=32, max_rows=max_rows).collect()
    assert {r.node_id for r in got} == set(names)
    assert {r.sources for r in got} <= {256, 512} and all(r.sources < len(names) for r in got)
    assert max(r.error_bound for r in got) <= 0.3
    assert all(abs(r.betweenness - exact[r.node_id]) <= r.error_bound for r in got)
    assert next(r for r in got if r.node_id == "alone").betweenness == 0.0


def test_sampled_betweenness_ends_exact(spark):
    """An error that sampling cannot reach with fewer sources than nodes gives all of them."""
    from pinchgraph.operators import sampling

    names = sorted({v for e in LADDER for v in e} | {"alone"})
    n = spark.createDataFrame([(v,) for v in names], "node_id string")
    adj = graph.adjacency(spark.createDataFrame(LADDER, "src string, dst string"))
    exact = {r.node_id: r.betweenness for r in graph.node_centrality(n, adj).collect()}
    for max_rows in (2_000_000, 0):
        got = sampling.sampled_betweenness(n, adj, error=0.01, first=4, max_rows=max_rows).collect()
        assert {(r.error_bound, r.sources) for r in got} == {(0.0, len(names))}
        assert {r.node_id: r.betweenness for r in got} == pytest.approx(exact, abs=1e-9)
    assert {r.betweenness for r in sampling.sampled_betweenness(n, adj.limit(0)).collect()} == {0.0}


@pytest.mark.parametrize("max_rows", [2_000_000, 0])
def test_twins_share_their_searches(spark, max_rows):
    """Many companies with the same country and product: one class each, and results as by brute force."""
    companies = [(f"c{i:03d}", f"geo{i % 2}", f"tech{i % 3}") for i in range(36)]
    edges = [*[(c, g) for c, g, _ in companies], *[(c, t) for c, _, t in companies], ("geo0", "region"), ("geo1", "region"), *[("hub", f"leaf{i}") for i in range(4)], ("hub", "region"), ("pair0", "pair1")]
    nodes = sorted({v for e in edges for v in e})
    n, adj = frames(spark, nodes, edges)
    found = graph.twins(adj)
    assert found.classes().count() == 6 + 2 + 3 + 1 + 2 + 2 and found.edges.rows < adj.count() / 4
    got = {r.node_id: r for r in graph.node_centrality(n, adj, max_rows=max_rows).collect()}
    assert {v: got[v].betweenness for v in nodes} == pytest.approx(brute_betweenness(nodes, edges), abs=1e-9)
    assert {v for v in nodes if got[v].is_articulation_point} == brute_points(nodes, edges)


@pytest.mark.parametrize("max_rows", [2_000_000, 0])
def test_pairs_share_their_paths(spark, max_rows):
    """Shares of the shortest paths between every two nodes, twins too, add up to the betweenness by brute force, however the ends are searched."""
    from pinchgraph.operators import sampling
    from pinchgraph.operators.graph_blocks import Walker

    edges = [*LADDER, *[("hub", f"leaf{i}") for i in range(4)], *[(f"c{i}", g) for i in range(3) for g in ("x", "y")], ("x", "z"), ("z", "hub"), ("pair0", "pair1")]
    names = sorted({v for e in edges for v in e})
    n, adj = frames(spark, names, edges)
    classes = graph.twins(adj.where("src <> dst").distinct())
    of = {r.node_id: r["class"] for r in classes.members.collect()}
    every = [(i, of[s], of[t]) for i, (s, t) in enumerate((s, t) for s in names for t in names if s != t and s in of and t in of)]
    pairs = spark.createDataFrame(every, "pair long, s string, t string")
    if max_rows:
        rows = Walker(classes.edges.df).shares(pairs).collect()
        sums = {r["class"]: r.s1 for r in rows}
    else:
        shares = sampling.path_shares(classes.edges.df, pairs).collect()
        assert len({(r.pair, r.node) for r in shares}) == len(shares)
        sums = {}
        for r in shares:
            sums[r.node] = sums.get(r.node, 0.0) + r.share
    scale = (len(names) - 1) * (len(names) - 2)
    assert {v: sums.get(of.get(v), 0.0) / scale for v in names} == pytest.approx(brute_betweenness(names, edges), abs=1e-9)


def test_a_pair_leaves_most_of_the_graph_unread():
    """Two ends in a hall of stars meet after the neighbours of both; a search per source read every row at each level."""
    import numpy as np
    from pinchgraph.operators.graph_blocks import _Pairs

    rng = np.random.default_rng(3)
    a, b = np.unique(np.stack([rng.integers(0, 100, 60_000), rng.integers(100, 2_100, 60_000)]), axis=1)
    pairs, read = _Pairs(np.r_[a, b], np.r_[b, a], np.ones(2_100)), []
    given = pairs._given
    pairs._given = lambda nodes, values: (read.append(len(nodes)), given(nodes, values))[1]
    for s, t in rng.integers(0, 2_100, (50, 2)):
        pairs.shares(int(s), int(t))
    assert sum(read) < 50 * 2_100 / 10


def test_adjacency_reads_its_edges_once(spark):
    rows = [("a", "b"), ("b", "a"), ("a", "b"), ("c", "c"), ("c", "c"), (None, "a"), ("a", None), (None, None), ("b", "c")]
    edges = spark.createDataFrame(rows, "src string, dst string")
    got = graph.adjacency(edges)
    assert sorted(map(str, got.collect())) == sorted(map(str, edges.union(edges.select("dst", "src")).distinct().collect()))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_sampled_searches_join_numbers(spark, monkeypatch):
    """Every step after the first reads ids of 64 bits and each pair of neighbours is written once; ids that meet are given up."""
    from pinchgraph.operators import sampling

    names = [f"n{i:03d}" for i in range(400)]
    n = spark.createDataFrame([(v,) for v in [*names, "n000", None]], "node_id string")
    adj = graph.adjacency(spark.createDataFrame([(names[i], names[i * 7 % 400]) for i in range(400)] + [(a, b) for a, b in zip(names, names[1:])], "src string, dst string"))
    pairs = adj.where("src < dst").count()
    seen, written = [], {}
    monkeypatch.setattr(sampling, "path_shares", lambda edges, pairs, f=sampling.path_shares: seen.append(edges) or f(edges, pairs))
    monkeypatch.setattr(sampling, "materialize", lambda df, tag, f=sampling.materialize, **m: written.setdefault(tag, f(df, tag, **m)) if tag == "sample-edges" else f(df, tag, **m))
    got = sampling.sampled_betweenness(n, adj, error=0.9, first=64, max_rows=0)
    by_walker = sampling.sampled_betweenness(n, adj, error=0.9, first=64)
    rows = lambda df: sorted((r.node_id or "", r.betweenness, round(r.error_bound, 9), r.sources) for r in df.collect())
    assert rows(got) == rows(by_walker) and len(rows(got)) == 402
    assert seen and all(kind == "bigint" for e in seen for name, kind in e.dtypes if name in ("src", "dst"))
    assert written["sample-edges"].rows == pairs

    real = F.xxhash64
    calls = []

    def weak(*columns):  # the first seed gives all names one id
        calls.append(1)
        return F.lit(7).cast("long") if len(calls) == 1 else real(*columns)

    monkeypatch.setattr(sampling.F, "xxhash64", weak)
    of = sampling._ids(n)
    monkeypatch.setattr(sampling.F, "xxhash64", real)
    assert n.select(of("node_id")).distinct().count() == 401


def test_classes_without_twins_keep_the_edges(spark):
    adj = graph.adjacency(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("a", "c")], "src string, dst string"))
    found = graph.twins(adj)
    assert {(r.src, r["dst"], r["size"]) for r in found.edges.df.collect()} == {(r.src, r.dst, 1) for r in adj.collect()}
    assert found.edges.rows == 10 and {(r.node_id, r["class"], r["size"]) for r in found.members.collect()} == {(c, c, 1) for c in "abcde"}
