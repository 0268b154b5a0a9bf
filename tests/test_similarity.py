"""Clusters of vectors against all pairs."""

import numpy as np
import pytest

from pinchgraph.operators import calibration, similarity

SCHEMA = "uid string, embedding array<float>"


def brute(rows, threshold):
    names = [k for k, v in rows]
    usable = [v is not None and None not in v and any(v) for _, v in rows]
    u = np.array([np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if ok else np.zeros(8) for (_, v), ok in zip(rows, usable)])
    near = (u @ u.T >= threshold) & np.outer(usable, usable)
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if near[i, j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for g, k in zip(group, names):
        least[g] = min(k, least.get(g, k))
    return {k: least[g] for g, k in zip(group, names)}, near


def clouds(n, seed, spread):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, 8))
    return [(f"u{i:04d}", [float(x) for x in (centres[i % 12] + spread * rng.standard_normal(8)).astype(np.float32)]) for i in range(n)]


@pytest.mark.parametrize("n,tile,plan", [(300, 2_048, None), (900, 2_048, None), (300, 16, (0, 1)), (300, 40, (2, 30))])
def test_clusters_equal_all_pairs(spark, n, tile, plan):
    """Clouds, a third of the rows in copies of one direction at other lengths, vectors without direction; crowded buckets go in tiles."""
    rows = clouds(n, n, 0.2)
    rows += [(f"v{i:04d}", [float(x) * (1 + i % 3) for x in (1, 2, 0, 0, -1, 0, 0, 3)]) for i in range(n // 2)]
    rows += [("w1", None), ("w2", [0.0] * 8), ("w3", [1.0, None, *[0.0] * 6])]
    want, _ = brute(rows, 0.95)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.uid: r.cluster for r in similarity.similar_clusters(df, "uid", 0.95, recall=0.99999, tile=tile, per_table=plan).collect()}
    assert got == want


def test_key_recall_is_as_planned():
    """The share of pairs at the threshold that share a key, measured over 2,000 random pairs."""
    for n, threshold, recall in [(100_000, 0.9, 0.95), (2_000_000, 0.85, 0.9), (5_000, 0.5, 0.99)]:
        bits, tables = similarity.key_plan(n, threshold, recall)
        rng = np.random.default_rng(n)
        a = rng.standard_normal((2_000, 64))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b = rng.standard_normal(a.shape)
        b -= (a * b).sum(1, keepdims=True) * a
        b = threshold * a + np.sqrt(1 - threshold**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
        planes = rng.standard_normal((64, bits * tables))
        same = ((a @ planes > 0) == (b @ planes > 0)).reshape(2_000, tables, bits).all(2).any(1)
        assert same.mean() >= recall - 0.02


def test_topics(spark):
    rows = [("o1", "pending", "2024-01-05", "N1", [1.0, 0.0]), ("o2", "pending", "2024-01-02", "N2", [0.99, 0.05]), ("o3", "resolved", "2024-01-01", "N1", [1.0, 0.0]),
            ("o4", "pending", "2024-01-01", None, [0.0, 1.0]), ("o5", "pending", "2024-01-03", "N1", [2.0, 0.0]), ("o6", "pending", "2024-01-03", "N1", None)]
    df = spark.createDataFrame(rows, "uid string, status string, created_at string, best_node string, embedding array<float>")
    got = [tuple(r) for r in calibration.orphan_topics(df).collect()]
    assert got == [("o1", 3, 2, "o2", "2024-01-02", "2024-01-05")]
    assert calibration.orphan_topics(df.limit(0)).count() == 0
