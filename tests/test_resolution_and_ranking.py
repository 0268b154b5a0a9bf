"""Vector routing, orphans, commodity ranking, opportunity score and report rules."""

from datetime import date, datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pinchgraph import storage
from pinchgraph.operators import commodities as com
from pinchgraph.operators import reports, resolution, scoring, vectors

NOW = datetime(2024, 1, 31, 12)
NODES = "node_id string, label string, embedding array<float>"
DOCS = "doc_uid string, embedding array<float>"


def brute_top(docs, nodes, k):
    out = {}
    for uid, v in docs:
        v = np.array(v, dtype=float)
        sims = []
        for nid, _, w in nodes:
            w = np.array(w, dtype=float)
            size = np.linalg.norm(v) * np.linalg.norm(w)
            s = float(v @ w / size) if size else 0.0
            if s > 0:
                sims.append((-s, nid))
        out[uid] = [n for _, n in sorted(sims)[:k]]
    return out


@pytest.mark.parametrize("limit,blocks", [(vectors.MAX_NODE_BYTES, 20_000), (0, 7)])
def test_top_k(spark, monkeypatch, limit, blocks):
    monkeypatch.setattr(vectors, "NODES_PER_BLOCK", blocks)
    monkeypatch.setattr(vectors, "DOCS_PER_BLOCK", blocks)
    rng = np.random.default_rng(1)
    nodes = [(f"n{i:03d}", "Company", rng.normal(size=6).tolist()) for i in range(40)] + [("zero", "Company", [0.0] * 6)]
    docs = [(f"d{i}", rng.normal(size=6).tolist()) for i in range(25)] + [("blank", [0.0] * 6)]
    got = vectors.top_k_nodes(spark.createDataFrame(docs, DOCS), spark.createDataFrame(nodes, NODES), 5, max_node_bytes=limit)
    got = {r.doc_uid: [c.node_id for c in r.candidates] for r in got.collect()}
    assert got == brute_top(docs, nodes, 5)


def test_ties_go_to_the_smaller_node(spark):
    nodes = [(n, "Company", [1.0, 0.0]) for n in ("c", "a", "b")] + [(f"x{i:02d}", "Company", [1.0, 0.5]) for i in range(30)]
    r = vectors.top_k_nodes(spark.createDataFrame([("d", [2.0, 0.0])], DOCS), spark.createDataFrame(nodes, NODES), 4).first()
    assert [c.node_id for c in r.candidates] == ["a", "b", "c", "x00"]


def test_scores_are_held_by_tiles():
    """The memory of a search does not grow with the nodes, and its results are those of whole rows."""
    import tracemalloc

    rng = np.random.default_rng(2)
    docs, nodes = np.round(rng.normal(size=(600, 4)), 1), np.round(rng.normal(size=(30_000, 4)), 1)  # many ties
    names = pa.array([f"n{i:05d}" for i in range(len(nodes))])
    tracemalloc.start()
    got = vectors._candidate_column(docs, nodes, names, names, 10).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20  # whole rows take 144 MB
    for d in range(0, 600, 50):
        scores = docs[d] @ nodes.T
        best = np.argsort(-np.round(scores, 9), kind="stable")[:10]
        assert [c["similarity"] for c in got[d]] == pytest.approx(scores[best].tolist())


def test_no_nodes(spark):
    r = vectors.top_k_nodes(spark.createDataFrame([("d", [1.0])], DOCS), spark.createDataFrame([], NODES)).first()
    assert r.candidates == []


def routed(spark):
    nodes = spark.createDataFrame([("n1", "Company", [1.0, 0.0]), ("n2", "Company", [0.9, 0.1]), ("n3", "Material", [0.0, 1.0])], NODES)
    docs = spark.createDataFrame([("auto", [1.0, 0.0]), ("choose", [0.7, 0.72]), ("below", [-1.0, 0.3]), ("none", [-1.0, -1.0]), ("mute", [0.72, 0.7])], DOCS)
    return resolution.route(vectors.top_k_nodes(docs, nodes, 10), 0.8, 0.55)


def test_three_way_routing(spark):
    got = {r.doc_uid: (r.route, r.best_node) for r in routed(spark).collect()}
    assert got == {"auto": ("auto", "n1"), "choose": ("choose", "n2"), "below": ("below_threshold", "n3"), "none": ("no_candidates", None), "mute": ("choose", "n2")}
    m = {(r.doc_uid, r.node_id) for r in resolution.auto_mentions(routed(spark), F.lit(NOW), 0.8).collect()}
    assert m == {("auto", "n1"), ("auto", "n2")}


def test_choices_and_orphans(spark):
    answers = [("choose", '{"node_id": "id=n3", "confidence": 0.7, "reason": "' + "r" * 300 + '"}'), ("mute", '{"node_id": "n9", "confidence": 0.9}'),
               ("auto", '{"node_id": "n1", "confidence": 0.9}')]
    raw = spark.createDataFrame(answers, "doc_uid string, response string")
    ok = resolution.valid_choices(routed(spark), raw)
    got = ok.collect()
    assert [(r.doc_uid, r.node_id, len(r.reason)) for r in got] == [("choose", "n3", 200)]
    docs = spark.createDataFrame([(u, "t", "x" * 900) for u in ("auto", "choose", "below", "none", "mute")], "uid string, title string, text string")
    o = {r.doc_uid: (r.reason, len(r.text_excerpt)) for r in resolution.orphans(routed(spark), ok, docs, F.lit("2024-01-02").cast("timestamp")).collect()}
    assert o == {"below": ("below_threshold", 500), "none": ("no_candidates", 500), "mute": ("mistral_undecided", 500)}
    assert tuple(resolution.outcomes(routed(spark), ok).first()) == (1, 1, 3, 5)


@pytest.mark.parametrize("answer", ['{"node_id": null, "confidence": 0.9}', '{"node_id": "None", "confidence": 0.9}', '{"node_id": "n3", "confidence": 0.59}', "no", '{"node_id": "n3"}'])
def test_unusable_choices(spark, answer):
    raw = spark.createDataFrame([("choose", answer)], "doc_uid string, response string")
    assert resolution.valid_choices(routed(spark), raw).count() == 0


def test_mention_upsert_keeps_latest(spark):
    s = "doc_uid string, node_id string, confidence double, method string, resolved_at timestamp"
    old = spark.createDataFrame([("d", "n", 0.9, "vector_auto", NOW), ("d", "m", 0.8, "vector_auto", NOW)], s)
    new = spark.createDataFrame([("d", "n", 0.7, "mistral", NOW + timedelta(days=1))], s)
    got = {(r.doc_uid, r.node_id): r.method for r in resolution.upsert_mentions(old, new).collect()}
    assert got == {("d", "n"): "mistral", ("d", "m"): "vector_auto"}


def test_mean_pool(spark):
    df = spark.createDataFrame([("a", [3.0, 0.0]), ("a", [0.0, 4.0]), ("b", [5.0, 0.0]), ("c", [1.0, 0.0]), ("c", [-1.0, 0.0])], "k string, v array<float>")
    got = {r.k: r.v for r in vectors.mean_pool(df, "k", "v").collect()}
    assert got["a"] == pytest.approx([0.6, 0.8]) and got["b"] == [5.0, 0.0] and got["c"] == [0.0, 0.0]


RES = "run_date date, commodity string, position int, supply_stress_score double, parse_error boolean"


def test_rank_and_delta(spark):
    d1, d2, d3 = date(2024, 1, 1), date(2024, 1, 3), date(2024, 1, 4)
    rows = [(d1, "A", 1, 50.0, False), (d1, "B", 2, None, True), (d2, "A", 1, 60.0, False), (d2, "B", 2, 60.0, False), (d2, "C", 3, 70.0, False), (d3, "A", 1, None, True)]
    all_ = com.with_delta_all_runs(com.rank(spark.createDataFrame(rows, RES)))
    got = {(r.run_date, r.commodity): (r["rank"], r.score_delta) for r in all_.collect()}
    assert got == {(d1, "A"): (1, 0.0), (d1, "B"): (None, 0.0), (d2, "C"): (1, 0.0), (d2, "A"): (2, 10.0), (d2, "B"): (3, 60.0), (d3, "A"): (None, 0.0)}
    today = spark.createDataFrame([(d3, "B", 2, 10.0, False)], RES)
    prev = com.previous_run(spark.createDataFrame(rows, RES), F.lit(d3))
    assert com.with_delta(today, prev).first().score_delta == -50.0
    assert [r.commodity for r in com.latest_ranking(all_).collect()] == ["A"]
    assert com.should_run(all_, F.lit(d3)).first().status == "skipped"


def test_articles_follow_alias_order(spark):
    docs = spark.createDataFrame([(f"d{i}", t, "", "s", NOW - timedelta(hours=i)) for i, t in enumerate(
        ["GAllium one", "neon two", "gallium three", "Ga four", "Gallium five", "Gallium six"])] + [("old", "Gallium", "", "s", NOW - timedelta(days=9))],
        "uid string, title string, text string, source string, published_at timestamp")
    dim = spark.createDataFrame([("Gallium", ["Ga", "neon"]), ("Neon", [])], "name string, aliases array<string>")
    got = {(r.commodity, r.position): r.uid for r in com.articles(docs, dim, F.lit(NOW)).collect()}
    assert got == {("Gallium", 1): "d0", ("Gallium", 2): "d2", ("Gallium", 3): "d4", ("Neon", 1): "d1"}


def test_default_dimension(spark):
    dim = com.default_dimension(spark)
    assert dim.count() == 35 and com.dimension(dim).count() == 35
    assert dim.select("sector").distinct().count() == 8
    docs = spark.createDataFrame([("d", "Cocoa prices", "", "s", NOW)], "uid string, title string, text string, source string, published_at timestamp")
    found = {r.commodity for r in com.articles(docs, dim, F.lit(NOW)).collect()}
    assert found == {"Cocoa", "Cobalt"}  # the alias "Co" is a substring of the title (S19)


def test_answers_to_ranking(spark):
    from pinchgraph.plans.flows import answers_to_ranking

    day = date(2024, 1, 4)
    raw = spark.createDataFrame([(day, "Cocoa", "Food", '{"supply_growth_score": 100}'), (day, "Copper", "Base Metals", "none")],
                                "run_date date, commodity string, sector string, response string")
    stored = spark.createDataFrame([(date(2024, 1, 1), "Cocoa", 50.0)], "run_date date, commodity string, supply_stress_score double")
    got = {r.commodity: r for r in answers_to_ranking(raw, com.default_dimension(spark), stored, F.lit(day)).collect()}
    assert (got["Cocoa"].supply_stress_score, got["Cocoa"]["rank"], got["Cocoa"].score_delta) == (57.5, 1, 7.5)
    assert got["Copper"].parse_error and got["Copper"]["rank"] is None and got["Copper"].score_delta == 0.0


def test_many_terms_in_passes(spark, monkeypatch):
    monkeypatch.setattr(com, "TERMS_PER_PASS", 2)
    docs = spark.createDataFrame([("d", "alpha beta gamma delta", "epsilon", "s", NOW)], "uid string, title string, text string, source string, published_at timestamp")
    got = {r.term for r in com.article_matches(docs, ["alpha", "zeta", "gamma", "epsilon", "eta"]).collect()}
    assert got == {"alpha", "gamma", "epsilon"} | {"eta"}  # a substring of beta


def test_opportunity_score(spark):
    s = ("id string, node_id string, node_name string, statement string, status string, confidence double, awareness_layer int, n_criteria int, "
         "srs_score_at_creation double, ach_reviewed boolean, evidence_for long, evidence_against long, created_at timestamp, updated_at timestamp")
    rows = [("a", "n", "n", "s", "active", 0.8, 1, 3, 0.9, True, 3, 1, NOW, NOW), ("b", "n", "n", "s", "active", 0.0, 0, 0, None, None, 0, 0, NOW - timedelta(days=40), None),
            ("c", "n", "n", "s", "stale", 0.9, 9, 9, 1.0, False, 1, 0, None, None)]
    reviews = spark.createDataFrame([("a", 0.5)], "hypothesis_id string, robustness double")
    sc = scoring.score(spark.createDataFrame(rows, s), reviews, F.lit(NOW))
    got = {r.id: r for r in sc.collect()}
    raw = 0.9 * 0.75 * 0.4 + 0.2 + 0.8 * 0.15 + 0.75 * 0.15 + 0.1
    assert got["a"].ops_raw == pytest.approx(raw, abs=1e-4) and got["a"].ops_final == pytest.approx(raw / 2, abs=1e-4) and got["a"].tier == 2
    assert got["b"].ops_raw == pytest.approx(0.5 * 0.75 * 0.4 + 0.5 * 0.15 + 0.01, abs=1e-4)
    assert got["c"].ias == 0.25 and got["c"].recency == 0.5
    assert [r.id for r in scoring.ranked(sc).collect()] == ["a", "b"]
    assert tuple(scoring.summary(sc).first()) == (2, 0, 1, 1, "a", got["a"].ops_final)


def test_risk_trend_counts_older_rows_in_the_baseline(spark):
    born = spark.createDataFrame([(NOW,), (NOW - timedelta(days=2),), (NOW - timedelta(days=40),), (None,)], "created_at timestamp")
    got = reports.risk_trend(born, F.lit(NOW)).orderBy("day").collect()
    assert len(got) == 31 and got[0].cumulative == 1 and got[-1].cumulative == 3 and got[-1].new_daily == 1


def test_snapshot_merges(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 9), ("c", None)], "k string, v int")
    rows = lambda df: sorted((r.k, r.v) for r in df.collect())
    assert rows(storage.insert_ignore(old, new, ["k"])) == [("a", 1), ("b", 2), ("c", None)]
    assert rows(storage.replace_rows(old, new, ["k"])) == [("a", 1), ("b", 9), ("c", None)]
    assert rows(storage.merge_columns(old, new, ["k"])) == [("a", 1), ("b", 9), ("c", None)]


def test_append_run_replaces_its_partition(spark, tmp_path):
    path = str(tmp_path / "runs")
    storage.append_run(spark.createDataFrame([("a", 1), ("b", 2)], "k string, run int"), path, "run")
    storage.append_run(spark.createDataFrame([("c", 2)], "k string, run int"), path, "run")
    assert sorted((r.k, r.run) for r in spark.read.parquet(path).collect()) == [("a", 1), ("c", 2)]


def test_running_offsets(spark):
    df = spark.createDataFrame([("k", 1, "b", 3), ("k", 0, "a", 5), ("k", 1, "c", 2), ("j", 1, "x", 7)], "key string, _salt int, _tie string, v int")
    got = {(r.key, r._tie): r.o for r in storage.running_offsets(df, ["key"], "v", "o").collect()}
    assert got == {("k", "a"): 0, ("k", "b"): 5, ("k", "c"): 8, ("j", "x"): 0}


def test_a_hundred_thousand_terms_in_one_scan(spark):
    """Every term that a plain search finds, each once per document, with overlapping, empty, null and upper-case candidates."""
    words = [f"w{i:05d}x" for i in range(100_000)]
    texts = ["W00001X and w99999xw00002x", "nothing here", None, "w00002x " * 50, "ÄW00003x"]
    docs = spark.createDataFrame([(f"d{i}", "s", "title w00007x" if i == 1 else None, t) for i, t in enumerate(texts)], "uid string, source string, title string, text string").withColumn("published_at", F.lit("2024-01-01").cast("timestamp"))
    terms = spark.createDataFrame([(w,) for w in [*words, "w0000", "", None]], "term string")
    got = com.article_matches(docs, terms)
    want = sorted((f"d{i}", t) for i, x in enumerate(texts) for t in [*words[:10], words[-1], "w0000", ""]
                  if t in ("" if x is None else x.translate({c: c + 32 for c in range(65, 91)})) or t in ("title w00007x" if i == 1 else ""))
    assert sorted((r.uid, r.term) for r in got.collect()) == want
    assert "BatchEvalPython" not in got._jdf.queryExecution().toString()


def test_dimension_notes(spark):
    base = com.default_dimension(spark)
    assert {"description", "key_producers"} <= set(base.columns)
    notes = spark.createDataFrame([(base.first()["name"], "used in chips", "two countries")], "name string, description string, key_producers string")
    got = com.described(base, notes)
    assert got.count() == base.count() and got.where("description = 'used in chips' and key_producers = 'two countries'").count() == 1
