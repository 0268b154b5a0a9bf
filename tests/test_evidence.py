"""The evidence fold against a plain walk, and hypothesis rules."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pinchgraph.operators import ach
from pinchgraph.operators import hypotheses as hyp

T0 = datetime(2024, 1, 1)
AS_OF = datetime(2024, 1, 31)
EV = "hypothesis_id string, doc_uid string, ts timestamp, supports boolean"
HYP = ("id string, node_id string, node_name string, statement string, confidence double, status string, awareness_layer int, "
       "ach_reviewed boolean, srs_score_at_creation double, created_at timestamp, updated_at timestamp")


def walk(c, rows):
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        c = min(c + 0.05, 0.95) if r[3] else max(c - 0.08, 0.05)
    return c


def hyps(spark, rows):
    return spark.createDataFrame(
        [(i, n, f"node {n}", "Claim on Gallium Output", c, s, layer, rev, 0.5, T0, T0) for i, n, c, s, layer, rev in rows], HYP)


@pytest.mark.parametrize("chunk", [2, 4096])
def test_fold_equals_walk(spark, monkeypatch, chunk):
    monkeypatch.setattr(hyp, "CHUNK", chunk)
    rng = random.Random(3)
    rows = [(f"h{i % 3 if i % 2 else 0}", f"d{i:03d}", T0 + timedelta(minutes=rng.randrange(200)), rng.random() < 0.5) for i in range(300)]
    rng.shuffle(rows)
    h = hyps(spark, [(f"h{i}", "n", 0.4 + i / 10, "active", 1, False) for i in range(4)])
    got = {r.id: r for r in hyp.apply_evidence(h, spark.createDataFrame(rows, EV)).collect()}
    for i in range(4):
        mine = [r for r in rows if r[0] == f"h{i}"]
        assert got[f"h{i}"].confidence == pytest.approx(walk(0.4 + i / 10, mine), abs=1e-6)
        assert got[f"h{i}"].evidence_for + got[f"h{i}"].evidence_against == len(mine)


def test_chunk_must_match_row_bits():
    assert hyp.CHUNK == 4096  # 12 bits of the 33-bit row number


def test_repeated_evidence_counts_once(spark):
    row = ("h0", "d1", T0, True)
    h = hyps(spark, [("h0", "n", 0.5, "active", 1, False)])
    r = hyp.apply_evidence(h, spark.createDataFrame([row, row, row], EV)).first()
    assert (r.confidence, r.evidence_for) == (0.55, 1)


def test_documents_become_evidence(spark):
    h = hyps(spark, [("h0", "n1", 0.5, "active", 1, False), ("h1", "n1", 0.5, "stale", 1, False), ("h2", "n2", 0.5, "active", 1, False)])
    docs = spark.createDataFrame(
        [("github:org/repo:123456", "New fab expansion", "", T0), ("d2", "Nothing here", None, T0), ("d3", "Old", "shortage", datetime(2023, 1, 1))],
        "uid string, title string, text string, published_at timestamp")
    m = spark.createDataFrame([("github:org/repo:123456", "n1"), ("d2", "n1"), ("d3", "n2"), ("d2", "n1")], "doc_uid string, node_id string")
    got = {(r.hypothesis_id, r.doc_uid): r for r in hyp.document_evidence(h, m, docs).collect()}
    assert set(got) == {("h0", "github:org/repo:123456"), ("h0", "d2"), ("h2", "d3")}
    assert not got["h0", "github:org/repo:123456"].supports and got["h0", "d2"].supports
    assert got["h0", "github:org/repo:123456"].line == "[github:org/r] New fab expansion"
    applied = spark.createDataFrame([("h0", "d2")], "hypothesis_id string, doc_uid string")
    fresh = hyp.unapplied_evidence(h, m, docs, applied, F.lit(AS_OF)).collect()
    assert [(r.hypothesis_id, r.doc_uid) for r in fresh] == [("h0", "github:org/repo:123456")]


def test_candidates_follow_cut_then_filter(spark):
    scores = spark.createDataFrame([(f"n{i}", 0.9 - i / 10) for i in range(8)], "node_id string, srs_score double")
    h = hyps(spark, [("h0", "n1", 0.5, "active", 1, False), ("h1", "n2", 0.5, "falsified", 1, False)])
    got = {r.node_id for r in hyp.select_candidates(scores, h, 3).collect()}
    assert got == {"n0", "n2"}  # n1 is taken and not replaced


def test_generated_answers(spark):
    rows = [("a", '{"statement": " s ", "falsification_criteria": ["1","2","3","4"], "confidence": 0.99}'),
            ("b", '{"statement": "s", "falsification_criteria": ["1"]}'), ("c", "none"),
            ("d", 'x {"statement": "t", "falsification_criteria": ["1","2"]} y')]
    df = spark.createDataFrame([(n, n, 0.6, r) for n, r in rows], "node_id string, node_name string, srs_score double, response string")
    got = {r.node_id: r for r in hyp.parse_generated(df).collect()}
    assert set(got) == {"a", "d"}
    assert (got["a"].statement, got["a"].confidence, got["a"].falsification_criteria) == ("s", 0.85, ["1", "2", "3"])
    assert got["d"].confidence == 0.6
    once = hyp.create(hyp.parse_generated(df), F.lit(AS_OF))
    assert {r.id for r in once.collect()} == {r.id for r in hyp.create(hyp.parse_generated(df), F.lit(AS_OF)).collect()}


def test_windows_at_risk(spark):
    h = hyps(spark, [("a", "n", 0.7, "active", 2, False), ("b", "n", 0.69, "active", 1, False), ("c", "n", 0.9, "active", 3, False)])
    assert [r.id for r in hyp.windows_at_risk(h).collect()] == ["a"]


def test_review_of_a_weak_and_a_strong_hypothesis(spark):
    h = hyps(spark, [("weak", "n", 0.9, "active", 1, False), ("strong", "n", 0.9, "active", 1, False), ("bare", "n", 0.9, "active", 1, False),
                     ("done", "n", 0.9, "active", 1, True)])
    cells = spark.createDataFrame(
        [("weak", 0, 1, "C"), ("weak", 0, 2, "I"), ("weak", 0, 3, "N"), ("strong", 0, 1, "C"), ("strong", 1, 1, "I"), ("strong", 0, 2, "N"), ("strong", 1, 2, "N")],
        "hypothesis_id string, alt_no int, evidence_no int, class string")
    reviews = ach.review(ach.review_candidates(h), cells, F.lit(AS_OF))
    got = {r.hypothesis_id: r for r in reviews.collect()}
    assert set(got) == {"weak", "strong", "bare"}
    assert got["weak"].robustness == pytest.approx(1 / 3) and not got["weak"].passed
    assert got["strong"].robustness == 0.5 and got["strong"].passed
    assert got["bare"].robustness == 0.0 and not got["bare"].passed
    after = {r.id: r.confidence for r in hyp.apply_evidence(h, ach.failed_review_evidence(reviews)).collect()}
    assert after == {"weak": 0.82, "strong": 0.9, "bare": 0.82, "done": 0.9}


def test_classification_is_padded(spark):
    raw = spark.createDataFrame([("h", 0, 'say ["c", " i", "?"] end'), ("h", 1, "nothing")], "hypothesis_id string, alt_no int, response string")
    n = spark.createDataFrame([("h", i) for i in (1, 2, 3, 4)], "hypothesis_id string, evidence_no long")
    got = {(r.alt_no, r.evidence_no): r["class"] for r in ach.classify(raw, n).collect()}
    assert [got[0, i] for i in (1, 2, 3, 4)] == ["C", "I", "N", "N"]
    assert [got[1, i] for i in (1, 2, 3, 4)] == ["N"] * 4


def test_evidence_list_numbers_supporting_first(spark):
    h = hyps(spark, [("a", "n", 0.5, "active", 1, False), ("b", "n", 0.5, "active", 1, False)])
    ev = spark.createDataFrame(
        [("a", "d1", T0, False, "first"), ("a", "d2", T0 + timedelta(hours=5), True, "third"), ("a", "d3", T0 + timedelta(hours=1), True, "second")],
        EV + ", line string")
    got = {(r.hypothesis_id, r.evidence_no): r.line for r in ach.evidence_list(h, ev).collect()}
    assert got == {("a", 1): "second", ("a", 2): "third", ("a", 3): "first", ("b", 1): "Structural risk: SRS=0.50 (graph topology)"}
