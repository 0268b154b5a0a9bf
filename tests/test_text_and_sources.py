"""Text expressions, JSON repair, mention matching and source normalisers on hand-made rows."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pinchgraph.functions import jsontext, scores, text
from pinchgraph.operators import mentions
from pinchgraph.sources import documents, feeds, filings, papers, taxonomy

NOW = datetime(2024, 1, 31, 12)


def one(spark, expr, **values):
    schema = ", ".join(f"{k} string" for k in values) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(expr.alias("r")).first().r


def test_clean_text(spark):
    raw = "<p>Hello  <b>world</b></p>\n see https://x.org/a?b=1 now " + "y" * 8000
    got = one(spark, text.clean_text("t"), t=raw)
    assert got.startswith("Hello world see now yyy") and len(got) == 7500


@pytest.mark.parametrize("title,body,want", [("Shortage and delay", "", 1.0), ("Expansion", "ban", 0.0), ("partnership", None, -1.0), ("", "", 0.0),
                                             ("bank", "", 1.0), ("tariff backlog new fab", "", pytest.approx(1 / 3))])
def test_evidence_tone(spark, title, body, want):
    got = spark.createDataFrame([(title, body)], "t string, b string").select(text.evidence_tone("t", "b").alias("r")).first().r
    assert got == want


@pytest.mark.parametrize("line,want", [("[github:a] x", "GitHub"), ("[rss_nyt_tech:1] x", "NYT"), ("[rss_eetimes:1]", "RSS"), ("[jobs_lever:1] x", "Job Posting"),
                                       ("no", "Unknown"), ("[x", "Unknown"), ("", "Unknown")])
def test_source_class(spark, line, want):
    assert one(spark, text.source_class("t"), t=line) == want


def test_chunks(spark):
    assert one(spark, text.chunks(F.col("t")), t="  ") == [" "]
    assert one(spark, text.chunks(F.col("t")), t="a" * 2000) == ["a" * 2000]
    got = one(spark, text.chunks(F.col("t")), t="abc" * 1300)
    assert [len(c) for c in got] == [2000, 2000, 300] and got[1] == ("abc" * 1300)[1800:3800]


def test_watch_keywords(spark):
    got = one(spark, text.watch_keywords(F.col("n"), F.col("s")), n="Neon", s="Neon from Ukraine and US Of Ab; Ukraine Gas McDonald Eight Nine Tenth Eleven Twelve")
    assert got == ["Neon", "Ukraine", "Gas", "Eight", "Nine", "Tenth", "Eleven", "Twelve"]
    assert one(spark, text.watch_keywords(F.col("n"), F.col("s")), n="", s="Only Words") == ["Only", "Words"]


def test_node_type_and_days(spark):
    assert [one(spark, text.node_type("t"), t=t) for t in ("COMP-001", "Gallium", "")] == ["COMP", "Gal", "—"]
    df = spark.createDataFrame([(datetime(2024, 1, 30, 13),), (None,), (datetime(2024, 2, 1),)], "t timestamp")
    assert [r.d for r in df.select(text.days_since("t", F.lit(NOW)).alias("d")).collect()] == [0, 999, -1]


@pytest.mark.parametrize("raw,want", [
    ('```json\n{"a": 1}\n```', "1"), ('x {"a": 2} y', "2"), ('{"a": 3, "b": {"c": 1}', "3"), ('{"a": {"b": [{"c": 4}', None), ("none", None), ("} {", None), (None, None)])
def test_fenced_object(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(jsontext.field(jsontext.fenced_object(F.col("t")), "a").alias("r")).first().r == want


@pytest.mark.parametrize("raw,want", [("77.9", 77), ("-3", 0), ("500", 100), ("abc", 50), (None, 50), ("Infinity", 50), ("NaN", 50), (" 12 ", 12)])
def test_sub_score(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(scores.sub_score(F.col("t")).alias("r")).first().r == want


@pytest.mark.parametrize("raw,want", [("Bearish.", "bearish"), ("quite negative", "bearish"), ("constructive tone", "bullish"), ("deficit", "bearish"), ("recovery", "bullish"),
                                      ("mixed", "neutral"), (None, "neutral"), ("?", "neutral"), ("demand may ease", "bullish")])
def test_outlook(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(scores.outlook(F.col("t")).alias("r")).first().r == want


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_mentions_small_and_large_dictionary(spark, monkeypatch, limit):
    monkeypatch.setattr(mentions, "BROADCAST_BYTES", limit)
    docs = spark.createDataFrame([
        ("d1", "TSMC and Applied Materials, ASML's EUV tools; S.O.I. wafers"), ("d2", "applied  materials; aTSMC TSMC_2 asml"), ("d3", ""), ("d4", "Über-Gas und gas+x")],
        "uid string, text string")
    names = spark.createDataFrame([(n,) for n in ("TSMC", "Applied Materials", "ASML", "EUV tools", "S.O.I.", "ab", "gas", "Über", "+++", "gas+x")], "name string")
    got = {}
    for r in mentions.find_mentions(docs, names).collect():
        got.setdefault(r.uid, set()).add(r.name)
    assert got == {"d1": {"TSMC", "Applied Materials", "ASML", "EUV tools"}, "d2": {"ASML"}, "d4": {"gas", "Über", "gas+x"}}


def test_process_batch_falls_back_to_title(spark):
    docs = spark.createDataFrame([("d1", "TSMC news", ""), ("d2", "x", "plain <b>ASML</b>")], "uid string, title string, text string")
    names = spark.createDataFrame([("TSMC",), ("ASML",)], "name string")
    got = {r.uid: (r.text, r.candidate_entities) for r in mentions.process_batch(docs, names).collect()}
    assert got == {"d1": ("TSMC news", ["TSMC"]), "d2": ("plain ASML", ["ASML"])}


def test_document_table(spark):
    rows = [("a", "t" * 600, "x" * 9000, 1), ("a", "second", "y", 2), ("b", "t", "x", 3), ("k", "known", "x", 4)]
    docs = spark.createDataFrame(rows, "uid string, title string, text string, arrival int")
    known = spark.createDataFrame([("k",)], "uid string")
    got = {r.uid: r for r in documents.dedup_insert(known, docs, "arrival").collect()}
    assert set(got) == {"a", "b"} and len(got["a"].title) == 512 and len(got["a"].text) == 8000
    again = documents.dedup_insert(docs, docs, "arrival")
    assert again.count() == 0


def test_filings(spark):
    payload = json.dumps({"filings": {"recent": {
        "form": ["8-K", "S-1", "10-Q", "10-K", "8-K"], "filingDate": ["2024-01-05", "2023-01-01", "2024-01-02", "2023-12-01", "2024-01-01"],
        "accessionNumber": ["1-1", "1-2", "1-3", "1-4", "1-5"], "primaryDocument": ["a", "b", "c", "d"]}}})
    df = spark.createDataFrame([("Co", "0000000012", payload)], "company string, cik string, payload string")
    got = filings.recent_filings(df, F.lit("2024-01-01")).collect()
    assert [(r.form, r.accession) for r in got] == [("8-K", "1-1"), ("10-Q", "1-3")]  # stops at the stale 10-K
    assert got[0].url == "https://www.sec.gov/Archives/edgar/data/12/11/a"


def test_snippet(spark):
    body = "<i>" + "a" * 300 + " shortage " + "b" * 900 + " TSMC</i>"
    got = one(spark, filings.risk_snippet(F.col("t")), t=body)
    assert len(got) == 700 and "shortage" in got
    assert one(spark, filings.risk_snippet(F.col("t"), ["TSMC"]), t=body) == ("a" * 300 + " shortage " + "b" * 900)[:1000]
    assert "TSMC" in one(spark, filings.risk_snippet(F.col("t"), ["TSMC"], True), t=body)


@pytest.mark.parametrize("raw,want", [("Tue, 02 Jan 2024 03:04:05 GMT", "2024-01-02 03:04:05"), ("2 Jan 2024 03:04:05 +0200", "2024-01-02 01:04:05"),
                                      ("2024-01-02T03:04:05.123Z", "2024-01-02 03:04:05"), ("soon", None), (None, None)])
def test_feed_date(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "t string").select(F.date_format(feeds.feed_date(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("r")).first().r
    assert got == want


def test_incomplete_papers_are_dropped(spark):
    ok = "<entry><id>http://arxiv.org/abs/1.2</id><title>T</title><summary>S</summary><published>2024-01-01T00:00:00Z</published></entry>"
    df = spark.createDataFrame([(ok, "cs.AR"), (ok.replace("<summary>S</summary>", ""), "cs.AR")], "entry string, category string")
    got = papers.papers(df).collect()
    assert [r.uid for r in got] == ["arxiv:1.2"] and json.loads(got[0].metadata)["authors"] == []


def test_taxonomy(spark):
    payload = json.dumps({
        "concepts": [{"id": "A", "label": "Company", "name": "a", "properties": {"s": "x", "n": 1, "b": True, "l": [1], "o": {"k": 1}, "z": None}}, {"id": "B", "label": "Material", "name": "b"}],
        "edges": [{"source": "A", "target": "B", "relation": "USES"}, {"source": "A", "target": "Z", "relation": "USES"}]})
    p = spark.createDataFrame([(payload,)], "payload string")
    c, e = taxonomy.concepts(p), taxonomy.edges(p)
    props = {r.id: r.p for r in c.select("id", taxonomy.primitive_properties(F.col("properties")).alias("p")).collect()}
    assert props == {"A": {"s": "x", "n": "1", "b": "true"}, "B": {}}
    assert [(r.source, r.target) for r in taxonomy.broken_edges(e, c).collect()] == [("A", "Z")]
    assert taxonomy.valid_edges(e, c).count() == 1
    got = {(r.metric, r.key): r.n for r in taxonomy.integrity(c, e).collect()}
    assert got == {("label", "Company"): 1, ("label", "Material"): 1, ("broken", ""): 1}
    old = spark.createDataFrame([("Company", "A", "old", "d")], "label string, id string, name string, description string")
    new = c.select("label", "id", "name", F.lit(None).cast("string").alias("description"))
    up = {r.id: (r.name, r.description) for r in taxonomy.upsert_nodes(old, new).collect()}
    assert up == {"A": ("a", "d"), "B": ("b", None)}
