from datetime import date, datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pinchgraph.functions.scores import sub_score
from pinchgraph.operators import ach, calibration, commodities, hypotheses
from pinchgraph.sources import feeds
from pinchgraph.storage import merge_columns


def test_merge_of_maps_and_repeated_rows(spark):
    old = spark.createDataFrame([("k", "old", {"a": "1", "b": "2"}), ("o", "o", None)], "id string, name string, p map<string,string>")
    new = spark.createDataFrame([("k", None, {"b": "9"}, 2), ("k", "x", {"b": "5", "c": "7"}, 1), ("n", "n", {"z": None}, 1)], "id string, name string, p map<string,string>, no int")
    got = {r.id: (r.name, r.p) for r in merge_columns(old, new, ["id"], "no").collect()}
    assert got == {"k": ("x", {"a": "1", "b": "9", "c": "7"}), "o": ("o", None), "n": ("n", {"z": None})}
    assert merge_columns(old, new.limit(0), ["id"]).count() == 2


def test_matrix_view_refuses_cells_it_cannot_show(spark):
    cells = spark.createDataFrame([("h", 0, 1, "C"), ("h", 4, 1, "I")], "hypothesis_id string, alt_no int, evidence_no int, class string")
    with pytest.raises(PySparkException):
        ach.matrix_view(cells).collect()
    assert ach.matrix_view(cells, 5).first()["h4"] == "I"


def test_no_answer_aborts_a_run(spark):
    answers = ['{}', '{"confidence": 99999999999}', '{"confidence": "NaN"}', '{"confidence": 1e400}', '{"confidence": "2.9", "supply_growth_score": "75f"}', '{"confidence": 1, "confidence": 4}', "none"]
    raw = spark.createDataFrame([("2024-01-01", str(i), "s", a, i) for i, a in enumerate(answers)], "run_date string, commodity string, sector string, response string, articles_used int")
    got = {int(r.commodity): (r.parse_error, r.confidence, r.articles_used) for r in commodities.scored_rows(raw).collect()}
    assert got == {0: (True, None, 0), 1: (False, 5, 1), 2: (False, 3, 2), 3: (False, 3, 3), 4: (False, 2, 4), 5: (False, 4, 5), 6: (True, None, 6)}


def test_sub_score_takes_plain_numbers_only(spark):
    df = spark.createDataFrame([(v,) for v in ("75", "75f", "75d", " 8.9 ", "1e1", "0x10", "NaN", "-3", "900", None)], "v string")
    assert [r[0] for r in df.select(sub_score(F.col("v"))).collect()] == [75, 50, 50, 8, 10, 50, 50, 0, 100, 50]


def test_zero_score_starts_at_half(spark):
    raw = spark.createDataFrame([("n", "N", 0.0, '{"statement": "s", "falsification_criteria": ["a", "b"]}')], "node_id string, node_name string, srs_score double, response string")
    assert hypotheses.parse_generated(raw).first()["confidence"] == 0.5


RSS = """<item><title>Chip news</title><link>https://a/1</link><guid isPermaLink="false">g1</guid><description>a semiconductor shortage</description>
<pubDate>Mon, 1 Jan 2024 10:00 EST</pubDate><category>x</category></item>"""
ATOM = """<entry><title type="html">Semiconductor plant</title><link rel="self" href="https://s"/><link rel="alternate" href="https://a/2"/><id>urn:2</id>
<content type="html">&lt;b&gt;body&lt;/b&gt;</content><updated>2024-01-02T03:04:05Z</updated></entry>"""


def test_feeds_as_they_are_sent(spark):
    items = spark.createDataFrame([(RSS, "nyt_business", "u"), (ATOM.replace("<entry>", "<item>").replace("</entry>", "</item>"), "nyt_business", "u")], "item string, feed string, feed_url string")
    tiers = spark.createDataFrame([("nyt_business", 3)], "feed string, tier int")
    got = {r.title: r for r in feeds.feed_entries(items, tiers, F.lit("2030-01-01").cast("timestamp")).collect()}
    rss, atom = got["Chip news"], got["Semiconductor plant"]
    assert rss.url == "https://a/1" and rss.text == "a semiconductor shortage" and rss.published_at == datetime(2024, 1, 1, 15)
    assert atom.url == "https://a/2" and atom.text == "body" and atom.published_at == datetime(2024, 1, 2, 3, 4, 5)


def test_brier(spark):
    d = date
    log = spark.createDataFrame([(0.8, d(2024, 1, 10), d(2024, 1, 9)), (0.6, d(2024, 1, 20), d(2024, 2, 1)), (0.5, d(2024, 2, 1), None), (0.9, d(2024, 5, 1), None), (0.9, None, None)],
                                "confidence_at_log double, predicted_recognition_date date, actual_recognition_date date")
    got = {r.month: (r.n, round(r.brier, 6)) for r in calibration.brier_by_month(log, F.lit("2024-03-01").cast("timestamp")).collect()}
    assert got == {d(2024, 1, 1): (2, 0.2), d(2024, 2, 1): (1, 0.25)}


def test_one_event_counts_once(spark):
    t = datetime(2024, 1, 1, 5)
    rows = [("a", "https://www.n.com/1", t), ("b", "http://N.com:80/2", t), ("b", "https://n.com/3", t), ("c", None, t), ("d", "https://n.com/1", None), ("e", "https://m.com", t)]
    got = calibration.correlated_weights(spark.createDataFrame(rows, "node_id string, url string, published_at timestamp")).collect()
    assert sorted((r.node_id, r.weight) for r in got) == [("a", 0.5), ("b", 0.5), ("b", 0.5), ("c", 1.0), ("d", 1.0), ("e", 1.0)]


def test_concentration(spark):
    rows = [("i", s, float(a)) for s, a in zip("abcde", (50, 20, 10, 10, 10))] + [("j", "a", 1.0), ("z", "a", 0.0)]
    got = {r.item: (r.suppliers, r.cr3, r.level) for r in calibration.concentration_ratio(spark.createDataFrame(rows, "item string, supplier string, amount double")).collect()}
    assert got == {"i": (5, 0.8, "warning"), "j": (1, 1.0, "chokepoint"), "z": (1, None, "none")}
