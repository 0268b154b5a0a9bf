"""News ledger, coverage alerts and watch list: ledger, lookback, once-only and preservation rules."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pinchgraph.operators import monitor
from pinchgraph.sources import news

NOW = datetime(2024, 1, 31, 12)
NEWS = "uid string, title string, url string, source string, sentiment_score double, sentiment_label string, topics string, first_seen timestamp"


def articles(spark, rows):
    return spark.createDataFrame([(u, t, f"https://x/{u}", s, 0.1, "neutral", topics, seen) for u, t, s, topics, seen in rows], NEWS)


def ledger(spark, uids=()):
    return spark.createDataFrame([(u,) for u in uids], "uid string")


def alert_ledger(spark, rows=()):
    return spark.createDataFrame([(h, n, NOW) for h, n in rows], "hypothesis_id string, layer int, alerted_at timestamp")


def watched(spark, *rows):
    return spark.createDataFrame([(i, "claim", 0.78, 8.7, layer, kws) for i, layer, kws in rows],
                                 "id string, statement string, confidence double, ops_score double, awareness_layer int, keywords array<string>")


TWO = [("aaa", "ABF supply tightens", "Reuters", "[]", NOW), ("bbb", "TSMC CoWoS allocation", "Bloomberg", "[]", NOW - timedelta(hours=1))]


def test_new_articles_have_tier_four_oldest_first(spark):
    got = news.new_articles(articles(spark, TWO), ledger(spark)).collect()
    assert [r.uid for r in got] == ["bbb", "aaa"] and {r.ias_tier for r in got} == {4}


def test_ledger_prevents_refetch(spark):
    assert news.new_articles(articles(spark, TWO[:1]), ledger(spark, ["aaa"])).count() == 0


def test_ledger_additions_are_safe_and_once(spark):
    assert news.ledger_additions(ledger(spark), ledger(spark)).count() == 0
    assert [r.uid for r in news.ledger_additions(ledger(spark, ["a"]), ledger(spark, ["a", "b", "b"])).collect()] == ["b"]


def test_article_counts(spark):
    assert tuple(news.article_counts(articles(spark, TWO), ledger(spark, ["aaa"])).first()) == (2, 1)
    assert tuple(news.article_counts(articles(spark, TWO), ledger(spark, ["a", "b", "c"])).first()) == (2, 0)


def test_missing_columns_fail(spark):
    with pytest.raises(ValueError, match="first_seen"):
        news.new_articles(articles(spark, TWO).drop("first_seen"), ledger(spark))


@pytest.mark.parametrize("raw,want", [(None, []), ("", []), ("  ", []), ('["A","B"]', ["A", "B"]), ("Tech,Energy", ["Tech", "Energy"]),
                                      (" a , ,b,", ["a", "b"]), ('{"a":1}', []), ("5", [])])
def test_topics(spark, raw, want):
    got = news.new_articles(articles(spark, [("a", "t", "s", raw, NOW)]), ledger(spark)).first()
    assert got.topics == want


def cover(spark, titles, kws, hours=24):
    rows = [(f"u{i}", t, "Reuters", "[]", seen) for i, (t, seen) in enumerate(titles)]
    k = spark.createDataFrame([("h", w) for w in kws], "hypothesis_id string, keyword string")
    return sorted(r.uid for r in monitor.coverage(k, articles(spark, rows), F.lit(NOW), hours).collect())


def test_coverage_matches_whole_words_of_recent_titles(spark):
    titles = [("Ajinomoto expands ABF film", NOW), ("Bank of France", NOW), ("abf prices", NOW - timedelta(hours=48)), (None, NOW),
              ("ABFs are other", NOW), ("New C++ tools", NOW), ("Gas: high-purity neon short", NOW), ("Élan vital", NOW)]
    assert cover(spark, titles, ["ABF", "Ajinomoto"]) == ["u0"]
    assert cover(spark, titles, ["ABF"], hours=72) == ["u0", "u2"]
    assert cover(spark, titles, ["ban"]) == []
    assert cover(spark, titles, ["high-purity neon"]) == ["u6"]
    assert cover(spark, titles, ["lan", "élan"]) == ["u7"]
    assert cover(spark, titles, ["c++"]) == []  # a word character would have to follow
    assert cover(spark, titles, ["-", ": "]) == ["u6"]  # a term of punctuation is the gap between two words


@pytest.mark.parametrize("layer,known,alerts", [(2, [], True), (3, [], True), (2, [("h", 4)], False), (4, [], False), (2, [("h", 99)], True), (0, [], True)])
def test_should_alert(spark, layer, known, alerts):
    got = monitor.may_alert(watched(spark, ("h", layer, ["ABF"])), alert_ledger(spark, known)).count()
    assert got == int(alerts)


def test_alert_row_shows_three_of_five(spark):
    rows = [(f"u{i}", f"ABF story {i}", f"S{i % 2}", "[]", NOW - timedelta(minutes=i)) for i in range(5)]
    alerts, _ = monitor.monitoring_cycle(watched(spark, ("h", 2, ["ABF"])), articles(spark, rows), alert_ledger(spark), F.lit(NOW))
    r = alerts.first()
    assert r.n_articles == 5 and r.more == "...and 2 more" and r.sources == "S0, S1"
    assert r.titles.split("\n") == ["S0: ABF story 0", "S1: ABF story 1", "S0: ABF story 2"]


def test_second_cycle_is_silent(spark):
    w, n = watched(spark, ("h", 2, ["ABF"]), ("g", 1, ["nothing"])), articles(spark, TWO)
    alerts, entries = monitor.monitoring_cycle(w, n, alert_ledger(spark), F.lit(NOW))
    assert [r.hypothesis_id for r in alerts.collect()] == ["h"]
    after = alert_ledger(spark).unionByName(monitor.new_ledger_rows(alert_ledger(spark), entries))
    assert monitor.monitoring_cycle(w, n, after, F.lit(NOW))[0].count() == 0
    assert monitor.new_ledger_rows(after, entries).count() == 0


def test_alerts_without_pairs_equal_alerts_from_pairs(spark):
    rng = random.Random(5)
    words = ["ABF", "Neon", "Output", "Supplier", "wafer", "gas plant"]
    rows = [(f"u{i:03}", rng.choice([None, "", *(" ".join(rng.sample(words + ["and", "of"], k)) for k in (1, 2, 3, 5))]), f"S{rng.randint(0, 5)}", "[]",
             NOW - timedelta(hours=rng.randint(0, 30))) for i in range(150)]
    keys = [(f"h{i}", k) for i in range(25) for k in {"Supplier", *rng.sample(words + ["absent", "nowhere"], rng.randint(0, 4))}] + [("none", "absent")]
    keywords = spark.createDataFrame(keys, "hypothesis_id string, keyword string")
    n = articles(spark, rows)
    columns = ["hypothesis_id", "n_articles", "titles", "sources", "more"]
    facts = lambda df: sorted(map(tuple, df.select(columns).collect()))
    got = facts(monitor.covered_alerts(keywords, n, F.lit(NOW)))
    assert got == facts(monitor.alert_rows(monitor.coverage(keywords, n, F.lit(NOW)))) and len(got) == 25
    assert monitor.covered_alerts(keywords.limit(0), n, F.lit(NOW)).count() == 0 and monitor.covered_alerts(keywords, n.limit(0), F.lit(NOW)).count() == 0


def test_a_keyword_of_all_titles_is_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(monitor, "CHUNK", 8)
    monkeypatch.setattr(monitor, "PAIRS_PER_TASK", 400)
    n = articles(spark, [(f"u{i:02}", f"Output {i}", "S", "[]", NOW) for i in range(60)])
    keywords = spark.createDataFrame([(f"h{i}", "Output") for i in range(80)], "hypothesis_id string, keyword string")
    got = monitor.coverage(keywords, n, F.lit(NOW))
    assert got.select("hypothesis_id", "uid").distinct().count() == got.count() == 60 * 80
    assert got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 60 * 80 / 4


def topics_table(spark, rows):
    return spark.createDataFrame(rows, "name string, keywords array<string>, managed boolean, statement string")


def test_watch_list(spark):
    t = topics_table(spark, [("mine", ["x"], False, ""), ("watch old", ["y"], True, "s"), ("unmarked", ["z"], None, "")])
    h = spark.createDataFrame([("h1", "s" * 200, ["ABF", "Neon"])], "id string, statement string, keywords array<string>")
    synced = monitor.sync_watch_list(t, h)
    got = {r.name: r for r in synced.collect()}
    assert set(got) == {"mine", "unmarked", "watch h1"}
    assert got["watch h1"].keywords == ["abf", "neon"] and len(got["watch h1"].statement) == 120
    assert {r.name for r in monitor.managed_topics(synced).collect()} == {"watch h1"}
    ids = spark.createDataFrame([("h1",)], "id string")
    assert {r.name for r in monitor.remove_from_watch_list(synced, ids).collect()} == {"mine", "unmarked"}
    absent = spark.createDataFrame([("nope",)], "id string")
    assert monitor.remove_from_watch_list(synced, absent).count() == 3


def test_source_report_names_missing_columns(spark):
    from pinchgraph.model import NEWS_REQUIRED
    from pinchgraph.sources import news as source

    full = spark.createDataFrame([("a", None), ("b", "t")], "uid string, title string").withColumn("more", F.lit(1))
    got = {r["column"]: (r.present, r.filled) for r in source.source_report(full).collect()}
    assert set(got) == set(NEWS_REQUIRED)
    assert got["uid"] == (True, 2) and got["title"] == (True, 1)
    assert all(got[c] == (False, 0) for c in NEWS_REQUIRED if c not in ("uid", "title"))
    assert {r.present for r in source.source_report(full.select("more")).collect()} == {False}
