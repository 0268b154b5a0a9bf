"""Registered queries of section H."""

from __future__ import annotations

from pyspark.sql import functions as F

from pinchgraph.operators import monitor
from pinchgraph.workload.registry import query
from pinchgraph.workload.sqlviews import A, SQL_VIEWS
from pinchgraph.workload.views import as_of

HOURS = 24 * 10

SQL_VIEWS["watched"] = ("hyps scored", """
SELECT h.id, h.statement, h.confidence, h.awareness_layer, s.ops_final AS ops_score,
  list_distinct([h.node_name, 'Output', 'Supplier', split_part(split_part(h.statement, ' limits ', 2), ' and ', 1), split_part(split_part(h.statement, ' and ', 2), ' supply in', 1)]) AS keywords
FROM hyps h JOIN scored s USING (id) WHERE h.status = 'active' AND h.confidence >= 0.4 AND h.awareness_layer <= 2""")
SQL_VIEWS["may_alert"] = ("watched alert_ledger", "SELECT * FROM watched WHERE id NOT IN (SELECT hypothesis_id FROM alert_ledger WHERE layer = 4)")
_HITS = r"""SELECT DISTINCT k.id AS hypothesis_id, t.uid, t.title, t.source, t.first_seen FROM (SELECT id, unnest(keywords) AS keyword FROM {0}) k
JOIN (SELECT *, regexp_split_to_array(lower(title), '[^\p{{L}}\p{{N}}_]+') AS w FROM news WHERE first_seen >= {1} - INTERVAL {2} HOUR) t
ON (NOT contains(k.keyword, '#') AND list_contains(t.w, lower(k.keyword))) OR (contains(k.keyword, '#') AND contains(lower(t.title), lower(k.keyword)))"""
SQL_VIEWS["hits"] = ("watched news", _HITS.format("watched", A, HOURS))
SQL_VIEWS["open_hits"] = ("may_alert news", _HITS.format("may_alert", A, HOURS))


def _watched(v):
    return monitor.watched(v.hyps, v.scored)


@query("h1_watched", "SELECT id, confidence, awareness_layer, ops_score, array_to_string(list_sort(keywords), '|') AS keywords FROM watched", "watched")
def h1(v):
    return _watched(v).select("id", "confidence", "awareness_layer", "ops_score", F.array_join(F.sort_array("keywords"), "|").alias("keywords"))


@query("h2_coverage", "SELECT hypothesis_id, uid, title, source FROM hits", "hits")
def h2(v):
    return monitor.coverage(monitor.keyword_table(_watched(v)), v.news, as_of(), HOURS).select("hypothesis_id", "uid", "title", "source")


@query("h3_may_alert", "SELECT id FROM hyps WHERE awareness_layer < 4 AND id NOT IN (SELECT hypothesis_id FROM alert_ledger WHERE layer = 4)", "hyps alert_ledger")
def h3(v):
    return monitor.may_alert(v.hyps, v.alert_ledger).select("id")


@query("h4_ledger_additions", "SELECT id AS hypothesis_id, CAST(4 AS INTEGER) AS layer FROM hyps WHERE id NOT IN (SELECT hypothesis_id FROM alert_ledger WHERE layer = 4)", "hyps alert_ledger")
def h4(v):
    rows = monitor.ledger_rows(v.hyps.select("id"), 4, as_of())
    return monitor.new_ledger_rows(v.alert_ledger, rows).select("hypothesis_id", "layer")


_ALERT = """SELECT h.hypothesis_id, count(*) AS n_articles, CASE WHEN count(*) > 3 THEN '...and ' || (count(*) - 3) || ' more' ELSE '' END AS more,
any_value(t.titles) AS titles, any_value(s.sources) AS sources FROM {0} h
JOIN (SELECT hypothesis_id, string_agg(source || ': ' || left(title, 90), chr(10) ORDER BY r) AS titles FROM (
  SELECT *, row_number() OVER (PARTITION BY hypothesis_id ORDER BY first_seen DESC, uid) AS r FROM {0}) WHERE r <= 3 GROUP BY 1) t USING (hypothesis_id)
JOIN (SELECT hypothesis_id, string_agg(source, ', ' ORDER BY r) AS sources FROM (SELECT *, row_number() OVER (PARTITION BY hypothesis_id ORDER BY seen DESC) AS r FROM (
  SELECT hypothesis_id, source, max(first_seen) AS seen FROM {0} GROUP BY 1, 2)) WHERE r <= 3 GROUP BY 1) s USING (hypothesis_id) GROUP BY 1"""


@query("h5_alert_rows", _ALERT.format("hits"), "hits")
def h5(v):
    return monitor.covered_alerts(monitor.keyword_table(_watched(v)), v.news, as_of(), HOURS)


@query("h6_monitoring_cycle", f"SELECT a.*, w.confidence, w.ops_score, w.awareness_layer FROM ({_ALERT.format('open_hits')}) a JOIN may_alert w ON w.id = a.hypothesis_id", "open_hits may_alert")
def h6(v):
    return monitor.monitoring_cycle(_watched(v), v.news, v.alert_ledger, as_of(), HOURS)[0].drop("statement")


@query("h6_ledger_after_cycle", """SELECT hypothesis_id, layer FROM alert_ledger UNION ALL SELECT DISTINCT hypothesis_id, 4 FROM open_hits""", "alert_ledger open_hits")
def h6_ledger(v):
    rows = monitor.monitoring_cycle(_watched(v), v.news, v.alert_ledger, as_of(), HOURS)[1]
    return v.alert_ledger.unionByName(monitor.new_ledger_rows(v.alert_ledger, rows)).select("hypothesis_id", "layer")


@query("h7_new_tier1", """SELECT id, ops_final FROM scored WHERE status = 'active' AND tier = 1 AND id NOT IN (SELECT hypothesis_id FROM alert_ledger WHERE layer = 99)""", "scored alert_ledger")
def h7(v):
    return monitor.new_tier1(v.scored, v.alert_ledger).select("id", "ops_final")


@query("h8_review_needed", """SELECT h.id, h.confidence, s.ops_final FROM hyps h JOIN scored s USING (id) WHERE h.status = 'active' AND h.confidence >= 0.8 AND NOT h.ach_reviewed
AND h.id NOT IN (SELECT hypothesis_id FROM alert_ledger WHERE layer = 98)""", "hyps scored alert_ledger")
def h8(v):
    return monitor.new_review_needed(v.hyps, v.scored, v.alert_ledger).select("id", "confidence", "ops_final")


@query("h9_digest_counts", f"""SELECT count(*) AS active, count(*) FILTER (tier = 1) AS tier1, count(*) FILTER (tier = 2) AS tier2,
(SELECT count(*) FROM hyps WHERE status = 'active' AND date_diff('day', created_at, {A}) <= 7) AS new_this_week, (SELECT count(*) FROM documents) AS documents
FROM scored WHERE status = 'active'""", "scored hyps")
def h9(v):
    return monitor.digest_counts(v.scored, v.hyps, v.docs, as_of())


@query("h9_digest_rows", """SELECT id, node_name AS name, tier, ops_final, confidence, left(statement, 70) AS statement FROM scored WHERE status = 'active' ORDER BY ops_final DESC, id LIMIT 6""", "scored")
def h9_rows(v):
    return monitor.digest_rows(v.scored)


def _topics(v):
    """A stored list: managed topics of old hypotheses and manual topics of every other supplier."""
    manual = v.hyps.where("s_suppkey % 2 = 1").select(F.concat(F.lit("topic "), "node_name").alias("name"), F.array(F.lower("node_name")).alias("keywords"),
                                                     F.lit(False).alias("managed"), F.lit("").alias("statement"))
    old = v.hyps.where("s_suppkey % 2 = 0").select(F.concat(F.lit("watch "), "id").alias("name"), F.array(F.lit("old")).alias("keywords"),
                                                   F.lit(True).alias("managed"), F.lit("old").alias("statement"))
    return manual.unionByName(old)


@query("h10_sync_watch_list", """SELECT 'topic ' || node_name AS name, FALSE AS managed, lower(node_name) AS keywords, '' AS statement FROM hyps WHERE s_suppkey % 2 = 1
UNION ALL SELECT 'watch ' || id, TRUE, array_to_string(list_sort(list_transform(keywords, lambda k: lower(k))), '|'), left(statement, 120) FROM watched""", "hyps watched")
def h10(v):
    return monitor.sync_watch_list(_topics(v), _watched(v)).select("name", "managed", F.array_join(F.sort_array("keywords"), "|").alias("keywords"), "statement")


@query("h11_remove", "SELECT 'topic ' || node_name AS name FROM hyps WHERE s_suppkey % 2 = 1 UNION ALL SELECT 'watch ' || id FROM hyps WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0", "hyps")
def h11(v):
    return monitor.remove_from_watch_list(_topics(v), v.hyps.where("s_suppkey % 3 = 0").select("id")).select("name")


@query("h11_managed", "SELECT 'watch ' || id AS name FROM hyps WHERE s_suppkey % 2 = 0", "hyps")
def h11_managed(v):
    return monitor.managed_topics(_topics(v)).select("name")
