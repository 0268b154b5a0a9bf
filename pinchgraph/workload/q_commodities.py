"""Registered queries of section I."""

from __future__ import annotations

from pyspark.sql import functions as F

from pinchgraph.functions import scores, vocab
from pinchgraph.functions.jsontext import fenced_object, safe_list
from pinchgraph.operators import commodities as com
from pinchgraph.workload.registry import query
from pinchgraph.workload.sqlviews import A
from pinchgraph.workload.views import as_of

LATEST = "(SELECT max(run_date) FROM rankings)"
_SUBS = list(vocab.STRESS_WEIGHTS)


def _day(df):
    return df.withColumn("run_date", F.col("run_date").cast("string"))


def _concept_dim(v):
    """The name dictionary as a commodity dimension: concept name, all its words as aliases, its text as description, its source as producers."""
    return v.concepts.select("name", "aliases", "description", F.col("id").alias("key_producers"))


# all different words, in reading order
_DIM = """dim AS (SELECT name, [name] || list_filter(w, lambda x, i: list_position(w, x) = i) AS terms FROM (
  SELECT w[1] || ' ' || w[2] AS name, w FROM (SELECT regexp_extract_all(text, '[A-Za-z]{3,}') AS w FROM benchmark)))"""
_ASCII = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ARTICLES = f"""WITH {_DIM}, listed AS (SELECT name, unnest(terms) AS term, unnest(range(len(terms))) AS alias_no FROM dim),
recent AS (SELECT uid, source, published_at, {_ASCII.format('title')} AS t, {_ASCII.format('text')} AS x FROM docs WHERE published_at >= {A} - INTERVAL 7 DAY),
hits AS (SELECT term, uid, source, published_at, row_number() OVER (PARTITION BY term ORDER BY published_at DESC, uid) AS r
  FROM recent, (SELECT DISTINCT term, {_ASCII.format('term')} AS low FROM listed) WHERE contains(t, low) OR contains(x, low)),
firsts AS (SELECT name, uid, min(alias_no * 10 + r) AS place FROM hits JOIN listed USING (term) WHERE r <= 3 GROUP BY 1, 2)
SELECT name AS commodity, CAST(row_number() OVER (PARTITION BY name ORDER BY place) AS INTEGER) AS position, uid FROM firsts QUALIFY position <= 3"""


@query("i1_articles", _ARTICLES, "docs")
def i1(v):
    return com.articles(v.docs, _concept_dim(v), as_of()).select("commodity", "position", "uid")


@query("i1_article_context", f"""SELECT a.commodity, a.position, a.uid, '[' || strftime(d.published_at, '%Y-%m-%d') || ' | ' || d.source || '] ' || d.title AS header, trim(left(d.text, 400), ' ') AS excerpt
FROM ({_ARTICLES}) a JOIN docs d USING (uid)""", "docs")
def i1_context(v):
    return com.article_context(com.articles(v.docs, _concept_dim(v), as_of()), v.docs)


@query("i2_sub_score", """SELECT event_id, CAST(least(100, greatest(0, trunc(CAST(json_extract_string(props, '$.k') AS DOUBLE) * 1.5 - 20))) AS INTEGER) AS score,
CAST(50 AS INTEGER) AS missing FROM events""")
def i2(v):
    k = F.get_json_object("props", "$.k").cast("double")
    return v.table("events").select("event_id", scores.sub_score((k * 1.5 - 20).cast("string")).alias("score"), scores.sub_score(F.col("event_type")).alias("missing"))


_FORM = "event_id % 6 IN (0, 1, 4, 5)"
_OUTLOOK = "CASE event_type WHEN 'click' THEN 'bearish' WHEN 'view' THEN 'bullish' WHEN 'error' THEN 'bullish' ELSE 'neutral' END"


@query("i3_outlook", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'bearish' WHEN 1 THEN 'bullish' WHEN 2 THEN 'neutral' WHEN 3 THEN 'bearish' WHEN 4 THEN 'bullish' ELSE 'neutral' END AS outlook,
CASE event_type WHEN 'click' THEN 'neutral' WHEN 'purchase' THEN 'neutral' ELSE 'neutral' END AS from_type FROM events""")
def i3(v):
    k = F.col("event_id") % 6
    raw = (F.when(k == 0, "Strongly Bearish.").when(k == 1, "slightly bullish").when(k == 2, "").when(k == 3, "supply deficit ahead")
           .when(k == 4, "surplus expected").otherwise("range-bound"))
    return v.table("events").select("event_id", scores.outlook(raw).alias("outlook"), scores.outlook(F.col("event_type")).alias("from_type"))


@query("i4_consensus", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'tight' WHEN 1 THEN 'contested' WHEN 2 THEN 'divided' ELSE 'divided' END AS consensus FROM events""")
def i4(v):
    k = F.col("event_id") % 4
    raw = F.when(k == 0, "Near unanimous ").when(k == 1, "Sharp dispute").when(k == 2, F.col("event_type"))
    return v.table("events").select("event_id", scores.consensus(raw).alias("consensus"))


@query("i5_safe_list", f"SELECT 'e' || event_id AS commodity, CASE WHEN {_FORM} THEN 'a|b' ELSE '' END AS catalysts, '' AS risks FROM events")
def i5(v):
    d = v.model_answers.withColumn("doc", fenced_object(F.col("response")))
    return d.select("commodity", F.array_join(safe_list(F.col("doc"), "key_catalysts"), "|").alias("catalysts"),
                    F.array_join(safe_list(F.col("doc"), "key_risks"), "|").alias("risks"))


@query("i6_stress_score", "SELECT CAST(run_date AS VARCHAR) AS run_date, commodity, supply_stress_score, s1, s9 FROM results", "results")
def i6(v):
    return _day(v.commodity_results).select("run_date", "commodity", "supply_stress_score", F.col(_SUBS[0]).alias("s1"), F.col(_SUBS[8]).alias("s9"))


@query("i7_scored_rows", f"""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run_date, 'e' || event_id AS commodity, NOT ({_FORM}) AS parse_error,
CASE WHEN {_FORM} THEN round(0.15::DOUBLE * (k + k + 100 + 50) + 0.10::DOUBLE * 150 + 0.05::DOUBLE * 100, 2) END AS supply_stress_score,
CASE WHEN {_FORM} THEN {_OUTLOOK} END AS outlook_6m, CASE WHEN {_FORM} THEN 'neutral' END AS outlook_5y,
CAST(CASE WHEN NOT ({_FORM}) THEN 0 WHEN event_id % 9 = 0 THEN 3 ELSE least(5, event_id % 9) END AS INTEGER) AS confidence,
CASE WHEN {_FORM} THEN CASE event_type WHEN 'view' THEN 'contested' WHEN 'error' THEN 'tight' ELSE 'divided' END END AS consensus
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""")
def i7(v):
    return _day(com.scored_rows(v.model_answers)).select(
        "run_date", "commodity", "parse_error", "supply_stress_score", "outlook_6m", "outlook_5y",
        F.coalesce("confidence", F.lit(0)).alias("confidence"), "consensus")


@query("i8_rank", "SELECT CAST(run_date AS VARCHAR) AS run_date, commodity, supply_stress_score, CAST(coalesce(rank, 0) AS INTEGER) AS rank FROM rankings", "rankings")
def i8(v):
    return _day(com.rank(v.commodity_results)).select("run_date", "commodity", "supply_stress_score", F.coalesce("rank", F.lit(0)).alias("rank"))


@query("i9_previous_run", """SELECT commodity, coalesce(supply_stress_score, 0) AS previous_score FROM results
WHERE run_date = (SELECT max(run_date) FROM results WHERE run_date < DATE '2000-01-15')""", "results")
def i9(v):
    return com.previous_run(v.commodity_results, F.lit("2000-01-15").cast("date"))


@query("i9_delta", "SELECT CAST(run_date AS VARCHAR) AS run_date, commodity, score_delta FROM rankings", "rankings")
def i9_delta(v):
    return _day(v.rankings).select("run_date", "commodity", "score_delta")


@query("i10_save_ranking", """SELECT CAST(run_date AS VARCHAR) AS run_date, commodity, CASE WHEN run_date >= DATE '1999-06-01' THEN 0.0 ELSE supply_stress_score END AS supply_stress_score FROM results""", "results")
def i10(v):
    """A rerun of the later months replaces their rows."""
    stored = v.commodity_results.select("run_date", "commodity", "supply_stress_score")
    rerun = stored.where(F.col("run_date") >= F.lit("1999-06-01").cast("date")).withColumn("supply_stress_score", F.lit(0.0))
    return _day(com.save(stored, rerun))


@query("i11_run_dates", "SELECT DISTINCT CAST(run_date AS VARCHAR) AS run_date FROM results ORDER BY 1 DESC", "results")
def i11(v):
    return _day(com.run_dates(v.commodity_results))


@query("i12_latest_ranking", f"SELECT CAST(run_date AS VARCHAR) AS run_date, commodity, supply_stress_score, CAST(coalesce(rank, 0) AS INTEGER) AS rank FROM rankings WHERE run_date = {LATEST}", "rankings")
def i12(v):
    return _day(com.latest_ranking(v.rankings)).select("run_date", "commodity", "supply_stress_score", F.coalesce("rank", F.lit(0)).alias("rank"))


@query("i13_history", """SELECT CAST(run_date AS VARCHAR) AS run_date, supply_stress_score, score_delta, CAST(coalesce(rank, 0) AS INTEGER) AS rank FROM rankings
WHERE commodity = 'Brand#3' AND run_date >= DATE '2001-06-15' - 365""", "rankings")
def i13(v):
    h = com.history(v.rankings, "Brand#3", F.lit("2001-06-15").cast("date"), 365)
    return _day(h).withColumn("rank", F.coalesce("rank", F.lit(0)))


@query("i14_run_summary", "SELECT CAST(run_date AS VARCHAR) AS run_date, count(*) AS total, count(*) FILTER (NOT parse_error) AS succeeded, count(*) FILTER (parse_error) AS failed FROM results GROUP BY 1", "results")
def i14(v):
    return _day(com.run_summary(v.commodity_results))


@query("i14_run_guard", "SELECT CAST(max(run_date) AS VARCHAR) AS latest, CASE WHEN max(run_date) = DATE '2001-12-01' THEN 'skipped' ELSE 'run' END AS status FROM results", "results")
def i14_guard(v):
    return com.should_run(v.commodity_results, F.lit("2001-12-01").cast("date")).withColumn("latest", F.col("latest").cast("string"))


@query("a32_commodity_dimension", """SELECT w[1] || ' ' || w[2] AS name, len(list_filter(w, lambda x, i: list_position(w, x) = i)) AS n_aliases, left(text, 80) AS description, 'C-' || item_id AS key_producers
FROM (SELECT item_id, text, regexp_extract_all(text, '[A-Za-z]{3,}') AS w FROM benchmark)""")
def a32(v):
    return com.dimension(_concept_dim(v)).select("name", F.size("aliases").cast("long").alias("n_aliases"), "description", "key_producers")
