"""Coverage monitoring, once-only alerts, digest and the watch list."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pinchgraph.functions.text import days_since, watch_keywords
from pinchgraph.functions.vocab import COVERAGE_LAYER, REVIEW_SENTINEL, TIER1_SENTINEL
from pinchgraph.operators.hypotheses import active, needs_review
from pinchgraph.operators.mentions import match_terms
from pinchgraph.operators.scoring import opportunities
from pinchgraph.storage import bounded_broadcast, keep_last, materialize

MIN_WATCH_CONFIDENCE = 0.40
MAX_WATCH_LAYER = 2


def watched(hypotheses: DataFrame, scored: DataFrame) -> DataFrame:
    """H1: active early-layer hypotheses with keywords and score."""
    h = active(hypotheses, MIN_WATCH_CONFIDENCE).where(
        F.coalesce(F.nullif("awareness_layer", F.lit(0)), F.lit(1)) <= MAX_WATCH_LAYER)
    return h.select(
        "id", "node_name", "statement", "confidence", "awareness_layer",
        watch_keywords(F.col("node_name"), F.col("statement")).alias("keywords")).join(
        scored.select("id", F.col("ops_final").alias("ops_score")), "id")


def keyword_table(watched_: DataFrame) -> DataFrame:
    """(hypothesis_id, keyword), empty keywords dropped."""
    return watched_.select(F.col("id").alias("hypothesis_id"), F.explode("keywords").alias("keyword")).where(
        F.col("keyword") != "").distinct()


def _recent(news: DataFrame, as_of: Column, lookback_hours: int) -> DataFrame:
    return news.where(F.col("first_seen") >= as_of - F.expr(f"INTERVAL {lookback_hours} HOURS")).select(
        "uid", F.coalesce("title", F.lit("")).alias("title"), "url", "source", "first_seen")


#: Hypotheses and articles that are paired at once.
CHUNK = 256
#: Pairs that a task writes, about.
PAIRS_PER_TASK = 1_000_000


def _chunked(df: DataFrame, key: str, row: Column, out: str) -> DataFrame:
    """The rows of each key in lists of about `CHUNK` (`out`), numbered; a list's rows are chosen by hash."""
    number = F.ceil(F.col("_n") / CHUNK).cast("int")
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).select(key, number.alias("_chunks"))
    part = F.pmod(F.xxhash64(row), F.col("_chunks")).cast("int").alias("_part")
    return df.join(sizes, key).select(key, part, row.alias("_row")).groupBy(key, "_part").agg(F.collect_list("_row").alias(out))


def coverage(keywords: DataFrame, news: DataFrame, as_of: Column, lookback_hours: int = 24) -> DataFrame:
    """H2: (hypothesis_id, article) for articles of the last hours whose title holds a keyword.

    Titles meet the distinct keywords in an equi-join on word runs.  Articles with the same keywords are one pattern and
    hypotheses with the same keywords found are one set; only sets and patterns are paired, so no pair is made twice.  The result
    itself may hold most hypotheses with most articles: it is dealt out in blocks of at most about `CHUNK` times `CHUNK` rows.
    """
    recent = _recent(news, as_of, lookback_hours)
    articles, members, pairs = _sets_and_patterns(keywords, recent, [F.col(c) for c in ("title", "url", "source", "first_seen")])
    left = materialize(_chunked(members, "set", F.col("hypothesis_id"), "_ids").withColumnRenamed("_part", "_h"), "set-chunks").df
    right = materialize(_chunked(articles, "pattern", F.struct(*recent.columns), "_articles").withColumnRenamed("_part", "_a"), "pattern-chunks").df
    blocks = pairs.select("set", "pattern").join(left.select("set", "_h"), "set").join(right.select("pattern", "_a"), "pattern")
    rows = pairs.join(members.groupBy("set").agg(F.count(F.lit(1)).alias("_n")), "set").agg(F.sum(F.col("n") * F.col("_n")).alias("n")).first()["n"] or 0
    tasks = max(1, ceil(rows / PAIRS_PER_TASK))  # stated, since blocks are small and what they write is not
    whole = blocks.join(left, ["set", "_h"]).join(right, ["pattern", "_a"]).repartition(tasks, "set", "_h", "pattern", "_a")
    return whole.select(F.explode("_ids").alias("hypothesis_id"), "_articles").select("hypothesis_id", F.inline("_articles"))


def may_alert(hypotheses: DataFrame, ledger: DataFrame) -> DataFrame:
    """H3: below layer 4 and not alerted for layer 4 before."""
    done = ledger.where(F.col("layer") == COVERAGE_LAYER).select(F.col("hypothesis_id").alias("id"))
    return hypotheses.where(F.coalesce(F.nullif("awareness_layer", F.lit(0)), F.lit(1)) < COVERAGE_LAYER).join(
        done, "id", "left_anti")


def ledger_rows(ids: DataFrame, layer: int, as_of: Column) -> DataFrame:
    """Ledger entries for alerted hypotheses (column `id`)."""
    return ids.select(F.col("id").alias("hypothesis_id"), F.lit(layer).alias("layer"), as_of.alias("alerted_at")).distinct()


def new_ledger_rows(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """H4: the rows to append; known (hypothesis, layer) keys are ignored."""
    return rows.join(ledger.select("hypothesis_id", "layer"), ["hypothesis_id", "layer"], "left_anti")


def _first_three(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first three rows of each key; a top-3, so hot keys are cut before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 3)


def _joined(df: DataFrame, key: str, value: str, out: str, sep: str) -> DataFrame:
    """The values of each key in the order of `_r`, as one text."""
    ranked = F.array_sort(F.collect_list(F.struct("_r", F.col(value).alias("v"))))
    return df.groupBy(key).agg(F.array_join(F.transform(ranked, lambda s: s["v"]), sep).alias(out))


def _alert_texts(key: str, totals: DataFrame, titles: DataFrame, sources: DataFrame) -> DataFrame:
    """Totals with the first three titles and sources of each key, given with their `_age` and `uid`."""
    lines = _joined(_first_three(titles, key, ["_age", "uid"]), key, "line", "titles", "\n")
    seen = sources.groupBy(key, "source").agg(F.min(F.struct("_age", "uid")).alias("_first"))
    names = _joined(_first_three(seen, key, ["_first"]), key, "source", "sources", ", ")
    return totals.join(lines, key).join(names, key).withColumn(
        "more", F.when(F.col("n_articles") > 3, F.format_string("...and %d more", F.col("n_articles") - 3)).otherwise(""))


def _age() -> Column:
    """Least for the newest article."""
    return (-F.unix_micros("first_seen")).alias("_age")


def _line() -> Column:
    return F.concat_ws(": ", "source", F.left("title", F.lit(90))).alias("line")


def alert_rows(hits: DataFrame) -> DataFrame:
    """H5: per hypothesis the number of articles, the first three sources and titles (newest first), and the rest count."""
    hits = materialize(hits.select("hypothesis_id", "uid", "source", _age(), _line()), "coverage").df
    return _alert_texts("hypothesis_id", hits.groupBy("hypothesis_id").agg(F.count(F.lit(1)).alias("n_articles")), hits, hits)


def _named(terms: Column) -> Column:
    """A name for a sorted set of terms."""
    return F.sha2(F.to_json(terms), 256)


def _sets_and_patterns(keywords: DataFrame, recent: DataFrame, columns: list[Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(articles, members, pairs): articles with their pattern, hypotheses with their set, and (set, pattern, n) that share a keyword."""
    terms = keywords.select(F.col("keyword").alias("term")).distinct()
    found = match_terms(recent.select("uid", "title"), terms, "uid", "title").groupBy("uid").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    articles = materialize(found.join(recent, "uid").select(_named(F.col("terms")).alias("pattern"), "terms", "uid", *columns), "covered").df
    patterns = articles.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.any_value("terms").alias("terms"))
    held = materialize(patterns.select("pattern", "n", F.explode("terms").alias("keyword")), "patterns").df
    known = keywords.join(bounded_broadcast(held.select("keyword").distinct()), "keyword", "left_semi")
    groups = known.groupBy("hypothesis_id").agg(F.sort_array(F.collect_set("keyword")).alias("keywords"))
    members = materialize(groups.select("hypothesis_id", "keywords", _named(F.col("keywords")).alias("set")), "sets").df
    sets = members.groupBy("set").agg(F.any_value("keywords").alias("keywords")).select("set", F.explode("keywords").alias("keyword"))
    pairs = materialize(sets.join(held, "keyword").select("set", "pattern", "n").distinct(), "pairs").df
    return articles, members, pairs


def covered_alerts(keywords: DataFrame, news: DataFrame, as_of: Column, lookback_hours: int = 24) -> DataFrame:
    """H5 from keywords and news, equal to `alert_rows(coverage(...))`, without pairs of hypotheses and articles.

    Articles that hold the same keywords are summed up as one pattern (their number, newest three titles and sources),
    and hypotheses are one set where the keywords found anywhere are the same.  Only sets and patterns are paired: a keyword that
    stands in most titles and belongs to most hypotheses costs as many pairs as it has sets and patterns.
    """
    articles, members, pairs = _sets_and_patterns(keywords, _recent(news, as_of, lookback_hours), [F.col("source"), _age(), _line()])
    totals = pairs.groupBy("set").agg(F.sum("n").alias("n_articles"))
    titles = pairs.join(_first_three(articles, "pattern", ["_age", "uid"]).select("pattern", "_age", "uid", "line"), "pattern")
    seen = articles.groupBy("pattern", "source").agg(F.min(F.struct("_age", "uid")).alias("_first"))
    sources = pairs.join(_first_three(seen, "pattern", ["_first"]).select("pattern", "source", "_first.*"), "pattern")
    return members.select("set", "hypothesis_id").join(_alert_texts("set", totals, titles, sources), "set").drop("set")


def monitoring_cycle(watched_: DataFrame, news: DataFrame, ledger: DataFrame, as_of: Column,
                     lookback_hours: int = 24) -> tuple[DataFrame, DataFrame]:
    """H6: alert rows of this cycle and the ledger rows to append.  A second run on the result gives nothing."""
    open_ = materialize(may_alert(watched_, ledger), "watched").df
    alerts = covered_alerts(keyword_table(open_), news, as_of, lookback_hours).join(
        open_.select(F.col("id").alias("hypothesis_id"), "statement", "confidence", "ops_score", "awareness_layer"),
        "hypothesis_id")
    return alerts, ledger_rows(alerts.select(F.col("hypothesis_id").alias("id")), COVERAGE_LAYER, as_of)


def new_tier1(scored: DataFrame, ledger: DataFrame) -> DataFrame:
    """H7: tier-1 opportunities never announced (sentinel 99)."""
    done = ledger.where(F.col("layer") == TIER1_SENTINEL).select(F.col("hypothesis_id").alias("id"))
    return opportunities(scored, 1).join(done, "id", "left_anti")


def new_review_needed(hypotheses: DataFrame, scored: DataFrame, ledger: DataFrame) -> DataFrame:
    """H8: hypotheses needing a review, never announced (sentinel 98), with their score."""
    done = ledger.where(F.col("layer") == REVIEW_SENTINEL).select(F.col("hypothesis_id").alias("id"))
    return hypotheses.where(needs_review()).join(done, "id", "left_anti").select(
        "id", "node_id", "node_name", "confidence").join(scored.select("id", "ops_final"), "id")


def digest_counts(scored: DataFrame, hypotheses: DataFrame, docs: DataFrame, as_of: Column) -> DataFrame:
    """H9: active opportunities, tiers 1 and 2, new in seven days, documents ingested."""
    o = opportunities(scored).agg(F.count(F.lit(1)).alias("active"), F.count_if(F.col("tier") == 1).alias("tier1"),
                                  F.count_if(F.col("tier") == 2).alias("tier2"))
    h = active(hypotheses).agg(F.count_if(days_since("created_at", as_of) <= 7).alias("new_this_week"))
    d = docs.agg(F.count(F.lit(1)).alias("documents"))
    zero = {c: F.lit(0).cast("long") for c in ("active", "tier1", "tier2", "new_this_week", "documents")}

    def padded(df: DataFrame) -> DataFrame:
        return df.select(*[(F.col(c) if c in df.columns else v).alias(c) for c, v in zero.items()])

    return padded(o).unionByName(padded(h)).unionByName(padded(d)).agg(*[F.sum(c).alias(c) for c in zero])


def digest_rows(scored: DataFrame, n: int = 6) -> DataFrame:
    """H9: the first rows of the daily digest."""
    name = F.coalesce(F.nullif("node_name", F.lit("")), "node_id", F.lit("?"))
    return opportunities(scored).orderBy(F.desc("ops_final"), "id").limit(n).select(
        "id", name.alias("name"), "tier", "ops_final", "confidence", F.left("statement", F.lit(70)).alias("statement"))


def sync_watch_list(topics: DataFrame, hypotheses: DataFrame, prefix: str = "watch ") -> DataFrame:
    """Keep manual topics, replace managed ones by the given hypotheses (id, statement, keywords)."""
    managed = hypotheses.select(
        F.concat(F.lit(prefix), "id").alias("name"), F.transform("keywords", lambda k: F.lower(k)).alias("keywords"),
        F.lit(True).alias("managed"), F.left("statement", F.lit(120)).alias("statement"))
    manual = topics.where(~F.coalesce("managed", F.lit(False)))
    return manual.select("name", "keywords", "managed", "statement").unionByName(managed)


def remove_from_watch_list(topics: DataFrame, ids: DataFrame, prefix: str = "watch ") -> DataFrame:
    """Drop the topics of the given hypothesis ids; unknown ids change nothing."""
    return topics.join(ids.select(F.concat(F.lit(prefix), "id").alias("name")), "name", "left_anti")


def managed_topics(topics: DataFrame) -> DataFrame:
    """The managed topics."""
    return topics.where(F.coalesce("managed", F.lit(False)))


def latest_ledger(ledger: DataFrame) -> DataFrame:
    """One row per (hypothesis, layer), for a ledger written by several jobs."""
    return keep_last(ledger, ["hypothesis_id", "layer"], ["alerted_at"]).distinct()
