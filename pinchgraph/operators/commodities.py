"""Commodity stress: article context, response parsing, ranking, deltas and history."""

from __future__ import annotations

from math import ceil
from uuid import uuid4

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pinchgraph.functions.jsontext import fenced_object, field, safe_list
from pinchgraph.functions.scores import consensus, outlook, plain_number, stress_score, sub_score
from pinchgraph.functions.text import ascii_lower
from pinchgraph.functions.vocab import COMMODITIES, STRESS_WEIGHTS
from pinchgraph.storage import materialize, replace_rows

DIMENSION = "name string, sector string, unit string, importance int, aliases array<string>, description string, key_producers string"
MAX_ARTICLES = 3
#: Terms of one automaton.
TERMS_PER_PASS = 1_000_000
FINDINGS = ["agent1_finding", "agent2_finding", "agent3_finding", "agent4_finding", "agent5_critique"]
LISTS = ["key_catalysts", "key_risks", "monitoring_indicators"]
HORIZONS = ["outlook_6m", "outlook_12m", "outlook_3y", "outlook_5y"]


def read_dimension(spark: SparkSession, path: str) -> DataFrame:
    """The commodity dimension from JSON lines; `position` is the list order."""
    return spark.read.schema(f"position int, {DIMENSION}").json(path)


def default_dimension(spark: SparkSession) -> DataFrame:
    """The tracked commodities, with `position` as their list order; their prose (description, key_producers) is left to `described`."""
    rows = [(i, *row, None, None) for i, row in enumerate(COMMODITIES, 1)]
    return spark.createDataFrame(rows, f"position int, {DIMENSION}")


def described(commodities: DataFrame, notes: DataFrame) -> DataFrame:
    """The dimension with `description` and `key_producers` from `notes(name, description, key_producers)` where they are given there."""
    one = notes.groupBy("name").agg(F.max("description").alias("_d"), F.max("key_producers").alias("_k"))
    return commodities.join(one, "name", "left").withColumn("description", F.coalesce("_d", "description")).withColumn(
        "key_producers", F.coalesce("_k", "key_producers")).drop("_d", "_k")


def dimension(rows: DataFrame) -> DataFrame:
    """A validated dimension: names unique and not blank, aliases never null."""
    return rows.where(F.coalesce(F.trim("name"), F.lit("")) != "").withColumn(
        "aliases", F.coalesce("aliases", F.array().cast("array<string>"))).dropDuplicates(["name"])


def _automaton(shared) -> ahocorasick.Automaton:
    """The automaton of broadcast terms, built once per Python worker."""
    key, terms = shared.value
    if key not in _BUILT:
        _BUILT.clear()
        found = ahocorasick.Automaton()
        for no, term in enumerate(terms):
            found.add_word(term, no)
        found.make_automaton()
        _BUILT[key] = found
    return _BUILT[key]


#: The automaton that this worker built last.
_BUILT: dict[str, ahocorasick.Automaton] = {}


def article_matches(docs: DataFrame, terms: DataFrame | list[str]) -> DataFrame:
    """(uid, source, published_at, term): documents holding a term in title or text, ASCII case ignored.

    `terms` (a column `term`, or a list) are already in ASCII lower case.  All of them are found in one scan of the texts
    by an Aho-Corasick automaton per worker, whatever their number; past `TERMS_PER_PASS` they are dealt by hash and
    each part takes a scan of its own, so neither driver nor worker holds more.  Only matching pairs are formed, each once.
    A null term matches nothing and an empty one every document.
    """
    spark = docs.sparkSession
    if isinstance(terms, list):
        terms = spark.createDataFrame([(t,) for t in terms], "term string")
    listed = materialize(terms.where("term is not null").select("term").distinct(), "terms")
    passes = max(1, ceil(listed.rows / TERMS_PER_PASS))
    both = docs.select("uid", "source", "published_at", ascii_lower(F.coalesce("title", F.lit(""))).alias("_t"),
                       ascii_lower(F.coalesce("text", F.lit(""))).alias("_x"))
    keep = ["uid", "source", "published_at"]
    kinds = ", ".join(f"{c} {both.schema[c].dataType.simpleString()}" for c in keep)
    out = None
    for part in range(passes):
        mine = [r["term"] for r in listed.df.where(F.pmod(F.xxhash64("term"), F.lit(passes)) == part).collect()]  # about TERMS_PER_PASS at most
        shared = spark.sparkContext.broadcast((uuid4().hex, [t for t in mine if t]))
        always = "" in mine

        def search(batches, shared=shared, always=always):
            names = shared.value[1]
            found = _automaton(shared) if names else None
            for batch in batches:
                rows, hits = [], []
                for i, texts in enumerate(zip(batch.column("_t").to_pylist(), batch.column("_x").to_pylist())):
                    held = {no for text in texts for _, no in found.iter(text)} if names else ()
                    hits += [names[no] for no in held] + [""] * always
                    rows += [i] * (len(held) + always)
                if rows:
                    chosen = batch.select(keep).take(pa.array(rows, pa.int32()))
                    yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(hits, pa.string())], names=[*keep, "term"])

        found = both.mapInArrow(search, f"{kinds}, term string")
        out = found if out is None else out.unionByName(found)
    return out


def articles(docs: DataFrame, commodities: DataFrame, as_of: Column, days: int = 7,
             per_commodity: int = MAX_ARTICLES) -> DataFrame:
    """Up to three articles per commodity of the last week.

    Per term the three newest; terms in order (name, then aliases); a document counts for its
    first term only; then three in all.  Both cuts are top-k windows, which Spark applies before
    the shuffle as well.
    """
    listed = commodities.select("name", F.posexplode(F.concat(F.array("name"), "aliases")).alias("alias_no", "term")).withColumn(
        "term", ascii_lower(F.col("term")))
    recent = docs.where(F.col("published_at") >= as_of - F.expr(f"INTERVAL {days} DAYS"))
    hits = article_matches(recent, listed.select("term"))
    by_term = Window.partitionBy("term").orderBy(F.desc("published_at"), "uid")
    newest = hits.withColumn("_r", F.row_number().over(by_term)).where(F.col("_r") <= per_commodity)
    paired = newest.join(listed, "term").groupBy("name", "uid").agg(
        F.min(F.struct("alias_no", "_r")).alias("_at"), F.first("published_at").alias("published_at"),
        F.first("source").alias("source"))
    overall = Window.partitionBy("name").orderBy("_at")
    return paired.withColumn("position", F.row_number().over(overall)).where(F.col("position") <= per_commodity).select(
        F.col("name").alias("commodity"), "position", "uid", "source", "published_at")


def article_context(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The chosen articles with date, title and a 400-character excerpt."""
    return found.drop("published_at", "source").join(docs, "uid").select(
        "commodity", "position", "uid",
        F.concat(F.lit("["), F.date_format("published_at", "yyyy-MM-dd"), F.lit(" | "), "source", F.lit("] "), "title").alias("header"),
        F.trim(F.left(F.coalesce("text", F.lit("")), F.lit(400))).alias("excerpt"))


def scored_rows(responses: DataFrame) -> DataFrame:
    """Raw `response` per (run_date, commodity) to a scored row, or a row flagged `parse_error`.

    An answer without a JSON object, or with an empty one, is an error.  `articles_used`, the number of articles
    the answer rests on, is carried where it is given.
    """
    d = responses.withColumn("_doc", fenced_object(F.col("response")))
    doc = F.col("_doc")
    subs = {name: sub_score(field(doc, name)) for name in STRESS_WEIGHTS}
    used = [F.col("articles_used")] if "articles_used" in responses.columns else []
    d = d.select("run_date", "commodity", "sector", *used, "_doc", (doc.isNull() | (F.to_json(doc) == "{}")).alias("parse_error"),
                 *[c.alias(n) for n, c in subs.items()])
    whole = F.least(F.lit(5.0), F.greatest(F.lit(0.0), plain_number(field(doc, "confidence"))))
    ok = ~F.col("parse_error")

    def kept(c: Column) -> Column:
        return F.when(ok, c)

    return d.select(
        "run_date", "commodity", "sector", *used, "parse_error",
        kept(stress_score({n: F.col(n) for n in STRESS_WEIGHTS})).alias("supply_stress_score"),
        *[kept(F.col(n)).alias(n) for n in STRESS_WEIGHTS],
        *[kept(outlook(field(doc, n))).alias(n) for n in HORIZONS],
        kept(F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(F.nullif(whole.cast("int"), F.lit(0)), F.lit(3))))).alias("confidence"),
        kept(consensus(field(doc, "consensus"))).alias("consensus"),
        *[kept(F.left(F.coalesce(field(doc, n), F.lit("")), F.lit(500))).alias(n) for n in FINDINGS],
        *[kept(safe_list(doc, n)).alias(n) for n in LISTS],
    )


def rank(results: DataFrame) -> DataFrame:
    """I8: per run the valid rows ranked by score, ties by `position` (list order, S22); failures unranked.

    A run has one row per commodity of the dimension, so a window partition stays small.
    """
    valid = F.col("supply_stress_score").isNotNull() & ~F.coalesce("parse_error", F.lit(False))
    order = Window.partitionBy("run_date", "_valid").orderBy(F.desc("supply_stress_score"), "position")
    return results.withColumn("_valid", valid).withColumn(
        "rank", F.when(F.col("_valid"), F.row_number().over(order))).drop("_valid")


def previous_run(rankings: DataFrame, as_of: Column) -> DataFrame:
    """Scores of the latest run before `as_of` (S21); a missing score counts 0."""
    before = rankings.where(F.col("run_date") < as_of)
    newest = before.agg(F.max("run_date").alias("run_date"))
    return before.join(F.broadcast(newest), "run_date").select(  # one row
        "commodity", F.coalesce("supply_stress_score", F.lit(0.0)).alias("previous_score"))


def with_delta(results: DataFrame, previous: DataFrame) -> DataFrame:
    """Change against the previous run; a commodity absent there, and a failed row, get 0."""
    score = F.col("supply_stress_score")
    return results.join(previous, "commodity", "left").withColumn(
        "score_delta", F.coalesce(F.round(score - F.coalesce("previous_score", score), 2), F.lit(0.0))).drop("previous_score")


def with_delta_all_runs(rankings: DataFrame) -> DataFrame:
    """I9 for every stored run at once: each run against the run before it.

    The list of run dates is distinct days, so its window is small; scores join on
    (run_date, commodity).
    """
    dates = rankings.select("run_date").distinct()
    steps = dates.withColumn("previous_date", F.lag("run_date").over(Window.orderBy("run_date")))
    old = rankings.select(F.col("run_date").alias("previous_date"), "commodity",
                          F.coalesce("supply_stress_score", F.lit(0.0)).alias("previous_score"))
    score = F.col("supply_stress_score")
    return rankings.join(F.broadcast(steps), "run_date").join(old, ["previous_date", "commodity"], "left").withColumn(
        "score_delta", F.coalesce(F.round(score - F.coalesce("previous_score", score), 2), F.lit(0.0))).drop(
        "previous_score", "previous_date")


def save(stored: DataFrame, ranking: DataFrame) -> DataFrame:
    """Snapshot with rows replaced by (run_date, commodity); `storage.append_run` writes it by run_date."""
    return replace_rows(stored, ranking.select(*stored.columns), ["run_date", "commodity"])


def run_dates(rankings: DataFrame) -> DataFrame:
    """Distinct run dates, newest first; the first is the latest run."""
    return rankings.select("run_date").distinct().orderBy(F.desc("run_date"))


def latest_ranking(rankings: DataFrame) -> DataFrame:
    """The latest run in rank order, failures last."""
    newest = rankings.agg(F.max("run_date").alias("run_date"))
    return rankings.join(F.broadcast(newest), "run_date").orderBy(F.asc_nulls_last("rank"), "commodity")


def history(rankings: DataFrame, commodity: str, as_of: Column, days: int = 30) -> DataFrame:
    """Runs of one commodity in the last `days` days, oldest first."""
    return rankings.where((F.col("commodity") == commodity) & (F.col("run_date") >= F.date_sub(as_of, days))).select(
        "run_date", "supply_stress_score", "score_delta", "rank").orderBy("run_date")


def should_run(rankings: DataFrame, run_date: Column) -> DataFrame:
    """Guard row (`status`): skipped when the latest stored run is `run_date`."""
    return rankings.agg(F.max("run_date").alias("latest")).select(
        "latest", F.when(F.col("latest") == run_date, "skipped").otherwise("run").alias("status"))


def run_summary(results: DataFrame) -> DataFrame:
    """Per run rows, successes and failures."""
    return results.groupBy("run_date").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("parse_error")).alias("succeeded"),
        F.count_if("parse_error").alias("failed"))
