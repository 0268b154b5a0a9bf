"""Whole-word matching of many names in many texts without a cross product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinchgraph.functions.text import clean_text, gaps, tokens, whole_word_pattern
from pinchgraph.storage import materialize, row_bytes

MIN_NAME_CHARS = 3
#: A dictionary up to this size meets the texts where they lie.
BROADCAST_BYTES = 128 << 20


def name_dictionary(concepts: DataFrame) -> DataFrame:
    """B2: distinct names and aliases."""
    every = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return concepts.select(F.explode(every).alias("name")).distinct()


def _word_runs(n: int) -> Column:
    """The runs of `n` words of column `_toks`, joined by single spaces."""
    starts = F.sequence(F.lit(1), F.size("_toks") - (n - 1))
    return F.when(F.size("_toks") >= n, F.transform(starts, lambda i: F.array_join(F.slice("_toks", i, n), " "))).otherwise(
        F.array().cast("array<string>"))


def match_terms(texts: DataFrame, terms: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term) pairs where `term` stands as a whole word in `text`, case ignored.

    `texts` has a unique `key`; `terms` has distinct column `term`.  Every term is reduced to
    its run of words; texts emit their distinct runs of the lengths that occur, and the two
    meet in an equi-join.  A term made only of punctuation can match nothing but the whole gap
    between two words, so gaps join the same way.  Terms that are one plain word are then
    certain; the others are verified with the exact pattern on the surviving pairs.  The terms
    are written once, which also gives their sizes.
    """
    words = tokens(F.col("term"))
    t = (
        terms.where(F.col("term") != "").withColumn("_words", words)
        .select(
            "term", F.size("_words").alias("_n"),
            F.when(F.size("_words") == 0, F.concat(F.lit("\u0001"), F.lower("term")))
            .otherwise(F.array_join("_words", " ")).alias("_gram"))
        .withColumn("_sure", (F.col("_n") == 1) & (F.lower("term") == F.col("_gram")))
        .withColumn("_pattern", F.when(~F.col("_sure"), whole_word_pattern(F.col("term"))))
    )
    written = materialize(t, "terms", lengths=F.collect_set("_n"), bytes=F.sum(row_bytes(t)))
    t, lengths = written.df, sorted(written.metrics.get("lengths") or [])  # a handful of small numbers
    runs = texts.select(key, text).withColumn("_toks", tokens(F.col(text)))
    parts = []
    for n in lengths:
        if n == 0:
            parts.append(F.transform(gaps(F.col(text)), lambda g: F.concat(F.lit("\u0001"), g)))
        elif n == 1:
            parts.append(F.col("_toks"))
        else:
            parts.append(_word_runs(n))
    if not parts:
        return texts.select(key).withColumn("term", F.lit(None).cast("string")).where(F.lit(False))
    grams = runs.select(key, text, F.explode(F.array_distinct(F.concat(*parts))).alias("_gram"))
    if (written.metrics.get("bytes") or 0) <= BROADCAST_BYTES:
        # small dictionary: one pass over the texts, nothing shuffled, text still at hand
        pairs = grams.join(F.broadcast(t), "_gram")
        return pairs.where(F.col("_sure") | F.regexp_like(F.lower(text), F.col("_pattern"))).select(key, "term")
    # large dictionary: shuffle only (key, gram), then bring the text back for pairs to verify
    pairs = grams.drop(text).join(t, "_gram").select(key, "term", "_sure", "_pattern")
    checked = (
        pairs.where(~F.col("_sure")).join(texts.select(key, text), key)
        .where(F.regexp_like(F.lower(text), F.col("_pattern")))
    )
    return pairs.where(F.col("_sure")).select(key, "term").unionByName(checked.select(key, "term"))


def find_mentions(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(uid, name) for names of at least three characters found in `text`."""
    terms = names.where(F.length("name") >= MIN_NAME_CHARS).select(F.col("name").alias("term")).distinct()
    return match_terms(docs, terms, "uid", "text").withColumnRenamed("term", "name")


def process_batch(docs: DataFrame, names: DataFrame) -> DataFrame:
    """Cleaned text (title when there is no text) with its sorted list of candidate names.

    `docs` is the batch to process, for example `sources.documents.pending`; marking them
    processed is A5.  A document's list is bounded by its own length.
    """
    raw = F.coalesce(F.nullif("text", F.lit("")), "title", F.lit(""))
    cleaned = docs.withColumn("text", clean_text(raw))
    found = find_mentions(cleaned.select("uid", "text"), names).groupBy("uid").agg(
        F.sort_array(F.collect_list("name")).alias("candidate_entities"))
    return cleaned.join(found, "uid", "left").withColumn(
        "candidate_entities", F.coalesce("candidate_entities", F.array().cast("array<string>")))
