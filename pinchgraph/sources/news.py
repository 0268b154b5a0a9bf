"""News articles of an outside table and the ledger of those taken in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinchgraph.functions.jsontext import topics
from pinchgraph.model import NEWS_REQUIRED, require_columns

NEWS_TIER = 4


def new_articles(news: DataFrame, ledger: DataFrame) -> DataFrame:
    """Articles whose uid is not in the ledger, oldest first; text is the title."""
    require_columns(news.columns, NEWS_REQUIRED)
    for name in ("sentiment_label", "topics"):
        if name not in news.columns:
            news = news.withColumn(name, F.lit(None).cast("string"))
    return (
        news.join(ledger.select("uid"), "uid", "left_anti")
        .select(
            "uid", "title", "url", "source", F.coalesce("title", F.lit("")).alias("text"), "sentiment_score",
            "sentiment_label", topics(F.col("topics")).alias("topics"), "first_seen",
            F.lit(NEWS_TIER).alias("ias_tier"))
        .orderBy("first_seen", "uid")
    )


def source_report(news: DataFrame) -> DataFrame:
    """(column, present, filled) of every required column of the source: whether it is there and in how many rows it has a value.

    What `new_articles` refuses is shown here before a run: a column with `present` false.  Further columns do not matter.
    """
    there = [c for c in NEWS_REQUIRED if c in news.columns]
    counts = news.agg(*[F.count(c).alias(c) for c in there]) if there else news.agg(F.count(F.lit(1)).alias("_rows"))
    row = lambda c: F.struct(F.lit(c).alias("column"), F.lit(c in there).alias("present"), (F.col(c) if c in there else F.lit(0).cast("long")).alias("filled"))
    return counts.select(F.inline(F.array(*[row(c) for c in sorted(NEWS_REQUIRED)])))


def ledger_additions(ledger: DataFrame, uids: DataFrame) -> DataFrame:
    """The uids to append to the ledger; repeats and known ones are ignored."""
    return uids.select("uid").distinct().join(ledger.select("uid"), "uid", "left_anti")


def article_counts(news: DataFrame, ledger: DataFrame) -> DataFrame:
    """Articles stored and not yet taken in (never negative)."""
    both = news.select(F.lit(1).alias("n"), F.lit(0).alias("d")).union(ledger.select(F.lit(0), F.lit(1)))
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum("d"), F.lit(0)).alias("_done")).select(
        "total", F.greatest(F.lit(0).cast("long"), F.col("total") - F.col("_done")).alias("pending"))


def as_documents(articles: DataFrame) -> DataFrame:
    """Articles in the document form that resolution takes."""
    return articles.select(
        "uid", "title", "text", "url", "source", "ias_tier", F.col("first_seen").alias("published_at"),
        F.to_json(F.struct("sentiment_score", "sentiment_label", "topics")).alias("metadata"))
