"""Forum posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pinchgraph.functions import vocab
from pinchgraph.functions.text import relevant

LISTING = """struct<data: struct<children: array<struct<data: struct<id: string, title: string, selftext: string,
url: string, permalink: string, score: bigint, num_comments: bigint, created_utc: double, author: string>>>>>"""


def default_tiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(vocab.FORUM_TIERS.items()), "forum string, tier int")


def posts(payloads: DataFrame, tiers: DataFrame, cutoff: Column, min_score: int = 5) -> DataFrame:
    """`payload` (listing), `forum` to documents; forum tiers are a small dimension (`forum`, `tier`)."""
    p = payloads.select("forum", F.explode(F.from_json("payload", LISTING)["data"]["children"]).alias("c")).select(
        "forum", "c.data.*")
    zero = F.lit(0)
    blank = F.lit("")
    p = p.where((F.coalesce("created_utc", zero) >= cutoff) & (F.coalesce("score", zero) >= min_score))
    title = F.coalesce("title", blank)
    text = F.left(F.coalesce(F.nullif("selftext", blank), "url", blank), F.lit(3000))
    meta = F.struct(
        F.col("forum").alias("subreddit"), F.coalesce("score", zero).alias("score"),
        F.coalesce("num_comments", zero).alias("num_comments"), F.coalesce("author", blank).alias("author"))
    return p.where(relevant(title, text, vocab.FORUM_KEYWORDS)).join(tiers, "forum").select(
        F.concat(F.lit("reddit:"), "id").alias("uid"),
        title.alias("title"),
        F.when(text != "", text).otherwise(title).alias("text"),
        F.concat(F.lit("https://www.reddit.com"), F.coalesce("permalink", blank)).alias("url"),
        F.concat(F.lit("reddit_r_"), F.lower("forum")).alias("source"),
        F.col("tier").cast("int").alias("ias_tier"),
        F.timestamp_seconds("created_utc").alias("published_at"),
        F.to_json(meta).alias("metadata"),
    )
