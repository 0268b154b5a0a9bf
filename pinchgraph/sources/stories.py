"""Story search hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinchgraph.storage import keep_first

HITS = """struct<hits: array<struct<objectID: string, title: string, story_title: string, url: string,
story_text: string, comment_text: string, created_at: string, created_at_i: bigint, points: bigint,
num_comments: bigint, author: string>>>"""


def stories(payloads: DataFrame, since: Column, as_of: Column, min_points: int = 10) -> DataFrame:
    """`payload` (search response), `query`, `query_no` to documents; both limits are strict.

    A story found by several queries is kept once, for the first query.
    """
    hit = payloads.select("query", "query_no", F.explode(F.from_json("payload", HITS)["hits"]).alias("h")).where(
        (F.col("h.points") > min_points) & (F.col("h.created_at_i") > since))
    blank = F.lit("")
    story = F.coalesce("h.objectID", blank)
    title = F.coalesce(F.nullif("h.title", blank), F.nullif("h.story_title", blank), blank)
    text = F.coalesce(F.nullif("h.story_text", blank), F.nullif("h.comment_text", blank), title)
    meta = F.struct(
        F.coalesce("h.points", F.lit(0)).alias("points"), F.coalesce("h.num_comments", F.lit(0)).alias("num_comments"),
        F.coalesce("h.author", blank).alias("author"), F.col("query"))
    docs = hit.select(
        F.concat(F.lit("hn:"), story).alias("uid"),
        title.alias("title"),
        F.left(text, F.lit(3000)).alias("text"),
        F.coalesce(F.nullif("h.url", blank), F.concat(F.lit("https://news.ycombinator.com/item?id="), story)).alias("url"),
        F.lit("hn").alias("source"),
        F.lit(1).alias("ias_tier"),
        F.coalesce(F.try_to_timestamp("h.created_at"), as_of).alias("published_at"),
        F.to_json(meta).alias("metadata"),
        "query_no",
    )
    return keep_first(docs, ["uid"], ["query_no"]).drop("query_no")
