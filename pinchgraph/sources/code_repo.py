"""Code-repository issues and pull requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinchgraph.functions import vocab
from pinchgraph.functions.text import relevant

ITEMS = """array<struct<number: bigint, title: string, body: string, html_url: string, state: string,
updated_at: string, created_at: string, labels: array<struct<name: string>>, comments: bigint>>"""


def issues(payloads: DataFrame) -> DataFrame:
    """`payload` (JSON array), `repo`, `kind` (issue or pull) to documents."""
    item = payloads.select("repo", "kind", F.explode(F.from_json("payload", ITEMS)).alias("i"))
    title = F.coalesce("i.title", F.lit(""))
    body = F.coalesce("i.body", F.lit(""))
    meta = F.struct(
        F.col("repo"), F.col("i.number").alias("number"), F.col("kind"), F.col("i.state").alias("state"),
        F.coalesce(F.transform("i.labels", lambda x: x["name"]), F.array().cast("array<string>")).alias("labels"),
        F.coalesce("i.comments", F.lit(0)).alias("comments"))
    return item.where(relevant(title, body, vocab.CODE_REPO_KEYWORDS)).select(
        F.concat(F.lit("github:"), "repo", F.lit(":"), F.col("i.number").cast("string"), F.lit(":"), "kind").alias("uid"),
        F.concat(F.lit("["), "repo", F.lit("] "), title).alias("title"),
        F.when(body != "", F.left(body, F.lit(3000))).otherwise(title).alias("text"),
        F.coalesce("i.html_url", F.lit("")).alias("url"),
        F.lit("github").alias("source"),
        F.lit(1).alias("ias_tier"),
        F.try_to_timestamp(F.coalesce(F.nullif("i.updated_at", F.lit("")), "i.created_at")).alias("published_at"),
        F.to_json(meta).alias("metadata"),
    )
