"""Company job boards in two response forms (A18, A19); the board list is an input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinchgraph.functions import vocab
from pinchgraph.functions.text import relevant, strip_tags

FORM_1 = """struct<jobs: array<struct<id: string, title: string, location: struct<name: string>, content: string,
updated_at: string, absolute_url: string>>>"""
FORM_2 = """array<struct<id: string, text: string, categories: struct<location: string, department: string>,
descriptionPlain: string, createdAt: bigint, hostedUrl: string>>"""


def _job_uid(board: str, job_id: Column, title: Column) -> Column:
    return F.concat(F.lit(f"{board}:"), F.coalesce(job_id, F.left(F.sha2(title, 256), F.lit(12))))


def board_form_1(payloads: DataFrame, as_of: Column) -> DataFrame:
    """`payload`, `company`, `tier`; body and relevance use `location — content` cut to 1500."""
    j = payloads.select("company", "tier", F.explode(F.from_json("payload", FORM_1)["jobs"]).alias("j"))
    blank = F.lit("")
    title = F.coalesce("j.title", blank)
    place = F.coalesce("j.location.name", blank)
    body = F.concat(place, F.lit(" — "), F.left(strip_tags(F.coalesce("j.content", blank)), F.lit(1500)))
    meta = F.struct(F.col("company"), place.alias("location"), F.lit("greenhouse").alias("board"))
    return j.where(relevant(title, body, vocab.JOB_KEYWORDS)).select(
        _job_uid("jobs_greenhouse", F.col("j.id"), title).alias("uid"),
        F.concat(F.lit("[Job] "), title, F.lit(" — "), "company").alias("title"),
        body.alias("text"),
        F.coalesce("j.absolute_url", blank).alias("url"),
        F.lit("jobs_greenhouse").alias("source"),
        F.col("tier").cast("int").alias("ias_tier"),
        F.coalesce(F.try_to_timestamp("j.updated_at"), as_of).alias("published_at"),
        F.to_json(meta).alias("metadata"),
    )


def board_form_2(payloads: DataFrame, as_of: Column) -> DataFrame:
    """`payload`, `company`, `tier`; creation time in milliseconds, relevance over the whole description."""
    j = payloads.select("company", "tier", F.explode(F.from_json("payload", FORM_2)).alias("j"))
    blank = F.lit("")
    title = F.coalesce("j.text", blank)
    place = F.coalesce("j.categories.location", blank)
    body = strip_tags(F.coalesce("j.descriptionPlain", blank))
    meta = F.struct(F.col("company"), place.alias("location"),
                    F.coalesce("j.categories.department", blank).alias("department"), F.lit("lever").alias("board"))
    created = F.nullif(F.coalesce("j.createdAt", F.lit(0)), F.lit(0))
    return j.where(relevant(title, body, vocab.JOB_KEYWORDS)).select(
        _job_uid("jobs_lever", F.col("j.id"), title).alias("uid"),
        F.concat(F.lit("[Job] "), title, F.lit(" — "), "company").alias("title"),
        F.concat(place, F.lit(" — "), F.left(body, F.lit(1500))).alias("text"),
        F.coalesce("j.hostedUrl", blank).alias("url"),
        F.lit("jobs_lever").alias("source"),
        F.col("tier").cast("int").alias("ias_tier"),
        F.coalesce(F.timestamp_millis(created), as_of).alias("published_at"),
        F.to_json(meta).alias("metadata"),
    )
