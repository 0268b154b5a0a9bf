"""Preprint entries in Atom XML."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinchgraph.functions.text import strip_space

ENTRY = """struct<id: string, title: string, summary: string, published: string,
author: array<struct<name: string>>>"""


def papers(entries: DataFrame) -> DataFrame:
    """`entry` (one Atom entry as XML text) and `category` to documents; incomplete entries are dropped."""
    e = entries.select("category", F.from_xml("entry", ENTRY, {"rowTag": "entry"}).alias("e")).where(
        F.col("e.id").isNotNull() & F.col("e.title").isNotNull() & F.col("e.summary").isNotNull()
        & F.col("e.published").isNotNull())
    paper = strip_space(F.element_at(F.split("e.id", "/abs/"), -1))
    names = F.transform("e.author", lambda a: a["name"])
    meta = F.struct(
        paper.alias("arxiv_id"),
        F.coalesce(F.slice(names, 1, 5), F.array().cast("array<string>")).alias("authors"),
        F.concat(F.lit("https://arxiv.org/pdf/"), paper).alias("pdf_url"), F.col("category"))
    return e.select(
        F.concat(F.lit("arxiv:"), paper).alias("uid"),
        F.replace(strip_space("e.title"), F.lit("\n"), F.lit(" ")).alias("title"),
        F.left(F.replace(strip_space("e.summary"), F.lit("\n"), F.lit(" ")), F.lit(3000)).alias("text"),
        F.concat(F.lit("https://arxiv.org/abs/"), paper).alias("url"),
        F.lit("arxiv").alias("source"),
        F.lit(2).alias("ias_tier"),
        F.try_to_timestamp(strip_space("e.published")).alias("published_at"),
        F.to_json(meta).alias("metadata"),
    )
