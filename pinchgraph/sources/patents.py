"""Patent grants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinchgraph.functions import vocab
from pinchgraph.functions.text import relevant

PATENTS = """struct<patents: array<struct<patent_id: string, patent_title: string, patent_abstract: string,
patent_date: string>>>"""


def patents(payloads: DataFrame, as_of: Column) -> DataFrame:
    """`payload` (query response), `assignee` to documents."""
    p = payloads.select("assignee", F.explode(F.from_json("payload", PATENTS)["patents"]).alias("p"))
    blank = F.lit("")
    title = F.coalesce("p.patent_title", blank)
    abstract = F.coalesce("p.patent_abstract", blank)
    pid = F.coalesce(F.nullif("p.patent_id", blank), F.left(F.sha2(title, 256), F.lit(12)))
    return p.where(relevant(title, abstract, vocab.PATENT_KEYWORDS)).select(
        F.concat(F.lit("uspto:"), pid).alias("uid"),
        F.concat(F.lit("[Patent] "), title).alias("title"),
        F.coalesce(F.nullif(F.left(abstract, F.lit(3000)), blank), title).alias("text"),
        F.concat(F.lit("https://patents.google.com/patent/US"), pid).alias("url"),
        F.lit("uspto").alias("source"),
        F.lit(1).alias("ias_tier"),
        F.coalesce(F.try_to_timestamp(F.concat("p.patent_date", F.lit("T00:00:00Z"))), as_of).alias("published_at"),
        F.to_json(F.struct(pid.alias("patent_id"), F.col("assignee"))).alias("metadata"),
    )
