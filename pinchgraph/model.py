"""Schemas and fixed names of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Node labels and relation types of the supply-chain graph.
NODE_LABELS = ["Company", "Material", "Process", "Technology", "Geography", "Regulation", "Equipment"]
RELATIONS = ["PRODUCES", "DEPENDS_ON", "COMPETES_WITH", "REGULATES", "SUBSTITUTES_FOR", "ENABLES", "CONTROLS",
             "LOCATED_IN", "USES", "MANUFACTURES"]

# Limits of the stored document.
TITLE_CHARS = 512
TEXT_CHARS = 8000
CLEAN_CHARS = 7500

DOCUMENT = T.StructType([
    T.StructField("uid", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("ias_tier", T.IntegerType()),
    T.StructField("published_at", T.TimestampType()),
    T.StructField("metadata", T.StringType()),
])

NEWS_REQUIRED = ["uid", "title", "url", "source", "sentiment_score", "first_seen"]


def require_columns(columns, required) -> None:
    """Fail on missing columns."""
    missing = sorted(set(required) - set(columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
