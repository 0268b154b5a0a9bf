"""Readers for landed payload files.

Fetching is outside; a payload is one response body per row in column `payload`, plus the
context columns the caller knows (repository, feed, board...).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed file, with its folder name for context."""
    return (
        spark.read.text(path, wholetext=True)
        .withColumnRenamed("value", "payload")
        .withColumn("folder", F.element_at(F.split(F.input_file_name(), "/"), -2))
    )


def read_payload_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line of JSON-lines files."""
    return spark.read.text(path).withColumnRenamed("value", "payload")


def read_xml_entries(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """Splittable read of large XML files, one row per `row_tag` element."""
    return spark.read.format("xml").option("rowTag", row_tag).load(path)
