"""The corpus pipeline: five stages over `documents`, each written as Parquet and read as the next one's input."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pinchgraph.llm import chunks, decontaminate, packing, resample, simhash
from pinchgraph.llm.common import prepare, table
from pinchgraph.llm.queries import vocabulary
from pinchgraph.storage import drop_scratch, materialize, recorded_scratch, scratch_path

#: Stages decide by trained models and by content, which SQL cannot express.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents outside the importance resample go.  Rows without an id cannot be addressed and stay."""
    kept = resample.resample(docs.where("doc_id is not null"), table(spark, sf_dir, "labels"), carry=True)
    return kept.select("row.*").unionByName(docs.where("doc_id is null"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id: five-word shingles, similarity 0.8."""
    return simhash.keep_one(docs, simhash.similar_groups(docs))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out of the texts; every document stays, and n_chars follows its text."""
    out = chunks.without_spans(docs, materialize(chunks.repeated_spans(docs), "spans").df)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, materialize(decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")), "leaks").df)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences.

    Ids follow from text and place; `packing.pieces(..., with_ids=True)` carries them, at the cost of moving them twice.
    """
    return packing.pack(packing.pieces(docs, vocabulary()))


#: Scratch tables of the stage that ran last.
_LEFT: list[str] = []


def _swept(stage):
    """`stage`, dropping the scratch tables of the stage before: its result is written by now."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_scratch(prepare(spark), _LEFT)
        with recorded_scratch() as names:
            out = stage(spark, docs, sf_dir)
        _LEFT[:] = names
        return out

    return run_stage


STAGES = [
    ("quality", _swept(quality)),
    ("near_dedup", _swept(near_dedup)),
    ("substring_dedup", _swept(substring_dedup)),
    ("decontamination", _swept(decontamination)),
    ("packing", _swept(pack)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(prepare(spark), docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
