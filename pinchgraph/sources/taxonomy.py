"""Taxonomy input: concepts and edges, upserts, extension and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pinchgraph.storage import insert_ignore, merge_columns

CONCEPT = "struct<id: string, label: string, name: string, aliases: array<string>, description: string, criticality: double, properties: variant>"
EDGE = "struct<source: string, target: string, relation: string, properties: variant>"
TAXONOMY = f"struct<concepts: array<{CONCEPT}>, edges: array<{EDGE}>>"
MIN_NODES = 300
MIN_EDGES = 200


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Landed taxonomy files, one per row in `payload`."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "payload")


def concepts(payloads: DataFrame) -> DataFrame:
    """The concept rows of taxonomy payloads."""
    return payloads.select(F.inline(F.from_json("payload", TAXONOMY)["concepts"]))


def edges(payloads: DataFrame) -> DataFrame:
    """The edge rows of taxonomy payloads."""
    return payloads.select(F.inline(F.from_json("payload", TAXONOMY)["edges"]))


def primitive_properties(props: Column) -> Column:
    """Properties that are text, number or boolean, as map(text, text); lists and objects are dropped."""
    entries = F.map_entries(F.coalesce(F.try_variant_get(props, "$", "map<string, variant>"),
                                       F.create_map().cast("map<string, variant>")))
    kind = lambda v: F.schema_of_variant(v)
    kept = F.filter(entries, lambda e: e["value"].isNotNull() & ~F.startswith(kind(e["value"]), F.lit("ARRAY"))
                    & ~F.startswith(kind(e["value"]), F.lit("OBJECT")) & (kind(e["value"]) != "VOID"))
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(
        e["key"], F.try_variant_get(e["value"], "$", "string"))))


def upsert_nodes(nodes: DataFrame, incoming: DataFrame, order: str | None = None) -> DataFrame:
    """Merge by (label, id), property by property, maps of properties key by key; later rows by `order` win."""
    return merge_columns(nodes, incoming, ["label", "id"], order)


def valid_edges(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Edges with both ends known."""
    ids = known.select("id").distinct()
    return (
        incoming.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
        .join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    )


def broken_edges(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Edges with an unknown end, each once."""
    ids = known.select("id").distinct()
    ok = (ids.select(F.col("id").alias("source"), F.lit(True).alias("_s")),
          ids.select(F.col("id").alias("target"), F.lit(True).alias("_t")))
    return (
        incoming.join(ok[0], "source", "left").join(ok[1], "target", "left")
        .where(F.col("_s").isNull() | F.col("_t").isNull()).drop("_s", "_t")
    )


def upsert_edges(edges_: DataFrame, incoming: DataFrame, known: DataFrame, order: str | None = None) -> DataFrame:
    """Merge valid edges by (source, relation, target), as `upsert_nodes`; variant properties keep primitives only."""
    valid = valid_edges(incoming, known)
    for f in valid.schema.fields:
        if f.dataType.typeName() == "variant":
            valid = valid.withColumn(f.name, primitive_properties(F.col(f.name)))
    return merge_columns(edges_, valid, ["source", "relation", "target"], order)


def extend(concepts_: DataFrame, edges_: DataFrame, more_concepts: DataFrame,
           more_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add unseen concepts, then edges with valid ends that are not there yet."""
    all_concepts = insert_ignore(concepts_, more_concepts, ["id"])
    added = valid_edges(more_edges, all_concepts).select(*edges_.columns)
    return all_concepts, insert_ignore(edges_, added, ["source", "target", "relation"])


def integrity(concepts_: DataFrame, edges_: DataFrame) -> DataFrame:
    """Concepts per label and the number of broken references."""
    by_label = concepts_.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("label").alias("metric"), F.col("label").alias("key"), "n")
    broken = broken_edges(edges_, concepts_).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("broken").alias("metric"), F.lit("").alias("key"), "n")
    return by_label.unionByName(broken)


def validation(nodes: DataFrame, edges_: DataFrame) -> DataFrame:
    """Node, edge and isolated-node counts, counts by label and relation, and the load gates."""
    ends = edges_.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    label = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    relation = edges_.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))
    isolated = nodes.select("id").join(ends, "id", "left_anti").agg(F.count(F.lit(1)).alias("n"))

    def rows(df: DataFrame, metric: str, key: Column, value: Column) -> DataFrame:
        return df.select(F.lit(metric).alias("metric"), key.alias("key"), value.cast("long").alias("n"))

    total_n = label.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    total_e = relation.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    none = F.lit("")
    out = rows(total_n, "nodes", none, F.col("n"))
    for part in (
        rows(total_e, "edges", none, F.col("n")),
        rows(isolated, "isolated", none, F.col("n")),
        rows(label, "label", F.col("label"), F.col("n")),
        rows(relation, "relation", F.col("relation"), F.col("n")),
        rows(total_n, "enough_nodes", none, F.col("n") >= MIN_NODES),
        rows(total_e, "enough_edges", none, F.col("n") >= MIN_EDGES),
    ):
        out = out.unionByName(part)
    return out
