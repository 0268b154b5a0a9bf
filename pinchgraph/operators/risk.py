"""Risk scores over the graph, stored runs, what-if removal and graph views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinchgraph.functions import vocab
from pinchgraph.functions.scores import or_default, risk_score, round_half_up
from pinchgraph.operators.graph import BlockCutTree, adjacency, load_edges, load_nodes, node_centrality, supplier_counts
from pinchgraph.storage import materialize

CRITICAL = 0.60


def node_metrics(nodes: DataFrame, edges: DataFrame, error: float | None = None) -> DataFrame:
    """Betweenness, suppliers, concentration, articulation flag and risk score of every node.

    `nodes` has node_id, name, label, criticality; `edges` has src, dst, relation.  With `error`, betweenness is sampled
    to that error (`graph.node_centrality`).
    """
    nodes = materialize(load_nodes(nodes), "risk-nodes").df
    edges = materialize(load_edges(edges, nodes).select("src", "dst"), "risk-edges").df
    joined = nodes.join(node_centrality(nodes, adjacency(edges), error=error), "node_id", "left").join(supplier_counts(edges), "node_id", "left")
    c = F.coalesce("betweenness", F.lit(0.0))
    n = F.coalesce("num_suppliers", F.lit(1).cast("long"))
    concentration = F.lit(1.0) - F.lit(1.0) / n
    criticality = or_default(F.col("criticality"), 0.5)
    is_ap = F.coalesce("is_articulation_point", F.lit(False))
    return joined.select(
        "node_id", "name", "label",
        round_half_up(risk_score(c, concentration, criticality, is_ap), 4).alias("srs_score"),
        round_half_up(c, 4).alias("betweenness"),
        round_half_up(concentration, 4).alias("concentration"),
        round_half_up(criticality, 4).alias("criticality"),
        n.alias("num_suppliers"),
        is_ap.alias("is_articulation_point"),
    )


def score_run(metrics: DataFrame, run_at: Column) -> DataFrame:
    """The rows of one versioned score run, keyed by (node_id, run_at)."""
    return metrics.select("node_id", "name", "label", "srs_score", "betweenness", "concentration", "criticality",
                          "is_articulation_point", run_at.alias("run_at"))


def latest_scores(runs: DataFrame) -> DataFrame:
    """The stored scores: the latest run of each node."""
    newest = runs.groupBy("node_id").agg(F.max("run_at").alias("run_at"))
    return runs.join(newest, ["node_id", "run_at"], "left_semi")


def top_nodes(scores: DataFrame, n: int = 20) -> DataFrame:
    """The n highest stored scores, ties by node_id."""
    return scores.where(F.col("srs_score").isNotNull()).orderBy(F.desc("srs_score"), "node_id").limit(n)


def run_summary(metrics: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges and articulation points of a run; its top list is D10."""
    m = metrics.agg(F.count(F.lit(1)).alias("nodes_analyzed"),
                    F.count_if("is_articulation_point").alias("articulation_points"))
    e = edges.agg(F.count(F.lit(1)).alias("edges_analyzed"))
    both = m.select("nodes_analyzed", "articulation_points", F.lit(0).cast("long").alias("edges_analyzed")).unionByName(
        e.select(F.lit(0).cast("long").alias("nodes_analyzed"), F.lit(0).cast("long").alias("articulation_points"), "edges_analyzed"))
    return both.agg(F.sum("nodes_analyzed").alias("nodes_analyzed"), F.sum("edges_analyzed").alias("edges_analyzed"),
                    F.sum("articulation_points").alias("articulation_points"))


def what_if(nodes: DataFrame, edges: DataFrame, stored: DataFrame, excluded: str, error: float | None = None) -> DataFrame:
    """Scores of every remaining node before and after removing `excluded`.

    `stored` is the baseline (node_id, name, label, srs_score, is_articulation_point).  With `error`, the scores after
    the removal rest on sampled betweenness.
    """
    after = node_metrics(nodes.where(F.col("node_id") != excluded),
                         edges.where((F.col("src") != excluded) & (F.col("dst") != excluded)), error)
    before = stored.where((F.col("node_id") != excluded) & F.col("srs_score").isNotNull()).select(
        "node_id", "name", "label", F.round("srs_score", 4).alias("srs_before"),
        F.coalesce("is_articulation_point", F.lit(False)).alias("was_ap"))
    return before.join(after.select("node_id", F.col("srs_score").alias("srs_after"),
                                    F.col("is_articulation_point").alias("now_ap")), "node_id").select(
        "node_id", "name", "label", "srs_before", "srs_after",
        round_half_up(F.col("srs_after") - F.col("srs_before"), 4).alias("delta"), "was_ap", "now_ap")


def what_if_articulation(tree: BlockCutTree, nodes: DataFrame, excluded: str) -> DataFrame:
    """(node_id, was_ap, now_ap) of every remaining node of `nodes(node_id)`, from the stored blocks; see `BlockCutTree.without`."""
    was = tree.articulation_points().withColumn("_was", F.lit(True))
    now = tree.without(excluded).articulation_points().withColumn("_now", F.lit(True))
    left = nodes.select("node_id").where(F.col("node_id") != excluded).join(was, "node_id", "left").join(now, "node_id", "left")
    return left.select("node_id", F.coalesce("_was", F.lit(False)).alias("was_ap"), F.coalesce("_now", F.lit(False)).alias("now_ap"))


def largest_changes(comparison: DataFrame, n: int = 30) -> DataFrame:
    """The n largest absolute changes, ties by node_id."""
    return comparison.orderBy(F.desc(F.abs("delta")), "node_id").limit(n)


def what_if_summary(comparison: DataFrame) -> DataFrame:
    """Remaining nodes, articulation points before and after, total change."""
    return comparison.agg(
        F.count(F.lit(1)).alias("nodes_remaining"), F.count_if("was_ap").alias("old_ap_count"),
        F.count_if("now_ap").alias("new_ap_count"),
        round_half_up(F.sum("srs_after") - F.sum("srs_before"), 4).alias("total_srs_delta"))


def top_subgraph(scores: DataFrame, edges: DataFrame, n: int = 50, max_edges: int = 300) -> tuple[DataFrame, DataFrame]:
    """The n highest nodes and at most `max_edges` edges among them, in key order."""
    top = top_nodes(scores, n)
    ids = F.broadcast(top.select("node_id"))  # n rows
    inner = edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select("src", "dst", "relation")
    return top, inner.orderBy("src", "dst", "relation").limit(max_edges)


def located_companies(scores: DataFrame, edges: DataFrame) -> DataFrame:
    """Companies with the geography they are located in and their score."""
    company = scores.where(F.col("label") == "Company").select(
        F.col("node_id").alias("src"), F.col("name").alias("company_name"), F.coalesce("srs_score", F.lit(0.0)).alias("company_srs"))
    geo = scores.where(F.col("label") == "Geography").select(F.col("node_id").alias("dst"))
    placed = edges.where(F.col("relation") == "LOCATED_IN").select("src", "dst").distinct()
    return placed.join(company, "src").join(geo, "dst", "left_semi").select(
        F.col("dst").alias("geo_id"), F.col("src").alias("company_id"), "company_name", "company_srs")


def country_risk(scores: DataFrame, edges: DataFrame, hypotheses: DataFrame, iso3: DataFrame | None = None) -> DataFrame:
    """Per geography its own score raised to that of its riskiest company, counts, and first suppliers.

    The three first companies by score come from a per-country top-3, never from a full list.
    `iso3` (name, iso3) keeps only known countries; without it every geography is kept.
    """
    from pyspark.sql import Window

    geo = scores.where(F.col("label") == "Geography").select(
        "node_id", "name", F.coalesce("srs_score", F.lit(0.0)).alias("own_srs"), "is_articulation_point")
    if iso3 is not None:
        geo = geo.join(F.broadcast(iso3), "name")  # the fixed country table
    companies = located_companies(scores, edges)
    totals = companies.groupBy("geo_id").agg(F.max("company_srs").alias("max_srs"), F.count(F.lit(1)).alias("companies"))
    order = Window.partitionBy("geo_id").orderBy(F.desc("company_srs"), "company_id")
    first = companies.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= 3).groupBy("geo_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "company_name"))),
                                 lambda s: s["company_name"]), ", ").alias("key_suppliers"))
    linked = hypotheses.groupBy(F.col("node_id").alias("geo_id")).agg(F.count(F.lit(1)).alias("hypotheses"))
    out = geo.withColumnRenamed("node_id", "geo_id").join(totals, "geo_id", "left").join(first, "geo_id", "left").join(
        linked, "geo_id", "left")
    return out.select(
        "geo_id", "name", *(["iso3"] if iso3 is not None else []),
        F.greatest("own_srs", F.coalesce("max_srs", F.lit(0.0))).alias("srs"), "is_articulation_point",
        F.coalesce("companies", F.lit(0)).alias("companies"), F.coalesce("key_suppliers", F.lit("—")).alias("key_suppliers"),
        F.coalesce("hypotheses", F.lit(0)).alias("hypotheses"))


def iso3_table(spark) -> DataFrame:
    return spark.createDataFrame(list(vocab.COUNTRY_ISO3.items()), "name string, iso3 string")


def recent_evidence(mentions: DataFrame, docs: DataFrame, per_node: int = 10) -> DataFrame:
    """The newest documents mentioned with each node (top `per_node`, ties by uid)."""
    from pyspark.sql import Window

    m = mentions.join(docs.select(F.col("uid").alias("doc_uid"), "title", "source", "published_at"), "doc_uid")
    order = Window.partitionBy("node_id").orderBy(F.desc("published_at"), "doc_uid")
    return m.withColumn("position", F.row_number().over(order)).where(F.col("position") <= per_node)


def severity(top: DataFrame) -> DataFrame:
    """The top list lowest first, with the critical flag and a star for articulation points."""
    return top.select(
        "node_id", F.concat(F.when(F.col("is_articulation_point"), "★ ").otherwise(""), "name").alias("label"),
        "srs_score", (F.col("srs_score") > CRITICAL).alias("is_critical")).orderBy("srs_score", F.desc("node_id"))
