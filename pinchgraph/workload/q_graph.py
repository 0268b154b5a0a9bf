"""Registered queries of section D."""

from __future__ import annotations

from pyspark.sql import functions as F

from pinchgraph.operators import graph, risk, sampling
from pinchgraph.workload.registry import query
from pinchgraph.workload.sqlviews import EXCLUDED
from pinchgraph.workload.views import as_of



@query("d1_load_graph", """SELECT label, count(*) AS n FROM nodes GROUP BY label UNION ALL
SELECT relation, count(*) FROM edges WHERE src IN (SELECT node_id FROM nodes) AND dst IN (SELECT node_id FROM nodes) GROUP BY 1""", "nodes edges")
def d1(v):
    nodes = graph.load_nodes(v.nodes)
    edges = graph.load_edges(v.edges, nodes)
    return nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).unionByName(
        edges.groupBy(F.col("relation").alias("label")).agg(F.count(F.lit(1)).alias("n")))


_SUPPLY = """SELECT DISTINCT 'COMP-' || l_suppkey AS src, 'MAT-' || l_partkey AS dst FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier) AND l_partkey IN (SELECT p_partkey FROM part)"""


@query("d2_adjacency", f"SELECT src, dst FROM ({_SUPPLY}) UNION SELECT dst, src FROM ({_SUPPLY})")
def d2(v):
    return graph.adjacency(graph.load_edges(v.supply_edges, v.supply_nodes))


@query("d3_supplier_counts", f"SELECT dst AS node_id, count(DISTINCT src) AS num_suppliers FROM ({_SUPPLY}) GROUP BY 1")
def d3(v):
    return graph.supplier_counts(graph.load_edges(v.supply_edges, v.supply_nodes))


@query("d4_d5_centrality", "SELECT node_id, round(betweenness, 6) AS betweenness, node_id IN (SELECT node_id FROM apoints) AS is_articulation_point FROM between", "between apoints")
def d4_d5(v):
    nodes = graph.load_nodes(v.nodes)
    return graph.node_centrality(nodes, graph.adjacency(graph.load_edges(v.edges, nodes))).withColumn(
        "betweenness", F.round("betweenness", 6))


@query("d4_betweenness", "SELECT node_id, round(betweenness, 6) AS betweenness FROM between", "between")
def d4(v):
    nodes = graph.load_nodes(v.nodes)
    adj = graph.adjacency(graph.load_edges(v.edges, nodes))
    return graph.betweenness(nodes, adj).withColumn("betweenness", F.round("betweenness", 6))


@query("d5_articulation_points", "SELECT node_id FROM apoints", "apoints")
def d5(v):
    nodes = graph.load_nodes(v.nodes)
    return graph.articulation_points(nodes, graph.adjacency(graph.load_edges(v.edges, nodes)))


@query("d6_components", """SELECT x AS node_id, min(v) AS component FROM (
WITH RECURSIVE comp AS (SELECT node_id AS x, node_id AS v FROM nodes UNION SELECT c.x, a.dst FROM comp c JOIN adj a ON a.src = c.v) SELECT * FROM comp) GROUP BY 1""", "nodes adj")
def d6(v):
    nodes = graph.load_nodes(v.nodes)
    return graph.components(nodes, graph.adjacency(graph.load_edges(v.edges, nodes)))


@query("d4_sampled_betweenness")
def d4_sampled(v):
    """Betweenness of the supplier-part graph of every order line, off by 0.05 at most with a risk of 1 in 20."""
    return sampling.sampled_betweenness(v.supply_nodes, graph.adjacency(graph.load_edges(v.supply_edges, v.supply_nodes)))


@query("d5_blocks", "SELECT node_id FROM apoints", "apoints")
def d5_blocks(v):
    """Articulation points as the nodes that lie in two blocks."""
    nodes = graph.load_nodes(v.nodes)
    return graph.block_cut_tree(nodes, graph.adjacency(graph.load_edges(v.edges, nodes))).articulation_points()


# minimum labels travelling ten steps, more than the supplier-part graph is wide
_ROUNDS = "WITH pairs AS MATERIALIZED (SELECT src, dst FROM (" + _SUPPLY + ") UNION SELECT dst, src FROM (" + _SUPPLY + """)),
l0 AS MATERIALIZED (SELECT 'COMP-' || s_suppkey AS v, 'COMP-' || s_suppkey AS c FROM supplier UNION ALL SELECT 'MAT-' || p_partkey, 'MAT-' || p_partkey FROM part)""" + "".join(
    f""", l{i + 1} AS MATERIALIZED (SELECT v, min(c) AS c FROM (SELECT v, c FROM l{i} UNION ALL SELECT p.src, l.c FROM pairs p JOIN l{i} l ON l.v = p.dst) GROUP BY 1)"""
    for i in range(10))


@query("d6_supply_components", f"{_ROUNDS} SELECT c AS component, count(*) AS size FROM l10 GROUP BY 1")
def d6_supply(v):
    """Component sizes of the supplier-part graph built from every order line."""
    c = graph.components(v.supply_nodes, graph.adjacency(v.supply_edges))
    return c.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


_S = "node_id, name, label, srs_score, betweenness, concentration, criticality, num_suppliers, is_articulation_point"


@query("d7_node_metrics", f"SELECT {_S} FROM scores", "scores")
def d7(v):
    return risk.node_metrics(v.nodes, v.edges)


@query("d8_score_run", "SELECT node_id, srs_score, betweenness, is_articulation_point, '2024-01-31' AS run FROM scores", "scores")
def d8(v):
    older = risk.score_run(v.node_scores().withColumn("srs_score", F.lit(0.0)), as_of() - F.expr("INTERVAL 7 DAYS"))
    runs = older.unionByName(risk.score_run(v.node_scores(), as_of()))
    return risk.latest_scores(runs).select("node_id", "srs_score", "betweenness", "is_articulation_point",
                                           F.date_format("run_at", "yyyy-MM-dd").alias("run"))


@query("d9_run_summary", """SELECT count(*) AS nodes_analyzed, CAST((SELECT count(*) FROM edges) AS BIGINT) AS edges_analyzed,
count(*) FILTER (is_articulation_point) AS articulation_points FROM scores""", "scores edges")
def d9(v):
    return risk.run_summary(v.node_scores(), v.edges)


@query("d10_top_nodes", "SELECT node_id, name, label, srs_score FROM scores ORDER BY srs_score DESC, node_id LIMIT 20", "scores")
def d10(v):
    return risk.top_nodes(v.node_scores()).select("node_id", "name", "label", "srs_score")


def _comparison(v):
    return risk.what_if(v.nodes, v.edges, v.node_scores(), EXCLUDED)


_CMP = """(SELECT b.node_id, b.name, b.label, b.srs_score AS srs_before, a.srs_score AS srs_after, CAST(round(CAST(a.srs_score - b.srs_score AS DECIMAL(18, 10)), 4) AS DOUBLE) AS delta,
b.is_articulation_point AS was_ap, a.is_articulation_point AS now_ap FROM scores b JOIN scores_x a USING (node_id))"""


@query("d11_what_if", f"SELECT * FROM {_CMP} ORDER BY abs(delta) DESC, node_id LIMIT 30", "scores scores_x")
def d11(v):
    """The largest score changes after removing one country."""
    return risk.largest_changes(_comparison(v))


@query("d11_what_if_summary", f"""SELECT count(*) AS nodes_remaining, count(*) FILTER (was_ap) AS old_ap_count, count(*) FILTER (now_ap) AS new_ap_count,
round(sum(srs_after) - sum(srs_before), 4) AS total_srs_delta FROM {_CMP}""", "scores scores_x")
def d11_summary(v):
    return risk.what_if_summary(_comparison(v))


@query("d11_what_if_blocks", "SELECT b.node_id, b.is_articulation_point AS was_ap, a.is_articulation_point AS now_ap FROM scores b JOIN scores_x a USING (node_id)", "scores scores_x")
def d11_blocks(v):
    """Articulation points before and after removing one country; only its blocks are searched again."""
    nodes = graph.load_nodes(v.nodes)
    return risk.what_if_articulation(graph.block_cut_tree(nodes, graph.adjacency(graph.load_edges(v.edges, nodes))), nodes, EXCLUDED)


@query("d11_what_if_sampled", "SELECT b.node_id, b.name, b.srs_score AS srs_before, b.is_articulation_point AS was_ap, a.is_articulation_point AS now_ap FROM scores b JOIN scores_x a USING (node_id)", "scores scores_x")
def d11_sampled(v):
    """The removal with sampled betweenness; what does not depend on the sample."""
    return risk.what_if(v.nodes, v.edges, v.node_scores(), EXCLUDED, error=0.1).select("node_id", "name", "srs_before", "was_ap", "now_ap")


@query("d12_top_subgraph", """SELECT src, dst, relation FROM edges WHERE src IN (SELECT node_id FROM scores ORDER BY srs_score DESC, node_id LIMIT 50)
AND dst IN (SELECT node_id FROM scores ORDER BY srs_score DESC, node_id LIMIT 50) ORDER BY src, dst, relation LIMIT 300""", "scores edges")
def d12(v):
    return risk.top_subgraph(v.node_scores(), v.edges)[1]


@query("d13_country_risk", """SELECT g.node_id AS geo_id, g.name, greatest(g.srs_score, coalesce(max(c.srs_score), 0)) AS srs, g.is_articulation_point,
count(c.node_id) AS companies, CAST((SELECT count(*) FROM hyps h WHERE h.node_id = g.node_id) AS BIGINT) AS hypotheses,
coalesce(string_agg(c.name, ', ' ORDER BY c.r) FILTER (c.r <= 3), '—') AS key_suppliers
FROM scores g LEFT JOIN (SELECT s.node_id, s.name, s.srs_score, e.dst, row_number() OVER (PARTITION BY e.dst ORDER BY s.srs_score DESC, s.node_id) AS r
  FROM scores s JOIN edges e ON e.src = s.node_id AND e.relation = 'LOCATED_IN' WHERE s.label = 'Company') c ON c.dst = g.node_id
WHERE g.label = 'Geography' GROUP BY g.node_id, g.name, g.srs_score, g.is_articulation_point""", "scores edges hyps")
def d13(v):
    return risk.country_risk(v.node_scores(), v.edges, v.hyps)


@query("d14_countries_ranked", """SELECT g.node_id AS geo_id, greatest(g.srs_score, coalesce(max(c.srs_score), 0)) AS srs
FROM scores g LEFT JOIN (edges e JOIN scores c ON c.node_id = e.src AND c.label = 'Company') ON e.dst = g.node_id AND e.relation = 'LOCATED_IN'
WHERE g.label = 'Geography' GROUP BY g.node_id, g.srs_score ORDER BY srs DESC, geo_id""", "scores edges")
def d14(v):
    return risk.country_risk(v.node_scores(), v.edges, v.hyps).select("geo_id", "srs").orderBy(F.desc("srs"), "geo_id")


@query("d15_recent_evidence", """SELECT node_id, doc_uid, title, CAST(position AS INTEGER) AS position FROM (SELECT m.node_id, m.doc_uid, d.title, row_number() OVER (PARTITION BY m.node_id ORDER BY d.published_at DESC, m.doc_uid) AS position
FROM mentions m JOIN docs d ON d.uid = m.doc_uid) WHERE position <= 10""", "mentions docs")
def d15(v):
    return risk.recent_evidence(v.mentions, v.docs).select("node_id", "doc_uid", "title", "position")


@query("d16_severity", """SELECT node_id, CASE WHEN is_articulation_point THEN '★ ' ELSE '' END || name AS label, srs_score, srs_score > 0.6 AS is_critical
FROM (SELECT * FROM scores ORDER BY srs_score DESC, node_id LIMIT 20)""", "scores")
def d16(v):
    return risk.severity(risk.top_nodes(v.node_scores()))
