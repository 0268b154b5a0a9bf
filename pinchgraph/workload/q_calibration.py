"""Registered queries of section K."""

from __future__ import annotations

from pyspark.sql import functions as F

from pinchgraph.operators import calibration as cal
from pinchgraph.workload.q_resolution import stored_orphans
from pinchgraph.workload.registry import query
from pinchgraph.workload.views import HIGH, as_of


@query("k1_brier", """SELECT strftime(date_trunc('month', p), '%Y-%m-%d') AS month, count(*) AS n, round(avg((c - o) * (c - o)), 6) AS brier FROM (
  SELECT c, p, CASE WHEN a <= p THEN 1.0::DOUBLE WHEN p < TIMESTAMP '1998-06-01' THEN 0.0::DOUBLE END AS o FROM (
    SELECT (o_orderkey * 37 % 100) / 100.0::DOUBLE AS c, CAST(o_orderdate AS DATE) + 100 AS p,
      (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'R') AS a FROM orders))
WHERE o IS NOT NULL GROUP BY 1""")
def k1(v):
    """Orders as predictions: recognised when the last part that stays with the customer ships."""
    shipped = v.table("lineitem").where("l_returnflag <> 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.to_date("l_shipdate")).alias("actual_recognition_date"))
    log = v.table("orders").join(shipped, "o_orderkey", "left").select(
        ((F.col("o_orderkey") * 37 % 100) / 100.0).alias("confidence_at_log"), F.date_add(F.to_date("o_orderdate"), 100).alias("predicted_recognition_date"), "actual_recognition_date")
    return cal.brier_by_month(log, F.lit("1998-06-01").cast("timestamp")).select(F.col("month").cast("string").alias("month"), "n", F.round("brier", 6).alias("brier"))


@query("k2_correlated_evidence", """SELECT uid, node_id, round(1.0::DOUBLE / (SELECT count(DISTINCT x.doc_id % 23) FROM docs x WHERE x.source = d.source AND CAST(x.published_at AS DATE) = CAST(d.published_at AS DATE)), 6) AS weight
FROM (SELECT *, 'N-' || (doc_id % 23) AS node_id FROM docs) d""", "docs")
def k2(v):
    rows = v.docs.select("uid", F.concat(F.lit("N-"), (F.col("doc_id") % 23).cast("string")).alias("node_id"), "url", "published_at")
    return cal.correlated_weights(rows).select("uid", "node_id", F.round("weight", 6).alias("weight"))


@query("k3_source_weights", """SELECT uid, CASE WHEN CAST(substr(source, 4) AS INTEGER) % 3 = doc_id % 3 THEN 1.0 WHEN CAST(substr(source, 4) AS INTEGER) % 4 = 0 AND doc_id % 3 = 1 THEN 0.1 ELSE 0.5 END AS source_weight FROM docs""", "docs")
def k3(v):
    """Sources count in full in one of three domains, some hardly in another, and by half elsewhere."""
    number = F.substring("source", 4, 9).cast("int")
    named = v.table("documents").select("source", number.alias("k")).distinct()
    listed = named.select("source", F.concat(F.lit("D"), (F.col("k") % 3).cast("string")).alias("domain"), F.lit(1.0).alias("weight"))
    little = named.where("k % 4 = 0").select("source", F.lit("D1").alias("domain"), F.lit(0.1).alias("weight"))
    rows = v.docs.select("uid", "source", F.concat(F.lit("D"), (F.col("doc_id") % 3).cast("string")).alias("domain"))
    return cal.source_weights(rows, listed.unionByName(little)).select("uid", "source_weight")


@query("k4_concentration", """SELECT item, suppliers, round(cr3, 6) AS cr3, CASE WHEN cr3 >= 0.90 THEN 'chokepoint' WHEN cr3 >= 0.70 THEN 'warning' ELSE 'none' END AS level FROM (
  SELECT item, count(*) AS suppliers, sum(a) FILTER (r <= 3) / sum(a) AS cr3 FROM (
    SELECT l_partkey AS item, l_suppkey, sum(l_quantity) AS a, row_number() OVER (PARTITION BY l_partkey ORDER BY sum(l_quantity) DESC, l_suppkey) AS r FROM lineitem GROUP BY 1, 2) GROUP BY 1)""")
def k4(v):
    supply = v.table("lineitem").select(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("supplier"), F.col("l_quantity").alias("amount"))
    return cal.concentration_ratio(supply).withColumn("cr3", F.round("cr3", 6))


@query("k5_orphan_clusters", """SELECT strftime(date_trunc('week', c), '%Y-%m-%d') AS week, best_node, count(*) AS n, round(avg(best_similarity), 6) AS mean_similarity, arg_min(uid, strftime(c, '%Y%m%d%H%M%S') || uid) AS oldest_uid
FROM (SELECT *, TIMESTAMP '2024-01-31 00:00:00' - to_days(CAST(CASE WHEN vec_id % 2 = 0 THEN vec_id % 30 ELSE 0 END AS INTEGER)) AS c FROM orphaned) WHERE vec_id % 4 <> 0 GROUP BY 1, 2""", "orphaned")
def k5(v):
    return cal.orphan_clusters(stored_orphans(v)).withColumn("week", F.col("week").cast("string")).withColumn("mean_similarity", F.round("mean_similarity", 6))


# every pair of pending orphans, then smallest names travelling along links
@query("k5_orphan_topics", """WITH pending AS MATERIALIZED (SELECT o.uid, best_node, c, CAST(embedding AS DOUBLE[]) AS e FROM (SELECT *, TIMESTAMP '2024-01-31 00:00:00' - to_days(CAST(CASE WHEN vec_id % 2 = 0 THEN vec_id % 30 ELSE 0 END AS INTEGER)) AS c FROM orphaned) o
  JOIN embeddings USING (vec_id) WHERE vec_id % 4 <> 0),
links AS MATERIALIZED (SELECT a.uid AS a, b.uid AS b FROM pending a, pending b WHERE a.uid <> b.uid AND list_cosine_similarity(a.e, b.e) >= 0.36),
named AS (SELECT x AS uid, min(y) AS cluster FROM (WITH RECURSIVE reach AS (SELECT uid AS x, uid AS y FROM pending UNION SELECT r.x, l.b FROM reach r JOIN links l ON l.a = r.y) SELECT * FROM reach) GROUP BY 1)
SELECT cluster, count(*) AS n, count(DISTINCT best_node) AS nodes, arg_min(uid, strftime(c, '%Y%m%d%H%M%S') || uid) AS oldest_uid, strftime(min(c), '%Y-%m-%d') AS first_seen, strftime(max(c), '%Y-%m-%d') AS last_seen
FROM pending JOIN named USING (uid) GROUP BY cluster HAVING count(*) > 1""", "orphaned")
def k5_topics(v):
    """The given vectors have hardly any direction in common, so the threshold is the one that splits them."""
    stored = stored_orphans(v).drop("embedding").join(v.doc_vectors, "doc_uid")
    found = cal.orphan_topics(stored, threshold=HIGH, recall=0.99999)
    return found.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first_seen", "last_seen")})
