"""Logical inputs of the jobs as views over the driver's tables.

`sqlviews` states the same views in SQL.  `as_of()` stands for "now" in every query.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pinchgraph.operators import ach, commodities, resolution, risk, scoring, vectors
from pinchgraph.storage import materialize, spread

AS_OF_TEXT = "2024-01-31 00:00:00"
HIGH, LOW = 0.36, 0.30  # thresholds that split the given vectors; the defaults would orphan all of them



def as_of() -> Column:
    return F.lit(AS_OF_TEXT).cast("timestamp")


_SCHEMAS: dict[tuple[str, str, str], StructType] = {}
_COUNTS: dict[tuple[str, str, str], int] = {}
_NODE_SCORES: dict[tuple[str, str], DataFrame] = {}


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def table(self, name: str) -> DataFrame:
        """A driver table; its schema is read from the files once per session."""
        key = (self.spark.sparkContext.applicationId, self.dir, name)
        path = f"{self.dir}/{name}.parquet"
        if key not in _SCHEMAS:
            _SCHEMAS[key] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[key]).parquet(path)

    def rows(self, name: str) -> int:
        """The rows of a driver table, counted from the file footers once per session."""
        key = (self.spark.sparkContext.applicationId, self.dir, name)
        if key not in _COUNTS:
            _COUNTS[key] = Views.table(self, name).count()
        return _COUNTS[key]

    def texts(self, name: str) -> DataFrame:
        """A table of long texts, dealt over the cores when it has few splits."""
        return spread(self.table(name))

    @cached_property
    def docs(self) -> DataFrame:
        d, labels = self.texts("documents"), self.table("labels").select("doc_id", F.lit(True).alias("_l"))
        e = self.table("events").select(  # event times, spread over the month
            F.col("event_id").alias("doc_id"),
            (F.col("ts").cast("timestamp") + F.make_dt_interval(days=(F.col("event_id") % 24).cast("int"))).alias("published_at"))
        key = F.col("doc_id").cast("string")
        return d.join(e, "doc_id", "left").join(labels, "doc_id", "left").select(
            "doc_id", F.concat(F.lit("doc:"), key).alias("uid"), F.left("text", F.lit(120)).alias("title"), "text",
            F.concat(F.lit("https://"), "source", F.lit(".example.org/d/"), key).alias("url"), "source", "lang",
            (F.col("doc_id") % 4 + 1).cast("int").alias("ias_tier"), "published_at",
            F.when(F.col("_l"), "processed").otherwise("pending").alias("status"), F.col("published_at").alias("ingested_at"),
            F.concat(F.lit('{"lang":"'), "lang", F.lit('"}')).alias("metadata"))

    @cached_property
    def concepts(self) -> DataFrame:
        words = F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))
        return self.table("benchmark").withColumn("_w", words).select(
            F.concat(F.lit("C-"), F.col("item_id").cast("string")).alias("id"), F.lit("Material").alias("label"),
            F.concat_ws(" ", F.try_element_at("_w", F.lit(1)), F.try_element_at("_w", F.lit(2))).alias("name"),
            F.array_distinct("_w").alias("aliases"), F.left("text", F.lit(80)).alias("description"), "item_id")

    @cached_property
    def nodes(self) -> DataFrame:
        none = F.lit(None).cast("double")

        def part(df: DataFrame, node_id, name, label: str, criticality=none) -> DataFrame:
            return df.select(node_id.alias("node_id"), name.alias("name"), F.lit(label).alias("label"),
                             criticality.alias("criticality"))

        p = self.table("part")
        s = self.table("supplier")
        parts = [
            part(self.table("region"), F.concat(F.lit("GEO-R"), F.col("r_regionkey").cast("string")), F.col("r_name"), "Geography"),
            part(self.table("nation"), F.concat(F.lit("GEO-N"), F.col("n_nationkey").cast("string")), F.col("n_name"), "Geography"),
            part(s, F.concat(F.lit("COMP-"), F.col("s_suppkey").cast("string")), F.col("s_name"), "Company", self._wealth()),
            part(p.select("p_brand").distinct(), F.concat(F.lit("TECH-"), "p_brand"), F.col("p_brand"), "Technology"),
            part(p.select("p_type").distinct(), F.concat(F.lit("PROC-"), "p_type"), F.col("p_type"), "Process"),
        ]
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    @staticmethod
    def _wealth():
        return (F.col("s_acctbal") + 1000) / 11000

    @cached_property
    def edges(self) -> DataFrame:
        s, n, p = self.table("supplier"), self.table("nation"), self.table("part")
        revenue = self.table("lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey", "p_brand").agg(
            F.sum("l_extendedprice").alias("rev"))
        top = revenue.groupBy("l_suppkey").agg(F.min(F.struct((-F.col("rev")).alias("neg"), "p_brand")).alias("t"))
        types = p.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n")).groupBy("p_brand").agg(
            F.min(F.struct((-F.col("n")).alias("neg"), "p_type")).alias("t"))

        def edge(df: DataFrame, src, dst, relation: str) -> DataFrame:
            return df.select(src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"))

        def key(prefix: str, column: str):
            return F.concat(F.lit(prefix), F.col(column).cast("string"))

        suppliers = s.select("s_suppkey")
        out = edge(s, key("COMP-", "s_suppkey"), key("GEO-N", "s_nationkey"), "LOCATED_IN")
        out = out.unionByName(edge(n, key("GEO-N", "n_nationkey"), key("GEO-R", "n_regionkey"), "LOCATED_IN"))
        out = out.unionByName(edge(top.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")), key("COMP-", "l_suppkey"),
                                   F.concat(F.lit("TECH-"), "t.p_brand"), "PRODUCES"))
        return out.unionByName(edge(types, F.concat(F.lit("TECH-"), "p_brand"), F.concat(F.lit("PROC-"), "t.p_type"), "USES"))

    @cached_property
    def supply_nodes(self) -> DataFrame:
        """Suppliers and parts as one bipartite graph."""
        return self.table("supplier").select(F.concat(F.lit("COMP-"), F.col("s_suppkey").cast("string")).alias("node_id")).union(
            self.table("part").select(F.concat(F.lit("MAT-"), F.col("p_partkey").cast("string")).alias("node_id")))

    @cached_property
    def supply_edges(self) -> DataFrame:
        return self.table("lineitem").select("l_suppkey", "l_partkey").distinct().select(
            F.concat(F.lit("COMP-"), F.col("l_suppkey").cast("string")).alias("src"),
            F.concat(F.lit("MAT-"), F.col("l_partkey").cast("string")).alias("dst"), F.lit("PRODUCES").alias("relation"))

    def node_scores(self) -> DataFrame:
        """Stored scores: computed once per session and data folder, then read back, as reports do."""
        key = (self.spark.sparkContext.applicationId, self.dir)
        if key not in _NODE_SCORES:
            _NODE_SCORES[key] = materialize(risk.node_metrics(self.nodes, self.edges), "node-scores").df
        return _NODE_SCORES[key]

    @cached_property
    def hyps(self) -> DataFrame:
        words = F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))
        b = self.table("benchmark").select(F.col("item_id").alias("_item"), F.initcap(words[0]).alias("_w1"), F.initcap(words[1]).alias("_w2"))
        k = F.col("s_suppkey")
        s = self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(
            b, k % self.rows("benchmark") == F.col("_item"))

        def ago(days):
            return as_of() - F.make_dt_interval(days=days.cast("int"))

        return s.select(
            F.concat(F.lit("H-"), k.cast("string")).alias("id"), F.concat(F.lit("COMP-"), k.cast("string")).alias("node_id"),
            F.col("s_name").alias("node_name"),
            F.concat(F.lit("Output of "), "s_name", F.lit(" limits "), "_w1", F.lit(" and "), "_w2", F.lit(" supply in "), "n_name").alias("statement"),
            F.round(F.lit(0.40) + F.lit(0.5) * ((k * 37) % 100) / 100.0, 3).alias("confidence"),
            F.when(k % 10 == 9, "confirmed").when(k % 10 == 8, "stale").otherwise("active").alias("status"),
            (k % 4 + 1).cast("int").alias("awareness_layer"), (k % 5).cast("int").alias("n_criteria"),
            self._wealth().alias("srs_score_at_creation"), (k % 3 == 0).alias("ach_reviewed"),
            ago((k * 7) % 45).alias("created_at"), F.when(k % 11 != 0, ago((k * 5) % 40)).alias("updated_at"), "s_suppkey")

    @cached_property
    def evidence(self) -> DataFrame:
        """One piece of evidence per event, for the supplier of the user's number."""
        e = self.table("events").withColumn("_h", F.col("user_id") % self.rows("supplier"))
        prefix = (F.when(F.col("event_id") % 6 == 0, "github:").when(F.col("event_id") % 6 == 1, "arxiv:")
                  .when(F.col("event_id") % 6 == 2, "hn:").when(F.col("event_id") % 6 == 3, "rss_nyt:")
                  .when(F.col("event_id") % 6 == 4, "jobs_x:").otherwise("zz:"))
        rows = e.select(
            F.concat(F.lit("H-"), F.col("_h").cast("string")).alias("hypothesis_id"),
            F.concat(prefix, F.col("event_id").cast("string")).alias("doc_uid"), F.col("ts").cast("timestamp").alias("ts"),
            (F.col("event_type") != "error").alias("supports"),
            F.concat(F.lit("["), F.left(F.concat(prefix, F.col("event_id").cast("string")), F.lit(12)), F.lit("] "),
                     "event_type", F.lit(" of user "), F.col("user_id").cast("string")).alias("line"))
        return rows.join(self.hyps.select(F.col("id").alias("hypothesis_id")), "hypothesis_id", "left_semi")

    @cached_property
    def hyps_counted(self) -> DataFrame:
        """Hypotheses with their evidence counts."""
        c = self.evidence.groupBy(F.col("hypothesis_id").alias("id")).agg(
            F.count_if("supports").alias("evidence_for"), F.count_if(~F.col("supports")).alias("evidence_against"))
        zero = F.lit(0).cast("long")
        return self.hyps.join(c, "id", "left").withColumn("evidence_for", F.coalesce("evidence_for", zero)).withColumn(
            "evidence_against", F.coalesce("evidence_against", zero))

    @cached_property
    def cells(self) -> DataFrame:
        """Matrix cells: one per supplier, part number mod 4, and order number mod a supplier-specific size."""
        rows = self.table("lineitem").select(
            F.concat(F.lit("H-"), F.col("l_suppkey").cast("string")).alias("hypothesis_id"),
            (F.col("l_partkey") % 4).cast("int").alias("alt_no"),
            (F.col("l_orderkey") % (100 + 120 * (F.col("l_suppkey") % 20))).alias("evidence_no"),
            F.when(F.col("l_returnflag") == "A", "C").when(F.col("l_returnflag") == "R", "I").otherwise("N").alias("class"))
        return ach.one_class_per_cell(rows)

    @cached_property
    def reviews(self) -> DataFrame:
        done = self.hyps.where("ach_reviewed").select("id", "s_suppkey")
        r = ach.robustness(self.cells).join(done, F.col("hypothesis_id") == F.col("id"))
        return r.select(
            "hypothesis_id", F.col("robustness"), (F.col("robustness") >= ach.PASS_ROBUSTNESS).alias("passed"),
            (as_of() - F.make_dt_interval(days=(F.col("s_suppkey") % 20).cast("int"))).alias("reviewed_at"),
            (F.col("s_suppkey") % 2 == 0).alias("human_approved"))

    @cached_property
    def scored(self) -> DataFrame:
        return scoring.score(self.hyps_counted, self.reviews, as_of())

    @cached_property
    def node_vectors(self) -> DataFrame:
        """Every fifth vector is that of a node, so nodes grow with the documents."""
        return self.table("embeddings").where("vec_id % 5 = 0").select(
            F.concat(F.lit("COMP-"), F.floor(F.col("vec_id") / 5).cast("string")).alias("node_id"), F.lit("Company").alias("label"), "embedding")

    @cached_property
    def doc_vectors(self) -> DataFrame:
        return self.table("embeddings").where("vec_id % 5 <> 0").select(
            F.concat(F.lit("doc:"), F.col("vec_id").cast("string")).alias("doc_uid"), "embedding")

    @cached_property
    def routed(self) -> DataFrame:
        return resolution.route(vectors.top_k_nodes(self.doc_vectors, self.node_vectors, 10), HIGH, LOW)

    @cached_property
    def choices_raw(self) -> DataFrame:
        """Answers for every document vector: the label picks a node, some answers are unusable."""
        e = self.table("embeddings").where("vec_id % 5 <> 0")
        v = F.col("vec_id").cast("string")
        node = F.concat(F.lit("COMP-"), (F.col("vec_id") * 13 % 100).cast("string"))
        best = self.routed.select("doc_uid", "best_node")
        rows = e.select(F.concat(F.lit("doc:"), v).alias("doc_uid"), "vec_id", node.alias("_node")).join(best, "doc_uid", "left")
        pick = (F.when(F.col("vec_id") % 11 == 0, F.lit("null")).when(F.col("vec_id") % 5 == 1, F.concat(F.lit('"id='), "best_node", F.lit('"')))
                .when(F.col("vec_id") % 5 == 2, F.concat(F.lit('"'), "_node", F.lit('"'))).otherwise(F.concat(F.lit('"'), "best_node", F.lit('"'))))
        conf = F.when(F.col("vec_id") % 7 == 0, "0.55").otherwise("0.9")
        return rows.select("doc_uid", F.concat(F.lit('Answer: {"node_id": '), pick, F.lit(', "confidence": '), conf,
                                               F.lit(', "reason": "closest"} end')).alias("response"))

    @cached_property
    def mentions(self) -> DataFrame:
        return resolution.auto_mentions(self.routed, as_of(), HIGH)

    @cached_property
    def news(self) -> DataFrame:
        k = F.col("doc_id")
        topics = (F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 5 == 1, "").when(k % 5 == 2, '["Tech","Energy"]')
                  .when(k % 5 == 3, "Tech, Energy,,").otherwise('{"a":1}'))
        return self.docs.select("uid", "title", "url", "source", ((k % 10) / 10.0).alias("sentiment_score"),
                                F.when(k % 2 == 0, "positive").otherwise("negative").alias("sentiment_label"),
                                topics.alias("topics"), F.col("published_at").alias("first_seen"))

    @cached_property
    def news_ledger(self) -> DataFrame:
        return self.table("labels").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("uid"))

    @cached_property
    def alert_ledger(self) -> DataFrame:
        k = F.col("s_suppkey")
        layers = F.array_compact(F.array(F.when(k % 7 == 0, 4), F.when(k % 6 == 0, 98), F.when(k % 5 == 0, 99)))
        return self.hyps.select(F.col("id").alias("hypothesis_id"), F.explode(layers).alias("layer"), as_of().alias("alerted_at"))

    @cached_property
    def commodity_results(self) -> DataFrame:
        """Monthly figures per brand as the nine sub-scores; every 17th total stands for a failed answer."""
        li = self.table("lineitem").join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(
            self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
        g = li.groupBy(F.to_date(F.date_trunc("month", F.col("o_orderdate").cast("timestamp"))).alias("run_date"), F.col("p_brand").alias("commodity")).agg(
            F.sum("l_quantity").cast("long").alias("q"), F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_if(F.col("l_returnflag") == "A").alias("a"),
            F.sum("l_linenumber").alias("l"))
        q, n = F.col("q"), F.col("n")
        raw = [q % 121, n * 7 % 121, (q + n) % 101, q * 3 % 101, F.col("r") * 5 % 101, F.col("a") * 11 % 101,
               F.col("l") * 3 % 101, n % 101, F.floor(q / 10) % 101]
        from pinchgraph.functions.scores import stress_score, sub_score
        from pinchgraph.functions.vocab import STRESS_WEIGHTS

        g = g.select("run_date", "commodity", (q % 17 == 0).alias("parse_error"), (q % 5 + 1).cast("int").alias("confidence"),
                     F.substring_index("commodity", "#", -1).cast("int").alias("position"),
                     *[sub_score(c.cast("string")).alias(name) for name, c in zip(STRESS_WEIGHTS, raw)])
        return g.withColumn("supply_stress_score", F.when(~F.col("parse_error"), stress_score({c: F.col(c) for c in STRESS_WEIGHTS})))

    @cached_property
    def rankings(self) -> DataFrame:
        return commodities.with_delta_all_runs(commodities.rank(self.commodity_results))

    @cached_property
    def model_answers(self) -> DataFrame:
        """One raw answer per event in six forms: fenced, in prose, cut short, missing, plain, cut inside."""
        k = F.get_json_object("props", "$.k")
        form = F.col("event_id") % 6
        head = F.concat(F.lit('{"supply_growth_score": '), k, F.lit(', "demand_growth_score": "'), k, F.lit('.7", "geopolitical_risk_score": "n/a", "inventory_depletion_score": 250, "outlook_6m": "'),
                        F.when(F.col("event_type") == "click", "Very Bearish.").when(F.col("event_type") == "view", "recovering").when(F.col("event_type") == "error", "BULLISH").otherwise("flat"),
                        F.lit('", "confidence": '), (F.col("event_id") % 9).cast("string"), F.lit(', "consensus": "'),
                        F.when(F.col("event_type") == "view", "sharply split").when(F.col("event_type") == "error", "clear").otherwise("unsure"),
                        F.lit('", "key_catalysts": ["a", "b"], "key_risks": "none"'))
        response = (F.when(form == 0, F.concat(F.lit("```json\n"), head, F.lit("}\n```")))
                    .when(form == 1, F.concat(F.lit("Here: "), head, F.lit("} as asked.")))
                    .when(form == 2, head).when(form == 3, F.lit("no answer")).when(form == 4, F.concat(head, F.lit("}")))
                    .otherwise(F.concat(head, F.lit(', "extra": {"x": 1}'))))
        return self.texts("events").select(
            F.to_date(F.col("ts").cast("timestamp")).alias("run_date"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("commodity"),
            F.col("event_type").alias("sector"), response.alias("response"))
