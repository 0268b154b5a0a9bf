"""Registered queries of section B."""

from __future__ import annotations

from pyspark.sql import functions as F

from pinchgraph.functions import jsontext, text, vocab
from pinchgraph.operators import mentions, vectors
from pinchgraph.sources import documents
from pinchgraph.workload.registry import query
from pinchgraph.workload.sqlviews import A, r
from pinchgraph.workload.views import as_of

_SP = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _clean(c: str) -> str:
    return (rf"left(trim(regexp_replace(regexp_replace(regexp_replace({c}, '<[^>]+>', ' ', 'g'), 'https?://[^{_SP}]+', ' ', 'g'), "
            rf"'[{_SP}]+', ' ', 'g')), 7500)")


@query("b1_clean_text", f"SELECT page_id, url, md5({_clean('html')}) AS digest, length({_clean('html')}) AS chars FROM pages")
def b1(v):
    p = v.texts("pages").select("page_id", "url", text.clean_text("html").alias("t"))
    return p.select("page_id", "url", F.md5("t").alias("digest"), F.length("t").cast("long").alias("chars"))


@query("b1_clean_documents", f"SELECT doc_id, md5({_clean('text')}) AS digest FROM documents")
def b1_docs(v):
    return v.texts("documents").select("doc_id", F.md5(text.clean_text("text")).alias("digest"))


@query("b2_name_dictionary", "SELECT DISTINCT name FROM (SELECT name FROM concepts UNION ALL SELECT unnest(aliases) FROM concepts)", "concepts")
def b2(v):
    return mentions.name_dictionary(v.concepts)


# words and space-separated word pairs of the cleaned text, compared with the lower-cased names
_MENTIONS = f"""
runs AS (SELECT doc_id, unnest(regexp_extract_all(lower({_clean('text')}), '[\\p{{L}}\\p{{N}}_]+(?: [\\p{{L}}\\p{{N}}_]+)*')) AS run FROM documents),
words AS (SELECT doc_id, string_split(run, ' ') AS w FROM runs),
grams AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(w) AS g FROM words UNION ALL
  SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words)),
names AS (SELECT DISTINCT name FROM (SELECT name FROM concepts UNION ALL SELECT unnest(aliases) FROM concepts) WHERE length(name) >= 3),
found AS (SELECT doc_id, name FROM grams JOIN names ON lower(name) = g)"""


@query("b3_mentions", f"SELECT * FROM (WITH {_MENTIONS} SELECT 'doc:' || doc_id AS uid, name FROM found)", "concepts")
def b3(v):
    docs = v.texts("documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("uid"), text.clean_text("text").alias("text"))
    return mentions.find_mentions(docs, mentions.name_dictionary(v.concepts))


@query("b4_process_batch", f"""SELECT * FROM (WITH {_MENTIONS}, batch AS (SELECT * FROM docs WHERE status = 'pending' ORDER BY ingested_at, uid LIMIT 50)
SELECT b.uid, md5({_clean('b.text')}) AS digest, count(f.name) AS n_candidates, coalesce(min(f.name), '') AS first_candidate
FROM batch b LEFT JOIN found f ON f.doc_id = b.doc_id GROUP BY b.uid, b.text)""", "concepts docs")
def b4(v):
    done = mentions.process_batch(documents.pending(v.docs, 50), mentions.name_dictionary(v.concepts))
    return done.select("uid", F.md5("text").alias("digest"), F.size("candidate_entities").cast("long").alias("n_candidates"),
                       F.coalesce(F.try_element_at("candidate_entities", F.lit(1)), F.lit("")).alias("first_candidate"))


_FORUM = "(" + " OR ".join(f"contains(t, '{k}')" for k in vocab.FORUM_KEYWORDS) + ")"


@query("b5_relevance", f"SELECT doc_id, {_FORUM} AS relevant FROM (SELECT doc_id, lower(lang || ' ' || text) AS t FROM documents)")
def b5(v):
    return v.texts("documents").select("doc_id", text.relevant("lang", "text", vocab.FORUM_KEYWORDS).alias("relevant"))


@query("b6_strip_tags", "SELECT page_id, md5(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS digest FROM pages")
def b6(v):
    return v.texts("pages").select("page_id", F.md5(text.strip_tags("html")).alias("digest"))


@query("b7_embedding_input", """SELECT id, len(text) AS chars, md5(text) AS digest FROM (
SELECT id, label || ': ' || name || '. Aliases: ' || array_to_string(aliases, ', ') || '. ' || description AS text FROM concepts)
UNION ALL SELECT 'doc:' || doc_id, len(left(text, 120) || '. ' || left(text, 1500)), md5(left(text, 120) || '. ' || left(text, 1500)) FROM documents""", "concepts")
def b7(v):
    c = v.concepts.select("id", text.embedding_input(F.col("label"), F.col("name"), F.col("aliases"), F.col("description")).alias("t"))
    d = v.docs.select("uid", text.document_embedding_input(F.col("title"), F.col("text")).alias("t"))
    return c.union(d).select("id", F.length("t").cast("long").alias("chars"), F.md5("t").alias("digest"))


_STRIP = rf"regexp_replace(text, '^[{_SP}]+|[{_SP}]+$', '', 'g')"


@query("b8_chunks", f"""SELECT doc_id, CAST(i // 1800 AS INTEGER) AS chunk_no, md5(CASE WHEN length(t) <= 2000 THEN t ELSE substr(t, i + 1, 2000) END) AS digest FROM (
SELECT doc_id, t, unnest(CASE WHEN length(t) <= 2000 THEN [0] ELSE range(0, length(t), 1800) END) AS i FROM (
SELECT doc_id, CASE WHEN {_STRIP} = '' THEN ' ' ELSE {_STRIP} END AS t FROM documents))""")
def b8(v):
    return v.texts("documents").select("doc_id", F.posexplode(text.chunks(F.col("text"))).alias("chunk_no", "c")).select(
        "doc_id", "chunk_no", F.md5("c").alias("digest"))


@query("b9_mean_pool", """SELECT label, CAST(pos AS INTEGER) AS pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS x FROM (
SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY 1, 2)""")
def b9(v):
    """The vectors of a label stand for the chunks of one document."""
    pooled = vectors.mean_pool(v.table("embeddings").select("label", "embedding"), "label", "embedding")
    return pooled.select("label", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("b10_json_object", """SELECT 'e' || event_id AS id, CASE WHEN event_id % 6 IN (0, 1, 4, 5) THEN CAST(json_extract_string(props, '$.k') AS VARCHAR) END AS supply,
CASE WHEN event_id % 6 IN (0, 1, 4, 5) THEN CASE event_type WHEN 'click' THEN 'Very Bearish.' WHEN 'view' THEN 'recovering' WHEN 'error' THEN 'BULLISH' ELSE 'flat' END END AS outlook
FROM events""")
def b10(v):
    d = v.model_answers.select(F.col("commodity").alias("id"), jsontext.fenced_object(F.col("response")).alias("doc"))
    return d.select("id", jsontext.field(F.col("doc"), "supply_growth_score").alias("supply"), jsontext.field(F.col("doc"), "outlook_6m").alias("outlook"))


@query("b11_watch_keywords", """SELECT id, node_name || '|Output|Supplier|' || CASE WHEN w1 = w2 THEN w1 ELSE w1 || '|' || w2 END AS keywords FROM (
SELECT id, node_name, split_part(split_part(statement, ' limits ', 2), ' and ', 1) AS w1, split_part(split_part(statement, ' and ', 2), ' supply in', 1) AS w2 FROM hyps)""", "hyps")
def b11(v):
    return v.hyps.select("id", F.array_join(text.watch_keywords(F.col("node_name"), F.col("statement")), "|").alias("keywords"))


@query("b12_whole_word", r"""SELECT doc_id, regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])' || lang || '($|[^\p{L}\p{N}_])') AS has_word FROM documents""")
def b12(v):
    """Whether a document holds its own language code as a word."""
    return v.texts("documents").select("doc_id", text.whole_word(F.col("lang"), F.col("text")).alias("has_word"))


def _hits(terms):
    return "list_sum(list_transform([" + ", ".join(f"'{t}'" for t in terms) + "], lambda x: CAST(contains(t, x) AS INTEGER)))"


@query("b13_evidence_tone", f"""SELECT doc_id, round(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (r - c)::DOUBLE / greatest(1, r + c))), 6) AS tone FROM (
SELECT doc_id, {_hits(vocab.RISK_TERMS)} AS r, {_hits(vocab.MITIGATING_TERMS)} AS c FROM (SELECT doc_id, lower(title || ' ' || text) AS t FROM docs))""", "docs")
def b13(v):
    return v.docs.select("doc_id", F.round(text.evidence_tone("title", "text"), 6).alias("tone"))


@query("b14_evidence_line", "SELECT uid, '[' || left(uid, 12) || '] ' || left(title, 120) AS line FROM docs", "docs")
def b14(v):
    return v.docs.select("uid", text.evidence_line("uid", "title").alias("line"))


@query("b15_source_class", """SELECT hypothesis_id, doc_uid, CASE split_part(doc_uid, ':', 1) WHEN 'github' THEN 'GitHub' WHEN 'arxiv' THEN 'arXiv' WHEN 'hn' THEN 'Hacker News'
WHEN 'rss_nyt' THEN 'NYT' WHEN 'jobs_x' THEN 'Job Posting' ELSE 'Unknown' END AS source FROM evidence""", "evidence")
def b15(v):
    return v.evidence.select("hypothesis_id", "doc_uid", text.source_class("line").alias("source"))


@query("b16_days_since", f"""SELECT event_id, CAST(floor(epoch({A} - CAST(ts AS TIMESTAMP)) / 86400) AS BIGINT) AS days FROM events
UNION ALL SELECT -1 - s_suppkey, CASE WHEN updated_at IS NULL THEN 999 ELSE date_diff('day', updated_at, {A}) END FROM hyps""", "hyps")
def b16(v):
    e = v.table("events").select("event_id", text.days_since(F.col("ts").cast("timestamp"), as_of()).alias("days"))
    return e.union(v.hyps.select(-1 - F.col("s_suppkey"), text.days_since("updated_at", as_of())))


@query("b17_node_type", """SELECT DISTINCT node_id, split_part(node_id, '-', 1) AS type FROM nodes UNION SELECT name, left(name, 3) FROM nodes WHERE label = 'Process'
UNION SELECT name, CASE WHEN contains(name, '-') THEN split_part(name, '-', 1) ELSE left(name, 3) END FROM nodes WHERE label = 'Technology'""", "nodes")
def b17(v):
    ids = v.nodes.select("node_id").union(v.nodes.where(F.col("label").isin("Process", "Technology")).select("name"))
    return ids.distinct().select("node_id", text.node_type("node_id").alias("type"))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_LABEL = "CASE label " + " ".join(f"WHEN '{k}' THEN {_sql_text(t)}" for k, t in text.LABEL_TEXT.items()) + " END"


@query("b18_explain_node", f"""SELECT node_id, array_to_string(list_filter([
CASE WHEN is_articulation_point THEN '**' || name || {_sql_text(text.AP_TEXT)} END,
CASE WHEN betweenness > 0.5 THEN printf({_sql_text(text.HIGH_BETWEENNESS)}, {r('betweenness', 3)}) WHEN betweenness > 0.15 THEN printf({_sql_text(text.SOME_BETWEENNESS)}, {r('betweenness', 3)}) END,
CASE WHEN concentration > 0.8 THEN printf({_sql_text(text.HIGH_CONCENTRATION)}, {r('concentration', 2)}) WHEN concentration > 0.5 THEN printf({_sql_text(text.SOME_CONCENTRATION)}, {r('concentration', 2)}) END,
{_LABEL}], lambda x: x IS NOT NULL), chr(10) || chr(10)) AS explanation FROM scores""", "scores")
def b18(v):
    s = v.node_scores()
    return s.select("node_id", text.explain_node(*[F.col(c) for c in (
        "name", "label", "srs_score", "betweenness", "concentration", "is_articulation_point")]).alias("explanation"))
