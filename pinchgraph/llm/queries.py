"""The registered queries of the operators, with production parameters, and the SQL of those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pinchgraph.llm import archives, bm25, chat, chunks, copies, decontaminate, divergence, linkgraph, packing, resample, shards, simhash, trie
from pinchgraph.llm.common import table
from pinchgraph.storage import materialize

def vocabulary() -> str:
    """The path of the packing vocabulary, found where tasks run on machines like the driver's."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


QUERIES: dict = {}
ORACLES: dict = {}

#: Fixed values of the URL rules.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkgraph.judge(table(spark, sf_dir, "pages"), URL_RULES)


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that change: what is cut, who keeps it, and the text that stays."""
    docs = table(spark, sf_dir, "documents")
    per = chunks.spans_per_document(materialize(chunks.repeated_spans(docs), "spans").df)
    return chunks.changed_documents(docs, per).select("doc_id", "spans", "first_doc_ids", "text")


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repaired(table(spark, sf_dir, "conversations")).drop("seq")


@query
def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 20, in full, against all documents."""
    docs = table(spark, sf_dir, "documents")
    return bm25.top_k(docs, docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text"), 10)


ORACLES["op6_topk"] = r"""
WITH words AS (
  SELECT doc_id, w, count(*) AS tf FROM (
    SELECT doc_id, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	

]+')) AS w FROM documents)
  WHERE w <> '' GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf) AS dl FROM words GROUP BY doc_id),
totals AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM lengths) / (SELECT count(*) FROM documents) AS mean),
idfs AS (SELECT w, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM words, totals GROUP BY w, n),
scores AS (
  SELECT q.doc_id AS query_id, d.doc_id, round(sum(idf * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
  FROM words q JOIN words d ON q.w = d.w JOIN idfs ON idfs.w = d.w JOIN lengths ON lengths.doc_id = d.doc_id, totals
  WHERE q.doc_id % 20 = 0 GROUP BY q.doc_id, d.doc_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores) WHERE rank <= 10
"""


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shard_rows(table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = packing.pieces(table(spark, sf_dir, "documents"), vocabulary())
    return packing.pack(parts).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archives.round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of `documents` with the row of its group that stays."""
    return copies.exact_groups(table(spark, sf_dir, "documents"))


ORACLES["op11_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM t
"""


@query
def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (lang, source) group of `documents` against the others of its language."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


ORACLES["op12_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS MATERIALIZED (SELECT k, lang, source, term, count(*) AS n FROM (
  SELECT k, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term FROM w GROUP BY ALL HAVING count(*) >= 30),
v AS (SELECT lang, (SELECT count(*) FROM kept WHERE kept.lang = g.lang) AS terms FROM (SELECT DISTINCT lang FROM d) g),
c AS (SELECT lang, source, term, sum(n)::HUGEINT AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (total + 5 * terms) AS p
  FROM g JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (coalesce(sum(n), 0) + 5)) // (any_value(t) + 5 * any_value(terms)) AS q
  FROM p JOIN v USING (lang) JOIN (SELECT lang, sum(total) AS t FROM g GROUP BY 1) USING (lang) GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 50
"""


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all `conversations`."""
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


ORACLES["op13_prefix_trie"] = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, item) - 1 AS place, item, words FROM (
    SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS item,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL)),
bits AS (SELECT conv_id, conv_id - conv_id % 20 AS lender, CAST(conv_id AS VARCHAR) AS s, count(*) AS own FROM t GROUP BY conv_id),
crc AS (
  SELECT conv_id, s, 0 AS i, CAST(4294967295 AS BIGINT) AS c FROM bits
  UNION ALL SELECT conv_id, s, i + 1, list_reduce(list_concat([xor(c, CAST(ascii(s[i + 1]) AS BIGINT))], list_transform(range(8), lambda z: CAST(0 AS BIGINT))), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))
  FROM crc WHERE i < length(s)),
c AS (SELECT b.conv_id, b.lender, b.own, xor(k.c, 4294967295) % 4 AS h, coalesce(l.own, 0) AS has
  FROM bits b JOIN crc k ON k.conv_id = b.conv_id AND k.i = length(k.s) LEFT JOIN bits l ON l.conv_id = b.lender),
r AS (SELECT c.conv_id, place + 1 AS depth, item, words FROM c JOIN t ON t.conv_id = c.lender WHERE place < least(h, has)
  UNION ALL SELECT c.conv_id, place - h + least(h, has) + 1, item, words FROM c JOIN t USING (conv_id) WHERE place >= h),
seq AS MATERIALIZED (SELECT c.conv_id, coalesce(list(item ORDER BY depth) FILTER (item IS NOT NULL), []) AS items, coalesce(list(words ORDER BY depth) FILTER (item IS NOT NULL), []) AS words
  FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
p AS MATERIALIZED (SELECT conv_id, d AS depth, len(items) AS length, items[1:d] AS path, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS words FROM seq, unnest(range(len(items) + 1)) AS u(d)),
n AS MATERIALIZED (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (length = depth), '')) AS ends_sha256 FROM p GROUP BY path, depth),
e AS MATERIALIZED (SELECT n.*, m.conv_id AS parent_conv_id FROM n LEFT JOIN n m ON n.depth > 0 AND m.depth = n.depth - 1 AND m.path = n.path[1:n.depth - 1]),
k AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n FROM e WHERE depth > 0 GROUP BY ALL),
w AS (SELECT e.*, coalesce(k.n, 0) AS n_children FROM e LEFT JOIN k USING (conv_id, depth)),
s AS (SELECT a.conv_id, a.depth, count(*) FILTER (w.n_children = 0) AS n_leaves, sum((w.n_convs - 1) * w.words) AS saved_tokens
  FROM w JOIN p q ON q.conv_id = w.conv_id AND q.depth <= w.depth JOIN n a ON a.depth = q.depth AND a.path = q.path GROUP BY ALL)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, CAST(n_children AS BIGINT) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM w JOIN s USING (conv_id, depth)
"""
