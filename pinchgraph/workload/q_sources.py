"""Registered queries of section A.

Landed payloads are derived from the driver's tables: every document, page or conversation turn
becomes one response body in the form of the source, which the normaliser then reads.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pinchgraph.functions import vocab
from pinchgraph.functions.jsontext import topics
from pinchgraph.model import NEWS_REQUIRED
from pinchgraph.operators import resolution, vectors
from pinchgraph.sources import code_repo, documents, feeds, filings, forums, job_boards, news, papers, patents, stories, taxonomy
from pinchgraph.workload.registry import query
from pinchgraph.workload.sqlviews import A
from pinchgraph.workload.views import HIGH, LOW, as_of

_DAY = "%Y-%m-%d"


def _epoch(df):
    """Documents as shown in checks: time in seconds, long text as a digest."""
    return df.select("uid", "title", F.md5("text").alias("text_md5"), "url", "source", "ias_tier",
                     F.floor(F.unix_micros("published_at") / 1_000_000).alias("published"), "metadata")


def _any(terms, column: str) -> str:
    return "(" + " OR ".join(f"contains({column}, '{t.lower()}')" for t in terms) + ")"


def _sec(ts: str) -> str:
    return f"CAST(floor(epoch({ts})) AS BIGINT)"


@query("a1_document_normalise", f"""SELECT CASE WHEN doc_id % 5 = 0 THEN left(sha256(url), 16) ELSE uid END AS uid,
{_sec(f"CASE WHEN doc_id % 7 = 0 THEN {A} ELSE published_at END")} AS published FROM docs""", "docs")
def a1(v):
    k = F.col("doc_id")
    raw = v.docs.withColumn("uid", F.when(k % 5 != 0, F.col("uid")).otherwise("")).withColumn(
        "published_at", F.when(k % 7 != 0, F.col("published_at")))
    return documents.normalise(raw, as_of()).select("uid", F.floor(F.unix_micros("published_at") / 1_000_000).alias("published"))


def _by_text(v):
    """Documents named by their text, so that copies share a uid."""
    return v.docs.withColumn("uid", F.sha2("text", 256))


@query("a2_dedup_insert", """SELECT uid, doc_id, length(left(title, 512)) AS title_chars, md5(left(text, 8000)) AS text_md5 FROM (
SELECT *, sha256(text) AS uid, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM (SELECT * EXCLUDE (uid) FROM docs))
WHERE r = 1 AND uid NOT IN (SELECT sha256(text) FROM docs WHERE status = 'processed')""", "docs")
def a2(v):
    docs = _by_text(v)
    new = documents.dedup_insert(docs.where("status = 'processed'"), docs, "doc_id")
    return new.select("uid", "doc_id", F.length("title").cast("long").alias("title_chars"), F.md5("text").alias("text_md5"))


@query("a3_is_known", "SELECT 'doc:' || event_id AS uid FROM events WHERE event_id IN (SELECT doc_id FROM documents)")
def a3(v):
    keys = v.table("events").select(F.concat(F.lit("doc:"), F.col("event_id").cast("string")).alias("uid"))
    return documents.known_only(keys, v.docs)


@query("a4_pending", "SELECT uid, title FROM docs WHERE status = 'pending' ORDER BY ingested_at, uid LIMIT 100", "docs")
def a4(v):
    return documents.pending(v.docs, 100).select("uid", "title")


@query("a5_mark_processed", "SELECT uid, CASE WHEN lang = 'en' THEN 'processed' ELSE status END AS status FROM docs", "docs")
def a5(v):
    return documents.mark_processed(v.docs, v.docs.where("lang = 'en'")).select("uid", "status")


@query("a6_counts", """SELECT 'total' AS metric, '' AS key, count(*) AS n FROM docs UNION ALL SELECT 'pending', '', count(*) FROM docs WHERE status = 'pending'
UNION ALL SELECT 'source', source, count(*) FROM docs GROUP BY source""", "docs")
def a6(v):
    return documents.counts(v.docs)


@query("a7_code_repo_issues", f"""SELECT 'github:' || repo || ':' || doc_id || ':' || kind AS uid, '[' || repo || '] ' || t AS title, md5(left(text, 3000)) AS text_md5,
'https://git.example.org/' || doc_id AS url, 'github' AS source, CAST(1 AS INTEGER) AS ias_tier, {_sec('published_at')} AS published,
'{{"repo":"' || repo || '","number":' || doc_id || ',"kind":"' || kind || '","state":"open","labels":["' || lang || '","' || source || '"],"comments":' || (doc_id % 10) || '}}' AS metadata
FROM (SELECT * EXCLUDE (source), source, 'org/' || source AS repo, CASE WHEN doc_id % 2 = 0 THEN 'issue' ELSE 'pull' END AS kind,
  CASE WHEN doc_id % 3 = 0 THEN 'GPU limits' ELSE 'Notes' END || ' ' || doc_id AS t FROM docs)
WHERE {_any(vocab.CODE_REPO_KEYWORDS, "lower(t || ' ' || text)")}""", "docs")
def a7(v):
    k = F.col("doc_id")
    item = F.struct(
        k.alias("number"), F.concat(F.when(k % 3 == 0, "GPU limits").otherwise("Notes"), F.lit(" "), k.cast("string")).alias("title"),
        F.col("text").alias("body"), F.concat(F.lit("https://git.example.org/"), k.cast("string")).alias("html_url"), F.lit("open").alias("state"),
        F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated_at"),
        F.array(F.struct(F.col("lang").alias("name")), F.struct(F.col("source").alias("name"))).alias("labels"), (k % 10).alias("comments"))
    payloads = v.docs.select(F.concat(F.lit("org/"), "source").alias("repo"), F.when(k % 2 == 0, "issue").otherwise("pull").alias("kind"),
                             F.to_json(F.array(item)).alias("payload"))
    return _epoch(code_repo.issues(payloads))


@query("a8_stories", f"""SELECT 'hn:' || conv_id || '-' || turn AS uid, left(text, 40) AS title, md5(left(text, 3000)) AS text_md5, CASE WHEN turn % 2 = 0 THEN 'https://news.ycombinator.com/item?id=' || conv_id || '-' || turn ELSE 'https://s.example.org/' || conv_id END AS url,
'hn' AS source, CAST(1 AS INTEGER) AS ias_tier, 1704067200 + conv_id * 60 AS published,
'{{"points":' || (conv_id % 40) || ',"num_comments":' || turn || ',"author":"' || role || '","query":"q1"}}' AS metadata
FROM conversations WHERE conv_id % 40 > 10 AND 1704067200 + conv_id * 60 > 1704067200 + 600""")
def a8(v):
    """Each turn is a hit of two queries; the first query keeps it."""
    c, t = F.col("conv_id"), F.col("turn")
    story = F.concat_ws("-", c.cast("string"), t.cast("string"))
    hit = F.struct(story.alias("objectID"), F.left("text", F.lit(40)).alias("title"),
                   F.when(t % 2 == 1, F.concat(F.lit("https://s.example.org/"), c.cast("string"))).alias("url"), F.col("text").alias("story_text"),
                   F.date_format(F.timestamp_seconds(F.lit(1704067200) + c * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
                   (F.lit(1704067200) + c * 60).alias("created_at_i"), (c % 40).alias("points"), t.alias("num_comments"), F.col("role").alias("author"))
    body = F.to_json(F.struct(F.array(hit).alias("hits")))
    bodies = v.table("conversations").select(body.alias("payload"))
    payloads = bodies.select("payload", F.explode(F.array(F.lit(1), F.lit(2))).alias("query_no")).withColumn(
        "query", F.concat(F.lit("q"), F.col("query_no").cast("string")))
    return _epoch(stories.stories(payloads, F.lit(1704067200 + 600), as_of()))


# submission lists of a customer: its orders newest first, the priority choosing the form
_FORM = "CASE left(o_orderpriority, 1) WHEN '1' THEN '8-K' WHEN '2' THEN '10-K' WHEN '3' THEN '10-Q' ELSE 'S-1' END"
_FILED = f"""SELECT 'Customer ' || o_custkey AS company, lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, {_FORM} AS form, strftime(o_orderdate, '{_DAY}') AS date,
'0001-' || o_orderkey AS accession, 'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/0001' || o_orderkey || '/d' || o_orderkey || '.htm' AS url
FROM orders WHERE {_FORM} <> 'S-1' AND o_orderdate >= TIMESTAMP '1998-01-01'"""


def _filings(v):
    o = v.table("orders").withColumn("_p", F.left("o_orderpriority", F.lit(1)))
    form = F.when(F.col("_p") == "1", "8-K").when(F.col("_p") == "2", "10-K").when(F.col("_p") == "3", "10-Q").otherwise("S-1")
    key = F.col("o_orderkey").cast("string")
    # one filer's submissions come in pages of at most 64 neighbouring order numbers
    listed = o.groupBy("o_custkey", F.floor(F.col("o_orderkey") / 64).alias("page")).agg(F.sort_array(F.collect_list(F.struct(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.concat(F.lit("0001-"), key).alias("acc"), form.alias("form"),
        F.concat(F.lit("d"), key, F.lit(".htm")).alias("doc"))), asc=False).alias("s"))
    recent = F.struct(F.col("s.form").alias("form"), F.col("s.date").alias("filingDate"), F.col("s.acc").alias("accessionNumber"), F.col("s.doc").alias("primaryDocument"))
    payloads = listed.select(
        F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("company"), F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"),
        F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings"))).alias("payload"))
    return filings.recent_filings(payloads, F.lit("1998-01-01"))


@query("a9_recent_filings", _FILED)
def a9(v):
    return _filings(v)


_SP = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SNIP_TERMS = ["the", "export control", "and", "EAR", "reth"]
_WIN = "[" + ", ".join(f"CASE WHEN instr(lower(t), '{w}') > 0 THEN substr(t, CAST(greatest(instr(lower(t), '{w}') - 200, 1) AS INTEGER), CAST(instr(lower(t), '{w}') + 500 - greatest(instr(lower(t), '{w}') - 200, 1) AS INTEGER)) ELSE '' END" for w in _SNIP_TERMS) + "]"


@query("a10_risk_snippet", rf"""SELECT page_id, md5(CASE WHEN best = '' THEN left(t, 1000) ELSE best END) AS digest FROM (
SELECT page_id, t, list_reduce({_WIN}, lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END) AS best FROM (
SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[{_SP}]+', ' ', 'g')) AS t FROM pages))""")
def a10(v):
    return v.texts("pages").select("page_id", F.md5(filings.risk_snippet(F.col("html"), _SNIP_TERMS)).alias("digest"))


@query("a11_filing_documents", f"""SELECT 'edgar:' || cik || ':' || accession AS uid, '[' || form || '] ' || company || ' — ' || date AS title, company || ' ' || form || ' ' || date AS text, url, 'edgar' AS source,
{_sec("CAST(date || ' 00:00:00' AS TIMESTAMP)")} AS published, '{{"company":"' || company || '","cik":"' || cik || '","form_type":"' || form || '","accession":"' || accession || '"}}' AS metadata FROM ({_FILED})""")
def a11(v):
    d = filings.filing_documents(_filings(v).withColumn("body", F.lit(None).cast("string")))
    return d.select("uid", "title", "text", "url", "source", F.unix_seconds("published_at").alias("published"), "metadata")


def _plain(c):
    """Letters, digits and single spaces only, so that the text can stand in XML as it is."""
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))


_PLAIN = r"trim(regexp_replace({0}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


@query("a12_papers", f"""SELECT 'arxiv:2401.' || doc_id AS uid, 'On ' || t AS title, md5(left('About ' || x, 3000)) AS text_md5, 'https://arxiv.org/abs/2401.' || doc_id AS url, 'arxiv' AS source,
CAST(2 AS INTEGER) AS ias_tier, {_sec('published_at')} AS published,
'{{"arxiv_id":"2401.' || doc_id || '","authors":["A ' || lang || '","B ' || source || '"],"pdf_url":"https://arxiv.org/pdf/2401.' || doc_id || '","category":"cs.AR"}}' AS metadata
FROM (SELECT *, {_PLAIN.format('title')} AS t, {_PLAIN.format('text')} AS x FROM docs)""", "docs")
def a12(v):
    k = F.col("doc_id").cast("string")
    entry = F.concat(
        F.lit("<entry><id>http://arxiv.org/abs/2401."), k, F.lit("</id><title>On\n"), _plain("title"), F.lit("</title><summary> About\n"), _plain("text"),
        F.lit("</summary><published>"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</published><author><name>A "), "lang",
        F.lit("</name></author><author><name>B "), "source", F.lit("</name></author></entry>"))
    return _epoch(papers.papers(v.docs.select(entry.alias("entry"), F.lit("cs.AR").alias("category"))))


_FT = {name: tier for name, tier in vocab.FORUM_TIERS.items()}
_FNAMES = list(_FT)
_FSQL = "CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_FNAMES)) + " END"
_FTIER = "CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(_FT.values())) + " END"


@query("a13_forum_posts", f"""SELECT 'reddit:p' || doc_id AS uid, title, md5(left(text, 3000)) AS text_md5, 'https://www.reddit.com/r/' || doc_id AS url, 'reddit_r_' || lower({_FSQL}) AS source,
CAST({_FTIER} AS INTEGER) AS ias_tier, {_sec('published_at')} AS published,
'{{"subreddit":"' || {_FSQL} || '","score":' || (doc_id % 30) || ',"num_comments":3,"author":"' || lang || '"}}' AS metadata
FROM docs WHERE doc_id % 30 >= 5 AND published_at >= {A} - INTERVAL 20 DAY AND {_any(vocab.FORUM_KEYWORDS, "lower(title || ' ' || left(text, 3000))")}""", "docs")
def a13(v):
    k = F.col("doc_id")
    forum = F.element_at(F.array(*[F.lit(n) for n in _FNAMES]), (k % 7 + 1).cast("int"))
    post = F.struct(F.concat(F.lit("p"), k.cast("string")).alias("id"), F.col("title"), F.col("text").alias("selftext"), F.concat(F.lit("/r/"), k.cast("string")).alias("permalink"),
                    (k % 30).alias("score"), F.lit(3).alias("num_comments"), (F.unix_micros("published_at") / 1_000_000).alias("created_utc"), F.col("lang").alias("author"))
    body = F.to_json(F.struct(F.struct(F.array(F.struct(post.alias("data"))).alias("children")).alias("data")))
    payloads = v.docs.select(forum.alias("forum"), body.alias("payload"))
    return _epoch(forums.posts(payloads, F.broadcast(forums.default_tiers(v.spark)), F.unix_timestamp(as_of() - F.expr("INTERVAL 20 DAYS")).cast("double")))


_FEEDS = list(vocab.FEED_TIERS)
_FEED = "CASE doc_id % 19 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_FEEDS)) + " END"
_TIER19 = "CASE doc_id % 19 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(vocab.FEED_TIERS.values())) + " END"


def _items(v, extra):
    """Feed items in three forms in turn: plain elements, RSS 2.0 with a named zone, and Atom."""
    k = F.col("doc_id").cast("string")
    even, form = F.col("doc_id") % 2 == 0, F.floor(F.col("doc_id") / 2) % 3
    html = F.concat(F.lit("&lt;p&gt;"), _plain("text"), F.lit("&lt;/p&gt;"))
    date = F.when(F.col("doc_id") % 3 == 0, F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).when(
        F.col("doc_id") % 3 == 1, F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("soon")
    rss_date = F.when(F.col("doc_id") % 3 == 0, F.date_format(F.col("published_at") - F.expr("INTERVAL 5 HOURS"), "EEE, d MMM yyyy HH:mm:ss 'EST'")).otherwise(date)
    rss = F.concat(
        F.lit("<item><title>"), _plain("title"), F.lit("</title><link>https://f.example.org/"), k, F.lit("</link>"),
        F.when(even, F.concat(F.lit("<guid isPermaLink=\"false\">id"), k, F.lit("</guid>"))).otherwise(""),
        F.lit("<description>"), html, F.lit("</description><pubDate>"), rss_date, F.lit("</pubDate><category>c1</category><category domain=\"d\">"), "lang", F.lit("</category></item>"))
    atom = F.concat(
        F.lit("<item><title type=\"html\">"), _plain("title"), F.lit("</title><link rel=\"self\" href=\"https://x.example.org/\"/><link href=\"https://f.example.org/"), k, F.lit("\"/>"),
        F.when(even, F.concat(F.lit("<id>id"), k, F.lit("</id>"))).otherwise(""),
        F.lit("<summary type=\"html\">"), html, F.lit("</summary><published>"), date,
        F.lit("</published><category term=\"c1\"/><category term=\""), "lang", F.lit("\"/></item>"))
    plain = F.concat(
        F.lit("<item><title>"), _plain("title"), F.lit("</title><link>https://f.example.org/"), k, F.lit("</link>"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<id>id"), k, F.lit("</id>"))).otherwise(""),
        F.lit("<summary>&lt;p&gt;"), _plain("text"), F.lit("&lt;/p&gt;</summary><published>"), date,
        F.lit("</published><category>c1</category><category>"), "lang", F.lit("</category></item>"))
    return v.docs.select(F.when(form == 0, plain).when(form == 1, rss).otherwise(atom).alias("item"), *extra)


_WHEN = f"CASE WHEN doc_id % 3 = 2 THEN {_sec(A)} ELSE {_sec('published_at')} END"


@query("a14_feed_entries", f"""SELECT 'rss_' || feed || ':' || left(sha256(CASE WHEN doc_id % 2 = 0 THEN 'id' || doc_id ELSE 'https://f.example.org/' || doc_id END), 16) AS uid, t AS title,
md5(CASE WHEN x = '' THEN t ELSE left(x, 3000) END) AS text_md5, 'https://f.example.org/' || doc_id AS url, 'rss_' || feed AS source, CAST({_TIER19} AS INTEGER) AS ias_tier, {_WHEN} AS published,
'{{"feed":"' || feed || '","feed_url":"https://f.example.org/' || feed || '","tags":["c1","' || lang || '"]}}' AS metadata
FROM (SELECT *, {_PLAIN.format('title')} AS t, {_PLAIN.format('text')} AS x, {_FEED} AS feed, lower(t || ' ' || x) AS low FROM docs) WHERE {_any(vocab.FEED_KEYWORDS, "low")}""", "docs")
def a14(v):
    feed = F.element_at(F.array(*[F.lit(n) for n in _FEEDS]), (F.col("doc_id") % 19 + 1).cast("int"))
    items = _items(v, [feed.alias("feed"), F.concat(F.lit("https://f.example.org/"), feed).alias("feed_url")])
    return _epoch(feeds.feed_entries(items, F.broadcast(feeds.default_tiers(v.spark)), as_of()))


@query("a15_feed_dates", f"SELECT doc_id, {_WHEN} AS published FROM docs", "docs")
def a15(v):
    date = F.when(F.col("doc_id") % 3 == 0, F.when(F.col("doc_id") % 2 == 0, F.date_format(
        F.col("published_at") - F.expr("INTERVAL 7 HOURS"), "EEE, d MMM yy HH:mm:ss 'PDT'")).otherwise(F.date_format("published_at", "EEE, d MMM yyyy HH:mm:ss '+0000'"))).when(
        F.col("doc_id") % 3 == 1, F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("soon")
    return v.docs.select("doc_id", F.unix_seconds(feeds.entry_date(date, F.lit(None).cast("string"), as_of())).alias("published"))


@query("a16_patents", f"""SELECT 'uspto:' || pid AS uid, '[Patent] ' || t AS title, md5(CASE WHEN text = '' THEN t ELSE left(text, 3000) END) AS text_md5, 'https://patents.google.com/patent/US' || pid AS url, 'uspto' AS source, CAST(1 AS INTEGER) AS ias_tier,
CASE WHEN doc_id % 5 = 0 THEN {_sec(A)} ELSE {_sec("date_trunc('day', published_at)")} END AS published, '{{"patent_id":"' || pid || '","assignee":"' || source || '"}}' AS metadata
FROM (SELECT * EXCLUDE (source), docs.source, t, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE left(sha256(t), 12) END AS pid
 FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'An EUV stage ' ELSE 'A stage ' END || doc_id AS t FROM docs) docs)
WHERE {_any(vocab.PATENT_KEYWORDS, "lower(t || ' ' || text)")}""", "docs")
def a16(v):
    k = F.col("doc_id")
    title = F.concat(F.when(k % 3 == 0, "An EUV stage ").otherwise("A stage "), k.cast("string"))
    p = F.struct(F.when(k % 2 == 0, k.cast("string")).alias("patent_id"), title.alias("patent_title"), F.col("text").alias("patent_abstract"),
                 F.when(k % 5 != 0, F.date_format("published_at", "yyyy-MM-dd")).alias("patent_date"))
    payloads = v.docs.select(F.col("source").alias("assignee"), F.to_json(F.struct(F.array(p).alias("patents"))).alias("payload"))
    return _epoch(patents.patents(payloads, as_of()))


_JT = list(vocab.JOB_FEED_TIERS.items())
_JTAG = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{n}'" for i, (n, _) in enumerate(_JT)) + " END"
_JTIER = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN {t}" for i, (_, t) in enumerate(_JT)) + " END"


@query("a17_job_feed", f"""SELECT 'jobs_remoteok:' || left(sha256('https://f.example.org/' || doc_id), 16) AS uid, '[Job] ' || t AS title, md5(CASE WHEN x = '' THEN t ELSE left(x, 2000) END) AS text_md5,
'https://f.example.org/' || doc_id AS url, 'jobs_remoteok' AS source, CAST({_JTIER} AS INTEGER) AS ias_tier, {_WHEN} AS published, '{{"tag":"' || {_JTAG} || '","board":"remoteok"}}' AS metadata
FROM (SELECT *, {_PLAIN.format('title')} AS t, {_PLAIN.format('text')} AS x, lower(t || ' ' || x) AS low FROM docs) WHERE {_any(vocab.JOB_KEYWORDS, "low")}""", "docs")
def a17(v):
    tag = F.element_at(F.array(*[F.lit(n) for n, _ in _JT]), (F.col("doc_id") % 6 + 1).cast("int"))
    tiers = v.spark.createDataFrame(_JT, "tag string, tier int")
    return _epoch(feeds.job_feed(_items(v, [tag.alias("tag")]), F.broadcast(tiers), as_of()))


_BODY = "'Lyon — ' || left(regexp_replace(html, '<[^>]+>', ' ', 'g'), 1500)"


@query("a18_job_board_1", f"""SELECT 'jobs_greenhouse:' || page_id AS uid, '[Job] Role ' || page_id || ' — Co' || (page_id % 9) AS title, md5({_BODY}) AS text_md5, url, 'jobs_greenhouse' AS source, CAST(2 AS INTEGER) AS ias_tier,
1704067200 + page_id * 3600 AS published, '{{"company":"Co' || (page_id % 9) || '","location":"Lyon","board":"greenhouse"}}' AS metadata
FROM pages WHERE {_any(vocab.JOB_KEYWORDS, f"lower('Role ' || page_id || ' ' || {_BODY})")}""")
def a18(v):
    k = F.col("page_id")
    job = F.struct(k.cast("string").alias("id"), F.concat(F.lit("Role "), k.cast("string")).alias("title"), F.struct(F.lit("Lyon").alias("name")).alias("location"),
                   F.col("html").alias("content"), F.date_format(F.timestamp_seconds(F.lit(1704067200) + k * 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated_at"), F.col("url").alias("absolute_url"))
    payloads = v.texts("pages").select(F.concat(F.lit("Co"), (k % 9).cast("string")).alias("company"), F.lit(2).alias("tier"), F.to_json(F.struct(F.array(job).alias("jobs"))).alias("payload"))
    return _epoch(job_boards.board_form_1(payloads, as_of()))


@query("a19_job_board_2", f"""SELECT 'jobs_lever:j' || page_id AS uid, '[Job] Role ' || page_id || ' — Co' || (page_id % 9) AS title, md5({_BODY}) AS text_md5, url, 'jobs_lever' AS source, CAST(2 AS INTEGER) AS ias_tier,
CASE WHEN page_id % 4 = 0 THEN {_sec(A)} ELSE 1704067200 + page_id * 3600 END AS published, '{{"company":"Co' || (page_id % 9) || '","location":"Lyon","department":"Ops","board":"lever"}}' AS metadata
FROM pages WHERE {_any(vocab.JOB_KEYWORDS, "lower('Role ' || page_id || ' ' || regexp_replace(html, '<[^>]+>', ' ', 'g'))")}""")
def a19(v):
    k = F.col("page_id")
    job = F.struct(F.concat(F.lit("j"), k.cast("string")).alias("id"), F.concat(F.lit("Role "), k.cast("string")).alias("text"),
                   F.struct(F.lit("Lyon").alias("location"), F.lit("Ops").alias("department")).alias("categories"), F.col("html").alias("descriptionPlain"),
                   F.when(k % 4 == 0, F.lit(0)).otherwise((F.lit(1704067200) + k * 3600) * 1000).alias("createdAt"), F.col("url").alias("hostedUrl"))
    payloads = v.texts("pages").select(F.concat(F.lit("Co"), (k % 9).cast("string")).alias("company"), F.lit(2).alias("tier"), F.to_json(F.array(job)).alias("payload"))
    return _epoch(job_boards.board_form_2(payloads, as_of()))


_NEW = "SELECT * FROM news WHERE uid NOT IN (SELECT uid FROM news_ledger)"
_TOPICS = "CASE doc_id % 5 WHEN 2 THEN 'Tech|Energy' WHEN 3 THEN 'Tech|Energy' ELSE '' END"


@query("a20_source_report", " UNION ALL ".join(f"SELECT '{c}' AS column, true AS present, count({c}) AS filled FROM news" for c in sorted(NEWS_REQUIRED)), "news")
def a20(v):
    return news.source_report(v.news)


@query("a21_new_articles", f"SELECT uid, title, url, source, title AS text, sentiment_score, sentiment_label, {_TOPICS} AS topics, CAST(4 AS INTEGER) AS ias_tier FROM ({_NEW})", "news news_ledger")
def a21(v):
    """The source check (A20) runs first and fails on missing columns."""
    n = news.new_articles(v.news, v.news_ledger)
    return n.withColumn("topics", F.array_join("topics", "|")).drop("first_seen")


@query("a22_topics", f"SELECT uid, {_TOPICS} AS topics FROM news", "news")
def a22(v):
    return v.news.select("uid", F.array_join(topics(F.col("topics")), "|").alias("topics"))


@query("a23_ledger_additions", "SELECT DISTINCT uid FROM news WHERE uid NOT IN (SELECT uid FROM news_ledger)", "news news_ledger")
def a23(v):
    return news.ledger_additions(v.news_ledger, v.news.select("uid").union(v.news.select("uid")))


@query("a24_article_counts", "SELECT count(*) AS total, count(*) - (SELECT count(*) FROM news_ledger) AS pending FROM news", "news news_ledger")
def a24(v):
    return news.article_counts(v.news, v.news_ledger)


@query("a25_route_news", """SELECT r.doc_uid, r.route, r.best_node FROM routed r JOIN news n ON n.uid = r.doc_uid WHERE r.doc_uid NOT IN (SELECT uid FROM news_ledger)""", "routed news news_ledger")
def a25(v):
    """New articles that have a vector, routed as documents are."""
    new = news.as_documents(news.new_articles(v.news, v.news_ledger)).select(F.col("uid").alias("doc_uid"))
    vecs = v.doc_vectors.join(new, "doc_uid", "left_semi")
    return resolution.route(vectors.top_k_nodes(vecs, v.node_vectors, 10), HIGH, LOW).select("doc_uid", "route", "best_node")


def _taxonomy_payloads(v):
    """One taxonomy file per nation: the nation, its suppliers, and an edge from each (one end in five unknown)."""
    s = v.table("supplier").join(v.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey").cast("string")
    concept = F.struct(F.concat(F.lit("COMP-"), k).alias("id"), F.lit("Company").alias("label"), F.col("s_name").alias("name"), F.array(F.concat(F.lit("S"), k)).alias("aliases"),
                       F.lit("made").alias("description"), F.lit(0.5).alias("criticality"),
                       F.struct(F.col("n_name").alias("country"), F.col("s_suppkey").alias("rank"), F.array(F.lit("x")).alias("list")).alias("properties"))
    edge = F.struct(F.concat(F.lit("COMP-"), k).alias("source"), F.when(F.col("s_suppkey") % 5 == 0, F.lit("GEO-NONE")).otherwise(
        F.concat(F.lit("COMP-"), F.col("s_nationkey").cast("string"))).alias("target"), F.lit("DEPENDS_ON").alias("relation"), F.struct(F.lit(1.0).alias("confidence")).alias("properties"))
    one = F.to_json(F.struct(F.array(concept).alias("concepts"), F.array(edge).alias("edges")))
    return s.select(one.alias("payload"))


_TE = """(SELECT 'COMP-' || s_suppkey AS source, CASE WHEN s_suppkey % 5 = 0 THEN 'GEO-NONE' ELSE 'COMP-' || s_nationkey END AS target, 'DEPENDS_ON' AS relation, s_suppkey FROM supplier)"""
_KNOWN = "(SELECT 'COMP-' || s_suppkey FROM supplier)"


@query("a26_read_taxonomy", """SELECT 'COMP-' || s_suppkey AS id, 'Company' AS label, s_name AS name, 'S' || s_suppkey AS aliases, 0.5::DOUBLE AS criticality FROM supplier""")
def a26(v):
    return taxonomy.concepts(_taxonomy_payloads(v)).select("id", "label", "name", F.array_join("aliases", "|").alias("aliases"), "criticality")


@query("a27_upsert_nodes", """SELECT 'Company' AS label, 'COMP-' || s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'old' END AS name, 'country=' || n_name || ';kept=COMP-' || s_suppkey || ';rank=' || s_suppkey AS properties
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def a27(v):
    """Stored names are old; the upsert brings names for even suppliers and properties for all; list properties are dropped.

    Stored properties overlap with new ones, and each new row comes once more in an older state.
    """
    c = taxonomy.concepts(_taxonomy_payloads(v))
    even = F.substring("id", 6, 20).cast("long") % 2 == 0
    stored = c.select("label", "id", F.lit("old").alias("name"), F.create_map(F.lit("country"), F.lit("old"), F.lit("kept"), F.col("id")).alias("properties"))
    new = c.select("label", "id", F.when(even, F.col("name")).alias("name"), taxonomy.primitive_properties(F.col("properties")).alias("properties"), F.lit(2).alias("no"))
    older = c.select("label", "id", F.when(even, F.lit("zz")).alias("name"), F.create_map(F.lit("rank"), F.lit("zz")).alias("properties"), F.lit(1).alias("no"))
    merged = taxonomy.upsert_nodes(stored, new.unionByName(older), "no")
    flat = F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return merged.select("label", "id", "name", flat.alias("properties"))


@query("a28_upsert_edges", f"SELECT source, target, relation, CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE 'old' END AS note FROM {_TE} WHERE target IN {_KNOWN} AND source IN {_KNOWN}")
def a28(v):
    p = _taxonomy_payloads(v)
    c, e = taxonomy.concepts(p), taxonomy.edges(p).select("source", "target", "relation")
    stored = taxonomy.valid_edges(e, c).withColumn("note", F.lit("old"))
    incoming = e.where(F.substring("source", 6, 20).cast("long") % 3 == 0).withColumn("note", F.lit("new"))
    return taxonomy.upsert_edges(stored, incoming.unionByName(incoming.withColumn("note", F.lit("mid"))), c)


@query("a28_skipped_edges", f"SELECT source, target FROM {_TE} WHERE target NOT IN {_KNOWN}")
def a28_skipped(v):
    p = _taxonomy_payloads(v)
    return taxonomy.broken_edges(taxonomy.edges(p), taxonomy.concepts(p)).select("source", "target")


_ONE = "SELECT source, target, relation FROM " + _TE + " WHERE target IN " + _KNOWN


@query("a29_extend", f"{_ONE} AND s_suppkey % 2 = 0 AND TRY_CAST(substr(target, 6) AS BIGINT) % 2 = 0 UNION {_ONE}")
def a29(v):
    """Half of the taxonomy is stored; all of it is offered as an extension."""
    p = _taxonomy_payloads(v)
    c, e = taxonomy.concepts(p).select("id", "label", "name"), taxonomy.edges(p).select("source", "target", "relation")
    even = lambda col: F.substring(col, 6, 20).try_cast("long") % 2 == 0
    stored_c = c.where(even("id"))
    stored_e = e.where(even("source") & even("target") & F.startswith("target", F.lit("COMP-")))
    return taxonomy.extend(stored_c, taxonomy.valid_edges(stored_e, stored_c).select("source", "target", "relation"), c, e)[1]


@query("a30_integrity", f"SELECT 'label' AS metric, 'Company' AS key, count(*) AS n FROM supplier UNION ALL SELECT 'broken', '', count(*) FROM {_TE} WHERE target NOT IN {_KNOWN}")
def a30(v):
    p = _taxonomy_payloads(v)
    return taxonomy.integrity(taxonomy.concepts(p), taxonomy.edges(p))


@query("a31_validation", """SELECT 'nodes' AS metric, '' AS key, count(*) AS n FROM nodes UNION ALL SELECT 'edges', '', count(*) FROM edges
UNION ALL SELECT 'isolated', '', count(*) FROM nodes WHERE node_id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)
UNION ALL SELECT 'label', label, count(*) FROM nodes GROUP BY label UNION ALL SELECT 'relation', relation, count(*) FROM edges GROUP BY relation
UNION ALL SELECT 'enough_nodes', '', CAST(count(*) >= 300 AS BIGINT) FROM nodes UNION ALL SELECT 'enough_edges', '', CAST(count(*) >= 200 AS BIGINT) FROM edges""", "nodes edges")
def a31(v):
    return taxonomy.validation(v.nodes.withColumnRenamed("node_id", "id"), v.edges.withColumnsRenamed({"src": "source", "dst": "target"}))


@query("a33_work_state", """SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending,
count(*) FILTER (status = 'processed' AND uid NOT IN (SELECT doc_uid FROM mentions UNION SELECT doc_uid FROM orphaned)) AS resolve_backlog FROM docs""", "docs mentions orphaned")
def a33(v):
    orphans = resolution.orphans(v.routed, resolution.valid_choices(v.routed, v.choices_raw), v.docs, as_of())
    return documents.work_state(v.docs, v.mentions, orphans)
