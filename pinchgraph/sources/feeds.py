"""Feed entries, feed dates and the job feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pinchgraph.functions import vocab
from pinchgraph.functions.text import relevant, strip_space, strip_tags

_LINK = "array<struct<_VALUE: string, _href: string, _rel: string>>"
_TEXT = "struct<_VALUE: string, _type: string>"
#: Elements of an RSS 2.0 item and of an Atom entry: both name most things in their own way.
ITEM = f"""struct<title: string, link: {_LINK}, id: string, guid: {_TEXT}, summary: {_TEXT}, description: string, content: {_TEXT}, `content:encoded`: string,
published: string, pubDate: string, `dc:date`: string, updated: string, category: array<struct<_VALUE: string, _term: string>>>"""
#: Zone names of RFC 822 and their offsets.
ZONES = {"GMT": "+0000", "UTC": "+0000", "UT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600",
         "PST": "-0800", "PDT": "-0700"}


def default_tiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(vocab.FEED_TIERS.items()), "feed string, tier int")


def feed_date(raw: Column) -> Column:
    """RFC-822 date, else the first 19 characters as ISO UTC, else null.

    Of an RFC-822 date the day's name and the seconds may be missing, the year may have two digits and
    the zone may be an offset or a name in `ZONES`; without a zone it is UTC.
    """
    text = F.trim(raw)
    parts = r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})\s+([A-Za-z]{3})[A-Za-z]*\s+(\d{4}|\d{2})\s+(\d{1,2}:\d{2})(:\d{2})?\s*([A-Z]{1,3}|[+-]\d{4})?$"
    part = lambda i: F.regexp_extract(text, parts, i)
    year = F.when(F.length(part(3)) == 4, part(3)).otherwise(F.concat(F.when(part(3) < "70", "20").otherwise("19"), part(3)))
    names = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])
    zone = F.when(part(6) == "", "+0000").when(part(6).rlike("^[+-]"), part(6)).otherwise(F.element_at(names, part(6)))
    rebuilt = F.concat_ws(" ", part(1), F.initcap(part(2)), year, F.concat(F.lpad(part(4), 5, "0"), F.coalesce(F.nullif(part(5), F.lit("")), F.lit(":00"))), zone)
    rfc = F.when(text.rlike(parts) & zone.isNotNull(), F.try_to_timestamp(rebuilt, F.lit("d MMM yyyy HH:mm:ss xx")))
    iso = F.try_to_timestamp(F.left(text, F.lit(19)), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return F.coalesce(rfc, iso)


def entry_date(published: Column, updated: Column, as_of: Column) -> Column:
    """A15 over `published`, then `updated`, then `as_of`."""
    return F.coalesce(feed_date(published), feed_date(updated), as_of)


def _items(items: DataFrame, *context: str) -> DataFrame:
    """The parts of an item under one name each, whichever of the two forms it has.

    The link is the text of an element or the `href` of one; an Atom entry's `alternate` comes first.
    """
    parsed = items.select(*context, F.from_xml("item", ITEM, {"rowTag": "item"}).alias("e"))
    blank = F.lit("")
    given = lambda *cs: F.coalesce(*[F.nullif(F.trim(c), blank) for c in cs])
    address = lambda ls: F.transform(ls, lambda a: F.coalesce(F.nullif(F.trim(a["_VALUE"]), blank), a["_href"]))
    main = F.filter("e.link", lambda a: F.coalesce(a["_rel"], F.lit("alternate")) == "alternate")
    first = lambda ls: F.try_element_at(address(ls), F.lit(1))
    tags = F.transform("e.category", lambda c: F.coalesce(F.nullif(F.trim(c["_VALUE"]), blank), c["_term"]))
    return parsed.select(
        *context, strip_space(F.coalesce("e.title", blank)).alias("title"),
        F.coalesce(first(main), first(F.col("e.link")), blank).alias("link"),
        given(F.col("e.id"), F.col("e.guid._VALUE")).alias("id"),
        strip_space(strip_tags(F.coalesce(given(F.col("e.summary._VALUE"), F.col("e.description")), blank))).alias("summary"),
        given(F.col("e.`content:encoded`"), F.col("e.content._VALUE")).alias("content"),
        F.coalesce("e.published", "e.pubDate", "e.`dc:date`").alias("published"), F.col("e.updated").alias("updated"),
        F.coalesce(F.filter(tags, lambda t: t.isNotNull()), F.array().cast("array<string>")).alias("tags"))


def feed_entries(items: DataFrame, tiers: DataFrame, as_of: Column) -> DataFrame:
    """`item` (one feed item as XML text), `feed`, `feed_url` to documents."""
    blank = F.lit("")
    e = _items(items, "feed", "feed_url")
    text = F.left(strip_space(strip_tags(F.coalesce("content", "summary"))), F.lit(3000))
    key = F.coalesce(F.col("id"), F.nullif("link", blank), "title")
    meta = F.struct("feed", "feed_url", "tags")
    return e.where(relevant("title", "summary", vocab.FEED_KEYWORDS)).join(tiers, "feed").select(
        F.concat(F.lit("rss_"), "feed", F.lit(":"), F.left(F.sha2(key, 256), F.lit(16))).alias("uid"),
        "title",
        F.coalesce(F.nullif(text, blank), F.nullif("summary", blank), "title").alias("text"),
        F.col("link").alias("url"),
        F.concat(F.lit("rss_"), "feed").alias("source"),
        F.col("tier").cast("int").alias("ias_tier"),
        entry_date(F.col("published"), F.col("updated"), as_of).alias("published_at"),
        F.to_json(meta).alias("metadata"),
    )


def job_feed(items: DataFrame, tiers: DataFrame, as_of: Column) -> DataFrame:
    """`item`, `tag` to documents; the tier belongs to the feed tag (`tag`, `tier`)."""
    blank = F.lit("")
    e = _items(items, "tag")
    return e.where(relevant("title", "summary", vocab.JOB_KEYWORDS)).join(tiers, "tag").select(
        F.concat(F.lit("jobs_remoteok:"), F.left(F.sha2("link", 256), F.lit(16))).alias("uid"),
        F.concat(F.lit("[Job] "), "title").alias("title"),
        F.coalesce(F.nullif(F.left("summary", F.lit(2000)), blank), "title").alias("text"),
        F.col("link").alias("url"),
        F.lit("jobs_remoteok").alias("source"),
        F.col("tier").cast("int").alias("ias_tier"),
        F.coalesce(feed_date(F.col("published")), as_of).alias("published_at"),
        F.to_json(F.struct(F.col("tag"), F.lit("remoteok").alias("board"))).alias("metadata"),
    )
