"""Company filings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinchgraph.functions import vocab
from pinchgraph.functions.text import SPACE, let, strip_tags

SUBMISSIONS = """struct<filings: struct<recent: struct<form: array<string>, filingDate: array<string>,
accessionNumber: array<string>, primaryDocument: array<string>>>>"""


def recent_filings(payloads: DataFrame, cutoff: Column) -> DataFrame:
    """`payload` (parallel arrays), `company`, `cik` to one row per wanted filing.

    Reading stops at the first wanted form older than `cutoff` (ISO text).
    """
    recent = F.from_json("payload", SUBMISSIONS)["filings"]["recent"]
    shortest = F.least(*[F.size(recent[c]) for c in ("form", "filingDate", "accessionNumber", "primaryDocument")])
    zipped = F.slice(F.arrays_zip(
        recent["form"].alias("form"), recent["filingDate"].alias("date"),
        recent["accessionNumber"].alias("accession"), recent["primaryDocument"].alias("doc")), F.lit(1), shortest)
    wanted = F.filter(zipped, lambda z: z["form"].isin(vocab.FILING_FORMS))
    # rows before the first stale one; -1 for stale rows finds the stop without a position scan per row
    first_stale = F.array_position(F.transform(wanted, lambda z: z["date"] < cutoff), True)
    kept = F.when(first_stale > 0, F.slice(wanted, F.lit(1), first_stale.cast("int") - 1)).otherwise(wanted)
    rows = payloads.select("company", "cik", F.inline(kept))
    return rows.select(
        "company", "cik", "form", "date", "accession",
        F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.col("cik").cast("long").cast("string"), F.lit("/"),
                 F.replace("accession", F.lit("-"), F.lit("")), F.lit("/"), "doc").alias("url"),
    )


def risk_snippet(body: Column, terms: list[str] | None = None, case_fold_terms: bool = False) -> Column:
    """A10: the longest of the windows (200 before, 500 after) around the first hit of each term.

    The first term wins ties; without a hit, the first 1000 characters.  Terms are compared as
    written with lower-cased text unless `case_fold_terms` (S17).
    """
    listed = F.array(*[F.lit(t.lower() if case_fold_terms else t) for t in terms or vocab.FILING_TERMS])

    def longest(text: Column, low: Column) -> Column:
        def window(term: Column) -> Column:
            at = F.instr(low, term)
            start = F.greatest(at - 200, F.lit(1))
            return F.when(at > 0, F.substring(text, start, at + 500 - start)).otherwise(F.lit(""))

        best = F.aggregate(F.transform(listed, window), F.lit(""),
                           lambda acc, s: F.when(F.length(s) > F.length(acc), s).otherwise(acc))
        return let(best, lambda b: F.when(b != "", F.left(b, F.lit(3000))).otherwise(F.left(text, F.lit(1000))))

    text = F.trim(F.regexp_replace(strip_tags(body), f"{SPACE}+", " "))
    return let(text, lambda t: let(F.lower(t), lambda low: longest(t, low)))


def filing_documents(filings: DataFrame) -> DataFrame:
    """Filings with their fetched `body` (may be null) to documents."""
    fallback = F.concat_ws(" ", "company", "form", "date")
    return filings.select(
        F.concat(F.lit("edgar:"), "cik", F.lit(":"), "accession").alias("uid"),
        F.concat(F.lit("["), "form", F.lit("] "), "company", F.lit(" — "), "date").alias("title"),
        F.when(F.col("body").isNull(), fallback).otherwise(risk_snippet(F.col("body"))).alias("text"),
        "url",
        F.lit("edgar").alias("source"),
        F.lit(1).alias("ias_tier"),
        F.try_to_timestamp(F.concat("date", F.lit("T00:00:00Z"))).alias("published_at"),
        F.to_json(F.struct("company", "cik", F.col("form").alias("form_type"), "accession")).alias("metadata"),
    )
