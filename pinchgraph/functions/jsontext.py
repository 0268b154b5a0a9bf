"""Reading JSON out of free text (B10), topic lists (A22) and loosely typed fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pinchgraph.functions import vocab
from pinchgraph.functions.text import let

_FENCED = r"```(?:json)?[\s]*(\{[\s\S]*?\})[\s]*```"


def fenced_object(raw: Column) -> Column:
    """B10, commodity form: fenced object, else first `{` to last `}`, repaired when truncated; VARIANT or null."""
    fenced = F.regexp_extract(raw, _FENCED, 1)
    braced = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    candidate = let(fenced, lambda f: F.when(f != "", f).otherwise(braced))
    return let(candidate, lambda c: F.when(c != "", F.coalesce(
        *[F.try_parse_json(F.concat(c, F.lit(end))) for end in vocab.JSON_REPAIRS])))


def flat_object(raw: Column) -> Column:
    """B10, node-choice form: first object without inner braces."""
    return F.try_parse_json(F.nullif(F.regexp_extract(raw, r"(\{[^{}]+\})", 1), F.lit("")))


def greedy_object(raw: Column) -> Column:
    """B10, hypothesis form: first `{` to last `}`, no repair."""
    return F.try_parse_json(F.nullif(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), F.lit("")))


def first_array(raw: Column) -> Column:
    """B10, list form: first `[` to the next `]`."""
    return F.try_parse_json(F.nullif(F.regexp_extract(raw, r"(?s)(\[.*?\])", 1), F.lit("")))


def field(doc: Column, name: str) -> Column:
    """A field of a VARIANT object as text; JSON null and absence are SQL null."""
    return F.try_variant_get(doc, f"$.{name}", "string")


def string_list(value: Column) -> Column:
    """A VARIANT array as texts; anything else is null."""
    return F.when(F.startswith(F.schema_of_variant(value), F.lit("ARRAY")),
                  F.try_variant_get(value, "$", "array<string>"))


def safe_list(doc: Column, name: str, max_items: int = 5, max_chars: int = 200) -> Column:
    """At most `max_items` texts of at most `max_chars`; not a list gives an empty list."""
    items = string_list(F.try_variant_get(doc, f"$.{name}", "variant"))
    return F.coalesce(F.transform(F.slice(items, 1, max_items), lambda x: F.left(x, F.lit(max_chars))),
                      F.array().cast("array<string>"))


def topics(raw: Column) -> Column:
    """JSON list, else comma-separated; blank or JSON of another kind gives an empty list."""
    blank = F.coalesce(F.trim(raw), F.lit("")) == ""
    parsed = F.try_parse_json(raw)
    split = F.filter(F.transform(F.split(raw, ","), lambda t: F.trim(t)), lambda t: t != "")
    empty = F.array().cast("array<string>")
    return (F.when(blank, empty)
            .when(parsed.isNotNull(), F.coalesce(string_list(parsed), empty))
            .otherwise(split))
