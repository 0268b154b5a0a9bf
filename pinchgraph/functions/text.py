"""Text expressions: cleaning, tokens, whole-word tests, relevance, evidence tone.

All are built-in column expressions, so no row leaves the JVM.  Lambdas over arrays, as in `let` and
`contains_any`, are interpreted there; the expressions around them are compiled.  Word characters are Unicode letters, digits and the underscore, whatever the JDK's
default for `\\w` is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pinchgraph.functions import vocab
from pinchgraph.model import CLEAN_CHARS

WORD = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]"
SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_SPACE = SPACE.replace("[", "[^", 1)
TAG = r"<[^>]+>"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """`use(value)` with the value computed once per row, however often `use` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip_space(c: Column | str) -> Column:
    """Trim Unicode white space at both ends."""
    return F.regexp_replace(_col(c), f"^{SPACE}+|{SPACE}+$", "")


def strip_tags(c: Column | str) -> Column:
    """Markup tags become spaces."""
    return F.regexp_replace(_col(c), TAG, " ")


def clean_text(c: Column | str, limit: int = CLEAN_CHARS) -> Column:
    """B1: tags and links to spaces, white space collapsed, trimmed, cut to `limit`."""
    no_links = F.regexp_replace(strip_tags(c), f"https?://{NOT_SPACE}+", " ")
    return F.left(F.trim(F.regexp_replace(no_links, f"{SPACE}+", " ")), F.lit(limit))


def contains_any(c: Column, terms: list[str], fold_terms: bool = True) -> Column:
    """Whether lower-cased text holds one of `terms` as a substring."""
    listed = F.array(*[F.lit(t.lower() if fold_terms else t) for t in terms])
    return let(F.lower(c), lambda low: F.exists(listed, lambda term: F.contains(low, term)))


def relevant(title: Column | str, body: Column | str, terms: list[str]) -> Column:
    """B5 over `title + ' ' + body`, missing parts read as empty."""
    text = F.concat(F.coalesce(_col(title), F.lit("")), F.lit(" "), F.coalesce(_col(body), F.lit("")))
    return contains_any(text, terms)


def count_terms(low: Column, terms: list[str]) -> Column:
    """How many of `terms` occur in already lower-cased text."""
    return F.size(F.filter(F.array(*[F.lit(t) for t in terms]), lambda term: F.contains(low, term)))


def evidence_tone(title: Column | str, text: Column | str) -> Column:
    """(risk - mitigating) / (risk + mitigating) in [-1, 1]; 0 without any term."""
    low = F.lower(F.concat(F.coalesce(_col(title), F.lit("")), F.lit(" "), F.coalesce(_col(text), F.lit(""))))
    return let(low, lambda t: let(
        F.struct(count_terms(t, vocab.RISK_TERMS).alias("risk"), count_terms(t, vocab.MITIGATING_TERMS).alias("calm")),
        lambda n: F.greatest(F.lit(-1.0), F.least(
            F.lit(1.0), (n["risk"] - n["calm"]) / F.greatest(F.lit(1), n["risk"] + n["calm"])))))


def evidence_line(uid: Column | str, title: Column | str) -> Column:
    """`[uid12] title120`."""
    return F.concat(F.lit("["), F.left(_col(uid), F.lit(12)), F.lit("] "),
                    F.left(F.coalesce(_col(title), F.lit("")), F.lit(120)))


def source_class(line: Column | str) -> Column:
    """Displayed source from the uid prefix of an evidence line."""
    def classify(uid: Column) -> Column:
        expr = None
        for prefix, name in vocab.SOURCE_CLASSES:
            hit = F.startswith(uid, F.lit(prefix))
            expr = F.when(hit, name) if expr is None else expr.when(hit, name)
        return expr.otherwise("Unknown")

    return let(F.regexp_extract(_col(line), r"^\[([^\]]*)\]", 1), classify)


def node_type(node_id: Column | str) -> Column:
    """The part before the first dash, else the first three characters, else a dash."""
    node_id = F.coalesce(_col(node_id), F.lit(""))
    return (F.when(F.contains(node_id, F.lit("-")), F.substring_index(node_id, "-", 1))
            .when(node_id != "", F.left(node_id, F.lit(3)))
            .otherwise("—"))


def days_since(ts: Column | str, as_of: Column) -> Column:
    """Whole days (floor) from `ts` to `as_of`; missing or unreadable gives 999."""
    seconds = F.unix_micros(as_of) - F.unix_micros(_col(ts))
    return F.coalesce(F.floor(seconds / F.lit(86_400_000_000)), F.lit(999)).cast("long")


def embedding_input(label: Column, name: Column, aliases: Column, description: Column) -> Column:
    """Text sent to the embedding service for a concept."""
    return F.concat(label, F.lit(": "), name, F.lit(". Aliases: "),
                    F.concat_ws(", ", F.coalesce(aliases, F.array().cast("array<string>"))), F.lit(". "),
                    F.coalesce(description, F.lit("")))


def document_embedding_input(title: Column, text: Column) -> Column:
    """Text sent to the embedding service for a document."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.left(F.coalesce(text, F.lit("")), F.lit(1500)))


def chunks(text: Column, size: int = 2000, step: int = 1800) -> Column:
    """Overlapping pieces; a text of at most `size` characters is one piece, blank is ' '."""
    def cut(body: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.length(body) - 1, F.lit(0)), F.lit(step))
        return F.when(F.length(body) <= size, F.array(body)).otherwise(
            F.transform(starts, lambda i: F.substring(body, i + 1, F.lit(size))))

    return let(strip_space(text), lambda t: let(F.when(t == "", F.lit(" ")).otherwise(t), cut))


def watch_keywords(node_name: Column, statement: Column, limit: int = 8) -> Column:
    """Node name, then capitalised words of the statement; distinct, first `limit`, no empties."""
    words = F.regexp_extract_all(F.coalesce(statement, F.lit("")),
                                 F.lit(rf"(?<!{WORD})[A-Z][a-z]{{2,}}(?!{WORD})"), F.lit(0))
    ordered = F.array_distinct(F.concat(F.array(F.coalesce(node_name, F.lit(""))), words))
    return F.filter(F.slice(ordered, 1, limit), lambda k: k != "")


def tokens(c: Column) -> Column:
    """Lower-case word runs in reading order."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"{WORD}+"), F.lit(0))


def gaps(c: Column) -> Column:
    """Runs of non-word characters standing between two word characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"(?<={WORD}){NON_WORD}+(?={WORD})"), F.lit(0))


def whole_word_pattern(name: Column) -> Column:
    """Regular expression matching lower-cased `name` between word boundaries.

    A boundary needs a change between word and non-word character, so a name edge that is
    itself punctuation must touch a word character.
    """
    low = F.lower(name)
    head = F.when(F.regexp_like(low, F.lit(f"^{WORD}")), F.lit(f"(?<!{WORD})")).otherwise(F.lit(f"(?<={WORD})"))
    tail = F.when(F.regexp_like(low, F.lit(f"{WORD}$")), F.lit(f"(?!{WORD})")).otherwise(F.lit(f"(?={WORD})"))
    quoted = F.regexp_replace(low, r"([\\.^$|?*+()\[\]{}\-])", r"\\$1")
    return F.concat(head, quoted, tail)


def whole_word(name: Column, text: Column) -> Column:
    """Case-insensitive whole-word test."""
    return F.regexp_like(F.lower(text), whole_word_pattern(name))


def ascii_lower(c: Column) -> Column:
    """Lower case for A-Z only, as SQL `LIKE` in the stored tables compares."""
    return F.translate(c, _UPPER, _UPPER.lower())


# Paragraphs of the node explanation, by what they depend on.
AP_TEXT = ("** is an articulation point — removing it from the supply chain graph would disconnect other nodes, "
           "making it structurally irreplaceable in the short term.")
HIGH_BETWEENNESS = ("It sits on a disproportionate share of the shortest paths between all supply chain nodes "
                    "(betweenness=%.3f), meaning most routes depend on it as an intermediary.")
SOME_BETWEENNESS = "It acts as a significant intermediary in the supply chain (betweenness=%.3f)."
HIGH_CONCENTRATION = ("Supplier concentration is critically high (%.2f/1.0) — there are very few qualified "
                      "alternatives, and requalification typically takes 2–5 years.")
SOME_CONCENTRATION = "Supplier concentration is elevated (%.2f/1.0), indicating limited alternatives."
LABEL_TEXT = {
    "Geography": "Geographic concentration adds geopolitical and natural disaster risk that cannot be diversified "
                 "through supplier selection alone — all suppliers in the same country share the same tail risk.",
    "Company": "Single-company dependency means any disruption to this firm's operations propagates immediately "
               "across its entire customer base.",
    "Material": "Material constraints are particularly sticky — new sources require geological prospecting, "
                "extraction infrastructure, and process qualification, each taking years.",
    "Process": "Process know-how is tacit and hard to transfer — loss of this capability typically requires "
               "multi-year reconstruction and significant capital investment.",
    "Equipment": "Capital equipment has 1–3 year lead times and highly proprietary specifications, making rapid "
                 "substitution nearly impossible even with unlimited capital.",
    "Technology": "Proprietary technology creates deep lock-in; competitors require years of R&D to replicate "
                  "equivalent capability.",
    "Regulation": "Regulatory chokepoints can shift rapidly with policy changes, creating both downside risk and "
                  "asymmetric information advantage.",
}


def explain_node(name: Column, label: Column, srs: Column, betweenness: Column, concentration: Column,
                 is_ap: Column) -> Column:
    """Paragraphs saying why a node is a chokepoint, joined by blank lines."""
    label_text = None
    for key, value in LABEL_TEXT.items():
        label_text = F.when(label == key, value) if label_text is None else label_text.when(label == key, value)
    parts = F.array_compact(F.array(
        F.when(is_ap, F.concat(F.lit("**"), name, F.lit(AP_TEXT))),
        F.when(betweenness > 0.5, F.format_string(HIGH_BETWEENNESS, betweenness))
        .when(betweenness > 0.15, F.format_string(SOME_BETWEENNESS, betweenness)),
        F.when(concentration > 0.80, F.format_string(HIGH_CONCENTRATION, concentration))
        .when(concentration > 0.50, F.format_string(SOME_CONCENTRATION, concentration)),
        label_text,
    ))
    # fixed value
    fallback = F.concat(name, F.format_string(
        " has a high structural risk score (SRS=%.3f) based on its position in the dependency graph.", srs))
    return F.when(F.size(parts) == 0, fallback).otherwise(F.array_join(parts, "\n\n"))
