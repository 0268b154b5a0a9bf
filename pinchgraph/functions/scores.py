"""Scoring expressions: opportunity score (G), risk score (D7), stress score and its parts (I), bands (J)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pinchgraph.functions import vocab
from pinchgraph.functions.text import days_since, let


def round_half_up(c: Column, digits: int) -> Column:
    """Decimal rounding after cutting to ten digits, so that the order of a sum never decides a tie."""
    return F.round(F.round(c, 10), digits)


def or_default(c: Column, default: float) -> Column:
    """Zero counts as missing."""
    return F.coalesce(F.nullif(c, F.lit(0).cast("double")), F.lit(default))


def risk_score(betweenness: Column, concentration: Column, criticality: Column, is_ap: Column) -> Column:
    """Additive score capped at 1."""
    base = betweenness * 0.40 + concentration * 0.35 + criticality * 0.25
    return F.least(base + F.when(is_ap, F.lit(0.20)).otherwise(F.lit(0.0)), F.lit(1.0))


def asymmetry(layer: Column) -> Column:
    """G1: layers 1-4; any other 0.25."""
    return (F.when(layer == 1, 0.75).when(layer == 2, 0.50).when(layer == 3, 0.25).when(layer == 4, 0.0)
            .otherwise(0.25))


def recency(updated: Column, as_of: Column) -> Column:
    """1 under 7 days, 0.5 under 30, else 0.1; no date 0.5."""
    days = days_since(updated, as_of)
    return (F.when(updated.isNull(), 0.5).when(days < 7, 1.0).when(days < 30, 0.5).otherwise(0.1))


def tier(ops: Column) -> Column:
    """On the unrounded score."""
    return F.when(ops >= 0.60, 1).when(ops >= 0.35, 2).otherwise(3)


def plain_number(raw: Column) -> Column:
    """A decimal number as double; anything else, such as `75d`, NaN and infinity, is null."""
    text = F.trim(raw)
    number = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text).try_cast("double")
    return F.when(F.abs(number) != float("inf"), number)


def sub_score(raw: Column, default: int = 50) -> Column:
    """Numeric text truncated and clamped to 0-100; anything else, infinity included, `default`."""
    number = plain_number(raw)
    usable = number.isNotNull()
    return F.when(usable, F.greatest(F.lit(0.0), F.least(F.lit(100.0), number))).otherwise(
        F.lit(float(default))).cast("int")


def stress_score(scores: dict[str, Column]) -> Column:
    """Weighted sum of the nine sub-scores, two digits."""
    total = F.lit(0.0)
    for name, weight in vocab.STRESS_WEIGHTS.items():
        total = total + scores[name] * F.lit(weight)
    return F.round(total, 2)


def outlook(raw: Column) -> Column:
    """Exact word, then phrases in order, then word families, else neutral."""
    def classify(v: Column) -> Column:
        expr = F.when(v == "", "neutral").when(v.isin(vocab.OUTLOOKS), v)
        for phrase, value in vocab.OUTLOOK_PHRASES:
            expr = expr.when(F.contains(v, F.lit(phrase)), value)
        for words, value in ((vocab.BEARISH_WORDS, "bearish"), (vocab.BULLISH_WORDS, "bullish")):
            for word in words:
                expr = expr.when(F.contains(v, F.lit(word)), value)
        return expr.otherwise("neutral")

    return let(F.regexp_replace(F.trim(F.lower(F.coalesce(raw, F.lit("")))), r"\.+$", ""), classify)


def consensus(raw: Column) -> Column:
    """I4: tight, contested or divided."""
    def classify(v: Column) -> Column:
        expr = None
        for words, value in ((vocab.TIGHT_WORDS, "tight"), (vocab.CONTESTED_WORDS, "contested")):
            for word in words:
                hit = F.contains(v, F.lit(word))
                expr = F.when(hit, value) if expr is None else expr.when(hit, value)
        return expr.otherwise("divided")

    return let(F.trim(F.lower(F.coalesce(raw, F.lit("")))), classify)


def stress_band(score: Column) -> Column:
    """High from 70, elevated from 40."""
    return F.when(score.isNull(), "none").when(score >= 70, "high").when(score >= 40, "elevated").otherwise("low")


def delta_text(delta: Column) -> Column:
    """Signed one-digit change with an arrow; a dash inside +-0.05."""
    return (F.when(delta.isNull() | (F.abs(delta) < 0.05), "—")
            .otherwise(F.concat(F.format_string("%+.1f", delta),
                                F.when(delta > 0, " ▲").otherwise(" ▼"))))


def stars(n: Column) -> Column:
    """One to five filled stars; missing gives a dash."""
    filled = F.greatest(F.lit(1), F.least(F.lit(5), n)).cast("int")
    return F.when(n.isNull(), "—").otherwise(
        F.concat(F.repeat(F.lit("★"), filled), F.repeat(F.lit("☆"), F.lit(5) - filled)))


def confidence_band(confidence: Column) -> Column:
    """High from 0.7, medium from 0.5."""
    c = F.coalesce(confidence, F.lit(0.0))
    return F.when(c >= 0.7, "high").when(c >= 0.5, "medium").otherwise("low")
