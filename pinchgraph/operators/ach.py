"""Competing-hypothesis analysis over long matrix cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinchgraph.functions.jsontext import first_array, string_list
from pinchgraph.operators.hypotheses import needs_review
from pinchgraph.storage import replace_rows, running_offsets

MIN_CONFIDENCE = 0.80
PASS_ROBUSTNESS = 0.40


def review_candidates(hypotheses: DataFrame) -> DataFrame:
    """F1."""
    return hypotheses.where(needs_review(MIN_CONFIDENCE))


def evidence_list(hypotheses: DataFrame, evidence: DataFrame) -> DataFrame:
    """numbered evidence lines (hypothesis_id, evidence_no, line), supporting ones first.

    Within a side lines follow (ts, doc_uid); a hypothesis without evidence gets one structural
    line.  Positions are counted per minute first, so no hypothesis is numbered in one task.
    """
    keyed = evidence.join(hypotheses.select(F.col("id").alias("hypothesis_id")), "hypothesis_id", "left_semi")
    ordered = keyed.withColumn("_salt", F.concat_ws(
        ":", F.when(F.col("supports"), "0").otherwise("1"), F.date_format("ts", "yyyyMMddHHmm"))).withColumn(
        "_tie", F.struct("ts", "doc_uid")).withColumn("_one", F.lit(1).cast("long"))
    numbered = running_offsets(ordered, ["hypothesis_id"], "_one", "_pos").select(
        "hypothesis_id", (F.col("_pos") + 1).alias("evidence_no"), "line", "supports")
    bare = hypotheses.join(evidence.select(F.col("hypothesis_id").alias("id")).distinct(), "id", "left_anti").select(
        F.col("id").alias("hypothesis_id"), F.lit(1).cast("long").alias("evidence_no"),
        F.format_string("Structural risk: SRS=%.2f (graph topology)",
                        F.coalesce(F.nullif("srs_score_at_creation", F.lit(0.0)), F.lit(0.5))).alias("line"),
        F.lit(True).alias("supports"))
    return numbered.unionByName(bare)


def alternatives(responses: DataFrame) -> DataFrame:
    """up to three alternatives from the raw `response` of each hypothesis, else two standard ones.

    Input columns: hypothesis_id, node_name, response.  Output: (hypothesis_id, alt_no, alternative).
    """
    parsed = string_list(first_array(F.col("response")))
    listed = F.slice(F.filter(F.transform(parsed, lambda a: F.trim(a)), lambda a: a != ""), 1, 3)
    standard = F.array(
        F.concat("node_name", F.lit(" supply risk is overstated due to existing alternatives")),
        F.concat(F.lit("Market forces will resolve the "), "node_name", F.lit(" bottleneck within 18 months")))
    chosen = F.when(F.size(F.coalesce(listed, F.array().cast("array<string>"))) > 0, listed).otherwise(standard)
    return responses.select("hypothesis_id", F.posexplode(chosen).alias("_p", "alternative")).select(
        "hypothesis_id", (F.col("_p") + 1).alias("alt_no"), "alternative")


def classify(responses: DataFrame, evidence: DataFrame) -> DataFrame:
    """Long cells (hypothesis_id, alt_no, evidence_no, class) from raw answers.

    `responses` has hypothesis_id, alt_no, response; `evidence` has hypothesis_id, evidence_no.
    Answers are trimmed and upper-cased; anything but C, I, N, and every item without an answer,
    is N.  `alt_no` 0 is the hypothesis itself (S10).  Answers meet the evidence rows on all three
    keys, so no list grows with the evidence of a hypothesis.
    """
    answers = responses.select(
        "hypothesis_id", "alt_no", F.posexplode(string_list(first_array(F.col("response")))).alias("_p", "_c")).select(
        "hypothesis_id", "alt_no", (F.col("_p") + 1).cast("long").alias("evidence_no"), F.upper(F.trim("_c")).alias("_c"))
    cells = evidence.select("hypothesis_id", F.col("evidence_no").cast("long").alias("evidence_no")).join(
        responses.select("hypothesis_id", "alt_no"), "hypothesis_id")
    return cells.join(answers, ["hypothesis_id", "alt_no", "evidence_no"], "left").select(
        "hypothesis_id", "alt_no", "evidence_no", F.when(F.col("_c").isin("C", "I", "N"), F.col("_c")).otherwise("N").alias("class"))


def robustness(cells: DataFrame) -> DataFrame:
    """share of evidence marked I under at least one hypothesis."""
    per_item = cells.groupBy("hypothesis_id", "evidence_no").agg(F.max((F.col("class") == "I").cast("int")).alias("hit"))
    return per_item.groupBy("hypothesis_id").agg(
        F.count(F.lit(1)).alias("evidence_count"), (F.sum("hit") / F.count(F.lit(1))).alias("robustness"))


def review(candidates: DataFrame, cells: DataFrame, as_of: Column) -> DataFrame:
    """review rows; without evidence robustness is 0; passing needs .40."""
    r = F.coalesce("robustness", F.lit(0.0))
    return candidates.select(F.col("id").alias("hypothesis_id")).join(robustness(cells), "hypothesis_id", "left").select(
        "hypothesis_id", F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"), r.alias("robustness"),
        (r >= PASS_ROBUSTNESS).alias("passed"), as_of.alias("reviewed_at"), F.lit(False).alias("human_approved"))


def failed_review_evidence(reviews: DataFrame) -> DataFrame:
    """A failed review is one piece of evidence against its hypothesis."""
    return reviews.where(~F.col("passed")).select(
        "hypothesis_id", F.concat(F.lit("ach:"), F.col("reviewed_at").cast("string")).alias("doc_uid"),
        F.col("reviewed_at").alias("ts"), F.lit(False).alias("supports"),
        F.format_string("[ACH] Robustness=%.2f — confidence adjusted", "robustness").alias("line"))


def save_reviews(stored: DataFrame, reviews: DataFrame) -> DataFrame:
    """F8: replace by hypothesis; a new review is not approved."""
    return replace_rows(stored, reviews.select(*stored.columns), ["hypothesis_id"])


def pending_approval(reviews: DataFrame) -> DataFrame:
    """passed and not approved, newest first."""
    return reviews.where(F.col("passed") & ~F.col("human_approved")).orderBy(F.desc("reviewed_at"), "hypothesis_id")


def approve(reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    """mark the hypotheses in `decisions` approved."""
    d = decisions.select("hypothesis_id").distinct().withColumn("_ok", F.lit(True))
    return reviews.join(d, "hypothesis_id", "left").withColumn(
        "human_approved", F.col("human_approved") | F.coalesce("_ok", F.lit(False))).drop("_ok")


def run_summary(new_reviews: DataFrame, all_reviews: DataFrame) -> DataFrame:
    """reviewed and passed in this run, and all waiting for approval."""
    a = new_reviews.select(F.lit(1).alias("r"), F.col("passed").cast("int").alias("p"), F.lit(0).alias("w"))
    b = all_reviews.select(F.lit(0), F.lit(0), (F.col("passed") & ~F.col("human_approved")).cast("int"))
    return a.union(b).agg(F.coalesce(F.sum("r"), F.lit(0)).alias("reviewed"), F.coalesce(F.sum("p"), F.lit(0)).alias("passed"),
                          F.coalesce(F.sum("w"), F.lit(0)).alias("pending_human_review"))


def matrix_view(cells: DataFrame, alternatives_shown: int = 4) -> DataFrame:
    """one row per evidence item, one column per hypothesis (h0 is the hypothesis itself); missing is N.

    A cell of an alternative that has no column is an error: ask for as many as there are.
    """
    known = F.col("alt_no").between(0, alternatives_shown - 1)
    told = F.raise_error(F.concat(F.lit(f"only {alternatives_shown} alternatives are shown, a cell has number "), F.col("alt_no").cast("string")))
    checked = cells.withColumn("alt_no", F.when(known, F.col("alt_no")).otherwise(told.cast("int")))
    wide = checked.groupBy("hypothesis_id", "evidence_no").pivot("alt_no", list(range(alternatives_shown))).agg(
        F.min(F.ascii("class")))  # codes keep the hash aggregate, strings would sort
    return wide.select("hypothesis_id", "evidence_no", *[
        F.coalesce(F.char(F.col(str(i))), F.lit("N")).alias(f"h{i}") for i in range(alternatives_shown)])


def one_class_per_cell(cells: DataFrame) -> DataFrame:
    """Distinct cells, the smallest class where a cell is repeated (compared by character code)."""
    return cells.groupBy("hypothesis_id", "alt_no", "evidence_no").agg(F.char(F.min(F.ascii("class"))).alias("class"))
