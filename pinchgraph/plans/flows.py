"""The three daily flows: documents to confidence, graph to opportunities, answers to ranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinchgraph.operators import ach, commodities, hypotheses, mentions, resolution, risk, scoring, vectors
from pinchgraph.storage import materialize


@dataclass(frozen=True)
class DocumentFlow:
    """Tables produced from one batch of documents."""

    processed: DataFrame
    mentions: DataFrame
    orphans: DataFrame
    evidence: DataFrame
    hypotheses: DataFrame


def documents_to_confidence(docs: DataFrame, doc_vectors: DataFrame, concepts: DataFrame, node_vectors: DataFrame,
                            responses: DataFrame, hyps: DataFrame, as_of: Column,
                            high: float = resolution.SIMILARITY_HIGH, low: float = resolution.SIMILARITY_LOW) -> DocumentFlow:
    """Clean and tag documents, route them, fold the new evidence into the hypotheses.

    Shuffles only on document, node and hypothesis keys.
    """
    processed = materialize(mentions.process_batch(docs, mentions.name_dictionary(concepts)), "processed").df
    routed = materialize(resolution.route(vectors.top_k_nodes(doc_vectors, node_vectors, 10), high, low), "routed").df
    choices = resolution.valid_choices(routed, responses)
    found = materialize(resolution.auto_mentions(routed, as_of, high).unionByName(resolution.chosen_mentions(choices, as_of)), "found").df
    evidence = hypotheses.document_evidence(hyps, found, processed)
    with_vectors = processed.join(doc_vectors.select(F.col("doc_uid").alias("uid"), "embedding"), "uid", "left")
    return DocumentFlow(processed, found, resolution.orphans(routed, choices, with_vectors, as_of), evidence,
                        hypotheses.apply_evidence(hyps, evidence))


@dataclass(frozen=True)
class RiskFlow:
    """Tables of one risk run."""

    scores: DataFrame
    candidates: DataFrame
    reviews: DataFrame
    opportunities: DataFrame


def graph_to_opportunities(nodes: DataFrame, edges: DataFrame, hyps: DataFrame, cells: DataFrame, stored_reviews: DataFrame,
                           as_of: Column) -> RiskFlow:
    """Score the graph, pick nodes without a hypothesis, review confident hypotheses, rank opportunities.

    `hyps` carries the evidence counts and `n_criteria` that scoring needs.
    """
    scores = risk.node_metrics(nodes, edges)
    fresh = ach.review(ach.review_candidates(hyps), cells, as_of)
    reviews = ach.save_reviews(stored_reviews, fresh)
    return RiskFlow(scores, hypotheses.select_candidates(scores, hyps), reviews,
                    scoring.ranked(scoring.score(hyps, reviews, as_of)))


def answers_to_ranking(responses: DataFrame, dimension: DataFrame, stored: DataFrame, as_of: Column) -> DataFrame:
    """Parse the day's answers, rank them, add the change against the previous run."""
    rows = commodities.scored_rows(responses).join(
        F.broadcast(dimension.select(F.col("name").alias("commodity"), "position")), "commodity", "left")
    return commodities.with_delta(commodities.rank(rows), commodities.previous_run(stored, as_of))
