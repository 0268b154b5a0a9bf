"""The composed flows on the smallest driver tables agree with the single operators."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pinchgraph.operators import resolution
from pinchgraph.plans import flows
from pinchgraph.workload.views import HIGH, LOW, Views, as_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")


def test_documents_to_confidence(spark):
    v = Views(spark, SF)
    f = flows.documents_to_confidence(v.docs, v.doc_vectors, v.concepts, v.node_vectors, v.choices_raw, v.hyps, as_of(), HIGH, LOW)
    out = resolution.outcomes(v.routed, resolution.valid_choices(v.routed, v.choices_raw)).first()
    assert f.orphans.count() == out.orphaned
    assert f.mentions.select("doc_uid").distinct().count() == out.auto_routed + out.choice_routed
    assert f.processed.count() == v.docs.count()
    assert f.hypotheses.count() == v.hyps.count()
    assert f.hypotheses.agg(F.sum(F.col("evidence_for") + F.col("evidence_against"))).first()[0] == f.evidence.count()


def test_graph_to_opportunities(spark):
    v = Views(spark, SF)
    f = flows.graph_to_opportunities(v.nodes, v.edges, v.hyps_counted, v.cells, v.reviews.select(
        "hypothesis_id", "robustness", "passed", "reviewed_at", "human_approved"), as_of())
    assert f.scores.count() == v.nodes.count()
    assert f.opportunities.count() == v.hyps.where("status = 'active'").count()
    assert f.candidates.count() <= 10
