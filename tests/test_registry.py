"""The registry, and a few registered queries against their SQL twins at the smallest scale."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows

SF = "/root/testdata/sf0.001"
SAMPLE = ["a2_dedup_insert", "a20_source_report", "a33_work_state", "j11_system_status", "b1_clean_text", "c2_top_k", "d3_supplier_counts", "e2_fold_evidence", "f6_robustness", "g6_ranked_opportunities", "i9_delta", "j4_risk_trend"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 140


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")
@pytest.mark.parametrize("name", SAMPLE)
def test_sample_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")
def test_entry(spark):
    df = entry.entry(spark)
    assert "ops_final" in df.columns and df.count() > 0
