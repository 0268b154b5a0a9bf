from pathlib import Path

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from pinchgraph.llm import queries
from tools.check import TABLES, rows

SF = "/root/testdata/sf0.001"
NAMES = ["op1_decontamination", "op2_url_filters", "op3_substring_dedup", "op4_simhash", "op5_chat", "op6_topk", "op7_quality", "op8_sharding", "op9_packing", "op10_warc", "op11_exact_dedup", "op12_divergence", "op13_prefix_trie", "pipeline"]


def test_all_registered():
    assert set(NAMES) <= set(entry.queries())
    assert set(queries.ORACLES) <= set(entry.oracle_sql())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "decontamination", "packing"]


def test_stages_apply_their_operators(llm, docs_of, prose, tmp_path):
    """Copies, near copies, a shared passage, a benchmark item and junk planted among clean documents."""
    clean = [(i, prose(80 + i % 50, i)) for i in range(200)]
    words = clean[3][1].split()
    passage, item = prose(60, 900), prose(40, 901)
    planted = [
        (301, clean[7][1]), (302, " ".join([*words[:40], "changed", *words[40:]])), (303, prose(50, 910) + " " + passage), (304, prose(50, 911) + " " + passage),
        (305, prose(50, 912) + " " + item + " " + prose(20, 913)), (306, " ".join(w.upper() + "!!" for w in prose(80, 914).split())),
    ]
    junk = [(400 + i, " ".join(w.upper() + "!!" for w in prose(60, 1000 + i).split())) for i in range(60)]
    docs_of(clean + planted + junk).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i in range(0, 200, 2)] + [(400 + i, 0, 0) for i in range(0, 60, 2)]
    llm.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    llm.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = llm.read.parquet(str(tmp_path / "documents.parquet")), {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(llm, docs, str(tmp_path))
        if n < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = llm.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()} if n < 4 else docs.collect()
    kept = {n: set(s) for n, s in seen.items() if n != "packing"}
    assert 306 not in kept["quality"] and not kept["quality"] & set(range(400, 460)) and len(kept["quality"] & set(range(200))) >= 194
    lost = kept["quality"] - kept["near_dedup"]
    assert lost == {i for i in (301, 302) if i in kept["quality"] and {301: 7, 302: 3}[i] in kept["quality"]}
    assert kept["substring_dedup"] == kept["near_dedup"]
    assert [i for i in (303, 304) if passage in seen["substring_dedup"].get(i, "")] == [303]
    assert kept["substring_dedup"] - kept["decontamination"] == {305} & kept["substring_dedup"]
    assert {r["doc_id"] for r in seen["packing"]} == kept["decontamination"]


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equal_to_sql(llm, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = entry.queries()[name](llm, SF).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
