"""Time the headline queries and print one JSON line.

Every result is consumed in full through the no-op sink.  One small query runs first so that
the session's start-up is not charged to the first headline.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pinchgraph.session import build_session  # noqa: E402
from pinchgraph.workload import load_all  # noqa: E402

HEADLINES = [
    "a2_dedup_insert", "a6_counts", "a7_code_repo_issues", "a10_risk_snippet", "a14_feed_entries", "a21_new_articles",
    "b1_clean_documents", "b3_mentions", "b5_relevance", "b8_chunks", "b9_mean_pool", "b13_evidence_tone",
    "c2_top_k", "c3_route", "c5_orphans",
    "d2_adjacency", "d3_supplier_counts", "d4_d5_centrality", "d6_supply_components", "d7_node_metrics", "d11_what_if", "d13_country_risk",
    "e2_fold_evidence", "e6_document_evidence", "f6_robustness", "f11_matrix_view", "g6_ranked_opportunities",
    "h2_coverage", "h6_monitoring_cycle", "i1_articles", "i7_scored_rows", "i9_delta", "j2_evidence_rows", "j4_risk_trend",
    "l1_ingest_stream", "l3_alert_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]")
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_all().QUERIES
    queries["b17_node_type"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINES:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": float(Path(sf_dir).name.removeprefix("sf")) if Path(sf_dir).name.startswith("sf") else sf_dir}))


if __name__ == "__main__":
    main()
