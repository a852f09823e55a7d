"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from dossier.plans import QUERIES  # noqa: E402
from dossier.session import build_session  # noqa: E402

HEADLINE = [
    "chunk_words", "chunk_chars", "evidence_units", "token_stats", "html_text", "html_sections",
    "bm25_topk", "index_topk", "bm25_by_tenant", "unit_scores", "dense_topk", "hybrid_fusion", "rerank_blend", "role_topk", "full_query", "ingest_answer",
    "reliability_gate", "retrieval_citation", "eval_metrics", "grouping_set_rates", "p95_lower", "composite_score",
    "prefilter_score", "dup_exact", "best_per_fingerprint", "cluster_anchor", "greedy_cover", "round_robin", "hash_sample",
    "pair_resolution", "question_gold_source", "expected_sources", "document_routing", "forward_fill", "kv_parse",
    "table_candidates", "resolve_candidates", "structured_records", "financial_answers", "batch_sessions",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", cpus)
    QUERIES["token_cost"](spark, sf).write.format("noop").mode("overwrite").save()  # JVM and file-system warm-up
    times = {}
    for n in names:
        t0 = time.perf_counter()
        QUERIES[n](spark, sf).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    n_items = spark.read.parquet(f"{sf}/benchmark.parquet").count()
    out = {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
           "sf": Path(sf).name.replace("sf", ""), "sec_per_question": {
               k: round(times[k] / max(1, n_items), 4) for k in ("bm25_topk", "hybrid_fusion", "rerank_blend", "full_query") if k in times}}
    print(json.dumps(out), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
