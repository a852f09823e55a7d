"""Registered queries against their SQL twins at the smallest scale, and the driver contract."""
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402
from tools.check import TABLES, rows_of  # noqa: E402

SAMPLE = ["chunk_words", "chunk_chars", "token_stats", "normalise_flags", "value_equivalence", "bm25_topk", "bm25_postings_join", "hybrid_fusion",
          "html_sections", "record_header_chunks", "workbook_questions", "eval_metrics", "grouping_set_rates", "p95_lower", "cluster_anchor",
          "greedy_cover", "hash_sample", "pair_resolution", "document_routing", "table_candidates", "resolve_text_values", "readiness_chain",
          "candidate_collapse", "stream_ingest", "stream_windows", "expected_sources"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(entry.oracle_sql()[name])
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_contract(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert len(q) > 200 and set(o) <= set(q)
    df = entry.entry(spark)
    assert df.count() > 0 and "confidence" in df.columns


def test_no_cartesian_product_in_lexical_plan(spark, sf):
    plan = entry.queries()["bm25_postings_join"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "WindowGroupLimit" in plan
