"""Work that grows with the input is done once."""
import random

from pyspark.sql import functions as F

from dossier.operators import curation as CU, ranking as R
from dossier.plans import QUERIES


def test_grams_of_a_rubric_are_made_once(spark):
    d = spark.createDataFrame([("what is the sum", "the sum is 5", "so the sum is 5 now", False), (None, "a", "a", True), ("", "", "", False)],
                              "q string, n string, u string, dup boolean")
    r = d.select(CU.silver_rubric(F.col("q"), F.col("n"), F.col("u"), F.col("u"), F.col("dup")).alias("r"))
    assert r._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 3
    assert [tuple(x.r) for x in r.collect()] == [(2, 2, 2, "promote"), (2, 0, 2, "reject_duplicate"), (2, 0, 0, "revise")]


def test_planned_chunks_share_the_count_of_the_corpus(spark, sf, monkeypatch):
    count, made = R.text_vocabulary, []
    monkeypatch.setattr(R, "text_vocabulary", lambda *a: made.append(a) or count(*a))
    for name in ("role_topk", "single_doc_retrieval"):
        QUERIES[name](spark, sf)
    assert len(made) == 2


def test_postings_meet_queries_in_cells(spark, monkeypatch):
    """Slabs of queries and groups of segments: the rows of scoring everything, without a row per query, term and chunk."""
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rnd.choices(words, [1 / (i + 1) for i in range(40)], k=rnd.randint(1, n)))
    chunks = spark.createDataFrame([(i, text(30)) for i in range(300)] + [(900, None), (901, "")], "id long, text string").repartition(3)
    queries = spark.createDataFrame([(q, text(9)) for q in range(20)] + [(90, "unknown")], "query_id long, text string")
    monkeypatch.setattr(R, "CELL_TERMS", 25)
    monkeypatch.setattr(R, "SEGMENT", 30)
    monkeypatch.setattr(R.segments, "__defaults__", (30,))
    got = R.lexical_topk(chunks, queries, ["id"], 5, max_cells=0)
    want = R.ranked(R.lexical_scores(chunks, queries, ["id"]), "query_id", "bm25", ["id"], 5)
    rows = lambda d: sorted((r.query_id, r.rank, r.id, round(r.bm25, 9), round(r.overlap, 9)) for r in d.collect())
    assert rows(got) == rows(want)
    assert "overlap" in got.columns and "common" not in got._jdf.queryExecution().logical().toString()  # no count per query and chunk
