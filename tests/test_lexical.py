"""Pruned search against scoring everything: random corpora, ties, tenants, boosts, negative weights; blocks are skipped."""
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from dossier.operators import lexical as L, ranking as R


def corpus(seed, n, words, tenants=("a", "b")):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return [(i, rnd.choice(tenants), " ".join(rnd.choices(vocab, weights, k=rnd.randint(1, 40))), rnd.choice([0.0, .5, -.25])) for i in range(n)], rnd, vocab


def rows(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9), round(r["bm25"], 9), round(r["overlap"], 9)) for r in df.collect())


@pytest.mark.parametrize("weights", [(1.0, 0.0), (0.6, 0.4), (0.0, 1.0)])
def test_three_ways_give_the_same_rows(spark, tmp_path, weights):
    data, rnd, vocab = corpus(1, 700, 60)
    chunks = spark.createDataFrame(data, "id long, co string, text string, b double").repartition(3)
    asked = [(q, rnd.choice("ab"), " ".join(rnd.choices(vocab, k=rnd.randint(1, 12)))) for q in range(25)] + [(90, "a", "unknown"), (91, "b", "")]
    queries = spark.createDataFrame(asked, "query_id long, co string, text string")
    for tenant in (None, "co"):
        path = f"{tmp_path}/{tenant}"
        ix = R.build_index(chunks, ["id"], path, tenant=tenant, keep=["b"])
        for boost in (None, "b"):
            kw = {"bm25_weight": weights[0], "overlap_weight": weights[1], "boost": boost, "tenant": tenant}
            want = rows(R.lexical_topk(chunks, queries, ["id"], 5, max_cells=0, **kw))
            assert rows(R.lexical_topk(chunks, queries, ["id"], 5, **kw)) == want
            assert rows(R.lexical_topk(ix, queries, ["id"], 5, **kw)) == want


def test_small_segments_and_repeated_chunks(spark, tmp_path, monkeypatch):
    data, rnd, vocab = corpus(2, 300, 25)
    data += [(1000 + i, "a", data[7][2], 0.0) for i in range(40)]  # ties over several segments
    chunks = spark.createDataFrame(data, "id long, co string, text string, b double").coalesce(1)
    queries = spark.createDataFrame([(0, data[7][2]), (1, "w0 w1 w2")], "query_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        monkeypatch.setattr(R._invert, "__defaults__", (20,))
        ix = R.build_index(chunks, ["id"], str(tmp_path))
        assert ix.postings.select("segment").distinct().count() == 17
        want = rows(R.lexical_topk(chunks, queries, ["id"], 5, max_cells=0))
        assert rows(R.lexical_topk(ix, queries, ["id"], 5)) == rows(R.lexical_topk(chunks, queries, ["id"], 5)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def segment(tf_rows, n, avgdl=20.0):
    """tf_rows: per term a list of (row, tf)."""
    at = np.r_[0, np.cumsum([len(t) for t in tf_rows])]
    r = np.array([x for t in tf_rows for x, _ in t], int)
    tf = np.array([x for t in tf_rows for _, x in t], float)
    sat = L.saturated(tf, np.full(len(r), 20.0), avgdl)
    return L.Segment(at, r, sat, *L.block_tops(at, sat), np.full(n, 15.0), None)


def test_walk_against_full_scores_with_negative_weights():
    rng = np.random.default_rng(3)
    for trial in range(40):
        n, terms = int(rng.integers(1, 600)), 12
        post = [[(int(r), int(rng.integers(1, 6))) for r in np.flatnonzero(rng.random(n) < p)] for p in rng.random(terms) ** 2]
        s = segment(post, n)
        w = pd.DataFrame([(q, f"t{t:02d}", 5.0, 20.0, float(rng.normal(1, 1))) for q in range(6) for t in rng.choice(terms, 5, replace=False)],
                         columns=["q", "term", "qd", "avgdl", "w"])
        asked = L.Asked.of(w, "q", None)
        search = L.Search(asked, 3, 1.0, 0.3)
        number = {f"t{t:02d}": t for t in range(terms)}
        order = [number[t] for t in asked.terms]
        s = segment([post[t] for t in order], n)
        for _ in range(2):  # the second time with floors
            c, r, bm, ov, sc = search.segment(s, np.arange(6))
            for q in range(6):
                full = {}
                for _, x in w[w.q == asked.qids[q]].iterrows():
                    for row, tf in post[number[x.term]]:
                        b, m = full.get(row, (0.0, 0))
                        full[row] = (b + x.w * L.saturated(np.array(tf, float), np.array(20.0), 20.0), m + 1)
                score = sorted(((b + .3 * (.75 * m / 5 + .25 * m / 10), row) for row, (b, m) in full.items()), key=lambda v: (-round(v[0], 9), v[1]))[:3]
                got = sorted(((float(x), int(row)) for x, row in zip(sc[c == q], r[c == q])), key=lambda v: (-round(v[0], 9), v[1]))[:3]
                assert [(round(a, 9), b) for a, b in got] == [(round(float(a), 9), b) for a, b in score]


def test_blocks_are_skipped(spark, tmp_path):
    """A rare term decides, so the lists of the frequent ones are read at its places only."""
    rnd = random.Random(5)
    data = [(i, " ".join(["of", "the"] * rnd.randint(1, 3) + [f"x{rnd.randint(0, 500)}" for _ in range(10)] + (["rare"] * 4 if i % 900 == 0 else []))) for i in range(9000)]
    chunks = spark.createDataFrame(data, "id long, text string").coalesce(1)
    queries = spark.createDataFrame([(0, "the rare of")], "query_id long, text string")
    ix = R.build_index(chunks, ["id"], str(tmp_path))
    assert rows(R.lexical_topk(ix, queries, ["id"], 3)) == rows(R.lexical_topk(chunks, queries, ["id"], 3, max_cells=0))
    spent = [(r["blocks"], r["read"]) for r in R.lexical_topk(ix, queries, ["id"], 3, work=True).collect() if r["blocks"]]
    one = L.Search(L.Asked.of(pd.DataFrame({"q": [0, 0], "term": ["a", "b"], "qd": 2.0, "avgdl": 20.0, "w": [5.0, .1]}), "q", None), 3, 1.0, 0.0)
    s = segment([[(i, 3) for i in range(0, 9000, 900)], [(i, 1) for i in range(9000)]], 9000)
    for _ in range(2):
        one.segment(s, np.arange(1))
    assert spent and all(r <= b for b, r in spent)
    assert one.read < .7 * one.blocks


def test_null_tokens_and_null_tenants():
    batch = pa.record_batch({"toks": pa.array([["a", "b", "a"], None, []]), "dl": pa.array([3, None, 0]), "co": pa.array(["x", None, "x"])})
    at, r, tf = L.counted(batch.column("toks"), pa.array(["a", "b", "c"]))
    assert at.tolist() == [0, 1, 2, 2] and r.tolist() == [0, 0] and tf.tolist() == [2.0, 1.0]
    assert [(v, b.num_rows) for v, b in L.by_tenant(batch, "co")] == [("x", 2)]
