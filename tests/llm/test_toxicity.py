"""The score against the double sum over pairs, an interaction that no additive model has, held-out accuracy."""
import math
import random

import numpy as np

from dossier.llm import queries, toxicity
from dossier.llm.common import hash_limit


def test_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = toxicity.Model({}, rng.random(9) + .5, -.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    at, x = np.array([0, 2, 5, 8]), rng.random(4)
    s = x * m.scale[at]
    z = m.bias + s @ m.w[at] + sum(s[i] * s[j] * (m.v[at[i]] @ m.v[at[j]]) for i in range(4) for j in range(i + 1, 4))
    assert abs(m.score(at, x) - 1 / (1 + math.exp(-z))) < 1e-12


def test_values_count_words_and_their_beginnings():
    at, x = toxicity.Terms().terms("Stupid stupid stupidity")
    got = dict(zip(at.tolist(), x.tolist()))
    from zlib import crc32
    bucket = lambda t: crc32(t.encode()) & ((1 << toxicity.BITS) - 1)
    assert got[bucket("wstupid")] == toxicity.value(2, 3) and got[bucket("pstupi")] == toxicity.value(3, 3)
    assert len(toxicity.Terms().terms(None)[0]) == len(toxicity.Terms().terms(" .,!")[0]) == 0


def test_share_of_the_sample_never_reaches_zero():
    assert hash_limit(20_000, 10 ** 15) > 0 and hash_limit(5, 5) == (1 << 63) - 1
    assert abs(hash_limit(10, 1000) / 2 ** 63 - .01) < 1e-9


def table(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(rows)], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(i, y, 1 - y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int, quality int")
    return docs, labels


def test_learns_a_pair_that_linear_weights_miss(spark):
    """Toxic: exactly one of the two words is there. Each is as frequent in either class; the interaction decides."""
    rnd = random.Random(4)
    rows = []
    for _ in range(1200):
        a, b = rnd.random() < .5, rnd.random() < .5
        rows.append((" ".join(["zorg"] * a + ["plim"] * b + rnd.choices(["aa", "bb", "cc", "dd"], k=6)), int(a != b)))
    docs, labels = table(spark, rows)
    before = toxicity.LEAST_T
    toxicity.LEAST_T = 0.0  # neither word differs between the classes
    try:
        m = toxicity.train(docs, labels)
    finally:
        toxicity.LEAST_T = before
    p = [r["score"] for r in toxicity.score(docs, m).orderBy("doc_id").collect()]
    assert sum((s >= .5) == y for s, (_, y) in zip(p, rows)) > .95 * len(rows)
    linear = toxicity.Model(m.columns, m.scale, m.bias, m.w, np.zeros_like(m.v))
    t = toxicity.Terms(m.columns)
    assert sum((linear.score(*t.terms(x)) >= .5) == y for x, y in rows) < .8 * len(rows)


def test_no_labels_one_class_nulls_repeats_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", None), (1, "a b", None), (None, None, 3), (2, "", None)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, none)).collect()
    assert len(got) == 4 and {r["score"] for r in got} == {.5}
    only = toxicity.train(docs, spark.createDataFrame([(1, 0), (1, 0), (2, None), (None, 1)], "doc_id long, toxic int"))
    assert all(r["score"] < .5 for r in toxicity.score(docs, only).collect())
    assert toxicity.score(docs.limit(0), only).count() == 0


def test_scores_follow_the_rate_in_very_long_texts(spark):
    rnd = random.Random(5)
    words = [f"q{i}x" for i in range(80)]
    rows = [(" ".join(rnd.choices(words, k=100) + ["gronk"] * (3 * y)), y) for y in (0, 0, 0, 1) for _ in range(150)]
    m = toxicity.train(*table(spark, rows))
    t = toxicity.Terms(m.columns)
    long = rnd.choices(words, k=200_000)
    assert m.score(*t.terms(" ".join(long))) < .3 < m.score(*t.terms(" ".join(long + ["gronk"] * 6_000)))


def test_held_out_accuracy_on_the_given_table(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = queries.QUERIES["op12_toxicity"](spark, sf).collect()
    assert len(rows) == docs and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= .3) for r in rows)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    hit = sum(p and y for p, y in held)
    assert hit / sum(p for p, _ in held) > .95 and hit / sum(y for _, y in held) > .88
