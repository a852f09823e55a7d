"""Exact base scores by brute force, the filter's one-sided error, rounds, held-out gain, odd rows."""
import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import bloom_lm, queries


def brute(rows):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    c = collections.Counter(w for d, t in rows if not held(d) for w in words(t))
    n, v = sum(c.values()), len(c)
    return [(d, held(d), len(words(t)), sum(c[w] > 0 for w in words(t)), n,
             sum(math.log10((c[w] + .1) / (n + .1 * (v + 1))) for w in words(t))) for d, t in rows]


def corpus():
    rnd = random.Random(2)
    vocab = [f"W{i}" for i in range(300)]
    rows = [(i, " ".join(vocab[min(299, int(rnd.expovariate(.02)))] for _ in range(rnd.randint(0, 200)))) for i in range(300)]
    return rows + [(400, None), (401, ""), (402, " \t\x0b\n"), (403, "É é\x1c x"), (None, "w1 w2"), (5, "w1 w2"), (5, "w1 w2"), (404, "q" * 100_000 + " w1 " * 30_000)]


@pytest.mark.parametrize("block,bytes_", [(1_000_000, 1 << 27), (700, 64)])
def test_base_score_and_rounds(spark, block, bytes_):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "c", 1) for d, t in rows], "doc_id long, text string, held string, block int")
    got = [tuple(r) for r in bloom_lm.score(df, queries.remainder("doc_id", 10) == 0, block_tokens=block, round_bytes=bytes_).collect()]
    key = lambda r: (repr(r[0]), r[2], r[3], r[5])
    for a, b in zip(sorted(got, key=key), sorted(brute(rows), key=key), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and math.isfinite(a[6]) and a[6] < 0


def test_blocks_and_rounds_do_not_change_scores(spark):
    df = spark.createDataFrame([r for r in corpus() if r[0] not in (5, None)], "doc_id long, text string")
    held = queries.remainder("doc_id", 10) == 0
    one = {r["doc_id"]: r["score"] for r in bloom_lm.score(df, held).collect()}
    two = {r["doc_id"]: r["score"] for r in bloom_lm.score(df, held, block_tokens=500, round_bytes=64).collect()}
    assert one.keys() == two.keys() and all(math.isclose(one[k], two[k], rel_tol=1e-9) for k in one)


def test_filter_never_reports_less():
    rng = np.random.default_rng(0)
    h, count = rng.integers(0, 1 << 48, 20_000).astype(np.uint64), rng.integers(1, 50, 20_000)
    level = bloom_lm.level_of(count)
    bits = bloom_lm.slice_bits(int(level.sum()))
    field = np.zeros(bits, bool)
    for q in range(1, level.max() + 1):
        for at in bloom_lm.positions(h[level >= q], q, bits):
            field[at] = True
    f = bloom_lm.Filter({0: np.packbits(field, bitorder="little").tobytes()}, 1)
    zero = np.zeros(len(h), np.int64)
    got = f.levels(h, zero)
    assert (got >= level).all() and (got > level).mean() < 0.06
    other = rng.integers(0, 1 << 48, 20_000).astype(np.uint64)
    assert (f.levels(other, zero) > 0).mean() < 0.06
    x = np.sort(rng.integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (bloom_lm.unpacked(bloom_lm.packed(x)) == x).all()


def test_two_grams_help_where_order_matters(spark):
    rnd = random.Random(0)
    line = lambda: " ".join(f"a{k} b{k}" for k in (rnd.randint(0, 50) for _ in range(40)))
    df = spark.createDataFrame([(i, line()) for i in range(400)], "doc_id long, text string")
    r = bloom_lm.score(df, F.col("doc_id") % 10 == 0).filter("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert r[1] > 0.75 * r[0]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bloom_lm.score(df, F.lit(False)).count() == 0
    got = bloom_lm.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(True)).first()
    assert got["train_tokens"] == 0 and got["n_known"] == 0 and math.isfinite(got["score"])
