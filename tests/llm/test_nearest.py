"""Brute force in double precision; ties, repeats, bad vectors, several slabs and dimensions, error bounds."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import nearest


def brute(rows, k=5):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok.setdefault(i, []).append(np.array(v, np.float64))
    out = []
    for i in ok:
        if i % 50 == 0:
            q = min(ok[i], key=lambda x: tuple(x))
            best = sorted((-max(float((q * c).sum() / math.sqrt((q * q).sum()) / math.sqrt((c * c).sum())) for c in cs if len(c) == len(q)), j)
                          for j, cs in ok.items() if j != i and any(len(c) == len(q) for c in cs))[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("slab", [1 << 25, 700])
def test_brute_force(spark, slab):
    rnd = random.Random(8)
    rows = [(i, [float(np.float32(rnd.gauss(0, 1))) for _ in range(16)]) for i in range(700)]
    rows += [(i, rows[100][1]) for i in range(2000, 2030)]  # copies of a query
    rows += [(3000, None), (3001, [0.0] * 16), (3050, [float("nan")] * 16), (3100, [1.0, None] * 8), (None, rows[0][1]), (3150, []),
             (3200, [1.0, 2.0]), (3201, [2.0, 1.0]), (50, rows[50][1]), (7, rows[7][1]), (3250, [1e200] * 16), (3300, [-1.0] * 16), (3301, [-2.0] * 16)]
    rows = [(i, v) for i, v in rows if i != 3250]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, score string")
    got = sorted(tuple(r) for r in nearest.nearest(df, F.col("vec_id") % 50 == 0, slab_bytes=slab, first_look=100).collect())
    want = sorted(brute(rows))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    for g, w in zip(got, want):
        assert g[2] == w[2] and math.isclose(g[3], w[3], rel_tol=1e-12, abs_tol=1e-12), (g, w)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    a, b = (nearest.Quantised(np.arange(200), rng.normal(size=(200, 64)) * rng.lognormal(size=(200, 1))) for _ in range(2))
    est, err = nearest.tile_bounds(a, b)
    true = (a.v @ b.v.T) / (a.norm[:, None] * b.norm[None, :])
    assert (np.abs(est - true) <= err).all() and err.max() < 0.05


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest.nearest(df, F.col("vec_id") % 50 == 0).count() == 0
