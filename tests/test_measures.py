"""Merged measures against the rows: ranks within the error, any cut of the rows, odd values."""
import random

import pytest

from dossier.operators import measures as MS

SCHEMA = "day int, company string, value double, who long, n string"


def rank_of(values, x):
    return sum(v < x for v in values) / len(values), sum(v <= x for v in values) / len(values)


def test_merged_is_direct(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(1, 20), rnd.choice(["a", "b", None]), round(rnd.lognormvariate(3, 1), 2), rnd.randint(0, 900), "x") for _ in range(20_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    days = MS.measure(df.filter("day <= 10"), ["day", "company"], "value", "who")
    later = MS.measure(df.filter("day > 10"), ["day", "company"], "value", "who")
    show = ["company", "n_rows", "n", "least", "most", MS.mean().alias("mean"), MS.quantile(.5).alias("p50"), MS.quantile(.95).alias("p95"), MS.distinct().alias("who")]
    got = {r["company"]: r for r in MS.roll_up(days.union(later), ["company"]).select(*show).collect()}
    direct = {r["company"]: r for r in MS.measure(df, ["company"], "value", "who").select(*show).collect()}
    assert got.keys() == direct.keys() == {"a", "b", None}
    for c, r in got.items():
        values = [v for _, k, v, _, _ in rows if k == c]
        for x in (r, direct[c]):
            assert (x["n_rows"], x["n"], x["least"], x["most"]) == (len(values), len(values), min(values), max(values))
            assert x["mean"] == pytest.approx(sum(values) / len(values))
            assert x["who"] == len({w for _, k, _, w, _ in rows if k == c})  # exact below the number of entries
            for name, share in (("p50", .5), ("p95", .95)):
                below, upto = rank_of(values, x[name])
                assert below - 2 * MS.rank_error() <= share <= upto + 2 * MS.rank_error()


def test_many_identities(spark):
    df = spark.range(50_000).selectExpr("cast(id % 7 as int) day", "'a' company", "cast(id as double) value", "id as who", "'x' n")
    got = MS.roll_up(MS.measure(df, ["day"], "value", "who"), []).select(MS.distinct()).first()[0]
    assert abs(got - 50_000) <= 50_000 * MS.distinct_error()


def test_odd_rows(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1, "a", None, None, "x"), (1, "a", float("nan"), 1, "x"), (1, "a", inf, 1, "x"), (2, "a", 5.0, 2, None),
                                (2, "a", 5.0, 2, None), (None, None, -inf, None, None)], SCHEMA)
    m = MS.measure(df, ["day"], "value", "who")
    read = lambda x: x.select("n_rows", "n", "total", MS.quantile(.5), MS.distinct())
    got = {r[0]: tuple(r)[1:] for r in m.select("day", "n_rows", "n", "total", MS.quantile(.5), MS.distinct()).collect()}
    assert got == {1: (3, 0, None, None, 1), 2: (2, 2, 10.0, 5.0, 1), None: (1, 0, None, None, 0)}
    assert tuple(read(MS.roll_up(m, [])).first()) == (6, 2, 10.0, 5.0, 2)
    empty = MS.measure(df.limit(0), ["day"], "value", "who")
    assert empty.count() == 0 and tuple(read(MS.roll_up(empty, [])).first()) == (0, 0, None, None, 0)
    assert tuple(read(MS.measure(df.limit(0), [], "value", "who")).first()) == (0, 0, None, None, 0)
