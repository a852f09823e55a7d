"""Brute force over all pairs, the bucket limit, nulls, empty tables, clashing columns."""
import random

import pytest
import xxhash

from dossier.llm import simhash


def brute_fp(text, words=3):
    import re
    t = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(t[i:i + words]) for i in range(len(t) - words + 1)] if len(t) >= words else ([" ".join(t)] if t else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def brute_components(rows, radius=3):
    fps = [brute_fp(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    low = {}
    for (d, _), c in zip(rows, comp):
        low[c] = min([x for x in (low.get(c), d) if x is not None], default=None)
    return sorted([(d, f"{f:016x}", low[c]) for (d, _), f, c in zip(rows, fps, comp)], key=repr)


def corpus():
    rnd = random.Random(5)
    words = ["Al", "be", "CE", "do", "eñ", "fo", "gu", "hi"]
    rows = []
    for g in range(12):
        base = [rnd.choice(words) + str(rnd.randint(0, 40)) for _ in range(120)]
        for k in range(6):
            t = list(base)
            for _ in range(k):
                t[rnd.randrange(120)] = "x"
            rows.append((len(rows), " ".join(t)))
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "one"), (504, "one TWO"), (505, "one two"), (None, "one two"),
             (506, "w " * 30000), (507, rows[0][1]), (507, rows[0][1])]
    return rows


@pytest.mark.parametrize("limit", [4096, 3])
def test_matches_brute_force(spark, limit):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "clash", "clash") for d, t in rows], "doc_id long, text string, fingerprint string, _fp string")
    got = [tuple(r) for r in simhash.near_duplicates(df, limit=limit).collect()]
    assert sorted(got, key=repr) == brute_components(rows)


def test_every_pair_within_radius_collides():
    masks = simhash.table_masks(3)
    rnd = random.Random(1)
    for _ in range(2000):
        x = rnd.getrandbits(64)
        y = x
        for i in rnd.sample(range(64), rnd.randint(0, 3)):
            y ^= 1 << i
        assert any((x ^ y) & m & (2 ** 64 - 1) == 0 for m in masks)


def test_chain_in_one_large_bucket(spark):
    fps = [(i, sum(1 << (15 * j) for j in range(4)) * 0 + ((1 << i) - 1)) for i in range(40)]
    df = spark.createDataFrame(fps, "doc_id long, fp long")
    for limit in (4096, 4):
        got = {r["component"] for r in simhash.groups(df, limit=limit).collect()}
        assert got == {0}


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
