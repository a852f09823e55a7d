"""Every occurrence that plain dynamic programming finds is found; clean texts stay clean; odd rows."""
import random

import pytest

from dossier.llm import decontaminate as dc


def least(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for ch in text:
        prev, row = row, [0]
        for i, p in enumerate(pattern, 1):
            row.append(min(prev[i - 1] + (p != ch), prev[i] + 1, row[i - 1] + 1))
        best = min(best, row[-1])
    return best


def edited(rnd, s, n):
    s = list(s)
    for _ in range(n):
        i = rnd.randrange(len(s))
        op = rnd.randrange(3)
        if op == 0:
            s[i] = rnd.choice("abc xyz")
        elif op == 1:
            s.insert(i, rnd.choice("abc xyz"))
        elif len(s) > 1:
            del s[i]
    return "".join(s)


def test_myers():
    rnd = random.Random(0)
    for _ in range(200):
        p, t = ("".join(rnd.choice("ab c") for _ in range(rnd.randint(1, n))) for n in (90, 120))
        assert dc.myers(dc.masks(p), len(p), t)[0] == least(p, t)


@pytest.mark.parametrize("slab", [4_000_000, 300])
def test_brute_force(spark, slab):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rnd.randint(8, 30)).capitalize() + ".") for i in range(12)]
    docs = []
    for i in range(150):
        t = prose(rnd.randint(0, 60))
        if i % 2:
            k, s = rnd.choice(items)
            t += rnd.choice([" ", "\n\n", ""]) + edited(rnd, s, rnd.randint(0, 2 + len(s) // 8)).replace(" ", rnd.choice([" ", "  ", "\n"])) + " " + prose(5)
        docs.append((i, t))
    docs += [(900, None), (901, ""), (902, " \n"), (903, items[0][1]), (903, items[0][1]), (None, items[1][1]), (904, "İ " + items[2][1].upper()),
             (905, prose(40_000) + items[3][1])]
    tests = items + [(50, None), (51, ""), (52, " "), (53, items[5][1]), (None, items[6][1])]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item_id string, start int")
    b = spark.createDataFrame([(i, t, "x") for i, t in tests], "item_id long, text string, doc_id string")
    got = dc.contaminated(d, b, slab_chars=slab).collect()
    want = {(i, k) for i, t in docs for k, s in tests if t and s and dc.normal(s)
            and len(t) < 5000 and least(dc.normal(s), dc.normal(t)) <= int(len(dc.normal(s)) * dc.RATE)}
    assert {(r["doc_id"], r["item_id"]) for r in got if r["doc_id"] != 905} == want
    assert any(r["doc_id"] == 905 and r["item_id"] == 3 for r in got)
    assert sum(r["doc_id"] == 903 and r["item_id"] == 0 for r in got) == 2
    texts, its = dict(docs), dict(tests)
    for r in got:
        if r["doc_id"] not in (904, None):
            s = dc.normal(texts[r["doc_id"]][r["start"]:r["end"]])
            assert abs(len(s) - len(dc.normal(its[r["item_id"]]))) <= r["distance"] + 1
    assert dc.contaminated(d.limit(0), b).count() == 0 and dc.contaminated(d, b.limit(0)).count() == 0
