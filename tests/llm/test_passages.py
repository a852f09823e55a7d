"""Chains against a quadratic program, planted passages with edits, hot passages, copies, odd rows."""
import random

import numpy as np
import pyarrow as pa

from dossier.llm import passages as ps


def edit(rnd, words, n):
    w = list(words)
    for _ in range(n):
        i = rnd.randrange(5, len(w) - 5)
        w[i:i + rnd.randint(0, 1)] = [f"e{rnd.randint(0, 9999)}"] * rnd.randint(0, 2)
    return w


def levenshtein(a, b):
    row = list(range(len(a) + 1))
    for x in b:
        prev, row = row, [row[0] + 1]
        for i, y in enumerate(a, 1):
            row.append(min(prev[i - 1] + (x != y), prev[i] + 1, row[i - 1] + 1))
    return row[-1]


def test_distance_and_chain_scores():
    rnd = random.Random(0)
    for _ in range(100):
        a, b = (np.array([rnd.randint(0, 4) for _ in range(rnd.randint(1, 40))], np.uint16) for _ in range(2))
        assert ps.distance(a, b) == levenshtein(a.tolist(), b.tolist())
    for _ in range(60):
        n = rnd.randint(2, 40)
        q, r = (np.array([rnd.randint(0, 120) for _ in range(n)]) for _ in range(2))
        mq, mr, mn = ps.merged(q, r)
        o = np.lexsort((mr, mq))
        mq, mr, mn = mq[o], mr[o], mn[o]
        f = []
        for j in range(len(mq)):
            f.append(mn[j] + max([0.0] + [f[i] - ps.GAP * (mq[j] - mq[i] - mn[i] + mr[j] - mr[i] - mn[i]) for i in range(j)
                                          if mq[i] + mn[i] <= mq[j] and mr[i] + mn[i] <= mr[j]]))
        best = ps.chains(q, r)[0]
        ends = {(int(mq[j] + mn[j]), int(mr[j] + mn[j])) for j in range(len(f)) if f[j] >= max(f) - 1e-9}
        assert (best[1], best[3]) in ends


def test_shared_run_shares_a_seed():
    rnd = np.random.default_rng(1)
    for _ in range(50):
        run = rnd.integers(0, 1 << 16, ps.K + ps.WINDOW - 1)
        a, b = (np.r_[rnd.integers(0, 1 << 16, 20), run, rnd.integers(0, 1 << 16, 20)].astype(np.uint16) for _ in range(2))
        assert set(ps.seeds(a)[1].tolist()) & set(ps.seeds(b)[1].tolist())


def test_planted(spark):
    rnd = random.Random(7)
    word = lambda: f"w{rnd.randint(0, 30000)}"
    prose = lambda n: [word() for _ in range(n)]
    docs, want, hot = [], [], prose(70)
    for g in range(15):
        p = prose(rnd.randint(55, 200))
        a, b = len(docs), len(docs) + 1
        docs += [" ".join(prose(rnd.randint(0, 80)) + p + prose(rnd.randint(0, 80))),
                 "\n".join(prose(rnd.randint(0, 80)) + edit(rnd, p, len(p) // 25) + prose(rnd.randint(0, 80)))]
        want.append((a, b))
    first_hot = len(docs)
    docs += [" ".join(prose(30) + hot + prose(30)) for _ in range(60)]
    short = prose(30)
    first_clean = len(docs)
    docs += [" ".join(prose(40) + short + prose(40)) for _ in range(5)] + [" ".join(prose(150)) for _ in range(20)]
    copy = docs[0]
    n = len(docs)
    rows = [(i, t) for i, t in enumerate(docs)] + [(n, copy), (n + 1, copy), (n + 1, copy), (n + 2, None), (n + 3, ""), (n + 4, "one two"),
                                                   (n + 5, "one two"), (None, docs[2]), (n + 6, "x " * 20_000),
                                                   (n + 7, " ".join(prose(33) + ["of"] * 90 + prose(20))), (n + 8, " ".join(prose(9) + ["of"] * 60 + prose(50)))]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, other int, _key string")
    got = ps.repeated(df).collect()
    pairs = {tuple(sorted((r["doc_id"], r["other"]))) for r in got if r["kind"] == "passage"}
    assert set(want) <= pairs
    assert (n + 7, n + 8) in pairs  # one word over and over
    docs += [""] * 7 + [t for d, t in rows if d is not None and d >= n + 7]
    inside = {x for p in pairs for x in p}
    assert set(range(first_hot, first_hot + 60)) <= inside
    assert not inside & set(range(first_clean, n))
    assert len([p for p in pairs if p[0] >= first_hot and p[1] < first_hot + 60]) <= 120
    copies = sorted(((r["doc_id"], r["other"]) for r in got if r["kind"] == "copy"), key=repr)
    assert copies == sorted([(n, 0), (n + 1, 0), (n + 1, 0), (None, 2)], key=repr)
    for r in got:
        if r["kind"] == "passage":
            a, b = docs[r["doc_id"]].split()[r["start"]:r["end"]], docs[r["other"]].split()[r["other_start"]:r["other_end"]]
            assert levenshtein(a, b) == r["distance"] <= .2 * max(len(a), len(b)) and max(len(a), len(b)) >= 50
    assert ps.repeated(df.limit(0)).count() == 0


def test_chain_over_unlike_text_is_cut(spark):
    rnd = random.Random(8)
    prose = lambda n: [f"w{rnd.randint(0, 30000)}" for _ in range(n)]
    docs, want = [], []
    for gap in (50, 100, 150, 200):
        p, q = prose(60), prose(60)
        docs += [prose(30) + p + prose(gap) + q + prose(30) for _ in range(2)]
        want.append([(30, 90), (90 + gap, 150 + gap)])
    p, q = prose(1000), prose(1000)
    docs += [p + prose(600) + q for _ in range(2)]
    want.append([(0, 1000), (1600, 2600)])
    short = prose(42)
    docs += [short, short[:21] + prose(8) + short[21:] + prose(100)]
    got = ps.repeated(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")).collect()
    for g, spans in enumerate(want):
        rows = [r for r in got if {r["doc_id"], r["other"]} == {2 * g, 2 * g + 1}]
        for s, e in spans:
            assert any(abs(r["start"] - s) < 8 and abs(r["end"] - e) < 8 and abs(r["other_start"] - s) < 8 for r in rows), (g, s, e, rows)
    n = 2 * len(want)
    assert any({r["doc_id"], r["other"]} == {n, n + 1} for r in got)  # 42 words against 50


def test_passages_of_common_lines(spark):
    """Every line is in many texts; only the order of the lines tells which two share a passage."""
    rnd = random.Random(9)
    prose = lambda n: [f"w{rnd.randint(0, 30000)}" for _ in range(n)]
    lines = [prose(14) for _ in range(60)]
    docs = [prose(20) + line + prose(20) for line in lines for _ in range(40)]
    want = set()
    for _ in range(40):
        order = rnd.sample(lines, 6)
        want.add((len(docs), len(docs) + 1))
        docs += [sum(([*line, *prose(1)] for line in order), prose(rnd.randint(0, 30))) + prose(rnd.randint(0, 30)) for _ in range(2)]
    order = list(range(len(docs)))
    rnd.shuffle(order)
    got = ps.repeated(spark.createDataFrame([(i, " ".join(docs[i])) for i in order], "doc_id long, text string")).collect()
    pairs = {tuple(sorted((r["doc_id"], r["other"]))) for r in got}
    assert len(want & pairs) >= .95 * len(want), len(want & pairs)
    for a, b in pairs - want:  # whatever else is named is as near
        r = next(r for r in got if {r["doc_id"], r["other"]} == {a, b})
        x, y = docs[r["doc_id"]][r["start"]:r["end"]], docs[r["other"]][r["other_start"]:r["other_end"]]
        assert levenshtein(x, y) == r["distance"] <= .2 * max(len(x), len(y))


def test_all_holders_of_a_key_meet(spark):
    """Against all pairs of holders of all seeds: whatever makes a passage is of one class where it lies."""
    rnd = random.Random(10)
    prose = lambda n: [f"w{rnd.randint(0, 30000)}" for _ in range(n)]
    lines = [prose(14) for _ in range(50)]
    docs = [prose(20) + line + prose(20) for line in lines for _ in range(30)]
    planted = []
    for _ in range(100):
        order, pair = rnd.sample(lines, 6), []
        for _ in range(2):
            body = sum(([*line, *prose(1)] for line in order), [])
            for i in rnd.sample(range(len(body)), 3):
                body[i:i + 1] = prose(1)
            pair.append(len(docs))
            docs.append(prose(rnd.randint(0, 30)) + body + prose(rnd.randint(0, 30)))
        planted.append(tuple(pair))
    rnd.shuffle(docs := list(enumerate(docs)))
    got = ps.repeated(spark.createDataFrame([(i, " ".join(d)) for i, d in docs], "doc_id long, text string")).collect()
    codes = {i: ps.word_codes(" ".join(d).encode()) for i, d in docs}
    holders = {}
    for i, c in codes.items():
        for p, h in zip(*(x.tolist() for x in ps.seeds(c))):
            holders.setdefault(h, []).append((i, p))
    matches = {}
    for at in holders.values():
        for i, p in at:
            for j, q in at:
                if i < j:
                    matches.setdefault((i, j), []).append((p, q))
    chained = [(i, j, *c[4:], 0, 0, codes[i].tobytes(), codes[j].tobytes()) for (i, j), m in matches.items() if len(m) > 1
               for c in ps.chains(*(np.array(x) for x in zip(*sorted(m)))) if min(c[1] - c[0], c[3] - c[2]) >= 22]
    batch = pa.RecordBatch.from_pydict(dict(zip(("t", "u", "qs", "rs", "ns", "qa", "ra", "qw", "rw"), map(list, zip(*chained)))))
    brute = next(ps._aligned(50, .8)(iter([batch])))
    brute = [((t, a, b), (u, x, y)) for t, u, a, b, x, y in zip(*(brute[c] for c in ("t", "u", "q0", "q1", "r0", "r1")))]
    assert len({(a[0], b[0]) for a, b in brute} & set(planted)) >= 80
    found = [((r["doc_id"], r["start"], r["end"]), (r["other"], r["other_start"], r["other_end"])) for r in got]
    root = {}

    def find(x):
        while x in root:
            x = root[x]
        return x

    def join(a, b):
        if (a := find(a)) != (b := find(b)):
            root[a] = b
    spans = {}
    for pair in found:
        for s in pair:
            spans.setdefault(s[0], set()).add(s)
        join(*pair)
    for of in spans.values():
        of = sorted(of)
        for i, a in enumerate(of):
            for b in of[i + 1:]:
                if b[1] < a[2]:
                    join(a, b)
    classes = lambda s: {find(x) for x in spans.get(s[0], ()) if x[1] < s[2] and s[1] < x[2]}
    assert [p for p in brute if not classes(p[0]) & classes(p[1])] == []


def test_cells_of_a_key_that_many_hold():
    """A key with more holders than a cell has is compared across all its cells."""
    rnd = random.Random(11)
    codes = lambda n: np.array([rnd.randint(0, 65535) for _ in range(n)], np.uint16)
    core, want = codes(28), set()
    rows = []
    for i in range(60):
        w = np.r_[codes(28), core, codes(28)]
        if i % 2:
            w[:28] = rows[-1][-1][:28]  # neighbours go on alike before the core
            want.add((i - 1, i))
        rows.append((i, 28, 50, 2 * i, 2 * i + 1, 0, w))
    cols = ("t", "pos", "pos2", "c1", "c2", "at")
    whole = ps._cell(0, *(np.array([r[k] for r in rows]) for k in range(len(cols))), [r[-1].tobytes() for r in rows], 50, .8)
    assert {(r[0], r[1]) for r in whole} == want and all(r[2:] == (0, 56, 0, 56, 0) for r in whole)
    group, met = [i * 7 % 3 for i in range(60)], set()
    cell = lambda lo, hi: [(7, lo, hi, group[i], *r[:-1], r[-1].tobytes()) for g in dict.fromkeys((lo, hi)) for i, r in enumerate(rows) if group[i] == g]
    every = [x for lo in range(3) for hi in range(lo, 3) for x in cell(lo, hi)]
    names = ("k", "lo", "hi", "g", *cols, "w")
    batches = (pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*every[i:i + 7]))))) for i in range(0, len(every), 7))
    for out in ps._compared(50, .8)(batches):
        met |= set(zip(out["t"], out["u"]))
    assert met == want


def test_reach_is_growth():
    rnd = np.random.default_rng(12)
    a, b = rnd.integers(0, 2, (2, 3000, ps.MARGIN))
    a[:1500], b[:1500] = np.where(rnd.random((1500, ps.MARGIN)) < .8, 1, a[:1500]), 1
    assert ps._reach(a == b).tolist() == [ps.grown(x, y) for x, y in zip(a, b)]
