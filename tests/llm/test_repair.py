"""Costs and audits against trying all edits, blocks against whole conversations, the SQL twin on odd rows."""
import hashlib
import itertools
import random
import re

import duckdb
import pandas as pd

from dossier.llm import queries, repair
from dossier.operators.bounds import join_null_safe


def brute(codes):
    """All ways: per row keep, either role or delete, up to two inserted rows at every place."""
    inserts = ["", "u", "a", "uu", "ua", "au", "aa"]
    best = None
    per_row = []
    for c in codes:
        ways = [("D", "", 4)]
        if c != "-":
            extra = 3 if c.isupper() else 0
            ways += [("K", c.lower(), extra), ("R", "u", 3 + extra), ("R", "a", 3 + extra)]
        per_row.append(ways)
    for ways in itertools.product(*per_row):
        cost = sum(w[2] for w in ways)
        if best and cost > best[0]:
            continue
        for ins in itertools.product(inserts, repeat=len(codes) + 1):
            total = cost + 3 * sum(map(len, ins))
            if best and total > best[0]:
                continue
            out = ins[0] + "".join(w[1] + i for w, i in zip(ways, ins[1:]))
            if re.fullmatch("(s?(ua)+)?", out):
                audit = "I" * len(ins[0]) + "".join(w[0] + "I" * len(i) for w, i in zip(ways, ins[1:]))
                best = min(best or (99, ""), (total, audit))
    return best


def test_least_cost_and_audit_against_all_edits():
    rnd, known = random.Random(1), {}
    for codes in ["", "s", "S", "o", "-", *["".join(rnd.choices("suaoSUAO-", k=rnd.randint(1, 4))) for _ in range(120)]]:
        assert repair.cheapest(repair.parse(codes, known)) == brute(codes), codes


def test_any_split_gives_the_same_cells():
    rnd = random.Random(2)
    for _ in range(30):
        codes = "".join(rnd.choices("suaoSUAO-", k=12))
        leaves = [repair.terminal(c) for c in codes]
        chart = {(i, i + 1): x for i, x in enumerate(leaves)}
        for n in range(2, 13):  # every split of every span
            for i in range(13 - n):
                made = [repair.combine(chart[i, k], chart[k, i + n]) for k in range(i + 1, i + n)]
                assert all(m == made[0] for m in made)
                chart[i, i + n] = made[0]
        assert repair.parse(codes, {}) == chart[0, 12]


def talk(rnd, n):
    texts = ["Hello.", "Why?", "no end", "", " ", "Same.", "Same.", None, "Go! \n", "x" * 30 + "."]
    return [(t if rnd.random() > .1 else None, rnd.choice(["system", "user", "assistant", "tool", None, ""]), rnd.choice(texts) if rnd.random() < .4 else f"Text {t}.")
            for t in sorted(rnd.sample(range(3 * n), n))]


def reference(rows):
    """Plain Python over one conversation."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), hashlib.sha256(f"{len(v[1])}:{v[1]}{v[2]}".encode()).digest()))
    seen, codes, n = set(), "", dict.fromkeys(repair.COUNTS, 0)
    for _, r, x in rows:
        body = x.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((r, x))
        if fault:
            n[fault] += 1
        c = r[:1] if r[:1] and r[:1] in "sua" else "o"
        codes += "-" if fault in ("blank", "duplicate") else c.upper() if fault else c
    n["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = repair.cheapest(repair.parse(codes, {}))
    lines = [f"{r}:{x}" for r, x in repair.repaired(audit, ((r, x) for _, r, x in rows))]
    turns = [t for t, *_ in rows if t is not None]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *n.values(), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), lines


def test_blocks_ties_nulls_and_repaired_rows(spark):
    rnd = random.Random(3)
    talks = {c: talk(rnd, n) for c, n in [(1, 1), (2, 7), (3, 40), (None, 90), (5, 3)]}
    talks[5] = [(None, "user", "a."), (None, "user", "a."), (None, "user", "b."), (7, "user", "a.")]
    rows = spark.createDataFrame([(c, *r, 0) for c, rs in talks.items() for r in rs], "conv_id long, turn long, role string, text string, i int").repartition(5)
    ids = spark.createDataFrame([(c,) for c in [1, 2, 2, 3, None, 5, 99]], "conv_id long")
    want = {c: reference(r) for c, r in talks.items()} | {99: ((0,) * 6 + ("", hashlib.sha256(b"").hexdigest()), [])}
    for block, fan, piece in ((1024, 16, 1_000_000), (4, 2, 20), (1, 3, 7)):
        heads = repair.parsed(rows, ids, block=block, fan=fan, piece_rows=piece).cache()
        got = {r["conv_id"]: r for r in join_null_safe(heads, repair.summary(rows, heads), ["conv_id"]).collect()}
        assert {c: (r["gaps"], *[r[k] for k in repair.COUNTS], r["cost"], r["audit"], r["repaired_sha256"]) for c, r in got.items()} == {c: w[0] for c, w in want.items()}
        lines = {}
        for r in sorted(repair.repair(rows, heads).collect(), key=lambda r: r["place"]):
            lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
        assert lines == {c: w[1] for c, w in want.items() if w[1]}


def test_empty_table(spark):
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    heads = repair.parsed(rows)
    assert heads.count() == repair.repair(rows, heads).count() == repair.summary(rows, heads).count() == 0


def test_query_against_its_twin_on_odd_rows(spark, tmp_path):
    rnd = random.Random(6)
    table = pd.DataFrame([(c, *r) for c in [*range(60), None] for r in talk(rnd, rnd.randint(1, 9))], columns=["conv_id", "turn", "role", "text"]).astype(
        {"conv_id": "Int64", "turn": "Int64"})
    table = pd.concat([table, pd.DataFrame([(70, 1, "user", "Same é."), (70, 1, "user", "Same é."), (71, None, None, None)], columns=table.columns)]).astype({"conv_id": "Int64", "turn": "Int64"})
    table.to_parquet(tmp_path / "conversations.parquet")
    got = sorted(map(str, (tuple(r) for r in queries.QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect())))
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet'")
    assert got == sorted(map(str, con.sql(queries.ORACLES["op11_conversation_repair"]).fetchall()))
