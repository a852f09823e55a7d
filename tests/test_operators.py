"""Operators against brute force on small fixtures."""
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from dossier.operators import bounds as B, chunking as C, classify as CL, evaluation as E, extraction as X, joins as J, ranking as R, select as S
from dossier.sources import files as FI, pages as P, records as RC, sinks as SK


@pytest.mark.parametrize("n,want", [(0, 0), (1, 1), (80, 1), (81, 1), (400, 1), (401, 2), (720, 2), (721, 3)])
def test_word_windows(spark, n, want):
    got = spark.range(1).select(C.word_windows(F.lit(" ".join(f"w{i}" for i in range(n)))).alias("w")).first()["w"]
    assert len(got) == want
    if want > 1:
        assert got[0].split()[-80:] == got[1].split()[:80]
        assert got[-1].split()[-1] == f"w{n - 1}"


@pytest.mark.parametrize("n", [0, 1, 900, 901, 1650, 1651, 5000])
def test_char_windows_cover_text(spark, n):
    t = "".join(random.Random(n).choice("abcdefg") for _ in range(n))
    got = spark.range(1).select(C.char_windows(F.lit(t)).alias("w")).first()["w"]
    want, i = [], 0
    while i < n:
        want.append(t[i:i + 900])
        if i + 900 >= n:
            break
        i += 750
    assert [w["text"] for w in got] == want


def test_char_windows_keep_ids_over_blanks(spark):
    got = spark.range(1).select(C.char_windows(F.lit("a" * 4 + " " * 8 + "b" * 4), 4, 0).alias("w")).first()["w"]
    assert [(w["pos"], w["text"]) for w in got] == [(0, "aaaa"), (3, "bbbb")]


def test_markdown_and_tables(spark):
    t = "intro\n# One\nbody\n## Two\nmore"
    s = spark.range(1).select(C.markdown_sections(F.lit(t)).alias("s")).first()["s"]
    assert [(x["title"], x["body"]) for x in s] == [("root", "intro"), ("One", "body"), ("Two", "more")]
    md = "x\n| m | 2023 | 2024 | unit |\n|---|---|---|---|\n| Scope 1 | 1,000 | not disclosed | t |\n| only |\n"
    u = spark.createDataFrame([(1, md)], "id int, text string")
    rows = X.table_candidates(u, ["id"], "text").collect()
    assert [(r.label, r.value, r.year, r.unit) for r in rows] == [("Scope 1", "1,000", 2023, "t")]
    flat = spark.createDataFrame([(1, "| a | b |\n|--|--|\n| k | 5 |")], "id int, text string")
    assert [(r.label, r.value, r.year) for r in X.table_candidates(flat, ["id"], "text").collect()] == [("k", "5", None)]


def okapi(corpus, query):
    toks = [re.findall("[a-z0-9]+", c.lower()) for c in corpus]
    n, avg = len(toks), sum(map(len, toks)) / len(toks)
    df = {}
    for t in toks:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - d + .5) - math.log(d + .5) for w, d in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: (0.25 * mean if v < 0 else v) for w, v in idf.items()}
    out = []
    for t in toks:
        s = 0.0
        for q in re.findall("[a-z0-9]+", query.lower()):
            f = t.count(q)
            s += idf.get(q, 0) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(t) / avg)) if f else 0
        out.append(s)
    return out


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "the", "of"]
    return [" ".join(rnd.choice(words) if rnd.random() < .8 else "the" for _ in range(rnd.randint(3, 30))) for _ in range(60)] + ["", "only once"]


@pytest.mark.parametrize("cells", [16_000_000, 0])
def test_bm25_against_brute_force(spark, texts, cells):
    ck = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    qs = {1: "alpha alpha the", 2: "only zeta", 3: "absent words"}
    q = spark.createDataFrame(list(qs.items()), "query_id long, text string")
    got = R.lexical_topk(ck, q, ["id"], 4, max_cells=cells).collect()
    for qid, text in qs.items():
        want = okapi(texts, text)
        order = sorted((i for i in range(len(texts)) if set(text.split()) & set(texts[i].split())), key=lambda i: (-round(want[i], 9), i))[:4]
        mine = sorted((r for r in got if r.query_id == qid), key=lambda r: r["rank"])
        assert [r.id for r in mine] == order
        assert [r.bm25 for r in mine] == pytest.approx([want[i] for i in order])


def test_bm25_tenants_do_not_mix(spark, texts):
    rows = [(i, "a" if i % 2 else "b", t) for i, t in enumerate(texts)]
    ck = spark.createDataFrame(rows, "id long, co string, text string")
    q = spark.createDataFrame([(1, "a", "alpha zeta"), (2, "b", "alpha zeta")], "query_id long, co string, text string")
    for cells in (16_000_000, 0):
        got = R.lexical_topk(ck, q, ["id"], 5, tenant="co", max_cells=cells).collect()
        for qid, co in ((1, "a"), (2, "b")):
            own = [(i, t) for i, c, t in rows if c == co]
            want = okapi([t for _, t in own], "alpha zeta")
            best = sorted(zip([i for i, _ in own], want), key=lambda x: (-round(x[1], 9), x[0]))
            best = [i for i, s in best if set("alpha zeta".split()) & set(texts[i].split())][:5]
            assert [r.id for r in sorted((r for r in got if r.query_id == qid), key=lambda r: r["rank"])] == best


def test_dense_paths_agree(spark):
    rnd = np.random.default_rng(1)
    v = rnd.normal(size=(200, 8))
    v[7] = v[3]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, e array<double>")
    q = df.filter("id < 20").select(F.col("id").alias("qid"), F.col("e").alias("qe"))
    a = R.dense_topk(df, q, "id", "e", "qid", "qe", 6)
    b = R.dense_topk(df, q, "id", "e", "qid", "qe", 6, rows_per_cell=30, max_query_floats=64)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = u @ u[:20].T
    for got in (a, b):
        rows = {(r.qid, r["rank"]): r.id for r in got.collect()}
        for j in range(20):
            want = sorted(range(200), key=lambda i: (-round(sims[i, j], 9), i))[:6]
            assert [rows[(j, k + 1)] for k in range(6)] == want


def test_min_max_flat_list_is_one(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 5.0), (3, 0.0), (3, 4.0)], "q int, s double")
    got = sorted((r.q, r.n) for r in df.select("q", R.min_max(F.col("s"), "q").alias("n")).collect())
    assert got == [(1, 1.0), (1, 1.0), (2, 1.0), (3, 0.0), (3, 1.0)]


def test_filter_or_all(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c")], "q int, s string")
    got = sorted(tuple(r) for r in R.filter_or_all(df, "q", F.col("s") == "a").collect())
    assert got == [(1, "a"), (2, "b"), (2, "c")]


def test_numbering_and_fill_in_pieces(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"), F.when(F.col("id") % 97 == 0, F.col("id")).alias("v"))
    w = Window.partitionBy("k").orderBy("o")
    want = {tuple(r) for r in df.select("k", "o", F.row_number().over(w), F.last("v", True).over(w)).collect()}
    n = B.number_rows(df, ["k"], [F.col("o")], F.col("o"), "rn", target_rows=50).select("k", "o", "rn")
    f = B.forward_fill(df, ["k"], F.col("o"), ["v"], target_rows=50).select("k", "o", F.col("v").alias("f"))
    assert {tuple(r) for r in n.join(f, ["k", "o"]).select("k", "o", "rn", "f").collect()} == want


def test_salted_join_equals_join(spark):
    big = spark.range(500).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 5).alias("k"), F.col("id").alias("i"))
    small = spark.createDataFrame([(0, "z"), (1, "a"), (9, "n")], "k long, v string")
    for how in ("inner", "left"):
        a = {tuple(r) for r in B.salted_join(big, small, ["k"], F.col("i"), how, threshold=100, salts=7).select("k", "i", "v").collect()}
        assert a == {tuple(r) for r in big.join(small, "k", how).select("k", "i", "v").collect()}


@pytest.mark.parametrize("seed,n", [(1, 3), (2, 6), (3, 40)])
def test_covering_equals_greedy_walk(spark, seed, n):
    rnd = random.Random(seed)
    rows = [(i, "c", rnd.sample("abcdefg", rnd.randint(0, 3)), rnd.random() < .3, rnd.randint(0, 5)) for i in range(40)]
    order = sorted(rows, key=lambda r: (-r[4], r[0]))
    chosen, claimed = [], set()
    def walk(pool, shared):
        for r in pool:
            if len(chosen) < n and r not in chosen and (not r[2] or set(r[2]) - claimed or shared):
                claimed.update(r[2])
                chosen.append(r)
    walk([r for r in order if r[3]], False)
    walk(order, False)
    walk(order, True)
    df = spark.createDataFrame(rows, "id long, g string, tags array<string>, p boolean, s int")
    got = {r.id for r in S.covering(df, "g", "tags", F.col("p"), "s", "id", n).collect()}
    assert got == {r[0] for r in chosen}


def test_containment_join_brute_force(spark):
    docs = [(1, "xx alpha beta gamma delta yy"), (2, "prealpha beta gammapost"), (3, "nothing here"), (4, "ab cd")]
    needles = [(10, "alpha beta gamma"), (11, "beta gamma delta"), (12, "ab cd"), (13, "a beta g"), (14, "b"), (15, "ab"), (16, "d "), (17, "zz")]
    docs += [(5, "b"), (6, ""), (7, "ab")]
    got = {tuple(r) for r in J.containment_join(spark.createDataFrame(docs, "d int, t string"), spark.createDataFrame(needles, "n int, t string"),
                                                "d", "t", "n", "t").collect()}
    assert got == {(d, n) for d, t in docs for n, s in needles if s in t}


def test_resolution_join_last_wins_and_fallback(spark):
    l = spark.createDataFrame([("q1", "k1", "old", 1), ("q1", "k1", "new", 2), (None, "k2", "x", 3)], "qid string, bk string, v string, o int")
    r = spark.createDataFrame([("q1", "k1", "R1", 1), (None, "k2", "R2", 2), (None, "k3", "R3", 3)], "qid string, bk string, w string, p int")
    got = {(x.qid, x.bk, x.v, x.w, x.join_type) for x in J.resolution_join(l, r, "qid", "bk", F.col("o"), F.col("p")).collect()}
    assert got == {("q1", "k1", "new", "R1", "question_id"), (None, "k2", "x", "R2", "business_key"), (None, "k3", None, "R3", "business_key")}


def test_citation_rank_one_and_compat(spark):
    h = spark.createDataFrame([(1, 1, None), (1, 2, "package"), (2, 1, "exact_record")], "q int, rank int, m string")
    q = spark.createDataFrame([(1,), (2,), (3,)], "q int")
    f = {r.q: (r.retrieval_hit, r.citation_correct, r.retrieval_code) for r in E.retrieval_flags(h, q, "q", "m").collect()}
    assert f == {1: (True, False, None), 2: (True, True, None), 3: (False, False, "retrieval_no_evidence")}
    assert {r.q: r.citation_correct for r in E.retrieval_flags(h, q, "q", "m", True).collect()}[1]


@pytest.mark.parametrize("n", [1, 2, 19, 20, 21, 100])
def test_p95_lower(spark, n):
    vals = [float(random.Random(n * 7 + i).randint(0, 30)) for i in range(n)]
    df = spark.createDataFrame([("k", v) for v in vals], "k string, v double")
    got = E.lower_nearest_rank(df, ["k"], "v").first()["p_value"]
    assert got == sorted(vals)[max(1, int(.95 * n)) - 1]


def test_rates_of_no_rows(spark):
    e = spark.createDataFrame([], "x boolean")
    r = E.rates(e, {"rate": F.col("x")}).first()
    assert (r.n, r.rate) == (0, 0.0)


def test_pages_xml_and_files(spark, tmp_path):
    html = "<h1>T</h1><p>hello world, this is a longer paragraph of text</p><table><tr><th>a</th><td>1</td></tr></table>"
    b = P.html_blocks(spark.createDataFrame([(1, html), (2, "<p>x</p>")], "id int, h string"), "id", "h").orderBy("id", "pos").collect()
    assert [(r.kind, r.text) for r in b] == [("heading", "## T"), ("text", "[T] hello world, this is a longer paragraph of text"), ("row", "a | 1"), ("plain", "x")]
    x = spark.range(1).select(FI.xml_to_text(F.lit('<r xmlns="u"><a k="v">text</a>tail</r>')).alias("x")).first()["x"]
    assert x == "a (k=v): text\ntail"
    assert spark.range(1).select(FI.xml_to_text(F.lit("<broken")).alias("x")).first()["x"] == "<broken"
    (tmp_path / "sub").mkdir()
    for name, body in (("a.md", "# hi"), ("README.md", "no"), ("sub/b.json", '[1, {"x": 2}]'), ("c.exe", "z")):
        (tmp_path / name).write_text(body)
    l = FI.list_files(spark, str(tmp_path))
    assert sorted(r.rel for r in FI.corpus_files(l).collect()) == ["a.md", "sub/b.json"]
    assert FI.read_json_documents(spark, str(tmp_path / "sub")).first()["text"] == '[1, {"x":2}]'
    n = SK.write_jsonl(spark.createDataFrame([("é",)], "t string"), str(tmp_path / "out"))
    assert n == 1 and spark.read.json(str(tmp_path / "out")).first()["t"] == "é"


def test_label_lines_leave_total_out(spark):
    ln = F.array(*[F.lit(x) for x in ("Division A", "10", "1,200", "Total", "10", "1,200", "Division B", "5")])
    got = spark.range(1).select(C.label_line_groups(ln, "^(Division|Total)", "^Total").alias("r")).first()["r"]
    assert [(r["label"], r["vals"]) for r in got] == [("Division A", ["10", "1,200"]), ("Division B", ["5"])]


def test_workbook_header_must_match(spark):
    with pytest.raises(ValueError):
        RC.check_header(spark.createDataFrame([(1, 2)], "a int, c int"), ["a", "b"])


def test_generation_is_optional(spark):
    df = spark.createDataFrame([("c", "q", None), ("c", "q", "no_items")], "context string, question string, abstain_reason string")
    assert [r.generated for r in R.generate_answers(df).collect()] == [None, None]
    up = F.pandas_udf(lambda c, q: c + "/" + q, "string")
    assert [r.generated for r in R.generate_answers(df, up).collect()] == ["c/q", None]


def test_pair_resolution_statuses(spark):
    rows = [("5", False, "5.0", True, .9), ("5", False, "7", True, .9), ("5", False, None, False, .1), (None, True, "7", True, .9), (None, True, None, False, .6), (None, True, None, False, .1)]
    df = spark.createDataFrame(rows, "v string, ab boolean, w string, ok boolean, conf double")
    t = F.lit(True)
    r = CL.pair_resolution(df, F.col("v"), F.col("ab"), F.lit(False), F.lit(None).cast("boolean"), F.col("w"), F.col("ok"), F.col("conf"), t, t, t).collect()
    assert [x.status for x in r] == ["MATCH_CONFIRMED", "CONFLICT_REVIEW_REQUIRED", "BACKFILL_FROM_DATASET", "BACKFILL_FROM_INTERNAL", "INSUFFICIENT_EVIDENCE", "NO_ANSWER_FOUND"]
