"""Rows that must not get lost, merged or multiplied: long numbers, null keys, several tenants, small slices, hot items."""
import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from dossier import session
from dossier.functions import text as T
from dossier.operators import bounds as B, extraction as X, ranking as R, select as S


def test_ids_beyond_their_width(spark):
    got = {r["id"]: r["p"] for r in spark.createDataFrame([(7,), (9999,), (10_000,), (123_456,)], "id long").select("id", T.pad_id(F.col("id"), 4).alias("p")).collect()}
    assert got == {7: "0007", 9999: "9999", 10_000: "10000", 123_456: "123456"}
    ids = S.sequence_ids(spark.range(100_100).withColumn("k", F.lit("a")), ["k"], "id", F.col("k")).select("seq_id")
    assert ids.distinct().count() == 100_100


def test_chunk_ids_tell_documents_apart(spark):
    df = spark.createDataFrame([(1, 0, "x" * 60 + "a"), (1, 0, "x" * 60 + "b"), (2, 0, "x" * 60 + "a")], "d long, i int, t string")
    assert df.select(T.content_id(F.col("d"), F.col("i"), F.col("t")).alias("c")).distinct().count() == 3


def test_null_keys_and_order_values_stay(spark):
    rows = [(None, 1, "a"), (None, 2, None), ("k", 5, "b"), ("k", None, None), ("k", 6, None), (None, None, "z")]
    df = spark.createDataFrame(rows, "k string, o long, v string")
    n = sorted(((r["k"], r["o"], r["rn"]) for r in B.number_rows(df, ["k"], [F.col("o")], F.col("o"), "rn", target_rows=1).collect()), key=repr)
    assert n == sorted([(None, 1, 1), (None, 2, 2), (None, None, 3), ("k", 5, 1), ("k", 6, 2), ("k", None, 3)], key=repr)
    f = {(r["k"], r["o"]): r["v"] for r in B.forward_fill(df, ["k"], F.col("o"), ["v"], target_rows=1).collect()}
    assert f == {(None, 1): "a", (None, 2): "a", (None, None): "z", ("k", 5): "b", ("k", 6): "b", ("k", None): "b"}
    small = spark.createDataFrame([(None, 9), ("k", 8)], "k string, w int")
    for threshold in (1, 100):
        got = B.salted_join(df, small, ["k"], F.col("o"), threshold=threshold, salts=3)
        assert sorted(r["w"] for r in got.collect()) == [8, 8, 8, 9, 9, 9]
    kept = X.plausible(df.withColumnRenamed("k", "item"), "item", F.col("v") == "a")
    assert sorted((repr(r["item"]), repr(r["o"])) for r in kept.collect()) == sorted([("None", "1"), ("'k'", "5"), ("'k'", "None"), ("'k'", "6")])


def test_pieces_follow_the_rows(spark):
    df = spark.range(4000).select(F.lit(1).alias("k"), F.when(F.col("id") < 3900, F.col("id")).otherwise(F.col("id") * 10 ** 9).alias("o"))
    sizes = [r["count"] for r in B.order_bucket(df, F.col("o"), 100).groupBy("_b").count().collect()]
    assert len(sizes) >= 30 and max(sizes) <= 300
    w = Window.partitionBy("k").orderBy("o")
    want = {tuple(r) for r in df.select("o", F.row_number().over(w)).collect()}
    assert {(r["o"], r["rn"]) for r in B.number_rows(df, ["k"], [F.col("o")], F.col("o"), "rn", target_rows=100).collect()} == want


@pytest.mark.parametrize("cells", [16_000_000, 0])
def test_query_in_several_tenants(spark, cells):
    ck = spark.createDataFrame([(1, "apple pie", "A"), (2, "apple tart", "B"), (3, "plum", "B"), (4, "apple", None)], "id int, text string, co string")
    q = spark.createDataFrame([("q", "apple", "A"), ("q", "apple", "B"), ("r", "plum", "A"), ("n", "apple", None), ("e", "", "A")], "query_id string, text string, co string")
    got = sorted((r["query_id"], r["id"], round(r["bm25"], 9)) for r in R.lexical_topk(ck, q, ["id"], 5, tenant="co", max_cells=cells).collect())
    assert [g[:2] for g in got] == [("q", 1), ("q", 2)]
    other = sorted((r["query_id"], r["id"], round(r["bm25"], 9)) for r in R.lexical_topk(ck, q, ["id"], 5, tenant="co", max_cells=0).collect())
    assert got == other


def test_floor_rises_from_rows_held():
    c, s = np.array([0, 1, 0, 0, 1]), np.array([3.0, 9.0, 1.0, 2.0, 8.0])
    assert R._held_floor(c, s, 2, np.full(3, -np.inf)).tolist() == [2.0, 8.0, -np.inf]
    assert R._held_floor(c, s, 3, np.full(3, -np.inf)).tolist() == [1.0, -np.inf, -np.inf]
    assert R._held_floor(c[:0], s[:0], 3, np.full(1, -np.inf)).tolist() == [-np.inf]


def test_hot_item_resolves_like_any(spark):
    rows = [("hot", f"d{i % 50}", str(100 + i % 3), 2020 + i % 2, float(i % 7), i % 11 == 0, i) for i in range(2000)]
    rows += [(None, "d1", "5", 2020, 1.0, True, 1), ("cold", "d1", "not disclosed", 2024, 9.0, True, 2), ("cold", "d2", "7", None, 1.0, False, 3)]
    df = spark.createDataFrame(rows, "item string, doc string, value string, year int, score double, prim boolean, ord int")
    got = {r["item"]: r for r in X.resolve(df, "item", "doc", "value", "year", "score", F.col("prim"), "ord").collect()}
    assert set(got) == {"hot", None, "cold"}
    now = [r for r in rows if r[0] == "hot" and r[3] == 2021]
    best = min(now, key=lambda r: (not r[5], -r[4], r[6]))
    assert (got["hot"]["resolved_value"], got["hot"]["resolved_doc"], got["hot"]["n_docs"]) == (best[2], best[1], len({r[1] for r in now}))
    assert (got["cold"]["resolved_value"], got[None]["resolved_value"]) == ("7", "5")


def test_no_local_folder_off_local_mode(spark, monkeypatch):
    class Far:
        class sparkContext:  # noqa: N801
            master = "yarn"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Far)


def test_replayed_stream_adds_nothing(spark, sf, tmp_path):
    from dossier import streaming as ST
    from dossier.plans.streams import stream_of
    s = ST.chunk_chars(stream_of(spark, sf, "documents").select("doc_id", "text")).withColumn(
        "chunk_key", T.content_id(F.col("doc_id"), F.col("chunk_id"), F.col("text")))
    out = str(tmp_path / "out")
    n = [ST.run_once(spark, s, out, str(tmp_path / f"ck{i}"), batch=ST.merge_batch(out)).count() for i in range(2)]
    assert n[0] == n[1] > 0


def test_index_gives_the_rows_of_the_corpus(spark, tmp_path):
    ck = spark.createDataFrame([(i, f"w{i % 7} w{i % 3} common", "AB"[i % 2], float(i % 5)) for i in range(60)], "id int, text string, co string, b double")
    q = spark.createDataFrame([("q", "w1 w2", "A"), ("q", "w1", "B"), ("r", "common nothing", "B")], "query_id string, text string, co string")
    R.build_index(ck, ["id"], str(tmp_path), tenant="co", keep=["b"])
    ix = R.load_index(spark, str(tmp_path))
    rows = lambda d: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in d.collect())
    want = rows(R.lexical_topk(ck, q, ["id"], 4, boost="b", tenant="co"))
    assert want == rows(R.lexical_topk(ix, q, ["id"], 4, boost="b", tenant="co")) == rows(R.lexical_topk(ix, q, ["id"], 4, boost="b", tenant="co", max_cells=0))


def test_ingest_and_answer(spark, tmp_path):
    from dossier.retrieval import answer, ingest
    docs = spark.createDataFrame([(1, "Apples grow on trees in May. Apples ripen in autumn here.", "s1", 2020), (2, "Apples are sold. Nothing else on apples.", "s2", 2021),
                                  (3, "Stones.", "s3", 2021)], "doc_id long, text string, source string, year int")
    q = spark.createDataFrame([(1, "where do apples grow", 2021), (2, "apples ripen", 1999), (3, "unheard", 2020)], "query_id long, text string, want int")
    ix = ingest(docs, str(tmp_path), keep=("source", "year"))
    got = {r["query_id"]: r for r in answer(q, ix, keep=F.col("year") == F.col("want")).collect()}
    assert [e["source"] for e in got[1]["evidence"]] == ["s2"]  # the filter holds
    assert {e["source"] for e in got[2]["evidence"]} == {"s1", "s2"}  # none fits: all stay
    assert got[3]["insufficient"] and got[3]["confidence"] == "low"


def test_units_without_tags_and_keys_stay(spark):
    a = spark.createDataFrame([(1, ["x"]), (2, []), (3, None), (None, ["n", "n"]), (None, None)], "u long, tags array<string>")
    b = spark.createDataFrame([(1, ["b", "x"]), (2, [None])], "u long, tags array<string>")
    got = sorted(((r["u"] or 0, r["tags"]) for r in S.merge_tagged([a, b], "u", "tags").collect()), key=str)
    assert got == [(0, ['n']), (0, []), (1, ['b', 'x']), (2, []), (3, [])]
    more = S.merge_tagged([a.withColumn("v", F.col("u") * 2)], "u", "tags").collect()
    assert sorted(r["v"] for r in more if r["v"]) == [2, 4, 6] and more[0].__fields__ == ["u", "tags", "v"]


def test_facts_under_questions_with_one_opening_stay(spark):
    head = "the same long opening of two questions that differ after it, "
    d = spark.createDataFrame([(1, head + "a", "f", 1), (2, head + "b", "f", 1), (3, head + "b", "f", 2)], "i long, q string, f string, r long")
    assert sorted(r["i"] for r in S.dedupe_distinct_facts(d, "q", "f", "r", "i").collect()) == [1, 3]


def test_hundred_thousand_matches_in_one_text(spark):
    from dossier.functions.text import occurrences
    import time
    d = spark.createDataFrame([("key value é " * 100_000,), (None,), ("none",)], "t string")
    t0 = time.time()
    got = d.select(occurrences(F.col("t"), "key", 4).alias("o")).select(F.size("o").alias("n"), F.get("o", F.lit(1)).alias("e")).collect()
    assert [r["n"] for r in got] == [100_000, 0, 0] and got[0]["e"]["snippet"] == "e é key val" and time.time() - t0 < 20


def test_page_blocks(spark):
    from dossier.sources import pages as P
    page = ("<!-- <h1>no</h1> --><script>var a = '<h2>x</h2>';</script>lead &amp; text<h2 class='header'>Head <b>one</b></h2>under it is a paragraph"
            "<table><tr><th>a</th><td>1 &lt; 2</td></tr><tr></tr></table>after<h3> </h3>still under one")
    d = spark.createDataFrame([(1, page), (None, None), (3, ""), (4, "<p>short</p>"), (5, "x \x01h broken <td> <h1> open" + "y" * 40)], "k long, pos string").repartition(3)
    got = {}
    for r in P.html_blocks(d, "k", "pos").collect():
        got.setdefault(r["k"], []).append((r["pos"], r["kind"], r["heading"], r["text"]))
    assert sorted(got[1]) == [(0, "text", "", "lead & text"), (1, "heading", "Head one", "## Head one"), (2, "text", "Head one", "[Head one] under it is a paragraph"),
                              (3, "row", "Head one", "a | 1 < 2"), (4, "text", "Head one", "[Head one] after"), (5, "text", "Head one", "[Head one] still under one")]
    assert got[None] == got[3] == [(0, "plain", "", "")] and got[4] == [(0, "plain", "", "short")] and len(got[5]) == 1
    P.register_blocks(spark, d.schema["k"].dataType)
    assert spark.sql("SELECT * FROM html_blocks(TABLE(SELECT * FROM {d}) PARTITION BY k)", d=d).count() == sum(map(len, got.values()))
