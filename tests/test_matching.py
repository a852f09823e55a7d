"""Substrings by automaton against trying every pair; slabs, case, nulls, repeats; scores of hints; many needles in one pass."""
import random

from dossier.operators import joins as J, matching as M


def test_pairs_against_every_pair_in_one_and_many_slabs(spark):
    rnd = random.Random(1)
    texts = [(i, "".join(rnd.choices("abcÄ é", k=rnd.randint(0, 40)))) for i in range(120)] + [(200, None), (201, "x"), (201, "abc abc")]
    needles = [(i, "".join(rnd.choices("abcä é", k=rnd.randint(0, 4)))) for i in range(60)] + [(90, None), (91, ""), (92, "abc"), (93, "abc"), (92, "abc")]
    t = spark.createDataFrame(texts, "k long, t string").repartition(4)
    n = spark.createDataFrame(needles, "m long, n string")
    for fold in (False, True):
        low = str.lower if fold else (lambda x: x)
        want = sorted({(a, b) for a, x in texts for b, y in needles if x is not None and y and low(y) in low(x)})
        for slab in (1_000_000, 20):
            assert sorted(map(tuple, M.contains_pairs(t, "k", "t", n, "m", "n", fold, slab).collect())) == want


def test_hundred_thousand_hints_in_one_pass(spark):
    rnd = random.Random(2)
    hints = [(i, f"h{i:06d}", None) for i in range(100_000)]
    docs = [(f"doc_{a}_h{rnd.randint(0, 99_999):06d}_{b}_pdf",) for a in range(20) for b in range(25)]
    got = M.matching_documents(spark.createDataFrame(docs, "doc string"), "doc", spark.createDataFrame(hints, "l long, hint string, kind string"), "l", "hint", "kind")
    assert got.count() == len(set(docs)) and got.filter("score <> 7").count() == 0


def test_scores_of_kinds_and_endings(spark):
    docs = spark.createDataFrame([("A_Impact_2023_PDF",), ("a_impact_2023_json",), ("a_dart_x_xml",), ("ab",)], "doc string")
    hints = spark.createDataFrame([(1, "a_", "sustainability_report"), (1, "2023", "sustainability_report"), (2, "A", "dart_filing"), (3, "zz", None), (4, "b", None),
                                   (5, "json", None)], "l long, hint string, kind string")
    m = M.matching_documents(docs, "doc", hints, "l", "hint", "kind")
    got = {(r["l"], r["doc"]): r["score"] for r in m.collect()}
    assert got == {(1, "A_Impact_2023_PDF"): 52, (1, "a_impact_2023_json"): 39, (1, "a_dart_x_xml"): 2, (2, "A_Impact_2023_PDF"): 1, (2, "a_dart_x_xml"): 42,
                   (2, "ab"): 1, (4, "ab"): 1}
    assert {r["l"]: r["doc"] for r in M.best_document(m, "doc", "l").collect()} == {1: "A_Impact_2023_PDF", 2: "a_dart_x_xml", 4: "ab"}


def test_routing_reads_the_last_word_and_falls_back(spark):
    q = spark.createDataFrame([(1, "Many words come before WATERUSE"), (2, "nothing"), (3, "water and energy")], "q long, text string")
    t = spark.createDataFrame([("d1", "wateruse", 3), ("d2", "water", 2), ("d3", "energy", 2), ("d3", "energy", 2)], "doc string, term string, weight int")
    got = {(r["q"], r["doc"], r["route_score"], r["route_rank"]) for r in J.route_documents(q, t, "q", "text", "doc", 4, "d0").collect()}
    assert got == {(1, "d1", 3, 1), (1, "d2", 2, 2), (2, "d0", 0, 1), (3, "d2", 2, 1), (3, "d3", 2, 2)}
