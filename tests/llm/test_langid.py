"""The forward sum against all segmentations, held-out accuracy, nulls, long words, ties, empty tables."""
import math
import random

import numpy as np
import public_tokenizers

from dossier.llm import langid, queries
from dossier.llm.common import hash_limit

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


PIECES = langid.Pieces(VOCABULARY)


def all_cuts(w, logp):
    """Log sum over all segmentations from the definition of the chain."""
    a = [0.0] + [-math.inf] * len(w)
    for j in range(1, len(w) + 1):
        ways = [a[i] + logp[PIECES.number[w[i:j]], 0] for i in range(max(0, j - 64), j) if w[i:j] in PIECES.number]
        top = max(ways)
        a[j] = top + math.log(math.fsum(math.exp(x - top) for x in ways))
    return a[-1]


def recursive(w, p):
    return 1.0 if not w else sum(p[PIECES.number[w[:k]], 0] * recursive(w[k:], p) for k in range(1, len(w) + 1) if w[:k] in PIECES.number)


def some_p(seed=0, scale=1e-3):
    p = np.random.default_rng(seed).random((len(PIECES.number) + 1, 1)) * scale
    p[0] = 0
    return p


def test_forward_sums_all_segmentations():
    p = some_p()
    logp = langid.logarithm(p)
    for w in (b" the", b" zx", " größe".encode(), b" internati", b" representatives"):
        got = langid.forward(PIECES, [w, w], logp)
        assert math.isclose(got[1, 0], math.log(recursive(w, p)), rel_tol=1e-9)
        assert np.allclose(langid.forward_all(PIECES, [w], logp)[-1], got[0])
    out = np.zeros((1, len(PIECES.number) + 1))
    langid.expected({b" the": np.array([3.0])}, PIECES, logp, out)
    lengths = {i: len(q) for q, i in PIECES.number.items()}
    assert math.isclose(sum(n * lengths[i] for i, n in enumerate(out[0]) if n), 3 * len(" the"), rel_tol=1e-9)


def test_long_pieces_and_long_words_without_borders(monkeypatch):
    """Pieces over eight bytes are used; words of any length, in small probabilities, over the borders of the chunks."""
    assert PIECES.longest > 12 and b" international" in PIECES.number
    rnd = random.Random(1)
    words = [langid.as_bytes("".join(rnd.choices(alphabet, k=n))) for n in (3, 40, 700, 2_000) for alphabet in ("etaoin", "ខ្មែរអក្សរ", "日本語文字列")]
    words += [langid.as_bytes("international" * 200)]
    for chunk in (4096, 50, 7):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        for w in words:
            logp = langid.logarithm(some_p(2, 1e-12))
            want = all_cuts(w, logp)
            assert math.isclose(langid.forward(PIECES, [w], logp)[0, 0], want, rel_tol=1e-9)
            if len(w) < 800:
                out = np.zeros((1, len(PIECES.number) + 1))
                langid.expected({w: np.array([2.0])}, PIECES, logp, out)
                assert math.isclose(sum(n * len(q) for q, i in PIECES.number.items() if (n := out[0][i])), 2 * len(w), rel_tol=1e-6)


def test_rare_scripts_in_one_language_leave_the_model_whole(spark):
    base = [(i, "the cat and the dog in the house" if i % 2 else "der hund und die katze im haus", "en" if i % 2 else "de") for i in range(40)]
    for k, rare in enumerate(["ខ្មែរអក្សរខ្មែរអក", "ㄅㄆㄇ" * 700, "ᏣᎳᎩ"]):
        df = spark.createDataFrame(base + [(100 + k, f"the {rare} of the", "en")], "doc_id long, text string, lang string")
        m = langid.train(df, VOCABULARY)
        assert np.isfinite(m.p).all() and (m.p[1:] > 0).all()
        got = {r["doc_id"]: r for r in langid.identify(df.union(spark.createDataFrame([(900, f"der {rare} und", "de")], df.schema)), m).collect()}
        assert all(0 <= r["score"] <= 1 for r in got.values())
        assert [r["lang_pred"] for i, r in sorted(got.items()) if i < 100] == ["en" if i % 2 else "de" for i in range(40)]


def test_share_of_the_sample_never_reaches_zero():
    assert all(hash_limit(4_000, n) > 0 for n in (1, 10 ** 6, 4 * 10 ** 9, 10 ** 12, 10 ** 15))


def test_held_out_accuracy(spark):
    got = queries.QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01").collect()
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    assert len(got) == 1000
    held = [r for r in got if r["held_out"] and docs[r["doc_id"]]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en", "x"), (2, "der hund und die katze", "de", "x"), (3, None, "en", "x"), (4, "", None, "x"),
            (5, "123 .. ½²", None, "x"), (6, "der " * 60_000, None, "x"), (7, "z" * 300_000, None, "x"), (None, "the the", None, "x"),
            (1, "the cat and the dog", "en", "x"), (8, "日本語 の テキスト", None, "x"), (9, "a\0b", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    m = langid.train(df, VOCABULARY)
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.identify(df, m).collect()]
    assert len(got) == len(rows)
    d = dict(got)
    assert (d[1], d[2], d[3], d[4], d[5], d[6], d[None]) == ("en", "de", "und", "und", "und", "de", "en")
    assert langid.identify(df.limit(0), m).count() == 0
    none = langid.train(df.limit(0), VOCABULARY)
    assert {r["lang_pred"] for r in langid.identify(df, none).collect()} == {"und"}
