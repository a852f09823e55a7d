"""Ids against the tokenizers library, gapless sequences, the plan against item-by-item placing."""
import os
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from dossier.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


def naive(lengths, cap):
    """One by one: greedy matching of large items, then best fit, longest first."""
    big = sorted((n for n in lengths if 3 * n > cap), reverse=True)
    gaps = []
    while big:
        n = big.pop(0)
        i = next((i for i, p in enumerate(big) if p + n <= cap), None)
        gaps.append(cap - n - (big.pop(i) if i is not None else 0))
    for n in sorted((n for n in lengths if 3 * n <= cap), reverse=True):
        fit = min((g, i) for i, g in enumerate([*gaps, cap]) if g >= n)[1] if gaps else 0
        if fit >= len(gaps):
            gaps.append(cap)
        gaps[fit] -= n
    return len(gaps)


def test_plan_equals_item_by_item():
    rnd = random.Random(3)
    for _ in range(60):
        cap = rnd.choice([10, 30, 64, 101])
        lengths = [min(cap, max(1, int(rnd.expovariate(rnd.choice([.02, .1, .5]))))) for _ in range(rnd.randint(1, 150))]
        rows, total = packing.plan({n: lengths.count(n) for n in set(lengths)}, cap)
        assert total == naive(lengths, cap)
        assert sum(r[2] for r in rows) == len(lengths)
        used = {}
        for n, _, count, first, each, off in rows:
            for j in range(count):
                used.setdefault(first + j // each, []).append((off + j % each * n, n))
        assert set(used) == set(range(total))
        for spans in used.values():
            at = 0
            for o, n in sorted(spans):
                assert o == at
                at += n
            assert at <= cap


TEXTS = ["", None, "a", "Hello  world's  \n\n x", " naïve Ünïcode ß œ", "数字 ２３ ² ½ Ⅷ", "a\x1cb\x1d c d e ", "<|endoftext|> x",
         "it's they'LL don't 'sx", "١٢٣ नमस्ते 👍🏽", "x_y-z 12ab34", "word " * 5000, "tab\t\t\ttab \r\n ", "\x85 é ªº",
         "  ", " \n", "ªª", "a" * 4000]


def test_ids_equal_the_library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    enc = packing.Encoder(PATH)
    for x in TEXTS:
        assert np.frombuffer(enc.encode(x or ""), "<u4").tolist() == t.encode(x or "", add_special_tokens=False).ids


def test_query_round_trip(spark, tmp_path):
    rnd = random.Random(1)
    texts = TEXTS + [" ".join(rnd.choice(["the", "of", "ing", "Zürich", "x9"]) for _ in range(rnd.randint(0, 2600))) for _ in range(60)]
    rows = [(None if i == 3 else i // 2, x, "en", 1, 2) for i, x in enumerate(texts)] + [(7, "same", "en", 1, 2)] * 3
    spark.createDataFrame(rows, "doc_id long, text string, lang string, sequence_id int, _row int").write.parquet(os.path.join(tmp_path, "documents.parquet"))
    got = queries.QUERIES["op2_bestfit_packing"](spark, str(tmp_path)).collect()
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    want = []
    for d, x, *_ in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        want += [(d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted([tuple(r)[:5] for r in got], key=repr) == sorted(want, key=repr)
    seq = {}
    for r in got:
        seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seq.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 1024
    assert len(seq) == naive([r["length"] for r in got], 1024)


def test_bad_lengths_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (3, 2000), (4, 5)], "id long, length long")
    got = {r["id"]: (r["sequence_id"], r["offset"]) for r in packing.pack(df).collect()}
    assert got == {1: (None, None), 2: (None, None), 3: (None, None), 4: (0, 0)}
    assert packing.pack(df.limit(0)).count() == 0
    assert packing.cut(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
