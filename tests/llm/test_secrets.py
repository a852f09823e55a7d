"""Base spans against the plain patterns, added spans on held-out strings, nulls, clashes."""
import hashlib
import os
import random
import re
import string

import numpy as np

from dossier.llm import queries, secrets

CASES = [None, "", "x" * 200_000, "password=abc", "PassWord : 'abcdef'", "token=token:abcdefgh", "api_key = \"AbC123.-/+\" secret=zzzzzz",
         "AKIA" + "A" * 15, "AKIA" + "B" * 16, "AKIAAKIA" + "C" * 16, "0" * 23, "a1" * 12, "é" * 5 + "deadbeef" * 4 + " tokenſecret=abcdefg",
         "password=0123456789abcdef0123456789 x", "paſſword=abcdefgh", "apikey:\x20\x20abcdef token\t=abcdefgh"]


def plain(text):
    out = []
    for i, (kind, rx, ok) in enumerate([
            ("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
             lambda m: len(m[2]) >= 6),
            ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
            ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]):
        out += [(m.start(), i, kind, m.end()) for m in rx.finditer(text or "") if ok(m)]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def test_base_spans(spark, tmp_path):
    rows = [(i if i != 2 else None, t, "a", "b") for i, t in enumerate(CASES)] + [(3, CASES[3], "a", "b")]
    spark.createDataFrame(rows, "doc_id long, text string, spans string, n_hex string").write.parquet(os.path.join(tmp_path, "documents.parquet"))
    got = queries.QUERIES["op3_secret_scan"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    want = sorted((repr(d), hashlib.sha256(",".join(plain(t)).encode()).hexdigest(), *(sum(x.startswith(k) for x in plain(t)) for k in ("assign", "access", "hex")))
                  for d, t, *_ in rows)
    assert sorted((repr(r["doc_id"]), r["base_sha256"], r["n_assign"], r["n_access"], r["n_hex"]) for r in got) == want
    assert all(set(",".join(plain(t)).split(",")) <= set(r["spans"].split(",")) | {""} for r in got for d, t, *_ in rows if d == r["doc_id"] and d is not None)


def test_model_separates_held_out(spark):
    rnd = random.Random(99)
    model = secrets.train(spark.createDataFrame([(1, "plain words only and ordinary_identifiers")], "doc_id long, text string"))
    keys = ["".join(rnd.choice(string.ascii_letters + string.digits) for _ in range(32)) for _ in range(300)]
    plain_ = secrets.drawn_samples(seed=1234)[1]
    plain_ = [t for t in plain_ if len(t) >= 20]
    hit = lambda t: any(k == 3 for _, _, k in secrets.all_spans(f"see {t} here", model, secrets.THRESHOLD))
    assert sum(map(hit, keys)) >= 295
    assert sum(map(hit, plain_)) <= 0.01 * len(plain_)


def test_redaction_and_empty(spark):
    df = spark.createDataFrame([(1, "a password=abcdefgh b"), (2, None), (3, "clean")], "doc_id long, text string")
    model = secrets.train(df)
    got = [r[0] for r in df.orderBy("doc_id").select(secrets.redacted(df["text"], model)).collect()]
    assert got == ["a [SECRET] b", None, "clean"]
    assert secrets.find(df.limit(0)).count() == 0


def test_free_tokens_against_every_span_and_in_linear_time():
    import random
    import re
    import time
    rnd = random.Random(3)
    for _ in range(200):
        text = "".join(rnd.choices("ab ", k=60))
        spans = [(s, s + rnd.randint(1, 9), 0) for s in rnd.choices(range(60), k=rnd.randint(0, 6))]
        want = [m.span() for m in re.finditer("[ab]+", text) if all(e <= m.start() or m.end() <= s for s, e, _ in spans)]
        assert [m.span() for m in secrets.free(re.finditer("[ab]+", text), spans)] == want
    text = "".join(f"password = s3cr3tvalue{i:06d} plain{i:030d} " for i in range(100_000))
    t0 = time.time()
    found = secrets.all_spans(text, np.zeros((68, 68)), 1.0)
    assert sum(k == 0 for _, _, k in found) == 100_000 and time.time() - t0 < 30
