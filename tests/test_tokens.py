"""Tokens and counts made in Python are those of the Spark expressions."""
import pyarrow as pa
from pyspark.sql import functions as F

from dossier.functions.text import tokenize, tokens_of
from dossier.operators import lexical as L, ranking as R


def test_tokens_of_every_code_point(spark):
    points = [chr(i) for i in range(1, 0x30000) if not 0xD800 <= i < 0xE000]
    texts = [f"Ab{c}C_9{c} K{c}" for c in points] + ["", "가나Xy 다", "Kelvin İI"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tokenize(F.col("t")).alias("w")).collect()
    assert all(r.w == tokens_of(texts[r.i]) for r in got) and len(got) == len(texts)


def test_vocabulary_of_texts(spark):
    rows = [(1, "a b A"), (2, None), (3, ""), (4, "B c K k"), (5, "...")]
    d = spark.createDataFrame(rows, "id int, text string").repartition(2)
    want = {r.term: (r.df, r.dl_sum) for r in R.vocabulary(R.tokenized(d, ["id"], "text")).collect()}
    got = {r.term: (r.df, r.dl_sum) for r in R.text_vocabulary(d, "text").collect()}
    assert got[""] == want[""] == (4, 6) and {t: v[0] for t, v in got.items()} == {t: v[0] for t, v in want.items()}


def test_counts_leave_a_task_in_parts():
    batch = pa.RecordBatch.from_arrays([pa.array([f"w{i} w0" for i in range(100)])], ["text"])
    parts = list(L.text_counts(iter([batch]), 10))
    assert len(parts) > 5 and max(p.num_rows for p in parts) <= 13
    assert sum(r["df"] for p in parts for r in p.to_pylist() if r["term"] == "") == 100


def test_tokens_of_a_column_are_those_of_its_texts():
    points = [chr(i) for i in range(1, 0x30000) if not 0xD800 <= i < 0xE000]
    texts = [*(f"Ab{c}C_9{c} K{c}" for c in points), "", None, "가나Xy 다", "힣가", "x", "x", None]
    for column in (pa.array(texts), pa.array(texts).slice(5), pa.array(texts, pa.large_string()).slice(len(points)), pa.array([None, ""], pa.string()), pa.array([], pa.string())):
        want = [tokens_of(t or "") for t in column.to_pylist()]
        got, number = L.tokens(column)
        assert number.tolist() == [len(w) for w in want] and got.to_pylist() == [t for w in want for t in w]
