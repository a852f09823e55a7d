"""Log of changes: replays, late rows, deletes and returns, in one batch or many, against the rule said plainly."""
import itertools
import random

from pyspark.sql import functions as F

from dossier import streaming as ST
from dossier.functions.text import content_id
from dossier.operators.chunking import chunk_chars
from dossier.streaming import changes as CH

SCHEMA = "doc_id long, source string, text string, op string, seq long"
EVENTS = [
    (1, "a", "one " * 300, "add", 1), (2, "a", "two", "add", 1), (3, "b", "three", "add", 1), (4, None, "four", "add", 1),
    (None, "a", None, "delete", 5), (1, "a", "one " * 300, "add", 6), (2, "a", "two", "add", 4), (None, None, None, "delete", 2),
    (5, "b", "five", "add", 2), (6, "b", None, "add", 2), (7, "b", "", "add", 2), (8, "b", "no number", "add", None),
    (9, "b", "odd", "upsert", 3), (3, "b", "three", "add", 7), (None, "b", None, "delete", 3), (None, "c", None, "delete", 1),
]


def expected(spark, events):
    gone = {}
    for _, s, _, op, seq in events:
        if op == "delete":
            gone[s] = max(seq, gone.get(s, seq))
    kept = [e for e in events if e[3] == "add" and e[4] is not None and e[4] >= gone.get(e[1], e[4])]
    c = chunk_chars(spark.createDataFrame(kept, SCHEMA), "text")
    return {(r[0], r[1]) for r in c.select("source", content_id(F.col("doc_id"), F.col("chunk_id"), F.col("text"))).collect()}


def play(spark, folder, batches):
    """Each batch is a file and a run of its own over one checkpoint; the log after every run."""
    counts = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        s = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        counts.append(ST.run_once(spark, s, f"{folder}/log", f"{folder}/ck", batch=CH.merge_changes(f"{folder}/log", parts=2)).count())
    return spark.read.parquet(f"{folder}/log"), counts


def live(log):
    rows = [(r["source"], r["chunk_key"]) for r in CH.live_chunks(log).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_any_order_and_replay(spark, tmp_path):
    want = expected(spark, EVENTS)
    assert {s for s, _ in want} == {"a", "b"} and len(want) > 2
    for n, parts in ((0, 1), (1, 3)):
        rows = EVENTS[:]
        random.Random(n).shuffle(rows)
        batches = [list(b) for b in itertools.batched(rows, -(-len(rows) // parts))]
        log, counts = play(spark, str(tmp_path / str(n)), batches + [rows])
        assert live(log) == want
        assert counts[-1] == counts[-2], "a replay logs nothing"


def test_delete_and_return(spark, tmp_path):
    log, counts = play(spark, str(tmp_path), [[(1, "a", "x", "add", 1), (2, "a", "y", "add", 1)], [(None, "a", None, "delete", 2)],
                                              [(1, "a", "x", "add", 1)], [(1, "a", "x", "add", 3)]])
    assert counts == [2, 5, 5, 6]  # two adds; two deletes and one of the source; too late; back again
    assert [(r["source"], r["text"], r["seq"]) for r in CH.live_chunks(log).collect()] == [("a", "x", 3)]
