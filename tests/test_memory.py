"""Batches are worked off in bounded pieces, with the results of one piece."""
import html
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa

from dossier.functions.text import unescaped
from dossier.operators import chunking as C, ranking as R


def test_dense_search_holds_no_product_of_vectors_and_queries():
    rng = np.random.default_rng(1)
    v, q = rng.normal(size=(9_000, 8)), R._unit_rows(rng.normal(size=(5_000, 8)))
    batches = [pd.DataFrame({"id": np.arange(i, i + 4_500), "e": list(v[i:i + 4_500])}) for i in (0, 4_500)]
    tracemalloc.start()
    got = pd.concat(R._dense_hits(iter(batches), np.arange(5_000), q, 3, "id", "e", "qid"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4_500 * 5_000 * 8  # one batch against all queries
    best = got.sort_values(["qid", "similarity"], ascending=[True, False]).groupby("qid").head(3)
    sims = R._unit_rows(v) @ q.T
    want = np.argsort(-sims, axis=0)[:3].T
    assert (best["id"].to_numpy().reshape(-1, 3) == want).all()


def test_recursive_chunks_leave_a_batch_in_pieces():
    texts = [None, "", *(f"{i} " + "word " * 400 + "\n\nline" for i in range(500))]
    schema = pa.schema([("doc_id", pa.int64()), ("chunk_id", pa.int64()), ("text", pa.string())])
    batch = pa.RecordBatch.from_arrays([pa.array([None, *range(501)], pa.int64()), pa.array(texts)], ["doc_id", "text"])
    out = list(C._recursive_batches(batch, schema, 800, 120))
    assert len(out) == 4 and max(b.num_rows for b in out) <= 128 * 4
    rows = [(k, i, c) for k, t in zip([None, *range(501)], texts)
            for i, c in enumerate(C._merge_pieces(C._recursive_split(t or "", 800, C.SEPARATORS), 800, 120))]
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == rows


def test_entities_of_a_batch_are_read_in_pieces():
    texts = [None if i % 7 == 0 else f"{i} &amp; &eacute;&#33; &bogus; " * (i % 3) + "plain" for i in range(1_000)]
    for rows in (64, 5_000):
        assert unescaped(pa.array(texts), rows).to_pylist() == [None if t is None else html.unescape(t) for t in texts]
    assert unescaped(pa.array([], pa.string())).to_pylist() == []
