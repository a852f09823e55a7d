"""What a Python worker holds beside an Arrow batch."""
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from dossier.llm import langid
from dossier.llm.common import few


def peak(fn) -> int:
    tracemalloc.start()
    fn()
    size = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return size


def test_short_words_of_many_languages_take_rows_for_their_own_length_only():
    pieces = langid.Pieces(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    logp = np.full((len(pieces.number) + 1, 8), -10.0)
    words = [b" w%03d" % i for i in range(1000)]
    words = [b" " + bytes(97 + int(c) for c in w[2:].decode()) for w in words]
    assert peak(lambda: langid.forward(pieces, words, logp)) < 16 * len(words) * 8 * 8


def test_a_batch_is_read_in_pieces():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 1000] * 2000)], ["text"])
    assert [x.num_rows for x in few(batch, 900)] == [900, 900, 200]
    assert peak(lambda: [len(t) for x in few(batch) for t in x.column(0).to_pylist()]) < 500_000
