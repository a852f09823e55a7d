"""Best-fit packing with large-item matching.

Items over a third of the capacity fit at most twice into a sequence, so they
are matched greedily: the longest with the longest partner that still fits.
Shorter items then go, longest first, into the smallest gap that holds them.

Lengths are integers up to the capacity, so the whole decision needs the
histogram only (one row per length, whatever the corpus). The driver packs the
histogram in runs of equal bins; documents find their place by their rank among
items of their length, which is counted in salted groups and never in one task.
"""
from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from dossier.llm.common import fresh, map_arrow, shuffle_width, stored, worker_cache

CAPACITY = 1024
END = 2
CACHE_WORDS = 150_000
# The vocabulary's split pattern in terms of the standard library, right for ASCII and Latin letters.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
UNSURE = r"[^\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ɏ]"  # where the two pattern dialects may differ


class Encoder:
    """Texts to little-endian 32-bit ids of a byte-level BPE vocabulary; the ids equal those of ``tokenizers``.

    Words are split and looked up, unknown words are merged by the vocabulary's
    ranks (the ``.tiktoken`` file beside the ``.json`` one). Texts with
    characters outside ASCII and Latin letters are encoded in one piece.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        lines = Path(path).with_suffix(".tiktoken").read_bytes().splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split, self.unsure, self.known = re.compile(SPLIT).findall, re.compile(UNSURE).search, {}

    def pack(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self.unsure(text):
            return self.pack(text)
        words, known = self.split(text), self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            if len(known) > CACHE_WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = self.pack(w)
            return b"".join([known[w] for w in words])


def cut(docs: DataFrame, tokenizer: str, item: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
        end: int = END) -> DataFrame:
    """(item, piece, start, length, ids): every text's ids and the end id, cut where longer than ``capacity``.

    ``ids`` is binary, little-endian unsigned 32-bit. Of a longer document the
    first piece takes the remainder, the others are full. A null text is empty
    and gives the end id alone. Repeated rows stay repeated; a null item stays null.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        enc = worker_cache(f"bpe {tokenizer}", lambda: Encoder(tokenizer))
        tail = np.array([end], "<u4").tobytes()
        for batch in batches:
            at, piece, start, length, ids, size = [], [], [], [], [], 0

            def out():
                return {item: batch.column(0).take(pa.array(at, pa.int64())), "piece": piece, "start": start,  # noqa: B023
                        "length": length, "ids": ids}  # noqa: B023
            for i, t in enumerate(batch.column(1).to_pylist()):
                blob = (enc.encode(t) if t else b"") + tail
                n = len(blob) // 4
                b = 0
                e = n % capacity or capacity if n > capacity else n
                k = 0
                while b < n:
                    at.append(i); piece.append(k); start.append(b); length.append(e - b); ids.append(blob[4 * b:4 * e])  # noqa: E702
                    b, e, k = e, e + capacity, k + 1
                size += len(blob)
                if size > 4 << 20:
                    yield out()
                    at, piece, start, length, ids, size = [], [], [], [], [], 0
            if at:
                yield out()
    schema = T.StructType([T.StructField(item, docs.schema[item].dataType), T.StructField("piece", T.IntegerType()),
                           T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                           T.StructField("ids", T.BinaryType())])
    return map_arrow(docs.select(F.col(item), F.col(text)), run, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rows (length, first rank, ranks, first sequence, items per sequence, offset) and the number of sequences.

    Equal to placing the items one by one, longest first; runs of equal bins are
    handled together, so the work follows the number of lengths.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    done = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int, int]] = []
    bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by gap: runs (first sequence, how many)
    total = 0

    def put(n: int, count: int, first: int, each: int, offset: int) -> None:
        rows.append((n, done[n], count, first, each, offset))
        done[n] += count
        left[n] -= count

    def opened(count: int) -> int:
        nonlocal total
        total += count
        return total - count

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        for p in (p for p in large if p <= n and p + n <= capacity):
            if not left[n]:
                break
            m = left[n] // 2 if p == n else min(left[n], left[p])
            if m:
                first = opened(m)
                put(n, m * (1 + (p == n)), first, 1 + (p == n), 0)
                if p != n:
                    put(p, m, first, 1, n)
                bins[capacity - n - p].append((first, m))
        if m := left[n]:
            first = opened(m)
            put(n, m, first, 1, 0)
            bins[capacity - n].append((first, m))
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        gap = n
        while left[n]:
            while gap <= capacity and not bins[gap]:
                gap += 1
            if gap > capacity:
                bins[gap := capacity].append((opened(m := -(-left[n] // (capacity // n))), m))
            first, m = bins[gap].pop()
            each = gap // n
            full = min(m, left[n] // each)
            if full:
                put(n, full * each, first, each, capacity - gap)
                bins[gap - each * n].append((first, full))
            rest = m - full
            if rest and (some := left[n]):  # fewer than one bin takes
                put(n, some, first + full, some, capacity - gap)
                bins[gap - some * n].append((first + full, 1))
                full, rest = full + 1, rest - 1
            if rest:
                bins[gap].append((first + full, rest))
    return rows, total


def places(rows: list[tuple[int, int, int, int, int, int]], length: Column, rank: Column) -> Column:
    """Struct (sequence_id, offset) of the item with this rank among those of its length."""
    rows = sorted(rows)
    n, lo, count, first, each, offset = (np.array([r[i] for r in rows], np.int64) for i in range(6))
    starts = (n << 44) + lo

    def of(a: pa.Array, r: pa.Array) -> pa.Array:
        size, k = a.to_numpy(zero_copy_only=False), r.to_numpy(zero_copy_only=False)
        i = np.searchsorted(starts, (size << 44) + k, "right") - 1
        j = k - lo[i]
        return pa.StructArray.from_arrays([pa.array(first[i] + j // each[i]), pa.array(offset[i] + j % each[i] * size)],
                                          ["sequence_id", "offset"])
    return F.arrow_udf(of, "struct<sequence_id:long,offset:long>")(length, rank)


def pack(items: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``: as few sequences of ``capacity`` as the method finds.

    Items without a length from 1 to ``capacity`` (null included) stay, with
    null places. An empty table gives an empty one. Columns of these two names
    in ``items`` are replaced; all others are kept. Ties of length are ordered
    by an id fixed when the items are written once to the shared folder.
    """
    items = items.drop("sequence_id", "offset")
    cols = items.columns
    row, salt, rank, before = (fresh(items, c) for c in ("_row", "_salt", "_rank", "_before"))
    own = stored(items.withColumn(row, F.monotonically_increasing_id()))
    salts = 4 * shuffle_width(items.sparkSession)
    salted = own.withColumn(salt, F.pmod(F.xxhash64(row), F.lit(salts)).cast("int"))
    good = salted.filter(F.col(length).between(1, capacity))
    counts = good.groupBy(length, salt).agg(F.count(F.lit(1)).alias(rank))
    histogram = {int(r[0]): int(r[1]) for r in counts.groupBy(length).agg(F.sum(rank)).collect()}  # at most ``capacity`` rows
    rows, _ = plan(histogram, capacity)
    earlier = Window.partitionBy(length).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(length), F.col(salt), F.coalesce(F.sum(rank).over(earlier), F.lit(0)).alias(before))
    local = F.row_number().over(Window.partitionBy(length, salt).orderBy(row)).cast("long") - 1
    ranked = good.withColumn(rank, local).join(offsets, [length, salt])
    place = fresh(items, "_place")
    out = ranked.withColumn(place, places(rows, F.col(length).cast("long"), F.col(rank) + F.col(before))) if rows else \
        ranked.withColumn(place, F.lit(None).cast("struct<sequence_id:long,offset:long>"))
    out = out.select(*cols, F.col(f"{place}.sequence_id").alias("sequence_id"), F.col(f"{place}.offset").alias("offset"))
    bad = own.filter(~F.coalesce(F.col(length).between(1, capacity), F.lit(False)))
    none = F.lit(None).cast("long")
    return out.union(bad.select(*cols, none, none))
