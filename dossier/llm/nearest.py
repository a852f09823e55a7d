"""Exact nearest neighbours of a stated query set by a block matrix join.

Vectors are scaled to unit length and quantised to int8. A tile of int8 products
gives every cosine of a block of queries and a block of candidates up to a bound
that follows from the quantisation errors of the two vectors. A pair survives
if its upper bound reaches the k-th best lower bound known for the query; only
survivors are computed again in double precision on the original vectors, and
enter the query's heap.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from dossier.llm.common import map_arrow, stored

SLAB_BYTES = 32 << 20  # of queries that travel to all workers at once
TILE = 2048  # candidates of a tile
QUERY_TILE = 512
FIRST_LOOK = 4096  # candidates read for a first floor per query


class Quantised:
    """Original vectors (double), int8 codes as exact float32 integers, and what is needed for bounds."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        self.ids, self.v = ids, v
        self.norm = np.sqrt(np.einsum("ij,ij->i", v, v))
        unit = v / self.norm[:, None]
        self.scale = np.abs(unit).max(1) / 127.0
        self.code = np.rint(unit / self.scale[:, None]).astype(np.int8)
        near = self.code * self.scale[:, None]
        self.err = np.sqrt(((unit - near) ** 2).sum(1)) + 1e-12
        self.size = np.sqrt((near ** 2).sum(1))

    def rows(self, i: slice) -> "Quantised":
        q = object.__new__(Quantised)
        for k, x in self.__dict__.items():
            setattr(q, k, x[i])
        return q


def tile_bounds(q: Quantised, c: Quantised) -> tuple[np.ndarray, np.ndarray]:
    """(estimate, error): the cosine lies within error of the estimate.

    int8 products of up to 1040 dimensions sum exactly in float32; longer
    vectors are summed in double precision.
    """
    kind = np.float32 if q.code.shape[1] <= 1040 else np.float64
    dot = (q.code.astype(kind) @ c.code.astype(kind).T).astype(np.float64)
    est = dot * q.scale[:, None] * c.scale[None, :]
    # a.b - a'.b' = (a - a').b + a'.(b - b')
    return est, q.err[:, None] + q.size[:, None] * c.err[None, :] + 1e-9


def exact(q: Quantised, i: np.ndarray, c: Quantised, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for a in range(0, len(i), 1 << 16):
        x, y = i[a:a + (1 << 16)], j[a:a + (1 << 16)]
        out[a:a + (1 << 16)] = np.einsum("ij,ij->i", q.v[x], c.v[y]) / (q.norm[x] * c.norm[y])
    return out


class Heaps:
    """The k best (score, then smaller id) per query, each id once."""

    def __init__(self, queries: int, k: int):
        self.k, self.heap = k, [[] for _ in range(queries)]
        self.floor = np.full(queries, -np.inf)

    def push(self, q: int, score: float, ident: int) -> None:
        h = self.heap[q]
        if any(-n == ident for _, n in h):
            old = next(x for x in h if -x[1] == ident)
            if score > old[0]:
                h.remove(old)
                h.append((score, -ident))
                heapq.heapify(h)
        elif len(h) < self.k:
            heapq.heappush(h, (score, -ident))
        else:
            heapq.heappushpop(h, (score, -ident))
        if len(h) == self.k:
            self.floor[q] = max(self.floor[q], h[0][0])


def kth_lower(est: np.ndarray, err: np.ndarray, k: int, skip: np.ndarray) -> np.ndarray:
    low = np.where(skip, -np.inf, est - err)
    return -np.partition(-low, k - 1, axis=1)[:, k - 1] if low.shape[1] >= k else np.full(len(low), -np.inf)


def search_tile(q: Quantised, first: int, c: Quantised, heaps: Heaps, k: int) -> None:
    """One tile of queries (from number ``first``) and candidates into the heaps."""
    est, err = tile_bounds(q, c)
    own = q.ids[:, None] == c.ids[None, :]
    distinct = len(np.unique(c.ids)) == len(c.ids)
    floor = heaps.floor[first:first + len(q.ids)]
    if distinct:  # repeated ids must not fill the k places of the tile's own floor
        floor = np.maximum(floor, kth_lower(est, err, k, own))
    i, j = np.nonzero((est + err >= floor[:, None]) & ~own)
    if not len(i):
        return
    s = exact(q, i, c, j)
    order = np.lexsort((c.ids[j], -s, i))
    i, j, s = i[order], j[order], s[order]
    if distinct:  # more than k of one query cannot enter
        start = np.r_[0, np.flatnonzero(np.diff(i)) + 1]
        keep = np.arange(len(i)) - np.repeat(start, np.diff(np.r_[start, len(i)])) < k
        i, j, s = i[keep], j[keep], s[keep]
    for a, b, x in zip(i.tolist(), c.ids[j].tolist(), s.tolist()):
        heaps.push(first + a, x, b)


def vectors_of(batch: pa.RecordBatch) -> Iterator[Quantised]:
    """The usable vectors of a batch by dimension: no null, no null or non-finite component, not zero."""
    col = batch.column(1)
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    size = pa.compute.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False)
    for d in np.unique(size[size > 0]):
        at = np.flatnonzero(size == d)
        flat = col.take(pa.array(at)).flatten()
        v = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, d)
        ok = np.isfinite(v).all(1)
        ok[ok] &= np.isfinite(np.einsum("ij,ij->i", v[ok], v[ok])) & (np.einsum("ij,ij->i", v[ok], v[ok]) > 0)
        if ok.any():
            yield Quantised(ids[at[ok]].astype(np.int64), v[ok])


def slab_search(cands: DataFrame, slab: dict[int, Quantised], floors: dict[int, np.ndarray] | None, k: int) -> DataFrame:
    """(query_id, vec_id, score): each task's k best per query that reach the floors of the first look."""
    cast = cands.sparkSession.sparkContext.broadcast((slab, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        slab_, floors_ = cast.value
        heaps = {d: Heaps(len(q.ids), k) for d, q in slab_.items()}
        for d, f in (floors_ or {}).items():
            heaps[d].floor = f.copy()
        for batch in batches:
            for c in vectors_of(batch):
                d = c.v.shape[1]
                if d not in slab_:
                    continue
                for a in range(0, len(c.ids), TILE):
                    part = c.rows(slice(a, a + TILE))
                    for b in range(0, len(slab_[d].ids), QUERY_TILE):
                        search_tile(slab_[d].rows(slice(b, b + QUERY_TILE)), b, part, heaps[d], k)
        for d, h in heaps.items():
            found = [(q, -n, s) for q, rows in zip(slab_[d].ids.tolist(), h.heap) for s, n in rows]
            if found:
                a, b, s = zip(*found)
                yield {"query_id": list(a), "vec_id": list(b), "score": list(s)}
    return map_arrow(cands, run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, is_query: Column, item: str = "vec_id", vector: str = "embedding", k: int = 5,
            slab_bytes: int = SLAB_BYTES, first_look: int = FIRST_LOOK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest by cosine of every query, ties to the smaller id.

    Null, zero and partly null or non-finite vectors, and rows with a null id,
    take no part; vectors meet those of their own dimension. All rows that carry
    the query's id are its own. A repeated id counts once, with its best score;
    of a repeated query id the rows are asked as one (its first vector, by value). Fewer
    candidates give fewer ranks, an empty table none. Other columns are not read.

    Queries go out in slabs of bounded bytes; the candidates are scanned where
    they lie, once per slab, and nothing but each task's survivors is shuffled. A
    look at a bounded number of candidates gives every task a floor to start from:
    a k-th best of some candidates is never above the k-th best of all.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(item).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v")).filter("i is not null and v is not null")
    asked = stored(vectors.filter(is_query).select(F.col(item).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v"))
                   .filter("i is not null and size(v) > 0").groupBy("i").agg(F.min("v").alias("v")))
    size = asked.agg(F.count(F.lit(1)), F.sum(F.size("v"))).first()
    slabs = max(1, -(-int(size[1] or 0) * 20 // slab_bytes))
    out = None
    for n in range(slabs):
        rows = asked.filter(F.pmod(F.xxhash64("i"), F.lit(slabs)) == n).toArrow() if slabs > 1 else asked.toArrow()
        slab: dict[int, Quantised] = {}
        parts: dict[int, list[Quantised]] = {}
        for batch in rows.to_batches():
            for q in vectors_of(batch):
                parts.setdefault(q.v.shape[1], []).append(q)
        for d, qs in parts.items():
            slab[d] = Quantised(np.concatenate([q.ids for q in qs]), np.concatenate([q.v for q in qs]))
        floors = None
        if slab:
            floors = {d: np.full(len(q.ids), -np.inf) for d, q in slab.items()}
            look: dict[int, list[Quantised]] = {}
            for batch in own.limit(first_look).toArrow().to_batches():
                for c in vectors_of(batch):
                    look.setdefault(c.v.shape[1], []).append(c)
            for d, cs in look.items():
                if d in slab:
                    ids, v = np.concatenate([c.ids for c in cs]), np.concatenate([c.v for c in cs])
                    c = Quantised(*((x[np.unique(ids, return_index=True)[1]]) for x in (ids, v)))
                    for a in range(0, len(slab[d].ids), QUERY_TILE):
                        q = slab[d].rows(slice(a, a + QUERY_TILE))
                        est, err = tile_bounds(q, c)
                        floors[d][a:a + QUERY_TILE] = kth_lower(est, err, k, q.ids[:, None] == c.ids[None, :])
        part = slab_search(own, slab, floors, k)
        out = part if out is None else out.union(part)
    best = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
