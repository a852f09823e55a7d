"""Exact pruned lexical search: postings in blocks with their highest impact, walked with MaxScore bounds.

A segment is a bounded run of chunks with its postings by term: chunk places,
saturated term counts ("impacts") and the highest impact of every block. A query
adds up its terms in order of the most they can give. Once the terms left can
no longer lift a chunk over the query's floor (its k-th best so far), they are
looked up for the chunks still in the race only, and blocks whose highest impact
cannot reach the floor are not read at all. What is left out cannot be among
the best, so the result is that of scoring everything.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

K1, B = 1.5, 0.75
BLOCK = 128  # postings under one highest impact
WHOLE = 2_000  # postings of a term that are added up sooner than chunks are looked up in them
NEAR = 8  # times as many postings as chunks in the race: looking chunks up costs as much as reading the list
TIE = 9  # scores equal to this many places are ties, broken by key
SLACK = 2 * 10.0 ** -TIE


@dataclass
class Asked:
    """Queries by column: their terms (numbers into ``terms``) and weights in CSR form, sizes, tenants."""
    terms: list[str]
    qids: np.ndarray
    start: np.ndarray
    term: np.ndarray
    w: np.ndarray
    qd: np.ndarray
    avgdl: np.ndarray
    tenant: np.ndarray | None

    @staticmethod
    def of(w: pd.DataFrame, qid: str, tenant: str | None) -> Asked:
        """From one row per (query, term): w, qd, avgdl; with a tenant a query is one per tenant that it is asked in."""
        own = [qid, tenant] if tenant else [qid]
        w = w.assign(_q=w.groupby(own, sort=False, dropna=False).ngroup().to_numpy()).sort_values("_q", kind="stable")
        first = w.drop_duplicates("_q")
        terms, number = np.unique(w["term"].to_numpy(dtype=object).astype(str), return_inverse=True) if len(w) else (np.array([], str), np.empty(0, int))
        start = np.r_[0, np.cumsum(np.bincount(w["_q"].to_numpy(), minlength=len(first)))].astype(np.int64)
        return Asked(terms.tolist(), first[qid].to_numpy(), start, number, w["w"].to_numpy(dtype=float), first["qd"].to_numpy(dtype=float),
                     first["avgdl"].to_numpy(dtype=float), first[tenant].to_numpy() if tenant else None)

    def columns(self, tenant) -> np.ndarray:
        return np.arange(len(self.qids)) if self.tenant is None else np.flatnonzero(self.tenant == tenant)


@dataclass
class Segment:
    """Postings by term (offsets ``at``; ``rows`` ascend inside a term) and, per chunk, its distinct tokens and what is added to its score."""
    at: np.ndarray
    rows: np.ndarray
    sat: np.ndarray
    tops: np.ndarray
    tops_at: np.ndarray
    dt: np.ndarray
    boost: np.ndarray | None


def saturated(tf: np.ndarray, dl: np.ndarray, avgdl: np.ndarray | float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def block_tops(at: np.ndarray, sat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Highest impact of every block of every term, and the terms' offsets into them."""
    n = -(-np.diff(at) // BLOCK)
    tops_at = np.r_[0, np.cumsum(n)].astype(np.int64)
    starts = np.repeat(at[:-1], n) + BLOCK * (np.arange(tops_at[-1]) - np.repeat(tops_at[:-1], n))
    return (np.maximum.reduceat(sat, starts) if len(starts) else np.empty(0)), tops_at


def counted(toks: pa.ListArray, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets by term, rows, counts) of the given terms in token lists."""
    n = len(toks)
    rows = np.repeat(np.arange(n), np.asarray(pc.fill_null(pc.list_value_length(toks), 0)))
    number = np.asarray(pc.fill_null(pc.index_in(toks.flatten(), value_set=terms), -1)).astype(np.int64)
    hit = number >= 0
    code, tf = np.unique(number[hit] * n + rows[hit], return_counts=True)
    return np.searchsorted(code, np.arange(len(terms) + 1) * n), code % max(n, 1), tf.astype(float)


class Search:
    """Best ``k`` of a stream of segments for every query; floors rise from one segment to the next."""

    def __init__(self, asked: Asked, k: int, bm25_weight: float, overlap_weight: float):
        self.a, self.k, self.bw, self.ow = asked, k, bm25_weight, overlap_weight
        self.floor = np.full(len(asked.qids), -np.inf)
        self.blocks = self.read = 0

    def overlap(self, c: int, common: np.ndarray, dt: np.ndarray) -> np.ndarray:
        return 0.75 * common / self.a.qd[c] + 0.25 * common / np.maximum(10.0, np.sqrt(dt))

    def query(self, s: Segment, c: int, top: np.ndarray, most_boost: float) -> tuple[np.ndarray, ...] | None:
        """(rows, bm25, overlap, score) of the chunks that may be among the best."""
        a, b = self.a.start[c], self.a.start[c + 1]
        t, w = self.a.term[a:b], self.a.w[a:b]
        have = s.at[t + 1] > s.at[t]
        t, w = t[have], w[have]
        if not len(t):
            return None
        each = max(0.0, self.ow * (0.75 / self.a.qd[c] + 0.025))
        bound = np.maximum(self.bw * w * top[t], 0.0) + each
        o = np.argsort(-bound, kind="stable")
        t, w, bound = t[o], w[o], bound[o]
        total = bound.sum()
        left = total - np.cumsum(bound) + bound  # what terms from here on can give
        least = self.floor[c] - SLACK - most_boost
        m = int((left >= least).sum())
        if m and (s.at[t[m:] + 1] - s.at[t[m:]]).sum() <= WHOLE * (len(t) - m):
            m = len(t)
        n_blocks = s.tops_at[t + 1] - s.tops_at[t]
        self.blocks += int(n_blocks.sum())
        if not m:
            return None
        span = list(zip(s.at[t[:m]], s.at[t[:m] + 1]))
        rows, sat = np.concatenate([s.rows[i:j] for i, j in span]), np.concatenate([s.sat[i:j] for i, j in span])
        weight = np.repeat(w[:m], [j - i for i, j in span])
        self.read += int(n_blocks[:m].sum())
        if least > 0:
            tops = np.concatenate([s.tops[i:j] for i, j in zip(s.tops_at[t[:m]], s.tops_at[t[:m] + 1])])
            worth = np.maximum(self.bw * np.repeat(w[:m], n_blocks[:m]) * tops, 0.0) + each + np.repeat(total - bound[:m], n_blocks[:m]) >= least
            if not worth.all():
                self.read -= int((~worth).sum())
                size = np.full(len(worth), BLOCK)
                size[np.cumsum(n_blocks[:m]) - 1] = [j - i - BLOCK * (n - 1) for (i, j), n in zip(span, n_blocks[:m])]
                keep = np.repeat(worth, size)
                rows, sat, weight = rows[keep], sat[keep], weight[keep]
        n = len(s.dt)
        common = np.bincount(rows, minlength=n)
        who = np.flatnonzero(common)
        bm, common = np.bincount(rows, weight * sat, n)[who], common[who]
        extra = s.boost[who] if s.boost is not None else np.zeros(len(who))
        dense = np.zeros(n if m < len(t) else 0)
        for i in range(m, len(t)):
            score = self.bw * bm + self.ow * self.overlap(c, common, s.dt[who]) + extra
            keep = score + left[i] >= self.floor[c] - SLACK
            if not keep.all():
                who, bm, common, extra = who[keep], bm[keep], common[keep], extra[keep]
            if not len(who):
                return None
            i0, i1 = s.at[t[i]], s.at[t[i] + 1]
            if i1 - i0 <= NEAR * len(who):  # a list that is about as short is read in order
                dense[s.rows[i0:i1]] = s.sat[i0:i1]
                sat = dense[who]
                dense[s.rows[i0:i1]] = 0.0
                hit = sat > 0
                self.read += int(n_blocks[i])
            else:
                at = np.minimum(np.searchsorted(s.rows[i0:i1], who), i1 - i0 - 1)
                self.read += len(np.unique(at // BLOCK))
                hit = s.rows[i0:i1][at] == who
                sat = np.where(hit, s.sat[i0:i1][at], 0.0)
            bm = bm + w[i] * sat
            common = common + hit
        over = self.overlap(c, common, s.dt[who])
        score = self.bw * bm + self.ow * over + extra
        if len(score) >= self.k:
            self.floor[c] = max(self.floor[c], np.partition(score, len(score) - self.k)[len(score) - self.k])
        keep = (score >= self.floor[c] - SLACK) & np.isfinite(score)
        return who[keep], bm[keep], over[keep], score[keep]

    def segment(self, s: Segment, columns: np.ndarray) -> tuple[np.ndarray, ...]:
        """(query column, row, bm25, overlap, score)."""
        n_tops = np.diff(s.tops_at)
        top = np.zeros(len(n_tops))
        if len(s.tops):
            top[n_tops > 0] = np.maximum.reduceat(s.tops, s.tops_at[:-1][n_tops > 0])
        most = float(s.boost.max()) if s.boost is not None and len(s.boost) else 0.0
        found = [(c, r) for c in columns if most > -np.inf and (r := self.query(s, c, top, most)) is not None]
        if not found:
            return tuple(np.empty(0, t) for t in (np.int64, np.int64, float, float, float))
        return (np.repeat([c for c, _ in found], [len(r[0]) for _, r in found]), *[np.concatenate([r[i] for _, r in found]) for i in range(4)])


def held_floor(c: np.ndarray, score: np.ndarray, k: int, floor: np.ndarray) -> np.ndarray:
    """Raise each query's floor to the k-th best of the rows held, wherever k are held."""
    o = np.lexsort((-score, c))
    c, score = c[o], score[o]
    start = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.empty(0, np.int64)
    kth = start[np.diff(np.r_[start, len(c)]) >= k] + k - 1
    floor = floor.copy()
    floor[c[kth]] = np.maximum(floor[c[kth]], score[kth])
    return floor


class Held:
    """What a task has found so far; cut down to the floors now and then."""

    def __init__(self, search: Search, key: list[str]):
        self.s, self.key, self.parts, self.size = search, key, [], 0

    def add(self, keys: pa.RecordBatch, found: tuple[np.ndarray, ...]) -> None:
        c, r, bm, ov, sc = found
        if not len(c):
            return
        self.parts.append((keys.select(self.key).take(pa.array(r)), c, bm, ov, sc))
        self.size += len(c)
        if self.size > 4 * self.s.k * len(self.s.floor) + 10_000:
            self.s.floor = held_floor(np.concatenate([p[1] for p in self.parts]), np.concatenate([p[4] for p in self.parts]), self.s.k, self.s.floor)
            self.parts = [self.above(p) for p in self.parts]
            self.size = sum(len(p[1]) for p in self.parts)

    def above(self, part):
        keys, c, bm, ov, sc = part
        ok = sc >= self.s.floor[c] - SLACK
        return keys.take(pa.array(np.flatnonzero(ok))), c[ok], bm[ok], ov[ok], sc[ok]

    def batches(self, qid: str) -> Iterator[pa.RecordBatch]:
        for part in self.parts:
            keys, c, bm, ov, sc = self.above(part)
            if len(c):
                yield pa.RecordBatch.from_arrays([pa.array(self.s.a.qids[c]), *keys.columns, pa.array(bm), pa.array(ov), pa.array(sc)],
                                                 [qid, *self.key, "bm25", "overlap", "score"])


class Walk:
    """Stored postings, sorted by segment and term, searched segment by segment; terms that no query has are passed over."""

    def __init__(self, search: Search, key: list[str], tenant: str | None, boost: str | None):
        self.search, self.held, self.tenant, self.boost = search, Held(search, key), tenant, boost
        self.number = {x: i for i, x in enumerate(search.a.terms)}
        self.now, self.rows = None, []

    def done(self) -> None:
        if not self.rows:
            return
        head, *post = self.rows  # the empty term sorts first, the others ascend as their numbers do
        self.rows = []
        n, m = (np.zeros(len(self.number) + 1, np.int64) for _ in range(2))
        for r in post:
            i = self.number[r["term"]] + 1
            n[i], m[i] = len(r["rows"]), len(r["tops"])
        join = lambda f: np.concatenate([r[f] for r in post]) if post else np.empty(0, np.int64)
        chunk = pa.RecordBatch.from_struct_array(head["head"])
        s = Segment(np.cumsum(n), join("rows"), join("sat"), join("tops"), np.cumsum(m),
                    np.asarray(chunk.column("dt")).astype(float), added(chunk, self.boost))
        self.held.add(chunk, self.search.segment(s, self.search.a.columns(head["tenant"])))

    def add(self, batch: pa.RecordBatch) -> None:
        seg, term = np.asarray(batch.column("segment")), batch.column("term").to_pylist()
        lists = {f: (np.asarray(batch.column(f).offsets), np.asarray(batch.column(f).values)) for f in ("rows", "sat", "tops")}
        for i in range(batch.num_rows):
            if seg[i] != self.now:
                self.done()
                self.now = seg[i]
            if term[i] and term[i] not in self.number:
                continue
            row = {"term": term[i], **{f: v[o[i]:o[i + 1]] for f, (o, v) in lists.items()}}
            if not term[i]:
                row |= {"head": batch.column("head")[i].values, "tenant": batch.column(self.tenant)[i].as_py() if self.tenant else None}
            self.rows.append(row)


def met(batches: Iterator[pa.RecordBatch], k: int, bm25_weight: float, overlap_weight: float, qid: str, key: list[str], tenant: str | None,
        boost: str | None) -> Iterator[pa.RecordBatch]:
    """Best ``k`` of every query of every cell; a cell's query terms, of no segment, come before its postings. One cell's queries and one
    segment are held."""
    now, asked, walk = None, [], None

    def told():
        if walk:
            walk.done()
            yield from walk.held.batches(qid)
    for batch in batches:
        cell = np.asarray(batch.column("_cell"))
        cuts = np.r_[0, np.flatnonzero(np.diff(cell)) + 1, len(cell)] if len(cell) else [0]
        for i, j in zip(cuts[:-1], cuts[1:]):
            if cell[i] != now:
                yield from told()
                now, asked, walk = cell[i], [], None
            part = batch.slice(i, j - i)
            n = part.column("segment").null_count  # these sort first
            if n:
                asked.append(part.slice(0, n).select(list(dict.fromkeys([qid, *([tenant] if tenant else []), "term", "qd", "avgdl", "w"]))).to_pandas())
            if n < j - i and asked:
                walk = walk or Walk(Search(Asked.of(pd.concat(asked, ignore_index=True), qid, tenant), k, bm25_weight, overlap_weight), key, tenant, boost)
                walk.add(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in part.slice(n).columns], schema=part.schema))
    yield from told()


def by_tenant(batch: pa.RecordBatch, tenant: str | None) -> Iterator[tuple[object, pa.RecordBatch]]:
    """The rows of every tenant in a batch; without tenants the batch."""
    if not tenant:
        yield None, batch
        return
    code = batch.column(tenant).dictionary_encode()
    at = np.asarray(pc.fill_null(code.indices, -1))
    for i, value in enumerate(code.dictionary.to_pylist()):
        yield value, batch.take(pa.array(np.flatnonzero(at == i)))


def token_segment(batch: pa.RecordBatch, asked: Asked, terms: pa.Array, avgdl: float, boost: str | None) -> Segment:
    """A segment made on the spot from token lists; only the terms asked for are inverted."""
    at, rows, tf = counted(batch.column("toks"), terms)
    dl = np.asarray(pc.fill_null(batch.column("dl"), 0)).astype(float)
    sat = saturated(tf, dl[rows], avgdl)
    tops, tops_at = block_tops(at, sat)
    return Segment(at, rows, sat, tops, tops_at, np.asarray(pc.fill_null(batch.column("dt"), 0)).astype(float), added(batch, boost))


_WORD = bytes(i for i in range(128) if chr(i).isalnum() or i == 95)  # Latin letters, digits and _
_KIND = bytes(i in _WORD for i in range(256))
_LOWER = bytes(range(256)).lower()
_OTHER = bytes(i for i in range(256) if i not in _WORD)


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(tokens of all texts in order, their number by text): what ``tokens_of`` gives, read off the UTF-8 bytes of the column at once."""
    texts = pc.fill_null(texts, "")
    size = np.dtype(np.int64 if pa.types.is_large_string(texts.type) else np.int32)
    off = np.frombuffer(texts.buffers()[1], size, len(texts) + 1, texts.offset * size.itemsize) if len(texts) else np.zeros(1, size)
    if off[-1] == off[0]:
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    raw = texts.buffers()[2].slice(off[0], off[-1] - off[0]).to_pybytes()
    off = (off - off[0]).astype(np.int64)
    data, kind = np.frombuffer(raw, np.uint8), np.frombuffer(raw.translate(_KIND), np.uint8)
    lead = np.flatnonzero((data >= 0xEA) & (data <= 0xED))  # Hangul syllables are EA B0 80 to ED 9E A3
    if len(lead):
        kind, a, b, c = kind.copy(), data[lead], data[lead + 1], data[lead + 2]
        lead = lead[((a > 0xEA) | (b >= 0xB0)) & ((a < 0xED) | (b < 0x9E) | ((b == 0x9E) & (c <= 0xA3)))]
        for i in range(3):
            kind[lead + i] = 2
    change = kind[1:] != kind[:-1]
    inner = off[(off > 0) & (off < len(raw))]
    change[inner - 1] = True  # a token ends with its text
    edge = np.r_[0, np.flatnonzero(change) + 1, len(raw)]
    word = kind[edge[:-1]] != 0
    start = edge[:-1][word]
    at = np.r_[0, np.cumsum(edge[1:][word] - start)]
    kept = data[kind != 0].tobytes().lower() if len(lead) else raw.translate(_LOWER, _OTHER)
    large = len(kept) >= 1 << 31
    out = (pa.LargeStringArray if large else pa.StringArray).from_buffers(len(start), pa.py_buffer(at.astype(np.int64 if large else np.int32)), pa.py_buffer(kept))
    return out, np.diff(np.searchsorted(start, off))


def distinct(toks: pa.Array, number: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms; row, term number and count of every term of every text, by row; distinct terms by text) of tokens and their number by text."""
    code = toks.dictionary_encode()
    n = max(len(code.dictionary), 1)
    both, tf = np.unique(np.repeat(np.arange(len(number)) * n, number) + np.asarray(code.indices), return_counts=True)
    return code.dictionary, both // n, both % n, tf, np.bincount(both // n, minlength=len(number))


def text_segment(batch: pa.RecordBatch, text: str, asked: Asked, terms: pa.Array, avgdl: float, boost: str | None) -> Segment:
    """A segment made on the spot from texts; only the terms asked for are inverted."""
    n = batch.num_rows
    toks, dl = tokens(batch.column(text))
    have, row, term, tf, dt = distinct(toks, dl)
    number = np.asarray(pc.fill_null(pc.index_in(have, value_set=terms), -1)).astype(np.int64)[term]
    hit = number >= 0
    code, tf = number[hit] * n + row[hit], tf[hit].astype(float)
    o = np.argsort(code)
    code, tf = code[o], tf[o]
    at, rows = np.searchsorted(code, np.arange(len(terms) + 1) * n), code % max(n, 1)
    sat = saturated(tf, dl[rows].astype(float), avgdl)
    return Segment(at, rows, sat, *block_tops(at, sat), dt.astype(float), added(batch, boost))


PIECE = 2_048  # texts whose tokens are counted at once


def column_tokens(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``tokens`` of a column of texts, or those of a column of token lists."""
    if pa.types.is_list(column.type):
        return column.flatten(), np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    return tokens(column)


def token_lists(batches: Iterator[pa.RecordBatch], text: str, keep: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns ``keep`` with toks, dl and dt (token list, length, distinct count) of the texts; all three null for a null text."""
    for batch in batches:
        for i in range(0, batch.num_rows, PIECE):
            part = batch.slice(i, PIECE)
            texts = part.column(text)
            null = texts.is_null()
            toks, number = tokens(texts)
            dt = distinct(toks, number)[4]
            at = pa.array(np.r_[0, np.cumsum(number)].astype(np.int32))
            lists = pa.ListArray.from_arrays(at, toks.cast(pa.string()), mask=null if texts.null_count else None)
            mask = np.asarray(null)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), lists, pa.array(number, pa.int32(), mask=mask),
                                              pa.array(dt, pa.int32(), mask=mask)], [*keep, "toks", "dl", "dt"])


def text_counts(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """(term, df, dl_sum) of texts or token lists, combined over up to ``most`` terms; the row of the empty term counts texts and tokens.

    Null texts are not counted, and dl_sum is that of the empty term alone.
    """
    held, size, n, total = [], 0, 0, 0

    def combined():
        code = pa.concat_arrays([t for t, _ in held]).dictionary_encode()
        df = np.bincount(np.asarray(code.indices), np.concatenate([d for _, d in held]), len(code.dictionary))
        return code.dictionary, df.astype(np.int64)

    def told(terms, df):
        return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array([""]), terms]), pa.array(np.r_[n, df], pa.int64()),
                                           pa.array(np.r_[total, np.zeros(len(df), np.int64)], pa.int64())], ["term", "df", "dl_sum"])
    for batch in batches:
        step = max(1, min(PIECE, most // 8))
        for i in range(0, batch.num_rows, step):
            texts = batch.column(0).slice(i, step).drop_null()
            toks, number = column_tokens(texts)
            terms, _, term, _, _ = distinct(toks, number)
            n, total, size = n + len(texts), total + len(toks), size + len(terms)
            held.append((terms.cast(pa.string()), np.bincount(term, minlength=len(terms))))
            if size > most:
                held = [combined()]
                size = len(held[0][0])
                if size > most // 2:
                    yield told(*held[0])
                    held, size, n, total = [], 0, 0, 0
    if n:
        yield told(*combined())


def added(batch: pa.RecordBatch, boost: str | None) -> np.ndarray | None:
    """A chunk whose boost is null has no score and is not ranked."""
    return None if boost is None else np.asarray(pc.fill_null(batch.column(boost).cast(pa.float64()), -np.inf))


def inverted(column: pa.Array, avgdl: float) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms ascending, offsets, rows, impacts, distinct tokens by row) of all tokens of a column of texts or token lists."""
    toks, dl = column_tokens(column)
    terms, row, term, tf, dt = distinct(toks, dl)
    o = pc.array_sort_indices(terms)
    place = np.empty(len(terms), np.int64)
    place[np.asarray(o)] = np.arange(len(terms))
    term = place[term]
    by = np.argsort(term, kind="stable")
    rows = row[by]
    return terms.take(o), np.searchsorted(term[by], np.arange(len(terms) + 1)), rows, saturated(tf[by].astype(float), dl[rows].astype(float), avgdl), dt
