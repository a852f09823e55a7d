"""Repeated passages by collinear chaining of shared k-mer seeds.

Seeds are word k-mers chosen by winnowing: of every ``WINDOW`` neighbouring
k-mers the one with the least hash, so any ``K + WINDOW - 1`` words in common
share a seed. Every occurrence of a seed is linked to the first and to the last
text that holds it, never to all others, so links grow with the texts. The
matches of two texts are chained in order: a Fenwick tree gives the best chain
to go on from, at a cost for every word skipped. A chain is aligned word by
word with Myers' bit-parallel distance and grown at its ends.

A passage made of common lines may have other first and last holders for each
of its seeds. Stretches of repeated seeds that no passage covers are therefore
linked once more by longer keys, pairs and runs of neighbouring seeds, which
only texts with the same order of lines share (``_key_rows``).

First and last holders do not meet every partner. What passages have linked so
so far makes classes of stretches; two texts of one class at a place need no link
of their own there, like copies. The rest is exact: two seeds that lie near each
other are a key, and all its holders of unlike classes are compared, in cells of
bounded size (``_rest``). So any two holders of a key that make a passage around
it are of one class there.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from dossier.llm.common import byte_words, components, dropped, map_arrow, runs, shuffle_width, stored, utf8

K = 6
WINDOW = 8
MIN_WORDS = 50
SIMILARITY = 0.8
GAP = 0.15  # cost of each skipped word, on either side
EDGE = K + WINDOW  # a passage may reach this far beyond its outer seeds
MARGIN = 2 * EDGE
FAR = 4  # times the least words of a passage: the outer seeds of some part of it are no further apart
CELL = 2048  # holders of a key on either side of a cell
BINS = 64  # of the counts of words that bound a distance from below
MUL = np.uint64(0x9E3779B97F4A7C15)


def word_codes(text: bytes) -> np.ndarray:
    """16-bit hashes of the words."""
    h = xxhash.xxh32_intdigest
    known: dict[bytes, int] = {}
    words = byte_words(text)
    for w in words:
        if w not in known:
            known[w] = h(w) & 0xFFFF
    return np.fromiter(map(known.__getitem__, words), np.uint16, len(words))


def seeds(codes: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the winnowed k-mers; the rightmost of equal least hashes."""
    n = len(codes) - k + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = (h ^ codes[i:i + n].astype(np.uint64)) * MUL
            h ^= h >> np.uint64(29)
        h = (h ^ (h >> np.uint64(32))) * MUL
    w = min(window, n)
    view = np.lib.stride_tricks.sliding_window_view(h, w)[:, ::-1]
    at = np.unique(np.arange(n - w + 1) + (w - 1 - view.argmin(1)))
    return _numbered(at, h[at], window)


def _numbered(at: np.ndarray, h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a stretch that repeats itself (four or more equal seeds in a row), one seed per ``window`` words stays, told
    apart by its distance from the start of the stretch; else all of them would meet in one place."""
    new = np.r_[True, (h[1:] != h[:-1]) | (at[1:] - at[:-1] > window)]
    start = np.flatnonzero(new)
    size = np.diff(np.r_[start, len(at)])
    of = np.repeat(np.arange(len(start)), size)
    block = np.where(size[of] >= 4, (at - at[start][of]) // window, 0)
    keep = np.r_[True, (of[1:] != of[:-1]) | (block[1:] != block[:-1]) | (size[of[1:]] < 4)]
    with np.errstate(over="ignore"):
        return at[keep], (h ^ (block.astype(np.uint64) * MUL))[keep]


class Fenwick:
    """Prefix maximum over ranks, with the item that has it."""

    def __init__(self, n: int):
        self.value, self.item = [float("-inf")] * (n + 1), [-1] * (n + 1)

    def put(self, i: int, v: float, item: int) -> None:
        i += 1
        while i < len(self.value):
            if v > self.value[i]:
                self.value[i], self.item[i] = v, item
            i += i & -i

    def best(self, i: int) -> tuple[float, int]:
        """Over ranks below ``i``."""
        v, item = float("-inf"), -1
        while i > 0:
            if self.value[i] > v:
                v, item = self.value[i], self.item[i]
            i -= i & -i
        return v, item


def merged(q: np.ndarray, r: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds of one diagonal that touch or overlap become one match: starts on both sides and length."""
    o = np.lexsort((q, r - q))
    q, d = q[o], (r - q)[o]
    new = np.r_[True, (d[1:] != d[:-1]) | (q[1:] > q[:-1] + k + WINDOW)]
    s = np.flatnonzero(new)
    e = np.r_[s[1:], len(q)] - 1
    return q[s], q[s] + d[s], q[e] - q[s] + k


def chains(q: np.ndarray, r: np.ndarray, k: int = K, gap: float = GAP) -> list[tuple[int, int, int, int, list[int], list[int], list[int]]]:
    """(q start, q end, r start, r end) of the local chains of matches, best first, and their matches in order: starts
    on both sides and lengths; a match is in one chain."""
    q, r, n = merged(q, r, k)
    o = np.lexsort((r, q))
    q, r, n = q[o].tolist(), r[o].tolist(), n[o].tolist()
    ends = sorted({b + c for b, c in zip(r, n)})
    rank = {x: i for i, x in enumerate(ends)}
    tree, score, back = Fenwick(len(ends)), [0.0] * len(q), [-1] * len(q)
    waiting = sorted(range(len(q)), key=lambda i: q[i] + n[i])  # a match can be gone on from once it has ended
    w = 0
    import bisect
    for j in range(len(q)):
        while w < len(waiting) and q[waiting[w]] + n[waiting[w]] <= q[j]:
            i = waiting[w]
            tree.put(rank[r[i] + n[i]], score[i] + gap * (q[i] + n[i] + r[i] + n[i]), i)
            w += 1
        v, i = tree.best(bisect.bisect_right(ends, r[j]))
        gain = v - gap * (q[j] + r[j])
        score[j], back[j] = (n[j] + gain, i) if gain > 0 else (float(n[j]), -1)
    out, used = [], [False] * len(q)
    for j in sorted(range(len(q)), key=lambda i: -score[i]):
        if used[j]:
            continue
        i, of = j, [j]
        while True:
            used[i] = True
            if back[i] < 0 or used[back[i]]:
                break
            i = back[i]
            of.append(i)
        of.reverse()
        out.append((q[i], q[j] + n[j], r[i], r[j] + n[j], [q[x] for x in of], [r[x] for x in of], [n[x] for x in of]))
    return out


def distance(a: np.ndarray, b: np.ndarray) -> int:
    """Edit distance of two word sequences, bit-parallel."""
    m = len(a)
    if not m:
        return len(b)
    peq: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        peq[x] = peq.get(x, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    for x in b.tolist():
        eq = peq.get(x, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += 1 if ph & top else -1 if mh & top else 0
        ph, mh = (ph << 1 | 1) & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
    return score


def grown(a: np.ndarray, b: np.ndarray) -> int:
    """How far two sequences go on together from their starts: a match counts 1, a difference costs 2; the best prefix."""
    n = min(len(a), len(b), MARGIN)
    if not n:
        return 0
    s = np.cumsum(np.where(a[:n] == b[:n], 1, -2))
    best = int(s.argmax())
    return best + 1 if s[best] > 0 else 0


def _texts(docs: DataFrame, item: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            codes = [word_codes(t) for t in utf8(batch.column(2))]
            yield {"item": batch.column(0), "key": batch.column(1), "n": [len(c) for c in codes], "words": [c.tobytes() for c in codes]}
    kind = docs.schema[item].dataType.simpleString()
    return map_arrow(docs.select(F.col(item).alias("item"), F.col("_key").alias("key"), F.col(text).alias("text")).filter("text is not null"), run,
                     f"item {kind}, key string, n int, words binary")


def _seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        t = batch.column(0).to_numpy()
        got = [seeds(np.frombuffer(b, np.uint16)) for b in batch.column(1).to_pylist()]
        yield {"h": np.concatenate([h for _, h in got]).view(np.int64), "t": np.repeat(t, [len(p) for p, _ in got]),
               "pos": np.concatenate([p for p, _ in got]).astype(np.int32)}


STEPS = (1, 2, 3)  # a pair key is a seed and one of the next three
RUNS = (4, 8)  # a run key is this many neighbouring seeds


def _by_text(work):
    """``work`` on the rows of one text after another; batches are sorted by their first column, the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held = None
        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows = rows if held is None else np.concatenate([held, rows])
            if not len(rows):
                continue
            s, e = runs(rows[:, 0])
            held = rows[s[-1]:].copy()
            if len(s) > 1:
                yield work(rows[:s[-1]], s[:-1], e[:-1])
        if held is not None and len(held):
            yield work(held, *runs(held[:, 0]))
    return run


def _bare_rows(least: int):
    """Hashes of repeated seeds outside all passages, where such seeds make up a stretch of ``least`` words.

    Rows are (text, position, end, hash): a passage has an end, a seed has end 0.
    """
    def work(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict:
        out = [np.empty(0, np.int64)]
        for i, j in zip(starts, ends):
            pos, end = rows[i:j, 1], rows[i:j, 2]
            bare = (end == 0) & (np.maximum.accumulate(end) < pos + K)
            p, h = pos[bare], rows[i:j, 3][bare]
            if len(p) < 2:
                continue
            s = np.r_[0, np.flatnonzero(np.diff(p) > MARGIN) + 1]
            e = np.r_[s[1:], len(p)]
            wide = (p[e - 1] - p[s] + K >= least) & (e - s > 1)
            out += [h[x:y] for x, y in zip(s[wide], e[wide])]
        return {"h": np.unique(np.concatenate(out))}
    return _by_text(work)


def _key_rows(longest: int):
    """Keys over the seeds of a text in order, rows (text, position, hash): pairs at up to three steps, so a seed that
    an edit adds or takes away does no harm, and runs of four and eight; with the positions of their outer seeds."""
    def keys(h: np.ndarray, n: int, inner: bool) -> np.ndarray:
        k = np.full(len(h) - n, n * 2 + inner, np.uint64)
        for i in range(n + 1) if inner else (0, n):
            k = (k ^ h[i:len(h) - n + i]) * MUL
            k ^= k >> np.uint64(29)
        return k

    def work(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict:
        t, pos, h = rows[:, 0], rows[:, 1], np.ascontiguousarray(rows[:, 2]).view(np.uint64)
        out = []
        with np.errstate(over="ignore"):
            for n, inner in [(n, False) for n in STEPS] + [(n - 1, True) for n in RUNS]:
                if len(t) > n:
                    ok = (t[n:] == t[:-n]) & (pos[n:] - pos[:-n] <= longest)
                    out.append((keys(h, n, inner)[ok], t[:-n][ok], pos[:-n][ok], pos[n:][ok]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.uint64)] + [np.empty(0, np.int64)] * 3
        return {"h": cols[0].view(np.int64), "t": cols[1], "pos": cols[2].astype(np.int32), "pos2": cols[3].astype(np.int32)}
    return _by_text(work)


def _placed_rows(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict:
    """Rows of ``_laid`` with the node they lie in: the start of the overlapping passages around them, below 0 for a
    seed that no passage covers."""
    node = np.empty(len(rows), np.int64)
    for i, j in zip(starts, ends):
        pos, end = rows[i:j, 1], rows[i:j, 2]
        most = np.maximum.accumulate(end)
        new = (end > 0) & (pos >= np.r_[0, most[:-1]])
        start = np.maximum.accumulate(np.where(new, pos, -1))
        node[i:j] = np.where((end > 0) | (most >= pos + K), start, -1 - pos)
    return {"t": rows[:, 0], "pos": rows[:, 1], "node": node, "h": rows[:, 3], "seed": rows[:, 2] == 0}


def _far_rows(near: int, far: int):
    """Keys of any two seeds of a text that lie ``near`` to ``far`` words apart; rows are (text, position, hash, class)."""
    def work(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict:
        t, pos, h, c = rows.T
        h = np.ascontiguousarray(h).view(np.uint64)
        out, n = [[np.empty(0, np.int64)] * 6], 1
        with np.errstate(over="ignore"):
            while n < len(t):
                i = np.flatnonzero((t[n:] == t[:-n]) & (pos[n:] - pos[:-n] <= far))
                if not len(i):
                    break
                i = i[pos[i + n] - pos[i] >= near]
                k = (h[i] * MUL ^ h[i] >> np.uint64(29) ^ h[i + n]) * MUL
                out.append([(k ^ k >> np.uint64(31)).view(np.int64), t[i], pos[i], pos[i + n], c[i], c[i + n]])
                n += 1
        return dict(zip(("k", "t", "pos", "pos2", "c1", "c2"), (np.concatenate(x) for x in zip(*out))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for cols in _by_text(work)(batches):
            yield cols | {c: cols[c].astype(np.int32) for c in ("pos", "pos2")}
    return run


def _reach(same: np.ndarray) -> np.ndarray:
    """``grown`` of many pairs at once, from what is alike."""
    score = np.cumsum(np.where(same, np.int8(1), np.int8(-2)), axis=1, dtype=np.int8)
    best = score.argmax(1)
    return np.where(score[np.arange(len(best)), best] > 0, best + 1, 0)


def _cell(split: int, t, pos, pos2, c1, c2, at, w, min_words: int, similarity: float) -> list[tuple]:
    """Passages around one key between rows of unlike classes, as many as join the classes: rows before ``split`` with
    the others, or all with all if there are none before."""
    n, core = len(t), pos2 - pos + K
    words = [np.frombuffer(x, np.uint16) for x in w]
    around = np.repeat(-1 - np.arange(n, dtype=np.int32)[:, None], 64, axis=1)  # beyond the text no row is like another
    before, after = around[:, :MARGIN], around[:, MARGIN:2 * MARGIN]
    bag = np.empty((n, BINS), np.uint16)
    for i, (a, x, y) in enumerate(zip(words, pos - at, pos - at + core)):
        before[i, :x], after[i, :len(a) - y] = a[:x][::-1], a[y:]
        bag[i] = np.bincount(a[x:y] % BINS, minlength=BINS)
    root: dict = {}

    def find(x):
        while x in root:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    out, every = [], np.arange(n)
    for i in range(split or n):
        j = every[split or i + 1:]
        j = j[(c1[j] != c1[i]) & (c2[j] != c2[i]) & (t[j] != t[i])]
        # What cannot become a passage: one side too short, too few words alike to grow by, too many left over in bags.
        j = j[np.minimum(core[i], core[j]) + 2 * MARGIN >= (np.maximum(core[i], core[j]) + 2 * MARGIN) * similarity]
        alike = np.bitwise_count(np.packbits(around[j] == around[i], axis=1).view(np.uint64)[:, 0]).astype(np.int64)
        j = j[3 * alike >= 2 * (min_words - np.maximum(core[i], core[j]))]
        apart = np.maximum(core[i], core[j]) - np.minimum(bag[i], bag[j]).sum(1, dtype=np.int64)
        ok = 1 - apart / (np.maximum(core[i], core[j]) + 2 * MARGIN) >= similarity
        j, apart = j[ok], apart[ok]
        if not len(j):
            continue
        before_j, after_j = _reach(before[j] == before[i]), _reach(after[j] == after[i])
        size, least = np.maximum(core[i], core[j]) + before_j + after_j, np.minimum(core[i], core[j]) + before_j + after_j
        ok = (size >= min_words) & (least >= np.maximum(min_words, size) * similarity) & (1 - apart / size >= similarity)
        for j, size, x, y in zip(*(x[ok].tolist() for x in (j, size, before_j, after_j))):
            links = [(a, b) for s, c in ((1, c1), (2, c2)) if (a := find((s, c[i]))) != (b := find((s, c[j])))]
            if not links:
                continue
            p, q = (i, j) if t[i] < t[j] else (j, i)
            q0, q1, r0, r1 = (int(v) for o in (p, q) for v in (pos[o] - x, pos[o] + core[o] + y))
            d = distance(words[p][q0 - at[p]:q1 - at[p]], words[q][r0 - at[q]:r1 - at[q]])
            if 1 - d / size >= similarity:
                out.append((int(t[p]), int(t[q]), q0, q1, r0, r1, d))
                root.update(links)
    return out


def _compared(min_words: int, similarity: float):
    """Rows sorted by cell (k, lo, hi) and group to passages; a task holds one cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        def work(table: pa.Table) -> list[tuple]:
            lo, hi, g, *cols = (table.column(i).to_numpy() for i in range(1, 10))
            split = int((g == lo[0]).sum()) if lo[0] < hi[0] else 0
            if lo[0] < hi[0] and split in (0, len(g)):
                return []
            return _cell(split, *(c.astype(np.int64) for c in cols), table.column(10).to_pylist(), min_words, similarity)

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            if not table.num_rows:
                continue
            s, e = runs(np.column_stack([table.column(i).to_numpy() for i in range(3)]))
            held, out = table.slice(s[-1]), [x for i, j in zip(s[:-1], e[:-1]) for x in work(table.slice(i, j - i))]
            yield dict(zip(("t", "u", "q0", "q1", "r0", "r1", "d"), zip(*out) if out else ([],) * 7))
        out = work(held) if held is not None else []
        yield dict(zip(("t", "u", "q0", "q1", "r0", "r1", "d"), zip(*out) if out else ([],) * 7))
    return run


def _chain_rows(least: int):
    """Matches sorted by (t, u) to chains that span at least ``least`` words on both sides."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held = np.empty((0, 4), np.int64)

        def work(rows: np.ndarray) -> dict:
            s, e = runs(rows[:, :2])
            lo = np.minimum.reduceat(rows[:, 2], s)
            hi = np.maximum.reduceat(rows[:, 2], s)
            out = [(*rows[i, :2].tolist(), *c) for i, j in zip(s[(e - s > 1) & (hi - lo + K >= least)], e[(e - s > 1) & (hi - lo + K >= least)])
                   for c in chains(rows[i:j, 2], rows[i:j, 3]) if c[1] - c[0] >= least and c[3] - c[2] >= least]
            return dict(zip(("t", "u", "q0", "q1", "r0", "r1", "qs", "rs", "ns"), zip(*out) if out else ([],) * 9))
        for batch in batches:
            rows = np.concatenate([held, np.column_stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)])])
            if not len(rows):
                continue
            last = runs(rows[:, :2])[0][-1]
            held = rows[last:].copy()
            if last:
                yield work(rows[:last])
        if len(held):
            yield work(held)
    return run


def _aligned(min_words: int, similarity: float):
    """Chains to passages. A chain under ``similarity`` is cut at its widest gap and its parts are judged in its place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        names = ["t", "u", "qs", "rs", "ns", "qa", "ra", "qw", "rw"]
        for batch in batches:
            out = []
            for t, u, qs, rs, ns, qa, ra, qw, rw in zip(*(batch.column(n).to_pylist() for n in names)):
                a, b = np.frombuffer(qw, np.uint16), np.frombuffer(rw, np.uint16)
                parts = [(0, len(qs))]
                while parts:
                    i, j = parts.pop()
                    q0, q1, r0, r1 = qs[i], qs[j - 1] + ns[j - 1], rs[i], rs[j - 1] + ns[j - 1]
                    left = grown(a[:q0 - qa][::-1], b[:r0 - ra][::-1])
                    right = grown(a[q1 - qa:], b[r1 - ra:])
                    q0, q1, r0, r1 = q0 - left, q1 + right, r0 - left, r1 + right
                    size, least = max(q1 - q0, r1 - r0), min(q1 - q0, r1 - r0)
                    if size < min_words or (i + 1 == j and least < min_words * similarity):
                        continue  # no part is longer
                    if least >= max(min_words, size) * similarity:
                        d = distance(a[q0 - qa:q1 - qa], b[r0 - ra:r1 - ra])
                        if 1 - d / size >= similarity:
                            out.append((t, u, q0, q1, r0, r1, d))
                            continue
                    if j - i > 1:
                        wide = max(range(i + 1, j), key=lambda x: max(qs[x] - qs[x - 1] - ns[x - 1], rs[x] - rs[x - 1] - ns[x - 1]))
                        parts += [(i, wide), (wide, j)]
            yield dict(zip(("t", "u", "q0", "q1", "r0", "r1", "d"), zip(*out) if out else ([],) * 7))
    return run


def repeated(docs: DataFrame, item: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
             similarity: float = SIMILARITY) -> DataFrame:
    """(item, other, kind, start, end, other_start, other_end, distance): where texts repeat, in words.

    ``copy`` rows name, for every further row of a text of ``min_words`` words or
    more, the row that stands for all its copies. ``passage`` rows are between
    rows that stand for their text: a stretch of ``min_words`` words or more of
    either and one of the other, at an edit distance of at most 1 - ``similarity``
    of the longer. Null texts and texts without words have no rows; rows with a
    null item take part and stand for their text only if no other can. Repeated
    rows are copies. Other columns are not read.
    """
    keyed = docs.select(F.col(item).alias(item), F.col(text).alias(text), F.md5(F.col(text).cast("binary")).alias("_key"))
    own = _texts(keyed, item, text).groupBy("key").agg(F.min("item").alias("item"), F.first("n").alias("n"), F.first("words").alias("words"),
                                                       F.count(F.lit(1)).alias("rows"))
    texts = stored(own.withColumn("t", F.monotonically_increasing_id()))
    found = stored(map_arrow(texts.filter(F.col("n") >= min_words * similarity).select("t", "words"), _seed_rows, "h long, t long, pos int"))
    ends = stored(_holders(found))
    held = stored(found.join(ends, "h"))
    dropped(found)
    dropped(ends)
    spans = _spans(held, texts, min_words, similarity, max(2, min_words - 2 * EDGE))
    # A key is an order of seeds already, so its two ends are chain enough; the alignment grows it to its size.
    spans = stored(spans.union(_spans(_relinked(held, spans, min_words), texts, min_words, similarity, K + 1)).distinct())
    spans = spans.union(_rest(held, spans, texts, min_words, similarity))
    names = texts.select("t", "item")
    cols = [F.col(c).alias(n) for c, n in (("q0", "start"), ("q1", "end"), ("r0", "other_start"), ("r1", "other_end"), ("d", "distance"))]
    passages = spans.join(names, "t").withColumnRenamed("item", "_i").join(names.withColumnRenamed("t", "u"), "u").select(
        F.col("_i").alias(item), F.col("item").alias("other"), F.lit("passage").alias("kind"), *cols)
    return passages.unionByName(_copies(keyed, texts, item, min_words))


def _holders(found: DataFrame, *more: str) -> DataFrame:
    """First and last place of every hash that two texts hold."""
    at = F.struct("t", "pos", *more)
    return found.groupBy("h").agg(F.min(at).alias("a"), F.max(at).alias("b")).filter("a.t <> b.t")


def _spans(linked: DataFrame, texts: DataFrame, min_words: int, similarity: float, least: int) -> DataFrame:
    """Passages (t, u, q0, q1, r0, r1, d) of texts linked at places (t, pos) to first and last holders ``a`` and ``b``,
    from chains of ``least`` words or more."""
    pairs = linked.select("t", "pos", F.explode(F.array("a", "b")).alias("o")).select(
        "t", F.col("o.t").alias("u"), "pos", F.col("o.pos").alias("opos")).filter("t <> u")
    # The smaller number first: a pair of texts is one group whichever of them the link came from.
    flip = F.col("t") < F.col("u")
    pairs = pairs.select(F.when(flip, F.col("u")).otherwise(F.col("t")).alias("t"), F.when(flip, F.col("t")).otherwise(F.col("u")).alias("u"),
                         F.when(flip, F.col("opos")).otherwise(F.col("pos")).alias("q"), F.when(flip, F.col("pos")).otherwise(F.col("opos")).alias("r"))
    width = shuffle_width(texts.sparkSession)
    chained = stored(map_arrow(pairs.repartition(width, "t", "u").sortWithinPartitions("t", "u", "q", "r"), _chain_rows(least),
                               "t long, u long, q0 int, q1 int, r0 int, r1 int, qs array<int>, rs array<int>, ns array<int>").distinct())
    piece = lambda s, e: F.substring("words", 2 * s + 1, 2 * (e - s))
    words = texts.select("t", "words")
    first = chained.join(words, "t").select(*chained.columns, F.greatest(F.col("q0") - MARGIN, F.lit(0)).alias("qa"),
                                            piece(F.greatest(F.col("q0") - MARGIN, F.lit(0)), F.col("q1") + MARGIN).alias("qw"))
    both = first.join(words.withColumnRenamed("t", "u"), "u").select(*first.columns, F.greatest(F.col("r0") - MARGIN, F.lit(0)).alias("ra"),
                                                                   piece(F.greatest(F.col("r0") - MARGIN, F.lit(0)), F.col("r1") + MARGIN).alias("rw"))
    spans = stored(map_arrow(both, _aligned(min_words, similarity), "t long, u long, q0 int, q1 int, r0 int, r1 int, d int").distinct())
    dropped(chained)
    return spans


def _laid(held: DataFrame, spans: DataFrame) -> DataFrame:
    """Repeated seeds (end 0) and passages of every text by position; a passage comes before the seed at its start.

    Intervals of a text are merged by start first: a text that many others share
    has no more of them than words.
    """
    sides = spans.select("t", F.col("q0").alias("pos"), F.col("q1").alias("end")).union(spans.select("u", "r0", "r1"))
    cover = sides.groupBy("t", "pos").agg(F.max("end").alias("end")).select(*(F.col(c).cast("long") for c in ("t", "pos", "end")), F.lit(0).cast("long").alias("h"))
    seeded = held.select("t", F.col("pos").cast("long").alias("pos"), F.lit(0).cast("long").alias("end"), "h")
    return seeded.union(cover).repartition(shuffle_width(held.sparkSession), "t").sortWithinPartitions("t", "pos", F.desc("end"))


def _relinked(held: DataFrame, spans: DataFrame, min_words: int) -> DataFrame:
    """Links by longer keys for what no passage covers.

    The seeds of bare stretches are looked up in all texts, covered or not, so a
    partner is found wherever it lies.
    """
    width = shuffle_width(held.sparkSession)
    bare = stored(map_arrow(_laid(held, spans), _bare_rows(max(2, min_words - 2 * EDGE)), "h long").distinct())
    seeded = held.join(bare, "h").select("t", F.col("pos").cast("long").alias("pos"), "h")
    keys = stored(map_arrow(seeded.repartition(width, "t").sortWithinPartitions("t", "pos"), _key_rows(2 * min_words),
                            "h long, t long, pos int, pos2 int"))
    both = keys.join(_holders(keys, "pos2"), "h")
    at = lambda o, p: F.struct(F.col(f"{o}.t").alias("t"), F.col(f"{o}.{p}").alias("pos"))
    # Either outer seed of a key is a match.
    return both.select("t", F.explode(F.array(*(F.struct(F.col(p).alias("pos"), at("a", p).alias("a"), at("b", p).alias("b"))
                                                for p in ("pos", "pos2")))).alias("m")).select("t", "m.*")


def _rest(held: DataFrame, spans: DataFrame, texts: DataFrame, min_words: int, similarity: float) -> DataFrame:
    """Passages between stretches that ``spans`` leave in unlike classes, from all holders of every key of two seeds."""
    width = shuffle_width(held.sparkSession)
    placed = stored(map_arrow(_laid(held, spans), _by_text(_placed_rows), "t long, pos long, node long, h long, seed boolean"))
    of = F.xxhash64("t", "node")
    starts = placed.filter("not seed").select("t", "pos", of.alias("x"))
    edges = spans.join(starts.withColumnRenamed("pos", "q0"), ["t", "q0"]).select("u", "r0", "x").join(
        starts.select(F.col("t").alias("u"), F.col("pos").alias("r0"), F.col("x").alias("y")), ["u", "r0"])
    classes = components(edges, "x", "y").withColumnRenamed("node", "x")
    seeded = placed.filter("seed").select("t", "pos", "h", of.alias("x")).join(classes, "x", "left").select(
        "t", "pos", "h", F.coalesce("root", "x").alias("c"))
    # A seed whose holders are all of one class has nothing left to link.
    unlike = seeded.groupBy("h").agg(F.min("c").alias("a"), F.max("c").alias("b")).filter("a <> b").select("h")
    left = seeded.join(unlike, "h").select("t", "pos", "h", "c")
    keys = stored(map_arrow(left.repartition(width, "t").sortWithinPartitions("t", "pos"), _far_rows(max(K, min_words - 2 * EDGE - K), FAR * min_words),
                            "k long, t long, pos int, pos2 int, c1 long, c2 long"))
    ends = [f(c).alias(f"{n}{c}") for c in ("c1", "c2") for n, f in (("a", F.min), ("b", F.max))]
    many = keys.groupBy("k").agg(F.count(F.lit(1)).alias("n"), *ends).filter("ac1 <> bc1 and ac2 <> bc2").select(
        "k", F.ceil(F.col("n") / CELL).alias("groups"))
    begin = F.greatest(F.col("pos") - MARGIN, F.lit(0))
    rows = keys.join(many, "k").join(texts.select("t", "words"), "t").select(
        "k", F.pmod(F.xxhash64("t"), F.col("groups")).alias("g"), "groups", "t", "pos", "pos2", "c1", "c2", begin.alias("at"),
        F.substring("words", 2 * begin + 1, 2 * (F.col("pos2") + K + MARGIN - begin)).alias("w"))
    met = rows.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).select(
        "k", F.least("g", "o").alias("lo"), F.greatest("g", "o").alias("hi"), "g", "t", "pos", "pos2", "c1", "c2", "at", "w")
    cells = met.repartition(width, "k", "lo", "hi").sortWithinPartitions("k", "lo", "hi", "g", "t", "pos")
    rest = stored(map_arrow(cells, _compared(min_words, similarity), "t long, u long, q0 int, q1 int, r0 int, r1 int, d int").distinct())
    dropped(placed)
    dropped(keys)
    return rest


def _copies(keyed: DataFrame, texts: DataFrame, item: str, min_words: int) -> DataFrame:
    """One row for every row beyond the one that stands for its text."""
    many = texts.filter((F.col("rows") > 1) & (F.col("n") >= min_words)).select(F.col("key").alias("_key"), F.col("item").alias("other"), "n")
    rows = keyed.select(item, "_key").join(many, "_key")
    same = rows.filter(F.col(item).eqNullSafe(F.col("other"))).groupBy(item, "_key", "other", "n").agg(F.count(F.lit(1)).alias("k"))
    further = same.select(item, "other", "n", F.explode(F.when(F.col("k") > 1, F.sequence(F.lit(2), F.col("k")))).alias("k")).drop("k")
    every = rows.filter(~F.col(item).eqNullSafe(F.col("other"))).select(item, "other", "n").union(further)
    zero = F.lit(0)
    return every.select(item, "other", F.lit("copy").alias("kind"), zero.alias("start"), F.col("n").alias("end"), zero.alias("other_start"),
                        F.col("n").alias("other_end"), zero.alias("distance"))
