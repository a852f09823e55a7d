"""SimHash near-duplicates by covering locality-sensitive hashing.

Bit i of a fingerprint gets a non-zero code m(i) of radius + 1 bits. Table v
(v = 1 .. 2^(radius+1) - 1) keeps the bits whose code has an odd inner product
with v. The codes of any ``radius`` differing bits leave some v orthogonal to
all of them, so every pair within the radius agrees in some table: nothing is
lost to chance.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from dossier.llm.common import byte_words, components, dropped, few, fresh, map_arrow, runs, shuffle_width, stored, utf8, worker_cache

BITS = 64
SEED = 42
RUN_LIMIT = 4096  # distinct fingerprints of one bucket compared in memory; larger buckets are linked through variants


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the space-joined word shingles, repeats included; fewer words give one shingle."""
    t = byte_words(text)
    if not t:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*(t[i:] for i in range(words)))) if len(t) >= words else [b" ".join(t)]
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(g, SEED) for g in grams), np.uint64, max(1, len(t) - words + 1))


def majority_bits(hashes: np.ndarray) -> int:
    """Bit is 1 if it is set in over half the hashes; no hashes give 0."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 18):
        ones += np.unpackbits(hashes[i:i + (1 << 18)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column, words: int = 3) -> Column:
    """64-bit SimHash of word shingles as long. Null and wordless texts: 0."""
    def of(col: pa.Array) -> pa.Array:
        return pa.array(np.array([majority_bits(shingle_hashes(t or b"", words)) for t in utf8(col)], np.uint64).view(np.int64))
    return F.arrow_udf(of, "long")(text)


def table_masks(radius: int, bits: int = BITS) -> list[int]:
    """The kept bits of each covering table, as signed 64-bit integers."""
    codes = [i % (2 ** (radius + 1) - 1) + 1 for i in range(bits)]
    masks = [sum(1 << i for i, m in enumerate(codes) if (m & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _tree(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the graph 'at most ``radius`` differing bits'.

    Breadth first: each fingerprint is compared once with what is not reached yet.
    """
    left, pa_, ch = np.arange(1, len(x)), [], []
    queue = [0]
    while True:
        while queue:
            u = queue.pop()
            if not len(left):
                break
            near = np.bitwise_count(x[left] ^ x[u]) <= radius
            hit = left[near]
            if len(hit):
                left = left[~near]
                pa_.append(np.full(len(hit), u))
                ch.append(hit)
                queue.extend(hit.tolist())
        if not len(left):
            break
        queue, left = [int(left[0])], left[1:]
    none = np.empty(0, np.int64)
    return (np.concatenate(pa_) if pa_ else none), (np.concatenate(ch) if ch else none)


def _bucket_edges(radius: int, limit: int, complete: int = 0):
    """Batches sorted by (v, key, fp) to spanning edges of each bucket; rows of buckets over ``limit`` come back marked.

    Buckets of up to ``complete`` fingerprints give all their links instead.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held = np.empty((0, 3), np.int64)  # the last bucket seen may go on
        hot = None

        def work(rows: np.ndarray) -> dict:
            s, e = runs(rows[:, :2])
            n, x = e - s, rows[:, 2].view(np.uint64) if rows.flags.c_contiguous is False else np.ascontiguousarray(rows[:, 2]).view(np.uint64)
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            two = s[n == 2]
            ok = np.bitwise_count(x[two] ^ x[two + 1]) <= radius
            a.append(two[ok]); b.append(two[ok] + 1)  # noqa: E702
            for i in np.flatnonzero(n > 2):
                y = x[s[i]:e[i]]
                p, c = np.nonzero(np.triu(np.bitwise_count(y[:, None] ^ y[None, :]) <= radius, 1)) if len(y) <= complete else _tree(y, radius)
                a.append(p + s[i]); b.append(c + s[i])  # noqa: E702
            ia, ib = np.concatenate(a), np.concatenate(b)
            f = x.view(np.int64)
            return {"v": rows[ia, 0].astype(np.int32), "a": f[ia], "b": f[ib], "hot": np.zeros(len(ia), bool)}

        def marked(rows: np.ndarray) -> dict:
            return {"v": rows[:, 0].astype(np.int32), "a": rows[:, 2].copy(), "b": rows[:, 2].copy(), "hot": np.ones(len(rows), bool)}

        for batch in batches:
            rows = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            if not len(rows):
                continue
            rows = np.concatenate([held, rows]) if len(held) else rows
            if hot is not None:  # go on with a bucket that is over the limit
                same = (rows[:, 0] == hot[0]) & (rows[:, 1] == hot[1])
                if same.any():
                    yield marked(rows[same])
                rows = rows[~same]
                held = rows[:0]
                if not len(rows):
                    continue
                hot = None
            s, e = runs(rows[:, :2])
            big = np.flatnonzero(e - s > limit)
            keep = np.ones(len(rows), bool)
            for i in big:
                yield marked(rows[s[i]:e[i]])
                keep[s[i]:e[i]] = False
            if len(big) and big[-1] == len(s) - 1:
                hot, held = rows[-1, :2].copy(), rows[:0]
                rows = rows[keep]
            else:
                last = s[-1]
                held = rows[last:].copy()
                rows = rows[:last][keep[:last]]
            if len(rows):
                yield work(rows)
        if len(held):
            yield work(held)
    return run


def _variants(masks: list[int], bits: int = BITS):
    """Each fingerprint of a large bucket with up to two of the bits its table drops flipped."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        flips = {}
        for v, m in enumerate(masks, 1):
            free = [1 << i for i in range(bits) if not (m >> i) & 1]
            one = [0, *free]
            two = [p | q for i, p in enumerate(free) for q in free[:i]]
            flips[v] = np.array(one + two, np.uint64), np.r_[np.ones(len(one), bool), np.zeros(len(two), bool)]
        for batch in batches:
            fp, v = batch.column("a").to_numpy().view(np.uint64), batch.column("v").to_numpy()
            for w in np.unique(v):
                f, near = flips[int(w) % len(masks) + 1]
                mine = fp[v == w]
                for i in range(0, len(mine), 512):
                    z = mine[i:i + 512, None] ^ f[None, :]
                    yield {"v": np.full(z.size, w, np.int32), "z": z.ravel().view(np.int64),
                           "fp": np.repeat(mine[i:i + 512], len(f)).view(np.int64), "near": np.tile(near, len(z))}
    return run


def covering_edges(points: DataFrame, fp: str = "fp", radius: int = 3, limit: int = RUN_LIMIT, family: str | None = None,
                   complete: int = 0) -> DataFrame:
    """(family, a, b) edges whose components are those of 'at most ``radius`` (3) differing bits' over distinct ``points[fp]``.

    Every bucket up to ``limit`` fingerprints gives a spanning forest of its true
    links, never all its pairs (all links in buckets of up to ``complete``). A
    larger bucket is linked in linear work: two fingerprints differ in at most 3
    bits exactly when some z is at most 1 flip from one and 2 flips from the
    other, so everything that reaches z is tied to one fingerprint that reaches z
    with at most one flip. ``family`` names an integer column: fingerprints meet
    those of their own family; without it all are family 0.
    """
    if radius != 3:
        raise ValueError("the linear way for large buckets is written for radius 3")
    masks = table_masks(radius)
    rows = points.select((F.col(family).cast("int") if family else F.lit(0)).alias("f"), F.col(fp).alias("fp")).select(
        "f", "fp", F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                                       for v, m in enumerate(masks)])).alias("t"))
    rows = rows.select((F.col("f") * len(masks) + F.col("t.v")).alias("v"), F.col("t.key").alias("key"), "fp") \
        .repartition(shuffle_width(points.sparkSession), "v", "key").sortWithinPartitions("v", "key", "fp")
    found = stored(map_arrow(rows, _bucket_edges(radius, limit, complete), "v int, a long, b long, hot boolean"))
    of = F.floor(F.col("v") / len(masks)).cast("int").alias("family")
    edges, hot = found.filter("not hot").select(of, "a", "b"), found.filter("hot")
    if hot.isEmpty():
        return edges
    z = map_arrow(hot.select("a", "v"), _variants(masks), "v int, z long, fp long, near boolean")
    centre = z.filter("near").groupBy("v", "z").agg(F.min("fp").alias("c"))
    return edges.union(z.join(centre, ["v", "z"]).filter("fp <> c").select(of, F.col("c").alias("a"), F.col("fp").alias("b")).distinct())


def groups(points: DataFrame, item: str = "doc_id", fp: str = "fp", radius: int = 3, limit: int = RUN_LIMIT) -> DataFrame:
    """(fp, component): per distinct fingerprint the smallest ``item`` of all rows reachable over links.

    Copies share a fingerprint and are one node. Null items count as absent; a
    component of null items only has a null id.
    """
    nodes = points.groupBy(F.col(fp).alias("fp")).agg(F.min(item).alias("first"))
    nodes = stored(nodes)
    roots = components(covering_edges(nodes, "fp", radius, limit)).select(F.col("node").alias("fp"), "root")
    of = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = of.groupBy("root").agg(F.min("first").alias("component"))
    return of.join(lows, "root").select("fp", "component")


def near_duplicates(docs: DataFrame, item: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3,
                    limit: int = RUN_LIMIT) -> DataFrame:
    """(item, fingerprint, component_id) for every row of ``docs``; links are ``radius`` or fewer differing bits.

    Null and wordless texts have fingerprint 0 and link like any other. Repeated
    rows stay repeated. Rows with a null item take part and get the smallest
    non-null item they reach, else null. Other columns are not read.
    """
    fp = fresh(docs, "_fp")
    marked = stored(docs.select(F.col(item).alias(item), fingerprint(F.col(text), words).alias(fp)))
    comp = groups(marked, item, fp, radius, limit)
    return marked.join(comp.withColumnRenamed("fp", fp), fp, "left").select(
        item, F.lpad(F.lower(F.hex(fp)), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


# ---- groups by Jaccard similarity of shingle sets ----------------------------
FAMILIES = 6
SHINGLE = 5
SIMILARITY = 0.8
COMPLETE = 16
PAIRS = 64  # texts of one rare shingle that are paired; more are compared in blocks
BLOCK = 256  # texts of a block
COMMON = 1 << 20  # common shingles known to every task


def family_table(families: int = FAMILIES, seed: int = 11) -> np.ndarray:
    """Random bits of every 16-bit word code, one 64-bit number per family."""
    return np.random.default_rng(seed).integers(0, 1 << 63, (1 << 16, families), dtype=np.uint64) << np.uint64(1) \
        ^ np.random.default_rng(seed + 1).integers(0, 1 << 63, (1 << 16, families), dtype=np.uint64)


def family_fingerprints(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """One SimHash per family over the distinct words of a text."""
    u = np.unique(codes)
    ones = np.zeros(table.shape[1] * BITS, np.int64)
    for i in range(0, len(u), 1 << 12):
        ones += np.unpackbits(table[u[i:i + (1 << 12)]].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(u), bitorder="little").view(np.int64)


def shingle_set(codes: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Distinct shingles of ``k`` words; a shorter text is one shingle, no words give none."""
    n = max(1, len(codes) - k + 1) if len(codes) else 0
    h = np.full(n, len(codes) if len(codes) < k else k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(k, len(codes))):
            h = (h ^ (codes[i:i + n].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return np.unique(h)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def prefix(h: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a sorted set, rare before common: two sets of ``similarity`` or more share one of these.

    They share at least ``similarity`` of the larger set, so one shared shingle
    comes before the last ceil(similarity x n) - 1, whatever the fixed order is.
    """
    late = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h if len(common) else np.zeros(len(h), bool)
    return np.concatenate([h[~late], h[late]])[:len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1]


def common_shingles(texts: DataFrame) -> np.ndarray:
    """Sorted shingles met often inside tasks. They only order the prefixes: any choice gives the same links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        def counted(sets: list[np.ndarray]) -> dict:
            h, n = np.unique(np.concatenate(sets), return_counts=True)
            return {"h": h[n > 2].view(np.int64), "n": n[n > 2]}
        held, size = [], 0
        for batch in batches:
            for w in batch.column(0).to_pylist():
                held.append(shingle_set(np.frombuffer(w, np.uint16)))
                size += len(held[-1])
                if size > 1 << 21:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)
    n = map_arrow(texts.select("words"), run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n >= 16")
    return np.sort(n.orderBy(F.desc("n"), "h").limit(COMMON).select("h").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))


def _prefix_pairs(similarity: float):
    """Rows (h, t, root, n, pos) sorted by h to pairs of texts of unlike root; those of over ``PAIRS`` texts come back marked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held, hot = np.empty((0, 5), np.int64), None

        def marked(rows: np.ndarray) -> dict:
            return {"a": rows[:, 1].copy(), "b": rows[:, 1].copy(), "h": rows[:, 0].copy(), "pos": rows[:, 4].astype(np.int32), "hot": np.ones(len(rows), bool)}

        def work(rows: np.ndarray) -> Iterator[dict]:
            s, e = runs(rows[:, 0])
            size = np.repeat(e - s, e - s)
            if (size > PAIRS).any():
                yield marked(rows[size > PAIRS])
            rows = rows[(size > 1) & (size <= PAIRS)]
            out = [np.empty((0, 2), np.int64)]
            for k in range(1, min(PAIRS, len(rows))):
                x, y = rows[:-k], rows[k:]
                same = x[:, 0] == y[:, 0]
                if not same.any():
                    break
                # What both can still share from their first common shingle on.
                left = np.minimum(x[:, 3] - x[:, 4], y[:, 3] - y[:, 4])
                ok = same & (x[:, 2] != y[:, 2]) & (left * (1 + similarity) >= similarity * (x[:, 3] + y[:, 3]) - 1e-6)
                out.append(np.column_stack([x[ok, 1], y[ok, 1]]))
            p = np.unique(np.sort(np.concatenate(out), axis=1), axis=0)
            yield {"a": p[:, 0].copy(), "b": p[:, 1].copy(), "h": np.zeros(len(p), np.int64), "pos": np.zeros(len(p), np.int32), "hot": np.zeros(len(p), bool)}

        for batch in batches:
            rows = np.column_stack([batch.column(i).to_numpy().astype(np.int64) for i in range(5)])
            if hot is not None and len(rows):
                same = rows[:, 0] == hot
                if same.any():
                    yield marked(rows[same])
                    rows = rows[~same]
            rows = np.concatenate([held, rows])
            if not len(rows):
                continue
            last = runs(rows[:, 0])[0][-1]
            held = rows[last:].copy()
            if len(held) > PAIRS:
                hot = held[0, 0]
                yield marked(held)
                held = held[:0]
            if last:
                yield from work(rows[:last])
        if len(held):
            yield from work(held)
    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share: rare elements by their pairs, the others as a matrix product."""
    m = len(sets)
    of = np.repeat(np.arange(m), [len(x) for x in sets])
    h = np.concatenate(sets) if m else np.empty(0, np.uint64)
    o = np.argsort(h, kind="stable")
    h, of = h[o], of[o]
    s, e = runs(h)
    df = np.repeat(e - s, e - s)
    out = np.zeros((m, m), np.float32)
    x, y = h[(df > 1) & (df <= 16)], of[(df > 1) & (df <= 16)]
    for k in range(1, min(16, len(x))):
        same = x[:-k] == x[k:]
        out += np.bincount(y[:-k][same] * m + y[k:][same], minlength=m * m).reshape(m, m)
    out += out.T
    no, rows = np.unique(h[df > 16], return_inverse=True)[1], of[df > 16]
    for i in range(0, int(no.max()) + 1 if len(no) else 0, 2048):
        here = (no >= i) & (no < i + 2048)
        has = np.zeros((m, 2048), np.float32)
        has[rows[here], no[here] - i] = 1
        out += has @ has.T
    return out


def _block_links(similarity: float):
    """Rows (h, i, j, t, root, words) sorted by (h, i, j): a spanning forest of the links between unlike roots of each block pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        def work(rows: list[tuple]) -> dict:
            t, root = (np.array([r[k] for r in rows], np.int64) for k in (3, 4))
            sets = [shingle_set(np.frombuffer(r[5], np.uint16)) for r in rows]
            n = np.array([len(x) for x in sets], np.float64)
            both = overlaps(sets).astype(np.float64)
            near = (both / np.maximum(n[:, None] + n[None, :] - both, 1) >= similarity) & (root[:, None] != root[None, :])
            left, a, b = np.ones(len(rows), bool), [], []
            for start in range(len(rows)):
                queue = [start] if left[start] else []
                left[start] = False
                while queue:
                    u = queue.pop()
                    hit = np.flatnonzero(near[u] & left)
                    left[hit] = False
                    a += [u] * len(hit)
                    b += hit.tolist()
                    queue += hit.tolist()
            return {"a": t[np.array(a, np.int64)], "b": t[np.array(b, np.int64)]}

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:3] != row[:3]:
                    yield work(held)
                    held = []
                held.append(row)
        if held:
            yield work(held)
    return run


def similar_groups(texts: DataFrame, similarity: float = SIMILARITY, families: int = FAMILIES) -> DataFrame:
    """(t, root) of the texts that link to others; ``texts`` has t and words (16-bit codes).

    Groups are the components of all links of ``similarity`` or more between
    sets of five-word shingles. The covering tables of several SimHash families
    over word sets find most links at little cost. What they leave apart is
    completed exactly: two texts of ``similarity`` or more share a shingle of
    their prefixes, so texts of one prefix shingle and of unlike groups are
    compared, in pairs or, where many share it, in blocks. Every candidate is
    checked exactly, so no text is grouped without a partner.
    """
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        table = family_table(families)
        for batch in batches:
            f = [family_fingerprints(np.frombuffer(w, np.uint16), table) for x in few(batch) for w in x.column(1).to_pylist()]
            yield {"t": np.repeat(batch.column(0).to_numpy(), families), "family": np.tile(np.arange(families, dtype=np.int32), len(f)),
                   "fp": np.concatenate(f)}

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            ok = [jaccard(shingle_set(np.frombuffer(x, np.uint16)), shingle_set(np.frombuffer(y, np.uint16))) >= similarity
                  for p in few(batch) for x, y in zip(p.column("x").to_pylist(), p.column("y").to_pylist())]
            ok = pa.array(ok, pa.bool_())
            yield {"a": batch.column("a").filter(ok), "b": batch.column("b").filter(ok)}

    words = texts.select("t", "words")

    def links(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
        both = pairs.join(words.toDF("a", "x"), "a").join(words.toDF("b", "y"), "b")
        return stored(map_arrow(both, checked, "a long, b long"))

    points = stored(map_arrow(words, prints, "t long, family int, fp long"))
    nodes = stored(points.groupBy("family", "fp").agg(F.min("t").alias("first"), F.count(F.lit(1)).alias("n")))
    edges = covering_edges(nodes, "fp", family="family", complete=COMPLETE)
    first = nodes.select("family", F.col("fp").alias("a"), F.col("first").alias("fa"))
    second = first.toDF("family", "b", "fb")
    across = edges.join(first, ["family", "a"]).join(second, ["family", "b"]).select(F.col("fa").alias("a"), F.col("fb").alias("b"))
    within = points.join(nodes.filter("n > 1"), ["family", "fp"]).filter("t <> first").select(F.col("first").alias("a"), F.col("t").alias("b"))
    found = links(across.union(within))
    dropped(points)
    roots = components(found).select(F.col("node").alias("t"), "root")

    cast = texts.sparkSession.sparkContext.broadcast(common_shingles(words))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        common = cast.value
        for batch in batches:
            sets = [shingle_set(np.frombuffer(w, np.uint16)) for w in batch.column(2).to_pylist()]
            p = [prefix(h, common, similarity) if len(h) else h for h in sets]
            n = [len(h) for h in p]
            yield {"h": np.concatenate(p).view(np.int64), "t": np.repeat(batch.column(0).to_numpy(), n), "root": np.repeat(batch.column(1).to_numpy(), n),
                   "n": np.repeat([len(h) for h in sets], n).astype(np.int32), "pos": np.concatenate([np.arange(k, dtype=np.int32) for k in n])}

    def rooted(rows: DataFrame) -> DataFrame:
        return rows.join(roots, "t", "left").withColumn("root", F.coalesce("root", "t"))

    rows = map_arrow(rooted(words).select("t", "root", "words"), prefixes, "h long, t long, root long, n int, pos int") \
        .repartition(shuffle_width(texts.sparkSession), "h").sortWithinPartitions("h")
    met = stored(map_arrow(rows, _prefix_pairs(similarity), "a long, b long, h long, pos int, hot boolean"))
    found = found.union(links(met.filter("not hot").select("a", "b")))
    roots = components(found).select(F.col("node").alias("t"), "root")
    hot = met.filter("hot").select(F.col("a").alias("t"), "h", "pos")
    if hot.isEmpty():
        return roots
    # Each text under its first such shingle, which joins most of a large group; then under all, without what is one group by now.
    leads = hot.groupBy("t").agg(F.min("pos").alias("pos"))
    for some in (hot.join(leads, ["t", "pos"]), hot):
        now = stored(rooted(some.select("t", "h")))
        live = now.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("g"), F.min("root").alias("lo"), F.max("root").alias("hi")) \
            .filter("lo < hi").select("h", "g")
        mine = now.join(live, "h").withColumn("c", F.expr("cast(pmod(xxhash64(t), g) as int)")) \
            .select("h", "t", "root", "c", F.explode(F.expr("sequence(0, g - 1)")).alias("o"), "g").filter("g = 1 or c <> o")
        blocks = mine.select("h", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "t", "root").join(words, "t") \
            .select("h", "i", "j", "t", "root", "words").repartition(shuffle_width(texts.sparkSession), "h", "i", "j").sortWithinPartitions("h", "i", "j")
        found = found.union(stored(map_arrow(blocks, _block_links(similarity), "a long, b long")))
        roots = components(found).select(F.col("node").alias("t"), "root")
    return roots


def deduplicated(docs: DataFrame, item: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one with the smallest ``item``.

    Groups are the components of links of ``similarity`` or more. Equal texts are
    one group; a null text is a group of its own kind, like an empty one. Of rows
    that share item and text, one stays. All columns are kept.
    """
    from dossier.llm.passages import word_codes
    key, multi, no = (fresh(docs, c) for c in ("_key", "_multi", "_item"))
    digest = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        worker_cache("", lambda: None)  # drop what an earlier stage has left in the worker
        for batch in batches:
            yield {"item": batch.column(0), "key": batch.column(1), "words": pa.array((word_codes(t).tobytes() for x in few(batch) for t in utf8(x.column(2))), pa.binary())}

    kind = docs.schema[item].dataType.simpleString()
    rows = map_arrow(docs.select(F.col(item).alias("item"), digest.alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")), coded,
                     f"item {kind}, key string, words binary")
    texts = stored(rows.groupBy("key").agg(F.min("item").alias("item"), F.first("words").alias("words")).withColumn("t", F.monotonically_increasing_id()))
    names = texts.select("t", "item", "key")
    grouped = names.join(similar_groups(texts, similarity), "t", "left").withColumn("root", F.coalesce("root", "t"))
    stay = grouped.groupBy("root").agg(F.min(F.struct(F.col("item").isNull().alias("none"), "item", "key")).alias("s")).select("s.item", "s.key")
    held = docs.select(F.col(item).alias("item"), digest.alias("key")).groupBy("item", "key").agg((F.count(F.lit(1)) > 1).alias("m"))
    kept = stored(stay.join(held, stay["key"].eqNullSafe(held["key"]) & stay["item"].eqNullSafe(held["item"])).select(
        stay["item"].alias(no), stay["key"].alias(key), F.col("m").alias(multi)))
    own = docs.withColumn(key, digest)
    on = lambda k: (own[key] == k[key]) & own[item].eqNullSafe(k[no])
    once, more = kept.filter(~F.col(multi)), kept.filter(F.col(multi))
    many = own.join(more, on(more)).select(own["*"]).dropDuplicates([item, key])
    return own.join(once, on(once), "left_semi").unionByName(many).drop(key)
