"""Language-model scoring from a log-frequency Bloom filter.

Counts of 1- and 2-grams of the training texts are quantised to levels
1 + floor(log2(count)), and an n-gram is entered once for each level up to its
own. A reader asks for level 1, 2, ... until a probe misses, and gets the
quantised count back. The filter is built in slices: each task merges the
counts of one hash range and sets the bits of that range, so no task and no
shuffle ever holds all n-grams as rows.

Texts travel as blocks of about a million tokens: word numbers within the block
and the 64-bit hashes of its distinct words. What is counted or looked up is
asked once per block. Exact counts of words come back to the blocks by a
shuffle; the slices go to all workers in rounds of bounded size.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from dossier.llm.common import byte_words, map_arrow, stored, utf8

BLOCK_TOKENS = 1_000_000
BITS_PER_ENTRY = 8.0
PROBES = 5
ROUND_BYTES = 128 << 20  # of filter slices broadcast at once
SLICE_TOKENS = 2_000_000  # training tokens whose n-grams one slice holds, about
BACKOFF = 20.0  # history count at which the 2-gram and the 1-gram weigh the same
ALPHA = 0.1
END_HASH = 0x9E3779B97F4A7C15
M1, M2, M3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * M1
        x = (x ^ (x >> np.uint64(27))) * M2
        return x ^ (x >> np.uint64(31))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """48-bit hash of a 2-gram."""
    with np.errstate(over="ignore"):
        return mixed(a * M3 + mixed(b + M2)) >> np.uint64(16)


def packed(x: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte plane by byte plane, so that the shuffle's compression finds the zero planes."""
    return np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(b: bytes) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8).reshape(8, -1)
    with np.errstate(over="ignore"):
        return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def bucket_of(h: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Equal ranges of a hash of ``bits`` bits; ascending, so sorted hashes have sorted buckets."""
    return ((h >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


# ---- blocks -----------------------------------------------------------------
def blocks(docs: DataFrame, item: str, text: str, held: Column, size: int = BLOCK_TOKENS) -> DataFrame:
    """One row per block: items, held, lengths (words of each text), seq (word numbers, 4 bytes), words (hashes, ascending).

    Word number 0 is the end token, whose hash stands apart in no text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, n = TaskContext.get().partitionId(), 0
        items, held_, lengths, seqs, known, tokens = [], [], [], [], {}, 0

        def out():
            nonlocal n, items, held_, lengths, seqs, known, tokens
            words = list(known)
            h = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
            order = np.argsort(h, kind="stable")
            place = np.empty(len(words) + 1, np.uint32)
            place[0] = 0
            place[order + 1] = np.arange(1, len(words) + 1)
            seq = place[np.concatenate(seqs)] if seqs else np.empty(0, np.uint32)
            chunk = pa.concat_arrays(items)
            row = {"block": [(part << 32) + n], "items": pa.ListArray.from_arrays(pa.array([0, len(chunk)], pa.int32()), chunk),
                   "held": [np.concatenate(held_).tobytes()], "lengths": [np.array(lengths, np.int64).tobytes()],
                   "seq": [seq.astype("<u4").tobytes()], "words": [h[order].tobytes()]}
            n += 1
            items, held_, lengths, seqs, known, tokens = [], [], [], [], {}, 0
            return row
        for batch in batches:
            texts, flags, at = utf8(batch.column(1)), np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool), 0
            for i, t in enumerate(texts):
                w = byte_words(t or b"")
                number = known.setdefault
                seqs.append(np.fromiter((number(x, len(known) + 1) for x in w), np.uint32, len(w)))
                lengths.append(len(w))
                tokens += len(w) + 1
                if tokens >= size:
                    items.append(batch.column(0).slice(at, i + 1 - at))
                    held_.append(flags[at:i + 1])
                    at = i + 1
                    yield out()
            if at < len(texts):
                items.append(batch.column(0).slice(at))
                held_.append(flags[at:])
        if items:
            yield out()
    kind = docs.schema[item].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("items", T.ArrayType(kind)),
                           *[T.StructField(c, T.BinaryType()) for c in ("held", "lengths", "seq", "words")]])
    return map_arrow(docs.select(F.col(item), F.col(text), held), run, schema)


@dataclass
class Block:
    """A block read back: token and history numbers of every token, ends included, and the text of each."""
    held: np.ndarray
    lengths: np.ndarray
    hashes: np.ndarray  # by word number; 0 is the end
    token: np.ndarray
    history: np.ndarray
    doc: np.ndarray

    @classmethod
    def of(cls, held: bytes, lengths: bytes, seq: bytes, words: bytes) -> Block:
        n = np.frombuffer(lengths, np.int64)
        ends = np.cumsum(n + 1) - 1
        token = np.zeros(int(n.sum()) + len(n), np.int64)
        inside = np.ones(len(token), bool)
        inside[ends] = False
        token[inside] = np.frombuffer(seq, "<u4")
        history = np.r_[0, token[:-1]] if len(token) else token
        return cls(np.frombuffer(held, bool), n, np.r_[np.uint64(END_HASH), np.frombuffer(words, np.uint64)], token, history,
                   np.repeat(np.arange(len(n)), n + 1))

    def pairs(self, where: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct 2-grams (history, token), their place for each token, and counts; ``where`` chooses tokens."""
        k = self.history * len(self.hashes) + self.token
        u, inv, n = np.unique(k if where is None else k[where], return_inverse=True, return_counts=True)
        return u // len(self.hashes), u % len(self.hashes), inv, n


def _rows(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple]:
    for i in range(batch.num_rows):
        yield tuple(batch.column(n)[i].as_py() for n in names)


# ---- counts and slices ------------------------------------------------------
def requests(table: DataFrame, buckets: int) -> DataFrame:
    """Per block and hash range: the block's words with their training counts, and its training 2-grams with theirs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for block, held, lengths, seq, words in _rows(batch, ["block", "held", "lengths", "seq", "words"]):
                b = Block.of(held, lengths, seq, words)
                train = ~b.held[b.doc]
                uni = np.bincount(b.token[train], minlength=len(b.hashes)).astype(np.uint32)
                uh, un = b.hashes[1:], uni[1:]
                p, w, _, n = b.pairs(train)
                bh = pair_hash(b.hashes[p], b.hashes[w])
                o = np.argsort(bh)
                bh, bn = bh[o], n[o].astype(np.uint32)
                edge = np.arange(buckets + 1)
                us, bs = np.searchsorted(bucket_of(uh, 64, buckets), edge), np.searchsorted(bucket_of(bh, 48, buckets), edge)
                cut = lambda f, x, s: [f(x[s[i]:s[i + 1]]) for i in range(buckets)]
                raw = lambda x: x.tobytes()
                yield {"bucket": np.arange(buckets, dtype=np.int32), "block": np.full(buckets, block, np.int64),
                       "uh": cut(packed, uh, us), "un": cut(raw, un, us), "bh": cut(packed, bh, bs), "bn": cut(raw, bn, bs)}
    return map_arrow(table, run, "bucket int, block long, uh binary, un binary, bh binary, bn binary")


def level_of(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, 1 + np.floor(np.log2(np.maximum(count, 1))), 0).astype(np.int64)


def count_of(level: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level."""
    return np.where(level > 0, 1.5 * 2.0 ** (level - 1) - 0.5, 0.0)


def positions(h: np.ndarray, level: np.ndarray | int, bits: np.ndarray | int) -> Iterator[np.ndarray]:
    with np.errstate(over="ignore"):
        a = mixed(h + np.asarray(level, np.uint64) * M3)
        step = mixed(a + M1) | np.uint64(1)
        for j in range(PROBES):
            yield (a + np.uint64(j) * step) % np.asarray(bits, np.uint64)


def slice_bits(entries: int) -> int:
    return 64 * max(1, int(np.ceil(entries * BITS_PER_ENTRY / 64)))


def merge(asked: DataFrame, width: int) -> DataFrame:
    """Replies (block, bucket, exact counts in the order asked) and one slice per bucket (block null), with sums."""
    def done(bucket: int, rows: list[tuple]) -> dict:
        uh = [unpacked(r[1]) for r in rows]
        keys, inv = np.unique(np.concatenate(uh), return_inverse=True)
        c = np.bincount(inv, np.concatenate([np.frombuffer(r[2], np.uint32) for r in rows]), len(keys)).astype(np.int64)
        bk, binv = np.unique(np.concatenate([unpacked(r[3]) for r in rows]), return_inverse=True)
        bc = np.bincount(binv, np.concatenate([np.frombuffer(r[4], np.uint32) for r in rows]), len(bk)).astype(np.int64)
        # 1-grams go in by their 48 upper bits, 2-grams by theirs with the lowest bit of a 49th turned: two key spaces
        h = np.concatenate([keys[c > 0] >> np.uint64(16), bk | np.uint64(1 << 48)])
        level = level_of(np.concatenate([c[c > 0], bc]))
        bits = slice_bits(int(level.sum()))
        field = np.zeros(bits, bool)
        for q in range(1, int(level.max(initial=0)) + 1):
            for at in positions(h[level >= q], q, bits):
                field[at] = True
        cuts = np.cumsum([0, *map(len, uh)])
        counts = c[inv]
        return {"block": [r[0] for r in rows] + [None], "bucket": [bucket] * (len(rows) + 1),
                "blob": [counts[a:b].tobytes() for a, b in zip(cuts, cuts[1:])] + [np.packbits(field, bitorder="little").tobytes()],
                "distinct": [0] * len(rows) + [int((c > 0).sum())],
                "mass": [0.0] * len(rows) + [float(count_of(level_of(c)).sum())]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, rows = None, []
        for batch in batches:
            for bucket, *rest in _rows(batch, ["bucket", "block", "uh", "un", "bh", "bn"]):
                if bucket != now and rows:
                    yield done(now, rows)
                    rows = []
                now = bucket
                rows.append(rest)
        if rows:
            yield done(now, rows)
    return map_arrow(asked.repartition(width, "bucket").sortWithinPartitions("bucket", "block"), run,
                     "block long, bucket int, blob binary, distinct long, mass double")


class Filter:
    """Slices of a hash range side by side, asked for many n-grams at once."""

    def __init__(self, slices: dict[int, bytes], buckets: int):
        self.buckets = buckets
        self.start, self.bits = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        at = 0
        for k, s in sorted(slices.items()):
            self.start[k], self.bits[k] = at, 8 * len(s)
            at += len(s)
        self.field = np.frombuffer(b"".join(s for _, s in sorted(slices.items())), np.uint8)

    def levels(self, h: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Probe level after level until a miss; n-grams of slices that are not here get 0."""
        out = np.zeros(len(h), np.uint8)
        live = np.flatnonzero(self.bits[bucket] > 0)
        q = 1
        while len(live):
            k = bucket[live]
            hit = np.ones(len(live), bool)
            for at in positions(h[live], q, self.bits[k]):
                byte = self.field[self.start[k] + (at >> np.uint64(3)).astype(np.int64)]
                hit &= (byte >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            live = live[hit]
            out[live] = q
            q += 1
        return out


def answers(table: DataFrame, slices: dict[int, bytes], buckets: int, turn: int) -> DataFrame:
    """Levels of every block's 1-grams and 2-grams, for the slices broadcast in this round."""
    cast = table.sparkSession.sparkContext.broadcast(Filter(slices, buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        f = cast.value
        for batch in batches:
            for block, held, lengths, seq, words in _rows(batch, ["block", "held", "lengths", "seq", "words"]):
                b = Block.of(held, lengths, seq, words)
                p, w, _, _ = b.pairs()
                uh, bh = b.hashes >> np.uint64(16), pair_hash(b.hashes[p], b.hashes[w])
                level = np.concatenate([f.levels(uh, bucket_of(b.hashes, 64, buckets)),
                                        f.levels(bh | np.uint64(1 << 48), bucket_of(bh, 48, buckets))])
                yield {"block": [block], "bucket": [-1 - turn], "blob": [level.tobytes()]}
    return map_arrow(table, run, "block long, bucket int, blob binary")


# ---- scores -----------------------------------------------------------------
def score(docs: DataFrame, held: Column, item: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS,
          round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(item, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    ``held`` marks rows that are scored but not learned from. ``base_score`` uses
    exact 1-gram counts; ``score`` interpolates the filter's 2-gram with its
    1-gram estimate, weighing by the history's count. Null and wordless texts
    are the end token alone. Repeated rows count as often as they occur. Other
    columns are not read. With nothing to learn from, every token is unknown.
    """
    spark = docs.sparkSession
    table = stored(blocks(docs, item, text, F.coalesce(held, F.lit(False)), block_tokens))
    total = table.agg(F.sum(F.length("seq"))).first()[0] or 0
    buckets = max(64, int(total) // 4 // SLICE_TOKENS)
    width = min(buckets, max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets // 4))
    merged = stored(merge(requests(table.drop("items"), buckets), width))
    ends = stored(map_arrow(table.select("held", "lengths"), _training_tokens, "docs long, tokens long")) \
        .agg(F.sum("docs"), F.sum("tokens")).first()
    docs_seen, tokens = int(ends[0] or 0), int(ends[1] or 0)
    slices = merged.filter("block is null")
    sums = slices.agg(F.sum("distinct"), F.sum("mass")).first()
    types = int(sums[0] or 0) + (docs_seen > 0)
    mass = float(sums[1] or 0.0) + docs_seen
    sizes = sorted((r["bucket"], r["n"]) for r in slices.select("bucket", F.length("blob").alias("n")).collect())
    turns: list[list[int]] = [[]]
    room = round_bytes
    for k, n in sizes:
        if n > room and turns[-1]:
            turns.append([])
            room = round_bytes
        turns[-1].append(k)
        room -= n
    replies = merged.filter("block is not null").select("block", "bucket", "blob")
    for i, turn in enumerate(turns):
        part = {r["bucket"]: bytes(r["blob"]) for r in slices.filter(F.col("bucket").between(turn[0], turn[-1])).select("bucket", "blob").collect()} if turn else {}
        replies = replies.unionByName(answers(table.drop("items"), part, buckets, i))
    kind = docs.schema[item].dataType
    blank = table.select("block", F.lit(1 << 30).alias("bucket"), F.lit(None).cast("binary").alias("blob"), "items", "held", "lengths", "seq", "words")
    extra = [F.lit(None).cast(blank.schema[c].dataType).alias(c) for c in ("items", "held", "lengths", "seq", "words")]
    both = replies.select("block", "bucket", "blob", *extra).union(blank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        exact, level, now = [], None, None
        for batch in batches:
            for i in range(batch.num_rows):
                block, bucket = batch.column("block")[i].as_py(), batch.column("bucket")[i].as_py()
                if block != now:
                    now, exact, level = block, [], None
                if bucket < 0:
                    got = np.frombuffer(batch.column("blob")[i].as_py(), np.uint8)
                    level = got if level is None else level + got
                elif bucket < 1 << 30:
                    exact.append(np.frombuffer(batch.column("blob")[i].as_py(), np.int64))
                else:
                    held_, lengths, seq, words = (batch.column(c)[i].as_py() for c in ("held", "lengths", "seq", "words"))
                    b = Block.of(held_, lengths, seq, words)
                    n = len(b.lengths)
                    count = np.concatenate([[docs_seen], *exact]).astype(float)
                    base = np.log10((count + ALPHA) / (tokens + ALPHA * (types + 1)))
                    p, w, inv, _ = b.pairs()
                    c1 = count_of(level[:len(b.hashes)].astype(np.int64))
                    c1[0] = docs_seen
                    c2 = count_of(level[len(b.hashes):].astype(np.int64))
                    p1 = (c1 + ALPHA) / (mass + ALPHA * (types + 1))
                    weight = c1[p] / (c1[p] + BACKOFF)
                    p2 = weight * np.minimum(1.0, c2 / np.maximum(c1[p], 1.0)) + (1 - weight) * p1[w]
                    yield {item: batch.column("items")[i].values, "held_out": b.held,
                           "n_tokens": b.lengths + 1, "n_known": np.bincount(b.doc, count[b.token] > 0, n).astype(np.int64),
                           "train_tokens": np.full(n, tokens, np.int64),
                           "base_score": np.bincount(b.doc, base[b.token], n), "score": np.bincount(b.doc, np.log10(p2)[inv], n)}
    schema = T.StructType([T.StructField(item, kind), T.StructField("held_out", T.BooleanType()),
                           *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")],
                           *[T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]])
    return map_arrow(both.repartition("block").sortWithinPartitions("block", "bucket"), run, schema)


def _training_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    docs = tokens = 0
    for batch in batches:
        for held, lengths in _rows(batch, ["held", "lengths"]):
            train = ~np.frombuffer(held, bool)
            docs += int(train.sum())
            tokens += int((np.frombuffer(lengths, np.int64)[train] + 1).sum())
    yield {"docs": [docs], "tokens": [tokens]}
