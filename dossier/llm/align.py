"""Alignment of two tokenizers' ids over the same bytes.

Both encodings of a text have cumulative byte ends. The ends that both have
(intersection of two end-to-index dictionaries) cut the text into groups: the
ids of either side between two common ends. A link joins an A and a B token
whose byte ranges end together; links are expanded slice by slice. How often an
id pair is linked is counted over all documents, and every document is judged
against these counts.

Encodings of words are kept per worker, with their groups and links: a space
between two plain characters is an end of both tokenizers, so a word's groups
do not depend on its neighbours.
"""
from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain, repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from dossier.llm.common import fresh, map_arrow, stored, worker_cache

HOT_PAIRS = 1_000_000  # id pairs sent to every worker, the most frequent ones; the rest are joined
CACHE_WORDS = 150_000
CACHE_CHARS = 64  # longer stretches are encoded each time
PLAIN = "!-~À-ÖØ-öø-ɏ"  # characters on whose class all pattern dialects agree
SPACE = "▁"  # how pieces write a space


class Byte:
    """Ids and token bytes of a byte-level vocabulary (the ``.tiktoken`` file beside the ``.json`` one); ids equal those of ``tokenizers``."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).with_suffix(".tiktoken").read_bytes().splitlines())}
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.text = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.text[i] = b
        self.splits = True

    def encode(self, texts: list[str]) -> list[list[int]]:
        return list(map(self.bpe.encode_ordinary, texts))


class Piece:
    """Ids and token bytes of a sentencepiece vocabulary, which writes a space before the text by itself."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.text = [bytes([int(p[1:-1], 16)]) if m.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in pieces)  # no piece crosses from a word into the next space

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The texts begin with the space that the model adds."""
        return self.model.encode([t[1:] for t in texts], num_threads=1)


def ends(lengths: list[int], ids: list[int]) -> dict[int, int]:
    """Cumulative byte end -> number of tokens up to it. Tokens are never empty, so ends differ."""
    return dict(zip(accumulate([lengths[i] for i in ids]), range(1, len(ids) + 1)))


class Aligner:
    """Texts to (A tokens, B tokens, groups, group text, links as A id * 2^32 + B id)."""

    def __init__(self, a: str, b: str):
        self.a, self.b = Byte(a), Piece(b)
        self.sizes = [list(map(len, x.text)) for x in (self.a, self.b)]
        self.lengths = [np.array(x, np.int64) for x in self.sizes]
        self.names = list(map(str, range(max(map(len, self.sizes)))))
        self.cut = re.compile(f"(?<=[{PLAIN}])(?= [{PLAIN}])").split if self.a.splits and self.b.splits else lambda t: [t]
        self.known: dict[str, tuple | None] = {}

    def word(self, text: str, ids_a: list[int], ids_b: list[int]) -> tuple[int, int, int, str, bytes] | None:
        """None where either side's bytes are not those of the text."""
        raw, text_a, text_b, names = text.encode(), self.a.text, self.b.text, self.names
        if b"".join([text_a[i] for i in ids_a]) != raw or b"".join([text_b[i] for i in ids_b]) != raw:
            return None
        ends_a, ends_b = ends(self.sizes[0], ids_a), ends(self.sizes[1], ids_b)
        said_a, said_b = [names[i] for i in ids_a], [names[i] for i in ids_b]
        groups, links, i, j = [], [], 0, 0
        for e in sorted(ends_a.keys() & ends_b.keys()):
            k, l = ends_a[e], ends_b[e]  # noqa: E741
            groups.append((said_a[i] if k - i == 1 else ",".join(said_a[i:k])) + "|" + (said_b[j] if l - j == 1 else ",".join(said_b[j:l])))
            links.append(ids_a[k - 1] << 32 | ids_b[l - 1])  # one token of each side ends with the slice
            i, j = k, l
        return len(ids_a), len(ids_b), len(groups), ";".join(groups), array("q", links).tobytes()

    def many(self, words: list[str], ids_a: list[list[int]], ids_b: list[list[int]]) -> list[tuple | None]:
        """``word`` for all of them laid end to end: the ends of words are ends of both sides. One by one if some bytes differ."""
        raw = [w.encode() for w in words]
        a, b = list(chain.from_iterable(ids_a)), list(chain.from_iterable(ids_b))
        whole = b"".join(raw)
        if b"".join([self.a.text[i] for i in a]) != whole or b"".join([self.b.text[i] for i in b]) != whole:
            return list(map(self.word, words, ids_a, ids_b))
        x, y = np.array(a, np.int64), np.array(b, np.int64)
        end_a, end_b = np.cumsum(self.lengths[0][x]), np.cumsum(self.lengths[1][y])
        end = np.cumsum(list(map(len, raw)))
        n_a, n_b = list(map(len, ids_a)), list(map(len, ids_b))
        if not all(np.array_equal(np.r_[0, e][np.cumsum(n)], end) for e, n in ((end_a, n_a), (end_b, n_b))):
            return list(map(self.word, words, ids_a, ids_b))
        to_b = np.searchsorted(end_b, end_a)
        last_a = np.flatnonzero(end_b[to_b] == end_a)  # both sides end with the text, so every place is one
        last_b = to_b[last_a]
        links = (x[last_a] << 32 | y[last_b]).tobytes()
        said_a, said_b = [self.names[i] for i in a], [self.names[i] for i in b]
        groups, i, j = [], 0, 0
        for k, l in zip((last_a + 1).tolist(), (last_b + 1).tolist()):  # noqa: E741
            groups.append((said_a[i] if k - i == 1 else ",".join(said_a[i:k])) + "|" + (said_b[j] if l - j == 1 else ",".join(said_b[j:l])))
            i, j = k, l
        upto = np.searchsorted(end_a[last_a], end, "right").tolist()
        return [(m, n, v - u, ";".join(groups[u:v]), links[8 * u:8 * v]) for m, n, u, v in zip(n_a, n_b, [0, *upto], upto)]

    def learn(self, words: list[str]) -> dict[str, tuple | None]:
        found = dict(zip(words, self.many(words, self.a.encode(words), self.b.encode(words))))
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        self.known.update((w, v) for w, v in found.items() if len(w) <= CACHE_CHARS)
        return found

    def align(self, text: str | None) -> tuple[int, int, int, str, np.ndarray] | None:
        """None for null and empty texts and those that an encoding does not give back."""
        if not text:
            return None
        words = self.cut(f" {text}")
        parts = list(map(self.known.get, words, repeat(0)))
        if 0 in parts:
            new = self.learn(list(dict.fromkeys([w for w, p in zip(words, parts) if p == 0])))
            parts = [new[w] if p == 0 else p for w, p in zip(words, parts)]
        if None in parts:
            return None
        n_a, n_b, n, groups, links = zip(*parts)
        return sum(n_a), sum(n_b), sum(n), ";".join(groups), np.frombuffer(b"".join(links), np.int64)


def align(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, item: str = "doc_id", text: str = "text") -> DataFrame:
    """(item, n_a, n_b, n_groups, n_links, groups, pairs, times) for every row.

    ``groups`` is ``a1,a2|b1;a3|b2,b3`` in decimal ids; ``pairs`` are the
    distinct links as A id * 2^32 + B id, ``times`` how often each occurs. Null
    and empty texts and those whose bytes an encoding changes have zeros, empty
    groups and no pairs. Whole texts are read. Repeated rows stay repeated, a
    null item stays null, other columns are not read; an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        aligner = worker_cache(f"align {tokenizer_a} {tokenizer_b}", lambda: Aligner(tokenizer_a, tokenizer_b))
        for batch in batches:
            at, out, size = [], [], 0

            def columns():
                n_a, n_b, n, groups, links, pairs, times = zip(*out)  # noqa: B023
                offsets = np.r_[0, np.cumsum([len(p) for p in pairs])].astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(v))) for v in (pairs, times)]
                return {item: batch.column(0).take(pa.array(at, pa.int64())), "n_a": n_a, "n_b": n_b, "n_groups": n,  # noqa: B023
                        "n_links": links, "groups": groups, "pairs": lists[0], "times": lists[1]}
            for i, t in enumerate(batch.column(1).to_pylist()):
                n_a, n_b, n, groups, links = aligner.align(t) or (0, 0, 0, "", np.empty(0, np.int64))
                pairs, times = np.unique(links, return_counts=True)
                at.append(i)
                out.append((n_a, n_b, n, groups, len(links), pairs, times.astype(np.int64)))
                size += len(groups) + 16 * len(pairs)
                if size > 8 << 20:
                    yield columns()
                    at, out, size = [], [], 0
            if out:
                yield columns()
    whole = T.LongType()
    schema = T.StructType([T.StructField(item, docs.schema[item].dataType), *[T.StructField(c, whole) for c in ("n_a", "n_b", "n_groups", "n_links")],
                           T.StructField("groups", T.StringType()), T.StructField("pairs", T.ArrayType(whole)), T.StructField("times", T.ArrayType(whole))])
    return map_arrow(docs.select(F.col(item), F.col(text)), run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, total, best) over all documents; ``best``: no other pair of its B id has more links. One row per id pair."""
    total = stored(aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("z")).groupBy(F.col("z.pairs").alias("pair")).agg(
        F.sum("z.times").alias("total")))
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    most = total.groupBy(b.alias("_b")).agg(F.max("total").alias("_m"))
    return total.join(most, b == F.col("_b")).select("pair", "total", (F.col("total") == F.col("_m")).alias("best"))


def hottest(pairs: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """Pairs over the least power of two that at most ``most`` pairs reach, and whether that is all of them."""
    power = F.floor(F.log2("total")).cast("int")
    sizes = {r["p"]: r["n"] for r in pairs.groupBy(power.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # under 64 rows
    have, least = 0, 64
    for p in sorted(sizes, reverse=True):
        if have + sizes[p] > most:
            break
        have, least = have + sizes[p], p
    return pairs.filter(power >= least), have == sum(sizes.values())


def judged(aligned: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Columns of ``aligned`` without its lists, with ``n_best`` and ``count_sum``.

    ``n_best`` counts the links whose pair is the most frequent one of its B id
    over all documents, ties included; ``count_sum`` adds the pairs' counts over
    the links. The ``hot_pairs`` most frequent pairs, which hold nearly all
    links, go to the workers and are looked up in place; the links of the
    others, if there are more, are joined by their pair, so a pair that a third
    of all links share is never a join key.
    """
    spark, row = aligned.sparkSession, fresh(aligned, "_row")
    a = stored(aligned.withColumn(row, F.monotonically_increasing_id()))
    pairs = stored(pair_counts(a))
    hot, complete = hottest(pairs, hot_pairs)
    t = hot.toArrow().sort_by("pair")
    sent = spark.sparkContext.broadcast((t["pair"].to_numpy(), t["total"].to_numpy(), t["best"].combine_chunks().to_numpy(zero_copy_only=False)))
    keep = [c for c in a.columns if c not in ("pairs", "times")]
    base = [a.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        keys, total, best = sent.value
        for batch in batches:
            p, n = batch.column("pairs"), batch.column("times").flatten().to_numpy()
            key, starts = p.flatten().to_numpy(), p.offsets.to_numpy() - p.offsets[0].as_py()
            at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            found = keys[at] == key if len(keys) else np.zeros(len(key), bool)
            add = lambda v: np.diff(np.r_[0, np.cumsum(v)][starts])
            at = np.where(found, at, 0)
            got = (np.where(found, total[at], 0), np.where(found, best[at], False)) if len(keys) else (np.zeros(len(key), np.int64),) * 2
            rest = np.r_[0, np.cumsum(~found)][starts].astype(np.int32)
            left = [pa.ListArray.from_arrays(pa.array(rest), pa.array(v[~found])) for v in (key, n)]
            yield {**{c: batch.column(c) for c in keep}, "n_best": add(n * got[1]), "count_sum": add(n * got[0]), "pairs": left[0], "times": left[1]}
    out = map_arrow(a.select(*keep, "pairs", "times"), run, T.StructType([
        *base, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), a.schema["pairs"], a.schema["times"]]))
    if complete:
        return out.drop(row, "pairs", "times")
    out = stored(out)
    rare = out.select(row, F.explode(F.arrays_zip("pairs", "times")).alias("z")).select(row, F.col("z.pairs").alias("pair"), "z.times").join(
        pairs, "pair").groupBy(row).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_n"), F.sum(F.col("times") * F.col("total")).alias("_s"))
    return out.drop("pairs", "times").join(rare, row, "left").withColumn("n_best", F.col("n_best") + F.coalesce("_n", F.lit(0))).withColumn(
        "count_sum", F.col("count_sum") + F.coalesce("_s", F.lit(0))).drop(row, "_n", "_s")
