"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Two first-order chains over the characters of a token are compared by their
log-likelihood ratio. Both are counted from labelled samples of the corpus:
what the fixed patterns capture is labelled random, all other long tokens of
the same documents ordinary. A seeded set of drawn strings is added to each
side, so that alphabets the corpus lacks are known too.
"""
from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dossier.llm.common import hash63, hash_limit, map_arrow

KINDS = ["assign", "access", "hex", "random"]
# The base patterns with their least lengths.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run is taken whole, so the least length can stand in the pattern
HEX = re.compile(r"[0-9a-f]{24,}")
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_=-"
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
SAMPLE_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
TRAIN_ROWS = 20_000  # documents that the models are counted from, at most about
THRESHOLD = 12.0  # nats by which random must be likelier
SMOOTH = 0.05


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind index) of the base patterns, leftmost and non-overlapping per kind."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
    out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return out


def free(tokens: Iterator[re.Match], spans: list[tuple[int, int, int]]) -> Iterator[re.Match]:
    """Tokens, given from left to right, that touch no span; one walk over both."""
    ends: list[tuple[int, int]] = []  # of the spans, overlapping ones merged
    for s, e, _ in sorted(spans):
        if ends and s <= ends[-1][1]:
            ends[-1] = (ends[-1][0], max(e, ends[-1][1]))
        else:
            ends.append((s, e))
    i = 0
    for m in tokens:
        while i < len(ends) and ends[i][1] <= m.start():
            i += 1
        if i == len(ends) or ends[i][0] >= m.end():
            yield m


def codes(token: str) -> np.ndarray:
    table = np.full(128, 0, np.int64)
    table[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(1, len(ALPHABET) + 1)
    return np.r_[0, table[np.frombuffer(token.encode("ascii"), np.uint8)]]  # 0: before the first character


def drawn_samples(seed: int = 7, n: int = 400) -> tuple[list[str], list[str]]:
    """Labelled strings: uniform draws over usual key alphabets; words joined as in code, numbers, rules and separators."""
    rnd = random.Random(seed)
    keys = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_",
            string.ascii_uppercase + string.digits, "0123456789abcdef"]
    rand = ["".join(rnd.choice(k) for _ in range(rnd.randint(20, 48))) for k in keys for _ in range(n)]
    syl = [c + v + e for c in "bcdfglmnprst" for v in "aeiou" for e in ("", "n", "r", "s", "t")]
    word = lambda: "".join(rnd.choice(syl) for _ in range(rnd.randint(1, 4)))
    plain = []
    for _ in range(n):
        w = [word() for _ in range(rnd.randint(2, 6))]
        plain += ["_".join(w), "-".join(w), "/".join(w), w[0] + "".join(x.title() for x in w[1:]), "_".join(w).upper(),
                  "".join(w), f"{w[0]}-{rnd.randint(1, 2030)}-{rnd.randint(1, 31):02d}", str(rnd.randint(10 ** 15, 10 ** 24)),
                  rnd.choice("=-_+/") * rnd.randint(8, 80), rnd.choice(string.ascii_letters) * rnd.randint(8, 60)]
    return rand, plain


def train(docs: DataFrame, item: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> np.ndarray:
    """Log-likelihood ratio of each character pair, random over ordinary.

    Counted over a sample of at most about ``rows`` documents, chosen by the hash
    of item and text. Each task sends one small count table; the driver adds
    2 x 68 x 68 numbers.
    """
    size = len(ALPHABET) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        n = np.zeros((2, size * size), np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                spans = base_spans(t)
                for s, e, k in spans:
                    c = codes(ASSIGN.match(t[s:e])[1].replace(".", "-") if k == 0 else t[s:e])
                    np.add.at(n[1], c[:-1] * size + c[1:], 1)
                for m in free(SAMPLE_TOKEN.finditer(t), spans):
                    c = codes(m[0])
                    np.add.at(n[0], c[:-1] * size + c[1:], 1)
        label, pair = np.nonzero(n)
        yield {"label": label.astype(np.int32), "pair": pair.astype(np.int32), "n": n[label, pair]}

    limit = hash_limit(rows, docs.count())
    part = docs.select(F.col(text).alias("t"), F.col(item).alias("i")).filter("t is not null").filter(
        hash63("i", "t") <= limit).select("t")
    counts = np.zeros((2, size, size))
    for r in map_arrow(part, run, "label int, pair int, n long").groupBy("label", "pair").agg(F.sum("n").alias("n")).collect():
        counts[r["label"], r["pair"] // size, r["pair"] % size] = r["n"]
    for label, tokens in enumerate(reversed(drawn_samples())):
        for c in map(codes, tokens):
            np.add.at(counts[label], (c[:-1], c[1:]), 1)
    start = counts.sum(2, keepdims=True)
    shape = counts.sum(1, keepdims=True) + 1.0  # back off to how often the character occurs at all
    p = (counts + SMOOTH * size * shape / shape.sum(2, keepdims=True)) / (start + SMOOTH * size)
    with np.errstate(divide="ignore"):
        return np.log(p[1]) - np.log(p[0])


def find(docs: DataFrame, item: str = "doc_id", text: str = "text", model: np.ndarray | None = None,
         threshold: float = THRESHOLD) -> DataFrame:
    """(item, spans): array of (kind, start, end) by start, then kind; code points, end exclusive.

    Kinds ``assign``, ``access`` and ``hex`` are the base patterns; ``random``
    are further tokens of 20 characters or more, free of base spans, that the
    models call random. One row per row of ``docs``; null text is empty.
    """
    model = train(docs, item, text) if model is None else model
    return docs.select(F.col(item), spans(F.col(text), model, threshold).alias("spans"))


def all_spans(text: str, llr: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
    found = base_spans(text)
    more = []
    for m in free(TOKEN.finditer(text), found):
        c = codes(m[0])
        if llr[c[:-1], c[1:]].sum() >= threshold:
            more.append((m.start(), m.end(), 3))
    return sorted(found + more, key=lambda x: (x[0], x[2]))


SPANS = "array<struct<kind:string,start:int,end:int>>"


def spans(text: Column, model: np.ndarray, threshold: float = THRESHOLD) -> Column:
    def of(col: pa.Array) -> pa.Array:
        return pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, e, k in all_spans(t or "", model, threshold)]
                         for t in col.to_pylist()],
                        pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))
    return F.arrow_udf(of, SPANS)(text)


def redacted(text: Column, model: np.ndarray, threshold: float = THRESHOLD, mark: str = "[SECRET]") -> Column:
    """``text`` with every span (overlapping ones merged) replaced by ``mark``; null stays null."""
    def clean(t: str) -> str:
        out, at = [], 0
        for s, e, _ in all_spans(t, model, threshold):
            if s >= at:
                out += [t[at:s], mark]
            at = max(at, e)
        return "".join([*out, t[at:]])

    def of(col: pa.Array) -> pa.Array:
        return pa.array([None if t is None else clean(t) for t in col.to_pylist()], pa.string())
    return F.arrow_udf(of, "string")(text)
