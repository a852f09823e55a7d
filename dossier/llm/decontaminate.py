"""Benchmark decontamination by pigeonhole edit matching.

An item with an error budget of e is cut into e + 1 pieces: wherever it occurs
with at most e edits, one piece occurs unchanged. One pass of a multi-pattern
automaton over a document finds the pieces. A hit climbs a binary tree over the
pieces: a node of m pieces may hold m - 1 edits, and an occurrence within the
budget is within the budget of every node above some unchanged piece. Each node
is checked with Myers' bit-parallel distance on the text around the hit, so
chance hits end at the lowest level.
"""
from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from dossier.llm.common import map_arrow, worker_cache

RATE = 0.1  # edits per character of an item
SLAB_CHARS = 4_000_000  # characters of items that travel to all workers at once
KEPT_SLABS = 4  # automata that a worker holds at once
SPACE = re.compile(r"\s+")


def normal(text: str) -> str:
    """Lower case, white space runs as one space, trimmed."""
    return SPACE.sub(" ", text.lower()).strip()


def positions(text: str) -> list[tuple[int, int]]:
    """Start and end in ``text`` of every character of ``normal(text)``."""
    out: list[tuple[int, int]] = []
    i, n = 0, len(text)
    while i < n:
        j = i + 1
        if SPACE.match(text[i].lower()):
            while j < n and SPACE.match(text[j].lower()):
                j += 1
            out.append((i, j))
        else:
            low = text[i].lower() if text[i] != "Σ" else "σ"
            out += [(i, j)] * len(low)
        i = j
    if out and SPACE.match(text[out[0][0]].lower()):
        out.pop(0)
    if out and SPACE.match(text[out[-1][0]].lower()):
        out.pop()
    return out


def myers(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to a substring of ``text``, and the first end of such a substring."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    get = peq.get
    for j, ch in enumerate(text, 1):
        eq = get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j
    return best, end


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        out[ch] = out.get(ch, 0) | 1 << i
    return out


@dataclass
class Node:
    start: int
    end: int
    budget: int
    peq: dict[str, int]
    parent: "Node | None"


def tree(text: str, budget: int) -> list[tuple[str, Node]]:
    """The pieces of an item with their leaves; inner nodes hang above them."""
    n = budget + 1
    cuts = [len(text) * i // n for i in range(n + 1)]
    leaves = []

    def build(a: int, b: int, parent: Node | None) -> None:
        piece = text[cuts[a]:cuts[b]]
        node = Node(cuts[a], cuts[b], b - a - 1, masks(piece), parent)
        if b - a == 1:
            leaves.append((piece, node))
        else:
            mid = (a + b) // 2
            build(a, mid, node)
            build(mid, b, node)
    build(0, n, None)
    return leaves


class Matcher:
    """All items of a slab in one automaton."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        self.items, self.auto = [], ahocorasick.Automaton()
        where: dict[str, list[tuple[int, Node]]] = {}
        for ident, raw in items:
            text = normal(raw)
            if not text:
                continue
            k = len(self.items)
            self.items.append((ident, text, int(len(text) * rate)))
            for piece, leaf in tree(text, int(len(text) * rate)):
                where.setdefault(piece, []).append((k, leaf))
        for piece, at in where.items():
            self.auto.add_word(piece, (len(piece), at))
        if where:
            self.auto.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item number, start, end, distance) of non-overlapping occurrences per item in normal text, left to right."""
        if not self.items:
            return []
        failed: set[tuple[int, int]] = set()
        taken: dict[int, list[tuple[int, int, int]]] = {}
        for last, (size, at) in self.auto.iter(text):
            begin = last + 1 - size
            for k, leaf in at:
                found = taken.get(k)
                if found and found[-1][0] <= begin < found[-1][1]:
                    continue
                shift = begin - leaf.start
                node = leaf
                ok = True
                while node.parent is not None:
                    node = node.parent
                    if (key := (id(node), shift)) in failed:
                        ok = False
                        break
                    lo = max(0, shift + node.start - node.budget)
                    d, end = myers(node.peq, node.end - node.start, text[lo:shift + node.end + node.budget])
                    if d > node.budget:
                        failed.add(key)
                        ok = False
                        break
                if not ok:
                    continue
                if node is leaf:  # no edits allowed: the piece is the item
                    lo, d, end = begin, 0, size
                stop = lo + end
                pattern = self.items[k][1]
                back, length = myers(masks(pattern[::-1]), len(pattern), text[max(0, stop - len(pattern) - d):stop][::-1])
                start = stop - length if back == d else max(0, stop - len(pattern))
                if found and start < found[-1][1]:
                    if d < found[-1][2]:
                        found[-1] = (start, stop, d)
                    continue
                taken.setdefault(k, []).append((start, stop, d))
        return sorted((k, s, e, d) for k, all_ in taken.items() for s, e, d in all_)


def contaminated(docs: DataFrame, items: DataFrame, item: str = "doc_id", text: str = "text", test_id: str = "item_id",
                 test_text: str = "text", rate: float = RATE, slab_chars: int = SLAB_CHARS) -> DataFrame:
    """(item, test_id, start, end, distance): every occurrence of a test item within its budget of ``rate`` edits a character.

    Texts are compared in lower case with white space as one space; start and
    end are code points of the text as it is. Occurrences of one item do not
    overlap. Null and empty texts and items match nothing; repeated rows give
    repeated results; equal items under several ids give one row each. Items
    travel in slabs of at most about ``slab_chars`` characters, one scan of the
    documents each; documents are never shuffled. Other columns are not read.
    """
    ident = items.schema[test_id].dataType
    schema = T.StructType([T.StructField(item, docs.schema[item].dataType), T.StructField(test_id, ident), T.StructField("start", T.LongType()),
                           T.StructField("end", T.LongType()), T.StructField("distance", T.IntegerType())])
    out = None
    for slab in slabs_of(items, test_id, test_text, slab_chars):
        part = map_arrow(docs.select(F.col(item), F.col(text)), _scan(slab, rate, item, test_id, uuid.uuid4().hex), schema)
        out = part if out is None else out.unionByName(part)
    return out


def slabs_of(items: DataFrame, test_id: str = "item_id", test_text: str = "text", slab_chars: int = SLAB_CHARS) -> Iterator[list[tuple[object, str]]]:
    """The distinct non-null items in lists of at most about ``slab_chars`` characters; one empty list if there are none."""
    rows = items.select(F.col(test_id).alias("i"), F.col(test_text).alias("t")).filter("t is not null").distinct()
    slabs = max(1, -(-int(rows.agg(F.sum(F.length("t"))).first()[0] or 0) // slab_chars))
    for n in range(slabs):
        yield [(r["i"], r["t"]) for r in rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(slabs)) == n).sort("i", "t").collect()]


def leaks(text: Column, items: DataFrame, test_id: str = "item_id", test_text: str = "text", rate: float = RATE,
          slab_chars: int = SLAB_CHARS) -> Column:
    """True where a text holds an item of ``items`` within its budget; false for null."""
    out = F.lit(False)
    for slab in slabs_of(items, test_id, test_text, slab_chars):
        out = out | _holds(slab, rate, uuid.uuid4().hex)(text)
    return out


def _holds(slab: list[tuple[object, str]], rate: float, key: str):
    def of(col: pa.Array) -> pa.Array:
        m = _matcher(slab, rate, key)
        return pa.array([bool(t and m.find(normal(t))) for t in col.to_pylist()], pa.bool_())
    return F.arrow_udf(of, "boolean")


def _matcher(slab: list[tuple[object, str]], rate: float, key: str) -> Matcher:
    kept = worker_cache("decontaminate", dict)
    if key not in kept:
        if len(kept) >= KEPT_SLABS:
            kept.clear()
        kept[key] = Matcher(slab, rate)
    return kept[key]


def _scan(slab: list[tuple[object, str]], rate: float, item: str, test_id: str, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        m = _matcher(slab, rate, key)
        for batch in batches:
            at, ids, starts, ends, dist = [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if not t:
                    continue
                if hits := m.find(norm := normal(t)):
                    where = positions(t)
                    if len(where) != len(norm):  # lower-casing depends on neighbours: count in normal text
                        where = [(j, j + 1) for j in range(len(norm))]
                    for k, s, e, d in hits:
                        at.append(i); ids.append(m.items[k][0]); dist.append(d)  # noqa: E702
                        starts.append(where[s][0]); ends.append(where[e - 1][1] if e > s else where[s][0])  # noqa: E702
            if at:
                yield {item: batch.column(0).take(pa.array(at, pa.int64())), test_id: ids, "start": starts, "end": ends, "distance": dist}
    return run
