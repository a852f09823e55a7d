"""Structure repair of conversations by weighted interval parsing.

A conversation is well formed if its roles' initials read ``(s?(ua)+)?``. Rows
may be kept, given another role, deleted, and empty rows inserted; the cheapest
way is found by a parser over spans. The repair grammar is in Chomsky normal
form: a nonterminal N[p, q] derives a span whose repaired rows lead the roles'
automaton from p to q, with N[p, r] -> N[p, q] N[q, r] and one terminal per row
and edit; inserted rows derive from the empty span and are closed in before each
row and after the last. A cell holds the least (cost, audit) of its nonterminal.
A cell of such a grammar is the same for every split of its span, so spans are
combined bottom-up by doubling length, one split each.

Of equal costs the audit that is least in ASCII stays. Audits of one span and
one cost are never a beginning of one another (what follows could only be
insertions, which cost), so the least of a whole is made of the least of parts.

Rows come to the parser as one byte each, in blocks of bounded length; the
blocks of a longer conversation are combined over several rounds. Texts move
once, for the repaired rows.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from dossier.llm.common import map_arrow, stored, worker_cache
from dossier.operators.bounds import number_rows

BLOCK = 1024  # rows parsed in one go
FAN = 16  # blocks combined in one go
PIECE_ROWS = 1_000_000  # of the numbering
CACHE = 100_000
SPACES = "\x20\t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3  # costs; CUT is added for a truncated row that stays
LETTERS = {"u": "user", "a": "assistant"}
# States: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 may end.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
Cells = dict[tuple[int, int], tuple[int, str]]


def combine(x: Cells, y: Cells) -> Cells:
    """Cells of two neighbouring spans to those of both."""
    out: Cells = {}
    for (p, q), (c, s) in x.items():
        for r in range(4):
            o = y.get((q, r))
            if o is not None:
                new = (c + o[0], s + o[1])
                if (p, r) not in out or new < out[p, r]:
                    out[p, r] = new
    return out


def _closure() -> Cells:
    """The empty span: insertions of user and assistant rows."""
    one: Cells = {(p, p): (0, "") for p in range(4)}
    for (p, letter), q in STEPS.items():
        if letter in LETTERS:
            one[p, q] = min(one.get((p, q), (INSERT, "I")), (INSERT, "I"))
    while (more := combine(one, one)) != one:
        one = more
    return one


EMPTY = _closure()


def terminal(code: str) -> Cells:
    """A row's cells, insertions before it closed in. ``code``: role initial (s, u, a, else o) in upper case if the row is truncated, ``-`` if it must go."""
    out: Cells = {(p, p): (DELETE, "D") for p in range(4)}
    if code != "-":
        extra = CUT if code.isupper() else 0
        for (p, letter), q in STEPS.items():
            edits = [(KEEP + extra, "K")] if letter == code.lower() else []
            edits += [(REROLE + extra, "R")] if letter in LETTERS else []
            if edits:
                out[p, q] = min(edits)
    return combine(EMPTY, out)


def parse(codes: str, known: dict[str, Cells]) -> Cells:
    """Cells of a block of rows, bottom-up; those of short spans are kept in ``known``."""
    level = [known.get(c) or known.setdefault(c, terminal(c)) for c in codes]
    width = 1
    while len(level) > 1:
        width *= 2
        new = []
        for i in range(0, len(level) - 1, 2):
            key = codes[i * width // 2:i * width // 2 + width]
            cell = known.get(key) if width <= 8 else None
            if cell is None:
                cell = combine(level[i], level[i + 1])
                if width <= 8 and len(known) < CACHE:
                    known[key] = cell
            new.append(cell)
        level = new + level[len(level) - len(level) % 2:]
    return level[0] if level else EMPTY


def cheapest(cells: Cells) -> tuple[int, str]:
    """(cost, audit) of a whole conversation, insertions after the last row closed in."""
    whole = combine(cells, EMPTY)
    return min(whole[0, q] for q in ENDS if (0, q) in whole)


def repaired(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation; ``rows`` are all its rows in order, read one by one."""
    state = 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit in "RI":
            role = LETTERS["a" if state == 2 else "u"]
        state = STEPS[state, role[0]]
        yield role, text


COUNTS = ("blank", "duplicate", "truncated", "illegal")
CELL = T.StructType([T.StructField("p", T.IntegerType()), T.StructField("q", T.IntegerType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())])
HEAD = T.StructType([*[T.StructField(c, T.LongType()) for c in (*COUNTS, "n")], T.StructField("first", T.StringType()),
                     T.StructField("last", T.StringType()), T.StructField("cells", T.ArrayType(CELL))])
LEGAL = ("su", "ua", "au")


def _cells(c: Cells) -> list[dict]:
    return [{"p": p, "q": q, "cost": v[0], "audit": v[1]} for (p, q), v in c.items()]


def _map(df: DataFrame, conv: str, fn, extra: list[T.StructField], out: T.StructType) -> DataFrame:
    """Per row of (conv, extra, list): ``fn(list)`` to the fields of ``out``."""
    schema = T.StructType([df.schema[conv], *extra, *out.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            rows = [fn(v) for v in batch.column("_list").to_pylist()]
            yield {conv: batch.column(conv), **{f.name: batch.column(f.name) for f in extra}, **{f.name: [r[f.name] for r in rows] for f in out.fields}}
    return map_arrow(df, run, schema)


def _leaf(rows: list[dict]) -> dict:
    """A block: marks of first holders beside the rows, in any order."""
    known = worker_cache("repair", dict)
    firsts = {r["i"] for r in rows if r["kind"] is None and r["i"] is not None}
    body = sorted((r for r in rows if r["kind"] is not None), key=lambda r: r["i"])
    n = dict.fromkeys(COUNTS, 0)
    codes, before = [], None
    for r in body:
        kind = "blank" if r["kind"] == "blank" else "duplicate" if r["i"] not in firsts else r["kind"]
        if kind in n:
            n[kind] += 1
        c = r["initial"] if r["initial"] and r["initial"] in "sua" else "o"
        codes.append("-" if kind in ("blank", "duplicate") else c.upper() if kind == "truncated" else c)
        n["illegal"] += before is not None and before + r["initial"] not in LEGAL
        before = r["initial"]
    return {**n, "n": len(body), "first": body[0]["initial"] if body else None, "last": before, "cells": _cells(parse("".join(codes), known))}


def _join(parts: list[dict]) -> dict:
    """Neighbouring blocks, in any order, to one."""
    parts = sorted(parts, key=lambda r: r["block"])
    n = {c: sum(p[c] for p in parts) for c in COUNTS}
    n["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(parts, parts[1:]))
    level = [{(c["p"], c["q"]): (c["cost"], c["audit"]) for c in p["cells"]} for p in parts]
    return {**n, "n": sum(p["n"] for p in parts), "first": parts[0]["first"], "last": parts[-1]["last"], "cells": _cells(reduce(combine, level))}


def parsed(rows: DataFrame, ids: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           block: int = BLOCK, fan: int = FAN, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(conv, blank, duplicate, truncated, illegal, cost, audit) for every conversation of ``rows`` and of ``ids``.

    Rows are taken by turn, nulls first, ties by role and then by a hash of the
    text; a null conversation is one of its own, null roles and texts are one
    space. A row counts with its first fault: blank, duplicate (role and text
    seen earlier), truncated (its last character that is no space is not one of
    ``.!?``). Conversations without rows have zeros and an empty audit.
    """
    r = _ordered(rows, conv, turn, role, text)
    end = F.rtrim(F.col("_text"), F.lit(SPACES))
    kind = F.when(end == "", "blank").when(F.right(end, F.lit(1)).isin(".", "!", "?"), "whole").otherwise("truncated")
    light = r.select(conv, "_turn", "_role", "_hash", kind.alias("kind"))
    light = stored(number_rows(light, [conv], [F.col("_turn").asc_nulls_first(), F.col("_role"), F.col("_hash")],
                               F.coalesce("_turn", F.lit(-(1 << 63))), "i", piece_rows).select(
        conv, (F.col("i") - 1).cast("long").alias("i"), F.left("_role", F.lit(1)).alias("initial"), "kind", "_hash"))
    none = F.lit(None).cast("string")
    marks = light.groupBy(conv, "_hash").agg(F.min("i").alias("i")).select(conv, "i", none.alias("initial"), none.alias("kind"))
    empty = (rows if ids is None else ids).select(conv).distinct().select(conv, F.lit(None).cast("long").alias("i"), none.alias("initial"), none.alias("kind"))
    whole = [T.StructField("block", T.LongType())]
    every = light.drop("_hash").unionByName(marks).unionByName(empty)
    b = _map(every.groupBy(conv, F.coalesce(F.floor(F.col("i") / block), F.lit(0)).cast("long").alias("block")).agg(
        F.collect_list(F.struct("i", "initial", "kind")).alias("_list")), conv, _leaf, whole, HEAD)
    most = (light.agg(F.max("i")).first()[0] or 0) // block
    while most:
        b = _map(stored(b).groupBy(conv, F.floor(F.col("block") / fan).cast("long").alias("up")).agg(
            F.collect_list(F.struct("block", *HEAD.names)).alias("_list")).withColumnRenamed("up", "block"), conv, _join, whole, HEAD)
        most //= fan
    out = T.StructType([*[f for f in HEAD.fields if f.name in COUNTS], T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())])

    def finish(v: dict) -> dict:
        cost, audit = cheapest({(c["p"], c["q"]): (c["cost"], c["audit"]) for c in v["cells"]})
        return {**{c: v[c] for c in COUNTS}, "cost": cost, "audit": audit}
    return _map(b.select(conv, F.struct(*HEAD.names).alias("_list")), conv, finish, [], out)


def _ordered(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    r, t = F.coalesce(F.col(role), F.lit(" ")), F.coalesce(F.col(text), F.lit(" "))
    return rows.select(F.col(conv), F.col(turn).cast("long").alias("_turn"), r.alias("_role"), t.alias("_text"),
                       F.unhex(F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, t), 256)).alias("_hash"))


def _stream(rows: DataFrame, heads: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """A conversation's audit, then its rows in order, conversations one after another in sorted partitions."""
    null = lambda t: F.lit(None).cast(t)
    body = _ordered(rows, conv, turn, role, text).select(conv, F.lit(1).alias("_k"), "_turn", "_role", "_hash", "_text", null("string").alias("_audit"))
    head = heads.select(conv, F.lit(0).alias("_k"), null("long").alias("_turn"), null("string").alias("_role"), null("binary").alias("_hash"),
                        null("string").alias("_text"), F.col("audit").alias("_audit"))
    return head.unionByName(body).repartition(conv).sortWithinPartitions(
        conv, "_k", F.col("_turn").asc_nulls_first(), "_role", "_hash").select(conv, "_k", "_turn", "_role", "_text", "_audit")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str, Iterator[tuple[int | None, str, str]]]]:
    """(conv, audit, rows) one after another; a conversation's rows are read as they come and never gathered."""
    flat = (x for b in batches for x in zip(*[c.to_pylist() for c in b.columns]))
    ahead = next(flat, None)
    while ahead is not None:
        head = ahead

        def rows():
            nonlocal ahead
            while (ahead := next(flat, None)) is not None and ahead[1]:
                yield ahead[2:5]
        body = rows()
        yield head[0], head[5], body
        for _ in body:  # what the reader has left
            pass


def repair(rows: DataFrame, heads: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations: (conv, place, role, text), place from 0. ``heads``: ``parsed`` of the same rows."""
    schema = T.StructType([rows.schema[conv], T.StructField("place", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        out, size = [], 0
        for c, audit, body in _conversations(batches):
            for i, (r, t) in enumerate(repaired(audit, (x[1:] for x in body))):
                out.append((c, i, r, t))
                size += len(t)
                if size > 4 << 20 or len(out) == 10_000:
                    yield dict(zip(schema.names, zip(*out)))
                    out, size = [], 0
        if out:
            yield dict(zip(schema.names, zip(*out)))
    return map_arrow(_stream(rows, heads, conv, turn, role, text), run, schema)


def summary(rows: DataFrame, heads: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, gaps, repaired_sha256): missing turns between the first and the last, and the hash of the repaired ``role:text`` lines.

    A hash of a whole conversation is taken in one sweep over its sorted rows, in
    bounded memory; that sweep is the only work that a long conversation does not split.
    """
    schema = T.StructType([rows.schema[conv], T.StructField("gaps", T.LongType()), T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        out = []
        for c, audit, body in _conversations(batches):
            first = last = None
            turns = 0

            def seen():
                nonlocal first, last, turns
                for t, r, x in body:  # noqa: B023
                    if t is not None:
                        turns += t != last
                        first, last = t if first is None else first, t
                    yield r, x
            rest, h = seen(), hashlib.sha256()
            for i, (r, x) in enumerate(repaired(audit, rest)):
                h.update(f"{chr(10) if i else ''}{r}:{x}".encode())
            for _ in rest:
                pass
            out.append((c, 0 if first is None else last - first + 1 - turns, h.hexdigest()))
            if len(out) == 10_000:
                yield dict(zip(schema.names, zip(*out)))
                out = []
        if out:
            yield dict(zip(schema.names, zip(*out)))
    return map_arrow(_stream(rows, heads, conv, turn, role, text), run, schema)
