"""Rule tables as folded column expressions.

A rule list is a parameter of bounded length, so it becomes one expression on
the scanned row: no join, no nested loop, and it stays inside codegen.
Rules are given in priority order.
"""
from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, functions as F


def contains_any(col: Column, needles: Iterable[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | col.contains(n)
    return out


def matches_any(col: Column, patterns: Iterable[str]) -> Column:
    pats = list(patterns)
    return col.rlike("|".join(f"(?:{p})" for p in pats)) if pats else F.lit(False)


def count_matching(col: Column, needles: Iterable[str]) -> Column:
    """How many of the needles occur at least once."""
    out = F.lit(0)
    for n in needles:
        out = out + col.contains(n).cast("int")
    return out


def first_match(col: Column, rules: Sequence[tuple[str, str]], default: str | None = None,
                regex: bool = True) -> Column:
    """Value of the first rule (pattern, value) that fits, else ``default``."""
    out = None
    for pat, val in rules:
        cond = col.rlike(pat) if regex else col.contains(pat)
        out = F.when(cond, F.lit(val)) if out is None else out.when(cond, F.lit(val))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def all_matches(col: Column, rules: Sequence[tuple[str, str]], regex: bool = True) -> Column:
    """Array of the values of every rule that fits, in rule order."""
    return F.array_compact(F.array(*[
        F.when(col.rlike(p) if regex else col.contains(p), F.lit(v)) for p, v in rules]))


def weight_sum(col: Column, rules: Sequence[tuple[str, float]], regex: bool = True) -> Column:
    out = F.lit(0.0)
    for pat, w in rules:
        out = out + F.when(col.rlike(pat) if regex else col.contains(pat), F.lit(float(w))).otherwise(0.0)
    return out


def ladder(cases: Sequence[tuple[Column, object]], default=None) -> Column:
    """CASE WHEN ladder: the first true condition wins."""
    out = None
    for cond, val in cases:
        v = val if isinstance(val, Column) else F.lit(val)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    d = default if isinstance(default, Column) else F.lit(default)
    return d if out is None else out.otherwise(d)


def first_reason(cases: Sequence[tuple[Column, str]]) -> Column:
    """Reason of the first failed test; null when all pass."""
    return ladder(cases, None)


def issue_array(cases: Sequence[tuple[Column, object]]) -> Column:
    """All reasons that hold, in order."""
    return F.array_compact(F.array(*[
        F.when(c, v if isinstance(v, Column) else F.lit(v)) for c, v in cases]))


def alias_of(col: Column, aliases: dict[str, str]) -> Column:
    """Canonical form from a small alias map; unknown values stay."""
    if not aliases:
        return col
    m = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.try_element_at(m, col), col)
