"""Numbers, years, units and value equivalence."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from dossier.functions.rules import alias_of
from dossier.functions.text import let, norm_ws, strip

# Number and sentinel patterns.
NUMBER_RE = r"(-?[\d,]+(?:\.\d+)?)"
NOT_DISCLOSED_RE = r"(?i)not disclosed|not available|n/a"


def years_in(c: Column, lo: int = 2015, hi: int = 2035) -> Column:
    ys = F.transform(F.regexp_extract_all(c, F.lit(r"(20\d{2})"), F.lit(1)), lambda y: y.cast("int"))
    return F.filter(ys, lambda y: y.between(lo, hi))


def infer_year(c: Column, fallback: Column | None = None) -> Column:
    y = F.array_max(years_in(c))
    return F.coalesce(y, fallback) if fallback is not None else y


def first_year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(20\d{2})", 1), F.lit("")).cast("int")


def metric_from_question(c: Column) -> Column:
    """Last slash part, up to the first parenthesis."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "/"), lambda s: strip(s)), lambda p: p != "")
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    return strip(F.split(last, r"\(")[0])


def kv_pairs(c: Column) -> Column:
    """`k=v | k=v` to a map, trimmed; a repeated key keeps its last value."""
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda p: F.locate("=", p) > 1)
    ents = F.filter(F.transform(parts, lambda p: F.struct(
        strip(F.substring_index(p, "=", 1)).alias("k"),
        strip(F.substring(p, F.locate("=", p) + 1, F.length(p))).alias("v"))), lambda e: e["k"] != "")
    def build(es):
        keys = F.array_distinct(F.transform(es, lambda e: e["k"]))
        last = let(keys, lambda ks: F.map_from_arrays(ks, F.transform(
            ks, lambda k: F.element_at(F.filter(es, lambda e: e["k"] == k), -1)["v"])))
        return F.when(F.size(keys) == F.size(es), F.map_from_entries(es)).otherwise(last)
    return let(ents, build)


def numbers_in_text(c: Column) -> Column:
    """Signed numbers, commas allowed; runs that are no number are skipped."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(NUMBER_RE), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double")),
                    lambda v: v.isNotNull())


def to_int(c: Column) -> Column:
    return F.coalesce(F.replace(c, F.lit(","), F.lit("")).try_cast("double").cast("long"), F.lit(0).cast("long"))


def amount(c: Column, currency: str = "KRW") -> Column:
    bare = strip(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit(currency), F.lit("")), F.lit(","), F.lit("")))
    return F.nullif(F.regexp_extract(bare, r"(-?\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")


def period_value(fields: Column, question_year: Column, doc_year: Column,
                 period_re: str = r"term\s*(\d+)") -> Column:
    """Value of the period that lies ``doc_year - question_year`` back; the oldest beyond that."""
    items = F.array_sort(F.transform(
        F.filter(F.map_entries(fields), lambda e: e["key"].rlike(period_re)),
        lambda e: F.struct((-F.regexp_extract(e["key"], period_re, 1).cast("int")).alias("o"), e["value"].alias("v"))))
    off = F.when(question_year.isNull() | doc_year.isNull(), F.lit(0)).otherwise(
        F.greatest(F.lit(0), doc_year - question_year))
    return F.when(F.size(items) > 0, amount(F.get(items, F.least(off, F.size(items) - 1))["v"]))


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def format_number(v: Column, unit: Column, million_units=("million",)) -> Column:
    """Percent with one decimal; million units whole; else at most six decimals."""
    six = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", v), "0+$", ""), r"\.$", "")
    return (F.when(unit == "%", F.format_string("%.1f", v))
            .when(unit.isin(*million_units), F.bround(v, 0).cast("long").cast("string"))
            .when(v == F.floor(v), v.cast("long").cast("string")).otherwise(six))


def tolerance(unit: Column, million_units=("million",)) -> Column:
    return F.when(unit == "%", 0.15).when(unit.isin(*million_units), 1.0).otherwise(0.05)


def close_enough(a: Column, b: Column, unit: Column) -> Column:
    return F.abs(a - b) <= tolerance(unit)


def field_number(c: Column, decimal_comma: bool = False) -> Column:
    """First number in a field; commas are thousands unless the locale says decimal."""
    s = F.replace(c, F.lit(","), F.lit("." if decimal_comma else ""))
    return F.nullif(F.regexp_extract(s, r"(\d+\.?\d*)", 1), F.lit("")).try_cast("double")


def field_number_checked(c: Column, lo: float | None = None, hi: float | None = None) -> tuple[Column, Column]:
    """(value, reject reason) with plausibility bounds given by the caller."""
    v = field_number(c)
    bad = F.lit(False)
    if lo is not None:
        bad = bad | (v < lo)
    if hi is not None:
        bad = bad | (v > hi)
    return F.when(~F.coalesce(bad, F.lit(False)), v), F.when(bad, F.lit("rejected_implausible"))


def scale_unit(c: Column) -> Column:
    low = F.lower(strip(c))
    return F.when(low.isin("mil", "million"), "USD million").when(low == "billion", "USD billion").otherwise(
        F.nullif(strip(c), F.lit("")))


def target_unit(question: Column, table_unit: Column) -> Column:
    u = strip(table_unit)
    q = F.lower(question)
    return (F.when(u.isNotNull() & ~F.lower(u).isin("", "nan", "-"), u)
            .when(q.rlike(r"%|percent|ratio|rate|share"), "%")
            .when(q.rlike(r"how many|number of|count|headcount"), "count")
            .when(q.rlike(r"revenue|cost|amount|price|sales"), "currency"))


# Unit suffixes left out of a number.
UNIT_SUFFIX_RE = r"(?i)\s*(?:tco2e|tco2|co2e|%|usd|krw|million|mil|billion)\b"


def numeric_core(c: Column) -> Column:
    """The number of a value without unit, commas and spaces; sentinels stay."""
    raw = strip(c)
    low = F.lower(raw)
    cleaned = F.replace(F.replace(F.regexp_replace(raw, UNIT_SUFFIX_RE, ""), F.lit(","), F.lit("")), F.lit(" "), F.lit(""))
    num = F.nullif(F.regexp_extract(cleaned, r"(\d+(?:\.\d+)?)", 1), F.lit(""))
    return F.when(raw.isNull() | (raw == ""), F.lit(None)).when(
        low.isin("not disclosed", "n/a", "-", "present", "scope_3"), low).otherwise(
        F.coalesce(num, F.nullif(cleaned, F.lit("")), raw))


def canonical_value(c: Column, variants: dict[str, str] | None = None) -> Column:
    """Canonical key of a surface value: registry variant, grade, scope, year, number, token."""
    return let(norm_ws(c, lower=True), lambda raw: _canonical(raw, variants or {}))


def _canonical(raw: Column, variants: dict[str, str]) -> Column:
    # The canonical keys.
    reg = F.lit(None).cast("string")
    if variants:
        m = F.create_map(*[F.lit(x) for kv in variants.items() for x in (kv[0].lower(), kv[1])])
        reg = F.try_element_at(m, raw)
    return (F.when(raw == "", F.lit(None))
            .when(raw.rlike(r"^a\+$"), "esg_grade_a_plus").when(raw.rlike(r"^a$"), "esg_grade_a")
            .when(reg.isNotNull(), reg)
            .when(raw.rlike(r"^[a-z][+]?$"), F.concat(F.lit("grade:"), F.upper(raw)))
            .when(raw.rlike(r"^scope\s*3$") | (raw == "scope_3"), "scope_3")
            .when(raw.rlike(r"^20\d{2}$"), F.concat(F.lit("year:"), raw))
            .when(raw.rlike(r"^[\d,]+(?:\.\d+)?$"), F.replace(raw, F.lit(","), F.lit(""))).otherwise(raw))


def values_equivalent(a: Column, b: Column, variants: dict[str, str] | None = None) -> Column:
    """Same canonical key, same text, or the same without spaces or commas."""
    bare = lambda x, ch: F.replace(x, F.lit(ch), F.lit(""))
    pair = F.struct(norm_ws(a, lower=True).alias("a"), norm_ws(b, lower=True).alias("b"))
    same = let(pair, lambda p: (p["a"] == p["b"]) | (bare(p["a"], " ") == bare(p["b"], " ")) | (bare(p["a"], ",") == bare(p["b"], ","))
               | F.coalesce(_canonical(p["a"], variants or {}) == _canonical(p["b"], variants or {}), F.lit(False)))
    return F.when(a.isNull() | b.isNull(), F.lit(False)).otherwise(same)


def numbers_agree(x: Column, y: Column, tol: float = 0.001) -> Column:
    """Relative tolerance, also with a factor of 1000 either way."""
    one = F.lit(1.0)
    return ((F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), one) <= tol)
            | (F.abs(x * 1000 - y) / F.greatest(F.abs(y), one) <= tol)
            | (F.abs(y * 1000 - x) / F.greatest(F.abs(x), one) <= tol))


def numeric_values_equivalent(a: Column, b: Column, variants: dict[str, str] | None = None,
                              tol: float = 0.001) -> Column:
    """``values_equivalent``, or numbers that agree with the scale rule, or equal text without a unit."""
    pair = F.struct(numeric_core(a).alias("a"), numeric_core(b).alias("b"))
    num = let(pair, lambda p: let(F.struct(p["a"].try_cast("double").alias("x"), p["b"].try_cast("double").alias("y")), lambda n: F.when(
        n["x"].isNotNull() & n["y"].isNotNull(), numbers_agree(n["x"], n["y"], tol)).otherwise(F.lower(p["a"]) == F.lower(p["b"]))))
    return values_equivalent(a, b, variants) | F.coalesce(num, F.lit(False))


def policy_value(c: Column) -> Column:
    return F.lower(F.replace(norm_ws(c), F.lit(","), F.lit("")))


def policy_equivalent(a: Column, b: Column, tol: float = 0.01) -> Column:
    na, nb = policy_value(a), policy_value(b)
    num = F.coalesce(F.abs(na.try_cast("double") - nb.try_cast("double")) <= tol, F.lit(False))
    return F.when((na == "") & (nb == ""), F.lit(True)).when((na == "") | (nb == ""), F.lit(False)).otherwise(
        (na == nb) | num)


def value_type(c: Column) -> Column:
    low = norm_ws(c, lower=True)
    return (F.when(c.isNull() | (low == ""), "unknown").when(low.rlike(NOT_DISCLOSED_RE), "not_disclosed")
            .when(F.replace(low, F.lit(","), F.lit("")).rlike(r"^-?\d+(\.\d+)?\s*%?$"), "numeric")
            .when(low.isin("yes", "no", "true", "false", "present"), "boolean").otherwise("text"))


def split_answer(value: Column, status: Column) -> Column:
    """Mixed gold answers as three typed columns plus the sentinel flag."""
    nd = F.lower(F.coalesce(status, F.lit(""))).rlike("not disclosed") | F.coalesce(value.rlike(NOT_DISCLOSED_RE), F.lit(False))
    num = F.replace(strip(value), F.lit(","), F.lit("")).try_cast("double")
    return F.struct(F.when(~nd, num).alias("gold_num"),
                    F.when(~nd & num.isNull(), strip(value)).alias("gold_text"),
                    nd.alias("is_not_disclosed"))


def question_type(value: Column, unit: Column) -> Column:
    low = norm_ws(value, lower=True)
    return F.when(F.coalesce(unit, F.lit("")) != "", "quantitative").when(
        F.replace(low, F.lit(","), F.lit("")).try_cast("double").isNotNull(), "quantitative").when(
        low.isin("yes", "no", "y", "n", "o", "x"), "yes_no").otherwise("qualitative")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9가-힣]+", "_"), r"^_+|_+$", "")


def metric_label_key(label: Column, item: Column) -> Column:
    """The plan item when label and item hold one another, else the label without years and symbols."""
    l, i = norm_ws(label, lower=True), norm_ws(item, lower=True)
    key = norm_ws(F.regexp_replace(F.regexp_replace(l, r"\d{4}", ""), r"[^a-z0-9가-힣+]+", " "))
    return F.when((i != "") & (l.contains(i) | i.contains(l)), F.concat(F.lit("item:"), item)).when(
        key == "", l).otherwise(key)


def unit_alias(c: Column, aliases: dict[str, str]) -> Column:
    return alias_of(norm_ws(c, lower=True), aliases)
