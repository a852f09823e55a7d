"""Values out of tables, key=value lines and prose; resolution across documents."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from dossier.functions.numbers import (NOT_DISCLOSED_RE, format_number, kv_pairs, metric_label_key,
                                       numbers_agree, numeric_core, numeric_values_equivalent, period_value, scale_unit)
from dossier.functions.rules import ladder
from dossier.functions.text import let, norm_ws, occurrences, strip, token_set
from dossier.operators.bounds import best_per_key, broadcast_if_small, join_null_safe, top_k
from dossier.operators.chunking import table_rows, year_columns

GENERIC = ("the", "of", "and", "total", "number", "rate", "ratio", "amount")


def alias_phrases(item: Column, sub: Column, cat: Column, blob: Column, aliases: list[tuple[str, list[str]]]) -> Column:
    """Phrases an item goes by: itself, its path, and the aliases of every key found in the question."""
    low = lambda c: norm_ws(c, lower=True)
    parts = [F.array(F.nullif(low(item), F.lit("")), F.nullif(low(sub), F.lit("")),
                     F.when(sub.isNotNull() & item.isNotNull(), low(F.concat_ws(" ", sub, item))),
                     F.when(cat.isNotNull() & item.isNotNull(), low(F.concat_ws(" ", cat, item))))]
    for key, vals in aliases:
        parts.append(F.when(blob.contains(key), F.array(*[F.lit(v.lower()) for v in vals])).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.array_compact(F.concat(*parts)))


def specific_tokens(c: Column, generic=GENERIC) -> Column:
    return F.filter(token_set(c), lambda t: ~t.isin(*generic) & (F.length(t) >= 2))


def row_match(label: Column, item: Column, sub: Column, phrases: Column, bridges: Column, blob: Column) -> Column:
    """struct(score, reason): exact, subcategory, item in label, alias, bridge, token overlap less extra tokens."""
    l, i, s = norm_ws(label, lower=True), norm_ws(item, lower=True), norm_ws(sub, lower=True)
    near = lambda p: (p != "") & ((p == l) | l.contains(p) | p.contains(l))
    r = lambda v, n: F.struct((v if isinstance(v, Column) else F.lit(v)).alias("score"), F.lit(n).alias("reason"))
    q, t = specific_tokens(blob), specific_tokens(label)
    common, extra = F.size(F.array_intersect(q, t)), F.size(F.array_except(t, q))
    ov = F.greatest(F.lit(0.0), common / F.greatest(F.lit(1), F.size(q)) - 0.15 * extra)
    return ladder([
        ((i != "") & (i == l), r(1.0, "item_exact")),
        ((s != "") & ((s == l) | l.contains(s) | s.contains(l)), r(0.92, "subcategory_exact")),
        ((i != "") & l.contains(i), r(0.88, "item_in_label")),
        (F.exists(phrases, near), r(0.85, "alias")), (F.exists(bridges, near), r(0.87, "semantic_bridge")),
        (F.size(q) == 0, r(0.0, "no_specific_query_tokens")), (common == 0, r(0.0, "no_specific_overlap")),
        (ov < 0.35, r(ov, "token_overlap_weak"))], r(F.least(F.lit(0.75), ov), "token_overlap"))


def wrong_row_risk(score: Column, reason: Column, label: Column, blob: Column) -> Column:
    extra = F.size(F.array_except(specific_tokens(label), specific_tokens(blob)))
    safe = (score >= 0.85) | reason.isin("item_exact", "subcategory_exact", "item_in_label", "alias", "semantic_bridge")
    return ~safe & ((extra > 0) | (reason == "token_overlap_weak"))


def table_candidates(units: DataFrame, keep: list[str], text: str, years: list[int] | None = None) -> DataFrame:
    """Rows of pipe tables as (label, value, unit, year): year columns, else the second cell."""
    t = units.filter(F.col(text).contains("|")).select(*keep, F.explode(table_rows(F.col(text))).alias("_r"))
    cells, head = F.col("_r.cells"), F.col("_r.header")
    unit = F.when(F.size(cells) == F.size(head), F.element_at(cells, -1)).otherwise(F.element_at(head, -1))
    yc = year_columns(head)
    if years:
        yc = F.filter(yc, lambda y: y["year"].isin(*years))
    vals = F.when(F.size(year_columns(head)) > 0, F.transform(yc, lambda y: F.struct(y["year"].alias("year"), F.get(cells, y["idx"]).alias("value")))).otherwise(
        F.array(F.struct(F.lit(None).cast("int").alias("year"), F.get(cells, F.lit(1)).alias("value"))))
    out = t.select(*keep, F.get(cells, F.lit(0)).alias("label"), unit.alias("unit"), F.explode(vals).alias("_v")).select(
        *keep, "label", "unit", "_v.year", strip(F.col("_v.value")).alias("value"))
    ok = (F.col("value") != "") & ~F.col("value").rlike(NOT_DISCLOSED_RE) & (F.col("year").isNotNull() | F.col("value").rlike(r"\d"))
    return out.filter(ok).withColumn("normalized", F.replace("value", F.lit(","), F.lit(""))).withColumn("normalized_unit", scale_unit(F.col("unit")))


def narrative_candidates(units: DataFrame, keep: list[str], text: str, patterns: list[tuple[str, str]], context: int = 40) -> DataFrame:
    """(hint, value, snippet) for every place a pattern holds; group 1 of the pattern is the value.

    Patterns are given without a capturing group around the whole.
    """
    def one(hint, pat):
        bare = re.sub(r"(?<!\\)\((?!\?)", "(?:", pat)
        return F.transform(occurrences(F.col(text), bare, context), lambda m: F.struct(
            F.lit(hint).alias("hint"), F.regexp_extract(m["match"], pat, 1).alias("value"), m["snippet"].alias("snippet")))
    found = F.flatten(F.array(*[one(h, p) for h, p in patterns]))
    out = units.select(*keep, F.posexplode(found).alias("pos", "_m")).select(*keep, "pos", "_m.*")
    return out.filter((F.col("value") != "") & ~F.col("snippet").rlike("(?i)not disclosed")).withColumn(
        "year", F.nullif(F.regexp_extract("snippet", r"(20\d{2})", 1), F.lit("")).cast("int"))


def concept_candidates(units: DataFrame, keep: list[str], text: str, concepts: list[tuple[str, str]]) -> DataFrame:
    """Presence values: a concept pattern occurs or it does not."""
    return units.select(*keep, F.explode(F.array_compact(F.array(*[
        F.when(F.col(text).rlike(f"(?i){p}"), F.struct(F.lit(p).alias("concept"), F.lit(v).alias("value"))) for p, v in concepts]))).alias("_c")).select(
        *keep, "_c.concept", "_c.value")


def plausible(cands: DataFrame, item: str, rules: Column) -> DataFrame:
    """Drop cross-metric values; an item that would lose all keeps all.

    Items may be of any size, so the test for "any left" is an aggregate joined
    back, not a window over the item.
    """
    c = cands.withColumn("_ok", F.coalesce(rules, F.lit(False)))
    g = c.groupBy(item).agg(F.max("_ok").alias("_any"))
    return join_null_safe(c, broadcast_if_small(g), [item]).filter(F.col("_ok") | ~F.col("_any")).drop("_ok", "_any")


def best_per_document(cands: DataFrame, item: str, doc: str, score: str, order: str) -> DataFrame:
    return best_per_key(cands, [item, doc], [F.col(score).desc(), F.col(order)])


def pick_single_source(cands: DataFrame, item: str, primary: Column, score: str, year: str, order: str, preview: int = 5) -> DataFrame:
    """Primary document first, then score, then later year; the best value with a preview of the next."""
    o = [primary.desc(), F.col(score).desc(), F.col(year).desc_nulls_last(), F.col(order)]
    top = top_k(cands, [item], o, preview, "_r")
    return top.groupBy(item).agg(F.min_by("value", "_r").alias("value"), F.min_by(score, "_r").alias("best_score"),
                                 F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "value"))), lambda e: e["value"]), ",").alias("preview"))


def _with_winner(cands: DataFrame, item: str, year: str, told: Column, win: Column, score: str, order: str) -> DataFrame:
    """Candidates of the target year (and undated ones) that pass ``told``, each with the fields of its item's winner.

    The winner comes from one aggregate per (item, year), which combines before
    the shuffle, and a small one per item; it goes back to the candidates in one
    join, broadcast while the items are few and else open to skew handling.
    """
    o = F.struct((~F.col("_p")).alias("a"), (-F.col(score)).alias("b"), F.col(order).alias("c"))
    best = F.min(F.when(told, F.struct(o.alias("o"), win.alias("w"))))
    per_year = cands.groupBy(item, year).agg(best.alias("_e"))
    top = per_year.groupBy(item).agg(F.max(year).alias("_y"), F.array_agg(F.struct(F.col(year).alias("y"), F.col("_e").alias("e"))).alias("_all"))
    pick = F.array_min(F.transform(F.filter("_all", lambda x: (x["y"].isNull() | (x["y"] == F.col("_y"))) & x["e"].isNotNull()), lambda x: x["e"]))
    winner = top.withColumn("_w", pick).filter("_w is not null").select(item, "_y", "_w.w.*")
    return join_null_safe(cands.filter(told), broadcast_if_small(winner), [item]).filter(
        F.col(year).isNull() | (F.col(year) == F.col("_y"))).drop("_y")


def resolve(cands: DataFrame, item: str, doc: str, value: str, year: str, score: str, primary: Column, order: str) -> DataFrame:
    """One value per item out of candidates of many documents.

    Target year is the latest one; undated rows stay in. Disclosed values only.
    The best primary value wins and supporting values that differ are flagged;
    without a primary value the best metric group decides. Numbers conflict
    beyond the tolerance. Flags are found by comparing with the chosen value,
    so no pair of rows is formed; confirming documents are counted here and listed
    as rows by ``confirming``.
    """
    seen = cands.withColumn("_p", primary)
    told = ~F.coalesce(F.col(value).rlike(NOT_DISCLOSED_RE), F.lit(True))
    win = F.struct(F.col(value).alias("resolved_value"), F.col(doc).alias("resolved_doc"), F.col("_p").alias("by_primary"), F.col(score).alias("best_score"))
    j = _with_winner(seen, item, year, told, win, score, order)
    clash = ~numeric_values_equivalent(F.col(value), F.col("resolved_value"))
    res = j.groupBy(item, "resolved_value", "resolved_doc", "by_primary", "best_score").agg(
        F.count_if(clash & ((F.col("by_primary") & ~F.col("_p")) | ~F.col("by_primary"))).alias("n_conflicts"),
        F.countDistinct(F.when(~clash, F.col(doc))).alias("n_confirming"), F.countDistinct(doc).alias("n_docs"))
    return res.withColumn("resolution_status", F.when(F.col("n_conflicts") > 0, "resolved_with_preference_rule").otherwise("resolved")).withColumn(
        "multi_source_confirmed", (F.col("n_confirming") >= 2) & (F.col("n_conflicts") == 0))


def confirming(cands: DataFrame, resolved: DataFrame, item: str, doc: str, value: str) -> DataFrame:
    """(item, document) rows of the documents whose value agrees with the resolved one."""
    c = join_null_safe(cands.filter(~F.col(value).rlike(NOT_DISCLOSED_RE)), broadcast_if_small(resolved.select(item, "resolved_value")), [item])
    return c.filter(numeric_values_equivalent(F.col(value), F.col("resolved_value"))).select(item, doc).distinct()


def resolve_numeric(cands: DataFrame, item: str, doc: str, value: str, year: str, score: str, primary: Column, order: str,
                    tol: float = 0.001) -> DataFrame:
    """``resolve`` for values that are numbers already; confirming documents are counted, not listed."""
    win = F.struct(F.col(value).alias("resolved_value"), F.col(doc).alias("resolved_doc"), F.col("_p").alias("by_primary"))
    j = _with_winner(cands.withColumn("_p", primary), item, year, F.lit(True), win, score, order)
    same = numbers_agree(F.col(value), F.col("resolved_value"), tol)
    return j.groupBy(item, "resolved_value", "resolved_doc", "by_primary").agg(
        F.count_if(~same & ~(F.col("by_primary") & F.col("_p"))).alias("n_conflicts"), F.countDistinct(F.when(same, F.col(doc))).alias("n_confirming"),
        F.countDistinct(doc).alias("n_docs"))


def sufficiency(resolved: Column, status: Column, n_conflicts: Column, strong: Column, n_with_metric: Column, missing_required: Column,
                absent_by_design: Column) -> Column:
    return ladder([
        (status == "conflict_unresolved", "conflict_unresolved"), (resolved.isNull(), "failed"),
        ((n_conflicts > 0) & (status != "resolved_with_preference_rule"), "conflict_unresolved"),
        (strong & (n_with_metric == 1) & (missing_required == 0), "resolved_single_source_sufficient"),
        (missing_required > 0, "partial_missing_numeric_role"), (absent_by_design > 0, "partial_metric_absent_in_role")], "resolved")


def role_classes(roles: DataFrame, item: str, doc: str, position: str, desc: str, csv_doc: str | None = None) -> DataFrame:
    """required / optional per (item, document): first primary required, supporting and context optional."""
    low = F.lower(F.coalesce(desc, F.lit("")))
    opt = (F.col(doc) == F.lit(csv_doc)) if csv_doc else F.lit(False)
    cls = ladder([(opt | low.contains("numeric table evidence"), "optional"), (F.col(position) == 1, "required"),
                  (low.contains("supporting") | low.contains("context"), "optional")], "required")
    return roles.withColumn("role_class", cls)


def fusion_preview(cands: DataFrame, item: str, label: str, doc: str) -> DataFrame:
    """Candidate groups per item: documents and distinct values in each."""
    g = cands.withColumn("metric_group", metric_label_key(F.col(label), F.col(item)))
    return g.groupBy(item, "metric_group").agg(F.countDistinct(doc).alias("n_docs"), F.countDistinct("value").alias("n_values"))


def records_of(text: Column) -> Column:
    """Distinct `k=v` lines of a text as maps."""
    lines = F.array_distinct(F.filter(F.transform(F.split(text, "\n"), lambda s: strip(F.regexp_replace(strip(s), r"^[- ]+", ""))),
                                      lambda s: s.contains("=")))
    return F.transform(lines, lambda s: kv_pairs(s))


def employee_answers(df: DataFrame, key: str, sex: str, total: str, regular: str, salary: str, male: str = "M", female: str = "F") -> DataFrame:
    """Head count, share of women, share of regulars, average pay, pay ratio; one pass."""
    s = lambda c, w=None: F.sum(F.when(F.col(sex) == w, F.col(c)) if w else F.col(c))
    pay = lambda w: F.try_divide(s(salary, w), s(total, w))
    return df.groupBy(key).agg(
        s(total).alias("headcount"), F.round(F.try_divide(100.0 * s(total, female), s(total)), 1).alias("female_pct"),
        F.round(F.try_divide(100.0 * s(regular), s(total)), 1).alias("regular_pct"),
        F.round(F.try_divide(s(salary), s(total)), 2).alias("avg_pay"),
        F.round(F.try_divide(100.0 * pay(female), pay(male)), 1).alias("pay_ratio_pct"))


def executive_answers(df: DataFrame, key: str, sex: str, outside: Column, female: str = "F") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.round(100.0 * F.avg((F.col(sex) == female).cast("int")), 1).alias("female_pct"),
                               F.count_if(outside).alias("outside"), F.count_if(~outside).alias("inside"))


def financial_answers(lines: DataFrame, key: str, rank: str, pos: str, line: Column, question_year: Column, doc_year: Column, unit: Column,
                      keywords: list[str], statement: str | None = None) -> DataFrame:
    """First account line by (hit rank, line) that fits statement and keywords and has a value.

    A line is parsed once: the test sits in the generator, where no filter can
    be pushed below it and parse again.
    """
    get = lambda m, k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(""))
    parsed = let(kv_pairs(line), lambda m: F.struct(get(m, "account").alias("acc"), get(m, "statement").alias("st"),
                                                    period_value(m, question_year, doc_year).alias("v")))
    def fits(s):
        ok = s["v"].isNotNull()
        if keywords:
            ok = ok & _any_in(s["acc"], keywords)
        return ok & s["st"].contains(statement) if statement else ok
    c = lines.select(key, rank, pos, unit.alias("_u"), F.explode(F.filter(F.array(parsed), fits)).alias("_s"))
    best = c.groupBy(key).agg(F.min_by(F.struct(F.col("_s.v").alias("_v"), "_u"), F.struct(rank, pos)).alias("_b"))
    val = F.when(F.col("_b._u") == "million", F.col("_b._v") / 1e6).otherwise(F.col("_b._v"))
    return best.select(key, format_number(val, F.col("_b._u")).alias("answer"))


def _any_in(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def sanction_answer(text: Column, zero_re: str, number_re: str = r"(\d+)") -> Column:
    """0 when a zero sign is there, else the first number."""
    return F.when(text.rlike(zero_re), "0").otherwise(F.nullif(F.regexp_extract(text, number_re, 1), F.lit("")))


def first_answer(extractors: list[tuple[str, Column]]) -> Column:
    """struct(answer, reason) of the first extractor that finds something: UDF-free dispatch."""
    return F.coalesce(*[F.when(c.isNotNull(), F.struct(c.alias("answer"), F.lit(n).alias("reason"))) for n, c in extractors])


def extract_fields(hits: DataFrame, schema: list[dict], qid: str, text: str, preferred: Column, max_rank: int = 8) -> DataFrame:
    """Schema fields x hits: the first value by (preferred source, rank), with conflict and the source kept.

    ``schema``: dicts with field, pattern (group 1 is the value), type.
    """
    found = F.array_compact(F.array(*[
        F.when(F.col(text).rlike(s["pattern"]), F.struct(F.lit(s["field"]).alias("field"), F.lit(s["type"]).alias("type"),
                                                         F.regexp_extract(text, s["pattern"], 1).alias("value"))) for s in schema]))
    c = hits.filter(F.col("rank") <= max_rank).withColumn("_pref", preferred).select(qid, "rank", "_pref", F.explode(found).alias("_f")).select(qid, "rank", "_pref", "_f.*")
    return c.groupBy(qid, "field", "type").agg(
        F.min_by("value", F.struct((~F.col("_pref")).alias("a"), F.col("rank").alias("b"))).alias("value"),
        F.countDistinct(F.coalesce(numeric_core(F.col("value")), F.col("value"))).alias("n_values")).withColumn("conflict", F.col("n_values") > 1)


def verify(attempts: DataFrame, key: str, attempt: str, score: str, base_score: str) -> DataFrame:
    """First attempt that improves on the start, else the start: all attempts lie in one plan."""
    better = F.col(score) > F.col(base_score)
    return attempts.groupBy(key, base_score).agg(F.min(F.when(better, F.col(attempt))).alias("attempt"),
                                                 F.min_by(score, F.when(better, F.col(attempt))).alias("new_score")).withColumn(
        "final_score", F.coalesce("new_score", base_score))


def policy_boost(fields: DataFrame, docs: DataFrame, rules: list[tuple[str, str, str]], field: str, doc: str, text: str) -> DataFrame:
    """Unresolved fields take a value from a named document when its pattern holds there."""
    got = docs.filter(F.col(doc).isin(*{r[1] for r in rules})).select(F.explode(F.array_compact(F.array(*[
        F.when((F.col(doc) == d) & F.col(text).rlike(p), F.struct(F.lit(f).alias("f"), F.regexp_extract(text, p, 1).alias("v"))) for f, d, p in rules]))).alias("_m"))
    best = got.groupBy(F.col("_m.f").alias(field)).agg(F.min("_m.v").alias("_bv"))
    return fields.join(best, field, "left").withColumn("value", F.coalesce("value", "_bv")).drop("_bv")


def text_occurrences(df: DataFrame, keep: list[str], text: str, pattern: str, context: int = 80) -> DataFrame:
    """Every occurrence of a pattern with the characters around it."""
    return df.select(*keep, F.posexplode(occurrences(F.col(text), pattern, context)).alias("pos", "_o")).select(
        *keep, "pos", "_o.match", "_o.snippet")
