"""Scoring of answers and hits, and the metrics made of the scores."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dossier.functions.rules import issue_array, ladder
from dossier.functions.text import char_ngrams, containment, let, normalize_path, strip, token_set


def match_reason(hit_record: Column, hit_doc: Column, hit_source: Column, want_record: Column, want_doc: Column,
                 want_source: Column, package_re: str, aliases: Column | None = None) -> Column:
    """Record id, document id, package, path alias: the first that fits; null when none does."""
    hs, ws = normalize_path(hit_source), normalize_path(want_source)
    pkg = lambda c: F.nullif(F.regexp_extract(c, package_re, 1), F.lit(""))
    split = lambda c: F.when(c.contains("/splits/"), F.substring_index(c, "/", -1))
    same_pkg = F.coalesce(pkg(hs) == pkg(ws), F.lit(False))
    al = aliases if aliases is not None else F.array(ws, F.substring_index(ws, "/", -1))
    eq = lambda a, b: F.coalesce((a == b) & (a != ""), F.lit(False))
    return ladder([
        (eq(hit_record, want_record), "exact_record"), (eq(hit_doc, want_doc), "same_document"),
        (same_pkg & F.coalesce(split(hs) == split(ws), F.lit(False)), "split_alias"), (same_pkg, "package"),
        (F.exists(al, lambda a: (F.length(a) >= 3) & hs.contains(a)), "path_alias")], None)


def retrieval_flags(hits: DataFrame, questions: DataFrame, qid: str, reason: str, compat_citation: bool = False) -> DataFrame:
    """Per question: hit anywhere, citation at rank 1, best reason, first position.

    ``compat_citation`` takes a match at any rank for the citation as well.
    """
    m = F.col(reason).isNotNull()
    g = hits.groupBy(qid).agg(
        F.bool_or(m).alias("retrieval_hit"), F.bool_or(m if compat_citation else m & (F.col("rank") == 1)).alias("citation_correct"),
        F.count_if(m).alias("topk_count"), F.min(F.when(m, F.col("rank"))).alias("first_rank"),
        F.min_by(F.when(m, F.col(reason)), F.when(m, F.col("rank"))).alias("match_reason"), F.count(F.lit(1)).alias("n_hits"))
    out = questions.select(qid).join(g, qid, "left")
    f = lambda c: F.coalesce(F.col(c), F.lit(False))
    return out.select(qid, f("retrieval_hit").alias("retrieval_hit"), f("citation_correct").alias("citation_correct"),
                      (F.coalesce("topk_count", F.lit(0)) > 0).alias("citation_topk_any"), "first_rank", "match_reason",
                      ladder([(F.col("n_hits").isNull(), "retrieval_no_evidence"), (~f("retrieval_hit"), "retrieval_true_miss")], None).alias("retrieval_code"))


def groundedness(answer: Column, evidence: Column, claims: Column, insufficient_expected: Column, insufficient: Column) -> Column:
    """Answer tokens in the evidence (pairs of characters below the threshold) or half of the claims found."""
    a, e = F.lower(F.coalesce(answer, F.lit(""))), F.lower(F.coalesce(evidence, F.lit("")))
    tok = containment(token_set(a), token_set(e))
    share = F.when(tok >= 0.18, tok).otherwise(F.greatest(tok, containment(char_ngrams(a), char_ngrams(e))))
    hits = F.size(F.filter(claims, lambda c: e.contains(c) | a.contains(c)))
    n = F.size(claims)
    claim_ok = F.when(n > 0, hits >= F.greatest(F.lit(1), F.floor(n / 2))).otherwise(share >= 0.12)
    return F.when(insufficient_expected, (e == "") | insufficient).when(e == "", F.lit(False)).otherwise((share >= 0.18) | claim_ok)


def answer_score(expected: Column, answer: Column, insufficient_expected: Column, insufficient: Column,
                 phrases: list[str], field_aliases: Column | None = None, booleans: tuple[str, ...] = ("yes", "no")) -> Column:
    """struct(ok, rule): the first rule that applies decides."""
    e, a = F.lower(F.coalesce(expected, F.lit(""))), F.lower(F.coalesce(answer, F.lit("")))
    says = F.lit(False)
    for p in phrases:
        says = says | a.contains(p)
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    pcts = F.regexp_extract_all(e, F.lit(r"(\d+(?:\.\d+)?)%"), F.lit(1))
    nums = F.regexp_extract_all(e, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    num_ok = F.exists(nums, lambda x: a.contains(x)) & ((F.size(pcts) == 0) | F.exists(pcts, lambda x: a.contains(x)))
    grams = containment(char_ngrams(e), char_ngrams(a))
    parts = F.filter(F.transform(F.split(e, "[,;]"), lambda p: strip(p)), lambda p: F.length(p) >= 3)
    part_ok = F.size(F.filter(parts, lambda p: a.contains(p))) >= F.greatest(F.lit(1), F.floor(F.size(parts) / 2))
    words = F.filter(F.split(e, r"[%\s]+"), lambda t: F.length(t) >= 3)
    word_ok = (F.size(words) == 0) | (F.size(F.filter(words, lambda t: a.contains(t))) >= F.greatest(F.lit(1), F.floor(F.size(words) / 2)))
    r = lambda ok, name: F.struct(ok.alias("ok"), F.lit(name).alias("rule"))
    alias_hit = F.exists(field_aliases, lambda x: a.contains(x)) if field_aliases is not None else F.lit(False)
    be, ba = bare(e), bare(a)
    return ladder([
        (~insufficient_expected & (insufficient | says), r(F.lit(False), "unexpected_insufficient")),
        (insufficient_expected, r(insufficient & says, "insufficient_flag_and_phrase")),
        (F.coalesce(alias_hit, F.lit(False)), r(F.lit(True), "field_alias")),
        (e.isin(*booleans), r(a.contains(e), "boolean")),
        (F.size(nums) > 0, r(num_ok, "numeric_or_percent")),
        ((F.length(be) >= 4) & (ba != "") & (ba.contains(be) | be.contains(ba)), r(F.lit(True), "substring")),
        (grams >= 0.28, r(F.lit(True), "char_pairs")),
        (F.size(parts) > 0, r(part_ok, "phrases"))], r(word_ok | (grams >= 0.18), "tokens"))


def insufficient_score(expected: Column, flagged: Column, says: Column) -> Column:
    return F.when(~expected, ~flagged | says).otherwise(flagged & says)


def overall_label(insufficient_expected: Column, insuf_ok: Column, hit: Column, cited: Column, grounded: Column, answer_ok: Column) -> Column:
    return ladder([(insufficient_expected & insuf_ok, "pass"), (insufficient_expected, "fail"),
                   (hit & cited & grounded & answer_ok, "pass"), (hit | answer_ok, "partial")], "fail")


def rate(flag: Column) -> Column:
    """Share of true over all rows, 0.0 for no rows, four places."""
    return F.round(F.coalesce(F.avg(F.coalesce(flag.cast("int"), F.lit(0))), F.lit(0.0)), 4)


def rates(df: DataFrame, flags: dict[str, Column], levels: list[list[str]] | None = None, dims: list[str] = ()) -> DataFrame:
    """All rates in one pass; ``levels`` are grouping sets over ``dims``."""
    aggs = [F.count(F.lit(1)).alias("n")] + [rate(c).alias(n) for n, c in flags.items()]
    if levels is None:
        return df.groupBy(*dims).agg(*aggs)
    sets = [[F.col(c) for c in lv] for lv in levels]
    return df.groupingSets(sets, *[F.col(d) for d in dims]).agg(*aggs)


def code_counts(df: DataFrame, codes: str, n: int | None = None) -> DataFrame:
    out = df.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.col("n").desc(), "code").limit(n) if n else out


def lower_nearest_rank(df: DataFrame, keys: list[str], value: str, share: float = 0.95) -> DataFrame:
    """``sorted[int(share * n) - 1]`` per key without sorting a group in one task.

    Values are counted first (copies combine), so the running count goes over
    distinct values; ranges of the value cut a large group in pieces.
    """
    from dossier.operators.bounds import join_null_safe, order_bucket
    c = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    b = order_bucket(c, F.col(value))
    piece = b.groupBy(*keys, "_b").agg(F.sum("_n").alias("_pn"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    piece = piece.withColumn("_off", F.coalesce(F.sum("_pn").over(before), F.lit(0))).withColumn(
        "_tot", F.sum("_pn").over(Window.partitionBy(*keys)))
    w = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    cum = join_null_safe(b.withColumn("_c", F.sum("_n").over(w)), piece.drop("_pn"), [*keys, "_b"])
    target = F.greatest(F.lit(1), F.floor(share * F.col("_tot")))
    hi = F.col("_off") + F.col("_c")
    return cum.filter((hi >= target) & (hi - F.col("_n") < target)).select(*keys, F.col(value).alias("p_value"), F.col("_tot").alias("n"))


def composite(df: DataFrame, weights: dict[str, float], latency: str, latency_weight: float, ok: Column) -> DataFrame:
    """Weighted sum with inverted min-max latency over the successful runs; failed runs get 0."""
    lim = df.agg(F.struct(F.min(F.when(ok, F.col(latency))).alias("lo"), F.max(F.when(ok, F.col(latency))).alias("hi"))).scalar()
    d = df.withColumn("_l", lim)
    inv = F.when(F.col("_l.hi") - F.col("_l.lo") < 1e-9, 1.0).otherwise(1 - (F.col(latency) - F.col("_l.lo")) / (F.col("_l.hi") - F.col("_l.lo")))
    s = latency_weight * inv
    for c, w in weights.items():
        s = s + w * F.coalesce(F.col(c), F.lit(0.0))
    return d.withColumn("composite", F.when(ok, F.round(s, 4)).otherwise(0.0)).drop("_l")


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    v = F.sum(F.col(value) * F.col(weight)) / F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))
    return df.groupBy(*keys).agg(F.round(v, 4).alias("weighted_mean"))


def confusion(df: DataFrame, rows: str, cols: str, values: list) -> DataFrame:
    return df.groupBy(rows).pivot(cols, values).agg(F.count(F.lit(1))).na.fill(0)


def consistency(a: DataFrame, b: DataFrame, field: str, value: str) -> DataFrame:
    """Share of fields with the same value in two runs (null equals null)."""
    j = a.select(field, F.col(value).alias("_x")).join(b.select(field, F.col(value).alias("_y")), field)
    return j.agg(F.count(F.lit(1)).alias("fields"), rate(F.col("_x").eqNullSafe(F.col("_y"))).alias("consistency"))


def pairwise_claims(evidence: Column, claims: Column) -> Column:
    """How many claims occur in the evidence."""
    return let(F.lower(evidence), lambda e: F.size(F.filter(claims, lambda c: e.contains(c))))


def validation_issues(df: DataFrame, key: str, checks: list[tuple[Column, str]]) -> DataFrame:
    """(row, issue): failed checks and repeated ids."""
    dup = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(key, F.lit("duplicate_id").alias("issue"))
    return df.select(key, F.explode(issue_array(checks)).alias("issue")).unionByName(dup)


def abstain_metrics(rows: DataFrame, group: str, answerable: Column, correct: Column, abstained: Column) -> DataFrame:
    """Answer rate over answerable rows (correct and not abstained), abstain rate over the others, and their mean.

    One row per group and one for ``all``; a side without rows has a null rate and counts 0 in the mean.
    """
    a = F.avg(F.when(answerable, (correct & ~abstained).cast("int")))
    b = F.avg(F.when(~answerable, abstained.cast("int")))
    g = rows.groupingSets([[], [F.col(group)]], F.col(group)).agg(
        F.count(F.lit(1)).alias("n"), a.alias("_a"), b.alias("_b"), F.grouping(group).alias("_g"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return g.select(F.when(F.col("_g") == 1, F.lit("all")).otherwise(F.col(group)).alias(group), "n", F.round("_a", 4).alias("answer_rate"),
                    F.round("_b", 4).alias("abstain_rate"), F.round((z("_a") + z("_b")) / 2, 4).alias("overall"))


def capability_metrics(rows: DataFrame, capability: str, ok: Column, tagged: Column) -> DataFrame:
    """Passed and total cases per capability, and the pass rate of the tagged ones (null without any)."""
    return rows.groupBy(F.col(capability).alias("capability")).agg(
        F.count_if(ok).alias("ok"), F.count(F.lit(1)).alias("total"),
        F.round(F.try_divide(F.count_if(ok & tagged), F.count_if(tagged)), 4).alias("tagged_rate"))


def readiness_summary(rows: DataFrame, group: str, state: Column) -> DataFrame:
    """How many rows of a group are in which state, with the share of the group; counts combine before the window."""
    return rows.groupBy(group, state.alias("state")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(group)), 4))


def blocker_counts(rows: DataFrame, group: str, blockers: Column) -> DataFrame:
    """Rows per blocker (an array column), in all and per group; the group is null on the totals."""
    b = rows.select(group, F.explode(blockers).alias("blocker"))
    return b.groupingSets([[F.col("blocker")], [F.col(group), F.col("blocker")]], F.col(group), F.col("blocker")).agg(F.count(F.lit(1)).alias("n"))


def source_agreement(rows: DataFrame, source: str, value: Column) -> DataFrame:
    """Distinct values per source, and the shares of those said twice or more and once."""
    g = rows.groupBy(source, value.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return g.groupBy(source).agg(F.count(F.lit(1)).alias("values_"), rate(F.col("_n") >= 2).alias("agreement_rate"), rate(F.col("_n") == 1).alias("single_rate"))


def confusion_counts(rows: DataFrame, outcomes: list[tuple[str, Column]]) -> DataFrame:
    """One row: how many rows each outcome holds for."""
    return rows.agg(*[F.count_if(c).alias(n) for n, c in outcomes])


def extraction_metrics(rows: DataFrame, group: str, found: Column, verified: Column, conflict: Column, value: Column) -> DataFrame:
    """Coverage, verified and conflict rates per field group, and the mean of the values found."""
    return rows.groupBy(F.col(group).alias("field_group")).agg(
        F.count(F.lit(1)).alias("fields"), rate(found).alias("coverage"), rate(verified).alias("verified"), rate(conflict).alias("conflict_rate"),
        F.round(F.avg(F.when(found, value)), 4).alias("mean_value"))
