"""Question-set curation: triage, canonical merge, gold decision, QC, promotion."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dossier.functions.rules import contains_any, first_match, first_reason, issue_array, ladder
from dossier.functions.signals import cleanliness, n_matches
from dossier.functions.text import char_ngrams, cluster_fingerprint, containment, let, norm_ws, pad_id, qc_overlap, strip
from dossier.operators.bounds import best_per_key
from dossier.operators.select import collapse_clusters


def triage(question: Column, disclosure: Column, generic: list[str], chrome: str, substance: str, min_disclosure: int = 40) -> Column:
    """struct(decision, reason): reject, rewrite or keep."""
    q, d = F.lower(question), F.lower(disclosure)
    r = lambda x, y: F.struct(F.lit(x).alias("decision"), F.lit(y).alias("reason"))
    return ladder([
        (strip(d) == "", r("reject", "empty_disclosure")), (d.rlike(chrome), r("reject", "page_chrome")),
        (F.length(disclosure) < min_disclosure, r("reject", "short_disclosure")), (~d.rlike(substance), r("reject", "no_substance")),
        (contains_any(q, generic), r("rewrite", "generic_question"))], r("keep", "specific"))


def curation_class(question: Column, disclosure: Column, names: list[tuple[str, str, int]]) -> Column:
    """struct(class, priority) by ordered patterns over question and disclosure."""
    blob = F.lower(F.concat_ws(" ", question, disclosure))
    cases = [(blob.rlike(p), F.struct(F.lit(c).alias("class"), F.lit(n).alias("priority"))) for p, c, n in names]
    return ladder(cases, F.struct(F.lit("other").alias("class"), F.lit(99).alias("priority")))


def cluster_of(question: Column, rules: list[tuple[str, str]]) -> Column:
    """Cluster by ordered rules; what fits none gets a hash name."""
    low = F.lower(question)
    return F.coalesce(first_match(low, rules), F.concat(F.lit("h_"), F.md5(norm_ws(low))))


def collapse_candidates(df: DataFrame, row_id: str, question: str, passage: str, decision: str, strength: str,
                        rules: list[tuple[str, str]]) -> DataFrame:
    """Kept and rewritten rows of one cluster and fingerprint: the strongest is the anchor, the rest collapse."""
    d = df.withColumn("cluster_id", cluster_of(F.col(question), rules)).withColumn("fp", cluster_fingerprint(F.col(passage)))
    live, dead = d.filter(F.col(decision).isin("keep", "rewrite")), d.filter(~F.col(decision).isin("keep", "rewrite"))
    c = collapse_clusters(live, ["cluster_id", "fp"], F.col(strength), row_id)
    dead = dead.withColumns({"anchor_id": F.lit(None).cast(c.schema["anchor_id"].dataType), "group_size": F.lit(0).cast("long"), "action": F.lit("rejected")})
    return c.unionByName(dead)


def canonical_merge(df: DataFrame, row_id: str, target: str, fp: str, strength: str) -> DataFrame:
    """Anchor per target and fingerprint keeps; the others drop and name their anchor."""
    out = collapse_clusters(df, [target, fp], F.col(strength), row_id)
    return out.withColumn("decision", F.when(F.col("action") == "anchor", "keep").otherwise("drop")).withColumn(
        "drop_reason", F.when(F.col("action") != "anchor", F.concat(F.lit("duplicate_of:"), F.col("anchor_id").cast("string"))))


def canonical_dedupe(df: DataFrame, keys: list[str], target: str, noisy: Column, drifted: Column, score: str, row_id: str) -> DataFrame:
    """Unknown target, noise and drift go first; then one row per key by score."""
    why = first_reason([(F.col(target).isNull(), "unknown_target"), (noisy, "noisy"), (drifted, "drifted")])
    d = df.withColumn("drop_reason", why)
    return best_per_key(d.filter("drop_reason is null"), keys, [F.col(score).desc(), F.col(row_id)])


def lane(noise: Column, facts: Column, clear: Column) -> Column:
    return ladder([(noise >= 4, "reject"), ((facts >= 3) & clear, "A"), (facts >= 2, "B"), (facts >= 1, "C")], "reject")


def manual_decision(lane_: Column, clean: Column, specific: Column) -> Column:
    r = lambda x, y: F.struct(F.lit(x).alias("decision"), F.lit(y).alias("note"))
    return ladder([(lane_ == "reject", r("drop", "lane_reject")), ((lane_ == "A") & (clean >= 0.8), r("confirm", "clean_a")),
                   (lane_.isin("A", "B") & (specific >= 2), r("revise", "specific_enough")), (clean < 0.4, r("drop", "unclean"))], r("revise", "default"))


def gold_decision(question: Column, disclosure: Column, cluster_ok: Column, chrome: str, prohibited: Column) -> Column:
    """approve / hold / reject with the reasons to hold."""
    low = F.lower(disclosure)
    hold = issue_array([(~strip(question).endswith("?"), "no_question_mark"), (F.length(question) < 20, "short_question"),
                        (~cluster_ok, "cluster_open"), (F.length(disclosure) > 600, "long_disclosure")])
    dec = ladder([(low.rlike(chrome), "reject"), (prohibited, "reject"), (F.size(hold) > 0, "hold")], "approve")
    return F.struct(dec.alias("decision"), F.array_join(hold, ",").alias("reasons"))


def freeze(df: DataFrame, decision: str, company: str, order: str, question: str, answer: str, context: str) -> DataFrame:
    """Approved rows to the gold schema with running ids per company."""
    from dossier.operators.bounds import number_rows
    a = number_rows(df.filter(F.col(decision) == "approve"), [company], [F.col(order)], F.col(order), "_n")
    return a.select(F.concat_ws("-", F.lit("GOLD"), F.upper(company), pad_id(F.col("_n"), 4)).alias("gold_id"), company,
                    F.col(question).alias("question"), F.col(context).alias("context"), F.col(answer).alias("answer"), F.col(order).alias("source_row"))


def qc_status(question: Column, answer: Column, context: Column, min_q: int = 12, min_a: int = 8, min_overlap: float = 0.15,
              strict: bool = True) -> Column:
    """struct(status, reason)."""
    verb = (F.length(strip(answer)) > 0) & F.lower(context).contains(F.lower(strip(answer)))
    why = first_reason([(F.length(strip(question)) < min_q, "question_too_short"), (F.length(strip(answer)) < min_a, "answer_too_short"),
                        (strip(context) == "", "empty_context"), (qc_overlap(answer, context) < min_overlap, "low_overlap"),
                        ((~verb) & F.lit(strict), "answer_not_in_context")])
    return F.struct(F.when(why.isNull(), "pass").otherwise("reject").alias("status"), why.alias("reason"))


def silver_rubric(question: Column, answer: Column, span: Column, unit_text: Column, duplicate: Column) -> Column:
    """Three scores of 0..2 and the decision."""
    faith = F.when(unit_text.contains(span) & span.contains(answer), 2).when(unit_text.contains(answer), 1).otherwise(0)
    grams = F.struct(char_ngrams(question).alias("q"), char_ngrams(answer).alias("n"), char_ngrams(unit_text).alias("u"))
    shares = let(grams, lambda g: F.struct(containment(g["q"], g["n"]).alias("rel"), containment(g["n"], g["u"]).alias("ground")))

    def judged(s: Column) -> Column:
        dec = ladder([(duplicate, "reject_duplicate"), (s["faith"] == 0, "reject"),
                      ((s["faith"] == 2) & (s["ground"] == 2) & (s["rel"] >= 1), "promote")], "revise")
        return F.struct(s["faith"].alias("faithfulness"), s["rel"].alias("relevancy"), s["ground"].alias("groundedness"), dec.alias("decision"))
    return let(let(shares, lambda s: F.struct(
        faith.alias("faith"), F.when(s["rel"] >= 0.3, 2).when(s["rel"] >= 0.15, 1).otherwise(0).alias("rel"),
        F.when(s["ground"] >= 0.9, 2).when(s["ground"] >= 0.6, 1).otherwise(0).alias("ground"))), judged)


def span_check(span: Column, answer: Column, unit_text: Column, question: Column, weak: str, min_overlap: float = 0.5) -> Column:
    """Reason to drop a distilled row, null when it stands (judged on given model output)."""
    return first_reason([(strip(span) == "", "empty_span"), (~norm_ws(unit_text).contains(norm_ws(span)), "span_not_in_text"),
                         (containment(char_ngrams(answer), char_ngrams(span)) < min_overlap, "answer_not_in_span"),
                         (F.lower(question).rlike(weak), "weak_question")])


def promote_reviewed(df: DataFrame, decision: str, approved: list[str], revised: str, original: str, confidence: str, floor: float) -> DataFrame:
    """Approved rows with the revised text where there is one; judged rows need the confidence."""
    return df.filter(F.col(decision).isin(*approved) & (F.col(confidence) >= floor)).withColumn(
        "final_text", F.coalesce(F.nullif(strip(F.col(revised)), F.lit("")), F.col(original)))


def fact_codes(question: Column, answer: Column, target: Column, banned: list[str]) -> Column:
    """Error codes of a question/fact row."""
    return issue_array([(target.isNull(), "no_fact_target"), (contains_any(F.lower(question), banned), "banned_template"),
                        (n_matches(answer, r"\d+") == 0, "no_number"), (F.length(answer) < 60, "thin_answer"),
                        (cleanliness(answer) < 0.5, "unclean_answer")])


def answerability(family_known: Column, scope_hit: Column) -> Column:
    return ladder([(~family_known, "out_of_scope"), (scope_hit, "answerable")], "no_information")


def reuse_tiers(df: DataFrame, keys: list[str], tier: str, correct: Column) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[
        F.round(F.avg((F.col(tier) == t).cast("int")), 4).alias(f"{t}_share") for t in ("reusable", "tuned", "fallback")],
        F.round(F.avg(correct.cast("int")), 4).alias("accuracy"))
    return g
