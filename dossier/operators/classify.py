"""Rule ladders that give rows a status. Inputs are columns, rule values are parameters."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dossier.functions.numbers import NOT_DISCLOSED_RE, policy_equivalent
from dossier.functions.rules import issue_array, ladder


def reliability(hits: DataFrame, qid: str, anchor: str, domain_bad: str, entity_bad: Column, check: int = 3) -> DataFrame:
    """Per query: abstain, reason and confidence from the flags of the first ``check`` hits."""
    ok = F.col(anchor) & ~F.col(domain_bad) & ~entity_bad
    top = F.col("rank") <= check
    g = hits.withColumn("_ok", ok).withColumn("_e", entity_bad).groupBy(qid).agg(
        F.bool_or(F.when(top, F.col(anchor))).alias("has_anchor"), F.bool_or(F.when(top, F.col(domain_bad))).alias("has_domain"),
        F.bool_or(F.when(top, F.col("_e"))).alias("has_entity"), F.bool_or(F.when(top, F.col("_ok"))).alias("answerable"),
        F.bool_or(F.when(F.col("rank") == 1, F.col("_ok"))).alias("top_ok"))
    f = lambda c: F.coalesce(F.col(c), F.lit(False))
    return g.select(qid, (~f("answerable")).alias("abstain"),
                    F.when(~f("answerable"), ladder([(~f("has_anchor"), "metric_anchor_missing"), (f("has_domain"), "domain_mismatch"),
                                                     (f("has_entity"), "entity_mismatch")], "no_answerable_evidence")).alias("reason"),
                    ladder([(f("answerable") & f("top_ok"), "high"), (f("answerable"), "medium")], "low").alias("confidence"),
                    issue_array([(~f("has_anchor"), "metric_anchor_missing"), (f("has_domain"), "domain_mismatch"),
                                 (f("has_entity"), "entity_mismatch"), (~f("answerable"), "no_answerable_evidence")]).alias("flags"))


def guard(abstain: Column, n_items: Column, n_answerable: Column) -> Column:
    """Reason not to generate, null when generation may run."""
    return ladder([(abstain, "abstain_recommended"), (n_items == 0, "no_items"), (n_answerable == 0, "no_answerable_item")], None)


def pair_resolution(df: DataFrame, ds_value: Column, ds_abstain: Column, ds_hit: Column, ds_correct: Column, in_value: Column,
                    in_ok: Column, in_conf: Column, in_resolved: Column, ds_there: Column, in_there: Column,
                    auto: float = 0.85, candidate: float = 0.5) -> DataFrame:
    """Adds status (match, two backfills, conflict, insufficient, none), best answer, origin, auto-confirm, owner.

    The status is a column of its own, so the later ladders read it instead of
    repeating the value comparison.
    """
    blank = lambda c: F.coalesce(F.trim(c.cast("string")), F.lit("")) == ""
    no = F.lit(False)
    ds = ds_there & ~F.coalesce(ds_abstain, no) & ~blank(ds_value)
    inn = in_there & F.coalesce(in_ok, no) & ~blank(in_value) & ~F.coalesce(in_value.rlike(NOT_DISCLOSED_RE), no)
    partial = (ds_there & ~F.coalesce(ds_abstain, no) & F.coalesce(ds_hit, no)) | (in_there & (F.coalesce(in_conf, F.lit(0.0)) >= candidate))
    d = df.withColumns({"_ds": ds, "_in": inn, "_part": partial, "_same": F.coalesce(policy_equivalent(ds_value, in_value), no),
                        "_auto": (F.coalesce(in_conf, F.lit(0.0)) >= auto) & F.coalesce(in_resolved, no)})
    c = F.col
    d = d.withColumn("status", ladder([
        (~c("_ds") & ~c("_in") & c("_part"), "INSUFFICIENT_EVIDENCE"), (~c("_ds") & ~c("_in"), "NO_ANSWER_FOUND"),
        (~c("_in"), "BACKFILL_FROM_DATASET"), (~c("_ds"), "BACKFILL_FROM_INTERNAL"), (c("_same"), "MATCH_CONFIRMED")], "CONFLICT_REVIEW_REQUIRED"))
    st = c("status")
    return d.withColumns({
        "best_answer": ladder([(st.isin("BACKFILL_FROM_DATASET", "MATCH_CONFIRMED"), ds_value), (st == "BACKFILL_FROM_INTERNAL", in_value),
                               (st == "INSUFFICIENT_EVIDENCE", F.coalesce(F.when(~blank(ds_value), ds_value), in_value))], F.lit(None).cast("string")),
        "origin": ladder([(st == "INSUFFICIENT_EVIDENCE", "candidate"), (st == "BACKFILL_FROM_DATASET", "dataset"),
                          (st == "BACKFILL_FROM_INTERNAL", "internal_doc"), (st == "MATCH_CONFIRMED", "both_confirmed"),
                          (st == "CONFLICT_REVIEW_REQUIRED", "unresolved")], None),
        "auto_confirm": ladder([(st == "BACKFILL_FROM_DATASET", F.coalesce(ds_correct, F.lit(True))), (st == "BACKFILL_FROM_INTERNAL", c("_auto")),
                                (st == "MATCH_CONFIRMED", F.lit(True))], False),
        "review_owner": ladder([(st == "INSUFFICIENT_EVIDENCE", "RAG"), (st == "CONFLICT_REVIEW_REQUIRED", "SME"),
                                ((st == "BACKFILL_FROM_INTERNAL") & ~c("_auto"), "SME")], None),
    }).drop("_ds", "_in", "_part", "_same", "_auto")


def conflict_status(resolved: Column, n_flags: Column, sufficiency: Column, n_confirming: Column, n_roles: Column,
                    n_absent: Column, n_missing: Column, mode: Column, all_undisclosed: Column) -> Column:
    """Eight classes, tested in this order."""
    has = F.coalesce(resolved != "", F.lit(False))
    confirm = F.when(n_confirming > 0, n_confirming).otherwise(n_roles)
    cross = mode == "cross_document_answer"
    return ladder([
        (has & resolved.rlike(NOT_DISCLOSED_RE), "not_disclosed"),
        (n_flags > 0, "conflict_numeric"),
        (sufficiency == "conflict_unresolved", "conflict_numeric"),
        ((confirm >= 2) & has, "multi_source_confirmed"),
        ((sufficiency == "partial_metric_absent_in_role") | ((n_absent > 0) & ~has), "metric_absent"),
        (sufficiency == "resolved_single_source_sufficient", "single_source_sufficient"),
        (cross & has & (n_missing > 0) & (n_roles >= 1), "conflict_numeric"),
        (cross & (n_roles < 2) & sufficiency.isin("partial_missing_numeric_role", "failed"), "insufficient_cross_doc_support"),
        (has & (n_roles >= 2), "multi_source_confirmed"),
        (has, "single_source_sufficient"),
        (all_undisclosed, "not_disclosed")], "metric_absent")


def extraction_confidence(base: Column, narrative: Column, narrative_conf: Column, success: Column, holdout: Column,
                          n_floor: float = 0.72, t_floor: float = 0.85, h_floor: float = 0.78) -> Column:
    """Floors for narrative values; a stricter one for held-out companies."""
    c = F.when(narrative, F.greatest(base, F.coalesce(narrative_conf, F.lit(0.0)))).otherwise(base)
    src = ladder([(narrative & (c < n_floor) & success, "narrative_floor_min"), (narrative, "narrative_metric_parse"),
                  (success & (c >= t_floor), "table_extraction_strong")], "table_row_match_score")
    c2 = F.when(narrative & success, F.greatest(c, F.lit(n_floor))).otherwise(c)
    c3 = F.when(holdout & narrative & success, F.greatest(c2, F.lit(h_floor))).otherwise(c2)
    return F.struct(F.round(F.least(F.lit(1.0), c3), 4).alias("confidence"), src.alias("confidence_source"))


def field_status(value: Column, score: Column, conflict: Column, strong: float = 0.55, weak: float = 0.35) -> Column:
    """(status, confidence) of one extracted field."""
    st = ladder([(value.isNull(), "insufficient"), (conflict, "conflict"), (score >= strong, "verified")], "extracted")
    cf = ladder([(value.isNull() | conflict, "low"), (score >= strong, "high"), (score >= weak, "medium")], "low")
    return F.struct(st.alias("status"), cf.alias("confidence"))


def intake_partition(question: Column, source: Column, gold: Column, undisclosed: Column) -> Column:
    """answerable / abstain / needs_review with its reasons."""
    blank = lambda c: F.coalesce(F.trim(c.cast("string")), F.lit("")) == ""
    reasons = issue_array([(blank(question), "missing_question"), (blank(source) & ~undisclosed, "missing_source"),
                           (blank(gold) & ~undisclosed, "missing_gold")])
    part = ladder([(F.size(reasons) > 0, "needs_review"), (undisclosed, "abstain")], "answerable")
    sev = ladder([(F.size(reasons) >= 2, "high"), (F.size(reasons) == 1, "medium")], "none")
    return F.struct(part.alias("partition"), F.array_join(reasons, ",").alias("reasons"), sev.alias("severity"))


def source_class(url: Column, file_url: Column, filing_hosts: list[str]) -> Column:
    """File first, then filing site, public web, missing; with the action to take."""
    host = F.try_parse_url(url, F.lit("HOST"))
    has = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    k = ladder([(has(file_url), "file"), (has(url) & host.isin(*filing_hosts), "web_filing"), (has(url), "web_public")], "missing")
    act = ladder([(k == "file", "use_local"), (k == "web_filing", "collect_filing"), (k == "web_public", "download")], "ask_owner")
    return F.struct(k.alias("kind"), act.alias("action"), host.alias("host"))


def fail_stage(parsed: Column, planned_in_corpus: Column, retrieved: Column, aggregated: Column, qualitative: Column) -> Column:
    return ladder([(~parsed, "parser_gap"), (~planned_in_corpus, "coverage_gap"), (~retrieved, "retrieval_gap"),
                   (~aggregated, "aggregation_gap"), (qualitative, "synthesis_gap")], "ready")


def readiness(stage: Column, kind: Column, undisclosed: Column, sufficiency: Column, agg_ok: Column, extracted: Column,
              needs_merge: Column, wrong_row: Column, has_units: Column) -> Column:
    return ladder([
        (stage == "coverage_gap", "coverage_gap"), (kind == "qualitative", "not_ready_for_synthesis"),
        (undisclosed, "honest_abstain"), (sufficiency == "resolved_single_source_sufficient", "single_source_sufficient"),
        (agg_ok & (sufficiency == "resolved"), "multi_source_sufficient"), (agg_ok, "aggregation_ready"),
        (extracted & ~needs_merge, "extraction_ready"), (wrong_row, "needs_sme_review"),
        (~has_units, "coverage_gap")], "retrieval_ready")


def promotion(readiness_state: Column, confidence: Column, conflict: Column, wrong_row: Column, qualitative: Column,
              floor: float = 0.6) -> Column:
    """Blockers; a row without any is promoted."""
    b = issue_array([(~readiness_state.isin("single_source_sufficient", "multi_source_sufficient", "aggregation_ready", "extraction_ready"), "not_ready"),
                     (confidence < floor, "confidence_below_floor"), (conflict == "conflict_numeric", "numeric_conflict"),
                     (wrong_row, "wrong_row_risk"), (qualitative, "qualitative_gate")])
    return F.struct((F.size(b) == 0).alias("promoted"), F.array_join(b, ",").alias("blockers"))


def review_owner(readiness_state: Column, promoted: Column, confidence: Column, floor: float, wrong_row: Column, kind: Column) -> Column:
    r = lambda o, s, i: F.struct(F.lit(o).alias("owner"), F.lit(s).alias("review_status"), F.lit(i).alias("rule"))
    return ladder([(promoted & (confidence >= floor), r("none", "auto_confirmed", "promoted_confident")),
                   (promoted, r("RAG", "spot_check", "promoted_low_confidence")), (wrong_row, r("SME", "review", "wrong_row_risk")),
                   (readiness_state == "coverage_gap", r("data", "collect_source", "coverage_gap")),
                   (kind == "qualitative", r("SME", "write", "qualitative"))], r("RAG", "improve", "default"))


def route_field(category: Column, priority: Column, base_k: int = 4, base_pool: int = 24) -> Column:
    """Retrieval settings per field category; priority fields look further."""
    mode = ladder([(category.isin("policy", "governance"), "hybrid_dense_bm25"), (category.isin("metric", "number"), "bm25_lexical")], "semantic_dense")
    return F.struct(mode.alias("mode"), (F.lit(base_k) + F.when(priority, 2).otherwise(0)).alias("top_k"),
                    (F.lit(base_pool) * F.when(priority, 2).otherwise(1)).alias("pool"))


def gates(metrics: DataFrame, thresholds: dict[str, float], keys: list[str]) -> DataFrame:
    """metric >= minimum per metric, and whether all hold."""
    u = metrics.unpivot(keys, list(thresholds), "metric", "value")
    lim = F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv])
    u = u.withColumn("minimum", lim[F.col("metric")]).withColumn("ok", F.coalesce(F.col("value") >= F.col("minimum"), F.lit(False)))
    g = u.groupBy(*keys).agg(F.every("ok").alias("all_ok")) if keys else None
    return u.join(g, keys) if keys else u.withColumn("all_ok", u.agg(F.every("ok")).scalar())


def status_ladder(cases: list[tuple[Column, str]], default: str = "not_pass") -> Column:
    return ladder(cases, default)
