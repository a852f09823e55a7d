"""Joins with declared duplicate handling, containment joins without all-pairs, reconciliation."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dossier.operators.bounds import best_per_key, top_k
from dossier.operators.matching import contains_pairs, route_scores
from dossier.session import materialise


def last_wins(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key: the last by the declared order (what a dict index keeps)."""
    return best_per_key(df, keys, [order.desc()])


def first_wins(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    return best_per_key(df, keys, [order.asc()])


def containment_join(docs: DataFrame, needles: DataFrame, doc_key: str, doc_text: str, needle_key: str,
                     needle_text: str) -> DataFrame:
    """(doc, needle) where the document holds the needle as a plain substring; an empty needle is in no document."""
    return contains_pairs(docs, doc_key, doc_text, needles, needle_key, needle_text)


def attach_record(hits: DataFrame, records: DataFrame, text: str, record_id: str, order: str) -> DataFrame:
    """Record id parsed from the chunk text, looked up; repeated ids keep the last loaded record."""
    rec = last_wins(records, [record_id], F.col(order))
    h = hits.withColumn(record_id, F.nullif(F.regexp_extract(text, r"(?i)record_id:\s*(\S+)", 1), F.lit("")))
    return h.join(rec, record_id, "left")


def passes_record_filters(year: Column, want_year: Column, etype: Column, want_type: Column) -> Column:
    """A hit without a record passes only when no filter is set."""
    return ((want_year.isNull()) | F.coalesce(year == want_year, F.lit(False))) & (
        (want_type.isNull()) | F.coalesce(etype == want_type, F.lit(False)))


def resolution_join(left: DataFrame, right: DataFrame, qid: str, bk: str, l_order: Column, r_order: Column) -> DataFrame:
    """Full outer by question id; rows without a question id full outer by business key.

    Each side keeps its last row per key before it is joined. Columns of the
    sides must differ except for the two keys.
    """
    def split(df, order):
        return last_wins(df.filter(F.col(qid).isNotNull()), [qid], order), last_wins(df.filter(F.col(qid).isNull()), [bk], order)
    lq, lb = split(left, l_order)
    rq, rb = split(right, r_order)
    a = lq.withColumnRenamed(bk, "_lbk").join(rq.withColumnRenamed(bk, "_rbk"), qid, "full_outer").withColumn(
        bk, F.coalesce("_lbk", "_rbk")).drop("_lbk", "_rbk").withColumn("join_type", F.lit("question_id"))
    b = lb.drop(qid).join(rb.drop(qid), bk, "full_outer").withColumn(qid, F.lit(None).cast(left.schema[qid].dataType)).withColumn(
        "join_type", F.lit("business_key"))
    return a.unionByName(b)


def primary_source(sources: DataFrame, key: str, priority: str, real: Column, tie: str) -> DataFrame:
    """One source per key: one with a priority first, then one with a real address."""
    return best_per_key(sources, [key], [F.col(priority).isNotNull().desc(), F.col(priority).asc_nulls_last(),
                                         real.desc(), F.col(tie).asc()])


def route_documents(questions: DataFrame, doc_terms: DataFrame, qid: str, blob: str, doc: str, cap: int = 4,
                    fallback: str | None = None) -> DataFrame:
    """Documents whose terms (``term``, ``weight``) a question's text contains, weights added up; keep within one of the best, at most ``cap``."""
    s = materialise(route_scores(questions, qid, blob, doc_terms, doc, "term", "weight"))
    best = s.groupBy(qid).agg(F.max("route_score").alias("_m"))
    kept = s.join(best, qid).filter(F.col("route_score") >= F.greatest(F.lit(1), F.col("_m") - 1)).drop("_m")
    out = top_k(kept, [qid], [F.col("route_score").desc(), F.col(doc)], cap, "route_rank")
    if fallback is not None:
        rest = questions.select(qid).join(out, qid, "left_anti").select(
            qid, F.lit(fallback).alias(doc), F.lit(0).cast("long").alias("route_score"), F.lit(1).alias("route_rank"))
        out = out.unionByName(rest)
    return out


def evidence_plan(routed: DataFrame, questions: DataFrame, qid: str, doc: str, kind: str, cross_re: str,
                  blob: str) -> DataFrame:
    """Primary documents, answer mode and merge flags per question (document lists hold at most the cap)."""
    docs = routed.groupBy(qid).agg(F.transform(F.array_sort(F.collect_list(F.struct("route_rank", doc))),
                                               lambda e: e[doc]).alias("primary_documents"))
    q = questions.join(docs, qid, "left")
    n = F.coalesce(F.size("primary_documents"), F.lit(0))
    cross = (F.col(kind) == "qualitative") | (F.lower(blob).rlike(cross_re) & (n >= 2))
    return q.select(qid, kind, "primary_documents",
                    F.when(cross, "cross_document_answer").otherwise("single_document_answer").alias("answer_mode"),
                    F.when(F.col(kind) == "qualitative", F.lit(True)).otherwise(cross & (n >= 2)).alias("needs_merge"),
                    ((F.col(kind) != "qualitative") & cross & F.lower(blob).contains("not disclosed")).alias("needs_conflict_resolution"))


def skip_known(new: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    return new.join(known.select(*keys).distinct(), keys, "left_anti")


def prefer_local(web: DataFrame, local: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept web rows, skipped rows with the reason)."""
    k = local.select(*keys).distinct()
    return web.join(k, keys, "left_anti"), web.join(k, keys, "left_semi").withColumn("skip_reason", F.lit("local_copy"))


def fill_missing(rows: DataFrame, registry: DataFrame, title: str, cols: list[str], alias: Column) -> DataFrame:
    """Rows without source data take it by title, else by an alias of the title; the way is recorded."""
    r1 = registry.select(F.col(title), *[F.col(c).alias(f"_a_{c}") for c in cols])
    r2 = registry.select(F.col(title).alias("_alias"), *[F.col(c).alias(f"_b_{c}") for c in cols])
    out = rows.withColumn("_alias", alias).join(r1, title, "left").join(r2, "_alias", "left")
    c0 = cols[0]
    out = out.withColumn("fill_method", F.when(F.col(c0).isNotNull(), "present").when(F.col(f"_a_{c0}").isNotNull(), "title").when(
        F.col(f"_b_{c0}").isNotNull(), "alias").otherwise("missing"))
    for c in cols:
        out = out.withColumn(c, F.coalesce(c, f"_a_{c}", f"_b_{c}"))
    return out.select(*rows.columns, "fill_method")


def resolve_paths(rows: DataFrame, listing: DataFrame, key: str, candidates: str, path: str, name: str) -> DataFrame:
    """First candidate path that exists, else the file name; several files of one name are ambiguous."""
    c = rows.select(key, F.posexplode(candidates).alias("_p", path))
    direct = c.join(listing.select(path), path).groupBy(key).agg(F.min_by(path, "_p").alias("direct"))
    by_name = listing.groupBy(name).agg(F.count(F.lit(1)).alias("_n"), F.min(path).alias("_np"))
    nm = rows.select(key, F.substring_index(F.get(candidates, F.lit(0)), "/", -1).alias(name)).join(by_name, name, "left")
    out = rows.select(key).join(direct, key, "left").join(nm.select(key, "_n", "_np"), key, "left")
    return out.select(key, F.coalesce("direct", F.when(F.col("_n") == 1, F.col("_np"))).alias(path),
                      F.when(F.col("direct").isNotNull(), "candidate").when(F.col("_n") == 1, "file_name").when(
                          F.col("_n") > 1, "ambiguous").otherwise("missing").alias("method"))


def latest_per_key(df: DataFrame, keys: list[str], ts: str, cols: list[str]) -> DataFrame:
    """Newest row per key by aggregate, so copies of a key combine before the shuffle."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), ts).alias("_r"), F.max(ts).alias(ts)).select(*keys, ts, "_r.*")


def metric_deltas(a: DataFrame, b: DataFrame, metrics: list[str], keys: list[str], tol: float = 1e-9) -> DataFrame:
    """Metric by metric difference of two runs with better / worse / same."""
    ua = a.unpivot(keys, metrics, "metric", "before")
    ub = b.unpivot(keys, metrics, "metric", "after")
    d = F.col("after") - F.col("before")
    return ua.join(ub, [*keys, "metric"], "full_outer").withColumn("delta", d).withColumn(
        "verdict", F.when(d > tol, "better").when(d < -tol, "worse").when(d.isNotNull(), "same").otherwise("missing"))


def parity(a: DataFrame, b: DataFrame, keys: list[str], id_cols: list[str]) -> DataFrame:
    """Counts per key on both sides and how many ids are on one side only."""
    u = a.select(*keys, *id_cols, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(*keys, *id_cols, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    one = u.groupBy(*keys, *id_cols).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return one.groupBy(*keys).agg(F.sum("_a").alias("expected"), F.sum("_b").alias("stored"),
                                  F.count_if((F.col("_a") == 1) & (F.col("_b") == 0)).alias("only_expected"),
                                  F.count_if((F.col("_a") == 0) & (F.col("_b") == 1)).alias("only_stored"))
