"""Curation queries: documents as passages, conversations as question/answer drafts."""
from __future__ import annotations

from pyspark.sql import functions as F

from dossier.functions import signals as S, text as T
from dossier.operators import curation as CU
from dossier.plans.base import WS, query, sql_pad, sql_tokens, table
from dossier.plans.text import PAIRS, TA, _grams, turn_pairs
from dossier.plans.windows import CFP

TRI = """CASE WHEN trim(lower(a), ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'reject' WHEN regexp_matches(lower(a), '%%%|token') THEN 'reject' WHEN length(a) < 40 THEN 'reject' WHEN NOT regexp_matches(lower(a), 'tion|de ') THEN 'reject' WHEN contains(lower(q), 'the') THEN 'rewrite' ELSE 'keep' END"""
RULES = [("licensed", "legal"), ("que ", "romance"), ("the ", "english")]


def tri():
    return CU.triage(F.col("q"), F.col("a"), ["the"], "%%%|token", "tion|de ")


@query("candidate_triage", f"""WITH {PAIRS} SELECT conv_id, turn, {TRI} AS decision FROM pairs""")
def candidate_triage(spark, sf):
    return turn_pairs(spark, sf).select("conv_id", "turn", tri()["decision"].alias("decision"))


@query("candidate_collapse", rf"""WITH {PAIRS}, t AS (SELECT conv_id * 1000 + turn AS id, {TRI} AS decision, length(a) AS strength, CASE WHEN regexp_matches(lower(q), 'licensed') THEN 'legal' WHEN regexp_matches(lower(q), 'que ') THEN 'romance' WHEN regexp_matches(lower(q), 'the ') THEN 'english'
  ELSE 'h_' || md5(trim(regexp_replace(lower(q), '\s+', ' ', 'g'), {WS})) END AS cluster_id, {CFP.replace('text', 'a')} AS fp FROM pairs),
k AS (SELECT id, cluster_id, first_value(id) OVER (PARTITION BY cluster_id, fp ORDER BY strength DESC, id) AS anchor_id FROM t WHERE decision IN ('keep', 'rewrite'))
SELECT id, cluster_id, anchor_id, CASE WHEN id = anchor_id THEN 'anchor' ELSE 'collapsed_variant' END AS action FROM k UNION ALL SELECT id, cluster_id, NULL, 'rejected' FROM t WHERE decision = 'reject'""")
def candidate_collapse(spark, sf):
    p = turn_pairs(spark, sf).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "q", "a", F.length("a").alias("strength"), tri()["decision"].alias("decision"))
    return CU.collapse_candidates(p, "id", "q", "a", "decision", "strength", RULES).select("id", "cluster_id", "anchor_id", "action")


@query("canonical_merge", f"""WITH d AS (SELECT doc_id, source, n_chars, {CFP} AS fp FROM documents), a AS (SELECT *, first_value(doc_id) OVER (PARTITION BY source, fp ORDER BY n_chars DESC, doc_id) AS anchor FROM d)
SELECT doc_id, CASE WHEN doc_id = anchor THEN 'keep' ELSE 'drop' END AS decision, CASE WHEN doc_id <> anchor THEN 'duplicate_of:' || anchor END AS drop_reason FROM a""")
def canonical_merge(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars", T.cluster_fingerprint(F.col("text")).alias("fp"))
    return CU.canonical_merge(d, "doc_id", "source", "fp", "n_chars").select("doc_id", "decision", "drop_reason")


@query("canonical_dedupe", """WITH d AS (SELECT doc_id, lang, source, n_chars FROM documents WHERE source <> 'src0' AND NOT contains(text, '%%%') AND n_chars >= 300) SELECT lang, source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS r FROM d) WHERE r = 1""")
def canonical_dedupe(spark, sf):
    d = table(spark, sf, "documents").withColumn("target", F.when(F.col("source") != "src0", F.col("source")))
    return CU.canonical_dedupe(d, ["lang", "source"], "target", F.col("text").contains("%%%"), F.col("n_chars") < 300, "n_chars", "doc_id").select("lang", "source", "doc_id")


@query("seed_classes", """SELECT doc_id, CASE WHEN regexp_matches(lower(source || ' ' || text), 'licensed') THEN 'legal' WHEN regexp_matches(lower(source || ' ' || text), 'token') THEN 'secret' WHEN regexp_matches(lower(source || ' ' || text), '[|]') THEN 'table' ELSE 'other' END AS class,
 CASE WHEN regexp_matches(lower(source || ' ' || text), 'licensed') THEN 3 WHEN regexp_matches(lower(source || ' ' || text), 'token') THEN 1 WHEN regexp_matches(lower(source || ' ' || text), '[|]') THEN 2 ELSE 99 END AS priority FROM documents""")
def seed_classes(spark, sf):
    c = CU.curation_class(F.col("source"), F.col("text"), [("licensed", "legal", 3), ("token", "secret", 1), ("[|]", "table", 2)])
    return table(spark, sf, "documents").select("doc_id", c["class"].alias("class"), c["priority"].cast("long").alias("priority"))


LANE = """n AS (SELECT doc_id, text, n_chars, 2 * CAST(contains(text, '%%%') AS INT) + 2 * CAST(contains(text, 'token') AS INT) AS noise, CAST(contains(text, 'tion') AS INT) + CAST(contains(text, 'the ') AS INT) + CAST(regexp_matches(text, '[0-9]') AS INT) AS facts FROM documents),
l AS (SELECT *, CASE WHEN noise >= 4 THEN 'reject' WHEN facts >= 3 AND n_chars < 5000 THEN 'A' WHEN facts >= 2 THEN 'B' WHEN facts >= 1 THEN 'C' ELSE 'reject' END AS lane FROM n)"""


@query("manual_lanes", f"""WITH {LANE}, c AS (SELECT *, round(greatest(0.0::DOUBLE, 1.0 - len(regexp_extract_all(text, '[^a-zA-Z0-9_\\s.,;:!?''-]')) / greatest(length(text), 1) * 5.0 - len(regexp_extract_all(text, '\\|')) / greatest(length(text), 1) * 10.0), 9) AS clean FROM l)
SELECT doc_id, lane, CASE WHEN lane = 'reject' THEN 'drop' WHEN lane = 'A' AND clean >= 0.8 THEN 'confirm' WHEN lane IN ('A', 'B') AND facts >= 2 THEN 'revise' WHEN clean < 0.4 THEN 'drop' ELSE 'revise' END AS decision FROM c""")
def manual_lanes(spark, sf):
    t = F.col("text")
    d = table(spark, sf, "documents").select("doc_id", "n_chars", (2 * t.contains("%%%").cast("int") + 2 * t.contains("token").cast("int")).alias("noise"),
                                             (t.contains("tion").cast("int") + t.contains("the ").cast("int") + t.rlike("[0-9]").cast("int")).alias("facts"),
                                             F.round(S.cleanliness(t), 9).alias("clean"))
    d = d.withColumn("lane", CU.lane(F.col("noise"), F.col("facts"), F.col("n_chars") < 5000))
    return d.select("doc_id", "lane", CU.manual_decision(F.col("lane"), F.col("clean"), F.col("facts"))["decision"].alias("decision"))


GOLD = f"""g AS (SELECT conv_id, turn, CASE WHEN regexp_matches(lower(a), '%%%') THEN 'reject' WHEN contains(a, 'token') THEN 'reject' WHEN NOT ends_with(trim(q, {WS}), '.') OR length(q) < 20 OR length(a) > 600 THEN 'hold' ELSE 'approve' END AS decision FROM pairs)"""


def gold_rows(spark, sf):
    p = turn_pairs(spark, sf)
    return p.withColumn("g", CU.gold_decision(F.regexp_replace(T.strip(F.col("q")), r"\.$", "?"), F.col("a"), F.lit(True), "%%%", F.col("a").contains("token")))


@query("gold_decisions", f"WITH {PAIRS}, {GOLD} SELECT conv_id, turn, decision FROM g")
def gold_decisions(spark, sf):
    return gold_rows(spark, sf).select("conv_id", "turn", "g.decision")


@query("gold_freeze", f"""WITH {PAIRS}, {GOLD} SELECT conv_id * 1000 + turn AS source_row, 'GOLD-' || CASE WHEN conv_id % 2 = 0 THEN 'EN' ELSE 'FR' END || '-' || {sql_pad('row_number() OVER (PARTITION BY conv_id % 2 ORDER BY conv_id * 1000 + turn)', 4)} AS gold_id FROM g WHERE decision = 'approve'""")
def gold_freeze(spark, sf):
    g = gold_rows(spark, sf).withColumn("decision", F.col("g.decision")).withColumn("company", F.when(F.col("conv_id") % 2 == 0, "en").otherwise("fr")).withColumn(
        "row", F.col("conv_id") * 1000 + F.col("turn"))
    return CU.freeze(g, "decision", "company", "row", "q", "a", "a").select("source_row", "gold_id")


@query("qc_split", rf"""WITH {PAIRS}, t AS (SELECT conv_id, turn, q, substr(a, 1, 40) AS ans, a AS ctx, list_distinct({sql_tokens('substr(a, 1, 40)')}) AS tq, list_distinct({TA}) AS ta FROM pairs)
SELECT conv_id, turn, CASE WHEN length(trim(q, {WS})) < 12 THEN 'question_too_short' WHEN length(trim(ans, {WS})) < 8 THEN 'answer_too_short' WHEN len(list_intersect(tq, ta)) / len(tq) < 0.15 THEN 'low_overlap' WHEN NOT contains(lower(ctx), lower(trim(ans, {WS}))) THEN 'answer_not_in_context' END AS reason FROM t""")
def qc_split(spark, sf):
    p = turn_pairs(spark, sf)
    return p.select("conv_id", "turn", CU.qc_status(F.col("q"), F.substring("a", 1, 40), F.col("a"))["reason"].alias("reason"))


@query("silver_rubric", rf"""WITH {PAIRS}, t AS (SELECT conv_id, turn, q, substr(a, 11, 60) AS ans, substr(a, 1, 120) AS span, a FROM pairs), g AS (SELECT *, {_grams('q')} AS gq, {_grams('ans')} AS gn, {_grams('a')} AS gu FROM t),
s AS (SELECT conv_id, turn, CASE WHEN contains(a, span) AND contains(span, ans) THEN 2 WHEN contains(a, ans) THEN 1 ELSE 0 END AS faith, CASE WHEN len(gq) = 0 OR len(gn) = 0 THEN 0 ELSE len(list_intersect(gq, gn)) / len(gq) END AS rel, CASE WHEN len(gn) = 0 OR len(gu) = 0 THEN 0 ELSE len(list_intersect(gn, gu)) / len(gn) END AS gr FROM g)
SELECT conv_id, turn, faith AS faithfulness, CASE WHEN rel >= 0.3 THEN 2 WHEN rel >= 0.15 THEN 1 ELSE 0 END AS relevancy, CASE WHEN gr >= 0.9 THEN 2 WHEN gr >= 0.6 THEN 1 ELSE 0 END AS groundedness,
 CASE WHEN conv_id % 9 = 0 THEN 'reject_duplicate' WHEN faith = 0 THEN 'reject' WHEN faith = 2 AND gr >= 0.9 AND rel >= 0.15 THEN 'promote' ELSE 'revise' END AS decision FROM s""")
def silver_rubric(spark, sf):
    p = turn_pairs(spark, sf)
    r = CU.silver_rubric(F.col("q"), F.substring("a", 11, 60), F.substring("a", 1, 120), F.col("a"), F.col("conv_id") % 9 == 0)
    return p.select("conv_id", "turn", r.alias("r")).select("conv_id", "turn", "r.*")


@query("span_checks", rf"""WITH {PAIRS}, t AS (SELECT conv_id, turn, q, a, CASE WHEN conv_id % 8 = 0 THEN '' WHEN conv_id % 8 = 1 THEN 'zz' || substr(a, 1, 50) ELSE substr(a, 1, 100) END AS span FROM pairs)
SELECT conv_id, turn, CASE WHEN span = '' THEN 'empty_span' WHEN conv_id % 8 = 1 THEN 'span_not_in_text' WHEN regexp_matches(lower(q), '^que ') THEN 'weak_question' END AS reason FROM t""")
def span_checks(spark, sf):
    k = F.col("conv_id") % 8
    span = F.when(k == 0, "").when(k == 1, F.concat(F.lit("zz"), F.substring("a", 1, 50))).otherwise(F.substring("a", 1, 100))
    return turn_pairs(spark, sf).select("conv_id", "turn", CU.span_check(span, F.substring("a", 1, 40), F.col("a"), F.col("q"), "^que ").alias("reason"))


@query("review_promotion", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'revised ' || o_orderpriority ELSE o_orderpriority END AS final_text FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice / 500000 >= 0.5""")
def review_promotion(spark, sf):
    o = table(spark, sf, "orders").withColumn("revised", F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" revised "), "o_orderpriority")).otherwise(" ")).withColumn("conf", F.col("o_totalprice") / 500000)
    return CU.promote_reviewed(o, "o_orderstatus", ["F", "P"], "revised", "o_orderpriority", "conf", 0.5).select("o_orderkey", "final_text")


@query("fact_quality", """WITH c AS (SELECT doc_id, unnest([CASE WHEN source = 'src0' THEN 'no_fact_target' END, CASE WHEN contains(lower(source), 'src1') THEN 'banned_template' END, CASE WHEN NOT regexp_matches(text, '[0-9]') THEN 'no_number' END, CASE WHEN length(text) < 60 THEN 'thin_answer' END,
 CASE WHEN round(greatest(0.0::DOUBLE, 1.0 - len(regexp_extract_all(text, '[^a-zA-Z0-9_\\s.,;:!?''-]')) / greatest(length(text), 1) * 5.0 - len(regexp_extract_all(text, '\\|')) / greatest(length(text), 1) * 10.0), 9) < 0.5 THEN 'unclean_answer' END]) AS code FROM documents)
SELECT code, count(*) AS n, count(DISTINCT doc_id) AS rows_ FROM c WHERE code IS NOT NULL GROUP BY code""")
def fact_quality(spark, sf):
    d = table(spark, sf, "documents")
    c = CU.fact_codes(F.col("source"), F.col("text"), F.when(F.col("source") != "src0", F.col("source")), ["src1"])
    return d.select("doc_id", F.explode(c).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("rows_"))


@query("reuse_analysis", """SELECT c_mktsegment AS family, count(*) AS n, round(avg(CAST(c_nationkey % 3 = 0 AS INT)), 4) AS reusable_share, round(avg(CAST(c_nationkey % 3 = 1 AS INT)), 4) AS tuned_share, round(avg(CAST(c_nationkey % 3 = 2 AS INT)), 4) AS fallback_share, round(avg(CAST(c_acctbal > 3000 AS INT)), 4) AS accuracy FROM customer GROUP BY ALL""")
def reuse_analysis(spark, sf):
    k = F.col("c_nationkey") % 3
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("family"), F.when(k == 0, "reusable").when(k == 1, "tuned").otherwise("fallback").alias("tier"), "c_acctbal")
    return CU.reuse_tiers(c, ["family"], "tier", F.col("c_acctbal") > 3000)


@query("synthetic_cases", """WITH k AS (SELECT DISTINCT source AS family FROM documents) SELECT family || '-' || kind || '-' || y AS case_id, CASE WHEN kind = 'plain' THEN 'answerable' WHEN kind = 'other_year' THEN 'no_information' ELSE 'out_of_scope' END AS expected
FROM (SELECT family, unnest(['plain', 'other_year', 'off_topic']) AS kind FROM k), (SELECT unnest(range(2021, 2026)) AS y)""")
def synthetic_cases(spark, sf):
    """Families found in the data x kinds x years, by explode."""
    k = table(spark, sf, "documents").select(F.col("source").alias("family")).distinct()
    c = k.select("family", F.explode(F.array(*[F.lit(x) for x in ("plain", "other_year", "off_topic")])).alias("kind")).select(
        "family", "kind", F.explode(F.sequence(F.lit(2021), F.lit(2025))).alias("y"))
    return c.select(F.concat_ws("-", "family", "kind", F.col("y").cast("string")).alias("case_id"), F.when(F.col("kind") == "plain", "answerable").when(
        F.col("kind") == "other_year", "no_information").otherwise("out_of_scope").alias("expected"))


@query("probe_cases", """SELECT item_id AS case_id, 'natural' AS case_origin, split_part(text, ' ', 1) AS item FROM benchmark WHERE length(text) >= 150 AND split_part(text, ' ', 1) <> ''""")
def probe_cases(spark, sf):
    """Probes with all required fields become cases; the others go."""
    from dossier.functions.rules import issue_array
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("case_id"), F.split_part("text", F.lit(" "), F.lit(1)).alias("item"), "text")
    bad = issue_array([(F.length("text") < 150, "question_short"), (F.col("item") == "", "item_missing")])
    return b.filter(F.size(bad) == 0).select("case_id", F.lit("natural").alias("case_origin"), "item")


@query("hold_refinement", rf"""WITH {PAIRS}, {GOLD}, h AS (SELECT p.conv_id, p.turn, trim(regexp_replace(regexp_replace(a, '%+|\*+', ' ', 'g'), '\s+', ' ', 'g'), {WS}) AS t FROM pairs p JOIN g USING (conv_id, turn) WHERE decision = 'hold'),
s AS (SELECT *, list_filter(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(x) >= 24 AND NOT contains(lower(x), '$$$')) AS gs FROM h)
SELECT conv_id, turn, md5(CASE WHEN length(t) <= 400 THEN t ELSE coalesce(gs[1], t) END) AS refined_md5 FROM s""")
def hold_refinement(spark, sf):
    """Held rows get a cleaned disclosure."""
    h = gold_rows(spark, sf).filter("g.decision = 'hold'")
    return h.select("conv_id", "turn", F.md5(S.clean_disclosure(F.col("a"), [r"%+|\*+"], ["$$$"])).alias("refined_md5"))


@query("revision_check", rf"""WITH {PAIRS}, t AS (SELECT conv_id, turn, a, CASE WHEN conv_id % 3 = 0 THEN substr(a, 5, 50) ELSE 'other words ' || substr(q, 1, 20) END AS rev FROM pairs), g AS (SELECT *, {_grams('rev')} AS gr, {_grams('a')} AS ga FROM t)
SELECT conv_id, turn, contains(a, rev) AS verbatim, len(list_intersect(gr, ga)) / len(gr) >= 0.8 AS promote FROM g""")
def revision_check(spark, sf):
    """Revised wording tested against the unit text before it may be promoted."""
    rev = F.when(F.col("conv_id") % 3 == 0, F.substring("a", 5, 50)).otherwise(F.concat(F.lit("other words "), F.substring("q", 1, 20)))
    return turn_pairs(spark, sf).select("conv_id", "turn", F.col("a").contains(rev).alias("verbatim"),
                                        (T.containment(T.char_ngrams(rev), T.char_ngrams(F.col("a"))) >= 0.8).alias("promote"))
