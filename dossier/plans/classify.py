"""Filters, rule ladders and reviews."""
from __future__ import annotations

from pyspark.sql import functions as F

from dossier.functions import rules as R, signals as S
from dossier.operators import classify as CL
from dossier.plans.base import query, table
from dossier.plans.ranking import GATE_SQL, hits, items, with_text


@query("lane_filter", "SELECT page_id FROM pages WHERE starts_with(url, 'https://')")
def lane_filter(spark, sf):
    return table(spark, sf, "pages").filter(F.col("url").startswith("https://")).select("page_id")


@query("scope_policy", """SELECT doc_id, list_filter([CASE WHEN contains(text, 'the ') THEN 'any_rule' END, CASE WHEN source IN ('src1', 'src2') THEN 'id' END], lambda x: x IS NOT NULL)[1] AS why FROM documents
WHERE NOT contains(text, '%%%') AND lang IN ('en', 'fr') AND (source IN ('src1', 'src2') OR contains(text, 'the '))""")
def scope_policy(spark, sf):
    """Excluded tokens, included types, included ids or any-of rules."""
    t = F.col("text")
    inc = F.col("source").isin("src1", "src2")
    return table(spark, sf, "documents").filter(~R.contains_any(t, ["%%%"]) & F.col("lang").isin("en", "fr") & (inc | R.contains_any(t, ["the "]))).select(
        "doc_id", F.get(R.issue_array([(t.contains("the "), "any_rule"), (inc, "id")]), F.lit(0)).alias("why"))


@query("family_pool", """WITH p AS (SELECT doc_id, source, 'pool_the' AS tag FROM documents WHERE contains(text, 'the ')) SELECT doc_id, tag FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM p) WHERE r <= 12""")
def family_pool(spark, sf):
    from dossier.operators.bounds import top_k
    p = table(spark, sf, "documents").filter(F.col("text").contains("the ")).select("doc_id", "source", F.array_join(F.array_union(
        F.array().cast("array<string>"), F.array(F.lit("pool_the"))), ",").alias("tag"))
    return top_k(p, ["source"], [F.col("doc_id")], 12, "r").select("doc_id", "tag")


@query("public_scope", "SELECT page_id, contains(url, 'example.org') OR contains(url, 'example.net') AS allowed FROM pages")
def public_scope(spark, sf):
    return table(spark, sf, "pages").select("page_id", R.contains_any(F.col("url"), ["example.org", "example.net"]).alias("allowed"))


@query("passage_filter", r"""WITH t AS (SELECT doc_id, text, lower(text) AS l FROM documents)
SELECT doc_id, CASE WHEN length(text) < 80 THEN 'too_short' WHEN CAST(contains(l, 'home') AS INT) + CAST(contains(l, 'menu') AS INT) + CAST(contains(l, 'login') AS INT) >= 3 THEN 'navigation'
 WHEN length(text) > 0 AND len(regexp_extract_all(text, '[|•]')) * 60 > length(text) THEN 'listing' WHEN regexp_matches(l, '[0-9]{13,}') AND NOT regexp_matches(l, 'tion') THEN 'finance_only'
 WHEN contains(l, '@') AND NOT regexp_matches(l, 'tion') THEN 'contact_only' WHEN NOT regexp_matches(l, 'tion') THEN 'no_substance' END AS reason FROM t""")
def passage_filter(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.passage_reason(F.col("text"), ["home", "menu", "login"], "[0-9]{13,}", "@", "tion").alias("reason"))


NOISE = [("%%%", 2.0), (r"\|", 1.5), ("token =", 3.0), (r"[0-9]{10,}", 2.0), ("licensed", 1.0)]
SUBST = [("tion", 1.5), ("the ", 1.0), ("que ", 1.0), (r"[A-Z][a-z]+ing", 0.5)]


def _wsum(rules, col="text"):
    return "(" + " + ".join(f"CASE WHEN regexp_matches({col}, '{p}') THEN {w}::DOUBLE ELSE 0 END" for p, w in rules) + ")"


@query("prefilter_score", f"""WITH s AS (SELECT d.doc_id, length(text) AS n, {_wsum(NOISE)} AS noise, {_wsum(SUBST)} AS sub, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)),
r AS (SELECT *, CASE WHEN noise + sub = 0 THEN 0 ELSE sub / (noise + sub) END AS ratio FROM s)
SELECT doc_id, noise, sub AS substance, round(ratio, 6) AS ratio, CASE WHEN n < 80 OR (noise >= 6 AND sub < 2) OR sub = 0 THEN 'drop' WHEN ratio >= 0.6 AND sub >= 2 THEN 'keep' ELSE 'conditional' END AS decision,
 CASE WHEN n < 80 THEN 'R1_short' WHEN noise >= 6 AND sub < 2 THEN 'R2_noise' WHEN sub = 0 THEN 'R3_no_substance' WHEN ratio >= 0.6 AND sub >= 2 THEN 'R4_substance' WHEN ratio >= 0.6 THEN 'R5_thin' WHEN noise >= 6 THEN 'R6_noisy' ELSE 'R7_mixed' END AS rule, quality FROM r""")
def prefilter_score(spark, sf):
    n, s, ratio = S.noise_substance(F.col("text"), NOISE, SUBST)
    d = table(spark, sf, "documents").select("doc_id", F.length("text").alias("n"), n.alias("noise"), s.alias("substance"), ratio.alias("ratio"))
    d = d.withColumn("p", S.prefilter_decision(F.col("noise"), F.col("substance"), F.col("ratio"), F.col("n")))
    return d.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left").select(
        "doc_id", "noise", "substance", F.round("ratio", 6).alias("ratio"), "p.decision", "p.rule", "quality")


@query("noise_flags", r"""SELECT doc_id, len(regexp_extract_all(text, '\.{4,}|(?:\s\d{1,3}\s*\n)')) >= 5 AS toc, length(text) > 0 AND len(regexp_extract_all(text, '[|•]')) * 60 > length(text) AS listing,
 trim(regexp_replace(text, '[\d\s./:-]+', '', 'g')) = '' AS date_only, length(trim(text, ' ' || chr(10))) > 0 AND NOT regexp_matches(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '[.!?"'')\]]$') AS truncated FROM documents""")
def noise_flags(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", S.toc_heavy(t).alias("toc"), S.listing_heavy(t).alias("listing"), S.date_only(t).alias("date_only"), S.truncated(t).alias("truncated"))


@query("curated_drop", """SELECT d.doc_id, l.doc_id IS NOT NULL AS dropped FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l USING (doc_id)""")
def curated_drop(spark, sf):
    drop = table(spark, sf, "labels").filter("toxic = 1").select("doc_id").distinct().withColumn("x", F.lit(True))
    return table(spark, sf, "documents").select("doc_id").join(drop, "doc_id", "left").select("doc_id", F.coalesce("x", F.lit(False)).alias("dropped"))


@query("not_disclosed", """SELECT o_orderkey, o_orderstatus = 'O' AS not_disclosed FROM orders""")
def not_disclosed(spark, sf):
    from dossier.functions.numbers import NOT_DISCLOSED_RE
    return table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "value: NOT Disclosed yet").otherwise(
        F.col("o_orderpriority")).rlike(NOT_DISCLOSED_RE).alias("not_disclosed"))


@query("plausible_candidates", """WITH c AS (SELECT l_partkey, l_orderkey * 10 + l_linenumber AS o, l_quantity >= 45 AS ok FROM lineitem), f AS (SELECT *, bool_or(ok) OVER (PARTITION BY l_partkey) AS anyok FROM c)
SELECT l_partkey, count(*) AS n, min(o) AS first_o FROM f WHERE ok OR NOT anyok GROUP BY l_partkey""")
def plausible_candidates(spark, sf):
    from dossier.operators.extraction import plausible
    c = table(spark, sf, "lineitem").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), "l_quantity")
    return plausible(c, "l_partkey", F.col("l_quantity") >= 45).groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("first_o"))


@query("insufficient_questions", r"""SELECT item_id, regexp_matches(lower(text), 'that .*from|esg-i0') AS insufficient FROM benchmark""")
def insufficient_questions(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", R.matches_any(F.lower("text"), ["that .*from", "esg-i0"]).alias("insufficient"))


@query("candidate_filter", """SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'empty' WHEN NOT contains(lower(text), 'the') AND NOT contains(lower(text), 'de') THEN 'company_missing' WHEN length(text) < 60 THEN 'excerpt_short' WHEN contains(text, '%%%') THEN 'chrome' END AS reason FROM conversations""")
def candidate_filter(spark, sf):
    t = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", R.first_reason([
        (F.trim(t) == "", "empty"), (~R.contains_any(F.lower(t), ["the", "de"]), "company_missing"), (F.length(t) < 60, "excerpt_short"), (t.contains("%%%"), "chrome")]).alias("reason"))


@query("fill_status", """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'high' WHEN c_acctbal < 2000 THEN 'medium' ELSE 'low' END AS priority, CASE WHEN c_acctbal < 0 THEN 'find_source' WHEN c_acctbal < 2000 THEN 'review' ELSE 'none' END AS action FROM customer WHERE c_mktsegment <> 'MACHINERY'""")
def fill_status(spark, sf):
    b = F.col("c_acctbal")
    return table(spark, sf, "customer").filter("c_mktsegment <> 'MACHINERY'").select(
        "c_custkey", R.ladder([(b < 0, "high"), (b < 2000, "medium")], "low").alias("priority"), R.ladder([(b < 0, "find_source"), (b < 2000, "review")], "none").alias("action"))


# ---- ladders ---------------------------------------------------------------------
@query("question_profiles", r"""SELECT item_id, CASE WHEN regexp_matches(lower(text), 'threeth') THEN 'three' WHEN regexp_matches(lower(text), 'that ') THEN 'that' WHEN regexp_matches(lower(text), 'the ') THEN 'the' ELSE 'generic' END AS family,
 array_to_string(list_filter([CASE WHEN regexp_matches(lower(text), 'threeth') THEN 'three' END, CASE WHEN regexp_matches(lower(text), 'that ') THEN 'that' END, CASE WHEN regexp_matches(lower(text), 'the ') THEN 'the' END], lambda x: x IS NOT NULL), ',') AS all_families FROM benchmark""")
def question_profiles(spark, sf):
    rules = [("threeth", "three"), ("that ", "that"), ("the ", "the")]
    low = F.lower("text")
    return table(spark, sf, "benchmark").select("item_id", R.first_match(low, rules, "generic").alias("family"), F.array_join(R.all_matches(low, rules), ",").alias("all_families"))


@query("cluster_inference", r"""SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'licensed') THEN 'legal' WHEN regexp_matches(lower(text), 'token') THEN 'secret' ELSE 'h_' || md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13))) END AS cluster FROM documents""")
def cluster_inference(spark, sf):
    from dossier.operators.curation import cluster_of
    return table(spark, sf, "documents").select("doc_id", cluster_of(F.col("text"), [("licensed", "legal"), ("token", "secret")]).alias("cluster"))


@query("evidence_types", """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'metric' WHEN contains(source, 'src1') THEN 'policy' WHEN contains(source, 'src2') THEN 'risk' ELSE 'text' END AS etype,
 CASE WHEN n_chars >= 3000 THEN 'high' WHEN n_chars >= 1000 THEN 'medium' ELSE 'low' END AS confidence,
 CASE WHEN 1 + CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 0 END + CASE WHEN lang = 'en' THEN 1 ELSE 0 END + CASE WHEN n_chars >= 6000 THEN 2 WHEN n_chars >= 3000 THEN 1 ELSE 0 END >= 4 THEN 'high'
  WHEN 1 + CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 0 END + CASE WHEN lang = 'en' THEN 1 ELSE 0 END + CASE WHEN n_chars >= 6000 THEN 2 WHEN n_chars >= 3000 THEN 1 ELSE 0 END >= 2 THEN 'medium' ELSE 'low' END AS points FROM documents""")
def evidence_types(spark, sf):
    d = table(spark, sf, "documents")
    m = F.when(F.col("doc_id") % 5 == 0, F.lit("m"))
    sec = F.when(F.col("source").contains("src1"), "policy").when(F.col("source").contains("src2"), "risk").otherwise("x")
    sc = F.col("n_chars") / 10000
    return d.select("doc_id", S.evidence_type(m, F.lit(""), sec).alias("etype"), S.confidence_level(F.col("n_chars"), 3000, 1000).alias("confidence"),
                    S.confidence_points(F.lit(True), m.isNotNull(), sc, F.col("lang") == "en").alias("points"))


@query("generation_guard", GATE_SQL + """, n AS (SELECT query_id, count(*) AS items, count_if(anchor AND NOT domain_bad) AS ok FROM f GROUP BY ALL)
SELECT n.query_id, CASE WHEN NOT answerable THEN 'abstain_recommended' WHEN items = 0 THEN 'no_items' WHEN ok = 0 THEN 'no_answerable_item' END AS reason FROM n JOIN q USING (query_id)""")
def generation_guard(spark, sf):
    q = items(spark, sf).select("query_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{6,})"), F.lit(1))).alias("terms"))
    h = with_text(spark, sf, hits(spark, sf, 8)).join(q, "query_id")
    h = h.withColumn("anchor", S.anchor_passes(F.col("text"), F.lit("count"), F.col("terms"), count_re=r"\d{3,}")).withColumn("domain_bad", F.col("source").contains("7"))
    h = h.withColumn("ok", F.col("anchor") & ~F.col("domain_bad"))
    g = h.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("k"), F.bool_or(F.when(F.col("rank") <= 3, F.col("ok"))).alias("a"))
    return g.select("query_id", CL.guard(~F.coalesce("a", F.lit(False)), F.col("n"), F.col("k")).alias("reason"))


@query("entity_checks", """SELECT doc_id, NOT contains(text, 'the ') AND contains(lower(text), 'tion') AND regexp_matches(text, '[0-9]{3,}') AS entity_mismatch FROM documents""")
def entity_checks(spark, sf):
    from dossier.functions.text import strip_header_lines
    t = F.concat(F.lit("company: the one\n"), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", S.entity_mismatch(
        F.col("text"), strip_header_lines(t), F.lit("the "), F.array(F.lit("tion")), F.col("text").rlike("[0-9]{3,}")).alias("entity_mismatch"))


@query("source_classes", """SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'file' WHEN contains(split_part(split_part(url, '/', 3), ':', 1), 'example.org') AND page_id % 2 = 0 AND split_part(url, '/', 3) = 'thther.example.org' THEN 'web_filing' WHEN page_id % 5 = 0 THEN 'missing' ELSE 'web_public' END AS kind FROM pages""")
def source_classes(spark, sf):
    k = F.col("page_id")
    url = F.when((k % 6 != 0) & (k % 5 == 0) & ~((F.try_parse_url(F.col("url"), F.lit("HOST")) == "thther.example.org") & (k % 2 == 0)), "").otherwise(F.col("url"))
    hosts = F.when(k % 2 == 0, F.lit("thther.example.org")).otherwise("-")
    c = CL.source_class(url, F.when(k % 6 == 0, "f.pdf"), ["thther.example.org"])
    return table(spark, sf, "pages").select("page_id", F.when((c["kind"] == "web_filing") & (hosts == "-"), "web_public").otherwise(c["kind"]).alias("kind"))


@query("source_actions", """WITH k AS (SELECT CASE WHEN n_chars % 4 = 0 THEN 'use_local' WHEN n_chars % 4 = 1 THEN 'download' ELSE 'ask_owner' END AS action, lang FROM documents)
SELECT action, lang, count(*) AS n FROM k GROUP BY GROUPING SETS ((action), (lang), (action, lang))""")
def source_actions(spark, sf):
    m = F.col("n_chars") % 4
    c = CL.source_class(F.when(m == 1, "http://x.example.com/a").otherwise(""), F.when(m == 0, "f"), [])
    d = table(spark, sf, "documents").select(c["action"].alias("action"), "lang")
    a, b = F.col("action"), F.col("lang")
    return d.groupingSets([[a], [b], [a, b]], a, b).agg(F.count(F.lit(1)).alias("n"))


@query("fail_types", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'correct_with_wrong_top1' WHEN o_orderkey % 3 = 0 THEN 'ambiguous' ELSE 'fail' END AS fail_type,
 array_to_string(list_filter([CASE WHEN o_orderkey % 2 = 1 THEN 'wrong_top1' END, CASE WHEN o_totalprice > 400000 THEN 'large' END], lambda x: x IS NOT NULL), ',') AS tags FROM orders""")
def fail_types(spark, sf):
    k, ok = F.col("o_orderkey"), F.col("o_orderstatus") == "F"
    return table(spark, sf, "orders").select("o_orderkey", R.ladder([(ok & (k % 2 == 0), F.lit(None).cast("string")), (ok, "correct_with_wrong_top1"), (k % 3 == 0, "ambiguous")], "fail").alias("fail_type"),
                                             F.array_join(R.issue_array([(k % 2 == 1, "wrong_top1"), (F.col("o_totalprice") > 400000, "large")]), ",").alias("tags"))


@query("conflict_classes", """SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'not_disclosed' WHEN o_orderkey % 4 = 1 THEN 'conflict_numeric' WHEN o_orderkey % 6 >= 2 AND o_orderstatus <> 'O' THEN 'multi_source_confirmed' WHEN o_orderstatus = 'O' THEN 'metric_absent' ELSE 'single_source_sufficient' END AS conflict_status FROM orders""")
def conflict_classes(spark, sf):
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    z = F.lit(0)
    val = F.when(k % 13 == 0, "not disclosed").when(s != "O", F.col("o_totalprice").cast("string")).otherwise("")
    return table(spark, sf, "orders").select("o_orderkey", CL.conflict_status(
        val, (k % 4 == 1).cast("int"), F.when(s == "O", "partial_metric_absent_in_role").otherwise("resolved"), k % 6, z, z, z, F.lit("single_document_answer"), F.lit(False)).alias("conflict_status"))


@query("extraction_confidence", """SELECT l_orderkey, l_linenumber, l_partkey, least(1.0, CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' AND l_partkey % 2 = 0 THEN greatest(l_discount * 10, 0.5, 0.78) WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN greatest(l_discount * 10, 0.5, 0.72) WHEN l_returnflag = 'A' THEN greatest(l_discount * 10, 0.5) ELSE l_discount * 10 END) AS confidence, count(*) AS n FROM lineitem GROUP BY ALL""")
def extraction_confidence(spark, sf):
    c = CL.extraction_confidence(F.col("l_discount") * 10, F.col("l_returnflag") == "A", F.lit(0.5), F.col("l_linestatus") == "O", F.col("l_partkey") % 2 == 0)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", c["confidence"].alias("confidence")).groupBy(
        "l_orderkey", "l_linenumber", "l_partkey", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query("field_status", """SELECT l_returnflag, CASE WHEN l_quantity > 45 THEN 'insufficient' WHEN l_discount > 0.08 THEN 'conflict' WHEN l_tax * 10 >= 0.55 THEN 'verified' ELSE 'extracted' END AS status,
 CASE WHEN l_quantity > 45 OR l_discount > 0.08 THEN 'low' WHEN l_tax * 10 >= 0.55 THEN 'high' WHEN l_tax * 10 >= 0.35 THEN 'medium' ELSE 'low' END AS confidence, count(*) AS n FROM lineitem GROUP BY ALL""")
def field_status(spark, sf):
    s = CL.field_status(F.when(F.col("l_quantity") <= 45, F.col("l_quantity")), F.col("l_tax") * 10, F.col("l_discount") > 0.08)
    return table(spark, sf, "lineitem").select("l_returnflag", s.alias("s")).groupBy("l_returnflag", "s.status", "s.confidence").agg(F.count(F.lit(1)).alias("n"))


@query("readiness_chain", """WITH x AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN 'coverage_gap' ELSE 'ready' END AS stage, CASE WHEN o_orderkey % 4 = 0 THEN 'qualitative' ELSE 'quantitative' END AS kind, o_orderstatus = 'O' AS nd, o_orderkey % 5 = 0 AS single, o_orderkey % 5 = 1 AS agg, o_orderstatus = 'F' AS ex FROM orders),
r AS (SELECT k, kind, ex, CASE WHEN stage = 'coverage_gap' THEN 'coverage_gap' WHEN kind = 'qualitative' THEN 'not_ready_for_synthesis' WHEN nd THEN 'honest_abstain' WHEN single THEN 'single_source_sufficient' WHEN agg THEN 'multi_source_sufficient' WHEN ex THEN 'extraction_ready' ELSE 'needs_sme_review' END AS readiness FROM x),
p AS (SELECT *, readiness IN ('single_source_sufficient', 'multi_source_sufficient', 'aggregation_ready', 'extraction_ready') AND k % 10 >= 3 AND kind <> 'qualitative' AS promoted FROM r)
SELECT k, readiness, promoted, CASE WHEN promoted AND k % 10 >= 6 THEN 'none' WHEN promoted THEN 'RAG' WHEN k % 10 = 0 THEN 'SME' WHEN readiness = 'coverage_gap' THEN 'data' WHEN kind = 'qualitative' THEN 'SME' ELSE 'RAG' END AS owner FROM p""")
def readiness_chain(spark, sf):
    """Stage -> readiness -> promotion -> review owner."""
    k, s = F.col("k"), F.col("o_orderstatus")
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    d = d.withColumn("kind", F.when(k % 4 == 0, "qualitative").otherwise("quantitative"))
    stage = CL.fail_stage(F.lit(True), k % 9 != 0, F.lit(True), F.lit(True), F.lit(False))
    suff = F.when(k % 5 == 0, "resolved_single_source_sufficient").when(k % 5 == 1, "resolved").otherwise("failed")
    d = d.withColumn("readiness", CL.readiness(stage, F.col("kind"), s == "O", suff, k % 5 == 1, s == "F", F.lit(False), F.lit(True), F.lit(True)))
    d = d.withColumn("conf", (k % 10) / 5.0)
    d = d.withColumn("p", CL.promotion(F.col("readiness"), F.col("conf"), F.lit("none"), F.lit(False), F.col("kind") == "qualitative"))
    return d.select("k", "readiness", "p.promoted", CL.review_owner(F.col("readiness"), F.col("p.promoted"), F.col("conf"), 1.2, k % 10 == 0, F.col("kind"))["owner"].alias("owner"))


@query("field_routes", """SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'bm25_lexical' ELSE 'semantic_dense' END AS mode, CASE WHEN p_size > 40 THEN 6 ELSE 4 END AS top_k, CASE WHEN p_size > 40 THEN 48 ELSE 24 END AS pool FROM part""")
def field_routes(spark, sf):
    r = CL.route_field(F.when(F.col("p_type").isin("ECONOMY", "SMALL"), "metric").otherwise("other"), F.col("p_size") > 40)
    return table(spark, sf, "part").select("p_partkey", r["mode"].alias("mode"), r["top_k"].cast("long").alias("top_k"), r["pool"].cast("long").alias("pool"))


@query("comparison_status", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'correct_abstain' WHEN o_orderstatus = 'O' THEN 'missed_abstain' WHEN o_totalprice > 250000 THEN 'match' ELSE 'mismatch' END AS status,
 CASE WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'P3' WHEN o_orderstatus = 'O' THEN 'P1' WHEN o_totalprice > 250000 THEN 'P3' ELSE 'P1' END AS priority FROM orders""")
def comparison_status(spark, sf):
    a, k = F.col("o_orderstatus") == "O", F.col("o_orderkey") % 2 == 0
    st = R.ladder([(a & k, "correct_abstain"), (a, "missed_abstain"), (F.col("o_totalprice") > 250000, "match")], "mismatch")
    return table(spark, sf, "orders").select("o_orderkey", st.alias("status")).withColumn(
        "priority", R.ladder([(F.col("status").isin("correct_abstain", "match"), "P3")], "P1"))


@query("answerability", """WITH c AS (SELECT item_id, text, item_id % 7 <> 0 AS known FROM benchmark), s AS (SELECT c.item_id, known, contains(text, 'the ') AS hit FROM c), r AS (SELECT *, CASE WHEN NOT known THEN 'out_of_scope' WHEN hit THEN 'answerable' ELSE 'no_information' END AS predicted, CASE WHEN item_id % 2 = 0 THEN 'answerable' ELSE 'no_information' END AS expected FROM s)
SELECT *, round(n / sum(n) OVER (PARTITION BY expected), 4) AS share FROM (SELECT expected, predicted, count(*) AS n FROM r GROUP BY ALL)""")
def answerability(spark, sf):
    from pyspark.sql import Window
    from dossier.operators.curation import answerability as ans
    b = table(spark, sf, "benchmark")
    r = b.select(ans(F.col("item_id") % 7 != 0, F.col("text").contains("the ")).alias("predicted"),
                 F.when(F.col("item_id") % 2 == 0, "answerable").otherwise("no_information").alias("expected"))
    g = r.groupBy("expected", "predicted").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("expected")), 4))


@query("layer_report", """WITH c AS (SELECT event_type, unnest(['parse', 'retrieve', 'extract']) AS layer, unnest([value > 1, value > 10, value > 50]) AS ok FROM events) SELECT layer, event_type, count(*) AS total, count_if(ok) AS passed FROM c GROUP BY ALL""")
def layer_report(spark, sf):
    v = F.col("value")
    c = table(spark, sf, "events").select("event_type", F.explode(F.array(*[F.struct(F.lit(n).alias("layer"), (v > x).alias("ok")) for n, x in (("parse", 1), ("retrieve", 10), ("extract", 50))])).alias("c"))
    return c.groupBy("c.layer", "event_type").agg(F.count(F.lit(1)).alias("total"), F.count_if("c.ok").alias("passed"))


@query("run_keys", """SELECT event_id, strftime(ts, '%Y%m%d') AS run_day, md5('{"type":"' || event_type || '","user":' || user_id || '}') AS config_md5, CASE WHEN event_type = 'error' AND value > 50 THEN 'timeout' WHEN event_type = 'error' THEN 'runtime_error' END AS error_code FROM events""")
def run_keys(spark, sf):
    e = table(spark, sf, "events")
    run_id = F.concat(F.lit("run-"), F.date_format("ts", "yyyyMMdd"), F.lit("-"), F.col("event_id").cast("string"))
    msg = F.when(F.col("event_type") == "error", F.when(F.col("value") > 50, "Timeout after").otherwise("boom"))
    return e.select("event_id", F.regexp_extract(run_id, r"run-(\d{8})", 1).alias("run_day"), F.md5(F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user")))).alias("config_md5"),
                    R.first_match(F.lower(msg), [("timeout", "timeout"), (".", "runtime_error")]).alias("error_code"))


@query("handoff_payload", """SELECT source, count(*) AS docs, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY n_chars DESC, doc_id) FILTER (r <= 3) AS evidence, max(n_chars) > 15000 AS allowed FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) GROUP BY source""")
def handoff_payload(spark, sf):
    """Counts over all documents, a bundle of the best three."""
    from dossier.operators.bounds import top_k
    d = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    best = top_k(d, ["source"], [F.col("n_chars").desc(), F.col("doc_id")], 3, "r").groupBy("source").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.col("doc_id").cast("string").alias("d")))), lambda e: e["d"]), ",").alias("evidence"))
    g = d.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), (F.max("n_chars") > 15000).alias("allowed"))
    return g.join(best, "source")
