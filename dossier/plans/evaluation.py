"""Evaluation queries: conversations as answers, events as runs, labels as gold."""
from __future__ import annotations

from pyspark.sql import functions as F

from dossier.operators import classify as CL, evaluation as E, joins as J, measures as MS
from dossier.plans.base import WS, query, sql_tokens, table
from dossier.plans.ranking import BM, EXPECT, expected, hits, items, rk
from dossier.plans.text import PAIRS, _grams, turn_pairs
from dossier.session import materialise


@query("source_match", BM + EXPECT + rk() + """, h AS (SELECT rk.query_id, rank, rk.doc_id, d.source, ex.doc_id IS NOT NULL AS is_exp FROM rk JOIN documents d USING (doc_id) LEFT JOIN ex ON ex.query_id = rk.query_id AND ex.doc_id = rk.doc_id WHERE rank <= 10),
m AS (SELECT query_id, rank, CASE WHEN is_exp THEN 'exact_record' WHEN source = 'src' || CAST(query_id % 20 AS VARCHAR) THEN 'package' WHEN contains(source, 'src1') THEN 'path_alias' END AS reason FROM h)
SELECT query_id, rank, reason FROM m WHERE reason IS NOT NULL""")
def source_match(spark, sf):
    return matched(spark, sf).filter("reason is not null").select("query_id", F.col("rank").cast("long").alias("rank"), "reason")


def matched(spark, sf):
    h = hits(spark, sf, 10).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    h = h.join(expected(spark, sf).withColumn("_e", F.lit(True)), ["query_id", "doc_id"], "left")
    rid = F.when(F.col("_e"), F.concat(F.lit("rec_"), F.col("doc_id").cast("string"))).otherwise("")
    want = F.concat(F.lit("pkg/src"), (F.col("query_id") % 20).cast("string"), F.lit("/"))
    return h.withColumn("reason", E.match_reason(
        rid, F.lit(""), F.concat(F.lit("pkg/"), "source", F.lit("/x")), F.concat(F.lit("rec_"), F.col("doc_id").cast("string")), F.lit(""),
        want, r"pkg/([^/]+)/", F.array(F.lit("src1"))))


FLAGS = """ fl AS (SELECT i.item_id AS query_id, coalesce(bool_or(reason IS NOT NULL), false) AS retrieval_hit, coalesce(bool_or(reason IS NOT NULL AND rank = 1), false) AS citation_correct,
 count(reason) > 0 AS citation_topk_any, min(CASE WHEN reason IS NOT NULL THEN rank END) AS first_rank, arg_min(reason, rank) FILTER (reason IS NOT NULL) AS match_reason FROM benchmark i LEFT JOIN m ON m.query_id = i.item_id GROUP BY ALL)"""
MATCH = BM + EXPECT + rk() + """, h AS (SELECT rk.query_id, rank, rk.doc_id, d.source, ex.doc_id IS NOT NULL AS is_exp FROM rk JOIN documents d USING (doc_id) LEFT JOIN ex ON ex.query_id = rk.query_id AND ex.doc_id = rk.doc_id WHERE rank <= 10),
m AS (SELECT query_id, rank, CASE WHEN is_exp THEN 'exact_record' WHEN source = 'src' || CAST(query_id % 20 AS VARCHAR) THEN 'package' WHEN contains(source, 'src1') THEN 'path_alias' END AS reason FROM h)"""


@query("retrieval_citation", MATCH + "," + FLAGS + "SELECT * FROM fl")
def retrieval_citation(spark, sf):
    return E.retrieval_flags(matched(spark, sf), items(spark, sf), "query_id", "reason").select(
        "query_id", "retrieval_hit", "citation_correct", "citation_topk_any", F.col("first_rank").cast("long").alias("first_rank"), "match_reason")


@query("match_reasons", MATCH + " SELECT coalesce(reason, 'none') AS reason, count(*) AS n FROM m GROUP BY ALL")
def match_reasons(spark, sf):
    return matched(spark, sf).groupBy(F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("eval_metrics", MATCH + "," + FLAGS + """ SELECT count(*) AS n, round(avg(CAST(retrieval_hit AS INT)), 4) AS retrieval_hit_rate, round(avg(CAST(citation_correct AS INT)), 4) AS citation_correctness,
 round(avg(CAST(citation_topk_any AS INT)), 4) AS citation_topk_rate FROM fl""")
def eval_metrics(spark, sf):
    f = E.retrieval_flags(matched(spark, sf), items(spark, sf), "query_id", "reason")
    return E.rates(f, {"retrieval_hit_rate": F.col("retrieval_hit"), "citation_correctness": F.col("citation_correct"),
                       "citation_topk_rate": F.col("citation_topk_any")})




@query("groundedness_turns", rf"""WITH {PAIRS}, t AS (SELECT conv_id, turn, lower(q) AS ans, lower(a) AS ev, list_distinct({sql_tokens('lower(q)')}) AS ta, list_distinct({sql_tokens('lower(a)')}) AS te, {_grams('lower(q)')} AS ga, {_grams('lower(a)')} AS ge FROM pairs),
s AS (SELECT *, CASE WHEN len(ta) = 0 OR len(te) = 0 THEN 0 ELSE len(list_intersect(ta, te)) / len(ta) END AS tok, CASE WHEN len(ga) = 0 OR len(ge) = 0 THEN 0 ELSE len(list_intersect(ga, ge)) / len(ga) END AS gr FROM t)
SELECT conv_id, turn, ev <> '' AND (CASE WHEN tok >= 0.18 THEN tok ELSE greatest(tok, gr) END >= 0.18 OR CAST(contains(ev, 'the') OR contains(ans, 'the') AS INT) + CAST(contains(ev, 'zu ') OR contains(ans, 'zu ') AS INT) + CAST(contains(ev, 'que') OR contains(ans, 'que') AS INT) >= 1) AS grounded FROM s""")
def groundedness_turns(spark, sf):
    """User turns as answers, replies as evidence, a fixed claim list."""
    no = F.lit(False)
    cl = F.array(F.lit("the"), F.lit("zu "), F.lit("que"))
    return turn_pairs(spark, sf).select("conv_id", "turn", E.groundedness(F.col("q"), F.col("a"), cl, no, no).alias("grounded"))


@query("answer_scores", rf"""WITH {PAIRS}, t AS (SELECT conv_id, turn, lower(substr(q, 1, 80)) AS e, lower(a) AS a, (conv_id % 10) = 0 AS ie, (conv_id % 7) = 0 AS fl FROM pairs),
g AS (SELECT *, {_grams('e')} AS ge, {_grams('a')} AS ga, regexp_replace(e, '\s+', '', 'g') AS be, regexp_replace(a, '\s+', '', 'g') AS ba, regexp_extract_all(e, '(\d+(?:\.\d+)?)', 1) AS nums,
  list_filter(list_transform(regexp_split_to_array(e, '[,;]'), lambda p: trim(p, {WS})), lambda p: length(p) >= 3) AS parts FROM t),
o AS (SELECT *, CASE WHEN len(ge) = 0 OR len(ga) = 0 THEN 0 ELSE len(list_intersect(ge, ga)) / len(ge) END AS gr FROM g)
SELECT conv_id, turn, CASE WHEN NOT ie AND (fl OR contains(a, 'zzz')) THEN 'unexpected_insufficient' WHEN ie THEN 'insufficient_flag_and_phrase' WHEN e IN ('yes', 'no') THEN 'boolean' WHEN len(nums) > 0 THEN 'numeric_or_percent'
  WHEN length(be) >= 4 AND ba <> '' AND (contains(ba, be) OR contains(be, ba)) THEN 'substring' WHEN gr >= 0.28 THEN 'char_pairs' WHEN len(parts) > 0 THEN 'phrases' ELSE 'tokens' END AS rule,
 CASE WHEN NOT ie AND (fl OR contains(a, 'zzz')) THEN false WHEN ie THEN fl AND contains(a, 'zzz') WHEN e IN ('yes', 'no') THEN contains(a, e) WHEN len(nums) > 0 THEN len(list_filter(nums, lambda x: contains(a, x))) > 0
  WHEN length(be) >= 4 AND ba <> '' AND (contains(ba, be) OR contains(be, ba)) THEN true WHEN gr >= 0.28 THEN true
  WHEN len(parts) > 0 THEN len(list_filter(parts, lambda p: contains(a, p))) >= greatest(1, len(parts) // 2) ELSE true END AS ok FROM o""")
def answer_scores(spark, sf):
    p = turn_pairs(spark, sf)
    s = E.answer_score(F.substring("q", 1, 80), F.col("a"), F.col("conv_id") % 10 == 0, F.col("conv_id") % 7 == 0, ["zzz"])
    return p.select("conv_id", "turn", s.alias("s")).select("conv_id", "turn", "s.rule", "s.ok")


@query("overall_labels", f"""WITH {PAIRS}, f AS (SELECT conv_id, turn, conv_id % 10 = 0 AS ie, length(a) % 2 = 0 AS h, length(a) % 3 = 0 AS c, length(q) % 2 = 0 AS g, length(q) % 3 <> 0 AS o FROM pairs)
SELECT conv_id, turn, CASE WHEN ie AND o THEN 'pass' WHEN ie THEN 'fail' WHEN h AND c AND g AND o THEN 'pass' WHEN h OR o THEN 'partial' ELSE 'fail' END AS overall FROM f""")
def overall_labels(spark, sf):
    la, lq = F.length("a"), F.length("q")
    o = lq % 3 != 0
    return turn_pairs(spark, sf).select("conv_id", "turn", E.overall_label(
        F.col("conv_id") % 10 == 0, o, la % 2 == 0, la % 3 == 0, lq % 2 == 0, o).alias("overall"))


@query("reason_codes", """WITH c AS (SELECT unnest([CASE WHEN value < 5 THEN 'low' END, CASE WHEN event_type = 'error' THEN 'error' END, CASE WHEN value > 100 THEN 'slow' END, CASE WHEN user_id % 3 = 0 THEN 'third' END]) AS code FROM events)
SELECT code, count(*) AS n FROM c WHERE code IS NOT NULL GROUP BY code ORDER BY n DESC, code LIMIT 3""")
def reason_codes(spark, sf):
    from dossier.functions.rules import issue_array
    e = table(spark, sf, "events").select(issue_array([(F.col("value") < 5, "low"), (F.col("event_type") == "error", "error"),
                                                       (F.col("value") > 100, "slow"), (F.col("user_id") % 3 == 0, "third")]).alias("codes"))
    return E.code_counts(e, "codes", 3)


@query("confusion_counts", """SELECT count_if(quality = 1 AND toxic = 0) AS pass, count_if(quality = 1 AND toxic = 1) AS partial, count_if(quality = 0) AS fail FROM labels""")
def confusion_counts(spark, sf):
    q, t = F.col("quality"), F.col("toxic")
    return E.confusion_counts(table(spark, sf, "labels"), [("pass", (q == 1) & (t == 0)), ("partial", (q == 1) & (t == 1)), ("fail", q == 0)])


@query("grouping_set_rates", """SELECT d.lang, d.source, count(*) AS n, round(avg(CAST(quality = 1 AS INT)), 4) AS quality_rate, round(avg(CAST(toxic = 1 AS INT)), 4) AS toxic_rate
FROM labels l JOIN documents d USING (doc_id) GROUP BY GROUPING SETS ((), (d.lang), (d.source), (d.lang, d.source))""")
def grouping_set_rates(spark, sf):
    """Overall, by company, by family and both, in one pass."""
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id")
    return E.rates(j, {"quality_rate": F.col("quality") == 1, "toxic_rate": F.col("toxic") == 1},
                   [[], ["lang"], ["source"], ["lang", "source"]], ["lang", "source"])


@query("label_confusion", """SELECT d.lang, count_if(l.quality = 0) AS "0", count_if(l.quality = 1) AS "1" FROM labels l JOIN documents d USING (doc_id) GROUP BY d.lang""")
def label_confusion(spark, sf):
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return E.confusion(j, "lang", "quality", [0, 1])


@query("abstain_metrics", """WITH p AS (SELECT d.lang, l.quality = 1 AS answerable, d.n_chars < 600 AS abstained, l.toxic = 0 AS correct FROM labels l JOIN documents d USING (doc_id)),
r AS (SELECT lang, count(*) AS n, avg(CASE WHEN answerable THEN CAST(correct AND NOT abstained AS INT) END) AS answer_rate, avg(CASE WHEN NOT answerable THEN CAST(abstained AS INT) END) AS abstain_rate FROM p GROUP BY GROUPING SETS ((), (lang)))
SELECT coalesce(lang, 'all') AS lang, n, round(answer_rate, 4) AS answer_rate, round(abstain_rate, 4) AS abstain_rate, round((coalesce(answer_rate, 0) + coalesce(abstain_rate, 0)) / 2, 4) AS overall FROM r""")
def abstain_metrics(spark, sf):
    p = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return E.abstain_metrics(p, "lang", F.col("quality") == 1, F.col("toxic") == 0, F.col("n_chars") < 600)


@query("capability_metrics", """SELECT event_type AS capability, count_if(value > 10) AS ok, count(*) AS total, CASE WHEN count_if(user_id < 50) = 0 THEN NULL ELSE round(count_if(value > 10 AND user_id < 50) / count_if(user_id < 50), 4) END AS tagged_rate FROM events GROUP BY ALL""")
def capability_metrics(spark, sf):
    return E.capability_metrics(table(spark, sf, "events"), "event_type", F.col("value") > 10, F.col("user_id") < 50)


@query("readiness_summary", """WITH s AS (SELECT lang, source, CASE WHEN n_chars < 300 THEN 'coverage_gap' WHEN n_chars < 1500 THEN 'retrieval_ready' ELSE 'extraction_ready' END AS state FROM documents)
SELECT lang, state, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 4) AS share FROM s GROUP BY lang, state""")
def readiness_summary(spark, sf):
    n = F.col("n_chars")
    return E.readiness_summary(table(spark, sf, "documents"), "lang",
                               F.when(n < 300, "coverage_gap").when(n < 1500, "retrieval_ready").otherwise("extraction_ready"))


@query("handoff_blockers", """WITH b AS (SELECT lang, source, unnest([CASE WHEN n_chars < 300 THEN 'short' END, CASE WHEN contains(text, '|') THEN 'table' END, CASE WHEN regexp_matches(text, '[0-9]{4}') THEN 'number' END]) AS blocker FROM documents)
SELECT lang, blocker, count(*) AS n FROM b WHERE blocker IS NOT NULL GROUP BY GROUPING SETS ((blocker), (lang, blocker))""")
def handoff_blockers(spark, sf):
    from dossier.functions.rules import issue_array
    t = F.col("text")
    return E.blocker_counts(table(spark, sf, "documents"), "lang", issue_array([
        (F.col("n_chars") < 300, "short"), (t.contains("|"), "table"), (t.rlike("[0-9]{4}"), "number")]))


@query("family_holdout", """WITH s AS (SELECT source, lang, count(*) AS c FROM documents GROUP BY ALL), r AS (SELECT source, sum(c) AS n, max(c) AS top_n FROM s GROUP BY ALL)
SELECT source, n, round(top_n / n, 4) AS dominant_share, CASE WHEN top_n / n >= 0.7 THEN 'reusable' WHEN top_n / n >= 0.55 THEN 'tuned' ELSE 'fallback' END AS tier, row_number() OVER (ORDER BY top_n / n DESC, source) AS rank FROM r""")
def family_holdout(spark, sf):
    """Dominant state per family with its tier; the final order is over one row per family."""
    from pyspark.sql import Window
    s = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("c"))
    r = s.groupBy("source").agg(F.sum("c").alias("n"), F.max("c").alias("t")).withColumn("sh", F.col("t") / F.col("n"))
    return r.select("source", "n", F.round("sh", 4).alias("dominant_share"), F.when(F.col("sh") >= 0.7, "reusable").when(
        F.col("sh") >= 0.55, "tuned").otherwise("fallback").alias("tier"), F.row_number().over(Window.orderBy(F.col("sh").desc(), "source")).cast("long").alias("rank"))


@query("overlap_metrics", """WITH f AS (SELECT source, lang, md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'), """ + WS + """))) AS v FROM documents), g AS (SELECT source, v, count(DISTINCT lang) AS langs, count(*) AS n FROM f GROUP BY ALL)
SELECT source, count(*) AS values_, round(avg(CAST(n >= 2 AS INT)), 4) AS agreement_rate, round(avg(CAST(n = 1 AS INT)), 4) AS single_rate FROM g GROUP BY source""")
def overlap_metrics(spark, sf):
    from dossier.functions.text import text_fingerprint
    return E.source_agreement(table(spark, sf, "documents"), "source", text_fingerprint(F.col("text")))


@query("scope_matrix", """WITH s AS (SELECT lang, source, unnest([CASE WHEN n_chars >= 300 THEN 'long' END, CASE WHEN contains(text, 'the ') THEN 'the' END, 'all']) AS scope FROM documents)
SELECT scope, lang, count(*) AS units, count(DISTINCT source) AS documents FROM s WHERE scope IS NOT NULL GROUP BY ALL""")
def scope_matrix(spark, sf):
    from dossier.functions.rules import issue_array
    s = table(spark, sf, "documents").select("lang", "source", F.explode(issue_array([
        (F.col("n_chars") >= 300, "long"), (F.col("text").contains("the "), "the"), (F.lit(True), "all")])).alias("scope"))
    return s.groupBy("scope", "lang").agg(F.count(F.lit(1)).alias("units"), F.countDistinct("source").alias("documents"))


@query("extraction_metrics", """SELECT o_orderpriority AS field_group, count(*) AS fields, round(avg(CAST(o_orderstatus <> 'P' AS INT)), 4) AS coverage, round(avg(CAST(o_orderstatus = 'F' AS INT)), 4) AS verified,
 round(avg(CAST(o_totalprice > 300000 AS INT)), 4) AS conflict_rate, round(avg(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END), 4) AS mean_value FROM orders GROUP BY ALL""")
def extraction_metrics(spark, sf):
    s = F.col("o_orderstatus")
    return E.extraction_metrics(table(spark, sf, "orders"), "o_orderpriority", s != "P", s == "F", F.col("o_totalprice") > 300000, F.col("o_totalprice"))


@query("gap_analysis", """WITH g AS (SELECT c_mktsegment AS grp, count(DISTINCT c_custkey) AS fields, count(DISTINCT o_custkey) AS found FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY ALL)
SELECT grp, fields, found, fields - found AS missing, round(found / fields, 4) AS completion, CASE WHEN found / fields < 0.9 THEN 'high' WHEN found / fields < 0.97 THEN 'medium' ELSE 'low' END AS risk FROM g""")
def gap_analysis(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.lit(1).alias("f")).distinct()
    g = table(spark, sf, "customer").join(o, "c_custkey", "left").groupBy(F.col("c_mktsegment").alias("grp")).agg(
        F.count(F.lit(1)).alias("fields"), F.count("f").alias("found"))
    c = F.col("found") / F.col("fields")
    return g.select("grp", "fields", "found", (F.col("fields") - F.col("found")).alias("missing"), F.round(c, 4).alias("completion"),
                    F.when(c < 0.9, "high").when(c < 0.97, "medium").otherwise("low").alias("risk"))


@query("p95_lower", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, value AS p_value, n FROM r WHERE i = greatest(1, CAST(floor(0.95 * n) AS BIGINT))""")
def p95_lower(spark, sf):
    return E.lower_nearest_rank(table(spark, sf, "events"), ["event_type"], "value")


@query("hardening_metrics", """SELECT event_type, round(avg(CAST(value > 20 AS INT)), 4) AS verified_rate, round(avg(value), 4) AS mean_attempts, round(avg(CAST(user_id < 50 AS INT)), 4) AS public_rate FROM events GROUP BY ALL""")
def hardening_metrics(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(E.rate(F.col("value") > 20).alias("verified_rate"), F.round(F.avg("value"), 4).alias("mean_attempts"),
                                                               E.rate(F.col("user_id") < 50).alias("public_rate"))


@query("repeat_consistency", """WITH a AS (SELECT user_id, arg_min(event_type, event_id) AS v FROM events GROUP BY ALL), b AS (SELECT user_id, arg_max(event_type, event_id) AS v FROM events GROUP BY ALL)
SELECT count(*) AS fields, round(avg(CAST(a.v IS NOT DISTINCT FROM b.v AS INT)), 4) AS consistency FROM a JOIN b USING (user_id)""")
def repeat_consistency(spark, sf):
    e = table(spark, sf, "events")
    a = e.groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("v"))
    b = e.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("v"))
    return E.consistency(a, b, "user_id", "v")


RUNS = """r AS (SELECT user_id AS config_id, avg(value) AS latency, avg(CAST(event_type = 'view' AS INT)) AS hit, avg(CAST(event_type = 'click' AS INT)) AS cite, count(*) AS n, max(value) < 300 AS ok FROM events GROUP BY ALL)"""


def runs(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.col("user_id").alias("config_id")).agg(
        F.avg("value").alias("latency"), F.avg((F.col("event_type") == "view").cast("int")).alias("hit"),
        F.avg((F.col("event_type") == "click").cast("int")).alias("cite"), F.count(F.lit(1)).alias("n"), (F.max("value") < 300).alias("ok"))


@query("composite_score", f"""WITH {RUNS} SELECT config_id, CASE WHEN ok THEN round(0.2 * (1 - (latency - min(latency) FILTER (ok) OVER ()) / (max(latency) FILTER (ok) OVER () - min(latency) FILTER (ok) OVER ())) + 0.5 * hit + 0.3 * cite, 4) ELSE 0 END AS composite FROM r""")
def composite_score(spark, sf):
    return E.composite(runs(spark, sf), {"hit": 0.5, "cite": 0.3}, "latency", 0.2, F.col("ok")).select("config_id", "composite")


@query("weighted_average", f"""WITH {RUNS} SELECT ok, round(sum(hit * n) / sum(n), 4) AS weighted_mean FROM r GROUP BY ok""")
def weighted_average(spark, sf):
    return E.weighted_mean(runs(spark, sf), ["ok"], "hit", "n")


@query("metric_deltas", """WITH a AS (SELECT user_id, avg(value) AS v, avg(CAST(event_type = 'view' AS INT)) AS h FROM events WHERE event_id % 2 = 0 GROUP BY ALL), b AS (SELECT user_id, avg(value) AS v, avg(CAST(event_type = 'view' AS INT)) AS h FROM events WHERE event_id % 2 = 1 GROUP BY ALL),
u AS (SELECT user_id, 'v' AS metric, a.v AS x, b.v AS y FROM a FULL JOIN b USING (user_id) UNION ALL SELECT user_id, 'h', a.h, b.h FROM a FULL JOIN b USING (user_id))
SELECT user_id, metric, round(y - x, 6) AS delta, CASE WHEN y - x > 1e-9 THEN 'better' WHEN y - x < -1e-9 THEN 'worse' WHEN y - x IS NOT NULL THEN 'same' ELSE 'missing' END AS verdict FROM u""")
def metric_deltas(spark, sf):
    """Two runs of every event (even and odd halves of the log), metric by metric."""
    e = table(spark, sf, "events").withColumn("run", F.col("event_id") % 2)
    g = e.groupBy("user_id", "run").agg(F.avg("value").alias("v"), F.avg((F.col("event_type") == "view").cast("int")).alias("h"))
    d = J.metric_deltas(g.filter("run = 0"), g.filter("run = 1"), ["v", "h"], ["user_id"])
    return d.select("user_id", "metric", F.round("delta", 6).alias("delta"), "verdict")


@query("gate_check", """WITH m AS (SELECT event_type, avg(value) AS mean_value, avg(CAST(user_id < 50 AS INT)) AS low_users FROM events GROUP BY ALL), u AS (SELECT event_type, 'mean_value' AS metric, mean_value AS value, 24.0::DOUBLE AS minimum FROM m UNION ALL SELECT event_type, 'low_users', low_users, 0.4 FROM m)
SELECT event_type, metric, round(value, 6) AS value, minimum, value >= minimum AS ok, bool_and(value >= minimum) OVER (PARTITION BY event_type) AS all_ok FROM u""")
def gate_check(spark, sf):
    m = table(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("mean_value"), F.avg((F.col("user_id") < 50).cast("int")).alias("low_users"))
    return CL.gates(m, {"mean_value": 24.0, "low_users": 0.4}, ["event_type"]).select(
        "event_type", "metric", F.round("value", 6).alias("value"), "minimum", "ok", "all_ok")


@query("status_ladder", """SELECT event_type, CASE WHEN avg(value) >= 25 THEN 'pass' WHEN avg(value) >= 24.5 THEN 'pass_with_limits' ELSE 'not_pass' END AS status FROM events GROUP BY ALL""")
def status_ladder(spark, sf):
    m = table(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("v"))
    return m.select("event_type", CL.status_ladder([(F.col("v") >= 25, "pass"), (F.col("v") >= 24.5, "pass_with_limits")]).alias("status"))


@query("eval_set_issues", f"""WITH d AS (SELECT doc_id % 900 AS id, text, source FROM documents), i AS (SELECT id, unnest([CASE WHEN length(text) < 100 THEN 'question_short' END, CASE WHEN source = 'src0' THEN 'source_missing' END]) AS issue FROM d)
SELECT id, issue FROM i WHERE issue IS NOT NULL UNION ALL SELECT id, 'duplicate_id' FROM d GROUP BY id HAVING count(*) > 1""")
def eval_set_issues(spark, sf):
    d = table(spark, sf, "documents").select((F.col("doc_id") % 900).alias("id"), "text", "source")
    return E.validation_issues(d, "id", [(F.length("text") < 100, "question_short"), (F.col("source") == "src0", "source_missing")])


@query("bottleneck", """WITH s AS (SELECT lang, CASE WHEN n_chars < 300 THEN 'parser' WHEN contains(text, '|') THEN 'table' WHEN n_chars < 2000 THEN 'retrieval' ELSE 'ready' END AS stage FROM documents), c AS (SELECT lang, stage, count(*) AS n FROM s GROUP BY ALL)
SELECT lang, arg_max(stage, n) AS stage, max(n) AS n FROM c GROUP BY lang""")
def bottleneck(spark, sf):
    n = F.col("n_chars")
    s = table(spark, sf, "documents").withColumn("stage", F.when(n < 300, "parser").when(F.col("text").contains("|"), "table").when(n < 2000, "retrieval").otherwise("ready"))
    return s.groupBy("lang", "stage").agg(F.count(F.lit(1)).alias("n")).groupBy("lang").agg(F.max_by("stage", "n").alias("stage"), F.max("n").alias("n"))


@query("insufficient_scores", f"""WITH {PAIRS} SELECT conv_id, turn, CASE WHEN conv_id % 10 <> 0 THEN length(a) % 5 <> 0 OR contains(lower(a), 'the') ELSE length(a) % 5 = 0 AND contains(lower(a), 'the') END AS ok FROM pairs""")
def insufficient_scores(spark, sf):
    return turn_pairs(spark, sf).select("conv_id", "turn", E.insufficient_score(
        F.col("conv_id") % 10 == 0, F.length("a") % 5 == 0, F.lower("a").contains("the")).alias("ok"))


@query("gate_evals", r"""WITH q AS (SELECT lang, contains(text, 'the ') AS expected, regexp_matches(lower(text), '(^|\s)the\s') AND NOT contains(text, '%%%') AS got, contains(text, 'token') AS leaked FROM documents)
SELECT lang, count(*) AS cases, round(avg(CAST(expected = got AS INT)), 4) AS pass_rate, round(avg(CAST(leaked AS INT)), 4) AS leak_rate FROM q GROUP BY lang""")
def gate_evals(spark, sf):
    """A case table through the intent gate: share of expected outcomes, share of leaks."""
    from dossier.functions.signals import headcount_intent
    t = F.col("text")
    got = headcount_intent(t, "%%%", r"(?i)(^|\s)the\s", "(?!x)x")
    return table(spark, sf, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("cases"), E.rate(t.contains("the ") == got).alias("pass_rate"), E.rate(t.contains("token")).alias("leak_rate"))


@query("case_evaluation", """WITH c AS (SELECT o_orderkey, o_orderkey % 3 AS t, o_totalprice AS x, o_totalprice / 1000 AS y, o_totalprice * 1.01 AS z FROM orders)
SELECT CASE t WHEN 0 THEN 'equivalence' WHEN 1 THEN 'conflict' ELSE 'canonical' END AS test_type, count(*) AS cases, count_if(CASE t WHEN 0 THEN abs(x - y * 1000) / x <= 0.001 WHEN 1 THEN abs(x - z) / greatest(x, z, 1) > 0.001 ELSE true END) AS passed FROM c GROUP BY ALL""")
def case_evaluation(spark, sf):
    """Constructed value pairs judged by their test type."""
    from dossier.functions import numbers as N
    k, x = F.col("o_orderkey") % 3, F.col("o_totalprice")
    f = lambda c: F.format_string("%,.4f", c)
    t = F.when(k == 0, "equivalence").when(k == 1, "conflict").otherwise("canonical")
    ok = F.when(k == 0, N.numeric_values_equivalent(f(x), f(x / 1000))).when(k == 1, ~N.numeric_values_equivalent(f(x), f(x * 1.01))).otherwise(
        N.canonical_value(F.lit("Scope 3")) == "scope_3")
    return table(spark, sf, "orders").select(t.alias("test_type"), ok.alias("ok")).groupBy("test_type").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("ok").alias("passed"))


@query("family_gate", """WITH s AS (SELECT source, count(*) AS n, avg(CASE WHEN lang = 'en' THEN CAST(n_chars > 1000 AS INT) END) AS quant, avg(CASE WHEN lang <> 'en' THEN CAST(n_chars > 1000 AS INT) END) AS qual FROM documents GROUP BY ALL)
SELECT source, n, round(quant, 4) AS quantitative_rate, round(qual, 4) AS qualitative_rate, CASE WHEN quant >= 0.75 THEN 'high' WHEN quant >= 0.6 THEN 'medium' ELSE 'low' END AS likelihood FROM s""")
def family_gate(spark, sf):
    big = (F.col("n_chars") > 1000).cast("int")
    g = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("lang") == "en", big)).alias("a"), F.avg(F.when(F.col("lang") != "en", big)).alias("b"))
    return g.select("source", "n", F.round("a", 4).alias("quantitative_rate"), F.round("b", 4).alias("qualitative_rate"),
                    F.when(F.col("a") >= 0.75, "high").when(F.col("a") >= 0.6, "medium").otherwise("low").alias("likelihood"))


@query("fusion_failures", """WITH g AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS docs, count(*) AS n, max(l_quantity) - min(l_quantity) AS spread FROM lineitem GROUP BY ALL), s AS (SELECT CASE WHEN n < 20 THEN 'extraction' WHEN docs < 2 THEN 'single_source' WHEN spread > 48 THEN 'equivalence' ELSE 'ok' END AS stage FROM g) SELECT stage, count(*) AS n FROM s GROUP BY stage""")
def fusion_failures(spark, sf):
    from dossier.functions.rules import ladder
    g = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("docs"), F.count(F.lit(1)).alias("n"), (F.max("l_quantity") - F.min("l_quantity")).alias("sp"))
    st = ladder([(F.col("n") < 20, "extraction"), (F.col("docs") < 2, "single_source"), (F.col("sp") > 48, "equivalence")], "ok")
    return g.groupBy(st.alias("stage")).agg(F.count(F.lit(1)).alias("n"))


@query("merged_measures", """WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, user_id, value FROM events),
l AS (SELECT 'all' AS level, 'all' AS part, * FROM e UNION ALL SELECT 'day', day, * FROM e UNION ALL SELECT 'type', event_type, * FROM e)
SELECT level, part, count(*) AS n_rows, count(value) AS n, round(avg(value), 6) AS mean_value, min(value) AS least, max(value) AS most,
 true AS p50_in_bounds, true AS p95_in_bounds, true AS users_in_bounds FROM l GROUP BY ALL""")
def merged_measures(spark, sf):
    """One measure table by day and type, merged to three levels; sketches are held against exact ranks and counts of the rows."""
    e = table(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    kept = materialise(MS.measure(e, ["day", "event_type"], "value", "user_id"))
    levels = {"all": F.lit("all"), "day": F.col("day"), "type": F.col("event_type")}
    parts = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), c.alias("part")) for k, c in levels.items())))
    merged = MS.roll_up(kept.withColumn("_l", parts).select("_l.*", *MS.COLUMNS), ["level", "part"]).select(
        "level", "part", "n_rows", "n", F.round(MS.mean(), 6).alias("mean_value"), "least", "most",
        MS.quantile(0.5).alias("p50"), MS.quantile(0.95).alias("p95"), MS.distinct().alias("users"))
    exact = e.withColumn("_l", parts).select("_l.*", "value", "user_id").join(merged.select("level", "part", "p50", "p95"), ["level", "part"])
    share = lambda c, op: F.avg(F.when(op, 1.0).otherwise(0.0))
    ranks = exact.groupBy("level", "part").agg(
        *(share(p, F.col("value") < F.col(p)).alias(f"{p}_below") for p in ("p50", "p95")),
        *(share(p, F.col("value") <= F.col(p)).alias(f"{p}_upto") for p in ("p50", "p95")), F.countDistinct("user_id").alias("true_users"))
    # Twice the error of 99 in 100; a group of n values has ranks no finer than 1 / n.
    slack = 2 * MS.rank_error() + 1 / F.col("n")
    ok = [((F.col(f"{p}_below") <= s + slack) & (F.col(f"{p}_upto") >= s - slack)).alias(f"{p}_in_bounds") for p, s in (("p50", .5), ("p95", .95))]
    return merged.join(ranks, ["level", "part"]).select(
        "level", "part", "n_rows", "n", "mean_value", "least", "most", *ok,
        (F.abs(F.col("users") - F.col("true_users")) <= F.col("true_users") * MS.distinct_error()).alias("users_in_bounds"))
