"""Join queries: lookups, resolution, reconciliation, routing."""
from __future__ import annotations

from pyspark.sql import functions as F

from dossier.operators import classify as CL, joins as J, matching as M
from dossier.operators.bounds import top_k
from dossier.plans.base import query, table


@query("attach_record", """WITH h AS (SELECT conv_id, turn, 'rec_' || (conv_id * 7 + turn) AS record_id FROM conversations), r AS (SELECT 'rec_' || (doc_id % 700) AS record_id, max(doc_id) AS last_doc FROM documents GROUP BY ALL)
SELECT conv_id, turn, h.record_id, last_doc, coalesce(last_doc % 10 = 3, false) AS year_ok FROM h LEFT JOIN r USING (record_id)""")
def attach_record(spark, sf):
    """Record id read from the chunk text; repeated records: the last one loaded."""
    h = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(
        F.lit("record_id: rec_"), (F.col("conv_id") * 7 + F.col("turn")).cast("string"), F.lit("\ntext"), "text").alias("text"))
    r = table(spark, sf, "documents").select(F.concat(F.lit("rec_"), (F.col("doc_id") % 700).cast("string")).alias("record_id"),
                                             F.col("doc_id").alias("last_doc"), (F.col("doc_id") % 10).alias("yr"))
    j = J.attach_record(h, r, "text", "record_id", "last_doc")
    return j.select("conv_id", "turn", "record_id", "last_doc",
                    J.passes_record_filters(F.col("yr"), F.lit(3), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("year_ok"))


@query("chunk_alignment", """WITH c AS (SELECT source, doc_id, substr(text, 1, 180) AS p, substr(text, 1, 220) AS w FROM documents), h AS (SELECT doc_id AS hit, source, substr(text, 11, 100) AS q FROM documents)
SELECT h.hit, min(c.doc_id) AS aligned FROM h JOIN c ON c.source = h.source AND c.doc_id = h.hit AND contains(c.w, h.q) GROUP BY ALL""")
def chunk_alignment(spark, sf):
    """The hit carries its chunk id, so the prefix test only confirms it."""
    d = table(spark, sf, "documents")
    h = d.select(F.col("doc_id").alias("hit"), "source", F.substring("text", 11, 100).alias("q"))
    c = d.select("source", "doc_id", F.substring("text", 1, 220).alias("w"))
    return h.join(c, (c.doc_id == h.hit) & (c.source == h.source) & F.col("w").contains(F.col("q"))).groupBy("hit").agg(F.min("doc_id").alias("aligned"))


@query("primary_source", """WITH s AS (SELECT l_orderkey, l_suppkey, l_partkey, CASE WHEN l_returnflag = 'A' THEN l_linenumber END AS prio, l_linestatus = 'O' AS real FROM lineitem)
SELECT l_orderkey, l_suppkey, prio FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY (prio IS NOT NULL) DESC, prio ASC NULLS LAST, real DESC, l_suppkey * 1000000 + l_partkey) AS r FROM s) WHERE r = 1""")
def primary_source(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", F.when(F.col("l_returnflag") == "A", F.col("l_linenumber")).alias("prio"),
                                             (F.col("l_linestatus") == "O").alias("real"), (F.col("l_suppkey") * 1000000 + F.col("l_partkey")).alias("tie"))
    return J.primary_source(li, "l_orderkey", "prio", F.col("real"), "tie").select("l_orderkey", "l_suppkey", F.col("prio").cast("long").alias("prio"))


@query("question_gold_source", """WITH s AS (SELECT l_orderkey, min(l_suppkey) AS supp FROM lineitem GROUP BY ALL), q AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE o_orderpriority END AS q, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS gold, o_orderstatus = 'O' AS nd FROM orders)
SELECT o_orderkey, CASE WHEN q = '' OR (supp IS NULL AND NOT nd) OR (gold IS NULL AND NOT nd) THEN 'needs_review' WHEN nd THEN 'abstain' ELSE 'answerable' END AS partition,
 array_to_string(list_filter([CASE WHEN q = '' THEN 'missing_question' END, CASE WHEN supp IS NULL AND NOT nd THEN 'missing_source' END, CASE WHEN gold IS NULL AND NOT nd THEN 'missing_gold' END], lambda x: x IS NOT NULL), ',') AS reasons FROM q LEFT JOIN s ON l_orderkey = o_orderkey""")
def question_gold_source(spark, sf):
    o = table(spark, sf, "orders")
    s = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("supp"))
    j = o.join(s, "o_orderkey", "left")
    p = CL.intake_partition(F.when(F.col("o_orderkey") % 13 == 0, "").otherwise(F.col("o_orderpriority")), F.col("supp"),
                            F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")), F.col("o_orderstatus") == "O")
    return j.select("o_orderkey", p.alias("p")).select("o_orderkey", "p.partition", "p.reasons")


SIDES = """ds AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey END AS qid, 'k' || o_orderkey AS bk, o_totalprice AS v, o_orderstatus = 'O' AS abst, o_orderkey % 2 = 0 AS hit FROM orders WHERE o_orderkey % 7 <> 0),
ins AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey END AS qid, 'k' || o_orderkey AS bk, round(o_totalprice + CASE WHEN o_orderkey % 4 = 0 THEN 5 ELSE 0 END, 2) AS w, o_orderkey % 3 <> 0 AS ok, 0.4 + (o_orderkey % 6) * 0.1 AS conf, o_orderkey % 2 = 1 AS res FROM orders WHERE o_orderkey % 11 <> 0)"""


@query("pair_resolution", f"""WITH {SIDES}, j AS (SELECT coalesce(d.bk, i.bk) AS bk, d.bk IS NOT NULL AS dt, i.bk IS NOT NULL AS it, d.v, d.abst, d.hit, i.w, i.ok, i.conf, i.res, CASE WHEN coalesce(d.qid, i.qid) IS NULL THEN 'business_key' ELSE 'question_id' END AS join_type
  FROM ds d FULL JOIN ins i ON (d.qid = i.qid OR (d.qid IS NULL AND i.qid IS NULL AND d.bk = i.bk))),
f AS (SELECT *, dt AND NOT abst AS dsp, it AND ok AS inp, (dt AND NOT abst AND hit) OR (it AND conf >= 0.5) AS part FROM j),
s AS (SELECT *, CASE WHEN NOT coalesce(dsp, false) AND NOT coalesce(inp, false) AND coalesce(part, false) THEN 'INSUFFICIENT_EVIDENCE' WHEN NOT coalesce(dsp, false) AND NOT coalesce(inp, false) THEN 'NO_ANSWER_FOUND'
  WHEN coalesce(dsp, false) AND NOT coalesce(inp, false) THEN 'BACKFILL_FROM_DATASET' WHEN coalesce(inp, false) AND NOT coalesce(dsp, false) THEN 'BACKFILL_FROM_INTERNAL' WHEN abs(v - w) <= 0.01 THEN 'MATCH_CONFIRMED' ELSE 'CONFLICT_REVIEW_REQUIRED' END AS status FROM f)
SELECT bk, join_type, status, CASE WHEN status = 'BACKFILL_FROM_INTERNAL' THEN conf >= 0.85 AND res ELSE status IN ('BACKFILL_FROM_DATASET', 'MATCH_CONFIRMED') END AS auto_confirm,
 CASE WHEN status = 'INSUFFICIENT_EVIDENCE' THEN 'RAG' WHEN status = 'CONFLICT_REVIEW_REQUIRED' THEN 'SME' WHEN status = 'BACKFILL_FROM_INTERNAL' AND NOT (conf >= 0.85 AND res) THEN 'SME' END AS review_owner FROM s""")
def pair_resolution(spark, sf):
    return resolved_pairs(spark, sf).select("bk", "join_type", "status", "auto_confirm", "review_owner")


def resolved_pairs(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    qid, bk = F.when(k % 5 == 0, None).otherwise(k).alias("qid"), F.concat(F.lit("k"), k.cast("string")).alias("bk")
    ds = o.filter(k % 7 != 0).select(qid, bk, F.format_string("%,.2f", "o_totalprice").alias("v"), (F.col("o_orderstatus") == "O").alias("abst"),
                                     (k % 2 == 0).alias("hit"), F.lit(True).alias("dt"), k.alias("do"))
    ins = o.filter(k % 11 != 0).select(qid, bk, F.format_string("%.2f", F.col("o_totalprice") + F.when(k % 4 == 0, 5).otherwise(0)).alias("w"),
                                       (k % 3 != 0).alias("ok"), (0.4 + (k % 6) * 0.1).alias("conf"), (k % 2 == 1).alias("res"), F.lit(True).alias("it"), k.alias("io"))
    j = J.resolution_join(ds, ins, "qid", "bk", F.col("do"), F.col("io"))
    t = lambda c: F.coalesce(F.col(c), F.lit(False))
    return CL.pair_resolution(j, F.col("v"), F.col("abst"), F.col("hit"), F.lit(None).cast("boolean"), F.col("w"), F.col("ok"),
                              F.col("conf"), F.col("res"), t("dt"), t("it"))


@query("resolution_breakdown", f"""WITH {SIDES}, j AS (SELECT coalesce(d.qid, i.qid) IS NULL AS nob, count(*) AS n FROM ds d FULL JOIN ins i ON (d.qid = i.qid OR (d.qid IS NULL AND i.qid IS NULL AND d.bk = i.bk)) GROUP BY ALL)
SELECT CASE WHEN nob THEN 'business_key' ELSE 'question_id' END AS join_type, n FROM j""")
def resolution_breakdown(spark, sf):
    return resolved_pairs(spark, sf).groupBy("join_type").agg(F.count(F.lit(1)).alias("n"))


@query("comparison_join", """WITH g AS (SELECT l_orderkey, sum(l_extendedprice) AS total FROM lineitem GROUP BY ALL)
SELECT o_orderkey, CASE WHEN g.l_orderkey IS NULL THEN 'unmatched' WHEN o_orderkey % 2 = 0 THEN 'row_index' ELSE 'business_key' END AS method, CASE WHEN g.l_orderkey IS NULL THEN NULL ELSE total > o_totalprice END AS above FROM orders LEFT JOIN g ON l_orderkey = o_orderkey""")
def comparison_join(spark, sf):
    """By row index first, by business key for the rest; the way is recorded."""
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("total"))
    o = table(spark, sf, "orders")
    a = g.select(F.when(F.col("l_orderkey") % 2 == 0, F.col("l_orderkey")).alias("row_index"), F.col("total").alias("t1"))
    b = g.select(F.concat(F.lit("k"), F.col("l_orderkey").cast("string")).alias("bk"), F.col("total").alias("t2"))
    j = o.join(a, o.o_orderkey == a.row_index, "left").withColumn("bk", F.concat(F.lit("k"), F.col("o_orderkey").cast("string"))).join(b, "bk", "left")
    return j.select("o_orderkey", F.when(F.col("t1").isNotNull(), "row_index").when(F.col("t2").isNotNull(), "business_key").otherwise("unmatched").alias("method"),
                    (F.coalesce("t1", "t2") > F.col("o_totalprice")).alias("above"))


@query("text_enrichment", """SELECT c.conv_id, c.turn, md5(coalesce(nullif(d.text, ''), c.text, '')) AS text_md5 FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id * 17""")
def text_enrichment(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("k"), F.col("text").alias("dt"))
    c = table(spark, sf, "conversations").withColumn("k", F.col("conv_id") * 17)
    return c.join(d, "k", "left").select("conv_id", "turn", F.md5(F.coalesce(F.nullif("dt", F.lit("")), "text", F.lit(""))).alias("text_md5"))


@query("anti_ingest", """WITH n AS (SELECT md5(source || text) AS id, source FROM documents), k AS (SELECT md5(source || text) AS id FROM documents WHERE lang = 'en')
SELECT source, count(*) AS added FROM n WHERE id NOT IN (SELECT id FROM k) GROUP BY source""")
def anti_ingest(spark, sf):
    d = table(spark, sf, "documents").select(F.md5(F.concat("source", "text")).alias("id"), "source", "lang")
    return J.skip_known(d, d.filter("lang = 'en'"), ["id"]).groupBy("source").agg(F.count(F.lit(1)).alias("added"))


@query("local_over_web", """WITH l AS (SELECT DISTINCT source, n_chars FROM documents WHERE lang = 'en'), w AS (SELECT * FROM documents WHERE lang <> 'en') SELECT doc_id, CASE WHEN l.source IS NULL THEN 'kept' ELSE 'local_copy' END AS reason FROM w LEFT JOIN l USING (source, n_chars)""")
def local_over_web(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars", "lang")
    kept, skipped = J.prefer_local(d.filter("lang <> 'en'"), d.filter("lang = 'en'"), ["source", "n_chars"])
    return kept.select("doc_id", F.lit("kept").alias("reason")).unionByName(skipped.select("doc_id", F.col("skip_reason").alias("reason")))


@query("fill_missing_sources", """WITH r AS (SELECT s_name, s_nationkey FROM supplier), q AS (SELECT c_custkey, 'Supplier#' || lpad(CAST(c_custkey % 150 AS VARCHAR), 9, '0') AS title, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS nk FROM customer)
SELECT c_custkey, coalesce(nk, r.s_nationkey, a.s_nationkey) AS nk, CASE WHEN nk IS NOT NULL THEN 'present' WHEN r.s_nationkey IS NOT NULL THEN 'title' WHEN a.s_nationkey IS NOT NULL THEN 'alias' ELSE 'missing' END AS fill_method
FROM q LEFT JOIN r ON r.s_name = title LEFT JOIN r a ON a.s_name = 'Supplier#' || lpad(CAST((c_custkey % 150) % 120 AS VARCHAR), 9, '0')""")
def fill_missing_sources(spark, sf):
    nm = lambda c: F.concat(F.lit("Supplier#"), F.lpad(c.cast("string"), 9, "0"))
    k = F.col("c_custkey")
    q = table(spark, sf, "customer").select("c_custkey", nm(k % 150).alias("title"), F.when(k % 3 == 0, F.col("c_nationkey")).alias("nk"))
    r = table(spark, sf, "supplier").select(F.col("s_name").alias("title"), F.col("s_nationkey").alias("nk"))
    return J.fill_missing(q, r, "title", ["nk"], nm((k % 150) % 120)).select("c_custkey", F.col("nk").cast("long").alias("nk"), "fill_method")


@query("path_resolution", """WITH l AS (SELECT 'd/' || c_nationkey || '/' || c_custkey || '.md' AS path, (c_custkey % 1000) || '.md' AS name FROM customer), r AS (SELECT s_suppkey, 'd/' || s_nationkey || '/' || s_suppkey || '.md' AS p1, (s_suppkey * 12) || '.md' AS nm FROM supplier),
b AS (SELECT name, count(*) AS n, min(path) AS np FROM l GROUP BY ALL)
SELECT s_suppkey, coalesce(l.path, CASE WHEN n = 1 THEN np END) AS path, CASE WHEN l.path IS NOT NULL THEN 'candidate' WHEN n = 1 THEN 'file_name' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS method
FROM r LEFT JOIN l ON l.path = p1 LEFT JOIN b ON b.name = nm""")
def path_resolution(spark, sf):
    s = lambda c: F.col(c).cast("string")
    l = table(spark, sf, "customer").select(F.concat(F.lit("d/"), s("c_nationkey"), F.lit("/"), s("c_custkey"), F.lit(".md")).alias("path"),
                                            F.concat((F.col("c_custkey") % 1000).cast("string"), F.lit(".md")).alias("name"))
    r = table(spark, sf, "supplier").select("s_suppkey", F.array(
        F.concat(F.lit("x/"), (F.col("s_suppkey") * 12).cast("string"), F.lit(".md")),
        F.concat(F.lit("d/"), s("s_nationkey"), F.lit("/"), s("s_suppkey"), F.lit(".md"))).alias("cands"))
    return J.resolve_paths(r, l, "s_suppkey", "cands", "path", "name")


@query("latest_per_key", """WITH g AS (SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL) SELECT g.user_id, g.event_type, g.event_id, e.value FROM g JOIN events e USING (event_id)""")
def latest_per_key(spark, sf):
    return J.latest_per_key(table(spark, sf, "events"), ["user_id", "event_type"], "event_id", ["value"])


@query("resume_runs", """WITH g AS (SELECT user_id, arg_max(event_type, event_id) AS st FROM events GROUP BY ALL) SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM g WHERE st IN ('view', 'click', 'purchase'))""")
def resume_runs(spark, sf):
    last = J.latest_per_key(table(spark, sf, "events"), ["user_id"], "event_id", ["event_type"])
    done = last.filter(F.col("event_type").isin("view", "click", "purchase")).select(F.col("user_id").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(done, "c_custkey", "left_anti")


@query("side_by_side", """WITH a AS (SELECT user_id, avg(value) AS x FROM events WHERE event_type = 'view' GROUP BY ALL), b AS (SELECT user_id, avg(value) AS y FROM events WHERE event_type = 'click' GROUP BY ALL)
SELECT user_id, round(x, 6) AS x, round(y, 6) AS y, round(x / y, 6) AS ratio FROM a JOIN b USING (user_id)""")
def side_by_side(spark, sf):
    e = table(spark, sf, "events")
    a = e.filter("event_type = 'view'").groupBy("user_id").agg(F.avg("value").alias("x"))
    b = e.filter("event_type = 'click'").groupBy("user_id").agg(F.avg("value").alias("y"))
    return a.join(b, "user_id").select("user_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round(F.try_divide("x", "y"), 6).alias("ratio"))


ALIASES = [("ring", "band,loop"), ("bolt", "screw"), ("widget", "gadget,part")]


@query("alias_phrases", """SELECT p_partkey, array_to_string(list_distinct(list_filter([lower(p_name), lower(p_type), lower(p_type || ' ' || p_name), CASE WHEN contains(p_name, 'ring') THEN 'band' END, CASE WHEN contains(p_name, 'ring') THEN 'loop' END,
  CASE WHEN contains(p_name, 'bolt') THEN 'screw' END, CASE WHEN contains(p_name, 'widget') THEN 'gadget' END, CASE WHEN contains(p_name, 'widget') THEN 'part' END], lambda x: x IS NOT NULL)).list_sort(), ',') AS phrases FROM part""")
def alias_phrases(spark, sf):
    from dossier.operators.extraction import alias_phrases as ap
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.array_sort(ap(
        F.col("p_name"), F.col("p_type"), F.lit(None).cast("string"), F.col("p_name"), [(k, v.split(",")) for k, v in ALIASES])), ",").alias("phrases"))


@query("index_parity", """WITH e AS (SELECT lang, md5(text) AS id FROM documents WHERE n_chars > 200), s AS (SELECT lang, md5(text) AS id FROM documents WHERE source <> 'src5'), u AS (SELECT coalesce(e.lang, s.lang) AS lang, e.id AS a, s.id AS b FROM (SELECT DISTINCT * FROM e) e FULL JOIN (SELECT DISTINCT * FROM s) s ON e.lang = s.lang AND e.id = s.id)
SELECT lang, count(a) AS expected, count(b) AS stored, count_if(b IS NULL) AS only_expected, count_if(a IS NULL) AS only_stored FROM u GROUP BY lang""")
def index_parity(spark, sf):
    d = table(spark, sf, "documents").select("lang", F.md5("text").alias("id"), "n_chars", "source")
    return J.parity(d.filter("n_chars > 200"), d.filter("source <> 'src5'"), ["lang"], ["id"])


@query("field_link", """SELECT c_mktsegment AS field, count(*) AS rows_, round(avg(CAST(o_orderstatus <> 'P' AS INT)), 4) AS value_rate FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL""")
def field_link(spark, sf):
    from dossier.operators.evaluation import rate
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("field"))
    return table(spark, sf, "orders").join(c, "o_custkey").groupBy("field").agg(F.count(F.lit(1)).alias("rows_"), rate(F.col("o_orderstatus") != "P").alias("value_rate"))


@query("routing_alignment", """WITH a AS (SELECT c_custkey AS k, c_acctbal > 0 AS f FROM customer), b AS (SELECT o_custkey AS k, max(o_totalprice) > 300000 AS f FROM orders GROUP BY ALL)
SELECT coalesce(a.k, b.k) AS k, a.f AS feasible, b.f AS ready FROM a FULL JOIN b USING (k) WHERE a.f IS DISTINCT FROM b.f""")
def routing_alignment(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") > 0).alias("feasible"))
    b = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg((F.max("o_totalprice") > 300000).alias("ready"))
    return a.join(b, "k", "full_outer").filter(~F.col("feasible").eqNullSafe(F.col("ready")))


ROUTE = r"""wc AS (SELECT source, term, count(*) AS n FROM (SELECT source, unnest(regexp_extract_all(lower(text), '([a-z]{6,})', 1)) AS term FROM documents) GROUP BY ALL),
tr AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, term) AS r FROM wc), dt AS (SELECT source, term, CASE WHEN r <= 5 THEN 3 ELSE 2 END AS weight FROM tr WHERE r <= 20),
sc AS (SELECT item_id, source, sum(weight) AS s FROM benchmark JOIN dt ON contains(lower(text), term) GROUP BY ALL), kp AS (SELECT *, max(s) OVER (PARTITION BY item_id) AS m FROM sc),
rt AS (SELECT item_id, source, s, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, source) AS r FROM kp WHERE s >= greatest(1, m - 1)),
al AS (SELECT item_id, source, CAST(s AS BIGINT) AS route_score, r AS route_rank FROM rt WHERE r <= 4 UNION ALL SELECT item_id, 'src0', 0, 1 FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM rt))"""


def source_terms(spark, sf):
    """A registry of the sources: of all long words of all their texts the five most frequent as domains (3), the next fifteen as topics (2)."""
    words = table(spark, sf, "documents").select("source", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{6,})"), F.lit(1))).alias("term"))
    counts = words.groupBy("source", "term").agg(F.count(F.lit(1)).alias("n"))
    return top_k(counts, ["source"], [F.col("n").desc(), F.col("term")], 20, "r").select("source", "term", F.when(F.col("r") <= 5, 3).otherwise(2).alias("weight"))


def routed(spark, sf):
    q = table(spark, sf, "benchmark").select("item_id", "text")
    return q, J.route_documents(q, source_terms(spark, sf), "item_id", "text", "source", 4, "src0")


@query("document_routing", f"WITH {ROUTE} SELECT item_id, source, route_score, route_rank FROM al")
def document_routing(spark, sf):
    return routed(spark, sf)[1].select("item_id", "source", F.col("route_score").cast("long").alias("route_score"), F.col("route_rank").cast("long").alias("route_rank"))


@query("evidence_plans", f"""WITH {ROUTE}, g AS (SELECT item_id, string_agg(source, ',' ORDER BY route_rank) AS docs, count(*) AS n FROM al GROUP BY ALL), k AS (SELECT g.*, CASE WHEN item_id % 3 = 0 THEN 'qualitative' ELSE 'quantitative' END AS kind, contains(lower(text), 'the ') AS x FROM g JOIN benchmark USING (item_id))
SELECT item_id, kind, docs, CASE WHEN kind = 'qualitative' OR (x AND n >= 2) THEN 'cross_document_answer' ELSE 'single_document_answer' END AS answer_mode, kind = 'qualitative' OR (x AND n >= 2) AS needs_merge FROM k""")
def evidence_plans(spark, sf):
    q, r = routed(spark, sf)
    q = q.withColumn("kind", F.when(F.col("item_id") % 3 == 0, "qualitative").otherwise("quantitative"))
    return J.evidence_plan(r, q, "item_id", "source", "kind", "the ", "text").select(
        "item_id", "kind", F.array_join("primary_documents", ",").alias("docs"), "answer_mode", "needs_merge")


LOGICAL = """d AS (SELECT DISTINCT replace(p_name, ' ', CASE p_partkey % 7 WHEN 0 THEN '_Impact_' WHEN 1 THEN '_governance_' ELSE '_' END) || '_' || p_partkey % 20 || CASE p_partkey % 3 WHEN 0 THEN '_pdf' WHEN 1 THEN '_XML' ELSE '_json' END AS doc FROM part),
h AS (SELECT DISTINCT split_part(p_name, ' ', 2) || '-' || p_type AS logical, CASE WHEN p_partkey % 2 = 0 THEN upper(substr(split_part(p_name, ' ', 2), 2)) ELSE substr(replace(p_name, ' ', '_'), 2, 6) END AS hint,
 CASE substr(p_type, 1, 1) WHEN 'E' THEN 'sustainability_report' WHEN 'S' THEN 'governance_report' WHEN 'P' THEN 'dart_filing' END AS kind FROM part),
m AS (SELECT logical, doc, lower(doc) AS l, hint, kind FROM h JOIN d ON contains(lower(doc), lower(hint))),
s AS (SELECT logical, doc, max(length(hint) + CASE WHEN kind = 'sustainability_report' AND (contains(l, 'impact') OR contains(l, 'sustain')) THEN 40 ELSE 0 END + CASE WHEN kind = 'sustainability_report' AND ends_with(l, '_pdf') THEN 8 ELSE 0 END
 + CASE WHEN kind IN ('governance_report', 'dart_filing') AND (contains(l, 'governance') OR contains(l, 'dart')) THEN 35 ELSE 0 END + CASE WHEN kind IN ('governance_report', 'dart_filing') AND ends_with(l, '_xml') THEN 6 ELSE 0 END
 - CASE WHEN ends_with(l, '_json') THEN 5 ELSE 0 END)::DOUBLE AS score FROM m GROUP BY ALL)"""


def logical_matches(spark, sf):
    p, key = table(spark, sf, "part"), F.col("p_partkey")
    part = lambda v: F.replace("p_name", F.lit(" "), v)
    infix = F.when(key % 7 == 0, "_Impact_").when(key % 7 == 1, "_governance_").otherwise("_")
    docs = p.select(F.concat(part(infix), F.lit("_"), (key % 20).cast("string"), F.when(key % 3 == 0, "_pdf").when(key % 3 == 1, "_XML").otherwise("_json")).alias("doc"))
    word, first = F.split_part("p_name", F.lit(" "), F.lit(2)), F.left("p_type", F.lit(1))
    hints = p.select(F.concat(word, F.lit("-"), "p_type").alias("logical"),
                     F.when(key % 2 == 0, F.upper(F.substring(word, 2, 1000))).otherwise(F.substring(part(F.lit("_")), 2, 6)).alias("hint"),
                     F.when(first == "E", "sustainability_report").when(first == "S", "governance_report").when(first == "P", "dart_filing").alias("kind"))
    return M.matching_documents(docs, "doc", hints, "logical", "hint", "kind")


@query("logical_documents", f"WITH {LOGICAL} SELECT logical, doc, score FROM s WHERE score >= 1")
def logical_documents(spark, sf):
    """Every document id that contains a hint of a logical document, scored by the hint and the wanted kind."""
    return logical_matches(spark, sf)


@query("logical_document_best", f"WITH {LOGICAL} SELECT logical, doc, score FROM (SELECT *, row_number() OVER (PARTITION BY logical ORDER BY score DESC, doc) AS r FROM s WHERE score >= 1) WHERE r = 1")
def logical_document_best(spark, sf):
    return M.best_document(logical_matches(spark, sf), "doc", "logical")
