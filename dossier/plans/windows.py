"""Dedupe, top-k, caps, selection and set queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from dossier.functions import text as T
from dossier.operators import bounds as B, select as S
from dossier.plans.base import WS, query, sql_pad, table
from dossier.plans.evaluation import RUNS, runs

NORM = rf"md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g'), {WS})))"
CFP = r"array_to_string(list_concat(list_slice(regexp_extract_all(lower(text), '([a-z]{5,})', 1), 1, 6), list_slice(regexp_extract_all(text, '(\d+(?:\.\d+)?)', 1), 1, 5)), '|')"


def docs(spark, sf):
    return table(spark, sf, "documents")


def fp_docs(spark, sf):
    return docs(spark, sf).select("doc_id", "lang", "source", "n_chars", T.text_fingerprint(F.col("text")).alias("fp"))


@query("dup_exact", "SELECT text_md5, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT md5(text) AS text_md5, doc_id FROM documents) GROUP BY text_md5 HAVING count(*) > 1")
def dup_exact(spark, sf):
    return docs(spark, sf).groupBy(F.md5("text").alias("text_md5")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


@query("dup_prefix", """WITH p AS (SELECT lower(substr(trim(text), 1, 55)) AS prefix, md5(text) AS m FROM documents), g AS (SELECT prefix, count(*) AS n, count(DISTINCT m) AS n_texts FROM p GROUP BY prefix)
SELECT md5(prefix) AS prefix_md5, n, n_texts FROM g WHERE n > 1""")
def dup_prefix(spark, sf):
    """Near copies by a common beginning; counts only, so a hot prefix costs one row per task."""
    p = docs(spark, sf).select(F.lower(F.substring(F.trim("text"), 1, 55)).alias("prefix"), F.md5("text").alias("m"))
    g = p.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("m").alias("n_texts"))
    return g.filter("n > 1").select(F.md5("prefix").alias("prefix_md5"), "n", "n_texts")


@query("best_per_fingerprint", f"""WITH d AS (SELECT doc_id, n_chars, {NORM} AS fp FROM documents) SELECT fp, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY n_chars DESC, doc_id) AS r FROM d WHERE n_chars >= 100) WHERE r = 1""")
def best_per_fingerprint(spark, sf):
    return B.best_per_key(fp_docs(spark, sf).filter("n_chars >= 100"), ["fp"], [F.col("n_chars").desc(), F.col("doc_id")]).select("fp", "doc_id", "n_chars")


@query("cluster_anchor", f"""WITH d AS (SELECT doc_id, lang, n_chars, {CFP} AS fp FROM documents) SELECT doc_id, first_value(doc_id) OVER (PARTITION BY lang, fp ORDER BY n_chars DESC, doc_id) AS anchor_id,
 count(*) OVER (PARTITION BY lang, fp) AS group_size, CASE WHEN doc_id = first_value(doc_id) OVER (PARTITION BY lang, fp ORDER BY n_chars DESC, doc_id) THEN 'anchor' ELSE 'collapsed_variant' END AS action FROM d""")
def cluster_anchor(spark, sf):
    d = docs(spark, sf).select("doc_id", "lang", "n_chars", T.cluster_fingerprint(F.col("text")).alias("fp"))
    return S.collapse_clusters(d, ["lang", "fp"], F.col("n_chars"), "doc_id").select("doc_id", "anchor_id", "group_size", "action")


@query("cluster_anchor_salted", f"""WITH d AS (SELECT doc_id, lang, n_chars FROM documents) SELECT doc_id, first_value(doc_id) OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS anchor_id FROM d""")
def cluster_anchor_salted(spark, sf):
    """The same join with every group above the hot threshold."""
    d = docs(spark, sf).select("doc_id", "lang", "n_chars")
    a = S.group_anchor(d, ["lang"], F.col("n_chars"), "doc_id")
    return B.salted_join(d, a, ["lang"], F.col("doc_id"), "inner", threshold=50, salts=8).select("doc_id", "anchor_id")


@query("distinct_fact_dedupe", """WITH d AS (SELECT doc_id, n_chars, lower(trim(text)) AS q, source AS fact FROM documents), g AS (SELECT q, count(DISTINCT fact) AS f FROM d GROUP BY q)
SELECT doc_id FROM (SELECT d.*, f, row_number() OVER (PARTITION BY d.q ORDER BY n_chars DESC, doc_id) AS r FROM d JOIN g ON d.q = g.q) WHERE f > 1 OR r = 1""")
def distinct_fact_dedupe(spark, sf):
    d = docs(spark, sf).select("doc_id", "n_chars", F.lower(F.trim("text")).alias("q"), F.col("source").alias("fact"))
    return S.dedupe_distinct_facts(d, "q", "fact", "n_chars", "doc_id").select("doc_id")


@query("per_document_cap", """SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 7""")
def per_document_cap(spark, sf):
    return B.top_k(docs(spark, sf).select("source", "doc_id"), ["source"], [F.col("doc_id")], 7, "r").select("source", "doc_id")


@query("template_caps", """WITH a AS (SELECT * FROM (SELECT doc_id, lang, source, n_chars, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 9),
b AS (SELECT * FROM (SELECT doc_id, lang, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM a) WHERE r <= 14)
SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r2 FROM b) WHERE r2 <= 60""")
def template_caps(spark, sf):
    return S.cap_chain(docs(spark, sf).select("doc_id", "lang", "source", "n_chars"), [(["lang", "source"], 9), (["source"], 14), (["lang"], 60)], "n_chars", "doc_id").select("doc_id")


@query("round_robin", f"""WITH d AS (SELECT doc_id, lang, n_chars, {NORM} AS fp FROM documents), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY n_chars DESC, doc_id) AS r FROM d) WHERE r = 1),
t AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS turn FROM o) SELECT doc_id, lang, turn FROM t ORDER BY turn, lang LIMIT 90""")
def round_robin(spark, sf):
    return S.balanced(fp_docs(spark, sf), ["fp"], "lang", "n_chars", "doc_id", 90).select("doc_id", "lang", F.col("turn").cast("long").alias("turn"))


TAGS_SQL = """list_filter([CASE WHEN contains(text, 'the ') THEN 'the' END, CASE WHEN contains(text, '|') THEN 'table' END, CASE WHEN regexp_matches(text, '[0-9]{4}') THEN 'number' END, CASE WHEN contains(text, 'licensed') THEN 'license' END, CASE WHEN contains(text, '@') THEN 'mail' END, CASE WHEN contains(text, '%%%') THEN 'junk' END], lambda x: x IS NOT NULL)"""


@query("greedy_cover", f"""WITH d AS (SELECT doc_id, lang, n_chars, doc_id % 3 = 0 AS p, {TAGS_SQL} AS tags FROM documents), t AS (SELECT lang, doc_id, p, n_chars, unnest(tags) AS tag FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, tag, p ORDER BY n_chars DESC, doc_id) AS rp, row_number() OVER (PARTITION BY lang, tag ORDER BY n_chars DESC, doc_id) AS ra, bool_or(p) OVER (PARTITION BY lang, tag) AS hasp FROM t),
f AS (SELECT doc_id, min(CASE WHEN p AND rp = 1 THEN 1 WHEN NOT hasp AND ra = 1 THEN 2 ELSE 3 END) AS ph FROM r GROUP BY ALL),
x AS (SELECT d.*, CASE WHEN len(tags) = 0 AND p THEN 1 WHEN len(tags) = 0 THEN 2 ELSE ph END AS phase FROM d LEFT JOIN f USING (doc_id))
SELECT lang, doc_id, phase, pick FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY phase, n_chars DESC, doc_id) AS pick FROM x) WHERE pick <= 30""")
def greedy_cover(spark, sf):
    from dossier.functions.rules import issue_array
    t = F.col("text")
    d = docs(spark, sf).select("doc_id", "lang", "n_chars", issue_array([
        (t.contains("the "), "the"), (t.contains("|"), "table"), (t.rlike("[0-9]{4}"), "number"), (t.contains("licensed"), "license"),
        (t.contains("@"), "mail"), (t.contains("%%%"), "junk")]).alias("tags"))
    return S.covering(d, "lang", "tags", F.col("doc_id") % 3 == 0, "n_chars", "doc_id", 30).select(
        "lang", "doc_id", F.col("phase").cast("long").alias("phase"), F.col("pick").cast("long").alias("pick"))


@query("batch_duplicates", f"""SELECT doc_id, count(*) OVER (PARTITION BY {NORM}) > 1 AS is_duplicate FROM documents""")
def batch_duplicates(spark, sf):
    return S.duplicate_flags(fp_docs(spark, sf).select("doc_id", "fp"), ["fp"], "doc_id").select("doc_id", "is_duplicate")


@query("first_seen", f"""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {NORM} ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def first_seen(spark, sf):
    return S.first_seen(fp_docs(spark, sf), ["fp"], "doc_id").select("doc_id")


@query("hash_sample", """SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS r, count(*) OVER () AS n FROM documents) WHERE r <= greatest(1, CAST(floor(n * 0.2) AS BIGINT))""")
def hash_sample(spark, sf):
    return S.hash_share(docs(spark, sf).select("doc_id"), "doc_id", 0.2).select("doc_id")


@query("seeded_subset", """SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5('seed7' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS r, count(*) OVER () AS n FROM orders) WHERE r <= CAST(floor(n * 0.3) AS BIGINT)""")
def seeded_subset(spark, sf):
    return S.hash_share(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.3, "seed7").select("o_orderkey")


@query("sequence_ids", f"""SELECT doc_id, 'S-' || lang || '-' || {sql_pad('n', 4)} AS seq_id FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents)""")
def sequence_ids(spark, sf):
    return S.sequence_ids(docs(spark, sf).select("doc_id", "lang"), ["lang"], "doc_id", F.concat(F.lit("S-"), "lang")).select("doc_id", "seq_id")


@query("sequence_ids_pieces", """SELECT l_orderkey, l_linenumber, l_partkey, n FROM (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem)""")
def sequence_ids_pieces(spark, sf):
    """Three groups hold all order lines: numbered in pieces, offsets added."""
    li = table(spark, sf, "lineitem")
    o = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")]
    return B.number_rows(li, ["l_returnflag"], o, F.col("l_orderkey"), "n", target_rows=5000).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("n").cast("long").alias("n"))


@query("notable_cases", """SELECT doc_id, CASE WHEN quality = 0 THEN 'fail' ELSE 'partial' END AS overall FROM labels WHERE quality = 0 OR toxic = 1 ORDER BY quality = 1, doc_id LIMIT 10""")
def notable_cases(spark, sf):
    q = F.col("quality")
    return table(spark, sf, "labels").filter((q == 0) | (F.col("toxic") == 1)).orderBy((q == 1), "doc_id").limit(10).select(
        "doc_id", F.when(q == 0, "fail").otherwise("partial").alias("overall"))


@query("best_mode", """SELECT arg_max(mode, s) AS best_mode FROM (SELECT event_type AS mode, 2 * avg(CAST(user_id < 30 AS INT)) + avg(CAST(value > 20 AS INT)) + 0.5 * avg(CAST(value > 40 AS INT)) AS s FROM events GROUP BY ALL)""")
def best_mode(spark, sf):
    a = lambda c: F.avg(c.cast("int"))
    g = table(spark, sf, "events").groupBy(F.col("event_type").alias("mode")).agg(
        (2 * a(F.col("user_id") < 30) + a(F.col("value") > 20) + 0.5 * a(F.col("value") > 40)).alias("s"))
    return g.agg(F.max_by("mode", "s").alias("best_mode"))


@query("next_phase_configs", f"""WITH {RUNS}, t AS (SELECT config_id FROM r WHERE ok ORDER BY hit DESC, config_id LIMIT 5) SELECT config_id, unnest(['none', 'rerank']) AS reranker FROM t""")
def next_phase_configs(spark, sf):
    t = runs(spark, sf).filter("ok").orderBy(F.col("hit").desc(), "config_id").limit(5)
    return t.select("config_id", F.explode(F.array(F.lit("none"), F.lit("rerank"))).alias("reranker"))


@query("curated_subset", """SELECT item_id, d.doc_id, row_number() OVER (ORDER BY item_id) AS pick FROM benchmark b JOIN documents d ON d.doc_id = b.item_id * 3 WHERE d.lang = 'en' QUALIFY pick <= 8""")
def curated_subset(spark, sf):
    """Ids listed by position, one mode, the first eight."""
    ids = table(spark, sf, "benchmark").select("item_id", (F.col("item_id") * 3).alias("doc_id"))
    j = docs(spark, sf).filter("lang = 'en'").select("doc_id").join(ids, "doc_id").withColumn("_all", F.lit(1))
    return B.top_k(j, ["_all"], [F.col("item_id")], 8, "pick").select("item_id", "doc_id", F.col("pick").cast("long").alias("pick"))


@query("answerable_first", """SELECT lang, doc_id FROM (SELECT d.lang, d.doc_id, row_number() OVER (PARTITION BY d.lang ORDER BY coalesce(quality, 0) DESC, md5(CAST(d.doc_id AS VARCHAR))) AS r FROM documents d LEFT JOIN labels l USING (doc_id)) WHERE r <= 100""")
def answerable_first(spark, sf):
    j = docs(spark, sf).select("lang", "doc_id").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return B.top_k(j, ["lang"], [F.coalesce("quality", F.lit(0)).desc(), F.md5(F.col("doc_id").cast("string"))], 100, "r").select("lang", "doc_id")


@query("gap_actions", """WITH u AS (SELECT c_custkey, 0 AS o, 'risk' AS why FROM customer WHERE c_acctbal < -900 UNION ALL SELECT o_custkey, 1, 'conflict' FROM orders WHERE o_totalprice > 499000 UNION ALL SELECT c_custkey, 2, 'missing' FROM customer WHERE c_acctbal < 0),
b AS (SELECT c_custkey, min(o) AS o, arg_min(why, o) AS why FROM u GROUP BY ALL) SELECT c_custkey, why FROM b ORDER BY o, c_custkey LIMIT 10""")
def gap_actions(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return S.action_list([(c.filter("c_acctbal < -900"), "risk"), (o.filter("o_totalprice > 499000").withColumnRenamed("o_custkey", "c_custkey"), "conflict"),
                          (c.filter("c_acctbal < 0"), "missing")], "c_custkey", 10)


# ---- sets -----------------------------------------------------------------------
@query("pool_union", """WITH u AS (SELECT doc_id, 'en' AS tag FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 'long' FROM documents WHERE n_chars > 2000 UNION ALL SELECT doc_id, 'src1' FROM documents WHERE source = 'src1' UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id % 3 = 0)
SELECT doc_id, coalesce(string_agg(DISTINCT tag, ',' ORDER BY tag), '') AS tags FROM u GROUP BY doc_id""")
def pool_union(spark, sf):
    d = docs(spark, sf).select("doc_id", "lang", "source", "n_chars")
    p = [d.filter(c).withColumn("tags", F.array(F.lit(t))) for c, t in (("lang = 'en'", "en"), ("n_chars > 2000", "long"), ("source = 'src1'", "src1"))]
    p.append(d.filter("doc_id % 3 = 0").withColumn("tags", F.array().cast("array<string>")))  # a pool that tags nothing
    return S.merge_tagged(p, "doc_id", "tags").select("doc_id", F.array_join("tags", ",").alias("tags"))


@query("pool_build", f"""WITH u AS (SELECT {NORM} AS fp, doc_id, 0 AS s FROM documents WHERE n_chars > 2000 UNION ALL SELECT {NORM}, doc_id, 1 FROM documents WHERE lang = 'en' UNION ALL SELECT {NORM}, doc_id, 2 FROM documents)
SELECT fp, doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY s, doc_id) AS r FROM u) WHERE r = 1""")
def pool_build(spark, sf):
    d = fp_docs(spark, sf)
    return S.prefer_earlier([d.filter("n_chars > 2000"), d.filter("lang = 'en'"), d], ["fp"], "doc_id").select("fp", "doc_id", F.col("_src").cast("long").alias("s"))


@query("selection_diff", """SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'kept' END AS change
FROM (SELECT doc_id FROM documents WHERE lang = 'en') a FULL JOIN (SELECT doc_id FROM documents WHERE n_chars > 1000) b ON a.doc_id = b.doc_id""")
def selection_diff(spark, sf):
    d = docs(spark, sf)
    return S.selection_diff(d.filter("lang = 'en'"), d.filter("n_chars > 1000"), "doc_id")


@query("agreeing_values", """WITH d AS (SELECT DISTINCT l_partkey, l_quantity, l_suppkey FROM lineitem), g AS (SELECT l_partkey, l_quantity, count(*) AS n_docs, min(l_suppkey) AS first_doc FROM d GROUP BY ALL)
SELECT *, n_docs * (n_docs - 1) // 2 AS n_pairs FROM g WHERE n_docs >= 2""")
def agreeing_values(spark, sf):
    return S.agreeing_values(table(spark, sf, "lineitem"), "l_partkey", "l_quantity", "l_suppkey")


@query("delete_by_source", "SELECT (SELECT count(*) FROM documents WHERE source = 'src3') AS removed, (SELECT count(*) FROM documents WHERE source <> 'src3') AS kept")
def delete_by_source(spark, sf):
    rest, removed = S.delete_source(docs(spark, sf).select("doc_id", "source"), "source", "src3")
    return removed.withColumn("kept", rest.agg(F.count(F.lit(1))).scalar())


@query("replace_slice", """SELECT doc_id, lang, source, NULL::BIGINT AS extra FROM documents WHERE NOT (lang = 'fr' AND source IN (SELECT source FROM documents WHERE lang = 'fr' AND n_chars > 9000))
UNION ALL SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'fr' AND n_chars > 9000""")
def replace_slice(spark, sf):
    d = docs(spark, sf)
    new = d.filter("lang = 'fr' AND n_chars > 9000").select("doc_id", "lang", "source", F.col("n_chars").alias("extra"))
    return S.replace_slice(d.select("doc_id", "lang", "source"), new, ["lang", "source"])


@query("keyed_overlay", """WITH u AS (SELECT user_id, event_type, value, 0 AS s FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, event_type, value, 1 FROM events WHERE event_type = 'click'), g AS (SELECT user_id, max(s) AS s FROM u WHERE value > 1 GROUP BY ALL)
SELECT user_id, CASE WHEN s = 1 THEN 'click' ELSE 'view' END AS event_type FROM g""")
def keyed_overlay(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "value")
    return S.overlay([e.filter("event_type = 'view'"), e.filter("event_type = 'click'")], ["user_id"], F.col("value") > 1).select("user_id", "event_type")


@query("source_summary", "SELECT source, count(*) AS chunks, min(doc_id) AS first_doc FROM documents GROUP BY source")
def source_summary(spark, sf):
    return docs(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.min("doc_id").alias("first_doc"))


@query("ingest_report", """WITH c AS (SELECT source, count(*) AS n FROM documents WHERE n_chars >= 300 GROUP BY ALL), f AS (SELECT DISTINCT source FROM documents)
SELECT f.source, coalesce(n, 0) AS chunks, CASE WHEN n IS NULL THEN 'empty' ELSE 'ok' END AS status FROM f LEFT JOIN c USING (source)""")
def ingest_report(spark, sf):
    d = docs(spark, sf)
    g = d.groupBy("source").agg(F.count_if(F.col("n_chars") >= 300).alias("chunks"))
    return g.withColumn("status", F.when(F.col("chunks") == 0, "empty").otherwise("ok"))
