"""Extraction queries: tables, records, resolution across documents, field schemas."""
from __future__ import annotations

from pyspark.sql import functions as F

from dossier.functions import numbers as N
from dossier.operators.bounds import ordered_sum, spread
from dossier.operators import chunking as C, classify as CL, extraction as X
from dossier.plans.base import WS, query, sql_tokens, table
from dossier.plans.ranking import BM, TEXT_SQL, hits, items, rk, with_text


@query("row_match", r"""WITH p AS (SELECT p_partkey, lower(p_name) AS label, split_part(lower(p_name), ' ', 2) AS item, lower(p_type) AS sub FROM part),
x AS (SELECT *, CASE p_partkey % 5 WHEN 0 THEN label WHEN 1 THEN item WHEN 2 THEN 'zzz ' || sub WHEN 3 THEN 'other ' || substr(item, 1, 2) || ' thing' ELSE 'gadget list' END AS l FROM p)
SELECT p_partkey, CASE WHEN item = l THEN 1.0::DOUBLE WHEN sub = l OR contains(l, sub) OR contains(sub, l) THEN 0.92 WHEN contains(l, item) THEN 0.88 WHEN item = 'widget' AND contains(l, 'gadget') THEN 0.85 ELSE 0.0 END AS score FROM x""")
def row_match(spark, sf):
    p = table(spark, sf, "part")
    item, sub = F.split_part("p_name", F.lit(" "), F.lit(2)), F.col("p_type")
    k = F.col("p_partkey") % 5
    label = F.when(k == 0, F.col("p_name")).when(k == 1, item).when(k == 2, F.concat(F.lit("zzz "), sub)).when(
        k == 3, F.concat(F.lit("other "), F.substring(item, 1, 2), F.lit(" thing"))).otherwise("gadget list")
    ph = X.alias_phrases(item, sub, F.lit(None).cast("string"), item, [("widget", ["gadget"])])
    return p.select("p_partkey", X.row_match(label, item, sub, ph, F.array().cast("array<string>"), F.concat_ws(" ", item, sub)).alias("m")).select(
        "p_partkey", F.round("m.score", 6).alias("score"))


@query("row_match_overlap", rf"""WITH b AS (SELECT item_id, list_filter(list_distinct({sql_tokens('text')}), lambda t: t NOT IN ('the', 'of', 'and', 'total', 'number', 'rate', 'ratio', 'amount') AND length(t) >= 2) AS q, {sql_tokens('text')} AS lt FROM benchmark),
l AS (SELECT item_id, q, list_filter(list_distinct(list_append(lt, 'zq')), lambda t: t NOT IN ('the', 'of', 'and', 'total', 'number', 'rate', 'ratio', 'amount') AND length(t) >= 2) AS t FROM b),
s AS (SELECT item_id, len(q) AS nq, len(list_intersect(q, t)) AS c, len(t) - len(list_intersect(q, t)) AS x FROM l), o AS (SELECT *, greatest(0.0::DOUBLE, c / greatest(1, nq) - 0.15 * x) AS ov FROM s)
SELECT item_id, round(CASE WHEN nq = 0 OR c = 0 THEN 0 WHEN ov < 0.35 THEN ov ELSE least(0.75, ov) END, 6) AS score, CASE WHEN nq = 0 THEN 'no_specific_query_tokens' WHEN c = 0 THEN 'no_specific_overlap' WHEN ov < 0.35 THEN 'token_overlap_weak' ELSE 'token_overlap' END AS reason,
 (x > 0 OR (nq > 0 AND c > 0 AND ov < 0.35)) AS risk FROM o""")
def row_match_overlap(spark, sf):
    from dossier.functions.text import tokenize
    b = table(spark, sf, "benchmark")
    label = F.concat_ws(" ", tokenize(F.col("text")), F.lit("zq"))
    e, n = F.array().cast("array<string>"), F.lit("")
    m = b.select("item_id", "text", label.alias("label")).withColumn("m", X.row_match(F.col("label"), n, n, e, e, F.col("text")))
    return m.select("item_id", F.round("m.score", 6).alias("score"), "m.reason",
                    X.wrong_row_risk(F.col("m.score"), F.col("m.reason"), F.col("label"), F.col("text")).alias("risk"))


NO_LABEL = "\u2205"  # a text table has no null; read back as one


def order_tables(spark, sf):
    """One pipe table per customer: a row per priority, a column per year; a dash for a sum of nulls, and for 1998 without orders."""
    v = ordered_sum(table(spark, sf, "orders").withColumn("y", F.year("o_orderdate")), ["o_custkey", "o_orderpriority", "y"], "o_totalprice", "o_orderkey", "v")
    cell = F.when(F.col("v").isNull(), "-").otherwise(F.format_string("%,d", F.round("v").cast("long")))
    year = lambda y: F.max(F.when(F.col("y") == y, cell))
    o = v.groupBy("o_custkey", "o_orderpriority").agg(
        F.coalesce(year(1996), F.lit("not disclosed")).alias("c1"), F.coalesce(year(1997), F.lit("not disclosed")).alias("c2"),
        F.coalesce(year(1998), F.when(F.max("y").isNull(), "not disclosed").otherwise("-")).alias("c3"))
    ln = F.concat(F.lit("| "), F.concat_ws(" | ", F.coalesce("o_orderpriority", F.lit(NO_LABEL)), "c1", "c2", "c3", F.lit("million")), F.lit(" |"))
    d = o.select("o_custkey", ln.alias("ln")).groupBy("o_custkey").agg(F.array_sort(F.collect_list("ln")).alias("lns"))
    return d.select("o_custkey", F.concat(F.lit("Intro line.\n| metric | 2016 | 2017 | 2018 | unit |\n| --- | --- |\n"), F.array_join("lns", "\n"), F.lit("\nend")).alias("text"))


@query("table_candidates", """WITH t AS (SELECT o_custkey, o_orderpriority AS label, year(o_orderdate) + 20 AS year, round(sum(o_totalprice)) AS v FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 GROUP BY ALL)
SELECT o_custkey, label, year, CAST(v AS BIGINT) AS value, 'USD million' AS unit FROM t
UNION ALL SELECT o_custkey, o_orderpriority, 2018, NULL, 'USD million' FROM orders GROUP BY o_custkey, o_orderpriority HAVING count_if(year(o_orderdate) = 1998) = 0""")
def table_candidates(spark, sf):
    """Year columns read back; undisclosed cells stay out, a dash stays in as text."""
    c = X.table_candidates(order_tables(spark, sf), ["o_custkey"], "text")
    return c.select("o_custkey", F.nullif("label", F.lit(NO_LABEL)).alias("label"), F.col("year").cast("long").alias("year"), F.col("normalized").try_cast("long").alias("value"),
                    F.col("normalized_unit").alias("unit"))


@query("table_units", """SELECT doc_id, length(text) - length(replace(text, '|', '')) >= 8 AS is_table FROM documents WHERE contains(text, '|')""")
def table_units(spark, sf):
    return table(spark, sf, "documents").filter(F.col("text").contains("|")).select("doc_id", (F.regexp_count("text", F.lit(r"\|")) >= 8).alias("is_table"))


@query("document_tables", rf"""WITH l AS (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda s: contains(s, '|'))) AS s FROM documents WHERE contains(text, '|')),
c AS (SELECT doc_id, string_split(regexp_replace(trim('| ' || s, {WS}), '^\|+|\|+$', '', 'g'), '|') AS cs FROM l)
SELECT doc_id, trim(cs[1], {WS}) AS label, len(cs) AS n_cells FROM c WHERE len(cs) >= 2""")
def document_tables(spark, sf):
    """Lines of the documents that hold pipes, framed as table rows."""
    d = table(spark, sf, "documents").filter(F.col("text").contains("|")).select("doc_id", F.concat(
        F.lit("| a | b |\n| --- |\n"), F.array_join(F.transform(F.filter(F.split("text", "\n"), lambda s: s.contains("|")), lambda s: F.concat(F.lit("| "), s)), "\n")).alias("text"))
    return d.select("doc_id", F.explode(C.table_rows(F.col("text"))).alias("r")).select("doc_id", F.get("r.cells", F.lit(0)).alias("label"), F.size("r.cells").alias("n_cells"))


@query("narrative_candidates", r"""WITH o AS (SELECT doc_id, unnest(ms) AS m, list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(list_slice(ps, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(ms, 1, i - 1), lambda x: length(x))), 0)) AS ats, text, generate_subscripts(ms, 1) AS k FROM (SELECT *, regexp_extract_all(text, 'token = "[0-9a-f]{6,}') AS ms, regexp_split_to_array(text, 'token = "[0-9a-f]{6,}') AS ps FROM documents WHERE regexp_matches(text, 'token = "[0-9a-f]{6,}'))), m AS (SELECT doc_id, m, substr(text, CAST(greatest(ats[k] - 40, 0) + 1 AS BIGINT), CAST(length(m) + least(ats[k], 40) + 40 AS BIGINT)) AS snippet FROM o)
SELECT doc_id, count(*) AS n, min(regexp_extract(m, 'token = "([0-9a-f]{6,})', 1)) AS first_value, min(md5(snippet)) AS snippet_md5 FROM m GROUP BY doc_id""")
def narrative_candidates(spark, sf):
    c = X.narrative_candidates(table(spark, sf, "documents"), ["doc_id"], "text", [("token", r'token = "([0-9a-f]{6,})')])
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("first_value"), F.min(F.md5("snippet")).alias("snippet_md5"))


@query("concept_candidates", r"""SELECT doc_id, unnest(list_filter([CASE WHEN regexp_matches(text, '(?i)licensed') THEN 'license' END, CASE WHEN regexp_matches(text, '(?i)token =') THEN 'secret' END, CASE WHEN contains(text, '@') THEN 'mail' END], lambda x: x IS NOT NULL)) AS value FROM documents""")
def concept_candidates(spark, sf):
    return X.concept_candidates(table(spark, sf, "documents"), ["doc_id"], "text", [("licensed", "license"), ("token =", "secret"), ("@", "mail")]).select("doc_id", "value")


@query("text_occurrences", r"""WITH o AS (SELECT doc_id, lang, unnest(ms) AS m, list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(list_slice(ps, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(ms, 1, i - 1), lambda x: length(x))), 0)) AS ats, text, generate_subscripts(ms, 1) AS k FROM (SELECT *, regexp_extract_all(text, 'licensed under') AS ms, regexp_split_to_array(text, 'licensed under') AS ps FROM documents WHERE regexp_matches(text, 'licensed under'))), m AS (SELECT doc_id, lang, substr(text, CAST(greatest(ats[k] - 80, 0) + 1 AS BIGINT), CAST(length(m) + least(ats[k], 80) + 80 AS BIGINT)) AS snippet FROM o)
SELECT lang, count(*) AS n, count(DISTINCT doc_id) AS docs, min(md5(snippet)) AS lo, max(md5(snippet)) AS hi FROM m GROUP BY lang""")
def text_occurrences(spark, sf):
    o = X.text_occurrences(table(spark, sf, "documents"), ["doc_id", "lang"], "text", "licensed under")
    return o.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"), F.min(F.md5("snippet")).alias("lo"), F.max(F.md5("snippet")).alias("hi"))


CAND = """c AS (SELECT l_partkey AS item, l_suppkey AS doc, l_orderkey * 10 + l_linenumber AS ord, round(l_extendedprice, 2) AS v, year(l_shipdate) AS y, l_discount * 10 AS s, l_returnflag = 'A' AS p FROM lineitem)"""


def candidates(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("doc"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
        F.round("l_extendedprice", 2).alias("v"), F.year("l_shipdate").alias("y"), (F.col("l_discount") * 10).alias("s"), (F.col("l_returnflag") == "A").alias("p"))


@query("best_per_document", f"""WITH {CAND} SELECT item, doc, v FROM (SELECT *, row_number() OVER (PARTITION BY item, doc ORDER BY s DESC, ord, v) AS r FROM c) WHERE r = 1""")
def best_per_document(spark, sf):
    from dossier.operators.bounds import best_per_key
    return best_per_key(candidates(spark, sf), ["item", "doc"], [F.col("s").desc(), F.col("ord"), F.col("v")]).select("item", "doc", "v")


@query("single_source_pick", f"""WITH {CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY p DESC, s DESC, y DESC, ord * 1000000 + v) AS r FROM c)
SELECT item, arg_min(v, r) AS value, round(arg_min(s, r), 6) AS best_score FROM r WHERE r <= 5 GROUP BY item""")
def single_source_pick(spark, sf):
    c = candidates(spark, sf).withColumnRenamed("v", "value").withColumn("o2", F.col("ord") * 1000000 + F.col("value"))
    return X.pick_single_source(c, "item", F.col("p"), "s", "y", "o2").select("item", "value", F.round("best_score", 6).alias("best_score"))


AGREE = "(abs(v - rv) / greatest(abs(v), abs(rv), 1) <= 0.05 OR abs(v * 1000 - rv) / greatest(abs(rv), 1) <= 0.05 OR abs(rv * 1000 - v) / greatest(abs(v), 1) <= 0.05)"


@query("resolve_candidates", f"""WITH {CAND}, f AS (SELECT * FROM (SELECT *, max(y) OVER (PARTITION BY item) AS my FROM c) WHERE y = my),
b AS (SELECT item, v AS rv, doc AS rd, p AS bp FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY p DESC, s DESC, ord * 1000000 + v) AS r FROM f) WHERE r = 1),
j AS (SELECT f.*, rv, rd, bp, {AGREE} AS same FROM f JOIN b USING (item))
SELECT item, rv AS resolved_value, rd AS resolved_doc, count_if(NOT same AND NOT (bp AND p)) AS n_conflicts, count(DISTINCT CASE WHEN same THEN doc END) AS n_confirming, count(DISTINCT doc) AS n_docs FROM j GROUP BY ALL""")
def resolve_candidates(spark, sf):
    c = candidates(spark, sf).withColumn("o2", F.col("ord") * 1000000 + F.col("v"))
    return X.resolve_numeric(c, "item", "doc", "v", "y", "s", F.col("p"), "o2", tol=0.05).drop("by_primary")


@query("resolve_text_values", f"""WITH c AS (SELECT doc_id, source AS item, lang AS doc, n_chars AS s, lang = 'en' AS p, CASE WHEN n_chars < 400 THEN 'Not disclosed' ELSE CAST(n_chars // 500 AS VARCHAR) || ',000 people' END AS v FROM documents),
f AS (SELECT *, TRY_CAST(regexp_extract(replace(replace(v, ',', ''), ' ', ''), '[0-9]+') AS DOUBLE) AS x FROM c WHERE NOT regexp_matches(v, '(?i)not disclosed')),
b AS (SELECT item, v AS rv, x AS rx, doc AS rd, p AS bp FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY p DESC, s DESC, doc_id) AS r FROM f) WHERE r = 1),
j AS (SELECT f.*, rv, rd, bp, (x = rx OR abs(x - rx) / greatest(x, rx, 1) <= 0.001 OR abs(x * 1000 - rx) / greatest(rx, 1) <= 0.001 OR abs(rx * 1000 - x) / greatest(x, 1) <= 0.001) AS same FROM f JOIN b USING (item))
SELECT item, rv AS resolved_value, rd AS resolved_doc, count_if(NOT same AND ((bp AND NOT p) OR NOT bp)) AS n_conflicts, count(DISTINCT CASE WHEN same THEN doc END) AS n_confirming FROM j GROUP BY ALL""")
def resolve_text_values(spark, sf):
    c = text_candidates(spark, sf)
    return X.resolve(c, "item", "doc", "v", "y", "s", F.col("p"), "doc_id").select("item", "resolved_value", "resolved_doc", "n_conflicts", "n_confirming")


def text_candidates(spark, sf):
    n = F.col("n_chars")
    return table(spark, sf, "documents").select("doc_id", F.col("source").alias("item"), F.col("lang").alias("doc"), n.alias("s"), (F.col("lang") == "en").alias("p"),
                                                F.lit(None).cast("int").alias("y"), F.when(n < 400, "Not disclosed").otherwise(
                                                    F.concat(F.floor(n / 500).cast("string"), F.lit(",000 people"))).alias("v"))


@query("confirming_documents", """WITH c AS (SELECT doc_id, source AS item, lang AS doc, n_chars AS s, lang = 'en' AS p, CAST(n_chars // 500 AS DOUBLE) * 1000 AS x FROM documents WHERE n_chars >= 400),
b AS (SELECT item, x AS rx FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY p DESC, s DESC, doc_id) AS r FROM c) WHERE r = 1)
SELECT DISTINCT item, doc FROM c JOIN b USING (item) WHERE x = rx OR abs(x - rx) / greatest(x, rx, 1) <= 0.001 OR abs(x * 1000 - rx) / greatest(rx, 1) <= 0.001 OR abs(rx * 1000 - x) / greatest(x, 1) <= 0.001""")
def confirming_documents(spark, sf):
    c = text_candidates(spark, sf)
    return X.confirming(c, X.resolve(c, "item", "doc", "v", "y", "s", F.col("p"), "doc_id"), "item", "doc", "v")


@query("structured_records", f"""WITH {CAND}, f AS (SELECT * FROM (SELECT *, max(y) OVER (PARTITION BY item) AS my FROM c) WHERE y = my),
b AS (SELECT item, v AS rv, p AS bp, s AS rs FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY p DESC, s DESC, ord * 1000000 + v) AS r FROM f) WHERE r = 1),
j AS (SELECT f.*, rv, bp, {AGREE} AS same FROM f JOIN b USING (item)),
g AS (SELECT item, rv, count_if(NOT same AND NOT (bp AND p)) AS nc, count(DISTINCT CASE WHEN same THEN doc END) AS ncf, count(DISTINCT doc) AS nd FROM j GROUP BY ALL),
s AS (SELECT *, CASE WHEN rv IS NULL THEN 'failed' WHEN nd = 1 THEN 'resolved_single_source_sufficient' ELSE 'resolved' END AS suff FROM g)
SELECT item, suff AS sufficiency, CASE WHEN nc > 0 THEN 'conflict_numeric' WHEN ncf >= 2 THEN 'multi_source_confirmed' WHEN suff = 'resolved_single_source_sufficient' THEN 'single_source_sufficient' WHEN nd >= 2 THEN 'multi_source_confirmed' ELSE 'single_source_sufficient' END AS conflict_status FROM s""")
def structured_records(spark, sf):
    """Resolved value -> sufficiency -> conflict status, one record per item."""
    c = candidates(spark, sf).withColumn("o2", F.col("ord") * 1000000 + F.col("v"))
    r = X.resolve_numeric(c, "item", "doc", "v", "y", "s", F.col("p"), "o2", tol=0.05)
    z = F.lit(0)
    st = F.when(F.col("n_conflicts") > 0, "resolved_with_preference_rule").otherwise("resolved")
    r = r.withColumn("sufficiency", X.sufficiency(F.col("resolved_value"), st, F.col("n_conflicts"), F.lit(True), F.col("n_docs"), z, z))
    return r.select("item", "sufficiency", CL.conflict_status(
        F.col("resolved_value").cast("string"), F.col("n_conflicts"), F.col("sufficiency"), F.col("n_confirming"), F.col("n_docs"), z, z,
        F.lit("cross_document_answer"), F.lit(False)).alias("conflict_status"))


@query("fusion_preview", """SELECT source AS item, 'item:' || source AS metric_group, count(DISTINCT lang) AS n_docs, count(DISTINCT n_chars // 500) AS n_values FROM documents WHERE doc_id % 2 = 0 GROUP BY source
UNION ALL SELECT source, lang || ' size', count(DISTINCT lang), count(DISTINCT n_chars // 500) FROM documents WHERE doc_id % 2 = 1 GROUP BY source, lang""")
def fusion_preview(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("item"), F.col("lang").alias("doc"), F.floor(F.col("n_chars") / 500).alias("value"),
                                             F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("total "), "source")).otherwise(F.concat("lang", F.lit(" size 2024"))).alias("label"))
    return X.fusion_preview(d, "item", "label", "doc")


@query("role_classes", """SELECT o_custkey, o_orderkey, CASE WHEN pos = 1 THEN 'required' WHEN o_orderpriority = '5-LOW' THEN 'optional' ELSE 'required' END AS role_class FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders)""")
def role_classes(spark, sf):
    from dossier.operators.bounds import number_rows
    o = number_rows(table(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderkey")], F.col("o_orderkey"), "pos")
    o = o.withColumn("desc", F.when(F.col("o_orderpriority") == "5-LOW", "Supporting context").otherwise("main"))
    return X.role_classes(o, "o_custkey", "o_orderkey", "pos", F.col("desc")).select("o_custkey", "o_orderkey", "role_class")


@query("sufficiency_ladder", """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'conflict_unresolved' WHEN o_orderkey % 7 = 0 THEN 'failed' WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 1 THEN 'resolved_single_source_sufficient' WHEN o_orderkey % 5 = 0 THEN 'partial_missing_numeric_role' WHEN o_orderkey % 4 = 0 THEN 'partial_metric_absent_in_role' ELSE 'resolved' END AS sufficiency
FROM orders""")
def sufficiency_ladder(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", X.sufficiency(
        F.when(k % 7 != 0, F.col("o_totalprice")), F.when(k % 11 == 0, "conflict_unresolved").otherwise("resolved"), F.lit(0), F.col("o_orderstatus") == "F",
        k % 3, F.when((k % 5 == 0) & ~((F.col("o_orderstatus") == "F") & (k % 3 == 1)), 1).otherwise(0), (k % 4 == 0).cast("int")).alias("sufficiency"))


@query("employee_answers", """WITH e AS (SELECT c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex, c_custkey % 50 + 1 AS total, c_custkey % 7 AS regular, (c_custkey % 90 + 10) * 1000 AS salary FROM customer)
SELECT c_nationkey, sum(total) AS headcount, round(100.0::DOUBLE * sum(total) FILTER (sex = 'F') / sum(total), 1) AS female_pct, round(100.0::DOUBLE * sum(regular) / sum(total), 1) AS regular_pct, round(sum(salary) / sum(total), 2) AS avg_pay,
 round(100.0::DOUBLE * (sum(salary) FILTER (sex = 'F') / sum(total) FILTER (sex = 'F')) / (sum(salary) FILTER (sex = 'M') / sum(total) FILTER (sex = 'M')), 1) AS pay_ratio_pct FROM e GROUP BY ALL""")
def employee_answers(spark, sf):
    """Customers as staff rows in `k=v` text, parsed and aggregated."""
    k = F.col("c_custkey")
    line = F.concat_ws(" | ", F.concat(F.lit("sex="), F.when(k % 2 == 0, "F").otherwise("M")), F.concat(F.lit("total="), (k % 50 + 1).cast("string")),
                       F.concat(F.lit("regular="), (k % 7).cast("string")), F.concat(F.lit("annual_salary="), F.format_string("%,d", (k % 90 + 10) * 1000)))
    e = table(spark, sf, "customer").select("c_nationkey", F.explode(X.records_of(F.concat(F.lit("- "), line))).alias("m")).select(
        "c_nationkey", F.col("m")["sex"].alias("sex"), *[N.to_int(F.col("m")[c]).alias(c) for c in ("total", "regular", "annual_salary")])
    return X.employee_answers(e, "c_nationkey", "sex", "total", "regular", "annual_salary")


@query("executive_answers", """SELECT s_nationkey, count(*) AS n, round(100.0::DOUBLE * avg(CAST(s_suppkey % 3 = 0 AS INT)), 1) AS female_pct, count_if(s_acctbal < 5000) AS outside, count_if(s_acctbal >= 5000) AS inside FROM supplier GROUP BY ALL""")
def executive_answers(spark, sf):
    s = table(spark, sf, "supplier").withColumn("sex", F.when(F.col("s_suppkey") % 3 == 0, "F").otherwise("M"))
    return X.executive_answers(s, "s_nationkey", "sex", F.col("s_acctbal") < 5000)


@query("financial_answers", """WITH c AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey * 1000000 + l_partkey) AS r FROM lineitem WHERE l_returnflag = 'R')
SELECT l_orderkey, CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) AS answer FROM c WHERE r = 1""")
def financial_answers(spark, sf):
    li = spread(table(spark, sf, "lineitem"))
    line = F.concat_ws(" | ", F.concat(F.lit("statement="), "l_linestatus"), F.concat(F.lit("account="), "l_returnflag"),
                       F.lit("term 3=1 KRW"), F.concat(F.lit("term 2="), F.format_string("%,d", F.floor("l_extendedprice")), F.lit(" KRW")))
    d = li.select("l_orderkey", F.col("l_linenumber").alias("rank"), (F.col("l_suppkey") * 1000000 + F.col("l_partkey")).alias("pos"), line.alias("line"))
    return X.financial_answers(d, "l_orderkey", "rank", "pos", F.col("line"), F.lit(2023), F.lit(2024), F.lit("krw"), ["R"])


@query("sanction_answers", """SELECT page_id, CASE WHEN regexp_matches(html, 'no results|track\\(0\\)') THEN '0' ELSE regexp_extract(html, 'track\\((\\d+)\\)', 1) END AS answer, length(html) - length(replace(html, '<li>', '')) >= 32 AS list_page FROM pages""")
def sanction_answers(spark, sf):
    from dossier.functions.signals import empty_list_page
    h = F.col("html")
    return table(spark, sf, "pages").select("page_id", X.sanction_answer(h, r"no results|track\(0\)", r"track\((\d+)\)").alias("answer"),
                                            empty_list_page(h, zero="(?!x)x", none="(?!x)x", cell="<li>", min_cells=8).alias("list_page"))


@query("answer_dispatch", """SELECT doc_id, CASE WHEN contains(text, 'licensed') THEN 'GNU' WHEN regexp_matches(text, '[0-9]{4,}') THEN regexp_extract(text, '[0-9]{4,}') WHEN contains(text, '|') THEN 'table' END AS answer,
 CASE WHEN contains(text, 'licensed') THEN 'license' WHEN regexp_matches(text, '[0-9]{4,}') THEN 'number' WHEN contains(text, '|') THEN 'table' END AS reason FROM documents""")
def answer_dispatch(spark, sf):
    """Extractors in fixed order, the first result wins: a coalesce of columns."""
    t = F.col("text")
    a = X.first_answer([("license", F.when(t.contains("licensed"), F.lit("GNU"))), ("number", F.nullif(F.regexp_extract(t, "([0-9]{4,})", 1), F.lit(""))),
                        ("table", F.when(t.contains("|"), F.lit("table")))])
    return table(spark, sf, "documents").select("doc_id", a.alias("a")).select("doc_id", "a.answer", "a.reason")


@query("field_extraction", BM + rk() + f""", h AS (SELECT rk.query_id, rank, d.source = 'src1' AS pref, {TEXT_SQL} AS t FROM rk JOIN documents d USING (doc_id) WHERE rank <= 8),
f AS (SELECT query_id, rank, pref, 'the_word' AS field, regexp_extract(t, 'the ([a-z]{{4,}})', 1) AS value FROM h WHERE regexp_matches(t, 'the ([a-z]{{4,}})') UNION ALL SELECT query_id, rank, pref, 'first_cap', regexp_extract(t, '([A-Z][a-z]{{5,}})', 1) FROM h WHERE regexp_matches(t, '([A-Z][a-z]{{5,}})'))
SELECT query_id, field, arg_min(value, CASE WHEN pref THEN 0 ELSE 100 END + rank) AS value, count(DISTINCT value) > 1 AS conflict FROM f GROUP BY ALL""")
def field_extraction(spark, sf):
    h = with_text(spark, sf, hits(spark, sf, 8))
    schema = [{"field": "the_word", "pattern": "the ([a-z]{4,})", "type": "string"}, {"field": "first_cap", "pattern": "([A-Z][a-z]{5,})", "type": "string"}]
    return X.extract_fields(h, schema, "query_id", "text", F.col("source") == "src1").select("query_id", "field", "value", "conflict")


@query("source_conflicts", BM + rk() + """, h AS (SELECT rk.query_id, bm25, rk.doc_id, rk.chunk_id, CASE WHEN contains(d.source, 'src1') THEN 50 ELSE 10 END AS trust, d.source FROM rk JOIN documents d USING (doc_id) WHERE rank <= 8)
SELECT query_id, source, trust FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY trust DESC, round(bm25, 9) DESC, doc_id, chunk_id) AS r FROM h) WHERE r = 1""")
def source_conflicts(spark, sf):
    from dossier.functions.signals import source_rank
    from dossier.operators.bounds import best_per_key
    h = hits(spark, sf, 8).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").withColumn("trust", source_rank(F.col("source"), [("src1", 50)]))
    return best_per_key(h, ["query_id"], [F.col("trust").desc(), F.round("bm25", 9).desc(), F.col("doc_id"), F.col("chunk_id")]).select(
        "query_id", "source", F.col("trust").cast("long").alias("trust"))


@query("verification_attempts", """WITH a AS (SELECT user_id, event_id AS attempt, value AS score, 20.0::DOUBLE AS base FROM events WHERE event_type = 'view') , g AS (SELECT user_id, base, min(CASE WHEN score > base THEN attempt END) AS attempt FROM a GROUP BY ALL)
SELECT g.user_id, g.attempt, coalesce(a.score, base) AS final_score FROM g LEFT JOIN (SELECT event_id, value AS score FROM events) a ON a.event_id = g.attempt""")
def verification_attempts(spark, sf):
    a = table(spark, sf, "events").filter("event_type = 'view'").select("user_id", F.col("event_id").alias("attempt"), F.col("value").alias("score"), F.lit(20.0).alias("base"))
    return X.verify(a, "user_id", "attempt", "score", "base").select("user_id", "attempt", "final_score")


@query("narrative_probe", """WITH f AS (SELECT DISTINCT source FROM documents WHERE contains(text, '|')), r AS (SELECT source, min(regexp_extract(text, '([0-9]{4,})', 1)) AS v FROM documents WHERE regexp_matches(text, '[0-9]{4,}') AND source NOT IN (SELECT source FROM f) GROUP BY ALL) SELECT source, v FROM r""")
def narrative_probe(spark, sf):
    """Second pass for items the first one left empty."""
    d = table(spark, sf, "documents")
    found = d.filter(F.col("text").contains("|")).select("source").distinct()
    rest = d.join(found, "source", "left_anti").withColumn("v", F.nullif(F.regexp_extract("text", "([0-9]{4,})", 1), F.lit("")))
    return rest.filter("v is not null").groupBy("source").agg(F.min("v").alias("v"))


@query("policy_boost", """WITH b AS (SELECT 'secret' AS field, min(regexp_extract(text, 'token = "([0-9a-f]+)', 1)) AS v FROM documents WHERE source = 'src0' AND regexp_matches(text, 'token = "([0-9a-f]+)')), f AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'secret' ELSE 'other' END AS field, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS value FROM part)
SELECT p_partkey, field, coalesce(value, CASE WHEN b.v IS NOT NULL THEN b.v END) AS value FROM f LEFT JOIN b USING (field)""")
def policy_boost(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "secret").otherwise("other").alias("field"),
                                        F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).alias("value"))
    return X.policy_boost(p, table(spark, sf, "documents"), [("secret", "src0", r'token = "([0-9a-f]+)')], "field", "source", "text").select("p_partkey", "field", "value")


@query("label_line_tables", """SELECT c_nationkey, c_mktsegment AS label, count(*) AS n, sum(c_custkey) AS v FROM customer GROUP BY ALL""")
def label_line_tables(spark, sf):
    """Cells on separate lines: a label opens a row, numbers follow, the total row is left out."""
    g = table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("v"))
    blk = F.concat_ws("\n", "c_mktsegment", F.format_string("%,d", "n"), F.format_string("%,d", "v"))
    d = g.groupBy("c_nationkey").agg(F.concat_ws("\n", F.array_sort(F.collect_list(blk)), F.lit("TOTAL\n9\n9")).alias("t"))
    r = d.select("c_nationkey", F.explode(C.label_line_groups(F.split("t", "\n"), "^[A-Z]+$", "^TOTAL$")).alias("r"))
    return r.select("c_nationkey", F.col("r.label").alias("label"), N.to_int(F.get("r.vals", F.lit(0))).alias("n"), N.to_int(F.get("r.vals", F.lit(1))).alias("v"))


@query("fixed_offset_records", """SELECT s_suppkey, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex, 'Manager' AS position, CAST(s_nationkey AS VARCHAR) AS role FROM supplier""")
def fixed_offset_records(spark, sf):
    s = table(spark, sf, "supplier")
    t = F.array(F.lit("head"), F.col("s_name"), F.when(F.col("s_suppkey") % 2 == 0, "F").otherwise("M"), F.lit("Manager"), F.col("s_nationkey").cast("string"), F.lit("foot"))
    return s.select("s_suppkey", F.explode(C.fixed_offset_records(t, "^[FM]$", ["position", "role"])).alias("r")).select(
        "s_suppkey", "r.name", F.col("r.key").alias("sex"), "r.position", "r.role")


@query("record_summary", f"""WITH {CAND}, f AS (SELECT * FROM (SELECT *, max(y) OVER (PARTITION BY item) AS my FROM c) WHERE y = my), b AS (SELECT item, v AS rv, p AS bp FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY p DESC, s DESC, ord * 1000000 + v) AS r FROM f) WHERE r = 1),
j AS (SELECT f.*, rv, bp, {AGREE} AS same FROM f JOIN b USING (item)), g AS (SELECT item, count_if(NOT same AND NOT (bp AND p)) > 0 AS conflict, count(DISTINCT CASE WHEN same THEN doc END) >= 2 AS confirmed FROM j GROUP BY ALL), k AS (SELECT g.*, p_brand AS brand, p_type AS ptype FROM g JOIN part ON p_partkey = item)
SELECT brand, ptype, count(*) AS n, round(avg(CAST(conflict AS INT)), 4) AS conflict_rate, round(avg(CAST(confirmed AS INT)), 4) AS confirmed_rate FROM k GROUP BY GROUPING SETS ((), (brand), (ptype))""")
def record_summary(spark, sf):
    """Rates over the structured records: overall, by company, by family."""
    from dossier.operators.evaluation import rates
    c = candidates(spark, sf).withColumn("o2", F.col("ord") * 1000000 + F.col("v"))
    r = X.resolve_numeric(c, "item", "doc", "v", "y", "s", F.col("p"), "o2", tol=0.05)
    k = r.join(table(spark, sf, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("brand"), F.col("p_type").alias("ptype")), "item")
    return rates(k, {"conflict_rate": F.col("n_conflicts") > 0, "confirmed_rate": F.col("n_confirming") >= 2}, [[], ["brand"], ["ptype"]], ["brand", "ptype"])


@query("cross_role_candidates", r"""WITH t AS (SELECT o_custkey, o_orderpriority AS label FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 GROUP BY o_custkey, o_orderpriority, year(o_orderdate)),
d AS (SELECT o_custkey, o_orderpriority AS label FROM orders GROUP BY o_custkey, o_orderpriority HAVING count_if(year(o_orderdate) = 1998) = 0), u AS (SELECT * FROM t UNION ALL SELECT * FROM d)
SELECT o_custkey, 'table' AS role, count(*) AS n FROM u WHERE contains(label, 'HIGH') GROUP BY ALL UNION ALL SELECT o_custkey, 'narrative', 1 FROM orders GROUP BY o_custkey""")
def cross_role_candidates(spark, sf):
    """Table and prose candidates of one question over the same texts, above a score."""
    d = order_tables(spark, sf)
    e = F.array().cast("array<string>")
    tc = X.table_candidates(d, ["o_custkey"], "text").withColumn("m", X.row_match(F.col("label"), F.lit("high"), F.lit(""), e, e, F.lit("high"))).filter("m.score >= 0.35")
    nc = X.narrative_candidates(d, ["o_custkey"], "text", [("intro", r"(Intro) line")])
    return tc.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).select("o_custkey", F.lit("table").alias("role"), "n").unionByName(
        nc.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).select("o_custkey", F.lit("narrative").alias("role"), "n"))


@query("profile_build", BM + rk() + f""", h AS (SELECT rk.query_id, rank, bm25, d.source = 'src1' AS pref, {TEXT_SQL} AS t FROM rk JOIN documents d USING (doc_id) WHERE rank <= 8),
f AS (SELECT query_id, arg_min(regexp_extract(t, 'the ([a-z]{{4,}})', 1), CASE WHEN pref THEN 0 ELSE 100 END + rank) AS value, count(DISTINCT regexp_extract(t, 'the ([a-z]{{4,}})', 1)) > 1 AS conflict FROM h WHERE regexp_matches(t, 'the ([a-z]{{4,}})') GROUP BY ALL)
SELECT i.item_id AS query_id, CASE WHEN i.item_id % 2 = 0 THEN 'bm25_lexical' ELSE 'semantic_dense' END AS mode, value, CASE WHEN value IS NULL THEN 'insufficient' WHEN conflict THEN 'conflict' ELSE 'verified' END AS status FROM benchmark i LEFT JOIN f ON f.query_id = i.item_id""")
def profile_build(spark, sf):
    """Fields routed, extracted, judged: one row per field."""
    h = with_text(spark, sf, hits(spark, sf, 8))
    x = X.extract_fields(h, [{"field": "w", "pattern": "the ([a-z]{4,})", "type": "string"}], "query_id", "text", F.col("source") == "src1")
    q = items(spark, sf).select("query_id", CL.route_field(F.when(F.col("query_id") % 2 == 0, "metric").otherwise("text"), F.lit(False))["mode"].alias("mode"))
    j = q.join(x.select("query_id", "value", "conflict"), "query_id", "left")
    return j.select("query_id", "mode", "value", CL.field_status(F.col("value"), F.lit(1.0), F.coalesce("conflict", F.lit(False)))["status"].alias("status"))
