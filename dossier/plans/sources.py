"""Sources, parsers, filings, workbooks and sinks over the driver tables."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dossier.functions import signals as S, text as T
from dossier.operators.bounds import ordered_sum
from dossier.plans.base import WS, query, sql_pad, table
from dossier.plans.text import _sql_unescape
from dossier.session import checkpoint_dir
from dossier.sources import files as FI, pages as P, records as RC, sinks as SK, stored as ST


def scratch(spark, name):
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/dossier-{name}-{uuid.uuid4().hex}"


def sql_strip_html(c):
    t = f"regexp_replace(regexp_replace(regexp_replace({c}, '<script.*?>.*?</script>', ' ', 'gis'), '<style.*?>.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'g')"
    return f"trim(regexp_replace({_sql_unescape(t)}, '\\s+', ' ', 'g'), {WS})"


@query("html_text", f"SELECT page_id, length({sql_strip_html('html')}) AS n_chars, md5({sql_strip_html('html')}) AS text_md5 FROM pages")
def html_text(spark, sf):
    t = T.strip_html(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.length(t).cast("long").alias("n_chars"), F.md5(t).alias("text_md5"))


def sql_unescape_found(c):
    """The entities that the pages hold, with or without the semicolon; ampersands last, as one pass would have it."""
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("nbsp", chr(160)), ("amp", "&")):
        c = f"regexp_replace({c}, '&{name};?', '{char}', 'g')"
    return c


@query("html_text_full_entities", f"""SELECT page_id, md5(trim(regexp_replace({sql_unescape_found(
    "regexp_replace(regexp_replace(regexp_replace(html, '<script.*?>.*?</script>', ' ', 'gis'), '<style.*?>.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'g')"
)}, '\\s+', ' ', 'g'), {WS})) AS text_md5 FROM pages""")
def html_text_full_entities(spark, sf):
    """Every entity, by Arrow batch; the named five have a SQL twin above."""
    t = T.strip_html(F.col("html"), full_entities=True)
    return table(spark, sf, "pages").select("page_id", F.md5(t).alias("text_md5"))


@query("html_sections", rf"""WITH m AS (SELECT page_id, string_split(regexp_replace(html, '<h[1-3][^>]*>(.*?)</h[1-3]>', chr(1) || '\1' || chr(2), 'gis'), chr(1)) AS ps, html FROM pages),
e AS (SELECT page_id, unnest(ps[2:]) AS p, generate_subscripts(ps[2:], 1) AS i FROM m WHERE len(ps) > 1),
s AS (SELECT page_id, i - 1 AS pos, coalesce(nullif(substr({sql_strip_html("split_part(p, chr(2), 1)")}, 1, 120), ''), 'section_' || i) AS heading, {sql_strip_html("split_part(p, chr(2), 2)")} AS body FROM e
 UNION ALL SELECT page_id, 0, 'document_body', {sql_strip_html('html')} FROM m WHERE len(ps) = 1)
SELECT page_id, heading, md5(body) AS body_md5 FROM s WHERE body <> ''""")
def html_sections(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(P.html_sections(F.col("html"))).alias("s")).select(
        "page_id", "s.heading", F.md5("s.body").alias("body_md5"))


def sql_plain(c):
    return f"trim(regexp_replace({sql_unescape_found(f"regexp_replace({c}, '<[^>]+>', ' ', 'g')")}, '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ')"


BLOCKS_SQL = rf"""WITH c AS (SELECT page_id, regexp_replace(coalesce(html, ''), '<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)\s*>', ' ', 'gis') AS h FROM pages),
m AS (SELECT page_id, h, string_split('t' || regexp_replace(regexp_replace(regexp_replace(h, '<h[1-4]\b[^>]*>(.*?)</h[1-4]\s*>', chr(1) || 'h\1' || chr(1) || 't', 'gis'),
 '<tr\b[^>]*>(.*?)</tr\s*>', chr(1) || 'r\1' || chr(1) || 't', 'gis'), '</?table\b[^>]*>', chr(1) || 't', 'gi'), chr(1)) AS ps FROM c),
e AS (SELECT page_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM m),
t AS (SELECT page_id, i, p[1] AS k, {sql_plain('p[2:]')} AS x FROM e),
w AS (SELECT *, coalesce(last_value(CASE WHEN k = 'h' AND x <> '' THEN x END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS heading FROM t WHERE x <> ''),
b AS (SELECT page_id, i, heading, CASE k WHEN 'h' THEN 'heading' ELSE 'text' END AS kind, CASE WHEN k = 'h' THEN '## ' || x WHEN heading <> '' THEN '[' || heading || '] ' || x ELSE x END AS text FROM w),
n AS (SELECT page_id, sum(length(text) + 1) - 1 AS size FROM b GROUP BY page_id)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS pos, kind, heading, md5(text) AS text_md5 FROM b JOIN n USING (page_id) WHERE size >= 40
UNION ALL SELECT page_id, 0, 'plain', '', md5({sql_plain('h')}) FROM c LEFT JOIN n USING (page_id) WHERE coalesce(size, -1) < 40"""


@query("html_blocks", BLOCKS_SQL)
def html_blocks(spark, sf):
    return P.html_blocks(table(spark, sf, "pages"), "page_id", "html").select("page_id", "pos", "kind", "heading", F.md5("text").alias("text_md5"))


@query("html_blocks_sql", BLOCKS_SQL)
def html_blocks_sql(spark, sf):
    """The same table function called from SQL."""
    p = table(spark, sf, "pages").select("page_id", "html")
    P.register_blocks(spark, p.schema["page_id"].dataType)
    return spark.sql("SELECT key AS page_id, pos, kind, heading, md5(text) AS text_md5 FROM html_blocks(TABLE(SELECT * FROM {p}) PARTITION BY page_id)", p=p)


@query("xml_walk", """SELECT o_orderkey, 'status: st-' || o_orderstatus || chr(10) || 'price (cur=usd): ' || printf('%.2f', o_totalprice) || chr(10) || 'tail ' || o_orderpriority AS lines FROM orders""")
def xml_walk(spark, sf):
    """Order rows as small XML documents with attributes and a namespace, walked back to lines."""
    o = table(spark, sf, "orders")
    x = F.format_string("<o:order xmlns:o=\"urn:o\" id=\"%d\"><o:status>st-%s</o:status><price cur=\"usd\">%.2f</price> tail %s</o:order>",
                        "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return o.select("o_orderkey", FI.xml_to_text(x).alias("lines"))


@query("source_types", r"""SELECT page_id, CASE WHEN url LIKE '%page=%' THEN 'html' WHEN url LIKE '%#%' THEN 'json' WHEN page_id % 3 = 0 THEN 'markdown' ELSE 'unknown' END AS source_type,
 trim(regexp_replace(lower(url), '[^a-z0-9가-힣]+', '-', 'g'), '-') AS document_id, split_part(split_part(url, '/', 3), ':', 1) AS host FROM pages""")
def source_types(spark, sf):
    u = F.col("url")
    ext = F.when(u.contains("page="), ".HTML").when(u.contains("#"), ".json").when(F.col("page_id") % 3 == 0, ".md").otherwise("/x")
    return table(spark, sf, "pages").select("page_id", FI.source_type(F.concat(u, ext)).alias("source_type"),
                                            T.sql_like_slug(u).alias("document_id"), F.try_parse_url(u, F.lit("HOST")).alias("host"))


@query("document_inventory", """SELECT source AS root, lang AS ext, count(*) AS n_files, sum(n_chars) AS bytes FROM documents GROUP BY ALL""")
def document_inventory(spark, sf):
    return FI.inventory(table(spark, sf, "documents").select(F.col("source").alias("root"), F.col("lang").alias("ext"), F.col("n_chars").alias("bytes")))


@query("file_listing", """SELECT 'source=' || source AS folder, 'text' AS kind, sum(octet_length(encode(replace(text, chr(10), ' '))) + 1) AS bytes FROM documents GROUP BY ALL""")
def file_listing(spark, sf):
    """Documents written as text files in a folder per source, listed again: folder, kind, bytes."""
    path = scratch(spark, "list")
    table(spark, sf, "documents").select("source", F.replace("text", F.lit("\n"), F.lit(" ")).alias("value")).write.partitionBy("source").text(path)
    f = FI.describe_documents(FI.list_files(spark, path)).filter("source_type <> 'unknown'").withColumn("folder", F.element_at(F.split("path", "/"), -2))
    return f.groupBy("folder", F.col("source_type").alias("kind")).agg(F.sum("bytes").alias("bytes"))


@query("whole_text_files", """SELECT count(*) AS n_files, sum(length(text)) AS n_chars, min(md5(text)) AS lo, max(md5(text)) AS hi FROM conversations""")
def whole_text_files(spark, sf):
    """Conversation turns written as JSON lines to text files, each file then read whole."""
    path = scratch(spark, "txt")
    table(spark, sf, "conversations").select(F.to_json(F.struct("text")).alias("value")).write.text(path)
    t = FI.read_whole_text(spark, path)
    lines = t.select(F.explode(F.split("text", "\n")).alias("j")).filter("j <> ''").select(F.get_json_object("j", "$.text").alias("text"))
    return lines.agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.length("text")).alias("n_chars"), F.min(F.md5("text")).alias("lo"), F.max(F.md5("text")).alias("hi"))


def as_records(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.concat(F.lit("rec_"), F.col("doc_id").cast("string")).alias("record_id"), F.concat(F.lit("doc_"), "source").alias("doc_id"),
                    F.col("lang").alias("company"), (2015 + F.col("doc_id") % 10).cast("int").alias("year"),
                    F.when(F.col("doc_id") % 7 == 0, "news").otherwise("report").alias("source_type"), F.col("source").alias("title"),
                    F.concat(F.lit("sec/"), "source").alias("section_path"), F.lit(None).cast("int").alias("page"),
                    F.when(F.col("doc_id") % 5 == 0, "requirement_taxonomy").otherwise("evidence").alias("record_role"),
                    F.lit("sys").alias("source_system"), F.lit(None).cast("string").alias("source_url"),
                    F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("E.energy"), F.lit("G.other"))).otherwise(F.array(F.lit("G.other"))).alias("esg_tags"),
                    F.to_json(F.struct(F.struct(F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("GRI "), F.col("doc_id").cast("string"))).alias("gri")).alias("source_row"))).alias("metadata"),
                    "text")


REC_SQL = r"""rec AS (SELECT doc_id AS k, 'rec_' || doc_id AS record_id, 'doc_' || source AS doc_id, lang AS company, 2015 + doc_id % 10 AS year,
 CASE WHEN doc_id % 7 = 0 THEN 'news' ELSE 'report' END AS source_type, source AS title, 'sec/' || source AS section_path,
 CASE WHEN doc_id % 5 = 0 THEN 'requirement_taxonomy' ELSE 'evidence' END AS record_role, trim(text, """ + WS + """) AS text FROM documents)"""


@query("record_header_chunks", f"""WITH {REC_SQL}, h AS (SELECT record_id, doc_id AS source, 'record_id: ' || record_id || chr(10) || 'doc_id: ' || doc_id || chr(10) || 'company: ' || company || chr(10) || 'year: ' || year || chr(10)
 || 'source_type: ' || source_type || chr(10) || 'title: ' || title || chr(10) || 'section_path: ' || section_path || chr(10) || 'record_role: ' || record_role || chr(10) || chr(10) || text AS t FROM rec WHERE text <> ''),
n AS (SELECT *, CASE WHEN length(t) <= 900 THEN 1 ELSE 1 + CAST(ceil((length(t) - 900) / 750.0) AS BIGINT) END AS nw FROM h),
w AS (SELECT record_id, source, t, unnest(range(0, CAST(nw AS BIGINT))) AS chunk_id FROM n)
SELECT record_id, chunk_id, md5(trim(substr(t, chunk_id * 750 + 1, 900), {WS})) AS text_md5 FROM w WHERE trim(substr(t, chunk_id * 750 + 1, 900), {WS}) <> ''""")
def record_header_chunks(spark, sf):
    """Records go out as JSONL with one broken line per file, come back through the record reader."""
    path = scratch(spark, "rec")
    as_records(spark, sf).select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    spark.range(1).select(F.lit("{broken").alias("value")).write.mode("append").text(path)
    c = RC.record_chunks(RC.read_records(spark, path))
    return c.select("record_id", "chunk_id", F.md5("text").alias("text_md5"))


@query("record_header_long", f"""WITH {REC_SQL} SELECT record_id, md5('record_id: ' || record_id || chr(10) || 'doc_id: ' || doc_id || chr(10) || 'company: ' || company || chr(10) || 'year: ' || year || chr(10) || 'source_type: ' || source_type || chr(10)
 || 'title: ' || title || chr(10) || 'section_path: ' || section_path || chr(10) || 'page: ' || chr(10) || 'record_role: ' || record_role || chr(10) || 'source_system: sys' || chr(10) || 'source_url: ' || chr(10)
 || 'esg_tags: ' || CASE WHEN k % 2 = 0 THEN 'E.energy, G.other' ELSE 'G.other' END || chr(10) || chr(10) || text) AS text_md5 FROM rec""")
def record_header_long(spark, sf):
    return RC.with_header(as_records(spark, sf), RC.HEADER_12).select("record_id", F.md5("text").alias("text_md5"))


@query("corpus_units", f"""WITH {REC_SQL} SELECT record_id, company, CASE WHEN k % 4 = 0 THEN 'GRI ' || k ELSE '' END AS gri_code, length(text) AS n_chars FROM rec
WHERE length(text) >= 80 AND (record_role = 'requirement_taxonomy' OR source_type <> 'news') AND (record_role = 'requirement_taxonomy' OR contains(lower(section_path || ' ' || text), 'tion the') OR k % 2 = 0)""")
def corpus_units(spark, sf):
    u = RC.corpus_units(as_records(spark, sf), ["tion the"])
    return u.select("record_id", "company", "gri_code", F.length("text").cast("long").alias("n_chars"))


@query("capped_units", """WITH u AS (SELECT lang AS company, md5(text) AS unit_id, min(doc_id) AS doc_id FROM documents GROUP BY ALL),
d AS (SELECT unit_id, arg_min(company, doc_id) AS company, min(doc_id) AS doc_id FROM u GROUP BY ALL)
SELECT company, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY doc_id) AS r FROM d) WHERE r <= 40""")
def capped_units(spark, sf):
    u = table(spark, sf, "documents").select(F.col("lang").alias("company"), F.md5("text").alias("unit_id"), "doc_id")
    return RC.capped_units(u, "company", "unit_id", [F.col("doc_id")], 40).select("company", "doc_id")


@query("prechunked_records", """SELECT doc_id AS chunk_id, md5('record_id: ' || doc_id || chr(10) || 'chunk_id: ' || doc_id || chr(10) || 'company: ' || lang || chr(10) || 'year: ' || CASE WHEN doc_id % 2 = 0 THEN '2020' ELSE CAST(2000 + doc_id % 20 AS VARCHAR) END
 || chr(10) || 'source_type: text' || chr(10) || 'document_title: ' || source || chr(10) || 'section_path: ' || chr(10) || 'source_path: ' || source || chr(10) || chr(10) || trim(text, """ + WS + """)) AS text_md5 FROM documents""")
def prechunked_records(spark, sf):
    d = table(spark, sf, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("lang").alias("company"), (2000 + F.col("doc_id") % 20).alias("year"), F.lit("text").alias("source_type"),
        F.col("source").alias("document_title"), F.lit("").alias("section_hint"), F.col("source").alias("source_path"), "text",
        F.struct(F.when(F.col("doc_id") % 2 == 0, "2020").otherwise("").alias("year_hint")).alias("metadata"))
    return RC.prechunked(d).select("chunk_id", F.md5("text").alias("text_md5"))


@query("filing_lines", """SELECT l_orderkey, l_linenumber, 'statement=' || l_returnflag || ' | account=part ' || l_partkey || ' | account_id=' || l_suppkey || CASE WHEN l_linestatus = 'O' THEN ' | detail=open' ELSE '' END
 || ' | term 3=' || format('{:,}', CAST(floor(l_extendedprice) AS BIGINT)) || ' KRW' || ' | term 2=- KRW' AS line, 'financial_statement' AS schema, count(*) AS n FROM lineitem GROUP BY ALL""")
def filing_lines(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("sj_nm"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("account_nm"),
        F.col("l_suppkey").cast("string").alias("account_id"), F.when(F.col("l_linestatus") == "O", "open").otherwise("-").alias("account_detail"),
        F.lit("term 3").alias("thstrm_nm"), F.floor("l_extendedprice").cast("long").cast("string").alias("thstrm_amount"),
        F.lit("term 2").alias("frmtrm_nm"), F.lit("-").alias("frmtrm_amount"), F.lit(None).cast("string").alias("bfefrmtrm_nm"),
        F.lit(None).cast("string").alias("bfefrmtrm_amount"), F.lit("KRW").alias("currency"))
    keys = F.array(*[F.lit(c) for c in li.columns])
    return li.select("l_orderkey", "l_linenumber", RC.filing_line("financial_statement").alias("line"),
                     RC.filing_schema(F.lit("untitled"), keys, [("^employees", "employee_status")]).alias("schema")).groupBy(
        "l_orderkey", "l_linenumber", "line", "schema").agg(F.count(F.lit(1)).alias("n"))


@query("filing_record_ids", """WITH r AS (SELECT o_custkey, o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS i FROM orders)
SELECT o_orderkey, 'doc_' || o_custkey || '::' || o_orderstatus || '::' || i AS record_id FROM r""")
def filing_record_ids(spark, sf):
    """Rows numbered per document and statement; pieces keep a hot document from one big sort."""
    from dossier.operators.bounds import number_rows
    o = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderkey")
    n = number_rows(o, ["o_custkey", "o_orderstatus"], [F.col("o_orderkey")], F.col("o_orderkey"), target_rows=4000)
    return n.select("o_orderkey", F.concat(F.lit("doc_"), F.col("o_custkey").cast("string"), F.lit("::"), "o_orderstatus", F.lit("::"),
                                           F.col("rn").cast("string")).alias("record_id"))


@query("forward_fill", """SELECT o_orderkey, last_value(CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority END IGNORE NULLS) OVER w AS area,
 last_value(CASE WHEN o_orderkey % 11 = 0 THEN o_custkey END IGNORE NULLS) OVER w AS category FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderkey)""")
def forward_fill(spark, sf):
    """Context columns present on some rows only, filled downwards per sheet."""
    from dossier.operators.bounds import forward_fill as ff
    o = table(spark, sf, "orders").select("o_orderstatus", "o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderpriority")).alias("area"),
                                          F.when(F.col("o_orderkey") % 11 == 0, F.col("o_custkey")).alias("category"))
    return ff(o, ["o_orderstatus"], F.col("o_orderkey"), ["area", "category"], target_rows=4000).select("o_orderkey", "area", "category")


@query("workbook_questions", f"""WITH f AS (SELECT o_orderkey, o_orderstatus, o_totalprice, year(o_orderdate) AS y, o_custkey, last_value(CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority END IGNORE NULLS) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS area FROM orders)
SELECT o_orderstatus || '-' || {sql_pad('o_orderkey', 5)} AS question_id, CASE WHEN area IS NULL THEN '' ELSE area || ' / ' END || 'item ' || o_custkey AS question_text, 'quantitative' AS question_type,
 'item_' || o_custkey AS metric_name, y AS year, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS gold_num, o_orderkey % 9 = 0 AS is_not_disclosed FROM f""")
def workbook_questions(spark, sf):
    o = table(spark, sf, "orders")
    w = o.select(F.col("o_orderstatus").alias("company_id"), F.col("o_orderkey").alias("row_index"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderpriority")).alias("area"),
                 F.concat(F.lit("item "), F.col("o_custkey").cast("string")).alias("item"), F.lit("usd").alias("unit"),
                 F.when(F.col("o_orderkey") % 9 == 0, "Not disclosed").otherwise(F.format_string("%.2f", "o_totalprice")).alias("value"),
                 F.year("o_orderdate").alias("year"), F.when(F.col("o_orderkey") % 9 == 0, "Not disclosed").otherwise("matched").alias("status"),
                 F.concat(F.lit("http://x/"), F.col("o_custkey").cast("string")).alias("url"), F.lit("").alias("file_url"))
    rows = RC.read_workbook(w, "company_id", "row_index", ["area"], ["value"])
    t = RC.workbook_tables(rows, "company_id", "row_index", ["area", "item"], "unit", "value", "year", "status", "url", "file_url")
    return t["questions"].join(t["gold_answers"], "question_id").select("question_id", "question_text", "question_type", "metric_name",
                                                                       F.col("year").cast("long").alias("year"), F.round("gold_num", 2).alias("gold_num"), "is_not_disclosed")


@query("workbook_registry", f"""WITH s AS (SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY ALL) SELECT 'http://x/' || s.o_custkey AS address, o_orderstatus || '-' || {sql_pad('k', 5)} AS question_id
FROM s JOIN orders o ON o.o_orderkey = s.k""")
def workbook_registry(spark, sf):
    o = table(spark, sf, "orders")
    w = o.select(F.col("o_orderstatus").alias("company_id"), F.col("o_orderkey").alias("row_index"), F.lit("a").alias("area"), F.lit("usd").alias("unit"), F.lit("1").alias("value"),
                 F.year("o_orderdate").alias("year"), F.lit("matched").alias("status"), F.concat(F.lit("http://x/"), F.col("o_custkey").cast("string")).alias("url"), F.lit("").alias("file_url"))
    return RC.workbook_tables(w, "company_id", "row_index", ["area"], "unit", "value", "year", "status", "url", "file_url")["registry"].select("address", "question_id")


@query("wide_to_long", """WITH p AS (SELECT o_custkey, year(o_orderdate) AS y, sum(o_totalprice) AS v FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 GROUP BY ALL)
SELECT o_custkey, y AS year, CASE WHEN v < 200000 THEN '' ELSE CAST(CAST(round(v) AS BIGINT) AS VARCHAR) END AS value, CASE WHEN v < 200000 THEN 'Not disclosed' ELSE 'matched' END AS disclosure_status FROM p""")
def wide_to_long(spark, sf):
    """A sum of nulls is a dash in the wide table: a value that was found and is no number."""
    o = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    v = F.col("v")
    cell = F.when(v.isNull(), "-").when(v < 200000, "Not disclosed").otherwise(F.round(v).cast("long").cast("string"))
    y = ordered_sum(o, ["o_custkey", "y"], "o_totalprice", "o_orderkey", "v").groupBy("o_custkey").pivot("y", [1996, 1997, 1998]).agg(F.first(cell))
    cols = []
    for k in (1996, 1997, 1998):
        c = F.col(str(k))
        cols += [c.alias(f"{k}_value"), F.when(c.isNotNull(), "src").alias(f"{k}_source"), F.lit(None).cast("string").alias(f"{k}_basis")]
    return RC.wide_to_long(y.select("o_custkey", *cols), ["o_custkey"], [1996, 1997, 1998]).select(
        "o_custkey", F.col("year").cast("long").alias("year"), F.nullif("value", F.lit("-")).alias("value"), "disclosure_status")


SIG = "len(regexp_extract_all(text, 'the ')) "


@query("import_validation", f"""WITH s AS (SELECT doc_id, source, text, {SIG} AS esg, len(regexp_extract_all(text, 'ti')) AS comp, CAST(contains(text, 'token =') AS INT) AS wrong, length(text) AS n,
  contains(text, 'licensed') AS cov FROM documents)
SELECT doc_id, CASE WHEN wrong > 0 OR n < 500 OR esg < 3 THEN 'reject' WHEN cov OR comp < 1 THEN 'accept_with_warnings' WHEN esg >= 5 AND comp >= 2 AND n >= 2000 THEN 'accept' ELSE 'accept_with_warnings' END AS decision,
 CASE WHEN wrong > 0 THEN 'wrong_document_type' WHEN n < 500 THEN 'insufficient_text' WHEN esg < 3 THEN 'low_topic_signal' WHEN cov THEN 'coverage_export' WHEN comp < 1 THEN 'low_company_signal'
  WHEN esg >= 5 AND comp >= 2 AND n >= 2000 THEN 'report_body' ELSE 'partial_body' END AS reason,
 CASE WHEN source = 'src1' THEN 'news_or_press' WHEN source = 'src2' THEN 'website_capture' WHEN esg >= 4 AND comp >= 2 AND wrong = 0 THEN 'likely_report' WHEN contains(lower(text), 'impact') THEN 'likely_impact_report'
  WHEN contains(lower(text), 'navigation') OR contains(lower(text), 'portal') THEN 'portal_noise' ELSE 'unknown' END AS class FROM s""")
def import_validation(spark, sf):
    t = F.col("text")
    esg, comp, wrong = S.n_matches(t, "the "), S.n_matches(t, "ti"), t.contains("token =").cast("int")
    path = F.when(F.col("source") == "src1", "news/a").when(F.col("source") == "src2", "website/b").otherwise("other")
    return table(spark, sf, "documents").select(
        "doc_id", RC.import_decision(esg, comp, wrong, t.contains("licensed"), F.length(t)).alias("d"),
        RC.audit_class(path, esg, comp, wrong, t).alias("a")).select("doc_id", "d.*", "a.class")


@query("themed_seeds", rf"""WITH p AS (SELECT doc_id, n_chars, trim(regexp_replace(unnest(ps), '\s+', ' ', 'g'), {WS}) AS p, generate_subscripts(ps, 1) - 1 AS para FROM (SELECT doc_id, n_chars, regexp_split_to_array(text, '\n+') AS ps FROM documents)),
t AS (SELECT *, CASE WHEN regexp_matches(lower(p), 'token|licen') THEN 'legal' WHEN regexp_matches(lower(p), 'tion') THEN 'action' END AS theme,
 array_to_string(list_concat(list_slice(regexp_extract_all(lower(p), '([a-z]{{5,}})', 1), 1, 6), list_slice(regexp_extract_all(p, '(\d+(?:\.\d+)?)', 1), 1, 5)), '|') AS cluster FROM p WHERE length(p) >= 60)
SELECT doc_id, para, theme FROM (SELECT *, row_number() OVER (PARTITION BY theme, cluster ORDER BY n_chars DESC, doc_id, para) AS r FROM t WHERE theme IS NOT NULL) WHERE r = 1""")
def themed_seeds(spark, sf):
    d = table(spark, sf, "documents")
    s = RC.themed_seeds(d, "doc_id", "text", [F.col("n_chars").desc()], [("token|licen", "legal"), ("tion", "action")])
    return s.select("doc_id", F.col("para").cast("long").alias("para"), "theme")


@query("source_selection", f"""WITH f AS (SELECT source, lang, doc_id, n_chars AS bytes, CAST(contains(text, 'the ') AS INT) + CAST(contains(text, 'token') AS INT) AS score,
  CASE WHEN lang = 'fr' THEN 'skip_path_pattern' WHEN n_chars < 300 THEN 'skip_too_small' END AS why, {sql_pad('doc_id', 8)} AS name FROM documents),
g AS (SELECT source, sum(score) AS s, count(*) AS n FROM f WHERE why IS NULL GROUP BY ALL ORDER BY s DESC, n DESC, source LIMIT 5)
SELECT source, doc_id, score, rank FROM (SELECT f.*, row_number() OVER (PARTITION BY source ORDER BY score DESC, bytes DESC, name) AS rank FROM f WHERE why IS NULL AND source IN (SELECT source FROM g)) WHERE rank <= 10""")
def source_selection(spark, sf):
    t = F.col("text")
    d = table(spark, sf, "documents").withColumn("bytes", F.col("n_chars")).withColumn("name", T.pad_id(F.col("doc_id"), 8))
    kept, _ = FI.select_sources(d, "source", F.when(F.col("lang") == "fr", "skip_path_pattern").when(F.col("n_chars") < 300, "skip_too_small"),
                                t.contains("the ").cast("int") + t.contains("token").cast("int"), 5, 10)
    return kept.select("source", "doc_id", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("skip_reasons", """SELECT CASE WHEN lang = 'fr' THEN 'skip_path_pattern' ELSE 'skip_too_small' END AS reason, count(*) AS n FROM documents WHERE lang = 'fr' OR n_chars < 300 GROUP BY ALL""")
def skip_reasons(spark, sf):
    d = table(spark, sf, "documents").withColumn("bytes", F.col("n_chars")).withColumn("name", F.col("source"))
    return FI.select_sources(d, "source", F.when(F.col("lang") == "fr", "skip_path_pattern").when(F.col("n_chars") < 300, "skip_too_small"), F.lit(0), 1, 1)[1]


@query("format_coverage", """WITH f AS (SELECT source AS fmt, lang AS company, count(*) AS n, count_if(regexp_matches(text, '20[0-9]{2}')) AS y, count_if(regexp_matches(text, '[0-9]')) AS num, count_if(contains(text, '|')) AS tab FROM documents GROUP BY ALL)
SELECT fmt, sum(n) AS document_count, count(DISTINCT company) AS companies, round((sum(y) + sum(num) + sum(tab)) / (3.0::DOUBLE * sum(n)), 3) AS readiness,
 CASE WHEN (sum(y) + sum(num) + sum(tab)) / (3.0::DOUBLE * sum(n)) >= 0.7 THEN 'strong' WHEN (sum(y) + sum(num) + sum(tab)) / (3.0::DOUBLE * sum(n)) >= 0.45 THEN 'adequate' ELSE 'weak' END AS tier FROM f GROUP BY fmt""")
def format_coverage(spark, sf):
    t = F.col("text")
    g = table(spark, sf, "documents").groupBy(F.col("source").alias("fmt")).agg(
        F.count(F.lit(1)).alias("document_count"), F.countDistinct("lang").alias("companies"),
        ((F.count_if(t.rlike("20[0-9]{2}")) + F.count_if(t.rlike("[0-9]")) + F.count_if(t.contains("|"))) / (3.0 * F.count(F.lit(1)))).alias("r"))
    return g.select("fmt", "document_count", "companies", F.round("r", 3).alias("readiness"),
                    F.when(F.col("r") >= 0.7, "strong").when(F.col("r") >= 0.45, "adequate").otherwise("weak").alias("tier"))


@query("sessions", """SELECT conv_id, count(*) AS messages, count_if(role = 'user') AS user_turns, max(turn) AS last_turn FROM conversations GROUP BY conv_id""")
def sessions(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("messages"), F.count_if(F.col("role") == "user").alias("user_turns"), F.max("turn").alias("last_turn"))


# ---- sinks: written, read back, compared with what SQL says about the table --------
@query("sink_jsonl", "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents")
def sink_jsonl(spark, sf):
    path = scratch(spark, "jsonl")
    SK.write_jsonl(table(spark, sf, "documents").select("doc_id", "lang", "text"), path)
    return spark.read.schema("doc_id long, lang string, text string").json(path).select("doc_id", "lang", F.md5("text").alias("text_md5"))


@query("sink_csv", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, '' AS note FROM customer")
def sink_csv(spark, sf):
    path = scratch(spark, "csv")
    SK.write_csv(table(spark, sf, "customer"), path, ["c_custkey", "c_name", "note"])
    return spark.read.csv(path, header=True, schema="c_custkey string, c_name string, note string").na.fill("")


@query("csv_pipe_text", "SELECT c_custkey || ' | ' || c_name || ' | ' || c_mktsegment AS text FROM customer")
def csv_pipe_text(spark, sf):
    path = scratch(spark, "csvt")
    SK.write_csv(table(spark, sf, "customer"), path, ["c_custkey", "c_name", "c_mktsegment"])
    return FI.csv_as_text(spark, path).select("text")


@query("sink_partitions", "SELECT lang, CASE WHEN n_chars < 300 THEN 'abstain' ELSE 'answerable' END AS part, count(*) AS n FROM documents GROUP BY ALL")
def sink_partitions(spark, sf):
    path = scratch(spark, "part")
    d = table(spark, sf, "documents").withColumn("part", F.when(F.col("n_chars") < 300, "abstain").otherwise("answerable"))
    SK.write_partitions(d.select("doc_id", "lang", "part"), path, ["lang", "part"], salts=4, row_id="doc_id")
    return spark.read.parquet(path).groupBy("lang", "part").agg(F.count(F.lit(1)).alias("n"))


@query("sink_scoped", "SELECT source AS document_id, count(*) AS units FROM documents WHERE lang = 'en' GROUP BY ALL")
def sink_scoped(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("document_id"), "lang", F.array(F.lit("base")).alias("tags"))
    return SK.write_scoped(d, scratch(spark, "scope"), F.col("lang") == "en", "english_only")


@query("sink_split", "SELECT CASE WHEN n_chars >= 500 THEN 'pass' ELSE 'reject' END AS qc_status, count(*) AS n FROM documents GROUP BY ALL")
def sink_split(spark, sf):
    path = scratch(spark, "qc")
    SK.split_sink(table(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") >= 500, "pass").otherwise("reject").alias("qc_status")), path)
    return spark.read.json(path).groupBy("qc_status").agg(F.count(F.lit(1)).alias("n"))


@query("eval_table_export", "SELECT 'G-' || item_id AS id, text AS question, '' AS expected_source, lower(text) AS expected_answer, '' AS extracted_field, '' AS difficulty, 'bench' AS category, 'approved' AS status FROM benchmark")
def eval_table_export(spark, sf):
    b = table(spark, sf, "benchmark")
    return SK.eval_table(b, {"id": F.concat(F.lit("G-"), F.col("item_id").cast("string")), "question": F.col("text"), "expected_answer": F.lower("text"),
                             "category": F.lit("bench"), "status": F.lit("approved")})


@query("json_documents", "SELECT count(*) AS n, sum(length(c_name)) AS name_chars FROM customer")
def json_documents(spark, sf):
    """Customers as one JSON object per line, lines read back as documents; a broken file is left out."""
    path = scratch(spark, "jsd")
    table(spark, sf, "customer").select(F.to_json(F.array(F.struct("c_custkey", "c_name"))).alias("value")).write.option("lineSep", "\n").text(path)
    spark.range(1).select(F.lit("{broken").alias("value")).write.mode("append").text(path)
    t = spark.read.text(path)
    ok = t.filter(F.try_parse_json("value").isNotNull())
    return ok.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.get_json_object("value", "$[0].c_name"))).alias("name_chars"))


@query("json_document_files", """SELECT 2 + sum(length('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}')) + 2 * (count(*) - 1) AS n_chars FROM nation GROUP BY n_regionkey""")
def json_document_files(spark, sf):
    """Whole files of JSON through the document reader."""
    path = scratch(spark, "jsf")
    n = table(spark, sf, "nation")
    n.groupBy("n_regionkey").agg(F.to_json(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("value")).write.partitionBy("n_regionkey").text(path)
    return FI.read_json_documents(spark, path).select(F.length("text").alias("n_chars"))


@query("corpus_build", f"""WITH {REC_SQL}, c AS (SELECT CASE WHEN k % 3 = 0 THEN 'prechunked' WHEN k % 3 = 1 THEN 'records' ELSE 'documents' END AS lane,
 CASE WHEN k % 3 = 0 THEN 1 WHEN k % 3 = 1 THEN 1 + greatest(0, CAST(ceil((length('record_id: ' || record_id || 'doc_id: ' || doc_id || 'company: ' || company || 'year: ' || year || 'source_type: ' || source_type || 'title: ' || title || 'section_path: ' || section_path || 'record_role: ' || record_role || text) + 9 - 900) / 750.0) AS BIGINT))
  ELSE 0 END AS n, k FROM rec WHERE text <> '')
SELECT lane, sum(n) AS chunks FROM c WHERE lane <> 'documents' GROUP BY lane UNION ALL SELECT 'documents', sum(CASE WHEN length(text) <= 900 THEN 1 ELSE 1 + CAST(ceil((length(text) - 900) / 750.0) AS BIGINT) END) FROM documents WHERE doc_id % 3 = 2""")
def corpus_build(spark, sf):
    """A third of the documents through each reader, one chunk table out of it, counted per lane."""
    from dossier.operators.chunking import chunk_chars
    d = table(spark, sf, "documents")
    k = F.col("doc_id") % 3
    pre = RC.prechunked(d.filter(k == 0).select(
        F.col("doc_id").alias("chunk_id"), F.col("lang").alias("company"), F.lit(2020).alias("year"), F.lit("text").alias("source_type"), F.col("source").alias("document_title"),
        F.lit("").alias("section_hint"), F.col("source").alias("source_path"), "text", F.struct(F.lit("").alias("year_hint")).alias("metadata"))).withColumnRenamed("source_path", "source")
    rec = RC.record_chunks(as_records(spark, sf).filter(F.substring("record_id", 5, 20).cast("long") % 3 == 1))
    doc = chunk_chars(d.filter(k == 2).select("source", "text"))
    return RC.build_chunks(pre, rec, doc).groupBy("lane").agg(F.count(F.lit(1)).alias("chunks"))


@query("filing_documents", """WITH r AS (SELECT o_custkey, o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS i FROM orders)
SELECT o_custkey, o_orderstatus, i AS pos, '- order=' || o_orderkey AS line FROM r UNION ALL SELECT DISTINCT o_custkey, o_orderstatus, 0, '## ' || o_orderstatus FROM orders""")
def filing_documents(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderkey")
    r = RC.filing_extract(o, "o_custkey", "o_orderstatus", "o_orderkey", F.concat(F.lit("order="), F.col("o_orderkey").cast("string")))
    return RC.filing_text(r, "o_custkey", "o_orderstatus")


@query("company_reingest", rf"""WITH s AS (SELECT doc_id, lang, list_filter(list_transform(regexp_split_to_array(text, '\n+'), lambda x: trim(x, {WS})), lambda x: x <> '') AS ss FROM documents), e AS (SELECT doc_id, lang, unnest(ss) AS sec FROM s),
n AS (SELECT *, CASE WHEN length(sec) <= 900 THEN 1 ELSE 1 + CAST(ceil((length(sec) - 900) / 750.0) AS BIGINT) END AS nw FROM e), w AS (SELECT doc_id, lang, sec, unnest(range(0, CAST(nw AS BIGINT))) AS c FROM n), t AS (SELECT doc_id, lang, trim(substr(sec, c * 750 + 1, 900), {WS}) AS text FROM w)
SELECT lang, count(DISTINCT doc_id) AS documents, count(*) AS chunks, count_if(length(text) >= 80) AS units FROM t WHERE length(text) >= 40 GROUP BY lang""")
def company_reingest(spark, sf):
    from dossier.operators.chunking import evidence_units
    path = scratch(spark, "units")
    evidence_units(table(spark, sf, "documents"), "doc_id", "text", "lang").write.partitionBy("lang").parquet(path)
    return spark.read.parquet(path).groupBy("lang").agg(F.countDistinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("chunks"), F.count_if("is_unit").alias("units"))


@query("corpus_file_filter", """SELECT page_id FROM pages WHERE page_id % 3 = 0 OR contains(url, 'page=')""")
def corpus_file_filter(spark, sf):
    """Corpus extensions stay, readme and manifest files go, an allow-list narrows the rest."""
    k = F.col("page_id")
    ext = F.when((k % 3 == 0) | F.col("url").contains("page="), "md").otherwise("exe")
    l = table(spark, sf, "pages").select("page_id", F.concat(F.lit("d/"), k.cast("string"), F.lit("."), ext).alias("rel"), F.lit("x").alias("name"), ext.alias("ext"))
    return FI.corpus_files(l, l.select("rel")).select("page_id")


def stored_documents(spark, sf, name):
    path = scratch(spark, name)
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars", "source")
    ST.create(d, path, ["lang"], "source")
    return d, path


@query("delete_in_place", "SELECT lang, source, count(*) AS n, sum(doc_id) AS ids, (SELECT count(*) FROM documents WHERE source IN ('src1', 'src7')) AS removed FROM documents WHERE source NOT IN ('src1', 'src7') GROUP BY ALL")
def delete_in_place(spark, sf):
    """Two sources taken out of a stored table; the partitions that hold them are rewritten."""
    d, path = stored_documents(spark, sf, "inplace")
    removed, _ = ST.delete_keys(spark, path, ["lang"], "source", d.filter(F.col("source").isin("src1", "src7")).select("source"))
    return ST.open_table(spark, path).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids")).withColumn("removed", F.lit(removed).cast("long"))


@query("replace_in_place", """SELECT lang, source, count(*) AS n, sum(n_chars) AS chars FROM (SELECT lang, source, n_chars FROM documents WHERE source <> 'src3' UNION ALL SELECT 'new', 'src3', n_chars + 1 FROM documents WHERE source = 'src3') GROUP BY ALL""")
def replace_in_place(spark, sf):
    """All rows of a source give way to new ones, which lie in another partition."""
    d, path = stored_documents(spark, sf, "inplace")
    new = d.filter("source = 'src3'").select("doc_id", F.lit("new").alias("lang"), (F.col("n_chars") + 1).alias("n_chars"), "source")
    ST.replace_keys(spark, path, ["lang"], "source", new)
    return ST.open_table(spark, path).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
