"""Chunk generators over the documents table."""
from __future__ import annotations

from pyspark.sql import functions as F

from dossier.functions.text import strip
from dossier.operators import chunking as C
from dossier.operators.bounds import spread
from dossier.plans.base import WS, query, sql_char_chunks, sql_pad, table


@query("chunk_words", r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents),
n AS (SELECT doc_id, ws, len(ws) AS n FROM w WHERE len(ws) > 0),
c AS (SELECT doc_id, ws, unnest(range(0, CASE WHEN n <= 400 THEN 1
        ELSE 1 + CAST(ceil((n - 400) / 320.0) AS BIGINT) END)) AS chunk_id FROM n)
SELECT doc_id, chunk_id, len(list_slice(ws, chunk_id * 320 + 1, chunk_id * 320 + 400)) AS n_words,
       md5(array_to_string(list_slice(ws, chunk_id * 320 + 1, chunk_id * 320 + 400), ' ')) AS text_md5 FROM c""")
def chunk_words(spark, sf):
    df = C.chunk_words(table(spark, sf, "documents").select("doc_id", "text"))
    return df.select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"),
                     F.size(F.split("text", " ")).cast("long").alias("n_words"), F.md5("text").alias("text_md5"))


@query("chunk_chars", f"""WITH c AS ({sql_char_chunks()})
SELECT doc_id, chunk_id, length(text) AS n_chars, md5(text) AS text_md5 FROM c""")
def chunk_chars(spark, sf):
    df = C.chunk_chars(table(spark, sf, "documents").select("doc_id", "text"))
    return df.select("doc_id", "chunk_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


@query("chunk_sections", rf"""
WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS sec, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS section_pos FROM documents),
t AS (SELECT doc_id, section_pos, trim(sec, {WS}) AS text FROM s),
n AS (SELECT *, CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 800 THEN 1 ELSE 1 + CAST(ceil((length(text) - 800) / 680.0) AS BIGINT) END AS nw FROM t),
w AS (SELECT doc_id, section_pos, unnest(range(0, CAST(nw AS BIGINT))) AS chunk_pos, text FROM n)
SELECT doc_id, section_pos, chunk_pos, md5(trim(substr(text, chunk_pos * 680 + 1, 800), {WS})) AS text_md5
FROM w WHERE trim(substr(text, chunk_pos * 680 + 1, 800), {WS}) <> ''""")
def chunk_sections(spark, sf):
    """The driver texts have no `#` headings; their line breaks stand for sections."""
    df = C.chunk_sections(table(spark, sf, "documents").select("doc_id", "text"), pattern="\n")
    return df.select("doc_id", F.col("section_pos").cast("long").alias("section_pos"), "chunk_pos",
                     F.md5("text").alias("text_md5"))


@query("chunk_recursive")
def chunk_recursive(spark, sf):
    df = C.chunk_recursive(table(spark, sf, "documents"), "doc_id")
    return df.select("doc_id", "chunk_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query("evidence_units", rf"""
WITH s AS (SELECT doc_id, lang, list_filter(list_transform(regexp_split_to_array(text, '\n+'), lambda x: trim(x, {WS})), lambda x: x <> '') AS ss FROM documents),
e AS (SELECT doc_id, lang, unnest(ss) AS sec, generate_subscripts(ss, 1) - 1 AS section_pos FROM s),
n AS (SELECT *, CASE WHEN length(sec) <= 900 THEN 1 ELSE 1 + CAST(ceil((length(sec) - 900) / 750.0) AS BIGINT) END AS nw FROM e),
w AS (SELECT doc_id, lang, section_pos, sec, unnest(range(0, CAST(nw AS BIGINT))) AS chunk_pos FROM n),
t AS (SELECT doc_id, lang, section_pos, chunk_pos, trim(substr(sec, chunk_pos * 750 + 1, 900), {WS}) AS text FROM w),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section_pos, chunk_pos) AS rn FROM t WHERE length(text) >= 40)
SELECT doc_id, lang, CAST(doc_id AS VARCHAR) || '-' || {sql_pad('rn', 4)} AS unit_id,
       section_pos, chunk_pos, length(text) AS n_chars, length(text) >= 80 AS is_unit FROM k""")
def evidence_units(spark, sf):
    df = C.evidence_units(table(spark, sf, "documents"), "doc_id", "text", "lang")
    return df.select("doc_id", "lang", "unit_id", F.col("section_pos").cast("long").alias("section_pos"), "chunk_pos",
                     F.length("text").cast("long").alias("n_chars"), "is_unit")


@query("sentence_split", r"""
WITH p AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '([.?!])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1))) AS s FROM documents),
t AS (SELECT doc_id, trim(regexp_replace(s, '\s+', ' ', 'g')) AS s FROM p)
SELECT doc_id, count(*) AS n_sentences, sum(length(s)) AS n_chars, min(md5(s)) AS lo, max(md5(s)) AS hi
FROM t WHERE length(s) >= 24 GROUP BY doc_id""")
def sentence_split(spark, sf):
    df = C.sentences_of(table(spark, sf, "documents").select("doc_id", "text"))
    return df.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum(F.length("sentence")).alias("n_chars"),
                                    F.min(F.md5("sentence")).alias("lo"), F.max(F.md5("sentence")).alias("hi"))


@query("atomic_facts", r"""
WITH p AS (SELECT doc_id, source, unnest(string_split(regexp_replace(text, '([.!?])\s+|;\s*|\n+|•', '\1' || chr(1), 'g'), chr(1))) AS s,
                  generate_subscripts(string_split(regexp_replace(text, '([.!?])\s+|;\s*|\n+|•', '\1' || chr(1), 'g'), chr(1)), 1) AS i FROM documents),
t AS (SELECT doc_id, i, substr(trim(regexp_replace(s, '\s+', ' ', 'g')), 1, 220) AS fact, source, trim(regexp_replace(s, '\s+', ' ', 'g')) AS full_s FROM p),
r AS (SELECT doc_id, fact, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS fact_pos FROM t
      WHERE length(full_s) >= 20 AND (contains(lower(full_s), lower(source)) OR length(full_s) >= 60))
SELECT doc_id, fact_pos, md5(fact) AS fact_md5 FROM r WHERE fact_pos < 4""")
def atomic_facts(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(C.atomic_facts(F.col("text"), F.col("source"))).alias("p", "fact")).select(
        "doc_id", F.col("p").cast("long").alias("fact_pos"), F.md5("fact").alias("fact_md5"))


@query("line_table_rows", r"""
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, year(l_shipdate) AS y FROM lineitem)
SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS label, year, sum(q) AS qty, count(*) AS n FROM
  (SELECT l_orderkey, l_partkey, y AS year, CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) AS q FROM t) GROUP BY ALL""")
def line_table_rows(spark, sf):
    """Order lines rendered as pipe tables, one per line, then parsed back by the table generator."""
    li = spread(table(spark, sf, "lineitem"))
    rows = li.select("l_orderkey", F.concat(F.lit("| "), F.concat_ws(" | ", F.col("l_partkey").cast("string"),
                                               *[F.when(F.year("l_shipdate") == y, F.col("l_quantity").cast("long").cast("string")).otherwise("-")
                                                 for y in range(1992, 2003)]), F.lit(" |")).alias("ln"))
    head = "| part | " + " | ".join(str(y) for y in range(1992, 2003)) + " |"
    docs = rows.select("l_orderkey", F.concat_ws("\n", F.lit(head), F.lit("| --- |"), "ln").alias("text"))
    t = docs.select("l_orderkey", F.explode(C.table_rows(F.col("text"))).alias("r"))
    cells = F.filter(F.arrays_zip(F.slice("r.header", 2, 11).alias("h"), F.slice("r.cells", 2, 11).alias("c")),
                     lambda x: ~x["c"].isin("", "-"))
    v = t.select("l_orderkey", F.element_at("r.cells", 1).alias("label"), F.explode(cells).alias("x"))
    return v.groupBy("l_orderkey", "label", F.col("x.h").cast("long").alias("year")).agg(
        F.sum(F.col("x.c").cast("double")).alias("qty"), F.count(F.lit(1)).alias("n"))


@query("claim_extract", r"""
WITH e AS (SELECT item_id, lower(text) AS e FROM benchmark),
a AS (SELECT item_id, list_concat(list_concat(list_concat(regexp_extract_all(e, '(\d+(?:\.\d+)?%?)', 1), regexp_extract_all(e, '\b(\d+)\b', 1)),
        list_filter(['the', 'and'], lambda w: contains(e, w))),
        list_transform(list_filter(list_transform(regexp_split_to_array(e, '[,;]'), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13))),
              lambda p: length(p) >= 4 AND NOT regexp_full_match(p, '\d+')), lambda p: substr(p, 1, 40))) AS c FROM e),
u AS (SELECT item_id, unnest(c) AS claim, generate_subscripts(c, 1) AS i FROM a),
d AS (SELECT item_id, claim, min(i) AS i FROM u GROUP BY ALL),
r AS (SELECT item_id, claim, row_number() OVER (PARTITION BY item_id ORDER BY i) - 1 AS pos FROM d)
SELECT item_id, pos, claim FROM r WHERE pos < 8""")
def claim_extract(spark, sf):
    b = table(spark, sf, "benchmark")
    return b.select("item_id", F.posexplode(C.claims_of(F.col("text"), ("the", "and"))).alias("p", "claim")).select(
        "item_id", F.col("p").cast("long").alias("pos"), "claim")


@query("anchored_amount", r"""
WITH x AS (SELECT doc_id, CASE WHEN position('token' IN text) > 0 THEN nullif(regexp_extract(substr(text, position('token' IN text) + 5, 300), '([\d,]{7,})', 1), '') END AS a,
   CASE WHEN position('the' IN text) > 0 THEN nullif(regexp_extract(substr(text, position('the' IN text) + 3, 300), '([\d,]{7,})', 1), '') END AS b FROM documents)
SELECT doc_id, coalesce(a, b) AS amount FROM x WHERE coalesce(a, b) IS NOT NULL""")
def anchored_amount(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", C.anchored_amount(F.col("text"), ["token", "the"]).alias("amount")).filter("amount is not null")


@query("company_section_chunks", rf"""
WITH s AS (SELECT doc_id, source, string_split(text, chr(10)) AS ss FROM documents),
e AS (SELECT doc_id, source, unnest(ss) AS sec, generate_subscripts(ss, 1) - 1 AS pos FROM s)
SELECT doc_id, pos AS section_pos, md5(source || ' / ' || CAST(pos AS VARCHAR) || chr(10) || trim(sec, {WS})) AS text_md5
FROM e WHERE trim(sec, {WS}) <> ''""")
def company_section_chunks(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "sec"))
    return d.filter(strip(F.col("sec")) != "").select(
        "doc_id", F.col("pos").cast("long").alias("section_pos"),
        F.md5(F.concat("source", F.lit(" / "), F.col("pos").cast("string"), F.lit("\n"), strip(F.col("sec")))).alias("text_md5"))


QRULES = [(r"(?i)\bthe [a-z]{5,}", "fact", "What is said about %s?"),
          (r"(?i)\band [a-z]{6,}", "list", "Which items come with %s?"),
          (r"\d{3,}", "number", "What does the figure %s stand for?")]


@query("question_candidates", r"""
WITH p AS (SELECT doc_id, source, unnest(string_split(regexp_replace(regexp_replace(text, '([.?!])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1))) AS s FROM documents),
t AS (SELECT doc_id, trim(regexp_replace(s, '\s+', ' ', 'g')) AS s FROM p),
c AS (SELECT doc_id, s, kind, q FROM (SELECT doc_id, s, unnest([
   CASE WHEN regexp_matches(s, '(?i)\bthe [a-z]{5,}') THEN {'kind': 'fact', 'q': 'What is said about ' || lower(regexp_extract(s, '(?i)\bthe [a-z]{5,}', 0)) || '?'} END,
   CASE WHEN regexp_matches(s, '(?i)\band [a-z]{6,}') THEN {'kind': 'list', 'q': 'Which items come with ' || lower(regexp_extract(s, '(?i)\band [a-z]{6,}', 0)) || '?'} END,
   CASE WHEN regexp_matches(s, '\d{3,}') THEN {'kind': 'number', 'q': 'What does the figure ' || lower(regexp_extract(s, '\d{3,}', 0)) || ' stand for?'} END], recursive := true)
   FROM t WHERE length(s) >= 24) WHERE kind IS NOT NULL)
SELECT doc_id, kind, count(*) AS n, count(DISTINCT q) AS n_questions, min(md5(q)) AS lo, count(DISTINCT md5(kind || '|' || lower(s))) AS n_keys FROM c GROUP BY ALL""")
def question_candidates(spark, sf):
    d = table(spark, sf, "documents")
    c = C.question_candidates(d, "text", QRULES, ["doc_id"])
    return c.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("question").alias("n_questions"),
                                           F.min(F.md5("question")).alias("lo"), F.countDistinct("dedupe_key").alias("n_keys"))


@query("config_grid_runs", r"""
WITH g AS (SELECT c, r FROM (VALUES ('400/80'), ('900/150'), ('section')) a(c), (VALUES ('dense'), ('bm25'), ('hybrid')) b(r))
SELECT source, c || '|' || r AS config, CASE WHEN r = 'bm25' THEN 'lexical' ELSE 'default' END AS mode, count(*) AS n_docs
FROM documents, g GROUP BY ALL""")
def config_grid_runs(spark, sf):
    """Every configuration meets the per-source document counts, not the documents."""
    grid = C.config_grid(spark, {"chunking": ["400/80", "900/150", "section"], "retrieval": ["dense", "bm25", "hybrid"]},
                         [("retrieval", "bm25", "lexical")])
    cfg = [F.struct(F.concat_ws("|", F.lit(r["chunking"]), F.lit(r["retrieval"])).alias("config"), F.lit(r["mode"]).alias("mode"))
           for r in grid.collect()]
    per = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    return per.select("source", F.explode(F.array(*cfg)).alias("c"), "n_docs").select("source", "c.config", "c.mode", "n_docs")


LINES = rf"""e AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"""


@query("markdown_sections", rf"""WITH {LINES} SELECT doc_id, CASE WHEN pos = 0 THEN 'root' ELSE 'part' END AS title, count(*) AS n, min(md5(trim(s, {WS}))) AS lo, max(md5(trim(s, {WS}))) AS hi FROM e WHERE trim(s, {WS}) <> '' GROUP BY ALL""")
def markdown_sections(spark, sf):
    """Every line break of a document becomes a `## part` heading, then the headings are split again."""
    d = table(spark, sf, "documents").select("doc_id", F.explode(C.markdown_sections(F.regexp_replace(
        F.regexp_replace("text", r"(?m)^#", "\u0001"), "\n", "\n## part\n"))).alias("s"))
    b = F.replace("s.body", F.lit("\u0001"), F.lit("#"))
    return d.groupBy("doc_id", "s.title").agg(F.count(F.lit(1)).alias("n"), F.min(F.md5(b)).alias("lo"), F.max(F.md5(b)).alias("hi"))


@query("structured_sections", rf"""WITH {LINES}, h AS (SELECT doc_id, CASE WHEN pos = 0 THEN 'root' ELSE 'part' END AS title, trim(s, {WS}) AS body FROM e WHERE doc_id % 2 = 0 AND trim(s, {WS}) <> ''
 UNION ALL SELECT doc_id, 'root', trim(text, {WS}) FROM documents WHERE doc_id % 2 = 1 AND trim(text, {WS}) <> '') SELECT doc_id, title, count(*) AS n, min(md5(body)) AS lo FROM h GROUP BY ALL""")
def structured_sections(spark, sf):
    """HTML-born text by `## ` lines, plain text as one root section."""
    kind = F.when(F.col("doc_id") % 2 == 0, "html").otherwise("text")
    t = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\n## part\n"))).otherwise(F.col("text"))
    d = table(spark, sf, "documents").select("doc_id", F.explode(C.structured_sections(t, kind)).alias("s"))
    return d.groupBy("doc_id", "s.title").agg(F.count(F.lit(1)).alias("n"), F.min(F.md5("s.body")).alias("lo"))


@query("extracted_text_units", rf"""WITH {LINES}, t AS (SELECT doc_id, pos, trim(s, {WS}) AS s FROM e), n AS (SELECT *, CASE WHEN length(s) = 0 THEN 0 WHEN length(s) <= 900 THEN 1 ELSE 1 + CAST(ceil((length(s) - 900) / 750.0) AS BIGINT) END AS nw FROM t),
w AS (SELECT doc_id, pos, s, unnest(range(0, CAST(nw AS BIGINT))) AS k FROM n), u AS (SELECT doc_id, pos, k, trim(substr(s, k * 750 + 1, 900), {WS}) AS body FROM w)
SELECT doc_id, count(*) AS units, sum(length(body)) AS n_chars FROM u WHERE length(body) >= 40 GROUP BY doc_id""")
def extracted_text_units(spark, sf):
    """Metadata header stripped, split at section lines, windowed."""
    from dossier.functions.text import strip_header_lines
    t = F.concat(F.lit("record_id: x\ncompany: y\n"), F.col("text"))
    d = table(spark, sf, "documents").select("doc_id", "lang", strip_header_lines(t).alias("text"))
    u = C.evidence_units(d, "doc_id", "text", "lang", pattern="\n")
    return u.groupBy("doc_id").agg(F.count(F.lit(1)).alias("units"), F.sum(F.length("text")).alias("n_chars"))


CATALOG = [{"pattern": "licensed under", "fact": "license", "question": "Which license applies?", "blockers": None},
           {"pattern": "token", "fact": "secret", "question": "Which secret is shown?", "blockers": "%%%"},
           {"pattern": "tion", "fact": "action", "question": "What does the text describe?", "blockers": r"\|"}]


@query("fact_candidates", r"""
WITH p AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '([.?!])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1))) AS s FROM documents),
t AS (SELECT doc_id, trim(regexp_replace(s, '\s+', ' ', 'g')) AS s FROM p),
f AS (SELECT doc_id, s, CASE WHEN regexp_matches(lower(s), 'licensed under') THEN 'license' WHEN regexp_matches(lower(s), 'token') AND NOT regexp_matches(lower(s), '%%%') THEN 'secret' WHEN regexp_matches(lower(s), 'tion') AND NOT regexp_matches(lower(s), '\|') THEN 'action' END AS fact FROM t WHERE length(s) >= 40)
SELECT doc_id, fact, count(*) AS n, count_if(regexp_matches(lower(s), 'the |gnu') AND fact <> 'action') AS usable, count_if(regexp_matches(s, '\d')) AS numbered FROM f WHERE fact IS NOT NULL GROUP BY ALL""")
def fact_candidates(spark, sf):
    c = C.fact_candidates(table(spark, sf, "documents"), "text", ["doc_id"], CATALOG, "the |gnu", ["what does the text"])
    return c.groupBy("doc_id", "fact").agg(F.count(F.lit(1)).alias("n"), F.count_if("usable").alias("usable"), F.count_if("has_number").alias("numbered"))
