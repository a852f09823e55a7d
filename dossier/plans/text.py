"""Scalar text and number operators over whole tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from dossier.functions import numbers as N, signals as S, text as T
from dossier.operators.bounds import ordered_sum, spread
from dossier.plans.base import WS, query, sql_tokens, table

TOK = sql_tokens("text")


@query("token_stats", f"""SELECT doc_id, len({TOK}) AS n_tokens, len(list_distinct({TOK})) AS n_distinct,
 greatest(1, length(text) // 4) AS token_estimate FROM documents""")
def token_stats(spark, sf):
    d = table(spark, sf, "documents")
    t = T.tokenize(F.col("text"))
    return d.select("doc_id", F.size(t).cast("long").alias("n_tokens"),
                    F.size(F.array_distinct(t)).cast("long").alias("n_distinct"),
                    T.token_estimate(F.col("text")).alias("token_estimate"))


@query("token_unicode", r"""SELECT lang, sum(len(regexp_extract_all(lower(text), '([\p{L}\p{N}_]+)', 1))) AS n_tokens FROM documents GROUP BY lang""")
def token_unicode(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(
        F.sum(F.size(T.tokenize(F.col("text"), True))).alias("n_tokens"))


@query("bigram_token_stats", r"""SELECT lang, sum(len(regexp_extract_all(lower(text), '([a-z0-9]+|[가-힣]+)', 1))) AS n_tokens FROM documents GROUP BY lang""")
def bigram_token_stats(spark, sf):
    """Latin runs only in the driver texts; pairs of Hangul are covered by unit rows."""
    return table(spark, sf, "documents").groupBy("lang").agg(
        F.sum(F.size(T.bigram_tokens(F.col("text")))).alias("n_tokens"))


def turn_pairs(spark, sf):
    c = table(spark, sf, "conversations")
    u = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("q"))
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    return u.join(a, ["conv_id", "turn"])


PAIRS = """pairs AS (SELECT u.conv_id, u.turn, u.text AS q, a.text AS a FROM conversations u JOIN conversations a
  ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant')"""
TQ, TA = sql_tokens("q"), sql_tokens("a")


@query("turn_overlap", rf"""WITH {PAIRS}, t AS (SELECT conv_id, turn, list_distinct({TQ}) AS tq, list_distinct({TA}) AS ta,
  len(list_intersect(list_distinct(regexp_extract_all(lower(q), '([a-z]{{4,}})', 1)), list_distinct(regexp_extract_all(lower(a), '([a-z]{{4,}})', 1)))) AS long_words FROM pairs)
SELECT conv_id, turn, round(CASE WHEN len(tq) = 0 OR len(ta) = 0 THEN 0 ELSE len(list_intersect(tq, ta)) / len(tq) END, 6) AS containment,
  round(CASE WHEN len(tq) = 0 OR len(ta) = 0 THEN 0 ELSE 0.75 * len(list_intersect(tq, ta)) / len(tq)
   + 0.25 * len(list_intersect(tq, ta)) / greatest(10.0, sqrt(len(ta))) END, 6) AS overlap, long_words FROM t""")
def turn_overlap(spark, sf):
    p = turn_pairs(spark, sf)
    tq, ta = T.token_set(F.col("q")), T.token_set(F.col("a"))
    return p.select("conv_id", "turn", F.round(T.containment(tq, ta), 6).alias("containment"),
                    F.round(T.overlap_score(F.col("q"), F.col("a")), 6).alias("overlap"),
                    T.long_word_overlap(F.col("q"), F.col("a")).cast("long").alias("long_words"))


def _grams(c):
    b = f"regexp_replace({c}, '\\s+', '', 'g')"
    return (f"CASE WHEN length({b}) = 0 THEN [] WHEN length({b}) < 2 THEN [{b}] ELSE "
            f"list_distinct(list_transform(range(1, length({b})), lambda i: substr({b}, i, 2))) END")


@query("turn_bigrams", rf"""WITH {PAIRS}, g AS (SELECT conv_id, turn, {_grams('q')} AS gq, {_grams('a')} AS ga FROM pairs)
SELECT conv_id, turn, len(gq) AS n_grams, round(CASE WHEN len(gq) = 0 OR len(ga) = 0 THEN 0 ELSE len(list_intersect(gq, ga)) / len(gq) END, 6) AS containment FROM g""")
def turn_bigrams(spark, sf):
    p = turn_pairs(spark, sf).select("conv_id", "turn", T.char_ngrams(F.col("q")).alias("gq"), T.char_ngrams(F.col("a")).alias("ga"))
    return p.select("conv_id", "turn", F.size("gq").cast("long").alias("n_grams"),
                    F.round(T.containment(F.col("gq"), F.col("ga")), 6).alias("containment"))


@query("qc_overlap_turns", rf"""WITH {PAIRS}, t AS (SELECT conv_id, turn, list_distinct({TQ}) AS tq, list_distinct({TA}) AS ta, {_grams('q')} AS gq, {_grams('a')} AS ga FROM pairs)
SELECT conv_id, turn, round(CASE WHEN len(tq) > 0 AND len(ta) > 0 THEN len(list_intersect(tq, ta)) / len(tq)
  WHEN len(gq) > 0 AND len(ga) > 0 THEN len(list_intersect(gq, ga)) / len(gq) ELSE 0 END, 6) AS overlap FROM t""")
def qc_overlap_turns(spark, sf):
    return turn_pairs(spark, sf).select("conv_id", "turn", F.round(T.qc_overlap(F.col("q"), F.col("a")), 6).alias("overlap"))


@query("best_snippet_turns", rf"""WITH {PAIRS}, n AS (SELECT conv_id, turn, trim(regexp_replace(a, '\s+', ' ', 'g'), {WS}) AS t,
   list_distinct(regexp_extract_all(lower(q), '([a-z0-9À-ɏ]+)', 1)) AS hs FROM pairs),
s AS (SELECT conv_id, turn, t, hs, string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM n),
e AS (SELECT conv_id, turn, t, hs, unnest(ss) AS x, generate_subscripts(ss, 1) AS i FROM s),
r AS (SELECT conv_id, turn, t, i, x, CASE WHEN length(x) < 12 THEN 0 ELSE len(list_intersect(hs, list_distinct(regexp_extract_all(lower(x), '([a-z0-9À-ɏ]+)', 1)))) END AS ov FROM e),
b AS (SELECT conv_id, turn, any_value(t) AS t, max(ov) AS ov, arg_max(x, ov * 100000 - i) AS x FROM r GROUP BY ALL)
SELECT conv_id, turn, md5(CASE WHEN length(t) <= 320 THEN t WHEN ov > 0 THEN substr(x, 1, 320) ELSE substr(t, 1, 320) END) AS snippet_md5 FROM b""")
def best_snippet_turns(spark, sf):
    return turn_pairs(spark, sf).select("conv_id", "turn", F.md5(T.best_snippet(F.col("a"), F.col("q"))).alias("snippet_md5"))


@query("norm_phrase", rf"""SELECT doc_id, md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g'), {WS}))) AS norm_md5 FROM documents""")
def norm_phrase(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.norm_ws(F.col("text"), lower=True)).alias("norm_md5"))


def _sql_unescape(c):
    for n, ch in T.NAMED_ENTITIES:
        c = f"replace({c}, '{n}', '{ch.replace(chr(39), chr(39) * 2)}')"
    return c


@query("normalise_flags", rf"""WITH t AS (SELECT page_id, html AS text,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_sql_unescape('html')}, '<!--.*?-->|</?(?:image|table|tr|td|th|div|span|p|br)\b[^>]*>', ' ', 'gis'), '\|{{2,}}', ' | ', 'g'), '-{{5,}}', ' ', 'g'), '\s+', ' ', 'g'), {WS}) AS cleaned FROM pages)
SELECT page_id, length(text) AS raw_chars, length(cleaned) AS normalized_chars, md5(cleaned) AS cleaned_md5,
 array_to_string(list_filter([CASE WHEN contains(text, 'â€') OR contains(text, 'Â') THEN 'mojibake_bullet' END,
   CASE WHEN contains(text, '&amp;') OR contains(text, '&lt;') OR contains(text, '&gt;') THEN 'html_entity' END,
   CASE WHEN contains(text, '<!--') OR contains(lower(text), '<image') THEN 'html_residue' END], lambda x: x IS NOT NULL), ',') AS fixes FROM t""")
def normalise_flags(spark, sf):
    p = table(spark, sf, "pages")
    c = T.normalize_corpus_text(F.col("html"))
    return p.select("page_id", F.length("html").cast("long").alias("raw_chars"), F.length(c).cast("long").alias("normalized_chars"),
                    F.md5(c).alias("cleaned_md5"), F.array_join(T.normalization_flags(F.col("html")), ",").alias("fixes"))


@query("normalise_fix_counts", r"""WITH f AS (SELECT unnest([CASE WHEN contains(html, '&amp;') OR contains(html, '&lt;') OR contains(html, '&gt;') THEN 'html_entity' END,
  CASE WHEN contains(html, '<!--') OR contains(lower(html), '<image') THEN 'html_residue' END,
  CASE WHEN contains(html, 'â€') OR contains(html, 'Â') THEN 'mojibake_bullet' END]) AS fix FROM pages)
SELECT fix, count(*) AS n FROM f WHERE fix IS NOT NULL GROUP BY fix""")
def normalise_fix_counts(spark, sf):
    return table(spark, sf, "pages").select(F.explode(T.normalization_flags(F.col("html"))).alias("fix")).groupBy(
        "fix").agg(F.count(F.lit(1)).alias("n"))


TIERS = [("example.org", "public"), ("/en/", "english"), ("/fr/", "french")]


@query("path_metadata", r"""WITH p AS (SELECT page_id, lower(regexp_replace(replace(url, chr(92), '/'), '/+', '/', 'g')) AS path FROM pages)
SELECT page_id, path, CASE WHEN contains(path, 'example.org') THEN 'public' WHEN contains(path, '/en/') THEN 'english' WHEN contains(path, '/fr/') THEN 'french' ELSE 'other' END AS tier,
 greatest(10, CASE WHEN contains(path, 'https') THEN 60 ELSE 10 END, CASE WHEN contains(path, '.org') THEN 80 ELSE 10 END) AS trust,
 regexp_replace(regexp_replace(path, '[^a-z0-9가-힣]+', '-', 'g'), '^-+|-+$', '', 'g') AS document_id FROM p""")
def path_metadata(spark, sf):
    p = table(spark, sf, "pages").select("page_id", T.normalize_path(F.col("url")).alias("path"))
    return p.select("page_id", "path", S.path_tier(F.col("path"), TIERS).alias("tier"),
                    S.source_rank(F.col("path"), [("https", 60), (".org", 80)]).cast("long").alias("trust"),
                    T.sql_like_slug(F.col("path")).alias("document_id"))


@query("path_nfkc", r"""SELECT page_id, nfc_normalize(lower(regexp_replace(url, '/+', '/', 'g'))) AS path FROM pages""")
def path_nfkc(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.normalize_path(F.col("url"), unicode_form=True).alias("path"))


@query("question_metric", r"""WITH q AS (SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) || ' ' || o_orderpriority || ' / ' || o_orderstatus || ' / total price (usd)' AS q, o_orderdate FROM orders)
SELECT o_orderkey, trim(split_part(trim(split_part(q, '/', 3)), '(', 1)) AS metric, year(o_orderdate) AS first_year,
  CASE WHEN year(o_orderdate) BETWEEN 2015 AND 2035 THEN year(o_orderdate) ELSE -1 END AS year,
  trim(regexp_replace(lower(q), '[^a-z0-9가-힣]+', '_', 'g'), '_') AS slug FROM q WHERE year(o_orderdate) >= 2000
UNION ALL SELECT o_orderkey, trim(split_part(trim(split_part(q, '/', 3)), '(', 1)), NULL, -1, trim(regexp_replace(lower(q), '[^a-z0-9가-힣]+', '_', 'g'), '_') FROM q WHERE year(o_orderdate) < 2000""")
def question_metric(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(
        F.year("o_orderdate").cast("string"), F.lit(" "), "o_orderpriority", F.lit(" / "), "o_orderstatus", F.lit(" / total price (usd)")).alias("q"))
    return o.select("o_orderkey", N.metric_from_question(F.col("q")).alias("metric"), N.first_year(F.col("q")).cast("long").alias("first_year"),
                    N.infer_year(F.col("q"), F.lit(-1)).cast("long").alias("year"), N.slug(F.col("q")).alias("slug"))


@query("kv_parse", r"""SELECT l_orderkey, l_linenumber, l_partkey AS part, CAST(l_quantity AS BIGINT) AS qty, count(*) AS n FROM lineitem GROUP BY ALL""")
def kv_parse(spark, sf):
    """Order lines as `k=v | k=v` text, parsed back; the repeated key keeps its last value."""
    li = spread(table(spark, sf, "lineitem"))
    line = F.concat_ws(" | ", F.concat(F.lit("part=0")), F.concat(F.lit("part = "), F.col("l_partkey").cast("string")),
                       F.concat(F.lit("qty="), F.format_string("%,d", F.col("l_quantity").cast("long"))), F.lit("note"))
    kv = li.select("l_orderkey", "l_linenumber", N.kv_pairs(line).alias("m"))
    return kv.select("l_orderkey", "l_linenumber", N.to_int(F.col("m")["part"]).alias("part"),
                     N.to_int(F.col("m")["qty"]).alias("qty")).groupBy("l_orderkey", "l_linenumber", "part", "qty").agg(
        F.count(F.lit(1)).alias("n"))


@query("period_offset", r"""WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, round(sum(o_totalprice)) AS v FROM orders GROUP BY ALL),
m AS (SELECT o_custkey, max(y) AS doc_year FROM y GROUP BY ALL),
r AS (SELECT y.o_custkey, y, v, doc_year, row_number() OVER (PARTITION BY y.o_custkey ORDER BY y DESC) - 1 AS off, count(*) OVER (PARTITION BY y.o_custkey) AS n FROM y JOIN m USING (o_custkey))
SELECT o_custkey, CAST(v AS BIGINT) AS value FROM r WHERE off = least(2, n - 1)""")
def period_offset(spark, sf):
    """Yearly sums rendered as period fields; the value two terms back, or the oldest."""
    y = ordered_sum(table(spark, sf, "orders").withColumn("y", F.year("o_orderdate")), ["o_custkey", "y"], "o_totalprice", "o_orderkey", "v").withColumn(
        "v", F.round("v"))
    doc = y.groupBy("o_custkey").agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("term "), F.col("y").cast("string")),
                                                   F.concat(F.format_string("%,d", F.col("v").cast("long")), F.lit(" KRW"))))).alias("m"),
        F.max("y").alias("doc_year"))
    return doc.select("o_custkey", N.period_value(F.col("m"), F.col("doc_year") - 2, F.col("doc_year")).cast("long").alias("value"))


@query("numbers_in_text", r"""WITH n AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '(-?[\d,]+(?:\.\d+)?)', 1), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE)), lambda v: v IS NOT NULL) AS ns FROM documents)
SELECT doc_id, len(ns) AS n, list_max(ns) AS largest, ns[1] AS first_number FROM n WHERE len(ns) > 0""")
def numbers_in_text(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", N.numbers_in_text(F.col("text")).alias("ns"))
    return d.filter(F.size("ns") > 0).select("doc_id", F.size("ns").cast("long").alias("n"), F.array_max("ns").alias("largest"),
                                             F.get("ns", F.lit(0)).alias("first_number"))


@query("number_format", r"""SELECT l_orderkey, l_linenumber, printf('%.1f', l_discount * 100) AS pct, CAST(CAST(round_even(l_extendedprice, 0) AS BIGINT) AS VARCHAR) AS mil,
  CASE WHEN l_quantity = floor(l_quantity) THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE 'x' END AS num,
  regexp_replace(regexp_replace(printf('%.6f', l_tax), '0+$', ''), '\.$', '') AS tax, count(*) AS n FROM lineitem WHERE l_tax > 0 GROUP BY ALL
 UNION ALL SELECT l_orderkey, l_linenumber, printf('%.1f', l_discount * 100), CAST(CAST(round_even(l_extendedprice, 0) AS BIGINT) AS VARCHAR), CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), '0', count(*) FROM lineitem WHERE l_tax = 0 GROUP BY ALL""")
def number_format(spark, sf):
    li = table(spark, sf, "lineitem")
    f = lambda c, u: N.format_number(c, F.lit(u))
    return li.select("l_orderkey", "l_linenumber", f(F.col("l_discount") * 100, "%").alias("pct"), f(F.col("l_extendedprice"), "million").alias("mil"),
                     f(F.col("l_quantity"), "each").alias("num"), f(F.col("l_tax"), "rate").alias("tax")).groupBy(
        "l_orderkey", "l_linenumber", "pct", "mil", "num", "tax").agg(F.count(F.lit(1)).alias("n"))


@query("value_equivalence", r"""WITH p AS (SELECT o_orderkey, o_totalprice AS x, o_totalprice / 1000 * (1 + (o_orderkey % 4) * 0.0007) AS y, o_totalprice + (o_orderkey % 3) * 0.06 AS z FROM orders)
SELECT o_orderkey, (o_orderkey % 4) < 2 AS fuzzy_equal, abs(x - z) <= 0.15 AS pct_close, abs(x - z) <= 0.05 AS plain_close, abs(x - z) <= 0.01 AS policy_equal FROM p""")
def value_equivalence(spark, sf):
    """Prices against rescaled, shifted and reformatted copies of themselves."""
    o = table(spark, sf, "orders")
    k, x = F.col("o_orderkey"), F.col("o_totalprice")
    a = F.concat(F.format_string("%,.2f", x), F.lit(" USD"))
    y = F.format_string("%.8f", x / 1000 * (1 + (k % 4) * 0.0007))
    z = x + (k % 3) * 0.06
    return o.select("o_orderkey", N.numeric_values_equivalent(a, y).alias("fuzzy_equal"),
                    N.close_enough(x, z, F.lit("%")).alias("pct_close"), N.close_enough(x, z, F.lit("each")).alias("plain_close"),
                    N.policy_equivalent(F.format_string("%,.2f", x), F.format_string("%.2f", z)).alias("policy_equal"))


@query("canonical_values", r"""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'esg_grade_a_plus' WHEN p_size % 5 = 1 THEN 'scope_3' WHEN p_size % 5 = 2 THEN 'year:20' || lpad(CAST(p_size AS VARCHAR), 2, '0')
  WHEN p_size % 5 = 3 THEN CAST(p_size * 1000 AS VARCHAR) ELSE 'econ' END AS canonical,
  CASE WHEN p_size % 5 IN (0, 1, 4) THEN 'text' ELSE 'numeric' END AS vtype FROM part""")
def canonical_values(spark, sf):
    s = F.col("p_size")
    v = (F.when(s % 5 == 0, " A+ ").when(s % 5 == 1, "Scope  3").when(s % 5 == 2, F.concat(F.lit("20"), F.lpad(s.cast("string"), 2, "0")))
         .when(s % 5 == 3, F.format_string("%,d", s * 1000)).otherwise("Economy  Type"))
    return table(spark, sf, "part").select("p_partkey", N.canonical_value(v, {"economy type": "econ"}).alias("canonical"),
                                           N.value_type(v).alias("vtype"))


@query("unit_targets", r"""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'USD million' WHEN p_size % 3 = 1 THEN 'USD billion' ELSE p_brand END AS scaled,
 CASE WHEN p_size % 4 = 0 THEN p_brand WHEN p_size % 4 = 1 THEN '%' WHEN p_size % 4 = 2 THEN 'count' ELSE 'currency' END AS target,
 CASE WHEN p_type = 'ECONOMY' THEN 'eco' ELSE lower(p_type) END AS alias, CAST(p_size * 1000 AS VARCHAR) AS core,
 CASE WHEN contains(lower(p_name), split_part(lower(p_name), ' ', 2)) THEN 'item:' || split_part(p_name, ' ', 2) END AS label_key FROM part""")
def unit_targets(spark, sf):
    s = F.col("p_size")
    q = F.when(s % 4 == 1, "what share").when(s % 4 == 2, "how many parts").otherwise("what is the price")
    return table(spark, sf, "part").select(
        "p_partkey", N.scale_unit(F.when(s % 3 == 0, " Mil").when(s % 3 == 1, "billion").otherwise(F.col("p_brand"))).alias("scaled"),
        N.target_unit(q, F.when(s % 4 == 0, F.col("p_brand")).otherwise("-")).alias("target"),
        N.unit_alias(F.col("p_type"), {"economy": "eco"}).alias("alias"),
        N.numeric_core(F.concat(F.format_string("%,d", s * 1000), F.lit(" tCO2e"))).alias("core"),
        N.metric_label_key(F.concat(F.col("p_name"), F.lit(" 2024")), F.split_part("p_name", F.lit(" "), F.lit(2))).alias("label_key"))


@query("field_numbers", r"""SELECT l_orderkey, l_linenumber, sum(CAST(l_extendedprice AS DOUBLE)) AS v, count(*) FILTER (WHERE l_extendedprice > 50000) AS rejected FROM lineitem GROUP BY ALL""")
def field_numbers(spark, sf):
    li = table(spark, sf, "lineitem")
    raw = F.concat(F.lit("about "), F.format_string("%,.2f", F.col("l_extendedprice")), F.lit(" usd"))
    v, why = N.field_number_checked(raw, hi=50000)
    return li.select("l_orderkey", "l_linenumber", N.field_number(raw).alias("v"), why.alias("w")).groupBy(
        "l_orderkey", "l_linenumber").agg(F.round(F.sum("v"), 2).alias("v"), F.count("w").alias("rejected"))


@query("split_answers", r"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice, 2) END AS gold_num, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS gold_text,
  o_orderstatus = 'O' AS is_not_disclosed, CASE WHEN o_orderstatus = 'F' THEN 'quantitative' WHEN o_orderstatus = 'P' THEN 'qualitative' ELSE 'yes_no' END AS qtype FROM orders""")
def split_answers(spark, sf):
    st = F.col("o_orderstatus")
    v = F.when(st == "F", F.format_string("%,.2f", F.col("o_totalprice"))).when(st == "P", F.col("o_orderpriority")).otherwise("yes")
    return table(spark, sf, "orders").select(
        "o_orderkey", N.split_answer(v, F.when(st == "O", "Not disclosed")).alias("g"),
        N.question_type(v, F.lit(None).cast("string")).alias("qtype")).select("o_orderkey", "g.*", "qtype")


@query("content_ids", rf"""SELECT doc_id, md5(source || '_' || CAST(doc_id AS VARCHAR) || '_' || text) AS chunk_id,
 md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g'), {WS}))) AS fp,
 array_to_string(list_concat(list_slice(regexp_extract_all(lower(text), '([a-z]{{5,}})', 1), 1, 6), list_slice(regexp_extract_all(text, '(\d+(?:\.\d+)?)', 1), 1, 5)), '|') AS cluster_fp FROM documents""")
def content_ids(spark, sf):
    d = table(spark, sf, "documents")
    t = F.col("text")
    return d.select("doc_id", T.content_id(F.col("source"), F.col("doc_id"), t).alias("chunk_id"),
                    T.text_fingerprint(t).alias("fp"), T.cluster_fingerprint(t).alias("cluster_fp"))


@query("token_cost", r"""SELECT source, sum(greatest(1, length(text) // 4)) AS tokens, round(sum(greatest(1, length(text) // 4)) / 1e6 * 0.02, 6) AS cost FROM documents GROUP BY source""")
def token_cost(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.sum(T.token_estimate(F.col("text"))).alias("tokens")).withColumn(
        "cost", F.round(F.col("tokens") / 1e6 * 0.02, 6))


HINTS = [(("that ",), ("Annual Report", "total"), 0.1), (("from",), ("total", "table"), 0.2)]


@query("query_expand", r"""WITH q AS (SELECT item_id, text, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS l FROM benchmark),
e AS (SELECT item_id, text, l, CASE WHEN contains(l, 'that ') AND contains(l, 'from') THEN 'annual report total table' WHEN contains(l, 'that ') THEN 'annual report total' WHEN contains(l, 'from') THEN 'total table' ELSE '' END AS x FROM q)
SELECT item_id, md5(CASE WHEN x = '' THEN text ELSE text || ' ' || x END) AS expanded_md5,
  md5(CASE WHEN contains(text, 'the') THEN replace(substr(text, 1, position('the' IN text) + 2), 'the', 'Acme') || substr(text, position('the' IN text) + 3) ELSE text END) AS rewritten_md5 FROM e""")
def query_expand(spark, sf):
    b = table(spark, sf, "benchmark")
    t = F.col("text")
    return b.select("item_id", F.md5(T.expand_query(t, HINTS)).alias("expanded_md5"),
                    F.md5(T.rewrite_for_company(t, F.lit("Acme"), ("the",), ("(?!x)x",))).alias("rewritten_md5"))


@query("metric_intents", r"""WITH q AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
w AS (SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)(^|\s)(rate|share|aux)\s|%') THEN 'percentage' WHEN regexp_matches(text, '(?i)(^|\s)(number|count|the)\s') THEN 'count' END AS kind,
  regexp_extract_all(lower(text), '([a-z가-힣]{4,})', 1) AS ws,
  NOT regexp_matches(text, '(?i)salary|wage') AND (regexp_matches(text, '(?i)headcount') OR regexp_matches(text, '(?i)\s(und|and)\s')) AS headcount FROM q),
u AS (SELECT conv_id, turn, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
d AS (SELECT conv_id, turn, x, min(i) AS i FROM u GROUP BY ALL),
s AS (SELECT conv_id, turn, string_agg(x, ',' ORDER BY i) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS r FROM d) WHERE r <= 6 GROUP BY ALL)
SELECT w.conv_id, w.turn, kind, coalesce(terms, '') AS terms, headcount FROM w LEFT JOIN s ON w.conv_id = s.conv_id AND w.turn = s.turn""")
def metric_intents(spark, sf):
    c = table(spark, sf, "conversations").filter("role = 'user'")
    t = F.col("text")
    return c.select("conv_id", "turn", S.metric_intent(t, r"(?i)(^|\s)(rate|share|aux)\s|%", r"(?i)(^|\s)(number|count|the)\s").alias("m"),
                    S.headcount_intent(t, "(?i)salary|wage", "(?i)headcount", r"(?i)\s(und|and)\s").alias("headcount")).select(
        "conv_id", "turn", "m.kind", F.array_join("m.terms", ",").alias("terms"), "headcount")


@query("sentence_scores", r"""WITH p AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([.?!])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)) AS ss FROM documents),
e AS (SELECT doc_id, trim(regexp_replace(unnest(ss), '\s+', ' ', 'g')) AS s, generate_subscripts(ss, 1) AS i FROM p),
k AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM e WHERE length(s) >= 24),
r AS (SELECT doc_id, s, pos, CASE WHEN regexp_matches(lower(s), 'token|licen') THEN 3 ELSE 0 END
  + CASE WHEN len(regexp_extract_all(s, '\b20\d{2}\b')) >= 2 THEN 4 WHEN len(regexp_extract_all(s, '\b20\d{2}\b')) = 1 THEN 2 ELSE 0 END
  + CASE WHEN len(regexp_extract_all(s, '\d+(?:\.\d+)?')) >= 2 THEN 3 WHEN len(regexp_extract_all(s, '\d+(?:\.\d+)?')) = 1 THEN 1 ELSE 0 END
  + 2 * (CAST(contains(lower(s), 'tion') AS INT) + CAST(contains(lower(s), 'the ') AS INT)) - CASE WHEN regexp_matches(lower(s), '[|$%]') THEN 5 ELSE 0 END AS score FROM k),
t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rk FROM r)
SELECT doc_id, rk AS rank, score, pos, md5(s) AS sentence_md5 FROM t WHERE rk <= 2""")
def sentence_scores(spark, sf):
    d = table(spark, sf, "documents")
    score = lambda s: S.sentence_score(s, "token|licen", ["tion", "the "], "[|$%]")
    sents = F.filter(F.transform(F.split("text", r"(?<=[.?!])\s+|\n+"), lambda s: T.norm_ws(s)), lambda s: F.length(s) >= 24)
    return d.select("doc_id", F.posexplode(S.best_sentences(sents, score)).alias("i", "b")).select(
        "doc_id", (F.col("i") + 1).cast("long").alias("rank"), (-F.col("b.neg")).cast("long").alias("score"),
        F.col("b.pos").cast("long").alias("pos"), F.md5("b.s").alias("sentence_md5"))


@query("disclosure_cleanup", rf"""WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, 'This work is licensed[^.]*\.', ' ', 'g'), '(?i)token = \S+', ' ', 'g'), '\s+', ' ', 'g'), {WS}) AS t FROM documents),
s AS (SELECT doc_id, t, list_filter(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(x) >= 24 AND NOT contains(lower(x), '%%%') AND NOT contains(lower(x), '|')) AS g FROM t)
SELECT doc_id, md5(CASE WHEN length(t) <= 400 THEN t ELSE coalesce(g[1], t) END) AS cleaned_md5 FROM s""")
def disclosure_cleanup(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(S.clean_disclosure(
        F.col("text"), [r"This work is licensed[^.]*\.", r"(?i)token = \S+"], ["%%%", "|"])).alias("cleaned_md5"))


@query("quality_scores", r"""SELECT doc_id, round(greatest(0.0::DOUBLE, 1.0 - len(regexp_extract_all(text, '[^a-zA-Z0-9_\s.,;:!?''-]')) / greatest(length(text), 1) * 5.0 - len(regexp_extract_all(text, '\|')) / greatest(length(text), 1) * 10.0), 6) AS cleanliness,
 round(least(len(regexp_extract_all(text, '\d+(?:\.\d+)?')), 4) * 1.0::DOUBLE + least(len(regexp_extract_all(text, '[A-Z][a-z]{3,}')), 4) * 0.5 + CASE WHEN length(text) BETWEEN 40 AND 400 THEN 1.5 ELSE 0 END
  - (CAST(contains(lower(source), 'src1') AS INT)), 6) AS specificity FROM documents""")
def quality_scores(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.round(S.cleanliness(F.col("text")), 6).alias("cleanliness"),
                    F.round(S.specificity(F.col("source"), F.col("text"), ["src1"]), 6).alias("specificity"))
