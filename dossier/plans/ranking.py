"""Retrieval queries: benchmark items against document chunks and vectors."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dossier.functions import signals as S, text as T
from dossier.operators import chunking as C, joins as J, ranking as R
from dossier.operators.bounds import broadcast_if_small, top_k
from dossier.retrieval import answer, ingest
from dossier.session import checkpoint_dir, materialise
from dossier.plans.base import WS, query, sql_bm25, sql_char_chunks, sql_tokens, table

KEY = ["doc_id", "chunk_id"]
TEXT_SQL = f"trim(substr(d.text, chunk_id * 750 + 1, 900), {WS})"


def corpus(spark, sf):
    return C.chunk_chars(table(spark, sf, "documents").select("doc_id", "source", "lang", "text"))


def items(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def scores(spark, sf):
    return R.lexical_scores(corpus(spark, sf), items(spark, sf), KEY)


def hits(spark, sf, k, bm25_weight=1.0, overlap_weight=0.0, vocab=None):
    return R.lexical_topk(corpus(spark, sf), items(spark, sf), KEY, k, bm25_weight, overlap_weight, vocab=vocab)


def corpus_vocabulary(spark, sf):
    """Counted once for the queries that score the corpus twice."""
    return materialise(R.text_vocabulary(corpus(spark, sf), "text"))


def with_text(spark, sf, h):
    """Chunk text for the hits only: the hits, at most k a query, go to the documents where they lie."""
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", F.col("text").alias("_t"))
    return d.join(broadcast_if_small(materialise(h)), "doc_id").withColumn("text", T.strip(F.substring(
        F.col("_t"), (F.col("chunk_id") * 750 + 1).cast("int"), F.lit(900)))).drop("_t")


ITEMS_SQL = "SELECT item_id AS query_id, text FROM benchmark"
BM = "WITH " + sql_bm25(sql_char_chunks(), ITEMS_SQL)


def rk(score="bm25", src="scored", name="rk"):
    return (f", {name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round({score}, 9) DESC, doc_id, chunk_id) AS rank FROM {src})")


def mm(c, part="query_id"):
    w = f"OVER (PARTITION BY {part})"
    return (f"CASE WHEN {c} IS NULL THEN NULL WHEN max({c}) {w} - min({c}) {w} < 1e-9 THEN 1.0::DOUBLE ELSE ({c} - min({c}) {w}) / (max({c}) {w} - min({c}) {w}) END")


@query("corpus_statistics", "WITH " + sql_bm25(sql_char_chunks(), ITEMS_SQL) + """
SELECT any_value(n) AS n_chunks, round(any_value(avgdl), 6) AS avgdl, (SELECT count(*) FROM dfq) AS vocabulary,
 round(any_value(mean_idf), 6) AS mean_idf, (SELECT count(*) FROM ri WHERE idf < 0) AS n_negative FROM st CROSS JOIN mi""")
def corpus_statistics(spark, sf):
    v = R.term_weights(materialise(R.vocabulary(R.tokenized(corpus(spark, sf), KEY, "text"))))
    return v.filter("term <> ''").agg(F.first("n").alias("n_chunks"), F.round(F.first("avgdl"), 6).alias("avgdl"),
                                      F.count(F.lit(1)).alias("vocabulary"), F.round(F.first("mean_idf"), 6).alias("mean_idf"),
                                      F.count_if(F.col("raw") < 0).alias("n_negative"))


@query("bm25_topk", BM + rk() + "SELECT query_id, rank, doc_id, chunk_id, round(bm25, 6) AS score FROM rk WHERE rank <= 5")
def bm25_topk(spark, sf):
    return hits(spark, sf, 5).select("query_id", F.col("rank").cast("long").alias("rank"), *KEY, F.round("bm25", 6).alias("score"))


def index_path(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("index_topk", BM + rk() + "SELECT query_id, rank, doc_id, chunk_id, round(bm25, 6) AS score FROM rk WHERE rank <= 5")
def index_topk(spark, sf):
    """Build the stored index, open it again and search it."""
    path = index_path(spark, "index")
    R.build_index(corpus(spark, sf), KEY, path)
    return R.lexical_topk(R.load_index(spark, path), items(spark, sf), KEY, 5).select(
        "query_id", F.col("rank").cast("long").alias("rank"), *KEY, F.round("bm25", 6).alias("score"))


@query("index_postings", BM + rk() + "SELECT query_id, rank, doc_id, chunk_id, round(bm25, 6) AS score FROM rk WHERE rank <= 5")
def index_postings(spark, sf):
    """One index, two uses: the postings join over it gives the rows of the matrix path."""
    ix = R.build_index(corpus(spark, sf), KEY, index_path(spark, "index"))
    return R.lexical_topk(ix, items(spark, sf), KEY, 5, max_cells=0).select(
        "query_id", F.col("rank").cast("long").alias("rank"), *KEY, F.round("bm25", 6).alias("score"))


@query("bm25_postings_join", BM + rk() + "SELECT query_id, rank, doc_id, chunk_id, round(bm25, 6) AS score, round(overlap, 6) AS overlap FROM rk WHERE rank <= 5")
def bm25_postings_join(spark, sf):
    """The path for query sets beyond the broadcast bound: postings joined with the query terms."""
    return R.lexical_topk(corpus(spark, sf), items(spark, sf), KEY, 5, max_cells=0).select(
        "query_id", F.col("rank").cast("long").alias("rank"), *KEY, F.round("bm25", 6).alias("score"), F.round("overlap", 6).alias("overlap"))


@query("bm25_pool", BM + rk() + f", p AS (SELECT * FROM rk WHERE rank <= 24) SELECT query_id, doc_id, chunk_id, round({mm('bm25')}, 6) AS score FROM p")
def bm25_pool(spark, sf):
    return R.bm25_pool(corpus(spark, sf), items(spark, sf), KEY).select("query_id", *KEY, F.round("score", 6).alias("score"))


LANG_SQL = "SELECT item_id AS query_id, ['en', 'fr', 'de', 'es'][item_id % 4 + 1] AS lang, text FROM benchmark"


@query("bm25_by_tenant", "WITH " + sql_bm25(sql_char_chunks(), LANG_SQL, tenant="lang") + rk() +
       "SELECT query_id, rank, doc_id, chunk_id, round(bm25, 6) AS score FROM rk WHERE rank <= 5")
def bm25_by_tenant(spark, sf):
    """One set of statistics per tenant; the language plays the tenant."""
    q = items(spark, sf).withColumn("lang", F.element_at(
        F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")]), (F.col("query_id") % 4 + 1).cast("int")))
    return R.lexical_topk(corpus(spark, sf), q, KEY, 5, tenant="lang").select(
        "query_id", F.col("rank").cast("long").alias("rank"), *KEY, F.round("bm25", 6).alias("score"))


@query("unit_scores", BM + ", s AS (SELECT *, 0.6 * bm25 + 0.4 * overlap AS score FROM scored)" + rk("score", "s") +
       "SELECT query_id, rank, doc_id, chunk_id, round(score, 6) AS score FROM rk WHERE rank <= 48")
def unit_scores(spark, sf):
    return hits(spark, sf, 48, 0.6, 0.4).select(
        "query_id", F.col("rank").cast("long").alias("rank"), *KEY, F.round("score", 6).alias("score"))


BOOSTS = [("src1", 0.22), ("src13", 0.1), ("src7", -0.35)]
BOOST_SQL = "(CASE WHEN contains(d.source, 'src1') THEN 0.22 ELSE 0 END + CASE WHEN contains(d.source, 'src13') THEN 0.1 ELSE 0 END + CASE WHEN contains(d.source, 'src7') THEN -0.35 ELSE 0 END)"


def boosted(spark, sf, k, bm25_weight, overlap_weight):
    """Top k with a per-source rule boost added to the score."""
    from dossier.functions.rules import weight_sum
    c = corpus(spark, sf).withColumn("boost", weight_sum(F.col("source"), BOOSTS, regex=False))
    return R.lexical_topk(c, items(spark, sf), KEY, k, bm25_weight, overlap_weight, boost="boost")


@query("lexical_boosted", BM + f", s AS (SELECT s.*, 0.55 * bm25 + 0.25 * overlap + {BOOST_SQL} AS score FROM scored s JOIN documents d USING (doc_id))" +
       rk("score", "s") + "SELECT query_id, rank, doc_id, chunk_id, round(score, 6) AS score FROM rk WHERE rank <= 5")
def lexical_boosted(spark, sf):
    pool = boosted(spark, sf, 32, 0.55, 0.25).drop("rank")
    return R.ranked(pool, "query_id", "score", KEY, 5).select(
        "query_id", F.col("rank").cast("long").alias("rank"), *KEY, F.round("score", 6).alias("score"))


@query("overlap_retrieval", BM + f", s AS (SELECT s.*, greatest(0.0, overlap + {BOOST_SQL}) AS score FROM scored s JOIN documents d USING (doc_id))" +
       ", p AS (SELECT * FROM s WHERE score > 0)" + rk("score", "p") +
       """SELECT query_id, rank, doc_id, chunk_id, round(score, 6) AS score, max(score) OVER (PARTITION BY query_id) < 0.23 AS insufficient,
 CASE WHEN max(score) OVER (PARTITION BY query_id) >= 0.45 THEN 'high' WHEN max(score) OVER (PARTITION BY query_id) >= 0.28 THEN 'medium' ELSE 'low' END AS confidence FROM rk WHERE rank <= 5""")
def overlap_retrieval(spark, sf):
    from pyspark.sql import Window
    s = boosted(spark, sf, 5, 0.0, 1.0).filter("score > 0")
    best = F.max("score").over(Window.partitionBy("query_id"))
    return s.select(
        "query_id", F.col("rank").cast("long").alias("rank"), *KEY, F.round("score", 6).alias("score"),
        (best < 0.23).alias("insufficient"), S.confidence_level(best, 0.45, 0.28).alias("confidence"))


LINES_SQL = f"""SELECT doc_id, pos AS chunk_id, trim(s, {WS}) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s,
 generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) WHERE trim(s, {WS}) <> ''"""


@query("catalog_line_pick", "WITH " + sql_bm25(LINES_SQL, ITEMS_SQL) + rk("overlap") +
       "SELECT query_id, doc_id, chunk_id AS line, round(overlap, 6) AS score FROM rk WHERE rank = 1 AND overlap > 0.18")
def catalog_line_pick(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_id", "text")).filter(
        T.strip(F.col("text")) != "")
    return R.lexical_topk(lines, items(spark, sf), KEY, 1, 0.0, 1.0).filter("overlap > 0.18").select(
        "query_id", "doc_id", F.col("chunk_id").cast("long").alias("line"), F.round("overlap", 6).alias("score"))


@query("generated_answers", """SELECT doc_id, CASE WHEN n_chars < 300 THEN 'too_short' END AS reason,
 CASE WHEN n_chars >= 300 THEN lang || ': ' || md5(text) END AS generated FROM documents""")
def generated_answers(spark, sf):
    """The caller's generator over every context that no rule refuses; here a column stands in for it."""
    c = table(spark, sf, "documents").select("doc_id", F.col("text").alias("context"), F.col("lang").alias("question"),
                                             F.when(F.col("n_chars") < 300, "too_short").alias("reason"))
    return R.generate_answers(c, lambda context, question: F.concat(question, F.lit(": "), F.md5(context)), reason="reason").select("doc_id", "reason", "generated")


# ---- dense -------------------------------------------------------------------
DENSE = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS similarity FROM v q, v WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, vec_id) AS rank FROM s)"""


def all_dense(spark, sf, k, **kw):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    q = e.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    return R.dense_topk(e, q, "vec_id", "embedding", "query_id", "qv", k, **kw)


def dense_cols(df):
    return df.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.round("similarity", 6).alias("similarity"))


@query("dense_topk", DENSE + "SELECT query_id, rank, vec_id, round(similarity, 6) AS similarity FROM r WHERE rank <= 5")
def dense_topk(spark, sf):
    return dense_cols(all_dense(spark, sf, 5))


@query("dense_topk_blocked", DENSE + "SELECT query_id, rank, vec_id, round(similarity, 6) AS similarity FROM r WHERE rank <= 5")
def dense_topk_blocked(spark, sf):
    """The path for query sets beyond the broadcast bound: blocks of both sides meet once."""
    return dense_cols(all_dense(spark, sf, 5, rows_per_cell=512, max_query_floats=64 * 128))


@query("dense_cutoff", DENSE + "SELECT query_id, rank, vec_id, round(similarity, 6) AS similarity FROM r WHERE rank <= 5 AND 1 - similarity < 0.7")
def dense_cutoff(spark, sf):
    return dense_cols(R.dense_cutoff(all_dense(spark, sf, 5)))


@query("cosine_neighbours", """SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cos
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_neighbours(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("nxt"))
    return e.join(n, "vec_id").select("vec_id", F.round(R.cosine(F.col("embedding"), F.col("nxt")), 6).alias("cos"))


DOCS_SQL = "SELECT doc_id, text FROM documents"
FUSE = ("WITH " + sql_bm25(DOCS_SQL, ITEMS_SQL, key="doc_id") + """,
lx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, doc_id) AS rank FROM scored) WHERE rank <= 24),
vv AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ds AS (SELECT b.item_id AS query_id, v.vec_id AS doc_id, list_cosine_similarity(q.e, v.e) AS similarity FROM benchmark b JOIN vv q ON q.vec_id = b.item_id, vv v),
dn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, doc_id) AS rank FROM ds) WHERE rank <= 24),
mg AS (SELECT coalesce(l.query_id, d.query_id) AS query_id, coalesce(l.doc_id, d.doc_id) AS doc_id, CASE WHEN similarity IS NULL THEN NULL ELSE greatest(0, similarity) END AS dense, bm25 FROM lx l FULL JOIN dn d ON l.query_id = d.query_id AND l.doc_id = d.doc_id),
nm AS (SELECT *, """ + mm("dense") + " AS dnn, " + mm("bm25") + """ AS bnn FROM mg),
fu AS (SELECT query_id, doc_id, dense, bm25, CASE WHEN dnn IS NULL THEN bnn WHEN bnn IS NULL THEN dnn ELSE 0.55 * dnn + 0.45 * bnn END AS score FROM nm)""")
ORD = "row_number() OVER (PARTITION BY query_id ORDER BY round({}, 9) DESC, doc_id)"


def doc_sides(spark, sf, pool=24):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    lex = R.lexical_topk(docs, items(spark, sf), ["doc_id"], pool).select("query_id", "doc_id", "bm25")
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = items(spark, sf).join(e.select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("qv")), "query_id")
    dense = R.dense_topk(e, q, "doc_id", "embedding", "query_id", "qv", pool).drop("rank")
    return docs, lex, dense


def with_overlap(spark, sf, docs, pairs):
    """Rerank score of the candidates only; a vector without a document scores 0."""
    pairs = materialise(pairs)
    asked = broadcast_if_small(pairs.select("query_id", "doc_id").join(items(spark, sf).withColumnRenamed("text", "q"), "query_id"))
    told = docs.join(asked, "doc_id").select("query_id", "doc_id", T.overlap_score(F.col("q"), F.col("text")).alias("rerank"))
    return pairs.join(told, ["query_id", "doc_id"], "left").withColumn("rerank", F.coalesce("rerank", F.lit(0.0)))


@query("hybrid_fusion", FUSE + f" SELECT * FROM (SELECT query_id, doc_id, round(score, 6) AS score, {ORD.format('score')} AS rank FROM fu) WHERE rank <= 8")
def hybrid_fusion(spark, sf):
    _, lex, dense = doc_sides(spark, sf)
    return R.hybrid_fusion(dense, lex, "query_id", ["doc_id"], 8).select(
        "query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


BLEND = FUSE + """, ov AS (SELECT f.*, coalesce(s.overlap, 0) AS rerank FROM fu f LEFT JOIN scored s ON f.query_id = s.query_id AND f.doc_id = s.doc_id),
bl AS (SELECT query_id, doc_id, 0.65 * """ + mm("rerank") + " + 0.35 * " + mm("score") + " AS final FROM ov)"


def blended(spark, sf):
    docs, lex, dense = doc_sides(spark, sf)
    return with_overlap(spark, sf, docs, R.hybrid_fusion(dense, lex, "query_id", ["doc_id"], None))


@query("rerank_blend", BLEND + f" SELECT * FROM (SELECT query_id, doc_id, round(final, 6) AS score, {ORD.format('final')} AS rank FROM bl) WHERE rank <= 8")
def rerank_blend(spark, sf):
    return R.rerank_blend(blended(spark, sf), "query_id", ["doc_id"], "score", "rerank", 8).select(
        "query_id", "doc_id", F.round("final_score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("head_tail_rerank", BLEND + f""", h AS (SELECT query_id, doc_id, score, rerank, {ORD.format('score')} AS rank FROM ov),
x AS (SELECT *, rank > 16 AS tail, CASE WHEN rank <= 16 THEN 0.65 * {mm('rerank', 'query_id, rank > 16')} + 0.35 * {mm('score', 'query_id, rank > 16')} END AS final FROM h)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY tail, round(final, 9) DESC NULLS LAST, rank) AS new_rank FROM x""")
def head_tail_rerank(spark, sf):
    h = R.ranked(blended(spark, sf), "query_id", "score", ["doc_id"], 1000)
    return R.head_tail_rerank(h, "query_id", ["doc_id"], "score", "rerank").select(
        "query_id", "doc_id", F.col("new_rank").cast("long").alias("new_rank"))


@query("mode_dispatch", BLEND + f""",
mode_rows AS (SELECT 'semantic_dense' AS mode, query_id, doc_id, similarity AS score FROM dn UNION ALL
 SELECT 'bm25_lexical', query_id, doc_id, {mm('bm25')} FROM lx UNION ALL
 SELECT 'hybrid_dense_bm25', query_id, doc_id, score FROM fu UNION ALL
 SELECT 'hybrid_dense_bm25_rerank', query_id, doc_id, final FROM bl UNION ALL
 SELECT 'semantic_dense_rerank', query_id, doc_id, 0.65 * {mm('rr')} + 0.35 * {mm('similarity')} FROM
   (SELECT d.*, coalesce(s.overlap, 0) AS rr FROM dn d LEFT JOIN scored s ON d.query_id = s.query_id AND d.doc_id = s.doc_id))
SELECT mode, query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY mode, query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM mode_rows) WHERE rank <= 5""")
def mode_dispatch(spark, sf):
    docs, lex, dense = doc_sides(spark, sf)
    lex, dense = materialise(lex), materialise(dense)
    rr = materialise(with_overlap(spark, sf, docs, lex.select("query_id", "doc_id").union(dense.select("query_id", "doc_id")).distinct()))
    out = None
    for m in R.MODES:
        part = R.retrieve(m, dense, lex, "query_id", ["doc_id"], 5, rr).select(
            F.lit(m).alias("mode"), "query_id", "doc_id", F.col("rank").cast("long").alias("rank"))
        out = part if out is None else out.unionByName(part)
    return out


# ---- filters, boosts, orders ---------------------------------------------------
@query("filter_fallback", BM + rk() + """, p AS (SELECT rk.*, d.source IN ('src1', 'src2') AS m FROM rk JOIN documents d USING (doc_id) WHERE rank <= 10)
SELECT query_id, doc_id, chunk_id FROM (SELECT *, bool_or(m) OVER (PARTITION BY query_id) AS anym FROM p) WHERE m OR NOT anym""")
def filter_fallback(spark, sf):
    h = hits(spark, sf, 10).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return R.filter_or_all(h, "query_id", F.col("source").isin("src1", "src2")).select("query_id", *KEY)


@query("field_boost", BM + rk() + f""", p AS (SELECT rk.*, lower(q.text) AS q, lower({TEXT_SQL}) AS t FROM rk JOIN documents d USING (doc_id) JOIN benchmark q ON q.item_id = query_id WHERE rank <= 24),
b AS (SELECT *, [CASE WHEN contains(q, 'that ') AND contains(t, 'annual') THEN 'annual' END, CASE WHEN contains(q, 'that ') AND contains(t, 'tion ') THEN 'tion ' END,
 CASE WHEN contains(q, 'from') AND contains(t, ' by ') THEN ' by ' END] AS f FROM p),
c AS (SELECT *, CASE WHEN f[1] IS NULL THEN 0 ELSE 0.1 END + CASE WHEN f[2] IS NULL THEN 0 ELSE 0.1 END + CASE WHEN f[3] IS NULL THEN 0 ELSE 0.2 END AS boost FROM b)
SELECT query_id, doc_id, chunk_id, CAST(boost AS DOUBLE) AS boost, array_to_string(list_filter(f, lambda x: x IS NOT NULL), ',') AS boost_hits,
 row_number() OVER (PARTITION BY query_id ORDER BY round(bm25 + boost, 9) DESC, doc_id, chunk_id) AS boost_rank FROM c""")
def field_boost(spark, sf):
    h = with_text(spark, sf, hits(spark, sf, 24)).join(items(spark, sf).select("query_id", F.col("text").alias("q")), "query_id")
    hints = [(("that ",), ("annual", "tion "), 0.1), (("from",), (" by ",), 0.2)]
    return R.hint_boost(h, hints, "q", "text", "bm25", "query_id", KEY).select(
        "query_id", *KEY, F.round("boost", 6).alias("boost"), F.array_join("boost_hits", ",").alias("boost_hits"),
        F.col("boost_rank").cast("long").alias("boost_rank"))


@query("manifest_injection", BM + rk() + """, p AS (SELECT query_id, d.source, doc_id, chunk_id, bm25 AS score FROM rk JOIN documents d USING (doc_id) WHERE rank <= 5),
m AS (SELECT item_id AS query_id, 'src0' AS source, CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS BIGINT) AS chunk_id, 2.5 AS score FROM benchmark WHERE contains(lower(text), 'that')),
u AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.query_id = p.query_id AND m.source = p.source) UNION ALL SELECT * FROM m)
SELECT query_id, source, doc_id, chunk_id, round(score, 6) AS score FROM u""")
def manifest_injection(spark, sf):
    h = hits(spark, sf, 5).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").select(
        "query_id", "source", *KEY, F.col("bm25").alias("score"))
    m = items(spark, sf).filter(F.lower("text").contains("that")).select("query_id", F.lit("src0").alias("source"), F.lit(2.5).alias("score"))
    return R.inject_rows(h, m, "query_id", "source", "score").withColumn("score", F.round("score", 6))


@query("numeric_context_boost", """SELECT o_orderkey, CAST(CASE WHEN o_custkey < 80 THEN -0.08 WHEN o_orderstatus = 'F' THEN 0.30 ELSE 0.06 END AS DOUBLE) AS bonus FROM orders""")
def numeric_context_boost(spark, sf):
    o = table(spark, sf, "orders")
    n = F.format_string("%,d", F.col("o_custkey"))
    t = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("total staff "), n, F.lit(" people"))).otherwise(
        F.concat(F.lit("there were "), n, F.lit(" people")))
    return o.select("o_orderkey", F.round(R.numeric_context_boost(t), 6).alias("bonus"))


@query("hit_orders", BM + rk() + """, p AS (SELECT rk.*, d.source, d.lang FROM rk JOIN documents d USING (doc_id) WHERE rank <= 10)
SELECT query_id, doc_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY source = 'src1' DESC, rank) AS promoted,
 row_number() OVER (PARTITION BY query_id ORDER BY lang = 'en' DESC, contains(source, '7'), source = 'src3' DESC, rank) AS family,
 row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN contains(source, 'src1') THEN 50 ELSE 10 END + CASE WHEN lang = 'fr' THEN 25 ELSE 0 END DESC, round(bm25, 9) DESC, doc_id, chunk_id) AS trusted FROM p""")
def hit_orders(spark, sf):
    h = hits(spark, sf, 10).join(table(spark, sf, "documents").select("doc_id", "source", "lang"), "doc_id")
    h = R.promote(h, "query_id", F.col("source") == "src1").withColumnRenamed("new_rank", "promoted")
    h = R.family_order(h, "query_id", F.col("lang") == "en", F.col("source").contains("7"), F.col("source") == "src3").withColumnRenamed("new_rank", "family")
    trust = S.source_rank(F.col("source"), [("src1", 50)])
    h = R.trust_order(h, "query_id", trust, F.col("lang") == "fr", "bm25", KEY)
    return h.select("query_id", *KEY, *[F.col(c).cast("long").alias(n) for c, n in
                                        (("promoted", "promoted"), ("family", "family"), ("new_rank", "trusted"))])


@query("expand_hits", BM + rk() + """, h AS (SELECT DISTINCT query_id, doc_id, chunk_id FROM rk WHERE rank <= 3),
x AS (SELECT DISTINCT h.query_id, c.doc_id, c.chunk_id FROM h JOIN ck c USING (doc_id) WHERE length(c.text) >= 400)
SELECT query_id, doc_id, chunk_id FROM h UNION SELECT query_id, doc_id, chunk_id FROM x""")
def expand_hits(spark, sf):
    """All long chunks of the hit documents join the hits."""
    h = hits(spark, sf, 3).select("query_id", *KEY)
    h = materialise(h)
    pool = corpus(spark, sf).join(broadcast_if_small(h.select("query_id", "doc_id").distinct()), "doc_id").select("query_id", *KEY, F.length("text").alias("n"))
    return R.expand_hits(h, pool, ["query_id", *KEY], F.col("n") >= 400).select("query_id", *KEY)


PLANNED = 4  # documents that an item plans at most; the number belongs to the retrieval plan
PLAN_SQL = f""", pl AS (SELECT i.item_id AS query_id, d.doc_id FROM benchmark i JOIN (SELECT doc_id, source FROM documents
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= {PLANNED}) d ON d.source = 'src' || CAST(i.item_id % 20 AS VARCHAR))"""


def planned(spark, sf):
    """Each item plans the longest documents of one source, four at most."""
    i = items(spark, sf).select("query_id", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")).alias("source"))
    best = top_k(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "n_chars"), ["source"], [F.desc("n_chars"), F.col("doc_id")], PLANNED)
    return best.join(broadcast_if_small(i), "source").select("query_id", "doc_id")


@query("single_doc_retrieval", BM + PLAN_SQL + """, b AS (SELECT s.*, (0.6 * bm25 + 0.4 * overlap) * CASE WHEN pl.doc_id IS NULL THEN 1.0 ELSE 1.25 END AS score FROM scored s LEFT JOIN pl ON s.query_id = pl.query_id AND s.doc_id = pl.doc_id)""" +
       rk("score", "b") + """, p AS (SELECT * FROM rk WHERE rank <= 48)
SELECT query_id, doc_id, round(max(score), 6) AS doc_score, count(*) AS unit_count FROM p GROUP BY ALL""")
def single_doc_retrieval(spark, sf):
    """Boosted top 48: what the boost lifts is planned, so the plain top 48 and the planned pairs hold it all."""
    mix = 0.6 * F.col("bm25") + 0.4 * F.col("overlap")
    vocab = corpus_vocabulary(spark, sf)
    pl = planned_scores(spark, sf, vocab).withColumn("score", mix * 1.25)
    plain = hits(spark, sf, 48, 0.6, 0.4, vocab).select("query_id", *KEY, "score").join(pl.select("query_id", *KEY), ["query_id", *KEY], "left_anti")
    pool = R.ranked(plain.unionByName(pl.select("query_id", *KEY, "score")), "query_id", "score", KEY, 48)
    return R.document_scores(pool, "query_id", "doc_id", "score").withColumn("doc_score", F.round("doc_score", 6))


def planned_scores(spark, sf, vocab):
    return materialise(R.lexical_scores(corpus(spark, sf), items(spark, sf), KEY, pairs=planned(spark, sf), vocab=vocab))


@query("plan_coverage", BM + PLAN_SQL + rk() + """, h AS (SELECT DISTINCT query_id, doc_id FROM rk WHERE rank <= 48)
SELECT pl.query_id, count(*) AS planned, count(h.doc_id) AS hit, round(count(h.doc_id) / count(*), 6) AS coverage FROM pl LEFT JOIN h ON pl.query_id = h.query_id AND pl.doc_id = h.doc_id GROUP BY ALL""")
def plan_coverage(spark, sf):
    return R.plan_coverage(hits(spark, sf, 48), planned(spark, sf), "query_id", "doc_id").withColumn("coverage", F.round("coverage", 6))


@query("role_topk", BM + PLAN_SQL + """, s2 AS (SELECT s.*, 0.6 * bm25 + 0.4 * overlap AS score, pl.doc_id IS NOT NULL AS planned FROM scored s LEFT JOIN pl ON s.query_id = pl.query_id AND s.doc_id = pl.doc_id),
rr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY round(score, 9) DESC, chunk_id) AS r FROM s2 WHERE planned) WHERE r <= 3),
gg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id, chunk_id) AS r FROM s2) WHERE r <= 10),
un AS (SELECT query_id, doc_id, chunk_id, max(f) AS f, max(score) AS score FROM (SELECT query_id, doc_id, chunk_id, score, 1 AS f FROM rr UNION ALL SELECT query_id, doc_id, chunk_id, score, 0 FROM gg) GROUP BY ALL),
pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, round(score, 9) DESC, doc_id, chunk_id) AS r FROM un) WHERE r <= 10)
SELECT query_id, doc_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id, chunk_id) AS rank FROM pk""")
def role_topk(spark, sf):
    """Three chunks of every planned document first, the global order after that."""
    mix = (0.6 * F.col("bm25") + 0.4 * F.col("overlap")).alias("score")
    vocab = corpus_vocabulary(spark, sf)
    pl = planned_scores(spark, sf, vocab).select("query_id", *KEY, mix, F.lit(True).alias("planned"))
    gl = hits(spark, sf, 10, 0.6, 0.4, vocab).select("query_id", *KEY, "score", F.lit(False).alias("planned"))
    s = pl.unionByName(gl.join(pl.select("query_id", *KEY), ["query_id", *KEY], "left_anti"))
    return R.per_doc_topk(s, "query_id", "doc_id", "score", KEY, 3, 10).select(
        "query_id", *KEY, F.col("rank").cast("long").alias("rank"))


@query("table_injection", BM + PLAN_SQL + rk() + """, t AS (SELECT pl.query_id, c.doc_id, c.chunk_id, 2.5 AS score FROM pl JOIN ck c USING (doc_id) WHERE length(c.text) - length(replace(c.text, '|', '')) >= 8),
u AS (SELECT query_id, doc_id, chunk_id, max(score) AS score FROM (SELECT query_id, doc_id, chunk_id, bm25 / 100 AS score FROM rk WHERE rank <= 10 UNION ALL SELECT * FROM t) GROUP BY ALL)
SELECT query_id, doc_id, chunk_id, round(score, 6) AS score FROM u""")
def table_injection(spark, sf):
    """Table chunks of planned documents get a constant score and lead."""
    tabs = corpus(spark, sf).filter(F.regexp_count("text", F.lit(r"\|")) >= 8).select(*KEY).join(
        planned(spark, sf), "doc_id").select("query_id", *KEY, F.lit(2.5).alias("score"))
    h = hits(spark, sf, 10).select("query_id", *KEY, (F.col("bm25") / 100).alias("score"))
    return h.unionByName(tabs).groupBy("query_id", *KEY).agg(F.round(F.max("score"), 6).alias("score"))


# ---- whole queries -------------------------------------------------------------
FULL_SQL = BM + rk() + f""", p AS (SELECT rk.query_id, rank, d.source, rk.bm25, doc_id, {TEXT_SQL} AS text, {mm('bm25', 'rk.query_id')} AS score FROM rk JOIN documents d USING (doc_id) WHERE rank <= 5),
t AS (SELECT query_id, max(score) AS best, arg_min(text, rank) AS top, string_agg(source, ',' ORDER BY rank) AS sources FROM p GROUP BY query_id),
a AS (SELECT t.*, q.text AS question, string_split(regexp_replace(top, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ss, list_distinct({sql_tokens('q.text')}) AS qs FROM t JOIN benchmark q ON q.item_id = query_id),
g AS (SELECT *, list_slice(list_filter(ss, lambda s: len(list_intersect(qs, list_distinct({sql_tokens('s')}))) >= 2), 1, 2) AS good FROM a)
SELECT query_id, sources, CASE WHEN best >= 0.55 THEN 'high' WHEN best >= 0.35 THEN 'medium' ELSE 'low' END AS confidence, false AS insufficient,
 md5(trim(array_to_string(CASE WHEN len(good) > 0 THEN list_transform(good, lambda x: trim(x, {WS})) ELSE list_slice(ss, 1, 2) END, ' '), {WS})) AS answer_md5 FROM g"""


def query_record(out):
    return out.select("query_id", F.array_join(F.transform("evidence", lambda e: e["source"]), ",").alias("sources"),
                      "confidence", "insufficient", F.md5("answer").alias("answer_md5"))


@query("ingest_answer", FULL_SQL)
def ingest_answer(spark, sf):
    """The two calls of ``dossier.retrieval``: documents to a stored index, questions to answers."""
    index = ingest(table(spark, sf, "documents"), index_path(spark, "ingest"), keep=("source",))
    return query_record(answer(items(spark, sf), index))


@query("full_query", FULL_SQL)
def full_query(spark, sf):
    h = R.bm25_pool(corpus(spark, sf), items(spark, sf), KEY, pool=5)
    q = items(spark, sf).withColumnRenamed("text", "question")
    out = R.answer_record(with_text(spark, sf, h), q, "query_id", "source", "text", "score")
    return query_record(out)


EXPECT = ", ex AS (SELECT i.item_id AS query_id, d.doc_id FROM benchmark i JOIN documents d ON contains(d.text, i.text))"


def expected(spark, sf):
    return J.containment_join(table(spark, sf, "documents").select("doc_id", "text"),
                              items(spark, sf), "doc_id", "text", "query_id", "text").select("query_id", "doc_id")


@query("expected_sources", "SELECT i.item_id AS query_id, d.doc_id FROM benchmark i JOIN documents d ON contains(d.text, i.text)")
def expected_sources(spark, sf):
    """Which documents hold an item word by word: anchored equi-join, then the exact test."""
    return expected(spark, sf)


@query("rank_of_expected", BM + EXPECT + rk() + """, h AS (SELECT query_id, doc_id, rank FROM rk WHERE rank <= 20)
SELECT i.item_id AS query_id, min(CASE WHEN ex.doc_id IS NOT NULL THEN h.rank END) AS first_rank FROM benchmark i LEFT JOIN h ON h.query_id = i.item_id
LEFT JOIN ex ON ex.query_id = h.query_id AND ex.doc_id = h.doc_id GROUP BY ALL""")
def rank_of_expected(spark, sf):
    h = hits(spark, sf, 20).join(expected(spark, sf).withColumn("m", F.lit(True)), ["query_id", "doc_id"], "left")
    r = R.rank_of_first(h, "query_id", F.coalesce("m", F.lit(False)))
    return items(spark, sf).select("query_id").join(r, "query_id", "left").select("query_id", F.col("first_rank").cast("long").alias("first_rank"))


@query("snippet_rank", BM + rk() + f""", h AS (SELECT query_id, rank, {TEXT_SQL} AS t, q.text AS snip FROM rk JOIN documents d USING (doc_id) JOIN benchmark q ON q.item_id = query_id WHERE rank <= 20),
r AS (SELECT query_id, min(CASE WHEN contains(t, snip) THEN rank END) AS first_rank FROM h GROUP BY ALL)
SELECT query_id, first_rank, CASE WHEN first_rank = 1 THEN 'ok' WHEN first_rank <= 5 THEN 'rank_low' WHEN first_rank IS NOT NULL THEN 'below_top5' ELSE 'not_retrieved' END AS failure FROM r""")
def snippet_rank(spark, sf):
    q = items(spark, sf).select("query_id", F.col("text").alias("snip"))
    h = with_text(spark, sf, hits(spark, sf, 20)).join(q, "query_id")
    r = R.rank_of_first(h, "query_id", F.col("text").contains(F.col("snip")))
    f = F.col("first_rank")
    return r.select("query_id", f.cast("long").alias("first_rank"),
                    F.when(f == 1, "ok").when(f <= 5, "rank_low").when(f.isNotNull(), "below_top5").otherwise("not_retrieved").alias("failure"))


@query("ablation_runs", BM + EXPECT + rk("bm25", "scored", "r1") + rk("overlap", "scored", "r2") +
       ", sb AS (SELECT *, 0.6 * bm25 + 0.4 * overlap AS sc FROM scored)" + rk("sc", "sb", "r3") + """,
 al AS (SELECT 'bm25' AS variant, query_id, doc_id, rank FROM r1 WHERE rank <= 5 UNION ALL SELECT 'overlap', query_id, doc_id, rank FROM r2 WHERE rank <= 5 UNION ALL SELECT 'mixed', query_id, doc_id, rank FROM r3 WHERE rank <= 5),
 pq AS (SELECT variant, query_id, min(CASE WHEN ex.doc_id IS NOT NULL THEN rank END) AS fr FROM al LEFT JOIN ex USING (query_id, doc_id) GROUP BY ALL)
SELECT variant, count(*) AS n, round(avg(CAST(fr IS NOT NULL AS INT)), 4) AS hit_rate, round(avg(CAST(coalesce(fr = 1, false) AS INT)), 4) AS top1_rate FROM pq GROUP BY ALL""")
def ablation_runs(spark, sf):
    """Scoring switched one by one; each variant is a pair of weights over one stored index."""
    h, index = None, R.build_index(corpus(spark, sf), KEY, index_path(spark, "ablation"))
    for name, wb, wo in (("bm25", 1.0, 0.0), ("overlap", 0.0, 1.0), ("mixed", 0.6, 0.4)):
        part = R.lexical_topk(index, items(spark, sf), KEY, 5, wb, wo).select(F.lit(name).alias("variant"), "query_id", "doc_id", "rank")
        h = part if h is None else h.unionByName(part)
    h = h.join(expected(spark, sf).withColumn("m", F.lit(1)), ["query_id", "doc_id"], "left")
    pq = h.groupBy("variant", "query_id").agg(F.min(F.when(F.col("m") == 1, F.col("rank"))).alias("fr"))
    return pq.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("fr").isNotNull().cast("int")), 4).alias("hit_rate"),
                                     F.round(F.avg(F.coalesce(F.col("fr") == 1, F.lit(False)).cast("int")), 4).alias("top1_rate"))


@query("probe_feasibility", BM + rk() + f""", h AS (SELECT query_id, rank, {TEXT_SQL} AS t, string_split(q.text, ' ') AS w FROM rk JOIN documents d USING (doc_id) JOIN benchmark q ON q.item_id = query_id WHERE rank <= 16),
r AS (SELECT query_id, count(*) AS units, bool_or(rank <= 5 AND contains(t, w[3] || ' ' || w[4])) AS signal, bool_or(regexp_matches(t, '\\d{{3,}}')) AS cand FROM h GROUP BY ALL)
SELECT query_id, units, signal, cand, CASE WHEN signal AND cand THEN 'extraction_ready' WHEN signal THEN 'retrieval_ready' WHEN units > 0 THEN 'needs_review' ELSE 'coverage_gap' END AS readiness FROM r""")
def probe_feasibility(spark, sf):
    w = F.split("text", " ")
    q = items(spark, sf).select("query_id", F.concat_ws(" ", w[2], w[3]).alias("sig"))
    h = with_text(spark, sf, hits(spark, sf, 16)).join(q, "query_id")
    r = h.groupBy("query_id").agg(F.count(F.lit(1)).alias("units"),
                                  F.bool_or((F.col("rank") <= 5) & F.col("text").contains(F.col("sig"))).alias("signal"),
                                  F.bool_or(F.col("text").rlike(r"\d{3,}")).alias("cand"))
    return r.withColumn("readiness", F.when(F.col("signal") & F.col("cand"), "extraction_ready").when(F.col("signal"), "retrieval_ready").when(
        F.col("units") > 0, "needs_review").otherwise("coverage_gap"))


@query("text_presence", BM + rk() + f""", h AS (SELECT query_id, string_agg({TEXT_SQL}, chr(10) ORDER BY rank) AS t, any_value(q.text) AS gold FROM rk JOIN documents d USING (doc_id) JOIN benchmark q ON q.item_id = query_id WHERE rank <= 5 GROUP BY query_id)
SELECT query_id, contains(replace(t, ',', ''), replace(gold, ',', '')) AS present FROM h""")
def text_presence(spark, sf):
    h = with_text(spark, sf, hits(spark, sf, 5)).groupBy("query_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda e: e["text"]), "\n").alias("t"))
    g = items(spark, sf).withColumnRenamed("text", "gold")
    bare = lambda c: F.replace(F.col(c), F.lit(","), F.lit(""))
    return h.join(g, "query_id").select("query_id", bare("t").contains(bare("gold")).alias("present"))


@query("context_assembly", BM + rk() + f""", h AS (SELECT query_id, rank, '[' || CAST(rank AS VARCHAR) || '] source=' || d.source || chr(10) || {TEXT_SQL} AS blk FROM rk JOIN documents d USING (doc_id) WHERE rank <= 4)
SELECT query_id, md5(string_agg(blk, chr(10) || chr(10) ORDER BY rank)) AS context_md5, sum(length(blk)) AS n_chars FROM h GROUP BY query_id""")
def context_assembly(spark, sf):
    h = with_text(spark, sf, hits(spark, sf, 4)).withColumn("blk", F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] source="), "source", F.lit("\n"), "text"))
    return h.groupBy("query_id").agg(
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "blk"))), lambda e: e["blk"]), "\n\n")).alias("context_md5"),
        F.sum(F.length("blk")).alias("n_chars"))


@query("leak_check", BM + rk() + """, h AS (SELECT query_id, d.lang <> 'en' AS leak FROM rk JOIN documents d USING (doc_id) WHERE rank <= 10)
SELECT query_id, bool_or(leak) AS any_leak, count_if(leak) AS n_leaks FROM h GROUP BY ALL""")
def leak_check(spark, sf):
    h = hits(spark, sf, 10).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return h.groupBy("query_id").agg(F.bool_or(F.col("lang") != "en").alias("any_leak"), F.count_if(F.col("lang") != "en").alias("n_leaks"))


GATE_SQL = BM + rk() + f""", h AS (SELECT query_id, rank, d.source, {TEXT_SQL} AS t, list_slice(list_distinct(regexp_extract_all(lower(q.text), '([a-z]{{6,}})', 1)), 1, 1000) AS terms
   FROM rk JOIN documents d USING (doc_id) JOIN benchmark q ON q.item_id = query_id WHERE rank <= 8),
f AS (SELECT *, regexp_matches(t, '\\d{{3,}}') AND len(list_filter(terms, lambda x: contains(lower(t), x))) > 0 AS anchor, contains(source, '7') AS domain_bad FROM h),
q AS (SELECT query_id, bool_or(anchor) FILTER (rank <= 3) AS has_anchor, bool_or(domain_bad) FILTER (rank <= 3) AS has_domain, bool_or(anchor AND NOT domain_bad) FILTER (rank <= 3) AS answerable,
   bool_or(anchor AND NOT domain_bad) FILTER (rank = 1) AS top_ok FROM f GROUP BY ALL)"""


@query("reliability_gate", GATE_SQL + """SELECT query_id, NOT answerable AS abstain, CASE WHEN answerable THEN NULL WHEN NOT has_anchor THEN 'metric_anchor_missing' WHEN has_domain THEN 'domain_mismatch' ELSE 'no_answerable_evidence' END AS reason,
 CASE WHEN answerable AND top_ok THEN 'high' WHEN answerable THEN 'medium' ELSE 'low' END AS confidence FROM q""")
def reliability_gate(spark, sf):
    from dossier.operators.classify import reliability
    q = items(spark, sf).select("query_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{6,})"), F.lit(1))).alias("terms"))
    h = with_text(spark, sf, hits(spark, sf, 8)).join(q, "query_id")
    h = h.withColumn("anchor", S.anchor_passes(F.col("text"), F.lit("count"), F.col("terms"), count_re=r"\d{3,}"))
    h = h.withColumn("domain_bad", F.col("source").contains("7"))
    return reliability(h, "query_id", "anchor", "domain_bad", F.lit(False)).select("query_id", "abstain", "reason", "confidence")
