"""Registered queries of the operators, over whole tables, with their SQL where SQL can say it."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from dossier.llm import align, bloom_lm, decontaminate, html, langid, nearest, packing, passages, repair, secrets, simhash, toxicity, urls
from dossier.llm.common import stored
from dossier.operators.bounds import join_null_safe

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op10_simhash_neardup")
def op10(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def remainder(column, n):
    """crc32 of the value as text, modulo n; null as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


@query("op1_language_id")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = remainder("doc_id", 4) == 2
    model = langid.train(docs.filter(~held), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return docs.select("doc_id", held.alias("held_out"), langid.predict(F.col("text"), model).alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score")


@query("op2_bestfit_packing")
def op2(spark, sf_dir):
    pieces = packing.cut(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def joined(spans):
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


@query("op3_secret_scan")
def op3(spark, sf_dir):
    found = secrets.find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query("op4_bloom_lm")
def op4(spark, sf_dir):
    return bloom_lm.score(table(spark, sf_dir, "documents"), remainder("doc_id", 10) == 0)


@query("op5_nearest_vectors", """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE list_dot_product(e, e) > 0 AND isfinite(list_dot_product(e, e))),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / (q.n * c.n) AS score
      FROM u q JOIN u c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY rank <= 5""")
def op5(spark, sf_dir):
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op6_decontaminate")
def op6(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_repeated_passages")
def op7(spark, sf_dir):
    return passages.repeated(table(spark, sf_dir, "documents"))


@query("op8_main_text")
def op8(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages"))


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query("op9_url_rules", """
WITH parts AS (SELECT page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
rules(rh, rp, rv) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                             ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
SELECT page_id, host, path,
       (SELECT max(struct_pack(n := length(rh || rp), rule := rh || rp)) FROM rules
        WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)).rule AS rule,
       coalesce((SELECT max(struct_pack(n := length(rh || rp), v := rv)) FROM rules
        WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)).v, 'allow') AS verdict
FROM parts""")
def op9(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


@query("op13_tokenizer_alignment")
def op13(spark, sf_dir):
    found = align.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return align.judged(found.withColumn("groups", digest).withColumnRenamed("groups", "groups_sha256")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query("op12_toxicity")
def op12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = remainder("doc_id", 4) == 2
    model = toxicity.train(docs.filter(~held), table(spark, sf_dir, "labels"))
    return docs.select("doc_id", held.alias("held_out"), toxicity.predict(F.col("text"), model).alias("score")).withColumn(
        "predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The stated damage, by crc32 of ``conv_id:turn`` modulo 20; nulls are one space there and in role and text."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = F.pmod(F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")), F.lit(20))
    text = F.when(d == 1, "").when(d == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    role = F.when(d == 4, "user").otherwise(said("role"))
    return conversations.filter(d != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(
        F.when(d == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


@query("op11_conversation_repair", r"""
WITH RECURSIVE
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, z: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295) % 20 AS d
    FROM conversations),
dam AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM src, range(2) AS k(copy) WHERE d <> 0 AND (copy = 0 OR d = 3)),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS pos FROM dam),
fault AS (SELECT conv_id, turn, role, text, pos, left(role, 1) AS initial,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
    NOT regexp_matches(regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1), '[.!?]') AS cut,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM num),
rows_ AS (SELECT *, blank OR again AS gone, cut AND NOT blank AND NOT again AS short FROM fault),
empty(p, q, cost, audit, rep) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
    (0, 2, 3, 'I', chr(10) || 'user:'), (0, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
    (1, 2, 3, 'I', chr(10) || 'user:'), (1, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
    (2, 3, 3, 'I', chr(10) || 'assistant:'), (3, 2, 3, 'I', chr(10) || 'user:')),
moves(p, op, letter, q, name) AS (VALUES (0, 'D', '', 0, ''), (1, 'D', '', 1, ''), (2, 'D', '', 2, ''), (3, 'D', '', 3, ''),
    (0, 'K', 's', 1, ''), (0, 'K', 'u', 2, ''), (1, 'K', 'u', 2, ''), (2, 'K', 'a', 3, ''), (3, 'K', 'u', 2, ''),
    (0, 'R', 'u', 2, 'user'), (1, 'R', 'u', 2, 'user'), (2, 'R', 'a', 3, 'assistant'), (3, 'R', 'u', 2, 'user')),
dp AS (SELECT conv_id, 0 AS pos, 0 AS q, {'cost': 0, 'audit': '', 'rep': ''} AS best FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL
    SELECT conv_id, pos, q, min(cand) FROM (
        SELECT d.conv_id, d.pos + 1 AS pos, m.q, {
            'cost': d.best.cost + e.cost + CASE m.op WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN r.short AND m.op <> 'D' THEN 3 ELSE 0 END,
            'audit': d.best.audit || e.audit || m.op,
            'rep': d.best.rep || e.rep || CASE m.op WHEN 'D' THEN '' WHEN 'R' THEN chr(10) || m.name || ':' || r.text ELSE chr(10) || r.role || ':' || r.text END} AS cand
        FROM dp d JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.pos = d.pos + 1 JOIN empty e ON e.p = d.q JOIN moves m ON m.p = e.q
        WHERE m.op = 'D' OR NOT r.gone AND (m.op = 'R' OR m.letter = r.initial)) GROUP BY conv_id, pos, q),
stats AS (SELECT c.conv_id, count(r.pos) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (short) AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id),
fin AS (SELECT s.*, min({'cost': d.best.cost + e.cost, 'audit': d.best.audit || e.audit, 'rep': d.best.rep || e.rep}) AS best
    FROM stats s JOIN dp d ON d.conv_id IS NOT DISTINCT FROM s.conv_id AND d.pos = s.n JOIN empty e ON e.p = d.q AND e.q IN (0, 3) GROUP BY ALL)
SELECT conv_id, CAST(gaps AS BIGINT) AS gaps, CAST(blank AS BIGINT) AS blank, CAST(duplicate AS BIGINT) AS duplicate, CAST(truncated AS BIGINT) AS truncated,
    CAST(illegal AS BIGINT) AS illegal, CAST(best.cost AS BIGINT) AS cost, best.audit AS audit, sha256(substr(best.rep, 2)) AS repaired_sha256 FROM fin""")
def op11(spark, sf_dir):
    talks = table(spark, sf_dir, "conversations")
    rows = damaged(talks)
    heads = stored(repair.parsed(rows, talks))
    return join_null_safe(heads, repair.summary(rows, heads), ["conv_id"]).select(
        "conv_id", "gaps", *repair.COUNTS, "cost", "audit", "repaired_sha256")
