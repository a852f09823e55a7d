"""Streams over the driver tables, run to the end of what is there."""
from __future__ import annotations

from pyspark.sql import functions as F

from dossier import streaming as ST
from dossier.operators.chunking import chunk_chars
from dossier.functions.text import content_id
from dossier.plans.base import query, sql_char_chunks, table
from dossier.plans.sources import scratch
from dossier.streaming import changes as CH


def stream_of(spark, sf, name):
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    # A pattern, as a plain path to one file is refused by streams; a table may be one file or a folder of files.
    s = spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")
    return s.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in s.columns else s


@query("stream_ingest", f"""WITH c AS ({sql_char_chunks()}) SELECT source, count(DISTINCT (doc_id, chunk_id, text)) AS chunks FROM c GROUP BY source""")
def stream_ingest(spark, sf):
    """File stream -> chunks -> foreachBatch merge."""
    out, ck = scratch(spark, "ing"), scratch(spark, "ck")
    c = chunk_chars(stream_of(spark, sf, "documents").select("doc_id", "source", "text")).withColumn(
        "chunk_key", content_id(F.col("doc_id"), F.col("chunk_id"), F.col("text")))
    ST.run_once(spark, c, out, ck, batch=ST.merge_batch(out))
    return spark.read.parquet(out).groupBy("source").agg(F.count(F.lit(1)).alias("chunks"))


@query("stream_dedupe", f"""WITH c AS ({sql_char_chunks()}) SELECT count(DISTINCT (doc_id, chunk_id, text)) AS chunks FROM c""")
def stream_dedupe(spark, sf):
    s = ST.ingest_stream(stream_of(spark, sf, "documents").select("doc_id", "source", "text"))
    return ST.run_once(spark, s, scratch(spark, "ded"), scratch(spark, "ck")).agg(F.count(F.lit(1)).alias("chunks"))


@query("stream_windows", """WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM events) SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H') AS start_hour, event_type, count(*) AS n, round(avg(value), 6) AS mean_value, avg(value) > 40 AS alert
FROM events, m GROUP BY ALL HAVING any_value(time_bucket(INTERVAL 1 HOUR, ts)) + INTERVAL 1 HOUR <= any_value(wm)""")
def stream_windows(spark, sf):
    """Hourly metrics against limits; append mode gives the windows the watermark has closed."""
    e = stream_of(spark, sf, "events")
    w = ST.metric_windows(e, "ts", ["event_type"], {"n": F.count(F.lit(1)), "mean_value": F.avg("value")})
    lim = table(spark, sf, "events").select("event_type").distinct().withColumn("lim", F.lit(40.0))
    r = ST.run_once(spark, ST.with_thresholds(w, lim, ["event_type"], "mean_value", "lim"), scratch(spark, "win"), scratch(spark, "ck"))
    return r.select(F.date_format("start", "yyyy-MM-dd HH").alias("start_hour"), "event_type", "n", F.round("mean_value", 6).alias("mean_value"), "alert")


@query("stream_sessions", """WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM events), g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS brk FROM events),
s AS (SELECT user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g), a AS (SELECT user_id, sid, min(ts) AS st, max(ts) + INTERVAL 30 MINUTE AS en, count(*) AS n FROM s GROUP BY ALL)
SELECT user_id, strftime(st, '%Y-%m-%d %H:%M:%S.%f') AS start_at, n FROM a, m WHERE en <= wm""")
def stream_sessions(spark, sf):
    s = ST.sessions(stream_of(spark, sf, "events"), "ts", "user_id")
    r = ST.run_once(spark, s, scratch(spark, "ses"), scratch(spark, "ck"))
    return r.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start_at"), "n")


@query("batch_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS brk FROM events), s AS (SELECT user_id, sum(brk) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
SELECT user_id, count(*) AS n FROM s GROUP BY user_id, sid""")
def batch_sessions(spark, sf):
    return table(spark, sf, "events").groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", "n")


@query("stream_source_changes", f"""WITH c AS ({sql_char_chunks()}), lo AS (SELECT min(source) AS s FROM documents)
SELECT c.source, count(DISTINCT (c.doc_id, c.chunk_id, c.text)) AS chunks FROM c JOIN documents d ON c.doc_id = d.doc_id, lo
WHERE c.source IS DISTINCT FROM lo.s OR d.lang = 'en' GROUP BY c.source""")
def stream_source_changes(spark, sf):
    """Every document is added, one source is deleted, its English documents come back; then all of it is replayed."""
    gone = F.col("source") == F.lit(table(spark, sf, "documents").agg(F.min("source")).first()[0])
    event = lambda op, n: F.struct(F.lit(op).alias("op"), F.lit(n).alias("seq"))
    e = stream_of(spark, sf, "documents").select(
        "doc_id", "source", "text", F.explode(F.filter(F.array(
            event("add", 1), F.when(gone, event("delete", 2)), F.when(gone & (F.col("lang") == "en"), event("add", 3))), lambda x: x.isNotNull())).alias("e")).select(
        "doc_id", "source", "text", "e.*")
    out = scratch(spark, "chg")
    for name in ("ck", "ck"):  # two checkpoints: the second run replays all events
        ST.run_once(spark, e, out, scratch(spark, name), batch=CH.merge_changes(out))
    return CH.live_chunks(spark.read.parquet(out)).groupBy("source").agg(F.count(F.lit(1)).alias("chunks"))
