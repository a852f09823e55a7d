"""Chunks that come, go with their source and come back, kept as a log of changes that replays do not alter."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dossier.functions.text import content_id
from dossier.operators.chunking import chunk_chars

SOURCE_PARTS = 64  # partitions of a log, by a hash of the source
LOG = "source string, chunk_key string, chunk_id long, text string, op string, seq long, source_part int"


def merge_changes(target: str, key: str = "doc_id", source: str = "source", text: str = "text", op: str = "op", seq: str = "seq",
                  parts: int = SOURCE_PARTS):
    """foreachBatch sink: adds of documents and deletes of sources -> log of changes (source, chunk_key, chunk_id, text, op, seq).

    ``seq`` orders the events of a source. A delete removes the chunks added
    under a lower number; an add below the newest delete comes too late; at
    equal numbers the add stays. So any order of arrival, any cut into batches
    and any replay end in the same chunks, and a replay logs nothing. An add
    of a chunk that stands is logged again only under a higher number; a
    delete also logs one row without a chunk key. Null sources are a source;
    events without ``seq`` or with another ``op`` are dropped, null and empty
    texts have no chunks. One writer at a time.

    A batch reads keys and numbers, no texts, of the log's partitions that its
    sources fall in; chunks meet by source and key, so a large source is
    spread. ``parts`` must stay the same for one log.
    """
    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        e = batch.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"),
                         F.col(op).alias("op"), F.col(seq).cast("long").alias("seq"),
                         F.pmod(F.xxhash64(F.col(source).cast("string")), F.lit(parts)).cast("int").alias("source_part"))
        e = e.filter(F.col("seq").isNotNull() & F.col("op").isin("add", "delete"))
        chunks = chunk_chars(e.filter("op = 'add'"), "text").withColumn(
            "chunk_key", content_id(F.col("doc_id"), F.col("chunk_id"), F.col("text")))
        came = chunks.select("source_part", "source", "chunk_key", F.lit(None).cast("long").alias("had"), F.col("seq").alias("came"),
                             F.struct(F.col("chunk_id").cast("long").alias("chunk_id"), "text").alias("c"))
        deletes = e.filter("op = 'delete'").select("source_part", "source", F.lit(None).cast("long").alias("old"), F.col("seq").alias("new"))
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            touched = [r[0] for r in e.select("source_part").distinct().collect()]  # at most ``parts`` numbers
            log = spark.read.schema(LOG).parquet(target).filter(F.col("source_part").isin(touched))
            came = came.unionByName(log.filter("op = 'add'").select(
                "source_part", "source", "chunk_key", F.col("seq").alias("had"), F.lit(None).cast("long").alias("came"),
                F.lit(None).cast(came.schema["c"].dataType).alias("c")))
            deletes = deletes.unionByName(log.filter("op = 'delete' AND chunk_key IS NULL").select(
                "source_part", "source", F.col("seq").alias("old"), F.lit(None).cast("long").alias("new")))
        gone = deletes.groupBy("source_part", "source").agg(F.max("old").alias("old"), F.max("new").alias("new")).withColumn(
            "gone", F.greatest("old", "new"))
        met = came.groupBy("source_part", "source", "chunk_key").agg(
            F.max("had").alias("had"), F.max("came").alias("came"), F.max_by("c", "came").alias("c"))
        g = gone.select(F.col("source").alias("_s"), "old", "gone")
        met = met.join(g, F.col("source").eqNullSafe(F.col("_s")), "left")
        stood = F.col("had").isNotNull() & (F.col("old").isNull() | (F.col("had") >= F.col("old")))
        comes = F.col("came").isNotNull() & (F.col("gone").isNull() | (F.col("came") >= F.col("gone"))) & (
            ~stood | (F.col("came") > F.col("had")))
        goes = stood & (F.col("had") < F.col("gone")) & ~comes
        row = lambda o, n, cid, t: F.struct(
            cid.alias("chunk_id"), t.alias("text"), F.lit(o).alias("op"), F.col(n).alias("seq"))
        none = F.lit(None)
        changes = met.select("source_part", "source", "chunk_key", F.when(comes, row("add", "came", F.col("c.chunk_id"), F.col("c.text"))).when(
            goes, row("delete", "gone", none.cast("long"), none.cast("string"))).alias("r")).filter("r IS NOT NULL").select(
            "source", "chunk_key", "r.*", "source_part")
        marks = gone.filter("new IS NOT NULL AND (old IS NULL OR new > old)").select(
            "source", none.cast("string").alias("chunk_key"), none.cast("long").alias("chunk_id"), none.cast("string").alias("text"),
            F.lit("delete").alias("op"), F.col("new").alias("seq"), "source_part")
        changes.unionByName(marks).write.mode("append").partitionBy("source_part").parquet(target)
    return run


def live_chunks(log: DataFrame) -> DataFrame:
    """The chunks that stand at the end of a log of changes, one row per source and key, with the number of the newest add."""
    gone = log.filter("op = 'delete' AND chunk_key IS NULL").groupBy(F.col("source").alias("_s")).agg(F.max("seq").alias("_gone"))
    newest = log.filter("op = 'add'").groupBy("source", "chunk_key").agg(
        F.max_by(F.struct("chunk_id", "text"), "seq").alias("c"), F.max("seq").alias("seq"))
    return newest.join(gone, F.col("source").eqNullSafe(F.col("_s")), "left").filter(
        F.col("_gone").isNull() | (F.col("seq") >= F.col("_gone"))).select("source", "chunk_key", "c.chunk_id", "c.text", "seq")
