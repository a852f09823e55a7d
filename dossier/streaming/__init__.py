"""Structured Streaming: incremental ingest, metric windows, sessions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dossier.functions.text import content_id
from dossier.operators.chunking import chunk_chars


KEY_PARTS = 64  # partitions of a merge target


def ingest_stream(files: DataFrame, key: str = "doc_id", text: str = "text",
                  event_time: str | None = None, horizon: str = "7 days") -> DataFrame:
    """New documents -> chunks -> ids not seen before.

    With an event time the seen-set is dropped behind the watermark; without
    one it is kept whole, which a store-backed merge should then replace.
    """
    c = chunk_chars(files, text).withColumn("chunk_key", content_id(F.col(key), F.col("chunk_id"), F.col("text")))
    if event_time:
        return c.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(["chunk_key"])
    return c.dropDuplicates(["chunk_key"])


def merge_batch(target: str):
    """foreachBatch sink: append only chunks the target does not hold; a replayed batch adds nothing.

    The target is partitioned by a hash of the key, and a batch reads the keys
    of the partitions it touches.
    """
    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.xxhash64("chunk_key"), F.lit(KEY_PARTS)).cast("int")
        one = batch.dropDuplicates(["chunk_key"]).withColumn("key_part", part)
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            touched = [r[0] for r in batch.select(part).distinct().collect()]  # at most KEY_PARTS numbers
            known = spark.read.schema(one.schema).parquet(target).filter(F.col("key_part").isin(touched)).select("key_part", "chunk_key")
            one = one.join(known, ["key_part", "chunk_key"], "left_anti")
        one.repartition("key_part").write.mode("append").partitionBy("key_part").parquet(target)
    return run


def metric_windows(events: DataFrame, ts: str, keys: list[str], aggs: dict[str, Column], late: str = "1 hour",
                   width: str = "1 hour", slide: str | None = None) -> DataFrame:
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(*[c.alias(n) for n, c in aggs.items()]).select(
        F.col("w.start").alias("start"), *keys, *aggs)


def with_thresholds(windows: DataFrame, limits: DataFrame, keys: list[str], metric: str, limit: str) -> DataFrame:
    """Stream-static join: each window against its limit."""
    return windows.join(limits, keys, "left").withColumn("alert", F.coalesce(F.col(metric) > F.col(limit), F.lit(False)))


def sessions(events: DataFrame, ts: str, user: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    s = F.session_window(ts, gap)
    return events.withWatermark(ts, late).groupBy(s.alias("s"), user).agg(F.count(F.lit(1)).alias("n")).select(
        user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def run_once(spark: SparkSession, stream: DataFrame, out: str, checkpoint: str, mode: str = "append", batch=None) -> DataFrame | None:
    """Take everything available, then stop; returns what was written."""
    w = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = (w.foreachBatch(batch) if batch else w.outputMode(mode).format("parquet").option("path", out)).start()
    q.awaitTermination()
    return spark.read.parquet(out)
