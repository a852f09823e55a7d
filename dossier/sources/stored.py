"""Partitioned tables that are changed in place: a delete or a replacement by key rewrites the partitions it touches and no other."""
from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from dossier.operators.bounds import broadcast_if_small, join_null_safe
from dossier.session import materialise

SLOTS = 65_536  # of a partition's key filter
FILTER = "_keys"  # folder of the key filters, which readers of the table skip


def _slot(key: str):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(SLOTS)).cast("int").alias("_slot")


def _write(df: DataFrame, path: str, parts: list[str], mode: str = "overwrite") -> None:
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def create(df: DataFrame, path: str, parts: list[str], key: str) -> None:
    """Write a table partitioned by ``parts``, and beside it which hash slots of ``key`` each partition holds."""
    df.write.mode("overwrite").partitionBy(*parts).parquet(path)
    df.select(*parts, _slot(key)).distinct().write.mode("overwrite").partitionBy(*parts).parquet(f"{path}/{FILTER}")


def open_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def rewrite(spark: SparkSession, path: str, parts: list[str], key: str, keys: DataFrame, added: DataFrame | None = None) -> tuple[int, int]:
    """Remove all rows whose key is in ``keys`` (null meets null) and add ``added``; (rows removed, partitions rewritten).

    Partitions come from the key filters, so one that cannot hold a key is not
    read. The new content of the touched partitions is written before it takes
    the place of the old, by dynamic partition overwrite; if that fails the old
    rows stay. Partitions left without rows are removed last. Keys held by no
    partition change nothing; repeated keys count once. One writer at a time.
    """
    k = materialise(keys.select(key).distinct())
    filters = spark.read.parquet(f"{path}/{FILTER}")
    touched = filters.join(broadcast_if_small(k.select(_slot(key)).distinct()), "_slot").select(*parts)
    if added is not None:
        added = materialise(added)
        touched = touched.unionByName(added.select(*parts))
    touched = materialise(touched.distinct())
    table = open_table(spark, path)
    old = join_null_safe(table.withColumn("_file", F.input_file_name()), broadcast_if_small(touched), parts, "left_semi")
    seen, kept = Observation(), Observation()
    gone = k.withColumnRenamed(key, "_k")
    rest = old.observe(seen, F.count(F.lit(1)).alias("n")).join(broadcast_if_small(gone), F.col(key).eqNullSafe(F.col("_k")), "left_anti").observe(
        kept, F.count(F.lit(1)).alias("n"))
    rest = materialise(rest)
    removed = seen.get["n"] - kept.get["n"]
    new = rest.select(*table.columns)
    if added is not None:
        new = new.unionByName(added.select(*table.columns))
    folders = {r["d"] for r in old.select(F.regexp_replace("_file", "/[^/]*$", "").alias("d")).distinct().collect()}
    n = touched.count()
    if not new.isEmpty():
        _write(new, path, parts)
        _write(new.select(*parts, _slot(key)).distinct(), f"{path}/{FILTER}", parts)
    stay = {r["d"] for r in rest.select(F.regexp_replace("_file", "/[^/]*$", "").alias("d")).distinct().collect()}
    if added is not None:  # a partition may be emptied and filled again
        again = join_null_safe(open_table(spark, path).withColumn("_file", F.input_file_name()), added.select(*parts).distinct(), parts, "left_semi")
        stay |= {r["d"] for r in again.select(F.regexp_replace("_file", "/[^/]*$", "").alias("d")).distinct().collect()}
    for folder in sorted(folders - stay):
        base = folder.rsplit("/", len(parts))[0]
        _remove(spark, folder)
        _remove(spark, f"{base}/{FILTER}{folder[len(base):]}")
    return removed, n


def _remove(spark: SparkSession, folder: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder)) if ":" in folder else spark._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def delete_keys(spark: SparkSession, path: str, parts: list[str], key: str, keys: DataFrame) -> tuple[int, int]:
    return rewrite(spark, path, parts, key, keys)


def replace_keys(spark: SparkSession, path: str, parts: list[str], key: str, rows: DataFrame) -> tuple[int, int]:
    """``rows`` take the place of all rows with their keys."""
    return rewrite(spark, path, parts, key, rows, rows)
