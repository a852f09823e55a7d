"""Shared helpers: tables in the shared folder, fresh column names, byte words, connected components."""
from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from dossier.session import checkpoint_dir


def stored(df: DataFrame) -> DataFrame:
    """Write an intermediate as Parquet to the shared checkpoint folder and go on from the files.

    Cuts lineage: a lost executor costs the tasks it ran, not the stages before.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by ``stored`` once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    for f in df.inputFiles()[:1]:
        p = jvm.org.apache.hadoop.fs.Path(f).getParent()
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash63(*cols) -> Column:
    """A hash from 0 to 2^63 - 1, to draw rows by."""
    return F.xxhash64(*cols).bitwiseAND(F.lit((1 << 63) - 1))


def hash_limit(rows: int, have: int) -> int:
    """What ``hash63`` must not exceed so that about ``rows`` of ``have`` pass; never zero at any size, all where there are fewer."""
    return (1 << 63) - 1 if have <= rows else (rows << 63) // have


def byte_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes, A-Z in lower case; bytes methods know ASCII only."""
    return text.lower().split()


def utf8(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def few(batch: pa.RecordBatch, rows: int = 128) -> Iterator[pa.RecordBatch]:
    """A batch in pieces, so that Python holds the values of a few rows beside it and not all of them twice."""
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def worker_cache(name: str, make):
    """A value kept by the Python worker process between tasks. Functions travel by value, so their globals do not stay.

    A worker holds one value: the next name takes its place, so that a long job
    does not gather what earlier stages have left.
    """
    home = sys.modules.setdefault("_dossier_worker", ModuleType("_dossier_worker"))
    if getattr(home, "name", None) != name:
        home.name = home.value = None
        home.name, home.value = name, make()
    return home.value


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of equal rows; ``keys`` is 1-d or 2-d."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = keys[1:] != keys[:-1]
    at = np.flatnonzero(new if new.ndim == 1 else new.any(axis=1)) + 1
    return np.r_[0, at], np.r_[at, len(keys)]


def map_arrow(df: DataFrame, fn, schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` for a function from batches to dicts of columns."""
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in fn(batches):
            yield pa.RecordBatch.from_arrays(
                [v if isinstance(v, pa.Array) else pa.array(v, f.type, from_pandas=False) for v, f in
                 ((cols[f.name], f) for f in arrow)], schema=arrow)
        pa.default_memory_pool().release_unused()  # what the task's batches took; the worker lives on

    return df.mapInArrow(run, out)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of undirected ``edges``; root is the smallest node it reaches.

    Alternating large-star and small-star steps: every round replaces edges by
    stars around the smallest neighbour, the number of rounds grows with the
    logarithm of the longest path. Rounds are tables in the shared folder; the
    driver sees two numbers of each. Neighbour minima combine before the
    shuffle, the joins back are plain equi-joins that adaptive execution splits.
    """
    def step(e: DataFrame, large: bool) -> DataFrame:
        pairs = e.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                                           F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("p")).select("p.*") \
            if large else e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        m = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        j = pairs.join(m, "u")
        if large:
            j = j.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            j = j.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")),
                                           F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("p")).select("p.*")
        return j.filter("a <> b").distinct()

    e = stored(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct())
    mark = None
    while True:
        n = stored(step(step(e, True), False))
        now = n.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        dropped(e)
        e = n
        if tuple(now) == mark:
            break
        mark = tuple(now)
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(e.select(F.col("b"), F.col("b")).distinct())
