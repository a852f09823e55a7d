"""Documents to packed training sequences: five stages, each on all that the one before kept.

Stages are (name, function) with function(spark, docs, sf_dir) -> DataFrame.
All but the last return the columns of ``documents``.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from dossier.llm import decontaminate, langid, packing, secrets, simhash
from dossier.llm.common import fresh, stored

LEAST_POSTERIOR = 0.5  # of the likeliest language; a clean text of a known language is far above


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of no known language go: null, without letters, or without a language likelier than all others together."""
    model = langid.train(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    p = fresh(docs, "_p")
    judged = docs.withColumn(p, langid.predict(F.col("text"), model))
    return judged.filter((F.col(f"{p}.lang_pred") != langid.UNKNOWN) & (F.col(f"{p}.score") >= LEAST_POSTERIOR)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id."""
    return simhash.deduplicated(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return docs.filter(~decontaminate.leaks(F.col("text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blotted out of the texts, n_chars follows; every document stays."""
    model = secrets.train(docs)
    clean = docs.withColumn("text", secrets.redacted(F.col("text"), model))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def bestfit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 1024 tokens."""
    pieces = packing.cut(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [("language_id", language_id), ("simhash_neardup", near_duplicates), ("decontaminate", decontamination),
          ("secret_scan", secret_scan), ("bestfit_packing", bestfit_packing)]

ORACLE_SQL = None  # no stage can be said in SQL; tests/llm/test_pipeline.py holds them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
