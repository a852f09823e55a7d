"""Writers. Counts come from the observed write, not from a second pass."""
from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    obs = Observation()
    df.observe(obs, F.count(F.lit(1)).alias("n")).write.mode(mode).json(path)
    return obs.get["n"]


def write_csv(df: DataFrame, path: str, columns: list[str], mode: str = "overwrite") -> None:
    """Fixed column list; what a row lacks is written empty."""
    cols = [(F.col(c) if c in df.columns else F.lit(None)).cast("string") for c in columns]
    df.select(*[F.coalesce(x, F.lit("")).alias(c) for x, c in zip(cols, columns)]).write.mode(mode).csv(path, header=True, emptyValue="")


def write_partitions(df: DataFrame, path: str, by: list[str], mode: str = "overwrite", salts: int = 1, row_id: str | None = None) -> None:
    """Partitioned output; ``salts`` > 1 lets several tasks write one large partition."""
    keys = [F.col(c) for c in by]
    if salts > 1 and row_id:
        keys.append(F.pmod(F.xxhash64(row_id), F.lit(salts)))
    df.repartition(*keys).write.mode(mode).partitionBy(*by).parquet(path)


def write_scoped(units: DataFrame, path: str, keep, scope: str) -> DataFrame:
    """Filtered corpus with the scope tag added; returns the summary per document."""
    out = units.filter(keep).withColumn("tags", F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.lit(scope))))
    out.write.mode("overwrite").parquet(path)
    return units.sparkSession.read.parquet(path).groupBy("document_id").agg(F.count(F.lit(1)).alias("units"))


def split_sink(df: DataFrame, path: str, status: str = "qc_status") -> None:
    """Pass and reject rows side by side, one folder each."""
    df.write.mode("overwrite").partitionBy(status).json(path)


# The eight columns of an eval table.
EVAL_COLUMNS = ["id", "question", "expected_source", "expected_answer", "extracted_field", "difficulty", "category", "status"]


def eval_table(gold: DataFrame, mapping: dict[str, object]) -> DataFrame:
    return gold.select(*[(mapping[c] if c in mapping else F.lit("")).cast("string").alias(c) for c in EVAL_COLUMNS])
