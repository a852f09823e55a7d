"""Measures that merge: kept once per fine group, read at any coarser level without a second scan of the rows.

A measure table has one row per group: counts, sum, smallest and largest value,
a KLL sketch of the values and a theta sketch of the identities. Its rows have a
bounded size, so a table over days and companies stays small at any number of
events; new days are added by a union. Exact percentiles stay the default
elsewhere (``evaluation.lower_nearest_rank``).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

KLL_K = 800
LG_ENTRIES = 12
COLUMNS = ("n_rows", "n", "total", "least", "most", "ranks", "ids")


def rank_error(k: int = KLL_K) -> float:
    """What a rank from a sketch of size ``k`` may be off, as a share of the values, 99 times in 100 (published fit of KLL)."""
    return 2.296 / k ** 0.9723


def distinct_error(lg_entries: int = LG_ENTRIES, deviations: float = 3.0) -> float:
    """Relative error of a distinct count; counts below the number of entries are exact."""
    return deviations / (2 ** lg_entries) ** 0.5


def measure(df: DataFrame, keys: list[str], value: str, ident: str, k: int = KLL_K, lg_entries: int = LG_ENTRIES) -> DataFrame:
    """(keys, n_rows, n, total, least, most, ranks, ids) per group.

    ``n`` counts finite values only; null, NaN and infinite values count in
    ``n_rows`` alone, null identities are no identity. Null keys are a group.
    Sketches are built in each task and merged after one shuffle. An empty table
    gives no rows, or one with zero counts where there are no keys.
    """
    v = F.col(value).cast("double")
    v = F.when(F.abs(v) < float("inf"), v)  # NaN is the greatest value
    return df.select(*keys, v.alias("_v"), F.col(ident).cast("string").alias("_id")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("_v").alias("n"), F.sum("_v").alias("total"), F.min("_v").alias("least"), F.max("_v").alias("most"),
        F.kll_sketch_agg_double("_v", k).alias("ranks"), F.theta_sketch_agg("_id", lg_entries).alias("ids"))


def roll_up(measures: DataFrame, keys: list[str], k: int = KLL_K, lg_entries: int = LG_ENTRIES) -> DataFrame:
    """The measures of ``keys``, a part of the keys that they were made for; also merges rows of several runs."""
    return measures.groupBy(*keys).agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("total").alias("total"),
        F.min("least").alias("least"), F.max("most").alias("most"),
        F.kll_merge_agg_double("ranks", k).alias("ranks"), F.theta_union_agg("ids", lg_entries).alias("ids"))


def mean() -> Column:
    return F.when(F.col("n") > 0, F.col("total") / F.col("n"))


def quantile(share: float) -> Column:
    """A value whose rank is within ``rank_error`` of ``share``; null where a group has no values."""
    return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("ranks", F.lit(share)))


def distinct() -> Column:
    return F.coalesce(F.theta_sketch_estimate("ids"), F.lit(0)).cast("long")
