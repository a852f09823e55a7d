"""Size checks before a broadcast, salting for hot keys, numbering without one big sort."""
from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from dossier.session import materialise

BROADCAST_ROWS = 500_000  # of narrow key rows; wide sides pass their own bound


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when a bounded count proves the side small.

    Beyond the bound the frame comes back unhinted, so the join is a shuffle
    join that adaptive execution may split on hot keys.
    """
    small = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if small else df


SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """Use every core for a small table of few splits; a table over ``SPREAD_BYTES`` is never moved for it."""
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def hot_keys(df: DataFrame, keys: list[str], threshold: int) -> DataFrame:
    """Keys held by more than ``threshold`` rows (counts combine before the shuffle)."""
    return df.groupBy(*keys).count().filter(F.col("count") > threshold).select(*keys)


def join_null_safe(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet null keys, so rows of a null group find their group again."""
    r = b.withColumnsRenamed({k: f"_j_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_j_{k}")) for k in keys]
    return a.join(r, reduce(and_, same), how).drop(*[f"_j_{k}" for k in keys])


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], row_id: Column, how: str = "inner",
                threshold: int = 1_000_000, salts: int = 64) -> DataFrame:
    """Equi-join where a few keys, null among them, may hold a third of ``big``.

    Rows of a hot key are spread over ``salts`` sub-keys and only the matching
    small-side rows of those keys are repeated. Hot keys are counted once, into a
    table of at most rows / ``threshold`` keys. ``how`` may be inner or left.
    """
    hot = broadcast_if_small(materialise(hot_keys(big, keys, threshold)).withColumn("_hot", F.lit(True)))
    b = join_null_safe(big, hot, keys, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(row_id), F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    s = join_null_safe(small, hot, keys, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
            F.array(F.lit(0))))).drop("_hot")
    return join_null_safe(b, s, [*keys, "_salt"], how).drop("_salt")


NULL_PIECE = 1 << 40  # rows without an order value come after all others


def _cuts(df: DataFrame, order: Column, target_rows: int) -> list | None:
    """Approximate quantiles that cut the rows in pieces of about ``target_rows``; None where all rows, nulls included, fit in one (one count)."""
    n, every = df.agg(F.count(order), F.count(F.lit(1))).first()
    pieces = max(1, -(-int(n) // target_rows))
    if every <= target_rows:
        return None
    return [] if pieces == 1 else sorted(set(df.agg(F.percentile_approx(
        order, [i / pieces for i in range(1, pieces)], max(10_000, 20 * pieces))).first()[0] or []))


def order_bucket(df: DataFrame, order: Column, target_rows: int = 1_000_000, cuts: list | None = None) -> DataFrame:
    """Add ``_b``: ranges of a numeric order key that hold about ``target_rows`` each, so a hot group is cut in pieces.

    Cut points are approximate quantiles, so clustered keys are cut as well;
    equal keys share a piece. Monotone in the key, hence whole-group numbering
    and carries can be done as (inside the piece) + (what the earlier pieces add
    up to). Null order values are a piece of their own, after the others. A row
    is compared with about twice the square root of the number of pieces.
    """
    cuts = (_cuts(df, order, target_rows) or []) if cuts is None else cuts
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    below = lambda xs: F.size(F.filter(F.array(*[F.lit(x) for x in xs]), lambda x: x < order)) if xs else F.lit(0)
    if len(groups) <= 1:
        b = below(cuts)
    else:
        heads = below([g[-1] for g in groups])  # groups that lie below the key as a whole
        rest = F.get(F.array(*[F.array(*[F.lit(x) for x in g]) for g in groups]), heads)
        b = heads * step + F.coalesce(F.size(F.filter(rest, lambda x: x < order)), F.lit(0))
    return df.withColumn("_b", F.when(order.isNull(), F.lit(NULL_PIECE)).otherwise(b.cast("long")))


def number_rows(df: DataFrame, keys: list[str], order_cols: list[Column], bucket_on: Column,
                name: str = "rn", target_rows: int = 1_000_000) -> DataFrame:
    """Row number per key (null is a key) for groups of any size; rows without ``bucket_on`` come last.

    ``bucket_on`` is the leading numeric order key. Each (key, piece) is ordered
    on its own; piece sizes, one row each, give the offsets. A table that fits
    in one piece, nulls included, is numbered by one window.
    """
    cuts = _cuts(df, bucket_on, target_rows)
    if cuts is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(bucket_on.isNull(), *order_cols)).cast("long"))
    b = order_bucket(df, bucket_on, target_rows, cuts)
    sizes = b.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = b.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order_cols)))
    return join_null_safe(local, offsets, [*keys, "_b"]).withColumn(name, F.col("_off") + F.col("_r")).drop("_off", "_r", "_b")


def forward_fill(df: DataFrame, keys: list[str], order: Column, cols: list[str],
                 target_rows: int = 1_000_000) -> DataFrame:
    """Last non-null value so far per key (null is a key), for groups of any size; rows without an order value come last.

    A window runs inside each (key, piece); the last value of every piece is
    carried into the later ones through a table with one row per piece. A table
    that fits in one piece, nulls included, needs one window alone.
    """
    cuts = _cuts(df, order, target_rows)
    if cuts is None:
        w = Window.partitionBy(*keys).orderBy(order.asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})
    b = order_bucket(df, order, target_rows, cuts)
    w = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = b.groupBy(*keys, "_b").agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(f"_l_{c}") for c in cols])
    prev = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(*keys, "_b", *[F.last(f"_l_{c}", ignorenulls=True).over(prev).alias(f"_c_{c}") for c in cols])
    out = join_null_safe(b.select("*", *[F.last(c, ignorenulls=True).over(w).alias(f"_f_{c}") for c in cols]), carry, [*keys, "_b"])
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col(f"_f_{c}"), F.col(f"_c_{c}")))
    return out.drop("_b", *[f"_f_{c}" for c in cols], *[f"_c_{c}" for c in cols])


def top_k(df: DataFrame, keys: list[str], order_cols: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per key; the limit is applied per task before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order_cols)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def ordered_sum(df: DataFrame, keys: list[str], value: str, order: str, name: str) -> DataFrame:
    """Sum of doubles per key, added up in an order of the rows, so the last bit does not change with partitions or files.

    A running sum; the rows of a key are held in a buffer that spills, never in one list.
    """
    w = Window.partitionBy(*keys).orderBy(order, value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select(*keys, F.sum(value).over(w).alias("_s"), F.count(F.lit(1)).over(w).alias("_n")).groupBy(*keys).agg(
        F.max_by("_s", "_n").alias(name))


def best_per_key(df: DataFrame, keys: list[str], order_cols: list[Column]) -> DataFrame:
    return top_k(df, keys, order_cols, 1, "_r").drop("_r")
