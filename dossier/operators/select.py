"""Deduplication, caps, balanced and covering selection, samples, set merges."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from dossier.functions.text import pad_id
from dossier.operators.bounds import best_per_key, number_rows, salted_join, top_k


def group_anchor(df: DataFrame, keys: list[str], strength: Column, row_id: str) -> DataFrame:
    """(key, anchor id, group size): strongest row, lower id on ties; an aggregate, so copies combine early."""
    return df.groupBy(*keys).agg(F.min_by(row_id, F.struct((-strength).alias("s"), F.col(row_id).alias("i"))).alias("anchor_id"),
                                 F.count(F.lit(1)).alias("group_size"))


def collapse_clusters(df: DataFrame, keys: list[str], strength: Column, row_id: str) -> DataFrame:
    """Every row with its anchor; others than the anchor are collapsed. Hot groups are salted in the join."""
    a = group_anchor(df, keys, strength, row_id)
    out = salted_join(df, a, keys, F.col(row_id), "inner")
    return out.withColumn("action", F.when(F.col(row_id) == F.col("anchor_id"), "anchor").otherwise("collapsed_variant"))


def dedupe_distinct_facts(df: DataFrame, question: str, fact: str, rank: str, row_id: str, all_must_differ: bool = False) -> DataFrame:
    """One fact under a question: its best row. Several facts: all rows.

    ``all_must_differ`` keeps all rows only when every one has its own fact.
    """
    g = df.groupBy(question).agg(F.countDistinct(fact).alias("_f"), F.count(F.lit(1)).alias("_n"),
                                 F.min_by(row_id, F.struct((-F.col(rank)).alias("s"), F.col(row_id).alias("i"))).alias("_best"))
    keep_all = (F.col("_f") == F.col("_n")) if all_must_differ else (F.col("_f") > 1)
    j = salted_join(df, g, [question], F.col(row_id), "inner")
    return j.filter(keep_all | (F.col(row_id) == F.col("_best"))).drop("_f", "_n", "_best")


def duplicate_flags(df: DataFrame, keys: list[str], row_id: str, name: str = "is_duplicate") -> DataFrame:
    g = df.groupBy(*keys).agg((F.count(F.lit(1)) > 1).alias(name))
    return salted_join(df, g, keys, F.col(row_id), "inner")


def first_seen(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows whose key was not seen at an earlier position."""
    return best_per_key(df, keys, [F.col(order)])


def balanced(df: DataFrame, dedupe: list[str], group: str, rank: str, row_id: str, total: int) -> DataFrame:
    """Turns over the groups, best first inside each: the n-th rows of all groups come before the n+1-th.

    Nobody can be reached after ``total`` turns, so the rank inside a group is
    cut there before the shuffle.
    """
    order = [F.col(rank).desc(), F.col(row_id)]
    one = best_per_key(df, dedupe, order)
    turns = top_k(one, [group], order, total, "turn")
    return turns.orderBy("turn", group).limit(total)


def covering(df: DataFrame, group: str, tags: str, proven: Column, rank: str, row_id: str, n: int) -> DataFrame:
    """Greedy tag cover: proven rows with a new tag, then any with a new tag, then by rank; ``n`` per group.

    Taken in a fixed order, a row brings a new tag exactly when it is the first
    row of that tag, so the greedy walk equals a minimum per tag and needs no
    loop. All tags of proven rows are claimed after the first phase.
    """
    d = df.withColumn("_p", proven).withColumn("_o", F.struct((-F.col(rank)).alias("s"), F.col(row_id).alias("i")))
    t = d.select(group, row_id, "_p", "_o", F.explode(tags).alias("tag"))
    per = t.groupBy(group, "tag").agg(F.min_by(row_id, F.when(F.col("_p"), F.col("_o"))).alias("p1"), F.min_by(row_id, "_o").alias("any"))
    first = per.select(group, F.coalesce("p1", "any").alias(row_id), F.when(F.col("p1").isNotNull(), 1).otherwise(2).alias("_ph")).groupBy(
        group, row_id).agg(F.min("_ph").alias("_ph"))
    j = d.join(first, [group, row_id], "left")
    bare = F.coalesce(F.size(tags), F.lit(0)) <= 0
    phase = F.when(bare & F.col("_p"), 1).when(bare, 2).otherwise(F.coalesce("_ph", F.lit(3)))
    j = j.withColumn("phase", phase)
    return top_k(j, [group], [F.col("phase"), F.col(rank).desc(), F.col(row_id)], n, "pick").drop("_p", "_o", "_ph")


def cap_chain(df: DataFrame, stages: list[tuple[list[str], int]], strength: str, row_id: str) -> DataFrame:
    """Caps one after the other; each sees the survivors of the one before."""
    order = [F.col(strength).desc(), F.col(row_id)]
    return reduce(lambda d, s: top_k(d, s[0], order, s[1], "_r").drop("_r"), stages, df)


def hash_share(df: DataFrame, key: str, ratio: float, seed: str = "", minimum: int = 1) -> DataFrame:
    """The first ``ratio`` of the rows by md5 of the key: the same rows on every run.

    Rows are ranked in ranges of the hash, so a large share is not sorted in one task.
    """
    h = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    d = df.withColumn("_h", h).withColumn("_hn", F.conv(F.substring("_h", 1, 8), 16, 10).cast("double")).withColumn("_all", F.lit(1))
    n = df.count()
    k = max(minimum, int(n * ratio))
    return number_rows(d, ["_all"], [F.col("_h"), F.col(key)], F.col("_hn"), "pick").filter(F.col("pick") <= k).drop("_h", "_hn", "_all")


def sequence_ids(df: DataFrame, keys: list[str], order: str, prefix: Column, width: int = 4) -> DataFrame:
    n = number_rows(df, keys, [F.col(order)], F.col(order), "_rn")
    return n.withColumn("seq_id", F.concat_ws("-", prefix, pad_id(F.col("_rn"), width))).drop("_rn")


def merge_tagged(parts: list[DataFrame], key: str, tags: str) -> DataFrame:
    """Union of pools, one row per unit, the distinct tags of all pools merged and sorted; units without tags stay, with an empty list.

    Rows without a key stand for no unit that could be merged and are passed
    through. Other columns keep a value of one of the unit's rows. Distinct tags
    combine before the shuffle, so a unit that many pools hold stays small.
    """
    u = reduce(lambda a, b: a.unionByName(b), parts)
    none = F.array().cast(u.schema[tags].dataType)
    clean = lambda c: F.sort_array(F.array_distinct(F.array_compact(F.coalesce(c, none))))
    others = [c for c in u.columns if c not in (key, tags)]
    t = u.filter(F.col(key).isNotNull()).withColumn("_t", F.explode_outer(clean(F.col(tags)))).groupBy(key).agg(
        F.sort_array(F.collect_set("_t")).alias(tags), *[F.first(c, ignorenulls=True).alias(c) for c in others])
    return t.select(*u.columns).unionByName(u.filter(F.col(key).isNull()).withColumn(tags, clean(F.col(tags))))


def prefer_earlier(parts: list[DataFrame], keys: list[str], order: str | None = None) -> DataFrame:
    """Union where the earlier source wins a key."""
    u = reduce(lambda a, b: a.unionByName(b), [p.withColumn("_src", F.lit(i)) for i, p in enumerate(parts)])
    return best_per_key(u, keys, [F.col("_src")] + ([F.col(order)] if order else []))


def overlay(parts: list[DataFrame], keys: list[str], ok: Column) -> DataFrame:
    """Later rows replace earlier ones by key; only ok rows count."""
    u = reduce(lambda a, b: a.unionByName(b), [p.withColumn("_src", F.lit(i)) for i, p in enumerate(parts)])
    return best_per_key(u.filter(ok), keys, [F.col("_src").desc()]).drop("_src")


def selection_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    b = before.select(key).distinct().withColumn("_b", F.lit(True))
    a = after.select(key).distinct().withColumn("_a", F.lit(True))
    return b.join(a, key, "full_outer").select(key, F.when(F.col("_b") & F.col("_a"), "kept").when(F.col("_a").isNull(), "removed").otherwise("added").alias("change"))


def agreeing_values(df: DataFrame, item: str, value: str, doc: str) -> DataFrame:
    """Values of an item that two or more documents share, with the number of documents and pairs.

    Pairs are counted, not listed: n documents agree in n * (n - 1) / 2 pairs.
    """
    g = df.select(item, value, doc).distinct().groupBy(item, value).agg(F.count(F.lit(1)).alias("n_docs"), F.min(doc).alias("first_doc"))
    return g.filter("n_docs >= 2").withColumn("n_pairs", (F.col("n_docs") * (F.col("n_docs") - 1) / 2).cast("long"))


def replace_slice(existing: DataFrame, new: DataFrame, slice_keys: list[str]) -> DataFrame:
    """Rows of the same slice give way to the new ones; columns are unioned."""
    return existing.join(new.select(*slice_keys).distinct(), slice_keys, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_source(df: DataFrame, source: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(what stays, one row with the number removed)."""
    return df.filter(F.col(source) != value), df.agg(F.count_if(F.col(source) == value).alias("removed"))


def action_list(parts: list[tuple[DataFrame, str]], key: str, n: int) -> DataFrame:
    """Lists in order of urgency, no key twice, first ``n``."""
    u = reduce(lambda a, b: a.unionByName(b), [d.select(key).distinct().select(key, F.lit(i).alias("_o"), F.lit(why).alias("why"))
                                               for i, (d, why) in enumerate(parts)])
    return best_per_key(u, [key], [F.col("_o")]).orderBy("_o", key).limit(n).drop("_o")
