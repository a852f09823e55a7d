"""URL rules by a sort-merge range join, DataFrame functions only.

A rule (host, path) fits its host and all subdomains where the url's path
starts with the rule's. The canonical key is the reversed host and then the
path, so that a rule is the interval of all keys with its own key as prefix. A
url takes part once for each ending of its host that has rules. Rule starts,
urls and rule ends are sorted together and swept; intervals of one host nest,
so the stack of open rules is one slot per depth: the innermost open rule at
depth d is the last one that started at depth d.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dossier.llm.common import fresh, shuffle_width
from dossier.operators.bounds import broadcast_if_small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = "://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def reversed_host(labels: Column) -> Column:
    return F.concat_ws(".", F.reverse(labels))


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule`` and ``verdict``; columns of these names are replaced.

    ``rules`` has (host, path, verdict). The longest fitting rule wins, of
    equally long ones that with the longer host. Of rules that repeat a (host,
    path), ``block`` wins. Rules with a null are left out. Where none fits,
    ``rule`` is null and ``verdict`` is ``default``. Null urls, repeated urls
    and empty tables are defined by the same words.

    Equal (host, path) are judged once. Urls of one host ending are salted in
    proportion to how many there are, its rules are repeated for each salt; no
    window sees more than about a quarter of a partition.
    """
    own = urls.drop("host", "path", "rule", "verdict")
    h, p, u, row = (fresh(own, c) for c in ("_h", "_p", "_u", "_row"))
    parts = own.withColumns({h: host(F.col(url)), p: path(F.col(url))})
    rule = rules.select(F.col("host").alias("rh"), F.col("path").alias("rp"), F.col("verdict").alias("rv")).dropna() \
        .groupBy("rh", "rp").agg(F.max("rv").alias("rv"))
    deepest = rule.agg(F.max(F.size(F.split("rh", "[.]")))).first()[0] or 0
    # One row per distinct url and host ending that has rules.
    labels = F.split(F.col("h"), "[.]")
    endings = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(1, deepest)))),
                          lambda n: F.concat_ws(".", F.slice(labels, -n, n)))
    keys = parts.groupBy(F.col(h).alias("h"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    points = keys.select("h", "p", F.explode(endings).alias("rh")).join(
        broadcast_if_small(rule.select("rh").distinct()), "rh", "left_semi")
    # Salts of each host ending, in proportion to its urls.
    counts = points.groupBy("rh").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 1
    target = max(1, int(total) // (4 * shuffle_width(urls.sparkSession)))
    salts = broadcast_if_small(counts.select("rh", F.ceil(F.col("n") / target).cast("int").alias("salts")))
    salted_points = points.join(salts, "rh").withColumn("salt", F.pmod(F.xxhash64("h", "p"), F.col("salts")).cast("int"))
    salted_rules = rule.join(salts, "rh").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    # Events: a rule opens at its key and closes behind every key that it prefixes (0xFF is in no UTF-8 text).
    ending = reversed_host(F.split(F.col("rh"), "[.]"))
    key = lambda rest: F.concat(ending, F.lit(" "), rest).cast("binary")
    none = F.lit(None).cast("string")
    opens = salted_rules.select("rh", "salt", key(F.col("rp")).alias("key"), F.lit(0).alias("kind"), F.lit(1).alias("step"),
                                F.col("rp"), F.col("rv"), none.alias("h"), none.alias("p"))
    closes = salted_rules.select("rh", "salt", F.concat(key(F.col("rp")), F.lit(b"\xff")).alias("key"), F.lit(2).alias("kind"),
                                 F.lit(-1).alias("step"), none.alias("rp"), none.alias("rv"), none.alias("h"), none.alias("p"))
    asked = salted_points.select("rh", "salt", key(F.col("p")).alias("key"), F.lit(1).alias("kind"), F.lit(0).alias("step"),
                                 none.alias("rp"), none.alias("rv"), "h", "p")
    sweep = Window.partitionBy("rh", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    slot = Window.partitionBy("rh", "salt", "depth").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = opens.unionByName(closes).unionByName(asked).withColumn("depth", F.sum("step").over(sweep)) \
        .withColumn("top", F.last(F.when(F.col("kind") == 0, F.struct("rp", "rv")), ignorenulls=True).over(slot)) \
        .filter("kind = 1 and depth > 0")
    best = swept.groupBy("h", "p").agg(F.max(F.struct(
        (F.length("rh") + F.length("top.rp")).alias("size"), F.length("rh").alias("host_size"), "rh", "top.rp", "top.rv")).alias(row))
    judged = best.select(F.col("h").alias(h), F.col("p").alias(p), F.col(row))
    return parts.join(judged, [h, p], "left").select(
        *own.columns, F.col(h).alias("host"), F.col(p).alias("path"),
        F.concat(F.col(f"{row}.rh"), F.col(f"{row}.rp")).alias("rule"),
        F.coalesce(F.col(f"{row}.rv"), F.lit(default)).alias("verdict"))
