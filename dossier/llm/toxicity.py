"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text and their beginnings, hashed into buckets; a
bucket's value follows its rate among the words, so a remark weighs as much in
a long text as in a short one only if it is as frequent. The model is

    bias + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j

so a pair of terms, such as an insult and a group, may say what neither says
alone. It is fitted on a bounded sample of labelled rows of either class; rows
carry weights that restore the classes' shares, so scores are probabilities.
Buckets enter the model by a two-sample t statistic.
"""
from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dossier.llm.common import hash63, hash_limit, map_arrow, stored, worker_cache

BITS = 18  # of a bucket's number
TRAIN_ROWS = 20_000  # labelled rows of each class that the model is fitted on, at most about
TERMS = 4_096  # buckets in the model, at most
LEAST_T = 4.0  # of a bucket's rate between the classes
LEAST_ROWS = 3  # sampled rows that hold a bucket
RANK = 4
EPOCHS, BATCH, STEP, DECAY = 30, 64, 0.1, 1e-4
BEGINNINGS = (3, 4, 5, 6, 7)
CACHE_WORDS = 300_000
THRESHOLD = 0.3
WORD = re.compile(r"\w+")


def buckets(word: str) -> list[int]:
    """Of the word and of its beginnings."""
    terms = [f"w{word}", *[f"p{word[:n]}" for n in BEGINNINGS if len(word) > n]]
    return sorted({crc32(t.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for t in terms})


def value(count: np.ndarray, words: int) -> np.ndarray:
    return np.log1p(100.0 * count / (words + 10))


class Terms:
    """Texts to (buckets, values); the buckets of words already seen are kept, up to a bound. ``columns`` renumbers buckets and drops the others."""

    def __init__(self, columns: dict[int, int] | None = None):
        self.columns, self.known = columns, {}

    def of(self, word: str) -> np.ndarray:
        b = buckets(word)
        return np.array(b if self.columns is None else [self.columns[x] for x in b if x in self.columns], np.int32)

    def terms(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = WORD.findall(text.lower()) if text else []
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        at, times = [], []
        for w, n in Counter(words).items():
            b = self.known.get(w)
            if b is None:
                b = self.known[w] = self.of(w)
            if len(b):
                at.append(b)
                times.append(n)
        if not at:
            return np.empty(0, np.int32), np.empty(0)
        where, inverse = np.unique(np.concatenate(at), return_inverse=True)
        return where, value(np.bincount(inverse, np.repeat(times, [len(b) for b in at])), len(words))


@dataclass
class Model:
    columns: dict[int, int]
    scale: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        x = x * self.scale[at]
        a = x @ self.v[at]
        z = self.bias + x @ self.w[at] + 0.5 * (a @ a - (x * x) @ (self.v[at] ** 2).sum(1))
        return 1.0 / (1.0 + math.exp(-min(max(z, -500.0), 500.0)))


def sampled(labels: DataFrame, item: str, label: str, rows: int) -> tuple[DataFrame, dict[int, float]]:
    """(item, y) for at most about ``rows`` items of either class, and the class shares over all items.

    An item's class is the highest of its labels; null items and labels are left
    out. The choice is by a hash of the item against a threshold of 63 bits, which
    does not reach zero at any size.
    """
    one = labels.select(F.col(item).alias("_k"), (F.col(label) > 0).cast("int").alias("y")).filter("_k is not null and y is not null").groupBy(
        "_k").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["n"] for r in one.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    limit = {y: hash_limit(rows, n) for y, n in sizes.items()}
    draw = hash63(F.lit("toxicity"), F.col("_k"))
    least = F.when(F.col("y") == 1, F.lit(limit.get(1, 0))).otherwise(F.lit(limit.get(0, 0)))
    return one.filter(draw <= least), {y: n / sum(sizes.values()) for y, n in sizes.items()}


def fit(y: np.ndarray, weight: np.ndarray, at: list[np.ndarray], x: list[np.ndarray], scale: np.ndarray, rank: int = RANK,
        epochs: int = EPOCHS, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted logistic loss by adaptive gradient steps over small batches."""
    rng, k = np.random.default_rng(seed), len(scale)
    share = float(np.clip((weight * y).sum() / weight.sum(), 1e-6, 1 - 1e-6))
    bias, w, v = math.log(share / (1 - share)), np.zeros(k), rng.normal(0, 0.01, (k, rank))
    gb, gw, gv = 1e-6, np.full(k, 1e-6), np.full((k, rank), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for s in range(0, len(y), BATCH):
            rows = order[s:s + BATCH]
            m = np.zeros((len(rows), k))
            for i, r in enumerate(rows):
                m[i, at[r]] = x[r] * scale[at[r]]
            used = np.flatnonzero(m.any(0))
            m, a = m[:, used], m[:, used] @ v[used]
            z = bias + m @ w[used] + 0.5 * ((a * a).sum(1) - (m * m) @ (v[used] ** 2).sum(1))
            g = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y[rows]) * weight[rows]
            dw = g @ m + DECAY * w[used]
            dv = m.T @ (g[:, None] * a) - ((g @ (m * m))[:, None]) * v[used] + DECAY * v[used]
            gw[used] += dw ** 2
            gv[used] += dv ** 2
            gb += g.sum() ** 2
            w[used] -= STEP * dw / np.sqrt(gw[used])
            v[used] -= 0.3 * STEP * dv / np.sqrt(gv[used])
            bias -= 0.1 * STEP * g.sum() / math.sqrt(gb)
    return bias, w, v


def train(docs: DataFrame, labels: DataFrame, item: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS,
          terms: int = TERMS, rank: int = RANK) -> Model:
    """Fit on documents that have a label; without labelled documents the model gives one half to all, without one of the classes 0 or 1 almost.

    The sample's items, at most about twice ``rows``, go to the documents, so no text is
    shuffled. Bucket statistics combine in tasks; the driver receives the chosen
    buckets and the sample's values of those.
    """
    picked, shares = sampled(labels, item, label, rows)
    d = docs.select(F.col(item).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(picked), "_k").select("_k", "y", "_t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        t = worker_cache("terms", Terms)
        for batch in batches:
            found = [t.terms(x) for x in batch.column(2).to_pylist()]
            offsets = pa.array(np.r_[0, np.cumsum([len(a) for a, _ in found])].astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(v))) for v in zip(*found)]
            yield {"k": batch.column(0).cast(pa.string()), "y": batch.column(1), "at": lists[0], "x": lists[1]}
    table = stored(map_arrow(d, run, "k string, y int, at array<int>, x array<double>"))
    have = {r["y"]: r["n"] for r in table.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not have:
        return Model({}, np.zeros(0), 0.0, np.zeros(0), np.zeros((0, rank)))
    n0, n1 = have.get(0, 0), have.get(1, 0)
    by = lambda f, y: F.sum(F.when(F.col("y") == y, f).otherwise(0.0))
    x = F.col("z.x")
    sums = table.select("y", F.explode(F.arrays_zip("at", "x")).alias("z")).groupBy(F.col("z.at").alias("at")).agg(
        F.count(F.lit(1)).alias("rows"), *[by(f, y).alias(f"{s}{y}") for y in (0, 1) for s, f in (("s", x), ("q", x * x))])
    mean = lambda y, n: F.col(f"s{y}") / max(n, 1)
    var = lambda y, n: F.greatest(F.col(f"q{y}") / max(n, 1) - mean(y, n) ** 2, F.lit(0.0)) / max(n, 1)
    t = F.round(F.abs(mean(1, n1) - mean(0, n0)) / F.sqrt(var(0, n0) + var(1, n1) + 1e-9), 6)
    best = sums.withColumn("t", t).filter((F.col("rows") >= LEAST_ROWS) & (F.col("t") >= LEAST_T)).orderBy(F.col("t").desc(), "at").limit(terms).select("at", "rows").collect()
    columns = {r["at"]: i for i, r in enumerate(best)}
    scale = np.array([math.log((n0 + n1 + 1) / (r["rows"] + 1)) / math.log(n0 + n1 + 1) for r in best])
    chosen = _chosen(table, columns)
    order = sorted(range(len(chosen["k"])), key=lambda i: (chosen["k"][i], chosen["y"][i], chosen["at"][i], chosen["x"][i]))
    at = [np.array([columns[b] for b in chosen["at"][i]], np.int64) for i in order]
    xs = [np.array(chosen["x"][i], float) for i in order]
    y = np.array([chosen["y"][i] for i in order], float)
    weight = np.where(y == 1, shares.get(1, 0) / max(n1, 1), shares.get(0, 0) / max(n0, 1)) * (n0 + n1)
    return Model(columns, scale, *fit(y, weight, at, xs, scale, rank))


def _chosen(table: DataFrame, columns: dict[int, int]) -> dict:
    keys = np.array(sorted(columns), np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            a, x = batch.column("at"), batch.column("x")
            flat = a.flatten().to_numpy()
            hit = np.isin(flat, keys)
            rest = pa.array(np.r_[0, np.cumsum(hit)][a.offsets.to_numpy() - a.offsets[0].as_py()].astype(np.int32))
            yield {"k": batch.column("k"), "y": batch.column("y"), "at": pa.ListArray.from_arrays(rest, pa.array(flat[hit])),
                   "x": pa.ListArray.from_arrays(rest, pa.array(x.flatten().to_numpy()[hit]))}
    return map_arrow(table, run, table.schema).toArrow().to_pydict()


def predict(text: Column, model: Model) -> Column:
    """Probability of the label; null and wordless texts get the bias alone. Whole texts are scored."""
    def of(col: pa.Array) -> pa.Array:
        home = worker_cache("toxicity", dict)
        if model.key not in home:
            home.clear()
            home[model.key] = Terms(model.columns)
        return pa.array([model.score(*home[model.key].terms(t)) for t in col.to_pylist()], pa.float64())
    return F.arrow_udf(of, "double")(text)


def score(docs: DataFrame, model: Model, item: str = "doc_id", text: str = "text") -> DataFrame:
    """(item, score) for every row, repeated rows included; other columns are not read."""
    return docs.select(F.col(item), predict(F.col(text), model).alias("score"))
