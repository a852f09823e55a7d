"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
The likelihood of a word (a space, then its letters in lower case, as UTF-8) is
the sum over all ways to cut it into pieces, by the forward algorithm; a text is
the product of its words. Pieces of such vocabularies do not cross words, so
that is the sum over all segmentations of the text. Words have any length and
pieces too; sums are kept as logarithms, so none runs empty.

Piece probabilities come from expected counts (forward-backward), first under a
rank-based start, then under the language's own first estimate.
"""
from __future__ import annotations

import base64
import math
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dossier.llm.common import few, hash63, hash_limit, map_arrow, worker_cache

CHUNK = 4096  # starts of a word looked up at once
MODEL_CELLS = 64_000_000  # languages x pieces, at most; they go to every worker
TRAIN_ROWS = 4_000  # labelled rows per language that the model is fitted on, at most about
ROUNDS = 2
SMOOTH = 0.5
CACHE_WORDS = 200_000
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    """Letter runs in lower case; none if the text has no letter."""
    w = LETTERS.findall(text.lower())
    return w if any(any(map(str.isalpha, x)) for x in w) else []


IN_WORD = re.compile(rb" ?[a-z\x80-\xff]*")


class Pieces:
    """The vocabulary's pieces that can stand in a word, numbered from 1 by rank; single bytes are all there.

    Pieces are looked up four bytes at a time: a table takes the number of the
    bytes before (0 at the start) and the next one to four bytes to a piece, and
    one of four bytes to the number of the longer beginning.
    """

    def __init__(self, path: str):
        lines = Path(path).read_bytes().splitlines()
        have = [base64.b64decode(a) for a, _ in map(bytes.split, lines)]
        have = [p for p in have if IN_WORD.fullmatch(p)]
        self.number = {p: i for i, p in enumerate(dict.fromkeys(have + [bytes([b]) for b in range(1, 256)]), 1)}
        self.longest = max(map(len, self.number))
        self.begin = [{b"": 0}]  # by depth / 4: beginnings of longer pieces to their numbers
        for d in range(4, self.longest, 4):
            self.begin.append({x: i for i, x in enumerate(sorted({p[:d] for p in self.number if len(p) > d}))})
        key = lambda p, d: self.begin[d // 4][p[:d]] << 32 | int.from_bytes(p[d:])
        self.table, self.deeper = {}, {}
        for k in range(1, self.longest + 1):
            d = (k - 1) // 4 * 4
            self.table[k] = self._sorted((key(p, d), i) for p, i in self.number.items() if len(p) == k)
        for j, names in enumerate(self.begin[1:], 1):
            self.deeper[4 * j] = self._sorted((key(x, 4 * j - 4), i) for x, i in names.items())

    @staticmethod
    def _sorted(pairs) -> tuple[np.ndarray, np.ndarray]:
        pairs = sorted(pairs)
        return np.array([a for a, _ in pairs], np.int64), np.array([b for _, b in pairs], np.int64)

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], code: np.ndarray, none: int) -> np.ndarray:
        keys, values = table
        if not len(keys):
            return np.full(len(code), none)
        at = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
        return np.where(keys[at] == code, values[at], none)

    def lattice(self, words: list[bytes]) -> np.ndarray:
        """(word, start, length - 1) -> piece number, 0 where there is none; all words have one length."""
        m, n = len(words), len(words[0])
        byte = np.zeros((m, n + 4), np.int64)
        byte[:, :n] = np.frombuffer(b"".join(words), np.uint8).reshape(m, n)
        out = np.zeros((m, n, min(self.longest, n)), np.int32)
        row, at = (x.ravel() for x in np.indices((m, n)))
        before = np.zeros(m * n, np.int64)
        for d in range(0, min(self.longest, n), 4):
            code = np.zeros(len(row), np.int64)
            for k in range(d + 1, min(d + 4, self.longest, n) + 1):
                code = code << 8 | byte[row, np.minimum(at + k - 1, n)]
                here = at + k <= n
                out[row[here], at[here], k - 1] = self._find(self.table[k], before[here] << 32 | code[here], 0)
            if d + 4 not in self.deeper:
                break
            here = at + d + 4 < n
            row, at, code, before = row[here], at[here], code[here], before[here]
            before = self._find(self.deeper[d + 4], before << 32 | code, -1)
            row, at, before = row[before >= 0], at[before >= 0], before[before >= 0]
        return out

    def starts(self, words: list[bytes], back: bool = False) -> Iterator[tuple[int, list[tuple[int, np.ndarray, np.ndarray]]]]:
        """Per start, from the first or from the last: (length, words that have a piece of it there, the pieces' numbers)."""
        n = len(words[0])
        for c in sorted(range(0, n, CHUNK), reverse=back):
            grid = self.lattice([w[c:c + CHUNK + self.longest] for w in words])
            some = grid.any(0)
            here = range(min(CHUNK, n - c))
            for i in reversed(here) if back else here:
                yield c + i, [(int(k) + 1, at, grid[at, i, k]) for k in np.flatnonzero(some[i]) for at in [np.flatnonzero(grid[:, i, k])]]


def as_bytes(word: str) -> bytes:
    return b" " + word.encode("utf-8", "surrogatepass").replace(b"\0", b"")


def forward(pieces: Pieces, words: list[bytes], logp: np.ndarray) -> np.ndarray:
    """(word, language): log probability of all segmentations. Words have one length; the last positions alone are kept."""
    n = len(words[0])
    size = min(pieces.longest, n) + 1
    ring = np.full((size, len(words), logp.shape[1]), -np.inf)
    ring[0] = 0.0
    for i, edges in pieces.starts(words):
        now = ring[i % size].copy()
        ring[i % size] = -np.inf
        for k, at, number in edges:
            to = ring[(i + k) % size]
            to[at] = np.logaddexp(to[at], now[at] + logp[number])
    return ring[n % size]


def forward_all(pieces: Pieces, words: list[bytes], logp: np.ndarray) -> np.ndarray:
    """(position, word, language): log probability of all segmentations that end there."""
    a = np.full((len(words[0]) + 1, len(words), logp.shape[1]), -np.inf)
    a[0] = 0.0
    for i, edges in pieces.starts(words):
        for k, at, number in edges:
            a[i + k][at] = np.logaddexp(a[i + k][at], a[i][at] + logp[number])
    return a


def by_length(parts: Iterable[bytes], most: int = 8_000, size: int = 400_000) -> Iterator[list[bytes]]:
    """Words of one length together, at most ``most`` and about ``size`` bytes."""
    groups: dict[int, list[bytes]] = {}
    for w in parts:
        g = groups.setdefault(len(w), [])
        g.append(w)
        if len(g) == most or len(g) * len(w) >= size:
            yield groups.pop(len(w))
    yield from groups.values()


def expected(counts: dict[bytes, np.ndarray], pieces: Pieces, logp: np.ndarray, out: np.ndarray) -> None:
    """Add expected piece counts of words (with their counts per language) to ``out`` (language, piece)."""
    for ws in by_length(counts):
        f = forward_all(pieces, ws, logp)
        n = np.stack([counts[w] for w in ws])
        ring = np.full((min(pieces.longest, len(ws[0])) + 1, len(ws), logp.shape[1]), -np.inf)  # backward, the next positions alone
        ring[len(ws[0]) % len(ring)] = 0.0
        for i, edges in pieces.starts(ws, back=True):
            b = np.full(ring[0].shape, -np.inf)
            for k, at, number in edges:
                way = logp[number] + ring[(i + k) % len(ring)][at]
                b[at] = np.logaddexp(b[at], way)
                e = np.exp(f[i][at] + way - f[-1][at]) * n[at]
                for l in range(out.shape[0]):  # noqa: E741
                    out[l] += np.bincount(number, e[:, l], out.shape[1])
            ring[i % len(ring)] = b


@dataclass
class Model:
    """Piece probabilities per language (columns of ``p``, row 0 is zero) and log priors; languages in order of name."""
    vocabulary: str
    languages: list[str]
    p: np.ndarray
    prior: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


def _estimate(counts: np.ndarray) -> np.ndarray:
    """Probabilities (piece, language) from expected counts, smoothed towards the languages' common ones."""
    counts = counts[:, 1:]
    common = counts.sum(0) + 0.01
    common /= common.sum()
    p = (counts + SMOOTH * 256 * common) / (counts.sum(1, keepdims=True) + SMOOTH * 256)
    return np.concatenate([np.zeros((1, len(counts))), p.T])


def train(docs: DataFrame, vocabulary: str, text: str = "text", lang: str = "lang", order: str = "doc_id",
          rows: int = TRAIN_ROWS, rounds: int = ROUNDS) -> Model:
    """Fit on rows with a label and a text: at most about ``rows`` of each language, chosen by the hash of ``order``.

    A task sends expected counts, at most languages x pieces numbers, which
    combine before the driver sees them once per round. Without labelled rows
    the model knows no language and every text is ``und``. More than ``MODEL_CELLS``
    languages x pieces are refused.
    """
    have = docs.select(F.col(lang).cast("string").alias("l"), F.col(text).alias("t"), F.col(order).alias("o")).filter("l is not null and t is not null")
    sizes = {r["l"]: r["n"] for r in have.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(sizes)
    if not names:
        return Model(vocabulary, [], np.zeros((1, 0)), np.zeros(0))
    limit = F.create_map(*[F.lit(x) for n in names for x in (n, hash_limit(rows, sizes[n]))])
    part = have.filter(hash63("o", F.length("t")) <= limit[F.col("l")]).select("l", "t")
    size = len(Pieces(vocabulary).number) + 1
    if size * len(names) > MODEL_CELLS:
        raise ValueError(f"{len(names)} languages x {size} pieces are more than {MODEL_CELLS} cells")
    start = 1.0 / (np.arange(1, size) + 50.0)
    p = np.concatenate([[[0.0]], (start / start.sum())[:, None]]).repeat(len(names), 1)
    for _ in range(rounds):
        now = logarithm(p)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            pieces = worker_cache(f"pieces {vocabulary}", lambda: Pieces(vocabulary))
            at = {n: i for i, n in enumerate(names)}
            out = np.zeros((len(names), size))
            seen: dict[bytes, np.ndarray] = {}
            for batch in batches:
                for lab, t in (row for x in few(batch) for row in zip(x.column(0).to_pylist(), x.column(1).to_pylist())):
                    for w in words_of(t):
                        s = as_bytes(w)
                        if s not in seen:
                            seen[s] = np.zeros(len(names), np.float32)
                        seen[s][at[lab]] += 1
                    if len(seen) > 200_000:
                        expected(seen, pieces, now, out)  # noqa: B023
                        seen = {}
            expected(seen, pieces, now, out)  # noqa: B023
            lab, piece = np.nonzero(out)
            yield {"l": lab.astype(np.int32), "piece": piece.astype(np.int32), "n": out[lab, piece]}

        counts = np.zeros((len(names), size))
        for r in map_arrow(part, run, "l int, piece int, n double").groupBy("l", "piece").agg(F.sum("n").alias("n")).toLocalIterator():
            counts[r["l"], r["piece"]] = r["n"]
        p = _estimate(counts)
    total = sum(sizes.values())
    return Model(vocabulary, names, p, np.array([math.log(sizes[n] / total) for n in names]))


def logarithm(p: np.ndarray) -> np.ndarray:
    """Row 0, which stands for no piece, gives minus infinity."""
    with np.errstate(divide="ignore"):
        return np.log(p)


class Scorer:
    """Log-likelihoods of texts; likelihoods of words already seen are kept, up to a bound."""

    def __init__(self, model: Model):
        self.m, self.pieces, self.logp = model, Pieces(model.vocabulary), logarithm(model.p)
        self.row: dict[str, int] = {}
        self.value = np.zeros((1024, len(model.languages)), np.float64)

    def learn(self, words: list[str]) -> None:
        while len(self.row) + len(words) > len(self.value):
            self.value = np.concatenate([self.value, np.zeros_like(self.value)])
        where = {as_bytes(w): len(self.row) + i for i, w in enumerate(words)}
        for ws in by_length(where):
            self.value[[where[w] for w in ws]] = forward(self.pieces, ws, self.logp)
        for w in words:
            self.row[w] = len(self.row)

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        split = [words_of(t) if t and self.m.languages else [] for t in texts]
        if len(self.row) > CACHE_WORDS:
            self.row = {}
        if new := {w for ws in split for w in ws} - self.row.keys():
            self.learn(sorted(new))
        out = []
        for ws in split:
            if not ws:
                out.append((UNKNOWN, 0.0))
                continue
            s = self.m.prior + self.value[np.fromiter(map(self.row.__getitem__, ws), np.int64, len(ws))].sum(0)
            best = int(s.argmax())
            out.append((self.m.languages[best], float(1.0 / np.exp(s - s[best]).sum())))
        return out


def predict(text: Column, model: Model) -> Column:
    """Struct (lang_pred, score): the likeliest language and its posterior; ``und`` and 0 for null and letterless texts.

    Equal posteriors go to the first name. Whole texts are scored.
    """
    def of(col: pa.Array) -> pa.Array:
        scorer = worker_cache("langid", dict)
        if model.key not in scorer:
            scorer.clear()
            scorer[model.key] = Scorer(model)
        out, some, size = [], [], 0
        for t in (t for i in range(0, len(col), 128) for t in col.slice(i, 128).to_pylist()):
            some.append(t)
            size += len(t or "")
            if size > 1_000_000:
                out += scorer[model.key].score(some)
                some, size = [], 0
        out += scorer[model.key].score(some)
        pa.default_memory_pool().release_unused()
        return pa.StructArray.from_arrays([pa.array([a for a, _ in out], pa.string()), pa.array([b for _, b in out], pa.float64())],
                                          ["lang_pred", "score"])
    return F.arrow_udf(of, "struct<lang_pred:string,score:double>")(text)


def identify(docs: DataFrame, model: Model, item: str = "doc_id", text: str = "text") -> DataFrame:
    """(item, lang_pred, score) for every row; other columns are not read."""
    return docs.select(F.col(item), predict(F.col(text), model).alias("_")).select(item, "_.lang_pred", "_.score")
