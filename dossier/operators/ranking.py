"""Retrieval: a table of queries against a table of chunks.

Layout of the lexical path: a first pass counts the vocabulary (counts combine
in each task); a second one scores the chunks where they lie against the query
weights, pruned by bounds (``operators/lexical.py``), and keeps k rows per query
and task. A stored index holds inverted lists, of which a search reads those of
its terms. Query sets beyond the broadcast bound are joined with the postings
of their terms, in cells of bounded size.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from dossier.functions.text import overlap_from_counts, tokenize
from dossier.operators import lexical as L
from dossier.operators.bounds import broadcast_if_small, top_k
from dossier.operators.lexical import K1, B, TIE, held_floor as _held_floor  # noqa: F401
from dossier.session import materialise

EPSILON = 0.25  # fixed value: floor of a negative idf, as a share of the mean
MAX_QUERY_TERMS = 2_000_000  # broadcast bound for the query side, rows
MAX_QUERY_BYTES = 128 << 20  # and bytes of its terms
SEGMENT = 16_384  # chunks of an inverted segment
CELL_TERMS = 500_000  # (query, term) rows of a slab of queries, at least
CELL_SEGMENTS = 4  # full segments of a group


def _slots(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def tokenized(chunks: DataFrame, key: list[str], text: str, tenant: str | None = None) -> DataFrame:
    """Token lists with length and distinct count.

    Both numbers are worked out here: beside ``explode`` they would be worked
    out again for every token.
    """
    cols = key + ([tenant] if tenant and tenant not in key else [])
    t = chunks.select(*cols, tokenize(F.col(text)).alias("toks"))
    return t.select(*cols, "toks", F.size("toks").alias("dl"), F.size(F.array_distinct("toks")).alias("dt"))


def postings(toks: DataFrame, key: list[str], tenant: str | None = None) -> DataFrame:
    """(chunk, term) -> tf; one shuffle by chunk, whose partitioning all later steps keep."""
    cols = key + ([tenant] if tenant and tenant not in key else [])
    return (toks.repartition(_slots(toks), *key).select(*cols, "dl", "dt", F.explode_outer("toks").alias("term"))
            .groupBy(*cols, "dl", "dt", "term").agg(F.count(F.lit(1)).alias("tf")))


def vocabulary(toks: DataFrame, tenant: str | None = None) -> DataFrame:
    """(term, df) of the corpus in one pass; the row of the empty term carries chunk and token totals.

    Counts combine in each task, so the shuffle moves vocabularies, not tokens.
    """
    t = [tenant] if tenant else []
    terms = F.concat(F.array(F.lit("")), F.array_distinct("toks"))
    return toks.select(*t, "dl", F.explode(terms).alias("term")).groupBy(*t, "term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("dl").alias("dl_sum"))


def text_vocabulary(chunks: DataFrame, text: str, tenant: str | None = None) -> DataFrame:
    """``vocabulary`` of a table of texts, or token lists. Without tenants the tasks tokenise and count in Python, which is several times
    cheaper than a row per token, and pass on counts."""
    if tenant:
        return vocabulary(chunks.select(tenant, tokenize(F.col(text)).alias("toks")).withColumn("dl", F.size("toks")), tenant)
    return chunks.select(text).mapInArrow(L.text_counts, "term string, df long, dl_sum long").groupBy("term").agg(
        F.sum("df").alias("df"), F.sum("dl_sum").alias("dl_sum"))


def term_weights(vocab: DataFrame, tenant: str | None = None) -> DataFrame:
    """idf per term with the average length beside it; negative idf is floored at a quarter of the mean.

    Reads the vocabulary several times, so callers hand in a written one.
    """
    n = F.max(F.when(F.col("term") == "", F.col("df")))
    tot = F.max(F.when(F.col("term") == "", F.col("dl_sum")))
    stats = F.struct(n.alias("n"), (tot / n).alias("avgdl")).alias("_s")
    raw = F.when(F.col("term") != "", F.log(F.col("_s.n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    if tenant:
        idf = vocab.join(vocab.groupBy(tenant).agg(stats), tenant).withColumn("raw", raw)
        idf = idf.join(idf.groupBy(tenant).agg(F.avg("raw").alias("mean_idf")), tenant)
    else:
        idf = vocab.withColumn("_s", vocab.agg(stats).scalar()).withColumn("raw", raw)
        idf = idf.withColumn("mean_idf", idf.agg(F.avg("raw")).scalar())
    t = [tenant] if tenant else []
    return idf.select(*t, "term", F.col("_s.n").alias("n"), F.col("_s.avgdl").alias("avgdl"), "raw", "mean_idf",
                      F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))


def query_terms(queries: DataFrame, qid: str, qtext: str, tenant: str | None = None) -> DataFrame:
    """(query, term) with its count and the number of distinct terms of the query."""
    t = [tenant] if tenant else []
    qs = queries.select(F.col(qid), *t, tokenize(F.col(qtext)).alias("_t"))
    qs = qs.select(qid, *t, F.size(F.array_distinct("_t")).alias("qd"), F.explode_outer("_t").alias("term"))
    return qs.filter(F.col("term").isNotNull()).groupBy(qid, *t, "qd", "term").agg(F.count(F.lit(1)).alias("qtf"))


def _fits(qt: DataFrame, rows: int = MAX_QUERY_TERMS) -> bool:
    """Whether query terms may be sent to every task: by rows and by bytes, one job."""
    r = qt.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("term")).alias("b")).first()
    return r["n"] <= rows and (r["b"] or 0) <= MAX_QUERY_BYTES


def lexical_scores(chunks: DataFrame | LexicalIndex, queries: DataFrame, key: list[str], text: str = "text",
                   qid: str = "query_id", qtext: str = "text", tenant: str | None = None,
                   pairs: DataFrame | None = None, vocab: DataFrame | None = None) -> DataFrame:
    """(query, chunk) with ``bm25`` (Okapi) and ``overlap`` for every pair sharing a term.

    Repeated query terms count as often as they occur. With ``tenant`` every
    statistic is per tenant and a query only meets chunks of its own. ``pairs``
    (query plus some of the key columns) limits the result to those pairs; the
    statistics stay those of the whole corpus, and only its chunks are tokenised
    for the scores. The corpus is read twice: once for the vocabulary, unless a
    written ``text_vocabulary`` of it is given, once for the scores.
    """
    if pairs is not None:
        pairs = materialise(pairs.distinct())
        by = [c for c in key if c in pairs.columns]
        only = broadcast_if_small(pairs.select(*by).distinct())
    t = [tenant] if tenant else []
    if isinstance(chunks, LexicalIndex):
        toks, vocab = chunks.chunks.select(*dict.fromkeys([*key, *t]), "toks", "dl", "dt"), chunks.vocabulary
    else:
        toks = tokenized(chunks if pairs is None else chunks.join(only, by, "left_semi"), key, text, tenant)
        vocab = materialise(text_vocabulary(chunks, text, tenant)) if vocab is None else vocab
    idf = term_weights(vocab, tenant)
    qt = query_terms(queries, qid, qtext, tenant)
    hint = F.broadcast if _fits(qt) else (lambda d: d)
    w = hint(qt).join(idf, [*t, "term"]).select(
        qid, *t, "term", "qd", "avgdl", (F.col("qtf") * F.col("idf")).alias("w"))
    part = F.col("w") * F.col("tf") * (K1 + 1) / (
        F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    post, on = postings(toks, key, tenant), [*t, "term"]
    if pairs is not None:
        wanted = toks.join(only, by, "left_semi") if isinstance(chunks, LexicalIndex) else toks
        post, on = postings(wanted, key, tenant).join(pairs.select(qid, *by).distinct(), by), [qid, *t, "term"]
    agg = post.join(hint(w), on).groupBy(qid, *key, "qd", "dt").agg(
        F.sum(part).alias("bm25"), F.count(F.lit(1)).alias("common"))
    return agg.select(qid, *key, "bm25", overlap_from_counts(
        F.col("common"), F.col("qd"), F.col("dt")).alias("overlap"))


def ranked(scores: DataFrame, qid: str, score: str, key: list[str], k: int) -> DataFrame:
    return top_k(scores, [qid], [F.round(F.col(score), TIE).desc(), *[F.col(c) for c in key]], k)


@dataclass(frozen=True)
class LexicalIndex:
    """A corpus tokenised once.

    ``chunks``: chunk rows with token list, length and distinct count;
    ``vocabulary``: its counts; ``postings``: inverted segments, per term the
    chunks' places and impacts with the highest impact of every block, and one
    row of the empty term with the segment's chunks.
    """
    chunks: DataFrame
    vocabulary: DataFrame
    postings: DataFrame
    key: list[str]
    tenant: str | None


def build_index(chunks: DataFrame, key: list[str], path: str, text: str = "text", tenant: str | None = None,
                keep: list[str] | None = None) -> LexicalIndex:
    """Write the index below ``path`` and open it; ``keep`` names further chunk columns (such as boosts) to carry.

    With a tenant the chunk table is partitioned by it, so a search of few
    tenants reads theirs only.
    """
    spark = chunks.sparkSession
    cols = list(dict.fromkeys([*key, *([tenant] if tenant else []), *(keep or [])]))
    src = chunks.select(*cols, F.col(text).alias("_text"))
    t = src.mapInArrow(lambda batches: L.token_lists(batches, "_text", cols), T.StructType(
        [*(src.schema[c] for c in cols), *T._parse_datatype_string("toks array<string>, dl int, dt int").fields]))
    w = t.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(tenant) if tenant and tenant not in key else w).parquet(f"{path}/chunks")
    toks = spark.read.schema(t.schema).parquet(f"{path}/chunks")
    v = vocabulary(toks, tenant) if tenant else text_vocabulary(toks, "toks")
    v.write.mode("overwrite").parquet(f"{path}/vocabulary")
    _invert(toks, v, key, tenant, path)
    meta = spark.createDataFrame([(list(key), tenant)], "key array<string>, tenant string")
    meta.write.mode("overwrite").json(f"{path}/meta")
    return load_index(spark, path)


def load_index(spark, path: str) -> LexicalIndex:
    m = spark.read.schema("key array<string>, tenant string").json(f"{path}/meta").first()
    chunks, vocab, post = (spark.read.parquet(f"{path}/{x}") for x in ("chunks", "vocabulary", "postings"))
    return LexicalIndex(chunks, vocab, post, list(m["key"]), m["tenant"])


def _average_length(vocab: DataFrame, tenant: str | None) -> DataFrame:
    return vocab.filter("term = ''").select(*([tenant] if tenant else []), (F.col("dl_sum") / F.col("df")).alias("_avgdl"))


def _invert(toks: DataFrame, vocab: DataFrame, key: list[str], tenant: str | None, path: str, segment: int = SEGMENT) -> None:
    """Write the postings of the index's token lists."""
    number = [f.name for f in toks.schema if f.name not in (*key, "toks", "dl", "dt") and isinstance(f.dataType, T.NumericType)]
    vocab = toks.sparkSession.read.parquet(f"{path}/vocabulary")
    segments(toks, "toks", vocab, key, number, tenant, segment).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/postings")


def segments(chunks: DataFrame, text: str, vocab: DataFrame, key: list[str], number: list[str], tenant: str | None,
             segment: int = SEGMENT) -> DataFrame:
    """Postings of texts or token lists: tasks invert what they read in segments of at most ``segment`` chunks of one tenant; no shuffle.

    A chunk of a null tenant is met by no query and gets no postings. ``number``
    names numeric columns to carry in the segments' heads.
    """
    head, t = list(dict.fromkeys([*key, *number])), [tenant] if tenant else []
    avg = _average_length(vocab, tenant)
    src = chunks.select(*dict.fromkeys([*head, *t]), F.col(text).alias("_text"))
    src = src.join(avg, tenant) if tenant else src.withColumn("_avgdl", avg.select("_avgdl").scalar())
    fields = [*[chunks.schema[c] for c in t], T.StructField("segment", T.LongType()), T.StructField("term", T.StringType()),
              T.StructField("rows", T.ArrayType(T.IntegerType())), T.StructField("sat", T.ArrayType(T.DoubleType())),
              T.StructField("tops", T.ArrayType(T.DoubleType())), T.StructField("head", T.ArrayType(T.StructType([*(chunks.schema[c] for c in head), T.StructField("dt", T.IntegerType())])))]
    schema = T.StructType(fields)
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        from pyspark import TaskContext
        at, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush(rows):
            nonlocal at, held, size
            table = pa.Table.from_batches(held)
            whole, held, size = table.slice(0, rows).combine_chunks().to_batches()[0], table.slice(rows).to_batches(), table.num_rows - rows
            for value, part in L.by_tenant(whole, tenant):
                terms, off, rows, sat, dt = L.inverted(part.column("_text"), np.asarray(part.column("_avgdl"))[0])
                tops, tops_at = L.block_tops(off, sat)
                lists = lambda o, v, ty: pa.ListArray.from_arrays(pa.array(np.r_[0, o].astype(np.int32)), pa.array(v, ty))
                n = len(terms) + 1
                chunks = pa.StructArray.from_arrays([*(part.column(c) for c in head), pa.array(dt, pa.int32())], fields=list(arrow.field("head").type.value_type))
                cols = {"segment": pa.array(np.full(n, at)), "term": pa.concat_arrays([pa.array([""]), terms.cast(pa.string())]), "rows": lists(off, rows.astype(np.int32), pa.int32()),
                        "sat": lists(off, sat, pa.float64()), "tops": lists(tops_at, tops, pa.float64()),
                        "head": pa.ListArray.from_arrays(pa.array(np.r_[0, np.full(n, len(chunks))].astype(np.int32)), chunks)}
                if tenant:
                    cols[tenant] = pa.array([value] * n, arrow.field(tenant).type)
                yield pa.RecordBatch.from_arrays([cols[f.name].cast(f.type) for f in arrow], schema=arrow)
                at += 1
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            while size >= segment:
                yield from flush(segment)
        if size:
            yield from flush(size)
        pa.default_memory_pool().release_unused()
    return src.mapInArrow(run, schema)


def _cells(post: DataFrame, qt: DataFrame, vocab: DataFrame, qid: str, tenant: str | None, max_cells: int) -> DataFrame:
    """Postings joined with the query terms, in cells: a slab of queries and a group of segments meet once.

    Postings of terms that no query has are left behind. The slabs grow with the
    queries, the groups with the chunks, so no cell grows; rows are sorted by
    cell, the query terms of each before its postings.
    """
    t = [tenant] if tenant else []
    asked, chunks = qt.count(), vocab.filter("term = ''").agg(F.sum("df")).first()[0] or 0
    slabs, groups = -(-asked // max(max_cells, CELL_TERMS)) or 1, max(_slots(post), -(-chunks // (CELL_SEGMENTS * SEGMENT)))
    hint = F.broadcast if _fits(qt) else (lambda d: d)
    w = hint(qt).join(term_weights(vocab, tenant), [*t, "term"]).select(
        qid, *t, "term", "qd", "avgdl", (F.col("qtf") * F.col("idf")).alias("w"))
    terms = qt.select("term").union(post.sparkSession.createDataFrame([("",)], "term string")).distinct()
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    slab, group = F.pmod(F.xxhash64(qid), F.lit(slabs)), F.pmod(F.xxhash64("segment"), F.lit(groups))
    left = post.join(hint(terms), "term", "left_semi").select("*", every(slabs).alias("_s")).select(
        "*", (F.col("_s") * groups + group).alias("_cell")).drop("_s")
    right = w.select("*", every(groups).alias("_g")).select("*", (slab * groups + F.col("_g")).alias("_cell")).drop("_g")
    return left.unionByName(right, allowMissingColumns=True).repartition(slabs * groups, "_cell").sortWithinPartitions("_cell", F.col("segment").asc_nulls_first(), "term")


def lexical_topk(chunks: DataFrame | LexicalIndex, queries: DataFrame, key: list[str], k: int, bm25_weight: float = 1.0,
                 overlap_weight: float = 0.0, boost: str | None = None, text: str = "text", qid: str = "query_id",
                 qtext: str = "text", tenant: str | None = None, max_cells: int = MAX_QUERY_TERMS, work: bool = False,
                 vocab: DataFrame | None = None) -> DataFrame:
    """Best ``k`` chunks per query by bm25_weight * bm25 + overlap_weight * overlap (+ a chunk column).

    While the (query, term) rows stay below a checked bound, they go to every
    task. A stored index is then searched in its postings: those of the query
    terms alone are read, segment by segment, and walked with exact bounds. A
    chunk table is scored where it lies: each batch of texts is inverted
    for the query terms and walked in the same way. Each task passes on its own
    k best per query; no token is shuffled. Beyond the bound postings and query
    terms are joined in cells, a slab of queries and a group of segments, each
    walked in the same way. Chunks whose boost is null are not ranked. ``work`` returns (blocks, read) per task in place of the
    hits: how many blocks of postings the queries have and how many were read.
    ``vocab`` is a written ``text_vocabulary`` of the chunk table, if there is one.
    """
    index = chunks if isinstance(chunks, LexicalIndex) else None
    chunks = index.chunks if index else chunks
    t = [tenant] if tenant else []
    qt = query_terms(queries, qid, qtext, tenant)
    cols = list(dict.fromkeys([*key, *t, *([boost] if boost else [])]))
    mix = bm25_weight * F.col("bm25") + overlap_weight * F.col("overlap")
    inverted = index and set(cols) <= {*index.postings.columns, *(f.name for f in index.postings.schema["head"].dataType.elementType)}
    if index:
        vocab = index.vocabulary
    elif vocab is None:
        vocab = materialise(text_vocabulary(chunks, text, tenant))
    qtype, types = queries.schema[qid].dataType.simpleString(), {f.name: f.dataType.simpleString() for f in chunks.schema}
    schema = "blocks long, read long" if work else ", ".join(
        [f"{qid} {qtype}", *[f"{c} {types[c]}" for c in key], "bm25 double", "overlap double", "score double"])
    if not _fits(qt, max_cells):
        post = index.postings if inverted else segments(chunks, "toks" if index else text, vocab, key, [boost] if boost else [], tenant)
        cells = _cells(post, qt, vocab, qid, tenant, max_cells)
        hits = cells.mapInArrow(lambda batches: L.met(batches, k, bm25_weight, overlap_weight, qid, key, tenant, boost), schema)
        return ranked(hits, qid, "score", key, k)
    idf = term_weights(vocab, tenant)
    w = F.broadcast(qt).join(idf, [*t, "term"]).select(qid, *t, "term", "qd", "avgdl", (F.col("qtf") * F.col("idf")).alias("w")).toPandas()
    bc = chunks.sparkSession.sparkContext.broadcast(vars(L.Asked.of(w, qid, tenant)))  # no class of ours: workers may have no copy of the package

    def told(search, held):
        if work:
            yield pa.RecordBatch.from_arrays([pa.array([search.blocks]), pa.array([search.read])], ["blocks", "read"])
        else:
            yield from held.batches(qid)

    def read(batches):
        asked = L.Asked(**bc.value)
        search = L.Search(asked, k, bm25_weight, overlap_weight)
        held, terms = L.Held(search, key), pa.array(asked.terms, pa.string())
        for batch in batches:
            for value, part in L.by_tenant(batch, tenant):
                c = asked.columns(value)
                if len(c):
                    held.add(part, search.segment(L.text_segment(part, "_text", asked, terms, asked.avgdl[c[0]], boost), c))
        yield from told(search, held)

    def scan(batches):
        asked = L.Asked(**bc.value)
        search = L.Search(asked, k, bm25_weight, overlap_weight)
        held, terms = L.Held(search, key), pa.array(asked.terms, pa.string())
        for batch in batches:
            for value, part in L.by_tenant(batch, tenant):
                c = asked.columns(value)
                if len(c):
                    held.add(part, search.segment(L.token_segment(part, asked, terms, asked.avgdl[c[0]], boost), c))
        yield from told(search, held)

    def walk(batches):
        search = L.Search(L.Asked(**bc.value), k, bm25_weight, overlap_weight)
        walked = L.Walk(search, key, tenant, boost)
        for batch in batches:
            walked.add(batch)
        walked.done()
        yield from told(search, walked.held)

    if inverted:
        wanted = chunks.sparkSession.createDataFrame([("",), *[(x,) for x in bc.value["terms"]]], "term string")
        post = index.postings.join(F.broadcast(wanted), "term")
        if tenant:
            who = chunks.sparkSession.createDataFrame([(x,) for x in w[tenant].drop_duplicates().tolist()], T.StructType([queries.schema[tenant]]))
            post = post.join(F.broadcast(who), tenant)
        hits = post.repartition(_slots(post), "segment").sortWithinPartitions("segment", "term").select(
            *t, "segment", "term", "rows", "sat", "tops", "head").mapInArrow(walk, schema)
    elif index:
        hits = index.chunks.select(*cols, "toks", "dl", "dt").mapInArrow(scan, schema)
    else:
        hits = chunks.select(*cols, F.col(text).alias("_text")).mapInArrow(read, schema)
    return hits if work else ranked(hits, qid, "score", key, k)


def bm25_topk(chunks, queries, key, k=5, **kw) -> DataFrame:
    return lexical_topk(chunks, queries, key, k, **kw)


def min_max(score: Column, qid: str, eps: float = 1e-9) -> Column:
    """Min-max over a query's rows; a flat list becomes 1.0."""
    w = Window.partitionBy(qid)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return F.when(score.isNull(), None).when(hi - lo < eps, F.lit(1.0)).otherwise((score - lo) / (hi - lo))


def bm25_pool(chunks, queries, key, pool=24, **kw) -> DataFrame:
    """Pool of the best rows with their min-max score (normalised before any filter)."""
    qid = kw.get("qid", "query_id")
    return lexical_topk(chunks, queries, key, pool, **kw).withColumn("score", min_max(F.col("bm25"), qid))


def filter_or_all(hits: DataFrame, qid: str, keep: Column) -> DataFrame:
    """Rows that pass; all rows of a query where none passes."""
    anyhit = F.max(F.coalesce(keep, F.lit(False)).cast("int")).over(Window.partitionBy(qid))
    return hits.withColumn("_k", F.coalesce(keep, F.lit(False))).withColumn("_any", anyhit).filter(
        F.col("_k") | (F.col("_any") == 0)).drop("_k", "_any")


# ---- dense -----------------------------------------------------------------
MAX_QUERY_FLOATS = 16_000_000  # broadcast bound for the query matrix


def _unit_rows(vs) -> np.ndarray:
    m = np.asarray(list(vs), dtype=np.float64)
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(n == 0, 1.0, n)


def _cell_topk(sims: np.ndarray, k: int, floor: np.ndarray | None = None):
    """Row, column and value of everything at or above each column's k-th best."""
    if sims.shape[0] > k:
        kth = np.partition(sims, sims.shape[0] - k, axis=0)[sims.shape[0] - k]
    else:
        kth = np.full(sims.shape[1], -np.inf)
    if floor is not None:
        kth = np.maximum(kth, floor)
    r, c = np.nonzero(sims >= kth - 10.0 ** -TIE)
    return r, c, sims[r, c], kth


CELL = 2_048  # vectors, and queries, of one block of similarities


def _dense_hits(batches, qids: np.ndarray, m: np.ndarray, k: int, key: str, vec: str, qid: str):
    """Frames (query, key, similarity) that hold the ``k`` best vectors of every query; the similarities of ``CELL`` vectors
    and as many queries are held at a time, so memory does not grow with vectors times queries."""
    if not len(qids):
        return
    floor = np.full(len(qids), -np.inf)
    held: list[pd.DataFrame] = []
    size = 0
    for pdf in batches:
        for at in range(0, len(pdf), CELL):
            part = pdf.iloc[at:at + CELL]
            rows, keys = _unit_rows(part[vec]), part[key].to_numpy()
            for q in range(0, len(qids), CELL):
                r, c, s, floor[q:q + CELL] = _cell_topk(rows @ m[q:q + CELL].T, k, floor[q:q + CELL])
                if len(r):
                    held.append(pd.DataFrame({"c": c + q, qid: qids[c + q], key: keys[r], "similarity": s}))
                    size += len(r)
            if size > 4 * k * len(qids) + 10_000:
                allh = pd.concat(held)
                floor = _held_floor(allh["c"].to_numpy(), allh["similarity"].to_numpy(), k, floor)
                held = [allh[allh["similarity"].to_numpy() >= floor[allh["c"].to_numpy()] - 10.0 ** -TIE]]
                size = len(held[0])
    for h in held:
        yield h[h["similarity"].to_numpy() >= floor[h["c"].to_numpy()] - 10.0 ** -TIE][[qid, key, "similarity"]]


def dense_topk(vectors: DataFrame, queries: DataFrame, key: str, vec: str, qid: str, qvec: str, k: int,
               rows_per_cell: int = 50_000, max_query_floats: int = MAX_QUERY_FLOATS) -> DataFrame:
    """Exact cosine top-k: (query, key, similarity, rank).

    A query matrix below the checked bound goes to every task once and the
    vectors stream past it where they lie; each task passes on its own k best
    per query. Beyond the bound both sides are cut in blocks that meet once per
    (vector block, query block), so no side has to fit one task.
    """
    kt = vectors.schema[key].dataType.simpleString()
    qt = queries.schema[qid].dataType.simpleString()
    schema = f"{qid} {qt}, {key} {kt}, similarity double"
    dims = queries.select(F.max(F.size(qvec))).first()[0] or 1
    bound = max(1, max_query_floats // dims)
    head = queries.select(qid, qvec).limit(bound + 1).toPandas()
    if len(head) <= bound:
        ids = head[qid].to_numpy()
        mat = _unit_rows(head[qvec]) if len(head) else np.zeros((0, dims))
        bc = vectors.sparkSession.sparkContext.broadcast((ids, mat))

        def scan(batches):
            yield from _dense_hits(batches, *bc.value, k, key, vec, qid)
        cand = vectors.select(key, vec).mapInPandas(scan, schema)
    else:
        n, q = vectors.count(), queries.count()
        vb, qb = -(-n // rows_per_cell), -(-q // max(1, min(bound, rows_per_cell)))
        v = vectors.select(F.pmod(F.xxhash64(key), F.lit(vb)).alias("_v"),
                           F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("_q"), key, vec)
        u = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(vb - 1).cast("long"))).alias("_v"),
                           F.pmod(F.xxhash64(qid), F.lit(qb)).cast("int").alias("_q"), F.col(qid), F.col(qvec).alias("_qv"))

        def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty or right.empty:
                return pd.DataFrame({qid: [], key: [], "similarity": []})
            r, c, s, _ = _cell_topk(_unit_rows(left[vec]) @ _unit_rows(right["_qv"]).T, k)
            return pd.DataFrame({qid: right[qid].to_numpy()[c], key: left[key].to_numpy()[r], "similarity": s})
        cand = v.groupBy("_v", "_q").cogroup(u.groupBy("_v", "_q")).applyInPandas(cell, schema)
    return ranked(cand, qid, "similarity", [key], k)


def dense_cutoff(hits: DataFrame, max_distance: float = 0.7) -> DataFrame:
    """Distance test after the top-k, so fewer than k rows may be left."""
    return hits.filter(1 - F.col("similarity") < max_distance)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")),
                                   F.lit(0.0), lambda s, v: s + v)
    d = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(d == 0, F.lit(0.0)).otherwise(dot(a, b) / d)


# ---- fusion and rerank -------------------------------------------------------
def hybrid_fusion(dense: DataFrame, lexical: DataFrame, qid: str, key: list[str], k: int | None,
                  alpha: float = 0.55, d_score: str = "similarity", l_score: str = "bm25") -> DataFrame:
    """Union of candidates; both sides present: a*d + (1-a)*b of the min-max scores, else the one side."""
    d = dense.select(qid, *key, F.greatest(F.lit(0.0), F.col(d_score)).alias("dense"))
    b = lexical.select(qid, *key, F.col(l_score).alias("bm25"))
    m = d.join(b, [qid, *key], "full_outer")
    dn, bn = min_max(F.col("dense"), qid), min_max(F.col("bm25"), qid)
    m = m.withColumn("dn", dn).withColumn("bn", bn)
    score = F.when(F.col("dn").isNull(), F.col("bn")).when(F.col("bn").isNull(), F.col("dn")).otherwise(
        alpha * F.col("dn") + (1 - alpha) * F.col("bn"))
    m = m.withColumn("score", score)
    return m if k is None else ranked(m, qid, "score", key, k)


def rerank_blend(hits: DataFrame, qid: str, key: list[str], base: str, rerank: str, k: int | None = None,
                 alpha: Column | float = 0.65) -> DataFrame:
    """alpha * norm(rerank) + (1 - alpha) * norm(base); the rerank score is any given column."""
    a = alpha if isinstance(alpha, Column) else F.lit(alpha)
    m = hits.withColumn("rerank_norm", min_max(F.col(rerank), qid)).withColumn("base_norm", min_max(F.col(base), qid))
    m = m.withColumn("final_score", a * F.col("rerank_norm") + (1 - a) * F.col("base_norm"))
    return m if k is None else ranked(m.drop("rank"), qid, "final_score", key, k)


def head_tail_rerank(hits: DataFrame, qid: str, key: list[str], base: str, rerank: str, head: int = 16,
                     alpha: float = 0.65) -> DataFrame:
    """Only the first ``head`` rows are rescored; the others follow in their old order."""
    w = Window.partitionBy(qid, "_tail")
    h = hits.withColumn("_tail", F.col("rank") > head)
    def norm(c):
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        return F.when(hi - lo < 1e-9, 1.0).otherwise((F.col(c) - lo) / (hi - lo))
    h = h.withColumn("final_score", F.when(~F.col("_tail"), alpha * norm(rerank) + (1 - alpha) * norm(base)))
    order = Window.partitionBy(qid).orderBy(F.col("_tail"), F.round("final_score", TIE).desc_nulls_last(), "rank")
    return h.withColumn("new_rank", F.row_number().over(order)).drop("_tail")


def hint_boost(hits: DataFrame, hints, question: str, text: str, score: str, qid: str, key: list[str]) -> DataFrame:
    """+weight for every needle found whose trigger is in the question; the needles are kept (five)."""
    q, t = F.lower(F.col(question)), F.lower(F.col(text))
    found = F.array_compact(F.array(*[
        F.when(_any_of(q, trig) & t.contains(n.lower()), F.struct(F.lit(n.lower()).alias("n"), F.lit(float(w)).alias("w")))
        for trig, needles, w in hints for n in needles]))
    h = hits.withColumn("_f", found)
    h = h.withColumn("boost", F.aggregate("_f", F.lit(0.0), lambda a, e: a + e["w"])).withColumn(
        "boost_hits", F.slice(F.transform("_f", lambda e: e["n"]), 1, 5)).drop("_f")
    h = h.withColumn("boosted", F.col(score) + F.col("boost"))
    w = Window.partitionBy(qid).orderBy(F.round("boosted", TIE).desc(), *key)
    return h.withColumn("boost_rank", F.row_number().over(w))


def _any_of(c: Column, needles) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | c.contains(n.lower())
    return out


def inject_rows(hits: DataFrame, constant: DataFrame, qid: str, source: str, score: str) -> DataFrame:
    """Put given rows first; hits of the same query and source are replaced."""
    rest = hits.join(constant.select(qid, source).distinct(), [qid, source], "left_anti")
    return rest.unionByName(constant, allowMissingColumns=True)


def numeric_context_boost(text: Column, unit_re: str = "people", near: tuple[str, ...] = ("employees", "staff"),
                          total_words: tuple[str, ...] = ("total",), prefer_total: bool = True) -> Column:
    """Bonus for numbers that stand next to the right words, at most 0.45, less a penalty for number grids."""
    ctx = F.regexp_extract_all(text, F.lit(r"((?:.{0,48})\b\d{1,3}(?:,?\d{3})*\s*(?:%s).{0,8})" % unit_re), F.lit(1))
    def one(c):
        num = F.replace(F.regexp_extract(c, r"(\d{1,3}(?:,?\d{3})*)\s*(?:%s)" % unit_re, 1), F.lit(","), F.lit("")).try_cast("double")
        bonus = F.lit(0.06) + F.when(_any_of(F.lower(c), near), 0.10).otherwise(0.0)
        bonus = bonus + F.when(_any_of(F.lower(c), total_words), 0.14 if prefer_total else 0.08).otherwise(0.0)
        many = F.size(F.regexp_extract_all(c, F.lit(r"(\b\d{1,2}\s*(?:%s))" % unit_re), F.lit(1))) >= 2
        return F.when(num < 80, F.lit(-0.08)).otherwise(bonus - F.when(many, 0.12).otherwise(0.0))
    total = F.least(F.aggregate(F.transform(ctx, one), F.lit(0.0), lambda a, b: a + F.coalesce(b, F.lit(0.0))), F.lit(0.45))
    grid = F.size(F.regexp_extract_all(text, F.lit(r"(\d+\.\d+)"), F.lit(1)))
    return total - F.when(grid >= 6, F.least(F.lit(0.20), 0.03 * grid)).otherwise(0.0)


def promote(hits: DataFrame, qid: str, first: Column, rank: str = "rank") -> DataFrame:
    """Rows with ``first`` go to the front, order otherwise kept."""
    w = Window.partitionBy(qid).orderBy(F.coalesce(first, F.lit(False)).desc(), rank)
    return hits.withColumn("new_rank", F.row_number().over(w))


def family_order(hits: DataFrame, qid: str, preferred: Column, noisy: Column, year_match: Column) -> DataFrame:
    """Stable partition: preferred, then clean, then same year."""
    w = Window.partitionBy(qid).orderBy(preferred.desc(), noisy.asc(), year_match.desc(), "rank")
    return hits.withColumn("new_rank", F.row_number().over(w))


def trust_order(hits: DataFrame, qid: str, trust: Column, bias: Column, score: str, key: list[str]) -> DataFrame:
    w = Window.partitionBy(qid).orderBy((trust + F.when(bias, 25).otherwise(0)).desc(), F.round(score, TIE).desc(), *key)
    return hits.withColumn("new_rank", F.row_number().over(w))


def document_scores(hits: DataFrame, qid: str, doc: str, score: str) -> DataFrame:
    return hits.groupBy(qid, doc).agg(F.max(score).alias("doc_score"), F.count(F.lit(1)).alias("unit_count"))


def plan_coverage(unit_hits: DataFrame, planned: DataFrame, qid: str, doc: str) -> DataFrame:
    """Share of a query's planned documents found among its hits; no plan counts as 1.0."""
    found = unit_hits.select(qid, doc).distinct().withColumn("_hit", F.lit(1))
    return planned.join(found, [qid, doc], "left").groupBy(qid).agg(
        F.count(F.lit(1)).alias("planned"), F.count("_hit").alias("hit")).withColumn(
        "coverage", F.when(F.col("planned") == 0, 1.0).otherwise(F.col("hit") / F.col("planned")))


def per_doc_topk(scores: DataFrame, qid: str, doc: str, score: str, key: list[str], per_doc: int, total: int) -> DataFrame:
    """Best ``per_doc`` of each planned document first, then the global order up to ``total``.

    ``scores`` has ``planned`` (boolean). One row per (query, unit).
    """
    order = [F.round(F.col(score), TIE).desc(), *[F.col(c) for c in key]]
    role = top_k(scores.filter("planned"), [qid, doc], order, per_doc, "_r").withColumn("_first", F.lit(1)).drop("_r")
    glob = top_k(scores, [qid], order, total, "_r").withColumn("_first", F.lit(0)).drop("_r")
    both = role.unionByName(glob)
    grp = key if doc in key else [doc, *key]
    one = both.groupBy(qid, *grp).agg(F.max("_first").alias("_first"), F.max(score).alias(score))
    picked = top_k(one, [qid], [F.col("_first").desc(), *order], total, "_r").drop("_r", "_first")
    return top_k(picked, [qid], order, total)


def expand_hits(hits: DataFrame, pool: DataFrame, keys: list[str], fits: Column) -> DataFrame:
    """All further rows of the pool that fit, added behind the hits."""
    extra = pool.filter(fits).join(hits.select(*keys), keys, "left_anti")
    return hits.unionByName(extra, allowMissingColumns=True)


def rank_of_first(hits: DataFrame, qid: str, match: Column) -> DataFrame:
    """1-based rank of the first fitting hit, null when none fits."""
    return hits.groupBy(qid).agg(F.min(F.when(match, F.col("rank"))).alias("first_rank"))


# Names of the modes.
MODES = ("semantic_dense", "bm25_lexical", "semantic_dense_rerank", "hybrid_dense_bm25", "hybrid_dense_bm25_rerank")


def retrieve(mode: str, dense: DataFrame | None, lexical: DataFrame | None, qid: str, key: list[str], k: int,
             rerank: DataFrame | None = None) -> DataFrame:
    """One schema (query, key, score, rank) for every mode; a missing side is an empty side."""
    if mode not in MODES:
        raise ValueError(f"unknown retrieval mode {mode}")
    if mode.startswith("semantic_dense"):
        base = dense.select(qid, *key, F.col("similarity").alias("score"))
    elif mode == "bm25_lexical":
        base = lexical.select(qid, *key, min_max(F.col("bm25"), qid).alias("score"))
    else:
        base = hybrid_fusion(dense, lexical, qid, key, None).select(qid, *key, "score")
    if mode.endswith("_rerank"):
        j = base.join(rerank.select(qid, *key, "rerank"), [qid, *key], "left").fillna({"rerank": 0.0})
        base = rerank_blend(j, qid, key, "score", "rerank").select(qid, *key, F.col("final_score").alias("score"))
    return ranked(base, qid, "score", key, k)


def answer_record(hits: DataFrame, queries: DataFrame, qid: str, source: str, text: str, score: str,
                  high: float = 0.55, medium: float = 0.35, refuse: Column | None = None, evidence_chars: int | None = None,
                  insufficient: str = "insufficient information") -> DataFrame:
    """One row per query: extractive answer, confidence, insufficient flag, evidence array (k entries)."""
    from dossier.functions.text import extractive_answer
    ev = hits.groupBy(qid).agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col(source).alias("source"), F.round(score, 4).alias("score"),
                                             (F.substring(text, 1, evidence_chars) if evidence_chars else F.col(text)).alias("text")))).alias("evidence"),
        F.max(score).alias("_best"), F.min_by(text, "rank").alias("_top"))
    out = queries.join(ev, qid, "left")
    no = F.coalesce(refuse, F.lit(False)) if refuse is not None else F.lit(False)
    ans = F.when(no | F.col("_top").isNull(), F.lit(insufficient)).otherwise(
        extractive_answer(F.col("question"), F.col("_top"), insufficient))
    out = out.withColumn("answer", ans)
    return out.withColumn("insufficient", F.lower("answer").contains(insufficient)).withColumn(
        "confidence", F.when(no | F.col("_best").isNull(), "low").when(F.col("_best") >= high, "high").when(
            F.col("_best") >= medium, "medium").otherwise("low")).drop("_best", "_top")


def generate_answers(contexts: DataFrame, generate=None, context: str = "context", question: str = "question",
                     reason: str = "abstain_reason") -> DataFrame:
    """Apply a caller's pandas UDF (context, question) -> text to rows no rule holds back; none by default."""
    text = generate(F.col(context), F.col(question)) if generate is not None else F.lit(None).cast("string")
    return contexts.withColumn("generated", F.when(F.col(reason).isNull(), text))
