"""The whole way in two calls: documents to a stored index, a table of questions to answers with evidence."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dossier.operators import ranking as R
from dossier.operators.bounds import broadcast_if_small
from dossier.operators.chunking import chunk_chars
from dossier.session import materialise


def ingest(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("source",),
           tenant: str | None = None, size: int = 900, overlap: int = 150) -> R.LexicalIndex:
    """Chunk the documents and write the searchable index below ``path``.

    ``keep`` names the document columns that answers, filters and boosts need.
    The chunk texts are part of the index, so answering reads nothing else.
    """
    cols = list(dict.fromkeys([key, *([tenant] if tenant else []), *keep]))
    chunks = chunk_chars(documents.select(*cols, F.col(text).alias("text")), "text", size, overlap)
    return R.build_index(chunks, [key, "chunk_id"], path, tenant=tenant, keep=[c for c in cols if c != key] + ["text"])


def answer(queries: DataFrame, index: R.LexicalIndex, k: int = 5, mode: tuple[float, float] = (1.0, 0.0), boost: str | None = None,
           keep: Column | None = None, refuse: Column | None = None, qid: str = "query_id", question: str = "text",
           source: str = "source") -> DataFrame:
    """One row per query: answer, confidence, insufficient flag, evidence.

    ``mode`` weighs BM25 and overlap; ``boost`` is a numeric chunk column added
    to the score. ``keep`` is a condition on chunk and query columns (a year, a
    kind): where none of a query's hits fits it, all of them stay. ``refuse`` is
    a condition on the query row under which no answer is given. Scores are
    min-max normal before the filter. Queries without a hit are insufficient.
    """
    hits = R.bm25_pool(index, queries, index.key, k, bm25_weight=mode[0], overlap_weight=mode[1], boost=boost, qid=qid, qtext=question,
                       tenant=index.tenant)
    hits = materialise(hits.select(qid, *index.key, "score", "rank"))
    told = index.chunks.drop("toks", "dl", "dt").join(broadcast_if_small(hits), index.key)
    if keep is not None:
        more = [c for c in queries.columns if c not in told.columns]
        told = R.filter_or_all(told.join(queries.select(qid, *more), qid) if more else told, qid, keep)
    return R.answer_record(told, queries.withColumnRenamed(question, "question"), qid, source, "text", "score", refuse=refuse)
