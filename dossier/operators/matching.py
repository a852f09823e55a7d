"""Which texts contain which of many strings: one automaton over all strings, one pass over the texts."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from dossier.operators.bounds import best_per_key
from dossier.session import materialise

SLAB_CHARS = 4_000_000  # characters of distinct strings in one automaton; an automaton takes about a hundred bytes for each


def contains_pairs(texts: DataFrame, text_key: str, text: str, needles: DataFrame, needle_key: str, needle: str,
                   fold: bool = False, slab_chars: int = SLAB_CHARS) -> DataFrame:
    """(text key, needle key), once each, where the text contains the needle as a plain substring.

    The needles' distinct strings go to the workers, whose number of characters
    is measured first: up to ``slab_chars`` they make one automaton and the texts
    are read once; beyond that they are cut in slabs of at most that size, each
    with a pass of its own whose result is written, so the memory of a worker
    does not grow with the needles. Only keys leave the pass. ``fold`` compares
    in lower case. Null and empty needles are in no text, null texts contain
    nothing; repeated needles are found once per key, repeated texts give one pair.
    """
    low = F.lower if fold else (lambda c: c)
    spark = texts.sparkSession
    n = needles.select(F.col(needle_key), low(F.col(needle)).alias("_n")).filter("_n <> ''").distinct()
    words = materialise(n.select("_n").distinct().withColumn("_w", F.xxhash64("_n")))
    size = words.agg(F.sum(F.length("_n"))).first()[0] or 0
    slabs = max(1, -(-2 * size // slab_chars)) if size > slab_chars else 1  # of half the size on average
    src = texts.select(F.col(text_key), low(F.col(text)).alias("_t"))
    schema = T.StructType([texts.schema[text_key], T.StructField("_n", T.StringType())])
    found = None
    for i in range(slabs):
        part = words if slabs == 1 else words.filter(F.pmod("_w", F.lit(slabs)) == i)
        sent = spark.sparkContext.broadcast([r["_n"] for r in part.select("_n").toLocalIterator()])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            import ahocorasick
            machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for j, w in enumerate(sent.value):
                machine.add_word(w, j)
            if not len(machine):
                return
            machine.make_automaton()
            names = pa.array(sent.value, pa.string())
            for batch in batches:
                hits = [{j for _, j in machine.iter(t)} if t else () for t in batch.column(1).to_pylist()]
                at = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
                if len(at):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), names.take(pa.array([j for h in hits for j in h], pa.int64()))],
                                                     [text_key, "_n"])
        part = src.mapInArrow(run, schema)
        if slabs > 1:
            part = materialise(part)
            sent.unpersist()
        found = part if found is None else found.unionByName(part)
    return found.distinct().join(n, "_n").select(text_key, needle_key).distinct()


# What a kind of document adds to a match (words anywhere in the id, its ending) and what an ending takes away.
KIND_WORDS = {"sustainability_report": (("sustain", "지속가능", "impact", "임팩트"), 40.0), "governance_report": (("지배구조", "governance", "dart", "공시"), 35.0)}
KIND_ENDS = {"sustainability_report": ("_pdf", 8.0), "governance_report": ("_xml", 6.0)}
KIND_ALIASES = {"dart_filing": "governance_report"}
END_LOSS = ("_json", 5.0)


def hint_score(doc: Column, hint: Column, kind: Column) -> Column:
    """Length of a hint that is known to be in the document id, with what the wanted kind adds."""
    low, score = F.lower(doc), F.length(hint).cast("double")
    for name in KIND_WORDS:
        words, more = KIND_WORDS[name]
        end, bit = KIND_ENDS[name]
        same = kind.isin(name, *[a for a, k in KIND_ALIASES.items() if k == name])
        inside = F.lit(False)
        for w in words:
            inside = inside | low.contains(w)
        score = score + F.when(same & inside, more).otherwise(0.0) + F.when(same & low.endswith(end), bit).otherwise(0.0)
    return score - F.when(low.endswith(END_LOSS[0]), END_LOSS[1]).otherwise(0.0)


def matching_documents(docs: DataFrame, doc: str, hints: DataFrame, logical: str, hint: str, kind: str, least: float = 1.0,
                       slab_chars: int = SLAB_CHARS) -> DataFrame:
    """(logical, doc, score): every corpus document that a logical document may stand for.

    ``hints`` has one row per (logical, hint) with the wanted kind, or null. A hint
    matches ids that contain it in any case; a document's score is its best hint's,
    those under ``least`` are left out.
    """
    h = hints.select(F.col(logical), F.lower(hint).alias("_h"), F.col(kind).alias("_k")).filter("_h <> ''").distinct()
    pairs = contains_pairs(docs.select(doc).distinct(), doc, doc, h.select("_h").distinct().withColumn("_key", F.col("_h")), "_key", "_h", True, slab_chars)
    s = pairs.withColumnRenamed("_key", "_h").join(h, "_h").withColumn("score", hint_score(F.col(doc), F.col("_h"), F.col("_k")))
    return s.groupBy(logical, doc).agg(F.max("score").alias("score")).filter(F.col("score") >= least)


def best_document(matches: DataFrame, doc: str, logical: str) -> DataFrame:
    """The document with the highest score of every logical one; equal scores: the first id."""
    return best_per_key(matches, [logical], [F.col("score").desc(), F.col(doc)])


def route_scores(questions: DataFrame, qid: str, blob: str, terms: DataFrame, doc: str, term: str, weight: str,
                 slab_chars: int = SLAB_CHARS) -> DataFrame:
    """(question, doc, route_score): weights of a document's terms that the question contains, added up; a term counts once."""
    t = terms.select(F.col(doc), F.lower(term).alias("_t"), F.col(weight).alias("_w")).distinct()
    pairs = contains_pairs(questions, qid, blob, t.select("_t").distinct().withColumn("_key", F.col("_t")), "_key", "_t", True, slab_chars)
    return pairs.withColumnRenamed("_key", "_t").join(t, "_t").groupBy(qid, doc).agg(F.sum("_w").alias("route_score"))
