"""Generators: one text row -> windows, sections, sentences, table rows, facts."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from dossier.functions.text import let, norm_ws, pad_id, strip


def word_windows(text: Column, size: int = 400, overlap: int = 80) -> Column:
    """Array of word windows; the window that reaches the end is the last one."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    step = max(1, size - overlap)
    return let(words, lambda ws: F.transform(_starts(F.size(ws), size, step), lambda i: F.array_join(
        F.slice(ws, (i * step + 1).cast("int"), size), " ")))


def _starts(n: Column, size: int, step: int) -> Column:
    """Window numbers 0.. for a text of ``n`` items; the last window is the first to reach the end."""
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / step)).cast("long")
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array().cast("array<bigint>"))


def char_windows(text: Column, size: int = 900, overlap: int = 150) -> Column:
    """Array of struct(pos, text): stripped character windows, blank ones left out.

    ``pos`` is the raw window number, so ids do not shift over blanks.
    """
    step = max(1, size - overlap)
    return let(text, lambda t: F.filter(F.transform(_starts(F.length(t), size, step), lambda i: F.struct(
        i.alias("pos"), strip(F.substring(t, (i * step + 1).cast("int"), F.lit(size))).alias("text"))),
        lambda w: w["text"] != ""))


def chunk_words(df: DataFrame, text: str = "text", size: int = 400, overlap: int = 80) -> DataFrame:
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, F.posexplode(word_windows(F.col(text), size, overlap)).alias("chunk_id", "text"))


def chunk_chars(df: DataFrame, text: str = "text", size: int = 900, overlap: int = 150) -> DataFrame:
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, F.explode(char_windows(F.col(text), size, overlap)).alias("_w")).select(
        *keep, F.col("_w.pos").alias("chunk_id"), F.col("_w.text").alias("text"))


def split_before_headings(text: Column, max_level: int = 3) -> Column:
    return F.split(text, r"\n(?=#{1,%d}\s)" % max_level)


def chunk_sections(df: DataFrame, text: str = "text", size: int = 800, overlap: int = 120,
                   pattern: str | None = None) -> DataFrame:
    """Section = heading to next heading; a long section is cut in windows."""
    keep = [c for c in df.columns if c != text]
    parts = split_before_headings(F.col(text)) if pattern is None else F.split(F.col(text), pattern)
    secs = df.select(*keep, F.posexplode(parts).alias("section_pos", "_s"))
    return secs.select(*keep, "section_pos", F.explode(char_windows(strip(F.col("_s")), size, overlap)).alias("_w")).select(
        *keep, "section_pos", F.col("_w.pos").alias("chunk_pos"), F.col("_w.text").alias("text"))


def markdown_sections(text: Column) -> Column:
    """Array of struct(title, body): one per `#` line, text before the first is `root`."""
    parts = F.split(F.concat(F.lit("\n"), text), r"\n(?=#)")
    return F.filter(F.transform(parts, lambda p, i: F.struct(
        F.when(i == 0, F.lit("root")).otherwise(
            strip(F.regexp_replace(F.substring_index(p, "\n", 1), r"^#+\s*", ""))).alias("title"),
        strip(F.when(i == 0, p).otherwise(F.when(p.contains("\n"), F.substring(
            p, F.locate("\n", p) + 1, F.length(p))).otherwise(F.lit("")))).alias("body"))),
        lambda s: s["body"] != "")


def structured_sections(text: Column, source_type: Column) -> Column:
    """Markdown by `#` lines; html/xml by `## ` lines or short `label:` lines; else one root section."""
    label = r"\n(?=(?:## |[^\n]{1,60}:\s*\n))"
    parts = F.split(F.concat(F.lit("\n"), text), label)
    other = F.filter(F.transform(parts, lambda p, i: F.struct(
        F.when(i == 0, F.lit("root")).otherwise(
            strip(F.regexp_replace(F.substring_index(p, "\n", 1), r"^## |:\s*$", ""))).alias("title"),
        strip(F.when(i == 0, p).otherwise(F.when(p.contains("\n"), F.substring(
            p, F.locate("\n", p) + 1, F.length(p))).otherwise(F.lit("")))).alias("body"))),
        lambda s: s["body"] != "")
    root = F.filter(F.array(F.struct(F.lit("root").alias("title"), strip(text).alias("body"))), lambda s: s["body"] != "")
    return F.when(source_type == "markdown", markdown_sections(text)).when(
        source_type.isin("html", "xml"), other).otherwise(root)


SEPARATORS = ("\n\n", "\n", " ", "")


def _recursive_split(text: str, size: int, seps: tuple[str, ...]) -> list[str]:
    if len(text) <= size:
        return [text]
    sep, rest = seps[0], seps[1:]
    if sep == "":
        return [text[i:i + size] for i in range(0, len(text), size)]
    out: list[str] = []
    for piece in text.split(sep):
        out.extend(_recursive_split(piece, size, rest) if len(piece) > size else [piece])
    return out


def _merge_pieces(pieces: list[str], size: int, overlap: int) -> list[str]:
    out: list[str] = []
    cur: list[str] = []
    n = 0
    for p in pieces:
        if cur and n + len(p) + 1 > size:
            out.append(" ".join(cur).strip())
            while cur and n > overlap:
                n -= len(cur.pop(0)) + 1
        cur.append(p)
        n += len(p) + 1
    if cur:
        out.append(" ".join(cur).strip())
    return [o for o in out if o]


def chunk_recursive(df: DataFrame, key: str, text: str = "text", size: int = 800, overlap: int = 120) -> DataFrame:
    """Paragraph, line, word, character ladder; pieces are merged up to ``size``.

    Own semantics, one row at a time inside Arrow batches: the ladder depends on
    what the level above produced, which array functions cannot say.
    """
    kt = df.schema[key].dataType.simpleString()
    out = T._parse_datatype_string(f"{key} {kt}, chunk_id long, text string")
    arrow = to_arrow_schema(out)
    return df.select(key, text).mapInArrow(lambda batches: (b for batch in batches for b in _recursive_batches(batch, arrow, size, overlap)), out)


ROWS = 128  # texts worked on at a time


def _recursive_batches(batch: pa.RecordBatch, schema: pa.Schema, size: int, overlap: int):
    """Pieces of the texts of a batch (key, text), in batches of the pieces of ``ROWS`` texts: a whole batch as Python
    strings, twice over, is many times its size."""
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        pieces = [_merge_pieces(_recursive_split(t or "", size, SEPARATORS), size, overlap) for t in part.column(1).to_pylist()]
        n = [len(p) for p in pieces]
        yield pa.RecordBatch.from_arrays([
            part.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))).cast(schema.field(0).type),
            pa.array([i for x in n for i in range(x)], pa.int64()), pa.array([c for p in pieces for c in p], schema.field(2).type)], schema=schema)


def evidence_units(df: DataFrame, doc_id: str, text: str, company: str, min_chunk: int = 40, min_unit: int = 80,
                   unit_cut: int | None = None, size: int = 900, overlap: int = 150, pattern: str = r"\n+") -> DataFrame:
    """Document -> sections -> windows -> numbered units.

    The number follows (section, window) inside one document; a document is one
    row, so the order is built in an array and nothing is shuffled.
    """
    secs = F.filter(F.transform(F.split(F.col(text), pattern), lambda s: strip(s)), lambda s: s != "")
    wins = F.flatten(F.transform(secs, lambda s, i: F.transform(
        char_windows(s, size, overlap), lambda w: F.struct(i.alias("section_pos"), w["pos"].alias("chunk_pos"),
                                                          w["text"].alias("text")))))
    kept = F.filter(wins, lambda w: F.length(w["text"]) >= min_chunk)
    out = df.select(F.col(doc_id), F.col(company), F.posexplode(kept).alias("_i", "_w"))
    return out.select(
        doc_id, company,
        F.concat_ws("-", F.col(doc_id).cast("string"), pad_id(F.col("_i") + 1, 4)).alias("unit_id"),
        F.col("_w.section_pos").alias("section_pos"), F.col("_w.chunk_pos").alias("chunk_pos"),
        (F.substring("_w.text", 1, unit_cut) if unit_cut else F.col("_w.text")).alias("text"),
        (F.length("_w.text") >= min_unit).alias("is_unit"))


def sentences_of(df: DataFrame, text: str = "text", min_len: int = 24) -> DataFrame:
    keep = [c for c in df.columns if c != text]
    parts = F.filter(F.transform(F.split(F.col(text), r"(?<=[.?!])\s+|\n+"), lambda s: norm_ws(s)), lambda s: F.length(s) >= min_len)
    return df.select(*keep, F.posexplode(parts).alias("sentence_pos", "sentence"))


def atomic_facts(text: Column, company: Column, limit: int = 4, min_len: int = 20, free_len: int = 60,
                 cut: int = 220) -> Column:
    """Facts at sentence, semicolon and bullet ends; short ones must name the company."""
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+|;\s*|\n+|•"), lambda s: norm_ws(s))
    good = F.filter(parts, lambda s: (F.length(s) >= min_len) & (
        F.lower(s).contains(F.lower(company)) | (F.length(s) >= free_len)))
    return F.slice(F.transform(good, lambda s: F.substring(s, 1, cut)), 1, limit)


def table_rows(text: Column) -> Column:
    """Pipe tables: array of struct(header, cells); data starts at the third pipe line."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda s: strip(s)), lambda ln: ln.startswith("|"))
    cells = lambda ln: F.transform(F.split(F.regexp_replace(ln, r"^\|+|\|+$", ""), r"\|"), lambda s: strip(s))
    rows = let(lines, lambda ls: let(cells(F.get(ls, F.lit(0))), lambda head: F.filter(F.transform(
        F.slice(ls, 3, F.greatest(F.size(ls) - 2, F.lit(1))), lambda ln: F.struct(
            head.alias("header"), cells(ln).alias("cells"))), lambda r: F.size(r["cells"]) >= 2)))
    return F.when(text.contains("|"), rows).otherwise(
        F.array().cast("array<struct<header:array<string>,cells:array<string>>>"))


def year_columns(header: Column) -> Column:
    """struct(year, idx) of the header cells that hold a year, latest first."""
    ys = F.transform(header, lambda h, i: F.struct(
        F.nullif(F.regexp_extract(h, r"(20\d{2})", 1), F.lit("")).cast("int").alias("year"), i.alias("idx")))
    return F.reverse(F.array_sort(F.filter(ys, lambda y: y["year"].isNotNull())))


def claims_of(expected: Column, words=("yes", "no")) -> Column:
    """Numbers, percents, key words and phrases of an expected answer; distinct, first eight."""
    e = F.lower(expected)
    nums = F.regexp_extract_all(e, F.lit(r"(\d+(?:\.\d+)?%?)"), F.lit(1))
    ints = F.regexp_extract_all(e, F.lit(r"\b(\d+)\b"), F.lit(1))
    kw = F.array_compact(F.array(*[F.when(e.contains(w), F.lit(w)) for w in words])) if words else F.array().cast("array<string>")
    parts = F.filter(F.transform(F.split(e, "[,;]"), lambda s: strip(s)), lambda p: (F.length(p) >= 4) & ~p.rlike(r"^\d+$"))
    phrases = F.transform(parts, lambda p: F.substring(p, 1, 40))
    return F.slice(F.array_distinct(F.concat(nums, ints, kw, phrases)), 1, 8)


def anchored_amount(text: Column, keywords: list[str], reach: int = 300, min_digits: int = 7) -> Column:
    """First long number within ``reach`` characters after a keyword, keywords in order."""
    rx = r"([\d,]{%d,})" % min_digits
    out = []
    for kw in keywords:
        pos = F.locate(kw, text)
        got = F.nullif(F.regexp_extract(F.substring(text, pos + len(kw), F.lit(reach)), rx, 1), F.lit(""))
        out.append(F.when(pos > 0, got))
    return F.coalesce(*out)


def label_line_groups(lines: Column, label_re: str, total_re: str, n_values: int = 6) -> Column:
    """Tables whose cells stand on separate lines.

    A label line opens a row; the numbers up to the next label are its cells.
    Total rows are left out so they are not counted twice. Works on the ordered
    line array of one document.
    """
    acc_t = "array<struct<label:string,vals:array<string>>>"
    def step(acc, ln):
        is_label = ln.rlike(label_re)
        is_num = ln.rlike(r"^-?[\d,]+(?:\.\d+)?$|^-$")
        new = F.concat(acc, F.array(F.struct(ln.alias("label"), F.array().cast("array<string>").alias("vals"))))
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            last["label"].alias("label"), F.concat(last["vals"], F.array(ln)).alias("vals"))))
        return F.when(is_label, new).when(
            is_num & (F.size(acc) > 0), F.when(F.size(acc) > 0, F.when(
                F.size(last["vals"]) < n_values, grown).otherwise(acc))).otherwise(acc)
    rows = F.aggregate(F.transform(lines, lambda s: strip(s)), F.array().cast(acc_t), step)
    return F.filter(rows, lambda r: ~r["label"].rlike(total_re) & (F.size(r["vals"]) > 0))


def fixed_offset_records(lines: Column, key_re: str, names: list[str]) -> Column:
    """A key line (e.g. sex) anchors a record; fields stand at fixed offsets, name is one line above."""
    return let(lines, lambda ls: F.transform(
        F.filter(F.transform(ls, lambda ln, i: F.struct(i.alias("i"), ln.alias("ln"))),
                 lambda e: e["ln"].rlike(key_re) & (e["i"] > 0)),
        lambda e: F.struct(F.get(ls, e["i"] - 1).alias("name"), e["ln"].alias("key"),
                           *[F.get(ls, e["i"] + k + 1).alias(n) for k, n in enumerate(names)])))


def question_candidates(df: DataFrame, text: str, rules: list[tuple[str, str, str]], keep: list[str],
                        min_len: int = 24) -> DataFrame:
    """Sentence x matching question rule -> (question, kind, cluster, rank, dedupe key).

    ``rules``: (pattern, kind, question template with %s for the matched words), by priority.
    """
    sents = sentences_of(df.select(*keep, text), text, min_len)
    cands = F.array_compact(F.array(*[
        F.when(F.col("sentence").rlike(p), F.struct(
            F.lit(kind).alias("kind"), F.lit(i).alias("priority"),
            F.format_string(tmpl, F.lower(F.regexp_extract("sentence", p, 0))).alias("question")))
        for i, (p, kind, tmpl) in enumerate(rules)]))
    out = sents.select(*keep, "sentence_pos", "sentence", F.explode(cands).alias("c")).select(
        *keep, "sentence_pos", "sentence", "c.*")
    rank = F.size(F.regexp_extract_all(F.col("sentence"), F.lit(r"(\d+)"), F.lit(1))) * 2 + F.least(
        F.length("sentence") / 100.0, F.lit(3.0)) - F.col("priority") * 0.1
    return out.withColumn("rank_score", rank).withColumn(
        "dedupe_key", F.md5(F.concat_ws("|", "kind", norm_ws(F.col("sentence"), lower=True))))


def config_grid(spark, dims: dict[str, list[str]], overrides: list[tuple[str, str, str]] = ()) -> DataFrame:
    """Every combination of the option lists (a parameter table, its size is the product of the lists).

    ``overrides``: (column, value, mode) sets ``mode`` where column = value.
    """
    df = spark.range(1).select(F.lit("default").alias("mode"))
    for name, vals in dims.items():
        df = df.select("*", F.explode(F.array(*[F.lit(v) for v in vals])).alias(name))
    for col, val, mode in overrides:
        df = df.withColumn("mode", F.when(F.col(col) == val, mode).otherwise(F.col("mode")))
    return df


def one_factor_grid(spark, base: dict[str, str], dims: dict[str, list[str]]) -> DataFrame:
    """Baseline plus every single-option change."""
    out = None
    for name, vals in dims.items():
        row = [F.lit(v).alias(k) for k, v in base.items() if k != name]
        part = spark.range(1).select(*row, F.explode(F.array(*[F.lit(v) for v in vals])).alias(name)).select(*base)
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def fact_candidates(df: DataFrame, text: str, keep: list[str], catalog: list[dict], anchors: str, banned: list[str],
                    min_len: int = 40) -> DataFrame:
    """Sentence -> first fact of an ordered catalog -> specific question, with its quality gates as columns.

    ``catalog``: dicts with pattern, fact, question, blockers (pattern or None).
    """
    s = sentences_of(df.select(*keep, text), text, min_len)
    low = F.lower("sentence")
    pick = None
    for e in catalog:
        ok = low.rlike(e["pattern"])
        if e.get("blockers"):
            ok = ok & ~low.rlike(e["blockers"])
        val = F.struct(F.lit(e["fact"]).alias("fact"), F.lit(e["question"]).alias("question"))
        pick = F.when(ok, val) if pick is None else pick.when(ok, val)
    out = s.withColumn("_f", pick).filter(F.col("_f").isNotNull()).select(*keep, "sentence_pos", "sentence", "_f.*")
    generic = F.lit(False)
    for b in banned:
        generic = generic | F.lower("question").contains(b)
    return out.withColumns({"has_anchor": F.lower("sentence").rlike(anchors), "is_generic": generic,
                            "has_number": F.col("sentence").rlike(r"\d")}).withColumn(
        "usable", F.col("has_anchor") & ~F.col("is_generic"))
