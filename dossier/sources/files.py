"""File listings and text, JSON, CSV and XML readers."""
from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from dossier.functions.text import sql_like_slug, strip_html

# Extensions that make up a corpus, and their source types.
CORPUS_EXTENSIONS = ["md", "html", "htm", "pdf", "txt", "json", "jsonl"]
SOURCE_TYPES = {"md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "json": "json", "jsonl": "jsonl",
                "xml": "xml", "csv": "csv", "pdf": "pdf", "txt": "text"}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def source_type(path: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in SOURCE_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(m, extension(path)), F.lit("unknown"))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, rel, name, ext, bytes): listing only, the contents stay unread."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    rel = F.regexp_replace("path", r"^file:/+", "/")
    base = root.replace("file:", "").rstrip("/") + "/"
    return f.select("path", F.replace(rel, F.lit(base), F.lit("")).alias("rel"),
                    F.substring_index("path", "/", -1).alias("name"), extension(F.col("path")).alias("ext"),
                    F.col("length").alias("bytes"))


def corpus_files(listing: DataFrame, allow: DataFrame | None = None) -> DataFrame:
    """Corpus extensions without readme and manifest files; an allow-list keeps only its relative paths."""
    out = listing.filter(F.col("ext").isin(*CORPUS_EXTENSIONS) & (F.lower("name") != "readme.md") & (F.col("name") != "manifest.csv"))
    return out.join(allow.select("rel").distinct(), "rel", "left_semi") if allow is not None else out


def read_whole_text(spark: SparkSession, path: str) -> DataFrame:
    """One row per file; bytes that do not decode turn into the replacement mark and are dropped."""
    t = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return t.select(F.col("_metadata.file_path").alias("source"), F.replace("value", F.lit("�"), F.lit("")).alias("text"))


def read_json_documents(spark: SparkSession, path: str, max_items: int | None = None, max_chars: int | None = None) -> DataFrame:
    """JSON documents as text, whole; a number of items or characters limits them."""
    t = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    v = F.try_parse_json("value")
    items = F.from_json("value", "array<string>")
    body = F.when(F.substring(F.ltrim("value"), 1, 1) == "[",
                  F.concat(F.lit("["), F.array_join(F.slice(items, 1, max_items) if max_items else items, ", "), F.lit("]"))).otherwise(F.col("value"))
    return t.filter(v.isNotNull()).select(F.col("_metadata.file_path").alias("source"),
                                          (F.substring(body, 1, max_chars) if max_chars else body).alias("text"))


def csv_as_text(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Every CSV row joined with ` | `."""
    d = spark.read.csv(path, header=header)
    return d.select(F.col("_metadata.file_path").alias("source"),
                    F.concat_ws(" | ", *[F.coalesce(F.col(c), F.lit("")) for c in d.columns]).alias("text"))


def inventory(listing: DataFrame, root: str = "root") -> DataFrame:
    return listing.groupBy(root, "ext").agg(F.count(F.lit(1)).alias("n_files"), F.sum("bytes").alias("bytes"))


def describe_documents(listing: DataFrame) -> DataFrame:
    return listing.select(sql_like_slug(F.col("rel")).alias("document_id"), "path", source_type(F.col("path")).alias("source_type"),
                          F.regexp_replace("name", r"\.[^.]+$", "").alias("title"), "bytes")


def select_sources(files: DataFrame, group: str, skip: Column, score: Column, max_groups: int, max_per_group: int) -> tuple[DataFrame, DataFrame]:
    """(kept files, counts of skip reasons). Groups by (score sum, file count), files by (score, size, name)."""
    from dossier.operators.bounds import top_k
    f = files.withColumn("_why", skip).withColumn("score", score)
    rejected = f.filter("_why is not null").groupBy(F.col("_why").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    ok = f.filter("_why is null").drop("_why")
    best = ok.groupBy(group).agg(F.sum("score").alias("_s"), F.count(F.lit(1)).alias("_n")).orderBy(
        F.col("_s").desc(), F.col("_n").desc(), group).limit(max_groups)
    kept = top_k(ok.join(best.select(group), group, "left_semi"), [group],
                 [F.col("score").desc(), F.col("bytes").desc(), F.col("name")], max_per_group)
    return kept, rejected


def _walk_xml(raw: str | None, max_lines: int | None) -> str | None:
    """Lines `tag (attrs): text`, namespaces removed; text that is no XML comes back as it is."""
    if raw is None:
        return None
    try:
        root = ET.fromstring(raw)
    except ET.ParseError:
        return raw
    lines, stack = [], [("open", root)]
    while stack:
        what, el = stack.pop()
        if what == "tail":
            if len(el) > 2:
                lines.append(el)
            continue
        body = (el.text or "").strip()
        if len(body) > 1:
            attrs = " ".join(f"{k}={v}" for k, v in el.attrib.items() if v)
            name = el.tag.rpartition("}")[2]
            lines.append(f"{name} ({attrs}): {body}" if attrs else f"{name}: {body}")
        for child in reversed(list(el)):
            stack.append(("tail", (child.tail or "").strip()))
            stack.append(("open", child))
    return "\n".join(lines[:max_lines]) if lines else raw


def xml_to_text(c: Column, max_lines: int | None = None) -> Column:
    """Free walk over arbitrary XML, in Arrow batches; ``from_xml`` needs a schema and cannot say it."""
    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: _walk_xml(v, max_lines))
    return run(c)


def as_text(text: Column, kind: Column) -> Column:
    """The reader each source type asks for, on text that is already loaded."""
    return F.when(kind == "html", strip_html(text)).when(kind == "xml", xml_to_text(text)).otherwise(text)
