"""HTML pages to sections and structured blocks."""
from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from dossier.functions.text import strip_html


# Fixed values: `document_body`, `section_n` and the length of a section's name.
HEADING_CHARS = 120


def html_sections(page: Column, heading_chars: int = HEADING_CHARS) -> Column:
    """Array of struct(heading, body) between h1-h3; a page without headings is one `document_body`.

    Of a heading the first ``heading_chars`` characters are its name; the text is in no case cut.
    """
    mark = F.regexp_replace(page, r"(?is)<h([1-3])[^>]*>(.*?)</h\1>", "\u0001$2\u0002")
    parts = F.split(mark, "\u0001")
    secs = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), lambda p, i: F.struct(
        F.coalesce(F.nullif(F.substring(strip_html(F.substring_index(p, "\u0002", 1)), 1, heading_chars), F.lit("")),
                   F.concat(F.lit("section_"), (i + 1).cast("string"))).alias("heading"),
        strip_html(F.substring_index(p, "\u0002", -1)).alias("body")))
    whole = F.array(F.struct(F.lit("document_body").alias("heading"), strip_html(page).alias("body")))
    return F.filter(F.when(F.size(parts) > 1, secs).otherwise(whole), lambda s: s["body"] != "")


# What is dropped whole, and the forms of the output (``## title``, ``[heading] text``, cells joined by `` | ``, 40 characters).
DROPPED = re.compile(r"<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)\s*>", re.I | re.S)
HEADING = re.compile(r"<h[1-4]\b[^>]*>(.*?)</h[1-4]\s*>", re.I | re.S)
ROW = re.compile(r"<tr\b[^>]*>(.*?)</tr\s*>", re.I | re.S)
CELL = re.compile(r"<t[dh]\b[^>]*>", re.I)
TABLE = re.compile(r"</?table\b[^>]*>", re.I)
TAG = re.compile(r"<[^>]+>")
BLANKS = re.compile(r"[ \t\n\r\f]+")
LEAST_CHARS = 40
CUT = "\x01"


def plain(markup: str) -> str:
    return BLANKS.sub(" ", html.unescape(TAG.sub(" ", markup))).strip(" ")


def blocks_of(page: str, least: int = LEAST_CHARS) -> list[tuple[str, str, str]]:
    """(kind, heading, text) of a page: headings, table rows and the text between, in order.

    The spans of headings and rows are marked in the markup, which is then cut at
    the marks; each piece stands under the last heading with a text before it.
    """
    marked = DROPPED.sub(" ", page.replace(CUT, " "))
    marked = TABLE.sub(f"{CUT}t", ROW.sub(rf"{CUT}r\1{CUT}t", HEADING.sub(rf"{CUT}h\1{CUT}t", marked)))
    out, heading = [], ""
    for piece in f"t{marked}".split(CUT):
        kind, body = piece[0], piece[1:]
        if kind == "r":
            cells = [plain(c) for c in CELL.split(body)[1:]]
            if cells:
                out.append(("row", heading, " | ".join(cells)))
        elif text := plain(body):
            if kind == "h":
                heading = text
            out.append(("heading", text, f"## {text}") if kind == "h" else ("text", heading, f"[{heading}] {text}" if heading else text))
    if sum(len(t) + 1 for *_, t in out) - 1 < least:
        return [("plain", "", plain(DROPPED.sub(" ", page)))]
    return out


def blocks_function(key: T.DataType, least: int = LEAST_CHARS):
    """Arrow table function over a table of (key, page): (key, pos, kind, heading, text).

    Rows are independent, so the table may come in any partitioning; ``PARTITION BY``
    the key is accepted and changes nothing. A null page is an empty one.
    """
    schema = T.StructType([T.StructField("key", key), T.StructField("pos", T.IntegerType()), *[
        T.StructField(c, T.StringType()) for c in ("kind", "heading", "text")]])

    class Blocks:
        def eval(self, table):
            keys, at, rows = table.column(0), [], []
            for i, page in enumerate(table.column(1).to_pylist()):
                found = blocks_of(page or "", least)
                at += [i] * len(found)
                rows += [(n, *b) for n, b in enumerate(found)]
            pos, kind, heading, text = zip(*rows) if rows else ((),) * 4
            yield pa.table({"key": keys.take(pa.array(at, pa.int64())), "pos": pa.array(pos, pa.int32()), "kind": pa.array(kind, pa.string()),
                            "heading": pa.array(heading, pa.string()), "text": pa.array(text, pa.string())})
    return F.arrow_udtf(Blocks, returnType=schema)


def register_blocks(spark: SparkSession, key: T.DataType, name: str = "html_blocks") -> None:
    """``SELECT * FROM html_blocks(TABLE(SELECT page_id, html FROM pages))``."""
    spark.udtf.register(name, blocks_function(key))


def html_blocks(df: DataFrame, key: str, page: str, min_chars: int = LEAST_CHARS) -> DataFrame:
    """(key, pos, kind, heading, text); pages with less structured text than ``min_chars`` give their plain text."""
    return blocks_function(df.schema[key].dataType, min_chars)(df.select(key, page).asTable()).withColumnRenamed("key", key)
