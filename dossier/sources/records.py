"""Evidence records, filings and workbook tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dossier.functions.numbers import question_type, slug, split_answer
from dossier.functions.rules import ladder
from dossier.functions.text import pad_id, strip
from dossier.operators.bounds import best_per_key, forward_fill

# Header fields put before a record's text, short and long form.
HEADER_8 = ["record_id", "doc_id", "company", "year", "source_type", "title", "section_path", "record_role"]
HEADER_12 = ["record_id", "doc_id", "company", "year", "source_type", "title", "section_path", "page", "record_role",
             "source_system", "source_url", "esg_tags"]
RECORD_SCHEMA = ("record_id string, doc_id string, company string, year int, source_type string, title string, "
                 "section_path string, page int, record_role string, source_system string, source_url string, "
                 "esg_tags array<string>, metric struct<metric_name:string,value_raw:string,value_normalized:double,unit:string>, "
                 "metadata string, text string, _bad string")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """JSONL evidence records; broken lines and records without text are left out."""
    d = spark.read.schema(RECORD_SCHEMA).option("columnNameOfCorruptRecord", "_bad").json(path)
    return d.filter(F.col("_bad").isNull() & (strip(F.coalesce("text", F.lit(""))) != "")).drop("_bad")


def with_header(df: DataFrame, fields: list[str] = HEADER_8) -> DataFrame:
    """`name: value` lines, a blank line, then the text."""
    def val(f):
        if f == "esg_tags":
            return F.concat_ws(", ", F.col(f))
        return F.coalesce(F.col(f).cast("string"), F.lit(""))
    head = F.concat_ws("\n", *[F.concat(F.lit(f"{f}: "), val(f)) for f in fields])
    return df.withColumn("text", F.concat(head, F.lit("\n\n"), strip(F.col("text"))))


def record_chunks(df: DataFrame, size: int = 900, overlap: int = 150) -> DataFrame:
    """Windows inside each record; the id comes from the record, not from a line number."""
    from dossier.operators.chunking import chunk_chars
    return chunk_chars(with_header(df).select("record_id", F.col("doc_id").alias("source"), "text"), "text", size, overlap)


def prechunked(df: DataFrame) -> DataFrame:
    """One line is one chunk; the year comes from the nested metadata, else from the row."""
    year = F.coalesce(F.nullif(F.col("metadata.year_hint"), F.lit("")), F.col("year").cast("string"), F.lit(""))
    names = [("record_id", "chunk_id"), ("chunk_id", "chunk_id"), ("company", "company"), ("year", None), ("source_type", "source_type"),
             ("document_title", "document_title"), ("section_path", "section_hint"), ("source_path", "source_path")]
    head = F.concat_ws("\n", *[F.concat(F.lit(f"{n}: "), year if c is None else F.coalesce(F.col(c).cast("string"), F.lit("")))
                               for n, c in names])
    return df.filter(strip(F.col("text")) != "").select("chunk_id", "source_path", F.concat(head, F.lit("\n\n"), strip(F.col("text"))).alias("text"))


def corpus_units(df: DataFrame, report_words: list[str], min_len: int = 80, cut: int | None = None) -> DataFrame:
    """Records fit to become units: long enough, no news unless taxonomy, report-like or with a real tag."""
    t = strip(F.col("text"))
    tax = F.col("record_role") == "requirement_taxonomy"
    hay = F.lower(F.concat_ws(" ", "section_path", t))
    reportish = F.lit(False)
    for w in report_words:
        reportish = reportish | hay.contains(w)
    news = (F.col("source_type") == "news") | F.lower("section_path").contains("news")
    tagged = (F.size("esg_tags") > 0) & (F.array_join("esg_tags", ",") != "G.other")
    ok = (F.length(t) >= min_len) & (tax | ~F.coalesce(news, F.lit(False))) & (tax | reportish | F.coalesce(tagged, F.lit(False)))
    gri = F.coalesce(F.nullif(F.get_json_object("metadata", "$.source_row.gri"), F.lit("")),
                     F.nullif(F.trim(F.regexp_extract(t, r"(?m)^\s*GRI:(.*)$", 1)), F.lit("")), F.lit(""))
    return df.filter(ok).withColumn("gri_code", gri).withColumn("text", F.substring(t, 1, cut) if cut else t)


def capped_units(units: DataFrame, company: str, unit_id: str, order: list[Column], cap: int) -> DataFrame:
    """Repeated unit ids go first, then the cap per company."""
    from dossier.operators.bounds import top_k
    return top_k(best_per_key(units, [unit_id], order), [company], order, cap, "_n").drop("_n")


# ---- filings -----------------------------------------------------------------
# Public filing fields and the names they get in rendered lines.
EMPLOYEE_FIELDS = [("corp", "corp_name"), ("division", "fo_bbm"), ("sex", "sexdstn"), ("regular", "rgllbr_co"), ("contract", "cnttk_co"),
                   ("total", "sm"), ("avg_tenure", "avrg_cnwk_sdytrn"), ("annual_salary", "fyer_salary_totamt"),
                   ("monthly_salary", "jan_salary_am"), ("stlm_dt", "stlm_dt")]
EXECUTIVE_FIELDS = [("corp", "corp_name"), ("name", "nm"), ("sex", "sexdstn"), ("position", "ofcps"), ("registered_exec", "rgist_exctv_at"),
                    ("full_time", "fte_at"), ("role", "chrg_job"), ("tenure", "hffc_pd"), ("stlm_dt", "stlm_dt")]
TERM_FIELDS = [("thstrm_nm", "thstrm_amount"), ("frmtrm_nm", "frmtrm_amount"), ("bfefrmtrm_nm", "bfefrmtrm_amount")]


def filing_schema(title: Column, keys: Column, title_rules: list[tuple[str, str]]) -> Column:
    """Schema by title pattern, else by the fields present."""
    has = lambda *ks: F.coalesce(F.array_size(F.array_intersect(keys, F.array(*[F.lit(k) for k in ks]))) == len(ks), F.lit(False))
    return ladder([(title.rlike(p), v) for p, v in title_rules] + [
        (has("account_nm", "thstrm_amount"), "financial_statement"), (has("fo_bbm", "sexdstn"), "employee_status"),
        (has("ofcps", "nm"), "executive_status")], "generic_json")


def format_amount(c: Column) -> Column:
    t = strip(F.coalesce(c, F.lit("")))
    return F.when(t.isin("", "-"), "-").when(t.rlike(r"^\d+$"), F.format_number(t.cast("decimal(38,0)"), 0)).otherwise(t)


def filing_line(schema: str) -> Column:
    """`k=v | k=v` rendering of one filing row of a schema."""
    if schema == "financial_statement":
        cur = F.coalesce("currency", F.lit("KRW"))
        terms = [F.when((F.coalesce(F.col(n), F.lit("")) != "") | F.lit(i == 0),
                        F.concat(F.col(n), F.lit("="), format_amount(F.col(a)), F.lit(" "), cur)) for i, (n, a) in enumerate(TERM_FIELDS)]
        return F.concat_ws(" | ", F.concat(F.lit("statement="), "sj_nm"), F.concat(F.lit("account="), "account_nm"),
                           F.concat(F.lit("account_id="), "account_id"),
                           F.when(~F.coalesce("account_detail", F.lit("")).isin("", "-"), F.concat(F.lit("detail="), "account_detail")), *terms)
    fields = EMPLOYEE_FIELDS if schema == "employee_status" else EXECUTIVE_FIELDS
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{n}="), F.coalesce(F.replace(F.col(c).cast("string"), F.lit("\n"), F.lit(" / ")), F.lit("")))
                                for n, c in fields])


def generic_line(cols: list[str]) -> Column:
    return F.concat_ws(" | ", *[F.when(~F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "-"),
                                       F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in cols])


# ---- workbooks -----------------------------------------------------------------
def check_header(df: DataFrame, expected: list[str]) -> None:
    if df.columns != expected:
        raise ValueError(f"workbook header differs: {sorted(set(expected) ^ set(df.columns)) or 'order'}")


def read_workbook(df: DataFrame, sheet: str, row_index: str, context: list[str], values: list[str]) -> DataFrame:
    """Drop empty rows, then fill the context columns from the last value above."""
    keep = df.filter(F.coalesce(*[F.col(c).cast("string") for c in context + values]).isNotNull())
    return forward_fill(keep, [sheet], F.col(row_index), context)


def workbook_tables(rows: DataFrame, company: str, row_index: str, path_cols: list[str], unit: str, value: str, year: str,
                    status: str, url: str, file_url: str) -> dict[str, DataFrame]:
    """One wide row -> question, gold answer, source; the registry keeps the first row per address."""
    qid = F.concat_ws("-", company, pad_id(F.col(row_index), 5))
    qtext = F.concat_ws(" / ", *path_cols)
    b = rows.withColumn("question_id", qid)
    questions = b.select("question_id", company, qtext.alias("question_text"), question_type(F.col(value), F.col(unit)).alias("question_type"),
                         slug(F.col(path_cols[-1])).alias("metric_name"), F.col(year).cast("int").alias("year"), F.col(unit).alias("unit"),
                         F.col(row_index).alias("source_row_index"))
    gold = b.select("question_id", F.col(value).alias("gold_answer_raw"), split_answer(F.col(value), F.col(status)).alias("_g"),
                    F.col(unit).alias("answer_unit"), F.col(status).alias("disclosure_status")).select(
        "question_id", "gold_answer_raw", "_g.*", "answer_unit", "disclosure_status")
    sources = b.select("question_id", company, F.col(url).alias("source_url"), F.col(file_url).alias("file_url"), F.col(row_index).alias("_o"))
    key = F.coalesce(F.nullif(F.col("source_url"), F.lit("")), F.nullif(F.col("file_url"), F.lit("")))
    registry = best_per_key(sources.withColumn("address", key).filter("address is not null"), ["address"], [F.col("_o"), F.col("question_id")])
    return {"questions": questions, "gold_answers": gold, "sources": sources.drop("_o"), "registry": registry.drop("_o")}


def wide_to_long(df: DataFrame, keep: list[str], years: list[int], value_fmt: str = "{y}_value", source_fmt: str = "{y}_source",
                 basis_fmt: str = "{y}_basis") -> DataFrame:
    """One row per year column triple; all-empty triples go."""
    parts = F.array(*[F.struct(F.lit(y).alias("year"), F.col(value_fmt.format(y=y)).cast("string").alias("value"),
                               F.col(source_fmt.format(y=y)).cast("string").alias("source"),
                               F.col(basis_fmt.format(y=y)).cast("string").alias("basis")) for y in years])
    out = df.select(*keep, F.explode(parts).alias("_p")).select(*keep, "_p.*")
    out = out.filter(F.coalesce("value", "source", "basis").isNotNull())
    v = F.lower(F.trim(F.coalesce("value", F.lit(""))))
    nd = (v == "") | v.startswith("not disclos")
    return out.withColumn("disclosure_status", F.when(nd, "Not disclosed").otherwise("matched")).withColumn(
        "value", F.when(nd, "").otherwise(F.col("value")))


# ---- audits --------------------------------------------------------------------
def import_decision(esg: Column, company: Column, wrong: Column, coverage: Column, length: Column) -> Column:
    """(decision, reason) of a source import."""
    r = lambda d, k: F.struct(F.lit(d).alias("decision"), F.lit(k).alias("reason"))
    return ladder([(wrong > 0, r("reject", "wrong_document_type")), (length < 500, r("reject", "insufficient_text")),
                   (esg < 3, r("reject", "low_topic_signal")), (coverage, r("accept_with_warnings", "coverage_export")),
                   (company < 1, r("accept_with_warnings", "low_company_signal")),
                   ((esg >= 5) & (company >= 2) & (length >= 2000), r("accept", "report_body"))], r("accept_with_warnings", "partial_body"))


def audit_class(path: Column, topic: Column, company: Column, wrong: Column, text: Column) -> Column:
    """(class, priority tier) of a raw source from its place and three signal scores."""
    low = F.lower(text)
    c = ladder([(path.contains("news"), "news_or_press"), (path.contains("website"), "website_capture"),
                (path.contains("filing"), "filing_only"), ((topic >= 4) & (company >= 2) & (wrong == 0), "likely_report"),
                (low.contains("impact"), "likely_impact_report"), (low.contains("navigation") | low.contains("portal"), "portal_noise")],
               "unknown")
    tier = ladder([(c == "likely_report", 1), (c == "likely_impact_report", 2), (c.isin("filing_only", "unknown"), 3)], 4)
    return F.struct(c.alias("class"), tier.alias("tier"))


def themed_seeds(docs: DataFrame, doc: str, text: str, order: list[Column], themes: list[tuple[str, str]], per_cluster: int = 1,
                 min_len: int = 60) -> DataFrame:
    """Paragraph -> theme by rules -> fact cluster; the first by the given order per cluster is the seed."""
    from dossier.functions.rules import first_match
    from dossier.functions.text import cluster_fingerprint, norm_ws
    from dossier.operators.bounds import top_k
    p = docs.select("*", F.posexplode(F.split(text, r"\n+")).alias("para", "p")).withColumn("p", norm_ws(F.col("p")))
    p = p.filter(F.length("p") >= min_len).withColumn("theme", first_match(F.lower("p"), themes)).filter("theme is not null")
    p = p.withColumn("cluster", cluster_fingerprint(F.col("p")))
    return top_k(p, ["theme", "cluster"], [*order, F.col(doc), F.col("para")], per_cluster, "seed_rank")


def filing_extract(rows: DataFrame, doc: str, statement: str, order: str, line: Column) -> DataFrame:
    """(record id, line) per filing row: rows numbered inside document and statement."""
    from dossier.operators.bounds import number_rows
    n = number_rows(rows.withColumn("_line", line), [doc, statement], [F.col(order)], F.col(order), "_n")
    return n.select(doc, statement, F.concat_ws("::", slug(F.col(doc).cast("string")), F.col(statement), F.col("_n").cast("string")).alias("record_id"),
                    F.col("_line").alias("line"), F.col("_n").alias("pos"))


def filing_text(records: DataFrame, doc: str, statement: str) -> DataFrame:
    """The lines of every extract in reading order: a `## statement` line, then its records.

    Lines stay rows and are range-partitioned by (document, statement, place),
    so a document of any size is spread over tasks and reads back in order.
    """
    heads = records.select(doc, statement).distinct().select(doc, statement, F.lit(0).cast("long").alias("pos"), F.concat(F.lit("## "), statement).alias("line"))
    body = records.select(doc, statement, F.col("pos").cast("long").alias("pos"), F.concat(F.lit("- "), "line").alias("line"))
    return heads.unionByName(body).repartitionByRange(doc, statement, "pos").sortWithinPartitions(doc, statement, "pos")


def build_chunks(prechunked_lane: DataFrame, record_lane: DataFrame, documents: DataFrame) -> DataFrame:
    """One chunk table out of the three readers, with its lane for partition pruning."""
    cols = ["source", "chunk_id", "text"]
    parts = [df.select(F.lit(lane).alias("lane"), *[F.col(c).cast("string").alias(c) for c in cols])
             for lane, df in (("prechunked", prechunked_lane), ("records", record_lane), ("documents", documents))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
