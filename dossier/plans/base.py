"""Registry: one name, one DataFrame builder, one SQL twin where SQL can say it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dossier.operators.bounds import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a builder; ``sql`` is what DuckDB runs on the same tables."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


TEXT_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; text tables of few splits are spread over the cores, large ones stay as they lie."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


# ---- SQL fragments shared by the twins -------------------------------------
WS = r"' ' || chr(9) || chr(10) || chr(13)"


def sql_pad(number: str, width: int) -> str:
    """Leading zeros up to a width, never cut."""
    return f"CASE WHEN length(CAST({number} AS VARCHAR)) < {width} THEN lpad(CAST({number} AS VARCHAR), {width}, '0') ELSE CAST({number} AS VARCHAR) END"


def sql_tokens(col: str) -> str:
    return rf"list_transform(regexp_extract_all({col}, '([가-힣]+|[a-zA-Z0-9_]+)', 1), lambda x: lower(x))"


def sql_char_chunks(size: int = 900, overlap: int = 150, src: str = "documents") -> str:
    """CTE body: doc_id, source, lang, chunk_id, text of the character windows."""
    step = max(1, size - overlap)
    return rf"""
      SELECT doc_id, source, lang, chunk_id, trim(w, {WS}) AS text FROM (
        SELECT doc_id, source, lang, unnest(range(0, CAST(nw AS BIGINT))) AS chunk_id,
               substr(text, unnest(range(0, CAST(nw AS BIGINT))) * {step} + 1, {size}) AS w
        FROM (SELECT *, CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= {size} THEN 1
                        ELSE 1 + CAST(ceil((length(text) - {size}) / {step}.0) AS BIGINT) END AS nw
              FROM {src}))
      WHERE trim(w, {WS}) <> ''"""


def sql_bm25(chunks: str, queries: str, key: str = "doc_id, chunk_id", tenant: str | None = None) -> str:
    """CTE chain ending in ``scored(query_id, <key>, bm25, overlap)``.

    ``chunks`` must give (<key>, text[, tenant]); ``queries`` (query_id, text[, tenant]).
    """
    t_ = f"{tenant}, " if tenant else ""
    on_t = f" AND p.{tenant} = w.{tenant}" if tenant else ""
    js = f"JOIN st USING ({tenant})" if tenant else "CROSS JOIN st"
    jm = f"JOIN mi USING ({tenant})" if tenant else "CROSS JOIN mi"
    grp = f"GROUP BY {tenant}" if tenant else ""
    jq = f"q.{tenant} = i.{tenant} AND " if tenant else ""
    qt = f"q.{tenant}, " if tenant else ""
    return rf"""
    ck AS ({chunks}), qs AS ({queries}),
    tk0 AS MATERIALIZED (SELECT {key}, {t_} {sql_tokens('text')} AS toks FROM ck),
    tk AS MATERIALIZED (SELECT *, len(toks) AS dl, len(list_distinct(toks)) AS dt FROM tk0),
    st AS MATERIALIZED (SELECT {t_} count(*) AS n, sum(dl) / count(*) AS avgdl FROM tk {grp}),
    po AS MATERIALIZED (SELECT {key}, {t_} term, dl, dt, count(*) AS tf FROM
            (SELECT {key}, {t_} dl, dt, unnest(toks) AS term FROM tk) GROUP BY ALL),
    dfq AS (SELECT {t_} term, count(*) AS df FROM po GROUP BY ALL),
    ri AS (SELECT {t_} term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM dfq {js}),
    mi AS (SELECT {t_} avg(idf) AS mean_idf FROM ri {grp}),
    ii AS (SELECT {t_} term, CASE WHEN idf < 0 THEN 0.25 * mean_idf ELSE idf END AS idf FROM ri {jm}),
    qt AS (SELECT query_id, {t_} term, count(*) AS qtf FROM
            (SELECT query_id, {t_} unnest({sql_tokens('text')}) AS term FROM qs) GROUP BY ALL),
    qn AS (SELECT query_id, count(DISTINCT term) AS qd FROM qt GROUP BY ALL),
    w AS (SELECT q.query_id, {qt} q.term, q.qtf * i.idf AS wt FROM qt q JOIN ii i ON {jq} q.term = i.term),
    agg AS (SELECT w.query_id, {', '.join('p.' + k.strip() for k in key.split(','))},
             sum(w.wt * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.dl / avgdl))) AS bm25,
             count(*) AS common, any_value(p.dt) AS dt
            FROM (SELECT * FROM po {js}) p JOIN w ON p.term = w.term {on_t} GROUP BY ALL),
    scored AS (SELECT agg.*, 0.75 * common / qd + 0.25 * common / greatest(10.0, sqrt(dt)) AS overlap
               FROM agg JOIN qn USING (query_id))"""
