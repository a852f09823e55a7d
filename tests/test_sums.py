"""Sums of doubles that end in a half: the same whichever way the rows lie."""
import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from dossier.operators.bounds import ordered_sum
from tools.check import rows_of


@pytest.fixture(scope="module")
def turned(spark, tmp_path_factory):
    """All orders of the customers that have a yearly sum ending in a half; one folder in order, one backwards in three files."""
    out = tmp_path_factory.mktemp("turned")
    o = spark.read.parquet("/root/testdata/sf0.1/orders.parquet")
    tied = o.groupBy("o_custkey", F.year("o_orderdate")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("s")).filter("s % 1 = 0.5")
    o = o.join(tied.select("o_custkey").distinct(), "o_custkey", "left_semi").select(o.columns)
    o.coalesce(1).sortWithinPartitions("o_orderkey").write.parquet(f"{out}/straight/orders.parquet")
    o.repartition(3).sortWithinPartitions(F.desc("o_orderkey")).write.parquet(f"{out}/backwards/orders.parquet")
    return out


@pytest.mark.parametrize("name", ["period_offset", "wide_to_long", "table_candidates"])
def test_halves_round_as_in_sql_however_rows_lie(spark, turned, name):
    con = duckdb.connect()
    con.sql("set threads = 1")  # with more of them DuckDB adds up parts, and halves fall either way
    con.sql(f"create view orders as select * from '{turned}/straight/orders.parquet/*.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    for lie in ("straight", "backwards"):
        df = entry.queries()[name](spark, f"{turned}/{lie}")
        assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


def test_ordered_sum(spark):
    rows = [("a", 3, 0.3), ("a", 1, 0.1), ("a", 2, 0.2), (None, 1, None), (None, 2, 5.0), ("b", 1, None)]
    got = ordered_sum(spark.createDataFrame(rows, "k string, o int, v double"), ["k"], "v", "o", "s").collect()
    assert {r.k: r.s for r in got} == {"a": 0.1 + 0.2 + 0.3, None: 5.0, "b": None}
