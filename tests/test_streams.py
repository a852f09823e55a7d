"""Streams over tables that are one file or a folder of files."""
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def folders(spark, sf, tmp_path_factory):
    """The tables of the streams as folders of three files each."""
    out = tmp_path_factory.mktemp("folders")
    for t in ("documents", "events"):
        spark.read.parquet(f"{sf}/{t}.parquet").repartition(3).write.parquet(f"{out}/{t}.parquet")
    return str(out)


@pytest.mark.parametrize("name", ["stream_dedupe", "stream_ingest", "stream_source_changes", "stream_sessions"])
def test_a_folder_gives_the_rows_of_a_file(spark, sf, folders, name):
    q = entry.queries()[name]
    rows = lambda at: sorted(tuple(r) for r in q(spark, at).collect())
    want = rows(sf)
    assert want and rows(folders) == want
