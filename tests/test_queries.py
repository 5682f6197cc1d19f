import os

import pytest
from pyspark.sql import DataFrameReader

from quirefold.plans import catalog
from tests.compare import DATA, same

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    same(spark, catalog.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


def test_sql_has_a_query():
    assert set(SQL) <= set(catalog.queries())


def test_the_word_scan_reads_only_what_it_needs(spark):
    frame = catalog.token_count(spark, DATA)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert "ReadSchema: struct<line_no:bigint,text:string>" in plan


def test_entry(spark):
    assert catalog.flagship(spark, DATA).count() > 0


def test_the_single_file_is_read_by_splits(spark, monkeypatch):
    """No row holds a whole file; lines of many splits are numbered as one file's."""
    read, most = DataFrameReader.text, spark.conf.get("spark.sql.files.maxPartitionBytes")

    def text(self, paths, wholetext=False, **options):
        assert not wholetext
        return read(self, paths, **options)

    monkeypatch.setattr(DataFrameReader, "text", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        same(spark, catalog.queries()["q38_single_file"], SQL["q38_single_file"])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
