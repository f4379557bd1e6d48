"""Every registered query against its check SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from compare import TABLES, rows
from tidewell.plans import catalog
from tests.conftest import SF

QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [bad for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython") if bad in plan]
    got = [tuple(r) for r in df.collect()]
    assert len(set(df.columns)) == len(df.columns)
    if name in ORACLES:
        rel = con.sql(ORACLES[name])
        assert sorted(df.columns) == sorted(rel.columns)
        assert rows(df.columns, got) == rows(rel.columns, rel.fetchall())


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns[:3] == ["request_id", "rank", "id"] and df.count() > 0


@pytest.mark.parametrize("name", ["c8_search_score", "c13_nearest_k", "e9_merge_events", "h2_even_sample", "e12_nest_items"])
def test_same_result_with_one_shuffle_partition(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    many = rows(*(lambda d: (d.columns, [tuple(r) for r in d.collect()]))(QUERIES[name](spark, SF)))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        single = rows(*(lambda d: (d.columns, [tuple(r) for r in d.collect()]))(QUERIES[name](spark, SF)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert many == single
