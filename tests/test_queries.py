"""Every registered query against its SQL equivalent on the smallest data set."""
import os

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = os.environ.get("DOCREG_TEST_DATA", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()

pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{ROOT}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, ROOT)
    columns = sorted(df.columns)
    got = sorted(repr([r[c] for c in columns]) for r in df.collect())
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(repr([r[i] for i in order]) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, ROOT).count() > 0


def test_flagship(spark):
    assert entry.entry(spark).count() == 5


@pytest.mark.parametrize("name", ["ocr_quality", "boxes_in_region", "split_scope", "record_trend_monthly", "approve_fields"])
def test_no_cross_join(spark, name):
    plan = entry.queries()[name](spark, ROOT)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_scan_reads_needed_columns_only(spark):
    plan = entry.queries()["headline"](spark, ROOT)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan and "o_custkey" not in plan
