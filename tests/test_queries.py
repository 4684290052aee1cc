"""Every registered query against its SQL, over whole tables."""

import compare
import pytest

import __spark_entry__ as entry_points
from tabletrust import workload

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = workload.QUERIES, workload.SQL


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


def test_every_sql_has_its_query():
    assert set(SQL) == set(QUERIES)
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert set(QUERIES) <= set(entry_points.queries())


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() == 6 and "semantic_type" in df.columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    assert compare.differences(df, con, SQL[name]) == []
