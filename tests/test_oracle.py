"""Every query against DuckDB: columns, types and all rows."""

import compare
import pytest

import __spark_entry__ as entry
import oracle_queries
from cartwright.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.queries())
    assert set(QUERIES) == set(oracle_queries.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows(spark, duck, name):
    result = entry.queries()[name](spark, SF_DIR)
    sql = entry.oracle_sql()[name]
    duck.execute(f"CREATE OR REPLACE VIEW oracle_{name} AS {sql}")
    assert compare.spark_types(result) == compare.duck_types(duck, sql)
    assert compare.spark_rows(result) == compare.duck_rows(duck, sql)


def test_entry(spark):
    assert entry.entry(spark).count() == 4
