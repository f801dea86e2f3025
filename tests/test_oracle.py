"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry_points
from gridtally.plans import oracle, registry
from compare import duckdb_rows, normalized

SF_DIR = "/root/testdata/sf0.01"
QUERIES = registry.queries()
SQL = oracle.oracle_sql()


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, name):
    result = QUERIES[name](spark, SF_DIR)
    names, types, expected = duckdb_rows(SQL[name], SF_DIR)
    rows = [tuple(row) for row in result.collect()]
    assert sorted(result.columns) == sorted(names)
    assert len(rows) == len(expected) > 0
    assert normalized(result.columns, rows) == normalized(names, expected)


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert len(rows) == 30
