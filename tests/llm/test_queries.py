"""Every registered query of the package that has SQL, against it."""

import pytest

from compare import duckdb_rows, normalized
from gridtally.llm import registry

SF_DIR = "/root/testdata/sf0.01"
SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", SQL)
def test_query_matches_sql(spark, name):
    result = registry.queries()[name](spark, SF_DIR)
    names, _, expected = duckdb_rows(SQL[name], SF_DIR)
    rows = [tuple(row) for row in result.collect()]
    assert sorted(result.columns) == sorted(names)
    assert len(rows) == len(expected) > 0
    assert normalized(result.columns, rows) == normalized(names, expected)
