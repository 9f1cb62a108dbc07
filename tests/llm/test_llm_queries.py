"""Queries of the operators that SQL can express, against their SQL."""

import pytest
from conftest import DATA, oracle_rows, rows_of

from millrace.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    columns, want = oracle_rows(registry.ORACLES[name])
    assert sorted(df.columns) == columns
    assert rows_of(df) == want


def test_entry_has_them():
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
