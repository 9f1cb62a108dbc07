"""Every query of the catalogue against its SQL."""

import pytest
from conftest import DATA, oracle_rows, rows_of

from millrace.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns, want = oracle_rows(catalogue.ORACLES[name])
    assert sorted(df.columns) == columns
    assert rows_of(df) == want
