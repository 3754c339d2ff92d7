"""Every catalog query against its DuckDB oracle on the sf0.001 stand-ins."""

import pytest

from compare import compare, duckdb_connection
from subrecon.checks.oracle import SQL
from subrecon.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def con(sf_small):
    return duckdb_connection(sf_small)


def test_every_query_has_oracle():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, sf_small, con, name):
    o = compare(spark, sf_small, name, QUERIES[name], SQL[name], con)
    assert o.columns_match, o.detail
    assert o.spark_rows == o.oracle_rows, o.detail
    assert o.values_match, o.detail


def test_entry_smoke(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["metric", "numerator", "denominator", "percent"]
    assert df.count() == 6
    assert set(QUERIES) <= set(e.oracle_sql()) <= set(e.queries())
