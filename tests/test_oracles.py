"""Every query that SQL can express, against DuckDB."""

import pytest

from tests.oracle import connect, rows_of_spark, rows_of_sql
from tidemark.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, sf_dir, con, name):
    assert rows_of_spark(catalog.QUERIES[name](spark, sf_dir)) == rows_of_sql(con, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_has_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0
