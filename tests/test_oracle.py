"""Every query of the reference's operators that SQL can express gives DuckDB's rows."""

import pytest

from quire.plans import catalog

from .compare import compare, connection


@pytest.fixture(scope="module")
def db(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(spark, sf_dir, db, name):
    compare(catalog.QUERIES[name](spark, sf_dir), db, catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() >= 0
