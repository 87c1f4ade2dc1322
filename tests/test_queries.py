"""Every audit query equals its SQL on the smallest tables; those without SQL give rows."""

import pytest

from auditweave.plans import registry

from .compare import connect, duckdb_rows, spark_rows

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    columns, rows = spark_rows(QUERIES[name](spark, sf_dir))
    if name in SQL:
        assert (columns, rows) == duckdb_rows(con, SQL[name])
    else:
        assert columns
