"""Every core query that has an SQL twin gives the same rows as DuckDB on the same tables."""

from __future__ import annotations

import pytest

from revora.plans import registry

from .oracle import connection, difference

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, folder, name):
    found = QUERIES[name](spark, folder).toPandas()
    assert difference(found, connection(folder), SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, folder, name):
    assert QUERIES[name](spark, folder).columns


def test_entry(spark, folder):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
