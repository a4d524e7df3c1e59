"""Every query that has SQL gives the same rows, names and types in DuckDB."""

from __future__ import annotations

import pytest
from compare import difference, duck

from __spark_entry__ import entry, oracle_sql, queries


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, sf, con, name):
    got = queries()[name](spark, sf).toPandas()
    assert difference(got, con.sql(oracle_sql()[name]).df()) is None


def test_entry(spark):
    assert entry(spark).columns == ["week", "case_id", "user_id", "src", "dst", "value"]


def test_sql_only_for_known_queries():
    assert set(oracle_sql()) <= set(queries())
