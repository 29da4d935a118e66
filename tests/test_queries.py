"""Every core query with SQL gives the rows of that SQL; the others give rows."""

import importlib

import pytest

import __spark_entry__ as entry
from tests.compare import DATA, spark_rows, sql_rows

REGISTRIES = [importlib.import_module(m).registry for m in entry.CORE]
QUERIES = {k: f for r in REGISTRIES for k, f in r.queries.items()}
SQL = {k: s for r in REGISTRIES for k, s in r.sql.items()}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    columns, rows = spark_rows(QUERIES[name](spark, DATA))
    if name in SQL:
        expected_columns, expected = sql_rows(SQL[name])
        assert columns == expected_columns
        assert rows == expected
    else:
        assert rows


def test_entry(spark):
    assert entry.entry(spark).columns == ["row_id", "ev_tenths"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
