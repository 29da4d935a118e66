"""Problem queries with SQL give the rows of that SQL."""

import pytest

from ionloom.llm.queries import registry
from tests.compare import DATA, spark_rows, sql_rows


@pytest.mark.parametrize("name", list(registry.sql))
def test_query(spark, name):
    assert spark_rows(registry.queries[name](spark, DATA)) == sql_rows(registry.sql[name])
