"""Every query with SQL against DuckDB, on whole tables."""

import pytest

from quire.llm import queries
from tests.oracle_check import compare, duck


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, sf, name):
    status, a, b, msg = compare(queries.QUERIES[name](spark, sf), duck(sf), queries.ORACLE[name])
    assert status == "OK", (name, a, b, msg)
