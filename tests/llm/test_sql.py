"""Queries with SQL against it, on the smallest tables."""

import pytest
from helpers import SF, same_rows

from tidewatch.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(name, spark, duck):
    same_rows(queries.QUERIES[name](spark, SF), duck, queries.ORACLES[name])


def test_one_query_each():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
