"""The operators' queries that SQL can express, against DuckDB."""

import pytest
from oracle import same

from corpusmill.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    same(spark, SF, queries.QUERIES[name], queries.ORACLES[name])
