"""Every registered query with SQL gives the rows that DuckDB gives; the others run."""

import pytest
from oracle import same

from corpusmill.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, name):
    same(spark, SF, catalogue.QUERIES[name], catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql(spark, name):
    rows = catalogue.QUERIES[name](spark, SF).collect()
    assert rows
    assert all(r["whole"] for r in rows) if name == "pretokenized" else True
