"""Registered queries against their SQL, and what the SQL cannot say."""

import pytest
from compare import difference, oracle

import __spark_entry__
from adlake.llm import queries


@pytest.mark.parametrize("key", list(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, key):
    assert difference(queries.QUERIES[key](spark, sf_dir), oracle(sf_dir), queries.ORACLES[key]) is None


def test_all_are_registered():
    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 14)} <= {name.split("_")[0] for name in names} and "pipeline" in names
