"""Every registered query against its SQL in DuckDB."""

import pytest
from compare import difference, oracle

import __spark_entry__
from adlake.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle(sf_dir)


@pytest.mark.parametrize("key", list(catalog.QUERIES))
def test_query_equals_sql(spark, con, sf_dir, key):
    frame = catalog.QUERIES[key](spark, sf_dir)
    assert difference(frame, con, catalog.ORACLES[key]) is None


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(catalog.ORACLES) <= set(__spark_entry__.oracle_sql())


def test_entry(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.columns == ["country", "cat", "total", "place"]
    assert frame.count() == 25
