"""Every registered query against its SQL on the smallest supplied tables."""

import pytest

from __spark_entry__ import entry
from pharmalith.plans.catalog import ORACLES, QUERIES
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf, con, name):
    compare(spark, con, QUERIES[name], ORACLES[name], sf)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0
