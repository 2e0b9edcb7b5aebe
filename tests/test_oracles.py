"""Every query against its SQL on the smallest tables, and the driver contract."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from branchtally import driver
from tests.oracle import connect, difference

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = driver.QUERIES, driver.ORACLES


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert QUERIES.items() <= entry.queries().items() and ORACLES.items() <= entry.oracle_sql().items()


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    assert difference(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) is None
