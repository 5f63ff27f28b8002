"""Every registered query against its check SQL, or row and invariant checks where SQL cannot express it."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference

SF = os.environ.get("LUREWATCH_TEST_SF", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, ORACLES[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 600
