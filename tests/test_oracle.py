"""Every registered query against its check SQL on the smallest data."""

import pytest
from compare import connect, differences
from conftest import SMALL

import __spark_entry__ as contract
from quayline.suite import registry

QUERIES = registry.queries()
CHECKS = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, key):
    assert key in CHECKS
    found = differences(QUERIES[key](spark, SMALL), con, CHECKS[key])
    assert found is None, found


def test_entry(spark):
    assert contract.entry(spark).count() > 0
