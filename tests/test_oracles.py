"""Every core query against its DuckDB oracle."""

import pytest
from oracle import check, connection

from sparkloom.plans.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return connection()


def test_each_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    check(spark, con, QUERIES[name], ORACLES[name])
