"""Every query with an oracle agrees with DuckDB on the smallest tables."""

import pytest

from folioflow.plans.all import ORACLES, QUERIES
from tests.parity import compare, connection

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_its_oracle(spark, con, name):
    compare(QUERIES[name](spark, SF), con, ORACLES[name])
