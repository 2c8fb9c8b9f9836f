"""Every contract query against its DuckDB oracle at the smallest scale factor."""

import os

import pytest

from contract.all import ORACLES, QUERIES
from contract.check import compare, oracle_connection

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, duck, name):
    ok, note = compare(spark, duck, SF, name, QUERIES[name], ORACLES.get(name))
    if note == "both empty":
        pytest.skip("no rows at this scale")
    assert ok, note
