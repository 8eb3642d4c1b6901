"""Every registered query over the smallest tables equals its SQL in DuckDB."""

from __future__ import annotations

import pytest

from scorebook import registry
from tests.oracle import differences, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert differences(spark, con, QUERIES[name], ORACLES[name], SF) == ""
