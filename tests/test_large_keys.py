"""Queries over tables whose keys are as large as those of larger copies."""

from __future__ import annotations

import shutil

import pytest
from pyspark.sql import functions as F

from scorebook import registry

SF = "/root/testdata/sf0.001"
SHIFT = 40_000_000


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """Orders and their lines of the smallest tables under keys past 2**63 / 10**13."""
    d = tmp_path_factory.mktemp("far")
    for name, keys in (("orders", ["o_orderkey"]), ("lineitem", ["l_orderkey"])):
        t = spark.read.parquet(f"{SF}/{name}.parquet")
        t.withColumns({k: F.col(k) + SHIFT for k in keys}).write.parquet(f"{d}/{name}.parquet")
    for name in ("customer", "part", "supplier"):
        shutil.copy(f"{SF}/{name}.parquet", d)
    return str(d)


def test_large_numbers_of_large_keys(spark, far):
    got = registry.queries()["der_numbers"](spark, far)
    assert {(r["path"], r["code"]) for r in got.collect()} == {("/task/n", "number_too_large")}
    assert got.count() == spark.read.parquet(f"{far}/orders.parquet").count()


@pytest.mark.parametrize("name", ["der_badges", "der_facts"])
def test_badges_of_large_keys(spark, far, name):
    assert registry.queries()[name](spark, far).count() == spark.read.parquet(f"{far}/orders.parquet").count()
