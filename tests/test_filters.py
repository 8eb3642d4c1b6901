"""Filters, ordering and pages."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scorebook.operators import filters, paging
from scorebook.operators.filters import Fact, FilterError, Scalar, Side, Vocabulary


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, "a", 1.0), (2, "b%", None), (3, None, 3.0)], "id int, name string, x double")


@pytest.fixture(scope="module")
def words(spark):
    side = spark.createDataFrame([(1, "m", 5.0), (1, "n", 9.0), (2, "m", 9.0)], "id int, metric string, value double")
    fact = spark.createDataFrame([(1, "aa")], "id int, h string")
    return Vocabulary(
        {"name": Scalar(F.col("name"), "string"), "x": Scalar(F.col("x"), "number"), "raw": Scalar(F.col("x"), "number", indexed=False)},
        {"results": Side(side, "id", {"metric": Scalar(F.col("metric"), "string"), "value": Scalar(F.col("value"), "number")})},
        {"print": Fact(fact, "id", "h")},
    )


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize(
    ("where", "want"),
    [
        (None, [1, 2, 3]),
        ({"and": []}, [1, 2, 3]),
        ({"or": []}, []),
        ({"path": "name", "op": "eq", "value": "a"}, [1]),
        ({"not": {"path": "name", "op": "eq", "value": "a"}}, [2]),
        ({"path": "name", "op": "prefix", "value": "b%"}, [2]),
        ({"path": "name", "op": "in", "value": []}, []),
        ({"path": "x", "op": "exists"}, [1, 3]),
        ({"path": "results", "op": "any", "match": {"metric": "m", "value": {"op": "gte", "value": 9}}}, [2]),
        ({"not": {"path": "results", "op": "any", "match": {"metric": "m"}}}, [3]),
        ({"path": "print", "op": "ne", "value": "aa"}, [2, 3]),
        ({"or": [{"path": "print", "op": "exists"}, {"path": "x", "op": "gt", "value": 2}]}, [1, 3]),
    ],
)
def test_filters(rows, words, where, want):
    assert ids(filters.apply(rows, where, words)) == want


@pytest.mark.parametrize(
    ("where", "code"),
    [
        ({"path": "nope", "op": "eq", "value": 1}, "unknown_path"),
        ({"path": "x", "op": "eq", "value": "1"}, "type_mismatch"),
        ({"path": "x", "op": "eq", "value": True}, "type_mismatch"),
        ({"path": "x", "op": "prefix", "value": "1"}, "type_mismatch"),
        ({"path": "raw", "op": "gt", "value": 1}, "not_indexed"),
        ({"path": "print", "op": "gt", "value": "a"}, "not_indexed"),
        ({"path": "results", "op": "exists"}, "type_mismatch"),
        ({"path": "name"}, "bad_request"),
    ],
)
def test_errors(rows, words, where, code):
    with pytest.raises(FilterError) as e:
        filters.apply(rows, where, words)
    assert e.value.code == code


def test_pages_join_up(spark):
    data = [(i, None if i % 3 == 0 else i % 4) for i in range(30)]
    df = spark.createDataFrame(data, "id int, k int")
    for d1 in ("asc", "desc"):
        for d2 in ("asc", "desc"):
            sort = [("k", d1), ("id", d2)]
            whole = [(r["k"], r["id"]) for r in df.orderBy(*paging.ordering(sort)).collect()]
            got, cursor = [], None
            while True:
                page = [(r["k"], r["id"]) for r in paging.page(df, sort, 7, cursor).collect()]
                got += page[:7]
                if len(page) <= 7:
                    break
                cursor = list(got[-1])
            assert got == whole


def test_tie_break_follows_last_key():
    assert paging.with_tie([("status", "asc"), ("kind", "desc")], "id", []) == [("status", "asc"), ("kind", "desc"), ("id", "desc")]
    assert paging.parse_sort("a:b:desc") == ("a:b", "desc") and paging.parse_sort("a:b") == ("a:b", "asc")


def test_cursor_is_signed():
    c = paging.sign({"k": [1, None]}, b"s")
    assert paging.verify(c, b"s") == {"k": [1, None]}
    with pytest.raises(ValueError):
        paging.verify(c, b"t")
