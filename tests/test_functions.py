"""JSON reads, canonical form, identifiers, side tables and streams."""

from __future__ import annotations

import hashlib
import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scorebook.functions import canon, ids, jsonx
from scorebook.operators import records
from scorebook.sources import ingest
from scorebook.streaming import jobs


def test_strict_reads(spark):
    body = ['{"k": 4}', '{"k": "4"}', '{"k": 4.5}', '{"k": true}', '{"k": null}', "{}", None, "not json"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(body)], "i int, body string").withColumn("v", jsonx.parsed(F.col("body")))
    v = F.col("v")
    got = df.select("i", jsonx.json_num(v, "$.k").alias("n"), jsonx.json_str(v, "$.k").alias("s"), jsonx.json_bool(v, "$.k").alias("b"), jsonx.exists(v, "$.k").alias("e"), jsonx.is_null(v, "$.k").alias("z")).orderBy("i").collect()
    assert [r["n"] for r in got] == [4.0, None, 4.5, None, None, None, None, None]
    assert [r["s"] for r in got] == [None, "4", None, None, None, None, None, None]
    assert [r["b"] for r in got] == [None, None, None, True, None, None, None, None]
    assert [r["e"] for r in got] == [True, True, True, True, True, False, False, False]
    assert [r["z"] for r in got] == [False, False, False, False, True, False, False, False]


def test_containment():
    assert jsonx.holds({"a": {"b": 4.0, "c": 1}}, jsonx.nested(["a", "b"], 4))
    assert jsonx.holds({"a": [1, {"x": 2}]}, {"a": [{"x": 2}]})
    assert not jsonx.holds({"a": True}, {"a": 1}) and not jsonx.holds({}, {"a": None})
    assert jsonx.path("ext", 'a/"b"-c') == '$["ext"]["a/\\"b\\"-c"]'
    with pytest.raises(ValueError):
        jsonx.path("a\x01")


@pytest.mark.parametrize(("x", "text"), [(0.0, "0"), (-0.0, "0"), (1.0, "1"), (4.50, "4.5"), (1e21, "1e+21"), (1e20, "100000000000000000000"), (1e-7, "1e-7"), (0.000001, "0.000001"), (123e-20, "1.23e-18"), (333333333.33333329, "333333333.3333333"), (9007199254740993, "9007199254740992"), (100000000000000000001, "100000000000000000000")])
def test_numbers(x, text):
    assert canon.number(x) == text


@given(st.recursive(st.none() | st.booleans() | st.integers(-(2**53), 2**53) | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(), x, max_size=3), max_leaves=8))
def test_canonical_is_a_fixed_point(value):
    try:
        once = canon.canonical(value)
        once.encode()
    except UnicodeEncodeError:
        return
    assert canon.canonical(json.loads(once)) == once


def test_keys_in_utf16_order():
    assert canon.canonical({"דּ": 1, "\U0001f600": 2, "a": 3}) == '{"a":3,"\U0001f600":2,"דּ":1}'


def test_fingerprints_leave_out_context_window():
    a = canon.facet_hash({"model": {"id": "m", "context_window": 8, "ext": {}}}, "model")
    assert a == hashlib.sha256(b'{"id":"m"}').hexdigest()
    assert canon.facet_hash({"model": None}, "model") == canon.facet_hash({}, "model") == hashlib.sha256(b"{}").hexdigest()


def test_ids(spark):
    df = spark.createDataFrame([(x,) for x in ("a/b@3", "external:x", "hf:x", "a/b", "a/b@0", "A/b@1", "a/b@1\n")], "t string")
    got = [tuple(r["p"]) for r in df.select(ids.parsed_target(F.col("t")).alias("p")).collect()]
    none = (None, None, None, None)
    assert got == [("version", "a", "b", 3), ("external", None, None, None), ("hf", None, None, None), none, none, none, none]
    times = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02 03:04:05Z",), ("2024-01-02T03:04:05+01:00",), ("2024-13-02T03:04:05Z",)], "t string")
    assert [r[0] for r in times.select(F.unix_timestamp(ids.instant(F.col("t")))).collect()] == [1704164645, None, 1704161045, None]
    runs = spark.createDataFrame([("r1",), ("",), ("a/b",), ("é" * 101,)], "t string")
    assert [r[0] for r in runs.select(ids.is_run_id(F.col("t"))).collect()] == [True, False, False, False]


def test_side_tables(spark, tmp_path):
    body = {"results": [{"metric": "m", "value": 1.5, "n": 3, "aggregation": "mean"}, {"metric": "k", "value": 2}], "relations": [{"type": "core/uses_eval", "to": "a/b@1"}]}
    df = spark.createDataFrame([(7, json.dumps(body)), (8, "{}")], "version_id long, body string")
    tables = ingest.side_tables(df)
    assert [(r["version_id"], r["ordinal"], r["metric"], r["value"]) for r in tables["results"].orderBy("ordinal").collect()] == [(7, 0, "m", 1.5), (7, 1, "k", 2.0)]
    assert tables["relations"].count() == 1 and tables["attachments"].count() == 0
    ingest.append(tables, str(tmp_path / "t"))
    ingest.append(tables, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t/results")).count() == 4


def test_batch_and_attachments(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"runs": [{"run_id": "x"}, {"run_id": "y"}]}))
    rows = ingest.read_batch(spark, str(tmp_path / "b.json")).orderBy("position").collect()
    assert [json.loads(r["run"])["run_id"] for r in rows] == ["x", "y"]
    with pytest.raises(Exception, match="413"):
        ingest.read_batch(spark, str(tmp_path / "b.json"), 1).collect()
    (tmp_path / "files").mkdir()
    (tmp_path / "files/a").write_bytes(b"abc")
    assert ingest.read_attachments(spark, str(tmp_path / "files")).first()["sha256"] == hashlib.sha256(b"abc").hexdigest()


def test_streams(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "1.json").write_text('{"version_id": 1, "body": "{\\"results\\": [{\\"metric\\": \\"m\\", \\"value\\": 1}]}"}\n')
    jobs.ingest_bodies(spark, str(source), out, str(tmp_path / "cp"))
    (source / "2.json").write_text('{"version_id": 2, "body": "{\\"results\\": [{\\"metric\\": \\"k\\", \\"value\\": 2}]}"}\n')
    jobs.ingest_bodies(spark, str(source), out, str(tmp_path / "cp"))
    results = spark.read.parquet(f"{out}/results")
    assert sorted((r["version_id"], r["metric"]) for r in results.collect()) == [(1, "m"), (2, "k")]
    known = spark.createDataFrame([("metrics", "m")], "kind string, id string")
    jobs.badge_sweep(spark, f"{out}/results", known, str(tmp_path / "badges"), str(tmp_path / "cp2"))
    assert sorted((r["version_id"], r["registered"]) for r in spark.read.parquet(str(tmp_path / "badges")).collect()) == [(1, True), (2, False)]


def test_latest_carries_any_type(spark):
    rows = spark.sql("select 'r' as record_id, seq, false as tombstoned, map('k', seq) as body from values (1), (3), (2) as t(seq)")
    assert records.latest(rows).first()["body"] == {"k": 3}
