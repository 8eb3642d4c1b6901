"""Hot columns, exports, comparison, traversal, and filters that are none."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from scorebook.operators import comparison, filters, graph, hot
from scorebook.sources import audit, ingest


def test_hot_columns_are_typed(spark):
    body = {"title": "t", "model": {"id": 5, "provider": None}, "generation": {"temperature": "0.5", "top_p": 1, "max_tokens": 2.5}, "trial": {"k": True}, "env": {"git": {"commit": {"a": [1]}, "dirty": "no"}}}
    df = spark.createDataFrame([(1, json.dumps(body)), (2, None), (3, "{"), (4, "[]")], "version_id long, body string")
    got = {r["version_id"]: r.asDict() for r in hot.with_columns(df).collect()}
    one = got[1]
    assert one["title"] == "t" and one["model_id"] == "5" and one["model_provider"] is None and json.loads(one["env_git_commit"]) == {"a": [1]}
    assert one["gen_temperature"] is None and one["gen_top_p"] == 1.0 and one["gen_max_tokens"] == 2.5 and one["trial_k"] is None and one["env_git_dirty"] is None
    assert all(got[i][c] is None for i in (2, 3, 4) for c in hot.COLUMNS)


def test_a_filter_on_a_hot_column_reads_neither_the_body_nor_all_row_groups(spark, tmp_path):
    df = spark.range(3000).select(F.col("id").alias("version_id"), F.concat(F.lit('{"model":{"id":"m'), (F.col("id") % 30).cast("string"), F.lit('"},"pad":"'), F.repeat(F.lit("x"), 200), F.lit('"}')).alias("body"))
    path = str(tmp_path / "versions")
    hot.write(df, path, ["model_id"], files=6)
    found = hot.read(spark, path).where("model_id = 'm7'").select("version_id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(model_id,m7)" in plan and "body" not in plan.split("ReadSchema")[1]
    assert sorted(r["version_id"] for r in found.collect()) == list(range(7, 3000, 30))
    # clustered: each model lies in one file
    files = hot.read(spark, path).select("model_id", F.input_file_name().alias("f")).distinct().groupBy("model_id").count()
    assert files.where("count > 1").count() == 0
    same = df.where(hot.below(F.try_parse_json("body"), ["model", "id"], "string") == "m7").count()
    assert same == found.count()


def test_model_index(spark):
    full = {"model": {"id": "m: 'x'"}, "task": {"id": "t", "split": "test"}, "results": [{"metric": "b", "value": 1}, {"metric": "a", "value": 0.25}, {"metric": 5, "value": 1}, {"metric": "c", "value": "1"}]}
    rows = [(1, "card/a/b@1", "https://h/x", json.dumps(full)), (2, "s", None, '{"results": []}'), (3, "s", None, '{"results": [{"metric": "a"}]}'), (4, "s", None, None), (5, "s", None, '{"results": [{"metric": "a", "value": 2}]}')]
    got = {r["version_id"]: r for r in ingest.model_index(spark.createDataFrame(rows, "version_id long, subject string, url string, body string"), "scorebook").collect()}
    assert got[1]["yaml"].split("\n")[:12] == ["model-index:", "- name: \"m: 'x'\"", "  results:", "  - task:", '      type: "t"', '      name: "t"', "    dataset:", '      type: "t"', '      name: "t"', '      split: "test"', "    metrics:", '    - type: "b"']
    assert '    - type: "a"\n      value: 0.25\n      name: "a"\n    source:\n      name: "scorebook card/a/b@1"\n      url: "https://h/x"\n' in got[1]["yaml"]
    assert [got[i]["code"] for i in (1, 2, 3, 4, 5)] == [None, "bad_request", "bad_request", "bad_request", None]
    assert '- name: "unknown"' in got[5]["yaml"] and "split" not in got[5]["yaml"] and "url" not in got[5]["yaml"]


@pytest.mark.parametrize(
    ("where", "at"),
    [
        ({"not": {"path": "x", "op": "exists"}, "path": "x"}, "/where"), ({"or": [1]}, "/where/or/0"), ({"or": {"path": "x"}}, "/where"), ({"and": 5}, "/where"), ({"and": [], "or": []}, "/where"), ([], "/where"), ("x", "/where"),
        ({"path": "x", "op": "eq", "value": 1, "more": 2}, "/where"), ({"path": "x", "op": "eq"}, "/where"), ({"path": "x", "op": "exists", "value": 1}, "/where"), ({"path": ["x"], "op": "eq", "value": 1}, "/where"), ({"path": "x", "op": 5, "value": 1}, "/where"),
        ({"and": [{"not": []}]}, "/where/and/0/not"), ({"path": "r", "op": "any", "match": []}, "/where/match"), ({"path": "r", "op": "any", "match": {"m": {"op": "eq"}}}, "/where/match/m"), ({"path": "r", "op": "any", "match": {"m": [1]}}, "/where/match/m"),
    ],
)
def test_what_is_no_filter_is_refused(spark, where, at):
    df = spark.range(3).select("id", F.col("id").cast("double").alias("x"))
    words = filters.Vocabulary({"x": filters.Scalar(F.col("x"), "number")}, {"r": filters.Side(df, "id", {"m": filters.Scalar(F.col("x"), "number")})})
    with pytest.raises(filters.FilterError) as e:
        filters.apply(df, where, words)
    assert (e.value.pointer, e.value.code) == (at, "bad_request")


def test_traversal_walks_a_node_once(spark):
    edges = spark.createDataFrame([(1, "a", 2), (2, "a", 3), (3, "a", 1), (3, "b", 4), (4, "a", 5), (5, "a", 6), (6, "a", 7), (7, "a", 8), (2, "a", 3)], "from_id long, type string, to_id long")
    start = spark.createDataFrame([(1,), (1,)], "node long")
    got = lambda *a: sorted((r["node"], r["distance"]) for r in graph.traverse(edges, start, *a).collect())
    assert got(1) == [(1, 0), (2, 1)] and got(0) == got(1)
    assert got(9) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (6, 5)]
    assert got(5, "in") == [(1, 0), (2, 2), (3, 1)] and got(2, "both", ["b"]) == [(1, 0)]
    assert graph.traverse(edges, start.limit(0), 3).count() == 0


def test_log_numbers_follow_the_order(spark):
    rows = spark.range(500).select(((F.col("id") * 7919) % 101).alias("a"), "id").repartition(5)
    got = [(r["audit_id"], r["a"], r["id"]) for r in audit.numbered(rows, ["a", "id"], 10).orderBy("audit_id").collect()]
    assert [g[0] for g in got] == list(range(11, 511)) and [g[1:] for g in got] == sorted(g[1:] for g in got)


def test_comparison(spark):
    kinds = "version_id long, record_id long, type string, ns string, name string, seq long, visibility string, tombstoned boolean, content_hash string, address string"
    targets = spark.createDataFrame([
        (1, 10, "eval", "a", "e", 1, "public", False, "h1", "a/e@1"), (2, 20, "card", "a", "x", 1, "public", False, "h2", "a/x@1"), (3, 20, "card", "a", "x", 2, "public", False, "h3", "a/x@2"),
        (4, 30, "card", "a", "b", 1, "public", False, "h4", "a/b@1"), (5, 40, "card", "p", "y", 1, "private", False, "h5", "p/y@1"), (6, 50, "eval", "a", "z", 1, "public", False, "h6", "a/z@1"),
    ], kinds)
    edges = spark.createDataFrame([(2, "core/uses_eval", 1, None), (3, "core/uses_eval", 1, None), (3, "core/uses_eval", None, "a/e@1"), (4, "core/uses_eval", None, "a/e@1"), (5, "core/uses_eval", 1, None), (6, "core/uses_eval", 1, None)], "from_version_id long, type string, to_version_id long, to_external string")
    prints = spark.createDataFrame([(3, "model", "m"), (3, "harness", "h"), (4, "model", "m")], "version_id long, facet string, fingerprint string")
    used = spark.createDataFrame([(3, 10, "r1", "o1"), (3, 10, "r2", "c2")], "version_id long, eval_record_id long, run_id string, posted_hash string")
    runs = spark.createDataFrame([(10, "r1", "c1"), (10, "r2", "c2")], "record_id long, run_id string, content_hash string")
    run_prints = spark.createDataFrame([(10, "r1", "model", "m"), (10, "r2", "model", "m"), (10, "r1", "harness", "h")], "record_id long, run_id string, facet string, fingerprint string")
    rows = comparison.compare(targets.where("type = 'eval'"), edges, targets, prints, used, runs, run_prints, [])
    got = {r["version_id"]: r for r in rows.collect()}
    assert set(got) == {3, 4}  # an older version, a private card and an eval are not compared
    assert (got[3]["same_model"], got[3]["same_harness"], got[3]["runs_used"], got[3]["changed"]) == (True, False, 2, ["r1"])
    assert (got[4]["same_model"], got[4]["runs_used"], got[4]["changed"], got[4]["fingerprints"]) == (False, 0, [], {"model": "m"})
    assert [[x["name"] for x in r["items"]] for r in comparison.grouped(rows, "model").collect()] == [["b", "x"]]
    assert {r["version_id"] for r in comparison.compare(targets.where("type = 'eval'"), edges, targets, prints, used, runs, run_prints, ["p"]).collect()} == {3, 4, 5}
