"""Creating and appending versions."""

from __future__ import annotations

import json

from scorebook.operators import ingest_records

MAKER = {"name": "h", "version": "1"}
SHA = "ab" * 32


def card(**more):
    return {"schema": "scorebook.card/1.1", "title": "t", "producer": MAKER, **more}


def test_parts_and_changes(spark):
    from pyspark.sql import functions as F

    rows = [('{"a":1,"b":{"x":[1]},"c":null}', '{"a":1.0,"b":{"x":[1]},"d":2}'), ('{"b":1,"a":2}', None)]
    df = spark.createDataFrame(rows, "now string, before string")
    got = [r["c"] for r in df.select(ingest_records.changed(ingest_records.parts(F.col("now")), ingest_records.parts(F.col("before"))).alias("c")).collect()]
    assert got[1] == ["a", "b"] and set(got[0]) >= {"c", "d"} and "b" not in got[0]


def test_versions_with_all_that_hangs_on_them(spark):
    records = spark.createDataFrame([(1, "eval", "a", "e", "public"), (2, "card", "a", "c", "public"), (3, "card", "a", "d", "private"), (4, "eval", "p", "e", "private")], "record_id long, type string, ns string, name string, visibility string")
    there = [(11, 1, 1, "{}", False), (21, 2, 1, json.dumps(card(title="old"), sort_keys=True, separators=(",", ":")), False), (22, 2, 2, None, True), (41, 4, 1, "{}", False)]
    versions = spark.createDataFrame(there, "version_id long, record_id long, seq long, body string, tombstoned boolean")
    runs = spark.createDataFrame([(1, "r1", "h1", False, False), (1, "r2", "h2", True, False)], "record_id long, run_id string, content_hash string, archived boolean, tombstoned boolean")
    registry = spark.createDataFrame([("metrics", "core", "x", "1"), ("harnesses", "core", "h", "2")], "kind string, ns string, id string, version string")
    ready = spark.createDataFrame([(SHA,)], "sha256 string")
    use = {"type": "core/uses_eval", "to": "a/e@1"}
    batch = [
        (0, 101, 2, card(title="old")),  # as the latest live version says
        (1, 102, 2, card(relations=[use, {"type": "core/x", "to": "external:y"}], run_results=[{"eval": "a/e", "run_id": "r1", "metric": "core/x", "value": 1.0}], results=[{"metric": "core/x", "value": 1, "aggregation": "mean"}], counts={"attempted": 1}, harness={"name": "core/h", "version": "2"}, attachments=[{"path": "f", "sha256": SHA, "size": 1}])),
        (2, 103, 2, card(title=5)),
        (3, 104, 2, card(relations=[use], run_results=[{"eval": "a/e", "run_id": "r2", "metric": "core/x", "label": "no"}])),
        (4, 105, 2, card(attachments=[{"path": "f", "sha256": "cd" * 32, "size": 1}])),
        (0, 106, 3, card(relations=[{"type": "core/uses_eval", "to": "p/e@1"}], redaction={"applied": True})),
        (0, 107, 1, {"schema": "scorebook.eval/2.0", "title": "e", "producer": MAKER, "eval_kind": "run_set", "origin": "live"}),
    ]
    df = spark.createDataFrame([(p, v, r, json.dumps(b)) for p, v, r, b in batch], "position int, version_id long, record_id long, body string")
    done = ingest_records.create_or_append(df, records, versions, runs, registry, ready, ["a"])
    assert {r["version_id"]: r["outcome"] for r in done.outcomes.collect()} == {101: "unchanged", 102: "appended", 103: "refused", 104: "refused", 105: "refused", 106: "created", 107: "appended"}
    assert sorted((r["version_id"], r["path"], r["code"]) for r in done.errors.collect()) == [(103, "/title", "schema"), (104, "/run_results/0/run_id", "run_not_in_used_set"), (105, "/attachments/0/sha256", "attachment_missing")]
    new = {r["version_id"]: r for r in done.versions.collect()}
    assert new[102]["seq"] == 3 and new[102]["changed"] == ["attachments", "counts", "harness", "relations", "results", "run_results", "title"]
    assert new[102]["badges"] == ["refs_resolved", "harness_registered", "metric_registered"] and new[106]["badges"] == ["metric_registered", "redacted"]
    assert new[106]["seq"] == 1 and "schema" in new[106]["changed"] and new[107]["seq"] == 2
    edges = sorted((r["version_id"], r["ordinal"], r["to_version_id"], r["to_external"]) for r in done.relations.collect())
    assert edges == [(102, 0, 11, None), (102, 1, None, "external:y"), (106, 0, None, "p/e@1")]
    assert [(r["version_id"], r["run_id"]) for r in done.used.collect()] == [(102, "r1")] and done.verdicts.count() == 1 and done.results.count() == 1
    assert [tuple(r) for r in done.attachment_refs.collect()] == [(102, "f", SHA)]
    prints = done.fingerprints.groupBy("version_id").count().collect()
    assert {r["version_id"]: r["count"] for r in prints} == {102: 7, 106: 7, 107: 6} and done.audit.count() == 3
