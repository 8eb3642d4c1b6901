"""Used sets, judgements, and cards that requests name."""

from __future__ import annotations

import json

import pytest

from scorebook.operators import registry_ops, used_sets

EDGE = "version_id long, ordinal int, type string, ns string, name string, eval_record_id long, attrs string"
VERDICT = "version_id long, ordinal int, eval string, run_id string, metric string, value double"


@pytest.fixture(scope="module")
def runs(spark):
    rows = [(10, "r1", "h1", False, False), (10, "r2", "h2", True, False), (10, "r3", "h3", False, True), (10, "r4", "h4", False, False), (11, "r1", "g1", False, False)]
    return spark.createDataFrame(rows, "record_id long, run_id string, content_hash string, archived boolean, tombstoned boolean")


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame([(10, "a", "public"), (11, "b", "private"), (12, "a", "private")], "record_id long, ns string, visibility string")


def edge(version, ordinal, record, attrs=None, name="e", type_="core/uses_eval"):
    return version, ordinal, type_, "a", name, record, attrs if attrs is None or isinstance(attrs, str) else json.dumps(attrs)


def fixed(spark, runs, records, edges, verdicts=(), writer=()):
    done = used_sets.fix(spark.createDataFrame(edges, EDGE), spark.createDataFrame(list(verdicts), VERDICT), runs, records, list(writer))
    used = sorted((r["version_id"], r["eval_record_id"], r["run_id"], r["content_hash"]) for r in done.used.collect())
    errors = [(r["version_id"], r["path"], r["code"]) for r in done.errors.orderBy("version_id", "place").collect()]
    return used, sorted(tuple(r) for r in done.verdicts.collect()), errors


def test_sets(spark, runs, records):
    edges = [
        edge(1, 0, 10), edge(1, 1, 10, {"other": 1}), edge(2, 0, 10, {"runs": ["r1", "r2"]}), edge(2, 1, 10, {"runs": ["r2", "r3"]}), edge(2, 2, 10), edge(3, 0, 10, {"runs": []}), edge(4, 0, 10, {"runs": "r1"}),
        edge(5, 0, None), edge(5, 1, 10, type_="core/compares"), edge(6, 0, 11), edge(7, 0, 11, "not json"),
    ]
    used, _, errors = fixed(spark, runs, records, edges)
    assert used == [(1, 10, "r1", "h1"), (1, 10, "r4", "h4"), (2, 10, "r1", "h1"), (2, 10, "r2", "h2"), (2, 10, "r3", "h3"), (4, 10, "r1", "h1"), (4, 10, "r4", "h4")]
    assert errors == []
    used, _, _ = fixed(spark, runs, records, edges, writer=["b"])
    assert (6, 11, "r1", "g1") in used and (7, 11, "r1", "g1") in used


def test_unknown_runs(spark, runs, records):
    edges = [edge(1, 0, 10, {"runs": ["r1", "x", 5]}), edge(1, 3, 10, {"runs": ["r2", None]}), edge(2, 0, 10)]
    used, verdicts, errors = fixed(spark, runs, records, edges, [(2, 0, "a/e", "r1", "core/x", 1.0)])
    assert errors == [(1, "/relations/0/attrs/runs/1", "run_unknown"), (1, "/relations/0/attrs/runs/2", "run_unknown"), (1, "/relations/3/attrs/runs/1", "run_unknown")]
    assert {u[0] for u in used} == {2} and verdicts == [(2, 0, 10, "r1", "core/x", 1.0)]


def test_judgements(spark, runs, records):
    edges = [edge(1, 0, 10, {"runs": ["r1"]}), edge(2, 0, 10), edge(3, 0, 11), edge(4, 0, 10, {"runs": ["r3"]})]
    verdicts = [
        (1, 0, "a/e", "r1", "core/x", 1.0), (1, 1, "a/e", "r2", "core/x", None), (1, 2, "a/e", "nope", "core/x", 1.0), (1, 10, "a/other", "r1", "core/x", 1.0), (2, 0, "a/e", "r4", "core/x", None),
        (2, 1, None, "r9", "core/x", 1.0), (2, 2, "a/e", "r1", None, 1.0), (3, 0, "a/e", "r1", "core/x", 1.0), (4, 0, "a/e", "r3", "core/x", 0.0), (4, 0, "a/e", "r3", "core/x", 0.0),
    ]
    used, rows, errors = fixed(spark, runs, records, edges, verdicts)
    assert errors == [(1, "/run_results/1/run_id", "run_not_in_used_set"), (1, "/run_results/10/run_id", "run_unknown"), (1, "/run_results/2/run_id", "run_unknown"), (3, "/run_results/0/run_id", "run_unknown")]
    assert rows == [(2, 0, 10, "r4", "core/x", None), (4, 0, 10, "r3", "core/x", 0.0), (4, 0, 10, "r3", "core/x", 0.0)]
    assert {u[0] for u in used} == {2, 4}
    assert fixed(spark, runs, records, []) == ([], [], [])


def test_card_lookup(spark):
    records = spark.createDataFrame([(1, "card", "a", "x", "public"), (2, "card", "a", "y", "private"), (3, "card", "a", "z", "public"), (4, "eval", "a", "x", "public"), (5, "card", "a", "w", "public")], "record_id long, type string, ns string, name string, visibility string")
    versions = spark.createDataFrame([(11, 1, 1, False), (12, 1, 2, True), (21, 2, 1, False), (31, 3, 1, False), (32, 3, 2, False), (41, 4, 1, False), (51, 5, 1, True)], "version_id long, record_id long, seq int, tombstoned boolean")
    edges = spark.createDataFrame([(11, "core/uses_eval", 41), (21, "core/uses_eval", 41), (31, "core/uses_eval", 41), (32, "core/compares", 41), (51, "core/uses_eval", 41), (11, "core/uses_eval", None)], "from_version_id long, type string, to_version_id long")
    asked = [(1, 0, "a", "x"), (2, 0, "a", "x"), (2, 1, "a", "y"), (3, 0, "a", "z"), (4, 0, "a", "w"), (5, 0, "no", "x"), (5, 1, "a", "x"), (6, 0, "a", "x"), (6, 1, "a", "x")]
    requests = spark.createDataFrame([(*r, 4) for r in asked], "request int, position int, ns string, name string, eval_record_id long")
    found, unknown = used_sets.card_lookup(requests, records, versions, edges, [])
    assert sorted((r["request"], r["position"], r["version_id"], r["seq"]) for r in found.collect()) == [(1, 0, 11, 1), (6, 0, 11, 1), (6, 1, 11, 1)]
    assert sorted((r["request"], r["name"]) for r in unknown.collect()) == [(2, "y"), (3, "z"), (4, "w"), (5, "x")]
    found, unknown = used_sets.card_lookup(requests, records, versions, edges, ["a"])
    assert {r["request"] for r in found.collect()} == {1, 2, 6}


@pytest.mark.parametrize(("text", "want"), [("n", ("latest", "n", None)), ("n@12", ("seq", "n", 12)), ("n@v1", ("label", "n", "v1")), ("n@", ("label", "n", "")), ("n@1@2", ("label", "n", "1@2"))])
def test_address(text, want):
    assert registry_ops.address(text) == want


def test_lookup(spark):
    records = spark.createDataFrame([(1, "card", "a", "n", "public"), (2, "card", "b", "n", "private")], "record_id long, type string, ns string, name string, visibility string")
    versions = spark.createDataFrame([(11, 1, 1, "old", False), (12, 1, 2, None, False), (13, 1, 3, "bad", True), (21, 2, 1, None, False)], "version_id long, record_id long, seq int, label string, tombstoned boolean")
    asked = spark.createDataFrame([("card", "a", x) for x in ("n", "n@1", "n@3", "n@old", "n@bad", "n@9", "n@", "m", "n@99999999999999")] + [("card", "b", "n"), ("eval", "a", "n")], "type string, ns string, address string")
    got = {(r["ns"], r["address"]): (r["version_id"], r["tombstoned"]) for r in registry_ops.lookup(asked, records, versions, []).collect()}
    assert got == {("a", "n"): (12, False), ("a", "n@1"): (11, False), ("a", "n@3"): (13, True), ("a", "n@old"): (11, False), ("a", "n@bad"): (13, True)}
    assert registry_ops.lookup(asked, records, versions, ["b"]).count() == 6


def test_registry(spark):
    kinds = "kind string, ns string, id string, version string, state string"
    registry = spark.createDataFrame([("metrics", "core", "x", "1", "applied"), ("metrics", "a", "y", "1", "applied")], kinds)
    new = spark.createDataFrame([(0, "metrics", "a", "y", "1"), (1, "metrics", "a", "y", "2"), (2, "metrics", "a", "y", "2"), (3, "ext_schemas", "a", "s", "1"), (4, "metrics", "core", "z", "1")], "position int, kind string, ns string, id string, version string")
    now, refused = registry_ops.put_entries(registry, new)
    assert sorted((r["id"], r["version"], r["state"]) for r in now.collect()) == [("s", "1", "applying"), ("x", "1", "applied"), ("y", "1", "applied"), ("y", "2", "applied")]
    assert sorted((r["position"], r["code"]) for r in refused.collect()) == [(0, "registry_entry_exists"), (2, "registry_entry_exists"), (4, "core_read_only")]
    flipped = registry_ops.set_state(now, spark.createDataFrame([("ext_schemas", "a", "s", "1", "applied"), ("metrics", "no", "x", "1", "applied")], kinds))
    assert sorted(r["state"] for r in flipped.collect()) == ["applied"] * 4
    assert [r["id"] for r in registry_ops.listed(flipped, limit=2, offset=1).collect()] == ["y", "y"] and registry_ops.listed(flipped, "metrics", "a", 0).count() == 1


def test_objects(spark):
    kinds = "sha256 string, size long, media_type string, state string, hashed boolean, created_at long"
    objects = spark.createDataFrame([("a", 1, "t", "ready", True, 1), ("b", 2, None, "pending", False, 1), ("c", 3, "u", "pending", False, 1)], kinds)
    uploads = spark.createDataFrame([(0, "a", 9, "z", 5), (1, "b", 7, "v", 5), (2, "b", 8, None, 6), (3, "d", 4, None, 5), (4, "c", 5, None, 5)], "position int, sha256 string, size long, media_type string, created_at long")
    now = registry_ops.announce(objects, uploads)
    assert sorted(tuple(r) for r in now.collect()) == [("a", 1, "t", "ready", True, 1), ("b", 8, "v", "pending", False, 1), ("c", 5, "u", "pending", False, 1), ("d", 4, None, "pending", False, 5)]
    stored = spark.createDataFrame([("b", 8, "b"), ("c", 6, "c"), ("d", 4, "x"), ("e", 1, "e")], "sha256 string, actual long, digest string")
    done, refused = registry_ops.complete(now, stored, 100)
    assert {r["sha256"]: (r["state"], r["hashed"]) for r in done.collect()} == {"a": ("ready", True), "b": ("ready", True), "c": ("pending", False), "d": ("pending", False)}
    assert {r["sha256"]: r["code"] for r in refused.collect()} == {"c": "object_size_mismatch", "d": "object_hash_mismatch", "e": "attachment_unknown"}
    done, refused = registry_ops.complete(now, stored, 3)
    assert {r["sha256"]: (r["state"], r["hashed"]) for r in done.collect()}["d"] == ("ready", False)


def test_a_reference_between_the_phases_keeps_its_object(spark):
    from pyspark.sql import functions as F

    from scorebook.operators import derive

    objects = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("new", 9)], "sha256 string, created_at long")
    refs, run_refs = spark.createDataFrame([("a",)], "sha256 string"), spark.createDataFrame([], "sha256 string")
    marked = derive.unreferenced(objects, "created_at", F.lit(5), refs, run_refs)
    assert sorted(r["sha256"] for r in marked.collect()) == ["b", "c"]
    later = spark.createDataFrame([("b",), (None,)], "sha256 string")
    assert sorted(r["sha256"] for r in registry_ops.sweep(objects, marked, refs, later).collect()) == ["a", "b", "new"]
