"""Writing runs: inherited facets, hashes, whole batches, one commit."""

from __future__ import annotations

import hashlib
import json

import pytest

from scorebook.functions import canon
from scorebook.operators import run_writes, runs
from scorebook.sources.staged import Staged

BATCH = "record_id string, position int, run_id string, body string"
HEADER = {"model": {"id": "m", "context_window": 8}, "task": None, "harness": {"name": "h", "version": "1"}, "title": "x", "grading": {"threshold": 1}}


@pytest.fixture
def headers(spark):
    return spark.createDataFrame([("e", json.dumps(HEADER)), ("f", "{}"), ("g", None)], "record_id string, header string")


@pytest.fixture
def ready(spark):
    return spark.createDataFrame([("ab" * 32,)], "sha256 string")


@pytest.fixture
def store(spark, tmp_path):
    return Staged(spark, str(tmp_path / "hub"), run_writes.TABLES, "record_id", 3)


def batch(spark, *rows):
    return spark.createDataFrame([(r, p, i, b if isinstance(b, str) or b is None else json.dumps(b)) for r, p, i, b in rows], BATCH)


def ok(run_id, **more):
    return {"run_id": run_id, "status": "ok", **more}


def table(store, name):
    return sorted((tuple(r) for r in store.read(name).collect()), key=str)


def test_materialised():
    assert run_writes.materialised({"task": None}, HEADER) == {"task": None, "model": HEADER["model"], "harness": HEADER["harness"]}
    assert run_writes.materialised({"model": None, "env": {}}, HEADER) == {"model": None, "env": {}, "harness": HEADER["harness"]}
    assert run_writes.materialised([1], HEADER) == [1] and run_writes.materialised({"a": 1}, None) == {"a": 1}
    once = run_writes.materialised({}, HEADER)
    assert run_writes.materialised(once, {"trial": {"k": 1}}) == {**once, "trial": {"k": 1}}


def test_run_hash(spark, headers):
    got = run_writes.run_hash(batch(spark, ("e", 0, "r1", {"status": "ok", "n": 1.0}), ("e", 1, "r1", {"n": 1, "run_id": "other", "status": "ok"}), ("f", 0, "r1", {}), ("g", 0, "x", "{")), headers).collect()
    by = {(r["record_id"], r["position"]): r["content_hash"] for r in got}
    want = {"status": "ok", "n": 1, "run_id": "r1", "model": HEADER["model"], "harness": HEADER["harness"]}
    assert by["e", 0] == by["e", 1] == hashlib.sha256(canon.canonical(want).encode()).hexdigest()
    assert by["f", 0] == hashlib.sha256(b'{"run_id":"r1"}').hexdigest() and by["g", 0] is None


def test_put_and_put_again(spark, store, headers, ready):
    file = {"path": "a", "sha256": "AB" * 32, "size": 1}
    done, refused = run_writes.put_runs(store, batch(spark, ("e", 0, "r1", ok("r1", metrics={"core/x": 1})), ("e", 1, "r2", ok("r2", attachments=[file], started_at="2026-01-01T00:00:00Z")), ("f", 0, "r1", ok("r1"))), headers, ready)
    assert refused.count() == 0 and {(r["record_id"], r["run_id"]): r["change"] for r in done.collect()} == {("e", "r1"): "created", ("e", "r2"): "created", ("f", "r1"): "created"}
    assert table(store, "run_metrics") == [("e", "r1", "core/x", 1.0)] and table(store, "run_attachment_refs") == [("e", "r2", "a", "ab" * 32)]
    prints = {(r["record_id"], r["run_id"], r["facet"]): r["fingerprint"] for r in store.read("run_fingerprints").collect()}
    assert len(prints) == 18 and prints["e", "r1", "model"] == canon.facet_hash(HEADER, "model") and prints["f", "r1", "model"] == canon.facet_hash({}, "model")
    first = {r["run_id"]: r for r in store.read("runs").where("record_id = 'e'").collect()}
    assert str(first["r2"]["started_at"]) == "2026-01-01 00:00:00" and json.loads(first["r1"]["body"])["harness"] == HEADER["harness"]
    pairs = json.dumps([[i, first[i]["content_hash"]] for i in ("r1", "r2")], separators=(",", ":"))
    assert dict(table(store, "run_hashes"))["e"] == hashlib.sha256(pairs.encode()).hexdigest()

    # again: one as it was, one changed (its child rows go), one new; the other record stays as it is
    done, refused = run_writes.put_runs(store, batch(spark, ("e", 0, "r1", ok("r1", metrics={"core/y": 2})), ("e", 1, "r2", ok("r2", started_at="2026-01-01T00:00:00Z", attachments=[file])), ("e", 2, "r3", ok("r3"))), headers, ready)
    assert refused.count() == 0 and {r["run_id"]: r["change"] for r in done.collect()} == {"r1": "updated", "r2": "unchanged", "r3": "created"}
    assert table(store, "run_metrics") == [("e", "r1", "core/y", 2.0)] and len(table(store, "runs")) == 4 and len(table(store, "run_fingerprints")) == 24
    log = table(store, "audit")
    assert sorted((a[0], a[1], a[3], a[5]) for a in log) == [("e", "r1", "run.create", 1), ("e", "r1", "run.update", 2), ("e", "r2", "run.create", 1), ("e", "r3", "run.create", 2), ("f", "r1", "run.create", 1)]


def test_a_failing_element_keeps_its_record_out(spark, store, headers, ready):
    run_writes.put_runs(store, batch(spark, ("e", 0, "gone", ok("gone")), ("f", 0, "r1", ok("r1"))), headers, ready)
    from pyspark.sql import functions as F

    held = store.read("runs").withColumn("tombstoned", F.col("run_id") == "gone")
    store.replace({"runs": store.keep(held)}, [0, 1, 2])
    before = {n: table(store, n) for n in run_writes.TABLES}
    rows = [
        ("e", 0, "r1", ok("r1")), ("e", 1, "r1", ok("r1")), ("e", 2, "gone", ok("gone")), ("e", 3, "r4", {"run_id": "r5", "status": "error"}), ("e", 4, "", ok("")), ("e", 5, "", ok("")),
        ("e", 6, "r6", ok("r6", attachments=[{"path": "a", "sha256": "xyz", "size": 1}, {"path": "b", "sha256": "cd" * 32, "size": 1}])), ("e", 7, "r7", ok("r7", attachments=[{"path": "b", "sha256": "cd" * 32, "size": 1}])), ("e", 8, "r8", "{"), ("e", 9, "r9", None),
        ("g", 0, "r1", ok("r1")),
    ]
    done, refused = run_writes.put_runs(store, batch(spark, *rows), headers, ready)
    assert [(r["record_id"], r["run_id"], r["change"]) for r in done.collect()] == [("g", "r1", "created")]
    got = {}
    for r in refused.orderBy("position", "place").collect():
        got.setdefault(r["position"], []).append((r["path"], r["code"]))
    assert got == {
        1: [("/run_id", "batch_duplicate_run_id")], 2: [("/run_id", "run_deleted")], 3: [("/error", "run_status_detail"), ("/run_id", "run_id_mismatch")], 4: [("/run_id", "run_id_invalid")], 5: [("/run_id", "run_id_invalid")],
        6: [("/attachments/0/sha256", "schema")], 7: [("/attachments/0/sha256", "attachment_missing")], 8: [("", "schema")], 9: [("", "schema")],
    }
    after = {n: table(store, n) for n in run_writes.TABLES}
    assert [x for x in after["runs"] if x[0] != "g"] == before["runs"] and [x for x in after["audit"] if x[0] != "g"] == before["audit"]


def test_a_failure_before_the_commit_leaves_the_tables_as_they_were(spark, store, headers, ready, monkeypatch):
    run_writes.put_runs(store, batch(spark, ("e", 0, "r1", ok("r1", metrics={"core/x": 1}))), headers, ready)
    before, number = {n: table(store, n) for n in run_writes.TABLES}, store.manifest()[0]
    second = batch(spark, ("e", 0, "r1", ok("r1", metrics={"core/x": 5})), ("f", 0, "r2", ok("r2")))

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Staged, "_commit", lost)
        with pytest.raises(RuntimeError, match="lost"):
            run_writes.put_runs(store, second, headers, ready)
    assert {n: table(store, n) for n in run_writes.TABLES} == before and store.manifest()[0] == number
    done, _ = run_writes.put_runs(store, second, headers, ready)
    assert {(r["record_id"], r["change"]) for r in done.collect()} == {("e", "updated"), ("f", "created")}
    assert table(store, "run_metrics") == [("e", "r1", "core/x", 5.0)] and len(table(store, "audit")) == 3


def test_an_empty_batch(spark, store, headers, ready):
    done, refused = run_writes.put_runs(store, spark.createDataFrame([], BATCH), headers, ready)
    assert done.count() == 0 and refused.count() == 0 and table(store, "runs") == []


def test_set_hashes(spark):
    rows = [("a", "b", "h1"), ("a", "é", "h2"), ("a", 'q"', "h3"), ("a", "\U0001f600", "h4"), ("b", None, "h"), (None, "x", "h5")] + [("big", f"{i:06d}", f"h{i}") for i in range(30_000)]
    df = spark.createDataFrame(rows, "record_id string, run_id string, content_hash string").repartition(5)
    got = {r["record_id"]: r["runs_hash"] for r in runs.runs_hash(df).collect()}
    want = {}
    for key in ("a", "big", None):
        own = sorted(([i, h] for k, i, h in rows if k == key and i is not None), key=lambda x: x[0].encode())
        want[key] = hashlib.sha256(json.dumps(own, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    assert got == want


def test_prepared_runs_leave_in_small_batches():
    import pyarrow as pa

    n = 3 * run_writes.RUNS + 5
    names = ["record_id", "position", "run_id", "body", "header"]
    one = pa.RecordBatch.from_pydict(dict(zip(names, [["r"] * n, list(range(n)), [str(i) for i in range(n)], ['{"metrics":{"a":1}}', "no JSON"] * (n // 2) + ["{}"] * (n % 2), ['{"model":{"id":"m"}}'] * n])))
    made = list(run_writes.prepare(iter([one, one.slice(0, 0)])))
    assert [b.num_rows for b in made] == [run_writes.RUNS] * 3 + [5]
    assert pa.Table.from_batches(made)["position"].to_pylist() == list(range(n))
