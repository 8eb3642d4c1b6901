"""The migration of evals whose runs are in their bodies."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from scorebook.functions import canon
from scorebook.operators import migrate, validate
from scorebook.sources.staged import Staged

SHA = "ab" * 32


def old(*runs, **more):
    return {"schema": validate.OLD_EVAL, "title": "t", "runs": list(runs), **more}


def run(run_id, outcome="pass", **more):
    return {"run_id": run_id, "outcome": outcome, **more}


@pytest.fixture
def store(spark, tmp_path):
    return Staged(spark, str(tmp_path / "hub"), migrate.TABLES, "record_id", 3)


def fill(spark, store, *versions):
    rows = [(str(r), v, t, seq, b if b is None or isinstance(b, str) else json.dumps(b), f"h{v}", dead) for r, v, t, seq, b, dead in versions]
    store.replace({"versions": spark.createDataFrame(rows, migrate.TABLES["versions"])}, [0, 1, 2])


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, None if n is None else json.dumps(n)) for a, b, n in rows], "version_id long, to_version_id long, attrs string")


def everything(store):
    return {n: sorted((tuple(r) for r in store.read(n).collect()), key=str) for n in migrate.TABLES}


def test_converted():
    header = {"model": {"id": "m"}, "task": None, "attachments": [{"path": "a", "sha256": "1"}, {"path": "b", "sha256": "2"}, {"path": "a", "sha256": "3"}, {"path": "c", "sha256": "4"}]}
    got = migrate.converted("r", {"run_id": "r", "outcome": "skipped", "calls": "c", "artifacts": ["a", 5], "started_at": "s", "extra": 1}, header)
    assert got == {
        "run_id": "r", "status": "skipped", "skip_reason": "unrecorded", "started_at": "s", "calls": "c", "artifacts": ["a", 5], "attachments": [{"path": "a", "sha256": "1"}, {"path": "c", "sha256": "4"}],
        "meta": {migrate.KEPT_KEY: {"outcome": "skipped"}}, "model": {"id": "m"},
    }
    assert migrate.converted("r", {}, {}) == {"run_id": "r", "status": "error", "error": {"kind": "unrecorded"}}
    assert migrate.converted("r", {"outcome": "fail"}, {})["status"] == "ok" and migrate.converted("r", {"outcome": None}, {})["meta"] == {migrate.KEPT_KEY: {"outcome": None}}


def test_migrated_once(spark, store):
    fill(
        spark, store,
        (1, 11, "eval", 1, old(run("r1"), run("r2", "fail"), run("r1", "skipped"), model={"id": "m1"}), False), (1, 12, "eval", 2, old(run("r1"), run("r3", "error"), model={"id": "m2"}), False),
        (1, 13, "eval", 3, {"schema": "scorebook.eval/2.0", "title": "new"}, False), (1, 14, "eval", 4, None, True), (2, 21, "card", 1, {"schema": "scorebook.card/1.1"}, False), (3, 31, "eval", 1, old(), False), (4, 41, "card", 1, old(run("x")), False),
    )
    uses = edges(spark, (21, 11, None), (21, 13, None), (22, 11, {"runs": ["r1", "r3", "no"]}), (22, 12, None), (23, 14, None), (24, 13, {"runs": ["r2"]}), (25, 31, None))
    assert migrate.migrate(store, uses).ran
    rows = {r["run_id"]: r for r in store.read("runs").collect()}
    assert {k: (r["record_id"], r["status"]) for k, r in rows.items()} == {"r1": ("1", "ok"), "r2": ("1", "ok"), "r3": ("1", "error")}
    own = lambda i, seq, outcome, **more: canon.digest(canon.canonical({"run_id": i, "model": {"id": f"m{seq}"}, "meta": {migrate.KEPT_KEY: {"outcome": outcome}}, **more}))
    assert rows["r1"]["content_hash"] == own("r1", 2, "pass", status="ok")
    now = {r["version_id"]: r for r in store.read("versions").collect()}
    assert json.loads(now[11]["body"]) == {"schema": "scorebook.eval/2.0", "title": "t", "model": {"id": "m1"}} and now[11]["content_hash"] == canon.digest(now[11]["body"])
    assert json.loads(now[41]["body"])["runs"] and now[13]["content_hash"] == "h13" and now[14]["body"] is None and "runs" not in json.loads(now[31]["body"])
    first = own("r1", 1, "skipped", status="skipped", skip_reason="unrecorded")
    used = {(r["version_id"], r["run_id"]): r["content_hash"] for r in store.read("used").collect()}
    # a card has the hashes of the version it points at, of two the higher one; a named run of no such version has its row's
    assert used == {(21, "r1"): first, (21, "r2"): own("r2", 1, "fail", status="ok"), (22, "r1"): rows["r1"]["content_hash"], (22, "r3"): rows["r3"]["content_hash"], (24, "r2"): rows["r2"]["content_hash"]}
    log = {(r["version_id"], r["action"]) for r in store.read("log").collect()}
    assert log == {(11, "migration.runs_split"), (12, "migration.runs_split"), (31, "migration.runs_split")}
    before = everything(store)
    assert not migrate.migrate(store, uses).ran and everything(store) == before


def test_unmatched_names_are_logged(spark, store):
    fill(spark, store, (1, 11, "eval", 1, old(run("r1")), False), (2, 21, "card", 1, {}, False))
    assert migrate.migrate(store, edges(spark, (21, 11, {"runs": ["b", "r1", "a"]}))).ran
    assert [(r["record_id"], r["version_id"], r["detail"]) for r in store.read("log").where("action like '%unmatched'").collect()] == [("2", 21, "1 a b")]


@pytest.mark.parametrize("bad", [{"run_id": "a/b"}, {"run_id": ""}, {"run_id": "é" * 101}, {}, "text", {"run_id": "ok", "calls": "f"}])
def test_one_bad_run_refuses_all(spark, store, bad):
    files = [{"path": "f", "sha256": "short", "size": 1}]
    fill(spark, store, (1, 11, "eval", 1, old(run("r1"), bad, attachments=files), False), (2, 12, "eval", 1, old(run("r1")), False))
    before = everything(store)
    done = migrate.migrate(store, edges(spark))
    assert not done.ran and [r["version_id"] for r in done.problems.collect()] == [11]
    assert everything(store) == before


def test_nothing_to_migrate(spark, store):
    fill(spark, store, (1, 11, "card", 1, {"schema": "x"}, False), (2, 12, "eval", 1, "[1]", False))
    assert migrate.migrate(store, edges(spark)).ran and store.read("runs").count() == 0
    assert store.read("versions").where(F.col("content_hash").isin("h11", "h12")).count() == 2
