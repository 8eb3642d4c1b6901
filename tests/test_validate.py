"""Validation: bodies and the errors they get."""

from __future__ import annotations

import json

import pytest

from scorebook.functions import walk
from scorebook.operators import validate

SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
MAKER = {"name": "h", "version": "1"}


def card(**more) -> dict:
    return {"schema": "scorebook.card/1.1", "title": "t", "producer": MAKER, **more}


def eval_(**more) -> dict:
    return {"schema": "scorebook.eval/2.0", "title": "t", "producer": MAKER, "eval_kind": "run_set", "origin": "live", **more}


def run(status="ok", **more) -> dict:
    return {"run_id": "r1", "status": status, **more}


def result(metric="core/pass_rate", **more) -> dict:
    return {"metric": metric, "value": 0.5, "aggregation": "mean", **more}


def files(*paths) -> list[dict]:
    return [{"path": p, "sha256": SHA, "size": 1} for p in paths]


def judged(eval_name="alice/k4", **more) -> dict:
    return {"eval": eval_name, "run_id": "r1", "metric": "core/pass", **more}


USES = {"type": "core/uses_eval", "to": "alice/k4@3", "attrs": {"runs": ["r1"]}}
FULL = card(
    model={"id": "m", "engine": {"name": "e"}, "quantization": {"method": "q", "dtype": None}, "context_window": 8, "ext": {"alice/x": {"deep": [1, {"ext": {"NOT": 1}}]}}},
    task={"id": "t", "n": 33, "seed": -1, "shuffled": False}, harness={"name": "h", "version": "1", "few_shot": 0}, generation={"temperature": 0, "stop": ["a"], "reasoning": {"effort": "high"}},
    trial={"k": 4.0, "sandbox": {"image": "i"}}, grading={"graders": [{"name": "g", "kind": None}], "judge": None}, env={"git": {"commit": "c", "dirty": False}, "packages": [{"name": "p", "version": "1"}], "hardware": {"memory_gb": 1.5}},
    results=[result(n=2, by={"any": 1}, samples_ref="s.jsonl", uncertainty={"stderr": 0.1, "ci": {"level": 0.9, "low": 0, "high": 1}})], counts={"attempted": 2, "completed": 1, "failed": 1},
    run_results=[judged(label="pass", **{"from": ["x"]}), judged(value=0)], relations=[USES, {"type": "core/x", "to": "hf:o/r@s", "attrs": None}], attachments=files("s.jsonl"), redaction={"applied": True, "fields": ["a"]},
    provenance={"source_type": "paper", "evaluator_relationship": None}, ext={"alice/x": 1},
)
CASES = {
    "accepted card": ("card", FULL, []),
    "accepted eval": ("eval", eval_(task={"id": "t"}, relations=[{"type": "core/subset_of", "to": "alice/full@1"}], attachments=files("tasks.jsonl"), redaction={"applied": False}), []),
    "accepted run": ("run", run(started_at="2026-09-20T10:00:00Z", ended_at="2026-09-20t10:02:11.5+02:00", calls="c", artifacts=["a"], attachments=files("c", "a"), metrics={"core/ms": 1}, ext={"a/b": {}}, meta={"w": [1]}), []),
    "paths and references": ("card", card(results=[result(samples_ref="s"), result(samples_ref="missing")], counts={"attempted": 1}, attachments=files("s", "s", "/abs", "a/../b", "")),
                             [("/attachments/1/path", "attachment_path_invalid"), ("/attachments/2/path", "attachment_path_invalid"), ("/attachments/3/path", "attachment_path_invalid"), ("/attachments/4/path", "attachment_path_invalid"), ("/results/1/samples_ref", "attachment_ref_unknown")]),
    "eleven of a path": ("card", card(attachments=files(*["p"] * 11)), [(f"/attachments/{i}/path", "attachment_path_invalid") for i in (1, 10, *range(2, 10))]),
    "a reference to a bad path": ("card", card(results=[result(samples_ref="/abs")], counts={"attempted": 1}, attachments=files("/abs")), [("/attachments/0/path", "attachment_path_invalid"), ("/results/0/samples_ref", "attachment_ref_unknown")]),
    "evals not used": ("card", card(run_results=[judged(label="x"), judged("alice/k4@3", label="x"), judged("alice/other", label="x"), judged("external:y", label="x")], relations=[USES, {"type": "core/uses_eval", "to": "external:y"}, {"type": "core/derived_from", "to": "alice/other@1"}]),
                       [("/run_results/1/eval", "run_results_eval_unknown"), ("/run_results/2/eval", "run_results_eval_unknown"), ("/run_results/3/eval", "run_results_eval_unknown")]),
    "judgement's metric": ("card", card(run_results=[judged(label="x", metric="pass")], relations=[USES]), [("/run_results/0/metric", "metric_id_invalid")]),
    "neither value nor label": ("card", card(run_results=[judged(), judged(value=None, label=None), judged(value=None, label="x")], relations=[USES]), [("/run_results/0", "run_result_value_or_label"), ("/run_results/1", "run_result_value_or_label")]),
    "counts too small": ("card", card(results=[result()], counts={"attempted": 3, "completed": 2, "failed": 1, "errored": 1}), [("/counts", "counts_inconsistent")]),
    "counts too small, empty results": ("card", card(results=[], counts={"attempted": 0, "skipped": 1}), [("/counts", "counts_inconsistent")]),
    "counts without results": ("card", card(counts={"attempted": 0, "skipped": 1}), []),
    "no counts": ("card", card(results=[result()], counts=None), [("/counts", "counts_missing")]),
    "runs in a header": ("eval", eval_(runs=[{"run_id": "r1"}], nonsense=1), [("/runs", "runs_moved")]),
    "runs null in a header": ("eval", eval_(runs=None), [("/runs", "runs_moved")]),
    "an old eval": ("eval", {"schema": "scorebook.eval/1.0", "bad": 1}, [("/runs", "runs_moved")]),
    "unknown schema": ("eval", {**eval_(), "schema": "scorebook.eval/3.0"}, [("/schema", "schema")]),
    "no schema": ("eval", {k: v for k, v in eval_().items() if k != "schema"}, [("", "schema")]),
    "ext keys": ("card", card(ext={"foobar": 1, "notes": {}, "a/b": {"C": 1}}, grading={"ext": {"bad": 1}}), [("/ext/foobar", "ext_key_invalid"), ("/ext/notes", "ext_key_invalid"), ("/grading/ext/bad", "ext_key_invalid")]),
    "ext keys of facets": ("eval", eval_(env={"ext": {"xy": 1}}, model={"id": "m", "ext": {"bad": 1, "a/b": 2}}), [("/env/ext/xy", "ext_key_invalid"), ("/model/ext/bad", "ext_key_invalid")]),
    "metric and relations": ("card", card(results=[result("pass_rate")], counts={"attempted": 1}, relations=[USES, {"type": "uses_eval", "to": "alice/k4"}, {"type": "core/uses_eval", "to": "external:"}, {"type": "core/uses_eval", "to": "hf:o/r@s"}, {"type": "core/uses_eval", "to": "alice/x@0"}]),
                             [("/relations/1/to", "schema"), ("/relations/1/type", "schema"), ("/relations/2/to", "schema"), ("/relations/4/to", "schema"), ("/results/0/metric", "metric_id_invalid")]),
    "missing keys": ("card", {"schema": "scorebook.card/1.0", "producer": {"name": "h"}}, [("", "schema"), ("/producer", "schema")]),
    "two missing keys": ("card", {"schema": "scorebook.card/1.0"}, [("", "schema"), ("", "schema")]),
    "large numbers": ("card", card(task={"id": "t", "n": 9007199254740993}, ext={"alice/x": {"big": -9007199254740993, "float": 9007199254740992.5, "ok": 9007199254740992, "e": [1e300]}}), [("/ext/alice~1x/big", "number_too_large"), ("/ext/alice~1x/e/0", "number_too_large"), ("/task/n", "number_too_large")]),
    "unknown keys": ("card", card(surprise=True, more=1, model={"id": "m", "surprise": 1}), [("", "schema"), ("/model", "schema")]),
    "faults within a facet count once": ("card", card(model={"id": 5, "engine": {"x": 1}, "context_window": -1}, env={"git": {}, "packages": [{"name": "p"}, 7]}), [("/env", "schema"), ("/model", "schema")]),
    "wrong kinds": ("card", card(title=5, results={"a": 1}, relations=[5, {"type": "a/b", "to": 5}], attachments=[{"path": "p", "sha256": SHA, "size": -1}, {"path": "q", "sha256": SHA, "size": 1.5}], ext=[1]),
                    [("/attachments/0/size", "schema"), ("/attachments/1/size", "schema"), ("/ext", "schema"), ("/relations/0", "schema"), ("/relations/1/to", "schema"), ("/results", "schema"), ("/title", "schema")]),
    "enums": ("card", card(results=[result(aggregation="mode")], counts={"attempted": 1}, provenance={"source_type": "x"}), [("/provenance", "schema"), ("/results/0/aggregation", "schema")]),
    "times": ("run", run(started_at="2026-09-20 10:00:00Z", ended_at="soon"), [("/ended_at", "schema"), ("/started_at", "schema")]),
    "run's ext": ("run", run(ext={"Core/x": 1, "notes": 1, "a/b": 1}), [("/ext/Core~1x", "ext_key_invalid"), ("/ext/notes", "ext_key_invalid")]),
    "run's metrics": ("run", run(metrics={"Core/x": 1, "a/b/c": 1, "tokens": 1, "a/b": "x"}), [("/metrics/Core~1x", "metric_id_invalid"), ("/metrics/a~1b", "schema"), ("/metrics/a~1b~1c", "metric_id_invalid"), ("/metrics/tokens", "metric_id_invalid")]),
    "run's paths": ("run", run(attachments=files("a", "a", "/b", "..", "")), [(f"/attachments/{i}/path", "attachment_path_invalid") for i in (1, 2, 3, 4)]),
    "run's references": ("run", run("error", error={"kind": "crash", "log": "l"}, calls="nope", artifacts=["ok", "missing"], attachments=files("ok")), [("/artifacts/1", "attachment_ref_unknown"), ("/calls", "attachment_ref_unknown"), ("/error/log", "attachment_ref_unknown")]),
    "error without detail": ("run", run("error", skip_reason="x"), [("/error", "run_status_detail"), ("/skip_reason", "run_status_detail")]),
    "error null": ("run", run("error", error=None), [("/error", "run_status_detail")]),
    "ok with detail": ("run", run(error={"kind": "x"}, skip_reason="y"), [("/error", "run_status_detail"), ("/skip_reason", "run_status_detail")]),
    "skipped without reason": ("run", run("skipped"), [("/skip_reason", "run_status_detail")]),
    "skipped with error": ("run", run("skipped", skip_reason="x", error={"kind": "x"}), [("/error", "run_status_detail")]),
    "skipped null": ("run", run("skipped", skip_reason=None), [("/skip_reason", "run_status_detail")]),
    "skipped well": ("run", run("skipped", skip_reason="x", error=None), []),
    "unknown status": ("run", run("gone", error={"kind": "x"}), [("/status", "schema")]),
    "other id": ("run", {**run(), "run_id": "r2"}, [("/run_id", "run_id_mismatch")]),
    "not an object": ("card", [1, {"surprise": 2}], [("", "schema")]),
    "a number": ("run", 5, [("", "schema")]),
}
RAW = {"not json": ("card", "{", [("", "schema")]), "null": ("card", None, [("", "schema")]), "deep": ("card", "[" * 100_000, [("", "schema")]), "empty": ("run", "", [("", "schema")])}
RUN_IDS = {"": [("/run_id", "run_id_invalid")], "a/b": [("/run_id", "run_id_invalid")], "é" * 100: [], "é" * 100 + "x": [("/run_id", "run_id_invalid")], None: [("/run_id", "run_id_invalid")]}


@pytest.fixture(scope="module")
def found(spark):
    """All cases in one job: a body's errors do not depend on its neighbours."""
    rows = [(n, k, "r1" if k == "run" else None, json.dumps(b)) for n, (k, b, _) in CASES.items()] + [(n, k, "r1" if k == "run" else None, b) for n, (k, b, _) in RAW.items()]
    rows += [(f"id {i}", "run", i, json.dumps({"run_id": i, "status": "ok"} if i is not None else {"run_id": "", "status": "ok"})) for i in RUN_IDS]
    df = spark.createDataFrame(rows, "id string, body_kind string, run_id string, body string").repartition(3)
    return {r["id"]: [tuple(e) for e in r["errors"]] for r in validate.errors(df).collect()}


@pytest.mark.parametrize("name", [*CASES, *RAW])
def test_errors(found, name):
    assert found[name] == {**CASES, **RAW}[name][2]


@pytest.mark.parametrize("run_id", list(RUN_IDS))
def test_run_ids(found, run_id):
    assert found[f"id {run_id}"] == RUN_IDS[run_id]


def test_places_of_other_kinds(spark):
    """A key that only other kinds of bodies have is unknown, and its ext keys are looked at all the same."""
    body = run(grading={"ext": {"Bad": 2**53 + 1}}, meta={"ext": {"Bad": [1]}}, artifacts={"*": "c"})
    df = spark.createDataFrame([("a", "run", "r1", json.dumps(body)), ("b", "other", None, '{"attachments": [{"path": "/a"}]}')], "id string, body_kind string, run_id string, body string")
    found = {r["id"]: [tuple(e) for e in r["errors"]] for r in validate.errors(df).collect()}
    own = [("", "schema"), ("/artifacts", "schema"), ("/artifacts/*", "attachment_ref_unknown"), ("/grading/ext/Bad", "number_too_large"), ("/grading/ext/Bad", "ext_key_invalid")]
    assert found == {"a": own, "b": [("/attachments/0/path", "attachment_path_invalid")]}


def test_no_bodies(spark):
    assert validate.errors(spark.createDataFrame([], "id string, body_kind string, run_id string, body string")).count() == 0


def test_walk(spark):
    body = '{"a": [1, {"b/c": null}], "~": true, "n": 12345678901234567890, "f": 2.0}'
    df = spark.createDataFrame([(7, body)], "id long, body string")
    rows = {r["pointer"]: r for r in walk.nodes(df).collect()}
    assert set(rows) == {"", "/a", "/a/0", "/a/1", "/a/1/b~1c", "/~0", "/n", "/f"}
    assert rows["/a/1/b~1c"]["shape"] == "/a/*/b~1c" and rows["/a/1/b~1c"]["kind"] == "null" and rows["/a/1/b~1c"]["key"] == "b/c" and rows["/a/1/b~1c"]["id"] == 7
    assert rows[""]["keys"] == ["a", "~", "n", "f"] and rows[""]["sizes"] == {"a": 2} and rows["/f"]["whole"] and rows["/n"]["number"] == 12345678901234567890.0
    assert rows["/a/1"]["given"] == [] and rows["/a/1"]["keys"] == ["b/c"] and not rows["/a/0"]["in_object"]


def test_codes_cover_the_rules():
    assert len(set(validate.CODES)) == len(validate.CODES) == 28
