"""Relations as a reader may see them, and bodies without what is hidden."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from scorebook.operators import filters, relations
from scorebook.plans import relation_queries

TARGET = "version_id long, type string, ns string, name string, seq long, visibility string, tombstoned boolean, content_hash string, address string"


@pytest.fixture(scope="module")
def targets(spark):
    made = [
        (1, "card", "alice", "a", 1, "private", False), (2, "card", "alice", "b", 1, "private", False), (3, "card", "alice", "c", 1, "private", True),
        (4, "card", "bob", "hidden", 1, "private", False), (5, "card", "bob", "open", 1, "public", False), (6, "eval", "bob", "open", 1, "public", False),
        (7, "eval", "bob", "twin", 2, "private", False), (8, "card", "bob", "twin", 2, "public", False),
    ]
    return spark.createDataFrame([(*m, f"h{m[0]}", f"{m[2]}/{m[3]}@{m[4]}") for m in made], TARGET)


@pytest.fixture(scope="module")
def edges(spark):
    made = [
        (1, 0, "core/uses_eval", None, "alice/single2-k4@3"), (1, 1, "core/compares", 4, None), (1, 2, "core/uses_eval", 5, None),
        (2, 0, "core/compares", 4, None), (3, 0, "core/uses_eval", 99, None), (3, 1, "core/uses_eval", None, None),
        (4, 0, "core/uses_eval", None, "bob/open@01"), (5, 0, "core/derived_from", None, "bob/hidden@1"), (5, 1, "core/derived_from", None, "hf:org/x@1"),
        (5, 2, "core/derived_from", None, "bob/twin@2"), (5, 3, "core/derived_from", None, "a/b/c@1"), (5, 4, "core/derived_from", None, "bob/open@0"),
    ]
    return spark.createDataFrame(made, "from_version_id long, ordinal int, type string, to_version_id long, to_external string")


def search(targets, edges, caller, **match):
    words = filters.Vocabulary(sides={"relations": relations.side(edges, targets, caller)})
    found = filters.apply(targets, {"path": "relations", "op": "any", "match": match}, words)
    return sorted(r["version_id"] for r in found.collect())


def test_any_relation(targets, edges):
    assert search(targets, edges, ["alice"], to={"op": "prefix", "value": "alice/single2-k4"}) == [1]
    # both conditions hold on one edge, or the row does not match
    assert search(targets, edges, [], type="core/uses_eval", to="bob/open@1") == [1]
    assert search(targets, edges, [], type="core/compares", to="bob/open@1") == []


def test_a_private_target_is_no_row_for_a_stranger(targets, edges):
    assert search(targets, edges, ["alice"], to="bob/hidden@1") == [5]  # text tells nothing
    assert search(targets, edges, ["bob"], to="bob/hidden@1") == [1, 2, 5]
    assert search(targets, edges, [], type="core/compares") == []
    assert search(targets, edges, ["bob"], type="core/compares") == [1, 2]
    # a target that is gone is no row, whoever asks
    assert 3 not in search(targets, edges, ["alice", "bob"], type={"op": "eq", "value": "core/uses_eval"}, to={"op": "exists"})


def test_any_relation_under_not_and_or(targets, edges):
    words = filters.Vocabulary(sides={"relations": relations.side(edges, targets, ["alice"])}, scalars={"name": filters.Scalar(F.col("name"), "string")})
    leaf = {"path": "relations", "op": "any", "match": {"type": "core/uses_eval"}}
    got = lambda where: sorted(r["version_id"] for r in filters.apply(targets, where, words).collect())
    assert got({"not": leaf}) == [2, 5, 6, 7, 8]
    assert got({"or": [leaf, {"path": "name", "op": "eq", "value": "twin"}]}) == [1, 3, 4, 7, 8]
    with pytest.raises(filters.FilterError, match="unknown_path"):
        got({"path": "relations", "op": "any", "match": {"attrs": 1}})


def test_any_attachment(spark, targets):
    refs = spark.createDataFrame([(1, "logs/a.txt", "aa"), (1, "b", "bb"), (2, "b", "aa"), (2, None, None)], "version_id long, path string, sha256 string")
    words = filters.Vocabulary(sides={"attachments": relations.attachment_side(refs)})
    got = lambda **m: sorted(r["version_id"] for r in filters.apply(targets, {"path": "attachments", "op": "any", "match": m}, words).collect())
    assert got(sha256="aa") == [1, 2] and got(path="b", sha256="aa") == [2] and got(path={"op": "prefix", "value": "logs/"}) == [1]


def test_resolved_for_a_reader(targets, edges):
    rows = {(r["from_version_id"], r["ordinal"]): r for r in relations.resolve(edges, targets, ["alice"]).collect()}
    assert len(rows) == 12
    kinds = {k: (r["kind"], r["version_id"]) for k, r in rows.items()}
    assert kinds == {
        (1, 0): ("unresolved", None), (1, 1): ("private", 4), (1, 2): ("version", 5), (2, 0): ("private", 4), (3, 0): ("unresolved", None), (3, 1): ("unresolved", None),
        (4, 0): ("version", 5), (5, 0): ("unresolved", None), (5, 1): ("external", None), (5, 2): ("version", 8), (5, 3): ("unresolved", None), (5, 4): ("unresolved", None),
    }
    assert rows[1, 1]["content_hash"] == "h4" and rows[1, 1]["address"] is None and rows[1, 2]["content_hash"] is None and rows[1, 2]["address"] == "bob/open@1"
    assert rows[3, 0]["text"] == "" and rows[5, 1]["text"] == "hf:org/x@1"


def test_resolved_when_written(spark, targets):
    refs = spark.createDataFrame([("bob/open@1",), ("bob/hidden@1",), ("alice/a@1",), ("bob/twin@2",), ("x",), (None,)], "text string")
    got = lambda writer, t=None: {r["text"]: r["resolved"] for r in relations.resolve_written(refs, targets, writer, t).collect()}
    assert got(["alice"]) == {"bob/open@1": None, "bob/hidden@1": None, "alice/a@1": 1, "bob/twin@2": 8, "x": None, None: None}
    assert got(["bob"], "eval") == {"bob/open@1": 6, "bob/hidden@1": None, "alice/a@1": None, "bob/twin@2": 7, "x": None, None: None}


def test_withheld(spark, targets, edges):
    body = {
        "title": "t\"q", "n": 0.1, "relations": [
            {"type": "core/compares", "to": "bob/hidden@01", "attrs": {"k": [1, 2.5]}}, {"type": "core/uses_eval", "to": "bob/hidden@1"}, {"to": "bob/hidden@1"}, "odd",
            {"type": "core/uses_eval", "to": "bob/open@1", "attrs": {"b": None, "a": "é"}}, {"type": "core/compares", "to": "bob/hidden@1"},
        ], "run_results": [{"eval": "bob/twin", "run_id": "r1"}, {"eval": "bob/open", "run_id": "r2", "value": 1.0}, {"run_id": "r3"}, {"eval": 3}],
    }
    plain = '{ "relations": [ {"type": "core/compares", "to": "bob/hidden@1"} ] }'
    bodies = spark.createDataFrame([(1, json.dumps(body)), (2, '{"relations": 5, "run_results": null}'), (5, plain), (6, None)], "version_id long, body string")
    hidden = relations.hidden_targets(edges, targets, ["alice"])
    assert sorted((r["from_version_id"], r["version_id"], r["content_hash"]) for r in hidden.collect()) == [(1, 4, "h4"), (2, 4, "h4")]
    records = spark.createDataFrame([(70, "bob", "twin", "private"), (71, "bob", "open", "public")], "record_id long, ns string, name string, visibility string")
    judged = spark.createDataFrame([(1, 70), (1, 70), (1, 71), (6, None)], "version_id long, eval_record_id long")
    evals = relations.hidden_evals(judged, records, ["alice"])
    assert [tuple(r) for r in evals.select("version_id", "ns", "name", "judgements").collect()] == [(1, "bob", "twin", 2)]
    got = {r["version_id"]: r for r in relations.withhold(bodies, hidden, evals).collect()}
    one = json.loads(got[1]["body"])
    assert one["relations"] == body["relations"][1:5] and one["run_results"] == body["run_results"][1:] and one["title"] == 't"q' and one["n"] == 0.1
    assert list(one) == sorted(one)
    assert [tuple(x) for x in got[1]["withheld_relations"]] == [("core/compares", 4, "h4")] * 2 and got[1]["withheld_run_results"] == 1
    # nothing of their own is hidden: untouched, down to the spaces
    assert got[5]["body"] == plain and got[5]["withheld_relations"] is None and got[5]["withheld_run_results"] is None
    assert got[2]["body"] == '{"relations": 5, "run_results": null}' and got[6]["body"] is None
    # a member sees all
    assert relations.hidden_targets(edges, targets, ["bob"]).count() == 0
    whole = relations.withhold(bodies, relations.hidden_targets(edges, targets, ["bob"]), relations.hidden_evals(judged, records, ["bob"])).collect()
    assert {r["version_id"]: r["body"] for r in whole}[1] == json.dumps(body)


def test_withheld_empties_an_array(spark, targets, edges):
    bodies = spark.createDataFrame([(2, '{"relations":[{"to":"bob/hidden@1","type":"core/compares"}]}')], "version_id long, body string")
    none = spark.createDataFrame([], "version_id long, eval_record_id long, judgements long, ns string, name string")
    got = relations.withhold(bodies, relations.hidden_targets(edges, targets, []), none).first()
    assert got["body"] == '{"relations":[]}' and [tuple(x) for x in got["withheld_relations"]] == [("core/compares", 4, "h4")]


def test_edges_are_worked_out_once_for_resolution(spark):
    """One scan of the lines whatever an edge asks; each kind of edge had its own."""
    plan = relation_queries.join_edge_target(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[l_orderkey", plan)) == 1


def test_addresses_are_cut_as_the_form_says(spark):
    texts = ["a/b@1", "a/b@+2", "a/b@c@3", "a/@4", "/b@1", "a/@@4", "a/b@0", "a/b@", "a/b/c@1", "a/b@1\n", "a\nb/c@2", "a/b@99999999999", "a/b@007", "é/ü😀@5", "external:a/b@1", "hf:a/b@1", "a@1/b@2", "", "@", "a/b@-1", "a/b@2147483647", "a/b@٣"]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", relations.hub_target(F.col("text")).alias("t")).collect()
    for r in got:
        m = re.fullmatch(r"([^/]+)/([^/]+)@(\+?[0-9]+)", r["text"])
        right = m and not r["text"].startswith(("external:", "hf:")) and 1 <= int(m[3]) < 1 << 31
        assert (tuple(r["t"]) if r["t"] else None) == ((m[1], m[2], int(m[3])) if right else None), r["text"]
