"""State changes in batches against the same requests applied one after the other; scopes, the gate and downloads as scenes."""

from __future__ import annotations

import json
import random

from scorebook.operators import state_ops as st


def test_labels_as_if_one_after_the_other(spark):
    rnd = random.Random(5)
    versions = [(100 * r + q, r, q, label) for r in range(20) for q, label in zip(range(1, 5), rnd.sample(["a", "b", "c", None], 4))]
    requests = [(p, rnd.randrange(22), rnd.randrange(1, 6), rnd.choice(["a", "b", "c", "d", "12", "", None, "٣"])) for p in range(150)]
    held, refused, done = {(r, q): label for _, r, q, label in versions}, {}, []
    for p, r, q, label in requests:
        if not label or (label.isascii() and label.isdigit()):
            refused[p] = "label_invalid"
        elif (r, q) not in held:
            refused[p] = "version_not_found"
        else:
            held |= {k: None for k in held if k[0] == r and held[k] == label} | {(r, q): label}
            done.append(p)
    df = spark.createDataFrame(versions, "version_id long, record_id long, seq int, label string")
    got = st.move_labels(df, spark.createDataFrame(requests, "position int, record_id long, seq int, label string"))
    assert {(r["record_id"], r["seq"]): r["label"] for r in got.rows.collect()} == held and got.rows.columns == df.columns
    assert {r["position"]: r["code"] for r in got.refused.collect()} == refused
    assert sorted(r["position"] for r in got.audit.collect()) == done


def test_runs_as_if_one_after_the_other(spark):
    rnd = random.Random(6)
    runs = [(r, f"r{k}", "{}", f"h{r}{k}", rnd.random() < 0.5, rnd.random() < 0.2, None, None) for r in range(6) for k in range(5)]
    requests = [(p, rnd.randrange(7), f"r{rnd.randrange(6)}", rnd.choice(["archive", "unarchive", "archive", "unarchive", "delete", None]), f"why{p}", None) for p in range(300)]
    now = {(x[0], x[1]): [x[2] if not x[5] else None, x[4], x[5], None] for x in runs}
    refused, done = {}, []
    for p, r, k, action, reason, _ in requests:
        if action is None:
            refused[p] = "bad_request"
        elif r in (0, 6):  # record 0 has tombstoned versions alone, record 6 none
            refused[p] = "record_not_found"
        elif (r, k) not in now:
            refused[p] = "run_not_found"
        elif now[r, k][2]:
            refused[p] = "run_deleted"
        elif action == "delete":
            now[r, k] = [None, now[r, k][1], True, reason]
            done.append(p)
        elif now[r, k][1] != (action == "archive"):
            now[r, k][1] = action == "archive"
            done.append(p)
    rows = [(r, k, None if t else b, h, a, t, x, n) for r, k, b, h, a, t, x, n in runs]
    df = spark.createDataFrame(rows, "record_id long, run_id string, body string, content_hash string, archived boolean, tombstoned boolean, reason string, note string")
    versions = spark.createDataFrame([(r, r == 0) for r in range(6)] + [(1, True)], "record_id long, tombstoned boolean")
    refs = spark.createDataFrame([(r, k, "s") for r, k, *_ in runs], "record_id long, run_id string, sha256 string")
    got, left = st.change_runs(df, spark.createDataFrame(requests, "position int, record_id long, run_id string, action string, reason string, note string"), versions, refs)
    assert {(x["record_id"], x["run_id"]): [x["body"], x["archived"], x["tombstoned"], x["reason"]] for x in got.rows.collect()} == now
    assert {x["position"]: x["code"] for x in got.refused.collect()} == refused
    assert sorted(x["position"] for x in got.audit.collect()) == done
    fresh = {key for key, was in now.items() if was[2] and was[3]}
    assert {(x["record_id"], x["run_id"]) for x in left.collect()} == {(r, k) for r, k, *_ in runs} - fresh


def test_tombstone_keeps_the_facts_and_drops_the_body(spark):
    versions = spark.createDataFrame([(1, 9, 1, "{}", "h1", False, None, None), (2, 9, 2, "{}", "h2", False, None, None), (3, 9, 3, None, "h3", True, "old", "n")], "version_id long, record_id long, seq int, body string, content_hash string, tombstoned boolean, reason string, note string")
    requests = spark.createDataFrame([(0, 9, 2, "withdrawn", "wrong seed"), (1, 9, 2, "error", None), (2, 9, 3, "error", None), (3, 9, 7, "error", None)], "position int, record_id long, seq int, reason string, note string")
    got, left = st.tombstone_versions(versions, requests, spark.createDataFrame([(1, "f", "s"), (2, "f", "s")], "version_id long, path string, sha256 string"))
    rows = {r["version_id"]: (r["body"], r["content_hash"], r["tombstoned"], r["reason"], r["note"]) for r in got.rows.collect()}
    assert rows == {1: ("{}", "h1", False, None, None), 2: (None, "h2", True, "withdrawn", "wrong seed"), 3: (None, "h3", True, "old", "n")}
    assert {r["position"]: r["code"] for r in got.refused.collect()} == {1: "already_tombstoned", 2: "already_tombstoned", 3: "version_not_found"}
    audit = got.audit.collect()
    assert [(r["position"], r["action"], json.loads(r["detail"])) for r in audit] == [(0, "version.tombstone", {"version_id": 2, "reason": "withdrawn", "note": "wrong seed"})]
    assert [r["version_id"] for r in left.collect()] == [1]


def test_visibility(spark):
    records = spark.createDataFrame([(1, "a", "public"), (2, "a", "private")], "record_id long, ns string, visibility string")
    asked = [(0, 1, "private"), (1, 1, "public"), (2, 2, "private"), (3, 3, "public"), (4, 2, "odd"), (5, 2, None)]
    got = st.set_visibility(records, spark.createDataFrame(asked, "position int, record_id long, visibility string"))
    assert {r["record_id"]: r["visibility"] for r in got.rows.collect()} == {1: "public", 2: "private"}
    assert {r["position"]: r["code"] for r in got.refused.collect()} == {3: "record_not_found", 4: "bad_request", 5: "bad_request"}
    assert sorted(r["position"] for r in got.audit.collect()) == [0, 1, 2]


def test_scopes(spark):
    tokens = spark.createDataFrame([(1, 7, "ann", "write"), (2, 7, "ann", "admin"), (3, 8, "bob", "read")], "token_id long, user_id long, login string, scope string")
    covered = spark.createDataFrame([(1, "ann"), (1, "org"), (1, "other"), (2, "org"), (3, "ann"), (3, "org"), (3, "org")], "token_id long, ns string")
    members = spark.createDataFrame([(7, "org", "admin"), (8, "org", "write"), (7, "far", "admin")], "user_id long, ns string, role string")
    scopes = st.effective_scopes(tokens, covered, members)
    assert sorted(tuple(r) for r in scopes.collect()) == [(1, "ann", "write"), (1, "org", "write"), (2, "org", "admin"), (3, "org", "read")]
    asked = spark.createDataFrame([(1, "org", "write"), (1, "org", "admin"), (2, "ann", "read"), (None, "org", "read")], "token_id long, ns string, needs string")
    assert sorted((r["token_id"] or 0, r["needs"], r["allowed"]) for r in st.permitted(asked, scopes).collect()) == [(0, "read", False), (1, "admin", False), (1, "write", True), (2, "read", False)]


def test_metric_gate(spark):
    registry = spark.createDataFrame([("metrics", "core", "f1", "1"), ("metrics", "core", "f1", "2"), ("harnesses", "core", "em", "1")], "kind string, ns string, id string, version string")
    sorts = spark.createDataFrame([(1, 0, "core/f1"), (1, 1, "core/em"), (2, 0, "f1"), (2, 1, None)], "request long, place int, metric string")
    assert sorted(tuple(r) for r in st.metric_gate(sorts, registry).collect()) == [(1, "/sort/1/path", "not_indexed"), (2, "/sort/0/path", "unknown_path"), (2, "/sort/1/path", "unknown_path")]


def test_downloads(spark):
    records = spark.createDataFrame([(1, "a", "public"), (2, "a", "private"), (3, "b", "private")], "record_id long, ns string, visibility string")
    versions = spark.createDataFrame([(11, 1, False), (21, 2, True), (31, 3, False)], "version_id long, record_id long, tombstoned boolean")
    refs = spark.createDataFrame([(11, "pub"), (31, "b"), (21, "gone")], "version_id long, sha256 string")
    run_refs = spark.createDataFrame([(1, "r1", "run"), (1, "r2", "arch"), (2, "r1", "dead")], "record_id long, run_id string, sha256 string")
    runs = spark.createDataFrame([(1, "r1", False), (1, "r2", True), (2, "r1", False)], "record_id long, run_id string, archived boolean")
    objects = spark.createDataFrame([(s, "ready") for s in ("pub", "b", "gone", "run", "arch", "dead", "free")] + [("late", "pending")], "sha256 string, state string")
    found = st.referencing(refs, run_refs, versions, runs, records)
    assert sorted((r["sha256"], r["version_id"], r["run_id"]) for r in found.collect()) == [("arch", None, "r2"), ("b", 31, None), ("gone", 21, None), ("pub", 11, None), ("run", None, "r1")]
    see = lambda caller: {r["sha256"] for r in st.may_download(objects, found, caller).collect()}
    assert see(None) == {"pub", "run"} and see([]) == {"pub", "run", "dead", "free"}
    assert see(["a"]) == {"pub", "run", "arch", "gone", "dead", "free"} and see(["b"]) == {"pub", "run", "b", "dead", "free"}


def test_edges_added_later(spark):
    records = spark.createDataFrame([(1, "eval", "a", "e", "public"), (2, "card", "b", "c", "public"), (3, "eval", "b", "p", "private")], "record_id long, type string, ns string, name string, visibility string")
    versions = spark.createDataFrame([(11, 1, 1), (21, 2, 1), (22, 2, 2), (31, 3, 1)], "version_id long, record_id long, seq long")
    targets = versions.join(records, "record_id")
    runs = spark.createDataFrame([(1, "r1", "h1", False, False), (1, "r2", "h2", True, False), (1, "r3", "h3", False, False), (3, "r1", "p1", False, False)], "record_id long, run_id string, content_hash string, archived boolean, tombstoned boolean")
    edges = spark.createDataFrame([(22, "core/uses_eval", 11, '{"runs":["r1"]}')], "from_version_id long, type string, to_version_id long, attrs string")
    used = spark.createDataFrame([(22, 1, "r1", "then")], "version_id long, eval_record_id long, run_id string, content_hash string")
    asked = [
        (0, 21, "core/uses_eval", "a/e@1", None),  # every live run, since nothing is named yet
        (1, 21, "core/uses_eval", "a/e@1", '{"runs":["r2"]}'),  # r2 joins, none leaves
        (2, 22, "core/uses_eval", "a/e@1", None),  # an older edge names runs: none joins
        (3, 22, "core/uses_eval", "a/e@1", '{"runs":["r3","r9"]}'),  # refused whole
        (4, 21, "core/uses_eval", "b/p@1", None),  # private, in the card's own namespace
        (5, 11, "core/x", "b/p@1", None),  # private elsewhere: text
        (6, 99, "core/x", "a/e@1", None),
        (7, 11, "core/x", "external:y", None),
    ]
    done = st.add_relations(spark.createDataFrame(asked, "position int, from_version_id long, type string, to string, attrs string"), edges, targets, used, runs, records, [])
    assert sorted((r["position"], r["to_version_id"], r["to_external"]) for r in done.edges.collect()) == [(0, 11, None), (1, 11, None), (2, 11, None), (4, 31, None), (5, None, "b/p@1"), (7, None, "external:y")]
    assert sorted((r["version_id"], r["eval_record_id"], r["run_id"], r["content_hash"]) for r in done.used.collect()) == [(21, 1, "r1", "h1"), (21, 1, "r2", "h2"), (21, 1, "r3", "h3"), (21, 3, "r1", "p1")]
    assert sorted((r["position"], r["path"], r["code"]) for r in done.errors.collect()) == [(3, "/attrs/runs/1", "run_unknown"), (6, "/from", "source_version_unknown")]
    assert done.audit.count() == 6
