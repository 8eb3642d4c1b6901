"""The one-time migration of evals whose runs are in their bodies.

Each such live version becomes a header, and its runs become rows of the eval: of a run that several versions have the one of
the highest number counts, of one that a body repeats the last. The used sets of cards that point at them are rebuilt with the
hash that a run has under the header of the version pointed at. All of it appears with one commit together with a guard row, so
a second run changes nothing; any run that cannot be named or referred to refuses the whole migration.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import canon, ids
from ..sources.staged import Staged
from . import derive, run_writes, runs, used_sets, validate

NAME = "runs_split"
# What a run says that the old form did not record, and the key that keeps what it said instead.
UNRECORDED = "unrecorded"
KEPT_KEY = "v0.2.0_migration"
TABLES = run_writes.TABLES | {
    "versions": "record_id string, version_id long, type string, seq long, body string, content_hash string, tombstoned boolean",
    "used": "record_id string, version_id long, run_id string, content_hash string",
    "log": "record_id string, version_id long, action string, detail string",
    "migrations": "record_id string",
}
SPLIT = pa.schema([("record_id", pa.string()), ("version_id", pa.int64()), ("seq", pa.int64()), ("old_hash", pa.string()), ("kind", pa.string()), ("position", pa.int32()), ("run_id", pa.string()), *run_writes.PREPARED])
SPLIT_DDL = "record_id string, version_id long, seq long, old_hash string, kind string, position int, run_id string, " + run_writes.PREPARED_DDL


def converted(run_id: str, old: dict, header: dict) -> dict:
    """A run of the old form as one of now: a status for the outcome, what it names of the header's attachments, the header's facets."""
    run: dict = {"run_id": run_id}
    outcome = old.get("outcome")
    if outcome in ("pass", "fail"):
        run["status"] = "ok"
    elif outcome == "skipped":
        run |= {"status": "skipped", "skip_reason": UNRECORDED}
    else:
        run |= {"status": "error", "error": {"kind": UNRECORDED}}
    run |= {k: old[k] for k in ("started_at", "ended_at", "calls", "artifacts") if k in old}
    artifacts = old.get("artifacts")
    named = {x for x in [old.get("calls"), *(artifacts if isinstance(artifacts, list) else [])] if isinstance(x, str)}
    files: dict = {}
    entries = header.get("attachments")
    for entry in entries if isinstance(entries, list) else []:
        if isinstance(entry, dict) and isinstance(entry.get("path"), str) and entry["path"] in named:
            files.setdefault(entry["path"], entry)
    if files:
        run["attachments"] = list(files.values())
    if "outcome" in old:
        run["meta"] = {KEPT_KEY: {"outcome": outcome}}
    return run_writes.materialised(run, header)


def split(body: dict, schema: str) -> tuple[dict, list, list[str]]:
    """(header, [(run_id, run)] of the elements in order, why the body is refused)."""
    header = {k: v for k, v in body.items() if k != "runs"} | {"schema": schema}
    found, problems = [], []
    elements = body.get("runs")
    for i, element in enumerate(elements if isinstance(elements, list) else []):
        run_id = element.get("run_id") if isinstance(element, dict) else None
        if not isinstance(run_id, str):
            problems.append(f"runs[{i}] has no string run_id")
        elif not run_id or "/" in run_id or len(run_id.encode()) > validate.MOST_RUN_ID_BYTES:
            problems.append(f"runs[{i}].run_id is not a valid run_id")
        else:
            found.append((run_id, converted(run_id, element, header)))
    return header, found, problems


def cut(versions: DataFrame, old: str, new: str) -> DataFrame:
    """Rows of kind header, run and problem of the live versions that declare the old schema; one parse of a body."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows: list[tuple] = []
                for row in batch.slice(at, 256).to_pylist():
                    body = json.loads(row["body"])
                    if not isinstance(body, dict) or body.get("schema") != old:
                        continue
                    header, found, problems = split(body, new)
                    key, none = (row["record_id"], row["version_id"], row["seq"], row["content_hash"]), [None] * 4
                    text = canon.canonical(header)
                    rows.append((*key, "header", None, None, text, text, canon.digest(text), *none, [], [], []))
                    rows += [(*key, "run", i, run_id, *run_writes.prepared_run(run_id, run, {})) for i, (run_id, run) in enumerate(found)]
                    rows += [(*key, "problem", i, None, p, None, None, *none, [], [], []) for i, p in enumerate(problems)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), SPLIT.types)], schema=SPLIT)

    chosen = versions.where((F.col("type") == "eval") & ~F.col("tombstoned") & F.col("body").isNotNull()).select("record_id", "version_id", "seq", "content_hash", "body")
    return chosen.mapInArrow(work, SPLIT_DDL)


@dataclass
class Migrated:
    """Whether the migration ran, and why it was refused: record_id, version_id, problem."""

    ran: bool
    problems: DataFrame


def used_of_cards(edges: DataFrame, made: DataFrame, live: DataFrame, winners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(used sets, named runs that nothing matches) of cards whose edges point at live versions of migrated evals.

    edges: version_id of the card, to_version_id, attrs. made: the runs of each old version. live: version_id and record_id of
    the evals' live versions. winners: record_id, run_id, content_hash of the rows.
    """
    to = live.select(F.col("version_id").alias("to_version_id"), F.col("record_id").alias("eval_record_id"))
    own = edges.join(to, "to_version_id").select("version_id", "to_version_id", "eval_record_id", F.lit(used_sets.USES).alias("type"), F.lit(0).alias("ordinal"), F.lit("").alias("ns"), F.lit("").alias("name"), "attrs")
    using = used_sets.uses(own)
    sets = using.groupBy("version_id", "eval_record_id").agg(F.bool_or(F.col("named").isNotNull()).alias("explicit"))
    hashes = made.select(F.col("version_id").alias("to_version_id"), "seq", "run_id", "content_hash")
    pointed = own.select("version_id", "to_version_id", "eval_record_id").distinct().join(hashes, "to_version_id").groupBy("version_id", "eval_record_id", "run_id").agg(F.max_by("content_hash", "seq").alias("content_hash"))
    every = pointed.join(sets.where("not explicit").drop("explicit"), ["version_id", "eval_record_id"])
    rows = winners.select(F.col("record_id").alias("eval_record_id"), "run_id", F.col("content_hash").alias("row_hash"))
    named = used_sets.named_runs(using).join(pointed, ["version_id", "eval_record_id", "run_id"], "left").join(rows, ["eval_record_id", "run_id"], "left").withColumn("content_hash", F.coalesce("content_hash", "row_hash"))
    columns = ["version_id", "eval_record_id", "run_id", "content_hash"]
    return every.select(*columns).unionByName(named.where("content_hash is not null").select(*columns)), named.where("content_hash is null").select("version_id", "eval_record_id", "run_id")


def migrate(store: Staged, edges: DataFrame, old: str = validate.OLD_EVAL, new: str = validate.DECLARED["eval"][0]) -> Migrated:
    """Run the migration once over a store of TABLES. edges: the cards' resolved uses of evals (version_id, to_version_id, attrs)."""
    spark, key = store.spark, ["record_id", "run_id"]
    none = spark.createDataFrame([], "record_id string, version_id long, problem string")
    if not store.read("migrations").where(F.col("record_id") == NAME).isEmpty():
        return Migrated(False, none)
    versions = store.read("versions")
    made = store.keep(cut(versions, old, new))
    per_version = derive.last_wins(made.where("kind = 'run'").drop("kind"), ["version_id", "run_id"], "position")
    best = store.keep(derive.last_wins(per_version, key, "seq"))
    odd = best.select("record_id", "version_id", "run_id", F.explode("attachments").alias("a")).where(~F.col("a.sha256").rlike(r"\A[0-9a-fA-F]{64}\z"))
    problems = store.keep(made.where("kind = 'problem'").select("record_id", "version_id", F.col("body").alias("problem")).unionByName(odd.select("record_id", "version_id", F.concat(F.lit("an attachment of run "), "run_id", F.lit(" has no sha256")).alias("problem")).distinct()))
    if not problems.isEmpty():
        return Migrated(False, problems)

    moment = lambda c: ids.instant(F.col(c))
    had = store.read("runs")
    flags = had.select(*key, F.col("archived").alias("_a"), F.col("tombstoned").alias("_t"))
    rows = best.join(flags, key, "left").select(*key, "status", "error_kind", moment("started").alias("started_at"), moment("ended").alias("ended_at"), F.col("stored").alias("body"), "content_hash", F.coalesce("_a", F.lit(False)).alias("archived"), F.coalesce("_t", F.lit(False)).alias("tombstoned"))
    others = lambda name: store.read(name).join(best.select(*key), key, "left_anti")
    now = {"runs": others("runs").unionByName(rows)}
    now["run_metrics"] = others("run_metrics").unionByName(best.select(*key, F.explode("metrics").alias("x")).select(*key, "x.metric", "x.value"))
    now["run_attachment_refs"] = others("run_attachment_refs").unionByName(best.select(*key, F.explode("attachments").alias("x")).select(*key, "x.path", F.lower("x.sha256").alias("sha256")))
    now["run_fingerprints"] = others("run_fingerprints").unionByName(best.select(*key, F.explode("fingerprints").alias("x")).select(*key, "x.facet", "x.fingerprint"))
    touched = best.select("record_id").distinct()
    now["run_hashes"] = store.read("run_hashes").join(touched, "record_id", "left_anti").unionByName(runs.runs_hash(now["runs"].join(touched, "record_id", "left_semi")))
    headers = made.where("kind = 'header'").select("record_id", "version_id", "old_hash", F.col("stored").alias("_body"), F.col("content_hash").alias("_hash"))
    rewritten = versions.join(headers.select("version_id", "_body", "_hash"), "version_id", "left")
    now["versions"] = rewritten.select("record_id", "version_id", "type", "seq", F.coalesce("_body", "body").alias("body"), F.coalesce("_hash", "content_hash").alias("content_hash"), "tombstoned")
    live = versions.where((F.col("type") == "eval") & ~F.col("tombstoned") & F.col("body").isNotNull()).join(headers.select("record_id").distinct(), "record_id", "left_semi")
    used, unmatched = used_of_cards(edges, per_version, live, best)
    cards = versions.select("version_id", F.col("record_id").alias("card_record_id"))
    fresh = used.select(F.col("eval_record_id").alias("record_id"), "version_id", "run_id", "content_hash")
    before = store.read("used")
    now["used"] = before.unionByName(fresh.join(before, ["record_id", "version_id", "run_id"], "left_anti"))
    said = headers.select("record_id", "version_id", F.lit("migration.runs_split").alias("action"), F.concat("old_hash", F.lit(" "), "_hash").alias("detail"))
    lost = unmatched.groupBy("version_id", "eval_record_id").agg(F.array_join(F.array_sort(F.collect_list("run_id")), " ").alias("named")).join(cards, "version_id")
    lost = lost.select(F.col("card_record_id").alias("record_id"), "version_id", F.lit("migration.card_runs_unmatched").alias("action"), F.concat("eval_record_id", F.lit(" "), "named").alias("detail"))
    now["log"] = store.read("log").unionByName(said).unionByName(lost)
    now["migrations"] = store.read("migrations").unionByName(spark.createDataFrame([(NAME,)], "record_id string"))
    store.replace(now, list(range(store.buckets)))
    return Migrated(True, none)
