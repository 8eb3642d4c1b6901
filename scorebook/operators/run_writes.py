"""Writing runs: facets inherited from the header, checks of a whole batch, and one commit of all tables.

A batch holds elements (record_id, position, run_id, body). All elements of a record are written or, if any of them fails,
none, and every failing one is reported with all its errors. A run that is written replaces its row and its rows in the
child tables.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import canon, ids
from ..sources.staged import Staged
from . import runs as run
from . import validate

# Facets that a run takes from its header.
FACETS = ["model", "task", "harness", "generation", "trial", "env"]
#: Runs whose columns leave in one batch, which is what a worker holds at once.
RUNS = 256
TABLES = {
    "runs": "record_id string, run_id string, status string, error_kind string, started_at timestamp, ended_at timestamp, body string, content_hash string, archived boolean, tombstoned boolean",
    "run_metrics": "record_id string, run_id string, metric string, value double",
    "run_attachment_refs": "record_id string, run_id string, path string, sha256 string",
    "run_fingerprints": "record_id string, run_id string, facet string, fingerprint string",
    "run_hashes": "record_id string, runs_hash string",
    "audit": "record_id string, run_id string, position int, action string, content_hash string, change_number long",
}
PREPARED = pa.schema([
    ("body", pa.string()), ("stored", pa.string()), ("content_hash", pa.string()), ("status", pa.string()), ("error_kind", pa.string()), ("started", pa.string()), ("ended", pa.string()),
    ("metrics", pa.list_(pa.struct([("metric", pa.string()), ("value", pa.float64())]))), ("attachments", pa.list_(pa.struct([("at", pa.int32()), ("path", pa.string()), ("sha256", pa.string())]))),
    ("fingerprints", pa.list_(pa.struct([("facet", pa.string()), ("fingerprint", pa.string())]))),
])
PREPARED_DDL = (
    "body string, stored string, content_hash string, status string, error_kind string, started string, ended string, metrics array<struct<metric:string,value:double>>, "
    "attachments array<struct<at:int,path:string,sha256:string>>, fingerprints array<struct<facet:string,fingerprint:string>>"
)


def materialised(own, header) -> dict:
    """The run with each facet it does not have from the header; one that it has as null stays null, a null one is not taken."""
    if not isinstance(own, dict):
        return own
    more = {f: header[f] for f in FACETS if f not in own and isinstance(header, dict) and header.get(f) is not None}
    return own | more


def prepared_run(run_id: str, own, header) -> tuple:
    """What is checked and what is stored of a run, from one parse of its body."""
    whole = materialised(own, header)
    checked = json.dumps(whole)
    if not isinstance(whole, dict):
        return (checked, *[None] * 6, [], [], [])
    stored = whole | {"run_id": run_id}
    text = canon.canonical(stored)
    word = lambda x: x if isinstance(x, str) else None
    numbers, files, error = stored.get("metrics"), stored.get("attachments"), stored.get("error")
    metrics = [{"metric": k, "value": float(v)} for k, v in numbers.items() if isinstance(v, (int, float)) and not isinstance(v, bool)] if isinstance(numbers, dict) else []
    attachments = [{"at": i, "path": a["path"], "sha256": a["sha256"]} for i, a in enumerate(files) if isinstance(a, dict) and word(a.get("path")) is not None and word(a.get("sha256")) is not None] if isinstance(files, list) else []
    prints = [{"facet": f, "fingerprint": canon.facet_hash({f: stored.get(f)} if isinstance(stored.get(f), dict) else {}, f)} for f in FACETS]
    return (
        checked, text, hashlib.sha256(text.encode()).hexdigest(), word(stored.get("status")), word(error.get("kind")) if isinstance(error, dict) else None,
        word(stored.get("started_at")), word(stored.get("ended_at")), metrics, attachments, prints,
    )


def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of record_id, position, run_id, body, header with the columns that ``prepared`` adds; headers are parsed once per batch."""
    for whole in batches:
        known: dict = {}
        for at in range(0, whole.num_rows, RUNS):
            b = whole.slice(at, RUNS)
            out = []
            for run_id, body, header in zip(*(b.column(n).to_pylist() for n in ("run_id", "body", "header"))):
                if header not in known:
                    known[header] = json.loads(header) if header else {}
                try:
                    out.append(prepared_run(run_id or "", json.loads(body or ""), known[header]))
                except (ValueError, RecursionError):
                    out.append((body, *[None] * 6, [], [], []))
            made = [pa.array(c, t) for c, t in zip(zip(*out), PREPARED.types)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("record_id", "position", "run_id")), *made], names=["record_id", "position", "run_id", *PREPARED.names])


def prepared(batch: DataFrame, headers: DataFrame) -> DataFrame:
    """The elements with their bodies as they will be checked and all columns that are stored; record_id, position, run_id first.

    headers: record_id, header. A body that is no JSON keeps its text and has no columns.
    """
    rows = batch.select("record_id", "position", "run_id", "body").join(headers.select("record_id", "header"), "record_id", "left")
    kinds = {n: rows.schema[n].dataType.simpleString() for n in ("record_id", "position", "run_id")}
    return rows.mapInArrow(prepare, ", ".join(f"{n} {k}" for n, k in kinds.items()) + ", " + PREPARED_DDL)


def run_hash(batch: DataFrame, headers: DataFrame) -> DataFrame:
    """record_id, position, run_id, content_hash: of the run as it will be stored."""
    return prepared(batch, headers).select("record_id", "position", "run_id", "content_hash")


def rejections(made: DataFrame, old: DataFrame, ready: DataFrame) -> DataFrame:
    """record_id, position, run_id, path, code of every failing element, all its errors in order.

    old: record_id, run_id, tombstoned of runs that are there. ready: sha256 of objects that may be referred to; a missing one is
    reported only for elements with no other error.
    """
    key = ["record_id", "position"]
    checked = validate.errors(made.select(F.struct(*key).alias("id"), F.lit("run").alias("body_kind"), "run_id", "body"))
    own = checked.select("id.*", F.explode("errors").alias("e")).select(*key, "e.path", "e.code")
    place = Window.partitionBy("record_id", "run_id").orderBy("position")
    again = made.where("run_id <> ''").select(*key, F.row_number().over(place).alias("nth")).where("nth > 1").select(*key, F.lit("/run_id").alias("path"), F.lit("batch_duplicate_run_id").alias("code"))
    gone = made.join(old.where("tombstoned").select("record_id", "run_id"), ["record_id", "run_id"], "left_semi").select(*key, F.lit("/run_id").alias("path"), F.lit("run_deleted").alias("code"))
    files = made.select(*key, F.explode("attachments").alias("a")).select(*key, F.concat(F.lit("/attachments/"), F.col("a.at").cast("string"), F.lit("/sha256")).alias("path"), F.col("a.sha256").alias("sha256"))
    odd = files.where(~F.col("sha256").rlike(r"\A[0-9a-fA-F]{64}\z")).select(*key, "path", F.lit("schema").alias("code"))
    found = own.unionByName(again).unionByName(gone).unionByName(odd)
    missing = files.withColumn("sha256", F.lower("sha256")).join(ready.select(F.lower("sha256").alias("sha256")), "sha256", "left_anti")
    missing = missing.join(found.select(*key).distinct(), key, "left_anti").select(*key, "path", F.lit("attachment_missing").alias("code"))
    order = F.create_map([F.lit(v) for i, code in enumerate(validate.CODES) for v in (code, i)])
    every = found.unionByName(missing).withColumn("_at", order[F.col("code")])
    ranked = every.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("path", "_at")) - 1).drop("_at")
    return ranked.join(made.select(*key, "run_id"), key).select("record_id", "position", "run_id", "place", "path", "code")


def written(made: DataFrame, refused: DataFrame, old: DataFrame) -> DataFrame:
    """The elements of records without a failing one, with what writing does to each: created, updated or unchanged by its hash."""
    had = old.select("record_id", "run_id", F.col("content_hash").alias("_hash"), F.col("archived").alias("_archived"))
    good = made.join(refused.select("record_id").distinct(), "record_id", "left_anti").join(had, ["record_id", "run_id"], "left")
    change = F.when(F.col("_hash").isNull(), "created").when(F.col("_hash") == F.col("content_hash"), "unchanged").otherwise("updated")
    return good.withColumn("change", change).withColumn("archived", F.coalesce("_archived", F.lit(False))).drop("_hash", "_archived")


def put_runs(store: Staged, batch: DataFrame, headers: DataFrame, ready: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Write a batch; (what was written, what was refused), read back from the shared folder.

    Old rows are read only in the buckets that the batch touches, so a small batch does not read all runs; bucket numbers, a
    bounded set, are all that the driver sees. The new parts of all six tables appear with one manifest.
    """
    made = store.keep(prepared(batch, headers))
    touched = sorted(r["b"] for r in made.select(store.bucket().alias("b")).distinct().collect())
    old = {n: store.read(n, touched) for n in TABLES}
    refused = store.keep(rejections(made, old["runs"], ready))
    done = store.keep(written(made, refused, old["runs"]))
    new = done.where("change <> 'unchanged'")
    keys = ["record_id", "run_id"]
    instant = lambda c: ids.instant(F.col(c))
    rows = new.select(*keys, "status", "error_kind", instant("started").alias("started_at"), instant("ended").alias("ended_at"), F.col("stored").alias("body"), "content_hash", "archived", F.lit(False).alias("tombstoned"))
    cut = {
        "run_metrics": new.select(*keys, F.explode("metrics").alias("x")).select(*keys, "x.metric", "x.value"),
        "run_attachment_refs": new.select(*keys, F.explode("attachments").alias("x")).select(*keys, "x.path", F.lower("x.sha256").alias("sha256")),
        "run_fingerprints": new.select(*keys, F.explode("fingerprints").alias("x")).select(*keys, "x.facet", "x.fingerprint"),
    }
    others = lambda name: old[name].join(new.select(*keys), keys, "left_anti")
    now = {"runs": others("runs").unionByName(rows)} | {n: others(n).unionByName(x) for n, x in cut.items()}
    changed = new.select("record_id").distinct()
    hashes = run.runs_hash(now["runs"].join(changed, "record_id", "left_semi"))
    now["run_hashes"] = old["run_hashes"].join(changed, "record_id", "left_anti").unionByName(hashes)
    action = F.when(F.col("change") == "created", "run.create").otherwise("run.update")
    now["audit"] = old["audit"].unionByName(new.select(*keys, F.col("position").cast("int").alias("position"), action.alias("action"), "content_hash", F.lit(store.manifest()[0] + 1).cast("long").alias("change_number")))
    store.replace(now, touched)
    return done, refused
