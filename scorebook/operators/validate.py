"""Validation of bodies: every failure of a body at once, as JSON Pointers with codes.

A body is walked once, where it is read, along a tree made of the field lists below; it never leaves its row, so nothing is
shuffled. What the walk itself can tell are the errors of form and those of counts and details that are missing. Texts that a
rule is about (identifiers, targets, paths, times, references) leave it as an array, each with what the walk knows of the rest of
the body: whether a path came before, whether what a text refers to is there. They are judged by Columns.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, walk

# Error codes in the order that breaks ties of a path.
CODES = (
    "schema number_too_large counts_missing counts_inconsistent attachment_ref_unknown attachment_path_invalid metric_id_invalid ext_key_invalid type_mismatch not_indexed "
    "unknown_path attachment_missing label_in_use namespace_in_use registry_entry_exists runs_moved run_status_detail run_id_invalid run_id_mismatch "
    "run_result_value_or_label run_results_eval_unknown run_unknown run_not_in_used_set too_many_run_results run_deleted batch_duplicate_run_id batch_too_large body_too_large"
).split()

# The fields of bodies. "!" is required, "?" may be null; uint is an integer from 0; a dict is a closed object,
# a list an array of what it holds, "map" an open object, "any" anything. A dict under "?" is judged as one value.
MODEL = {
    "id!": "string", "provider": "string?", "revision": "string?", "endpoint": "string?", "engine?": {"name!": "string", "version": "string?"},
    "quantization?": {"method!": "string", "dtype": "string?"}, "availability": "string?", "context_window": "uint?", "ext": "map",
}
TASK = {
    "id!": "string", "version": "string?", "revision": "string?", "split": "string?", "config": "string?", "n": "uint?", "seed": "integer?", "shuffled": "boolean?",
    "source_data": "string?", "sample_ids_sha256": "string?", "ext": "map",
}
HARNESS = {"name!": "string", "version!": "string", "config_sha256": "string?", "prompt_template_sha256": "string?", "system_prompt_sha256": "string?", "few_shot": "uint?", "ext": "map"}
GENERATION = {
    "temperature": "number?", "top_p": "number?", "top_k": "uint?", "max_tokens": "uint?", "seed": "integer?", "n": "uint?", "stop": ["string"],
    "reasoning?": {"effort": "string?", "budget_tokens": "uint?"}, "ext": "map",
}
TRIAL = {"k": "uint?", "pass_at_k": "boolean?", "max_turns": "uint?", "timeout_ms": "uint?", "retries": "uint?", "sandbox?": {"image!": "string", "digest": "string?"}, "ext": "map"}
GRADING = {
    "graders": [{"name!": "string", "kind": "string?"}], "judge?": {"id!": "string", "provider": "string?", "revision": "string?"}, "rubric_sha256": "string?",
    "aggregation": "string?", "threshold": "number?", "ext": "map",
}
ENV = {
    "git?": {"origin": "string?", "commit!": "string", "dirty": "boolean?"}, "packages": [{"name!": "string", "version!": "string"}], "os": "string?",
    "hardware?": {"gpu": "string?", "gpu_count": "uint?", "cpu": "string?", "memory_gb": "number?"}, "ext": "map",
}
FACETS = {"model?": MODEL, "task?": TASK, "harness?": HARNESS, "generation?": GENERATION, "trial?": TRIAL, "env?": ENV}
ATTACHMENTS = [{"path!": "string", "sha256!": "string", "size!": "uint", "media_type": "string?"}]
HEAD = {
    "schema!": "string", "title!": "string", "producer!": {"name!": "string", "version!": "string"}, **FACETS, "relations": [{"type!": "string", "to!": "string", "attrs": "map?"}],
    "attachments": ATTACHMENTS, "redaction?": {"applied!": "boolean", "method": "string?", "fields": ["string"]}, "ext": "map",
}
CARD = {
    **HEAD, "grading?": GRADING,
    "results": [{
        "metric!": "string", "value!": "number", "n": "uint?", "aggregation!": "enum mean pass_at_k median sum custom",
        "uncertainty?": {"stderr": "number?", "ci?": {"level!": "number", "low!": "number", "high!": "number"}}, "by": "map?", "samples_ref": "string?",
    }],
    "counts?": {"attempted!": "uint", "completed": "uint", "failed": "uint", "skipped": "uint", "errored": "uint"},
    "run_results": [{"eval!": "string", "run_id!": "string", "metric!": "string", "value": "number?", "label": "string?", "by": "map?", "from": ["string"]}],
    "provenance?": {"source_type!": "enum evaluation_run paper model_card leaderboard other", "evaluator_relationship?": "enum first_party third_party"},
}
EVAL = {**HEAD, "eval_kind!": "enum run_set prompt_set task_set trace_set", "origin!": "enum live reconstructed imported"}
RUN = {
    "run_id!": "string", "status!": "enum ok error skipped", "error?": {"kind!": "string", "message": "string?", "log": "string?"}, "skip_reason": "string?",
    "started_at": "time?", "ended_at": "time?", **FACETS, "calls": "string?", "artifacts": ["string"], "attachments": ATTACHMENTS, "metrics": "numbers", "ext": "map", "meta": "any",
}
EXT_OWNERS = ["", "/model", "/task", "/harness", "/generation", "/trial", "/grading", "/env"]
MOST_RUN_ID_BYTES = 200
#: Identifiers that a body may declare, and the old one of an eval whose runs are in its body.
DECLARED = {"card": ["scorebook.card/1.0", "scorebook.card/1.1"], "eval": ["scorebook.eval/2.0"]}
OLD_EVAL = "scorebook.eval/1.0"
#: Bodies whose errors and texts leave a worker in one batch.
BODIES = 256
AT = {code: i for i, code in enumerate(CODES)}


def schema_rows(body_kind: str, fields: dict, declared: list[str] = ()) -> list[tuple]:
    """(body_kind, shape, kinds, whole, least, choices, time, closed, required, numbers, depth) per shape.

    depth: how many tokens of a pointer lead to the outermost value that is judged as one, if any.
    """
    out: list[tuple] = []

    def add(spec, shape: str, nullable: bool, depth: int | None) -> None:
        if isinstance(spec, str):
            word, *choices = spec.rstrip("?").split()
            nullable |= spec.endswith("?")
            if choices and nullable and depth is None:
                depth = shape.count("/")
        if nullable and isinstance(spec, dict) and depth is None:
            depth = shape.count("/")
        null = ["null"] if nullable else []
        if isinstance(spec, dict):
            names = {k.rstrip("!?"): (k, v) for k, v in spec.items()}
            out.append((body_kind, shape, ["object", *null], False, None, None, False, True, [n for n, (k, _) in names.items() if k.endswith("!")], False, depth))
            for n, (k, v) in names.items():
                add(v, f"{shape}/{n}", k.endswith("?"), depth)
        elif isinstance(spec, list):
            out.append((body_kind, shape, ["array", *null], False, None, None, False, False, [], False, depth))
            add(spec[0], f"{shape}/*", False, depth)
        else:
            kinds = {"uint": "number", "integer": "number", "time": "string", "enum": "string", "map": "object", "numbers": "object"}.get(word, word)
            kinds = list(walk.KINDS.values()) if word == "any" else [kinds, *null]
            if shape == "/schema":
                choices = list(declared)
            out.append((body_kind, shape, kinds, word in ("uint", "integer"), 0.0 if word == "uint" else None, choices or None, word == "time", False, [], word == "numbers", depth))

    add(fields, "", False, None)
    return out


# Fixed values: (rule, code) of the values at a shape, for all kinds of bodies, for records, and for cards and runs alone.
RULES = {"/attachments/*/path": ("path", "attachment_path_invalid")}
RECORD_RULES = {**RULES, "/relations/*/type": ("id", "schema"), "/relations/*/to": ("target", "schema")}
REF = ("ref", "attachment_ref_unknown")
BODY_RULES = {
    "card": {
        **RECORD_RULES, "/results/*/metric": ("id", "metric_id_invalid"), "/run_results/*/metric": ("id", "metric_id_invalid"), "/results/*/samples_ref": REF, "/relations/*": ("uses", "schema"),
        "/run_results/*/eval": ("eval", "run_results_eval_unknown"), "/run_results/*": ("judgement", "run_result_value_or_label"), "/counts": ("counts", "counts_inconsistent"),
    },
    "eval": RECORD_RULES,
    "run": {**RULES, "/calls": REF, "/artifacts/*": REF, "/error/log": REF},
}


class Place:
    """What is known of the values at a shape; a value that is at none may be anything."""

    def __init__(self, kinds=None, whole=False, least=None, choices=None, time=False, closed=False, required=(), numbers=False, depth=None):
        self.kinds, self.whole, self.least, self.choices, self.time, self.closed, self.required, self.depth = kinds, whole, least, choices, time, closed, frozenset(required), depth
        self.rule = self.code = self.keys = None
        # Kinds of values that pass without a look, numbers among them from the low one up to those that doubles do not hold.
        self.passed, self.low = frozenset(), 0
        self.children: dict[str, Place] = {}
        self.others = Place(["number"]) if numbers else None


def places(body_kind: str, declared: dict[str, list[str]]) -> Place:
    """The tree of the shapes of a kind of body, from its root on; a kind without a field list has the rules of records alone."""
    fields, rules = {"card": CARD, "eval": EVAL, "run": RUN}.get(body_kind), BODY_RULES.get(body_kind, RECORD_RULES)
    found = {shape: Place(*rest) for _, shape, *rest in schema_rows(body_kind, fields, declared.get(body_kind, []))} if fields else {"": Place()}
    keys = {f"{o}/ext": "ext_key_invalid" for o in EXT_OWNERS} | ({"/metrics": "metric_id_invalid"} if body_kind == "run" else {})
    for shape in [*rules, *keys]:
        for i in range(1, shape.count("/") + 1):
            found.setdefault("/".join(shape.split("/")[: i + 1]), Place())
    for shape, place in found.items():
        place.rule, place.code = rules.get(shape, (None, None))
        place.keys = keys.get(shape)
        if shape:
            parent, _, name = shape.rpartition("/")
            found[parent].children[name] = place
    for place in found.values():
        place.known = frozenset(name for name, child in place.children.items() if child.kinds is not None)
        if place.rule is None and not place.time and place.choices is None:
            place.passed = frozenset(t for t, kind in walk.KINDS.items() if kind not in ("object", "array") and not (place.whole and t is float) and (place.kinds is None or kind in place.kinds))
            place.low = -walk.EXACT if place.least is None else place.least
    return found[""]


def _used(relation: dict) -> str | None:
    """The eval ``ns/name`` of a relation that uses a version of it; whether it is an identifier is not looked at."""
    to = relation.get("to")
    if relation.get("type") == "core/uses_eval" and isinstance(to, str):
        name, _, seq = to.rpartition("@")
        number = seq.lstrip("0") if seq.isascii() and seq.isdigit() else ""
        if number and len(number) <= 10 and int(number) < 1 << 32:
            return name
    return None


def _details(root: dict, run_id: str | None) -> Iterator[tuple[str, int]]:
    """Errors of a run's details, which depend on its status."""
    if isinstance(root.get("run_id"), str) and run_id is not None and root["run_id"] != run_id:
        yield "/run_id", AT["run_id_mismatch"]
    if root.get("status") in ("ok", "error", "skipped"):
        for key, status in (("error", "error"), ("skip_reason", "skipped")):
            if (root.get(key) is not None) != (root["status"] == status):
                yield f"/{key}", AT["run_status_detail"]


def _counted(counts: dict) -> dict[str, float]:
    return {k: float(v) for k, v in counts.items() if isinstance(v, int) and not isinstance(v, bool) and 0 <= v < 1 << 64}


def walked(text: str | None, run_id: str | None, body_kind: str, tree: Place, declared: list[str], old_eval: str) -> tuple[list[tuple], list[tuple]]:
    """Of a body the errors (path, code) that its form tells, and the texts under a rule: (path, code, rule, text, known).

    known: of a path, that it came before; of a reference, that the body has what it names, whatever its form.
    """
    try:
        root = None if text is None else json.loads(text)
    except (ValueError, RecursionError):
        root = ...
    top = root if isinstance(root, dict) else {}
    if body_kind == "eval" and isinstance(top.get("schema"), str) and (top["schema"] == old_eval or (top["schema"] in declared and "runs" in top)):
        return [("/runs", AT["runs_moved"])], []
    schema, found, once, texts, refers = AT["schema"], [], set(), [], []
    paths, used = set(), set()
    open_ = [(root, tree, "")]
    for value, place, pointer in open_:
        kind = walk.KINDS.get(type(value), "invalid")
        if kind == "number":
            number, whole, large = walk.measured(value)
            if large:
                found.append((pointer, AT["number_too_large"]))
        if place is None:
            if kind == "object":
                open_ += [(v, None, f"{pointer}/{walk.escape(k)}") for k, v in value.items()]
            elif kind == "array":
                open_ += [(v, None, f"{pointer}/{i}") for i, v in enumerate(value)]
            continue
        times = place.kinds is not None and kind not in place.kinds
        rule, code = place.rule, place.code
        if kind == "number":
            times = times or (place.whole and not whole) or (place.least is not None and number < place.least)
        elif kind == "string":
            times = times or (place.choices is not None and value not in place.choices)
            if place.time:
                texts.append((pointer, schema, "time", value, False))
            if rule == "path":
                texts.append((pointer, AT[code], rule, value, value in paths))
                paths.add(value)
            elif rule in ("ref", "eval"):
                refers.append((pointer, AT[code], rule, value))
            elif rule in ("id", "target"):
                texts.append((pointer, AT[code], rule, value, False))
        elif kind == "object":
            if place.closed:
                times += len(place.required - value.keys()) + (not place.known.issuperset(value))
            if rule == "uses":
                used.add(_used(value))
            elif rule == "judgement" and value.get("value") is None and value.get("label") is None:
                found.append((pointer, AT[code]))
            elif rule == "counts" and isinstance(top.get("results"), list):
                n = _counted(value)
                if "attempted" in n and n["attempted"] < sum(n.get(k, 0.0) for k in ("completed", "failed", "skipped", "errored")):
                    found.append((pointer, AT[code]))
            for k, v in value.items():
                child = place.children.get(k, place.others)
                if place.keys:
                    texts.append((f"{pointer}/{walk.escape(k)}", AT[place.keys], "id", k, False))
                t = type(v)
                if child is None or t not in child.passed or ((t is int or t is float) and not child.low <= v <= walk.EXACT):
                    open_.append((v, child, f"{pointer}/{walk.escape(k)}"))
        elif kind == "array":
            child = place.children.get("*", place.others)
            open_ += [(v, child, f"{pointer}/{i}") for i, v in enumerate(value)]
        if times and place.depth is None:
            found += [(pointer, schema)] * times
        elif times:
            once.add("/".join(pointer.split("/")[: place.depth + 1]))  # the value that is judged as one
    if body_kind == "card" and isinstance(top.get("results"), list) and top["results"] and top.get("counts") is None:
        found.append(("/counts", AT["counts_missing"]))
    if body_kind == "run":
        found += _details(top, run_id) if isinstance(root, dict) else []
    texts += [(at, code, rule, value, value in (paths if rule == "ref" else used)) for at, code, rule, value in refers]
    return found + [(path, schema) for path in once], texts


FOUND = pa.struct([("path", pa.string()), ("at", pa.int32())])
TEXT = pa.struct([("path", pa.string()), ("at", pa.int32()), ("rule", pa.string()), ("text", pa.string()), ("known", pa.bool_())])
WALKED_DDL = "found array<struct<path:string,at:int>>, texts array<struct<path:string,at:int,rule:string,text:string,known:boolean>>"


def _lists(rows: list[list[tuple]], kind: pa.StructType) -> pa.Array:
    """A list column of structs."""
    columns = zip(*(x for own in rows for x in own)) if any(rows) else [[]] * kind.num_fields
    offsets = [0]
    for own in rows:
        offsets.append(offsets[-1] + len(own))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], fields=list(kind)))


def _bad(v: Column) -> Column:
    """Whether a text breaks its rule."""
    path = v["text"]
    bad_path = (path == "") | path.startswith("/") | F.array_contains(F.split(path, "/"), "..")
    broken = {
        "id": ~ids.is_id(path), "target": ids.parsed_target(path)["kind"].isNull(), "path": v["known"] | bad_path, "ref": ~v["known"] | bad_path,
        "eval": ~v["known"] | ~ids.is_id(path), "time": ids.instant(path).isNull(),
    }
    return reduce(lambda out, rule: out.when(v["rule"] == rule, broken[rule]), list(broken)[1:], F.when(v["rule"] == "id", broken["id"]))


def errors(bodies: DataFrame, declared: dict[str, list[str]] = DECLARED, old_eval: str = OLD_EVAL) -> DataFrame:
    """id, errors: array<struct<path, code>> in order of path and code, empty for what is accepted.

    bodies: id, body_kind (card, eval or run), run_id (that a run is written under, else null), body. Ids are distinct. A text
    that is not JSON, or null, has a schema error at the root.
    """

    def walk_bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = cache(lambda kind: places(kind, declared))
        for batch in batches:
            for at in range(0, batch.num_rows, BODIES):
                part = batch.slice(at, BODIES)
                rows = zip(*(part.column(c).to_pylist() for c in ("body", "run_id", "body_kind")))
                found, texts = zip(*(walked(text, run_id, kind, tree(kind), declared.get(kind, []), old_eval) for text, run_id, kind in rows))
                columns = [part.column("id"), part.column("body_kind"), part.column("run_id"), _lists(found, FOUND), _lists(texts, TEXT)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "body_kind", "run_id", "found", "texts"])

    rows = bodies.select("id", "body_kind", "run_id", "body")
    out = rows.mapInArrow(walk_bodies, f"id {rows.schema['id'].dataType.simpleString()}, body_kind string, run_id string, {WALKED_DDL}")
    error = lambda path, at: F.struct(path.alias("path"), at.alias("at"))
    broken = F.transform(F.filter("texts", _bad), lambda v: error(v["path"], v["at"]))
    no_id = (F.col("body_kind") == "run") & ~F.coalesce(ids.is_run_id(F.col("run_id")), F.lit(False))
    of_id = F.when(no_id, F.array(error(F.lit("/run_id"), F.lit(AT["run_id_invalid"])))).otherwise(F.array().cast("array<struct<path:string,at:int>>"))
    codes = F.array(*map(F.lit, CODES))
    return out.select("id", F.transform(F.array_sort(F.concat("found", broken, of_id)), lambda x: F.struct(x["path"].alias("path"), F.get(codes, x["at"]).alias("code"))).alias("errors"))


def rows_of(found: DataFrame) -> DataFrame:
    """id, place, path, code: the errors of bodies as rows."""
    return found.select("id", F.posexplode("errors").alias("place", "e")).select("id", "place", "e.path", "e.code")
