"""Batches of revisions of bi-temporal edges: what was believed stays on record, and what is believed now is appended.

A version of an edge is believed from recorded_at to recorded_to and holds from valid_from to valid_to (null: open). The steps:
  create   opens an edge that has no open version;
  revise   closes the open version's record and opens one with the given fields, the others as they were;
  close    does so with valid_to alone;
  retract  closes the record without a successor.
A step counts as recorded at its own time, but a millisecond after the version that it replaces at least; a retraction must
be later than that version by itself.

The steps of an edge depend on each other, so they are folded in order: rows are dealt by edge and sorted within tasks, and a task
streams through them with the state of one edge. Edges without a step, and closed versions, are neither dealt nor sorted.

Defined results: steps of an edge go by recorded_at, then step (nulls first). A step that can't be applied has no effect and is
reported: "open" (create of an open edge), "missing" (nothing open), "interval" (valid_to or recorded_to not after its
beginning), "late" (a retraction not later than its version), "unknown" (an unknown step, or one without edge or time). Repeated
steps are steps of their own; an empty batch changes nothing. An edge has one open version at most; of more the latest counts,
and the others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("valid_from", "valid_to", "weight", "recorded_at", "recorded_to")
KINDS = ("create", "revise", "close", "retract")


def as_of(valid_at: Column, recorded_at: Column) -> Column:
    """Whether a version holds at a time, as believed at a time."""
    until = lambda end, t: F.col(end).isNull() | (F.col(end) > t)
    return (F.col("valid_from") <= valid_at) & until("valid_to", valid_at) & (F.col("recorded_at") <= recorded_at) & until("recorded_to", recorded_at)


def _apply(open_: dict | None, s: dict) -> tuple[list[dict], dict | None, str]:
    """Versions that are finished by a step, the open version after it, and the outcome."""
    at = s["recorded_at"]
    if s["kind"] not in KINDS or at is None:
        return [], open_, "unknown"
    if s["kind"] == "create":
        if open_ is not None:
            return [], open_, "open"
        new = {f: s[f] for f in FIELDS} | {"valid_from": at if s["valid_from"] is None else s["valid_from"], "weight": 1.0 if s["weight"] is None else s["weight"]}
    elif open_ is None:
        return [], None, "missing"
    elif s["kind"] == "retract":
        if at <= open_["recorded_at"]:
            return [], open_, "late"
        return [open_ | {"recorded_to": at}], None, "applied"
    else:
        at = max(at, open_["recorded_at"] + 1)
        given = ("valid_to",) if s["kind"] == "close" else ("valid_from", "valid_to", "weight")
        new = open_ | {f: s[f] for f in given if s[f] is not None} | {"recorded_at": at, "recorded_to": s["recorded_to"] if s["kind"] == "revise" else None}
        if s["kind"] == "revise" and s["reopen"]:
            new["valid_to"] = None
    if any(new[b] is not None and new[b] <= new[a] for a, b in (("valid_from", "valid_to"), ("recorded_at", "recorded_to"))):
        return [], open_, "interval"
    done = [open_ | {"recorded_to": at}] if open_ is not None else []
    return (done, new, "applied") if new["recorded_to"] is None else ([*done, new], None, "applied")


OUT = "edge {edge}, src {src}, dst {dst}, valid_from long, valid_to long, weight double, recorded_at long, recorded_to long, step long, kind string, outcome string"
STEP = ("edge", "src", "dst", *FIELDS, "step", "kind", "reopen")


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Versions (outcome null) and outcomes of rows that are sorted by edge, the open version first."""
    edge, ends, open_, out, schema = None, (None, None), None, [], None

    def version(v: dict) -> dict:
        return {"edge": edge, "src": ends[0], "dst": ends[1]} | {f: v[f] for f in FIELDS} | {"step": None, "kind": None, "outcome": None}

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(out, schema)

    for b in batches:
        kinds = {f.name: f.type for f in b.schema}
        schema = schema or pa.schema([(n, kinds.get(n, pa.string())) for n in ("edge", "src", "dst", *FIELDS, "step", "kind", "outcome")])
        for s in b.to_pylist():
            if s["edge"] != edge:
                if open_ is not None:
                    out.append(version(open_))
                edge, ends, open_ = s["edge"], (s["src"], s["dst"]), None
            if s["kind"] is None and s["step"] is None and s["reopen"] is None:  # the open version
                open_, ends = {f: s[f] for f in FIELDS}, (s["src"], s["dst"])
                continue
            before = open_
            done, open_, outcome = _apply(open_, s)
            if before is None and open_ is not None or s["kind"] == "create" and outcome == "applied":
                ends = s["src"], s["dst"]
            out += [version(v) for v in done]
            out.append({"edge": edge, "src": s["src"], "dst": s["dst"]} | dict.fromkeys(FIELDS) | {"step": s["step"], "kind": s["kind"], "outcome": outcome})
        if len(out) > 4096:
            yield batch()
            out = []
    if open_ is not None:
        out.append(version(open_))
    if out:
        yield batch()


def _folded(versions: DataFrame, steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Versions that the steps leave alone; and what is made of the others."""
    own = steps.filter(F.col("edge").isNotNull()).select("edge", "src", "dst", *FIELDS, F.coalesce("step", F.lit(-1)).cast("long").alias("step"), F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("reopen", F.lit(False)).alias("reopen"))
    touched = own.select("edge").distinct()
    latest = F.row_number().over(Window.partitionBy("edge").orderBy(F.desc("recorded_at"), F.desc("valid_from"), F.desc("weight")))
    live = versions.filter("recorded_to IS NULL").join(touched, "edge", "left_semi").withColumn("_n", latest)
    still = versions.filter("recorded_to IS NOT NULL").unionByName(versions.filter("recorded_to IS NULL").join(touched, "edge", "left_anti")).unionByName(live.filter("_n > 1").drop("_n"))
    begun = live.filter("_n = 1").select("edge", "src", "dst", *FIELDS, F.lit(None).cast("long").alias("step"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("boolean").alias("reopen"))
    rows = begun.withColumn("_first", F.lit(0)).unionByName(own.withColumn("_first", F.lit(1)))
    rows = rows.repartition("edge").sortWithinPartitions("edge", "_first", F.asc_nulls_first("recorded_at"), "step", "kind").select(*STEP)
    kinds = {f.name: f.dataType.simpleString() for f in versions.schema.fields}
    return still, rows.mapInArrow(_fold, OUT.format(**{c: kinds[c] for c in ("edge", "src", "dst")}))


def revise(versions: DataFrame, steps: DataFrame) -> DataFrame:
    """versions (edge, src, dst and FIELDS, in milliseconds) after the steps (edge, src, dst, FIELDS, step, kind, reopen)."""
    versions = versions.select("edge", "src", "dst", *FIELDS)
    still, made = _folded(versions, steps)
    return still.unionByName(made.filter("outcome IS NULL").select(versions.columns))


def outcomes(versions: DataFrame, steps: DataFrame) -> DataFrame:
    """edge, step, kind, outcome of every step."""
    _, made = _folded(versions.select("edge", "src", "dst", *FIELDS), steps)
    nameless = steps.filter("edge IS NULL").select("edge", F.coalesce("step", F.lit(-1)).cast("long").alias("step"), F.coalesce("kind", F.lit("")).alias("kind"), F.lit("unknown").alias("outcome"))
    return made.filter("outcome IS NOT NULL").select("edge", "step", "kind", "outcome").unionByName(nameless)
