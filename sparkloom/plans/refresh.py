"""Inputs of loads, refresh runs in graph order, schema planning and tracking."""

from __future__ import annotations

import datetime as dt
import hashlib
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import types
from .graph import Graph
from .models import Model, read_only

INPUT_TYPES = {"DATE": dt.date, "TIMESTAMP": dt.datetime, "INTEGER": int, "BIGINT": int, "SMALLINT": int, "VARCHAR": str}


class SkipLoad(Exception):
    """A resolver found nothing and the load is to be left out."""


@dataclass
class Input:
    name: str
    type: str
    default: object = None

    def value(self, given: object):
        v = self.default if given is None else given
        if v is None:
            raise ValueError(f"{self.name} has no value")
        kind = INPUT_TYPES[self.type]
        if kind is int:
            bits = {"SMALLINT": 15, "INTEGER": 31, "BIGINT": 63}[self.type]
            if isinstance(v, bool) or int(v) != (float(v) if not isinstance(v, int) else v) or not -(2**bits) <= int(v) < 2**bits:
                raise ValueError(f"{self.name} is no {self.type}: {v!r}")
            return int(v)
        if isinstance(v, str) and kind is not str:
            return kind.fromisoformat(v)
        if kind is dt.date and isinstance(v, dt.datetime):
            return v.date()
        if not isinstance(v, kind):
            raise ValueError(f"{self.name} is no {self.type}: {v!r}")
        return v


@dataclass
class Resolver:
    """A query of one row whose columns are the values that it provides. on_null: fail, initial or skip_load."""

    provides: list[str]
    query: str
    on_null: str = "fail"
    initial: dict[str, object] = field(default_factory=dict)
    needs: list[str] = field(default_factory=list)

    def resolve(self, spark: SparkSession, known: dict[str, object]) -> dict[str, object]:
        rows = spark.sql(read_only(self.query), args={n: known[n] for n in self.needs} or None).limit(2).collect()
        if len(rows) != 1:
            raise ValueError(f"a resolver must give one row, not {'none' if not rows else 'several'}")
        out = {}
        for name, v in zip(self.provides, rows[0], strict=True):
            if v is None:
                if self.on_null == "skip_load":
                    raise SkipLoad(name)
                if self.on_null == "fail" or name not in self.initial:
                    raise ValueError(f"{name} is NULL")
                v = self.initial[name]
            out[name] = v
        return out


def resolve_inputs(spark: SparkSession, inputs: list[Input], resolvers: list[Resolver], given: dict[str, object]) -> dict[str, object]:
    """Given values first, then resolvers as soon as what they need is known, then defaults."""
    known = {i.name: i.value(given[i.name]) for i in inputs if given.get(i.name) is not None}
    todo = [r for r in resolvers if not set(r.provides) <= set(known)]
    while todo:
        ready = [r for r in todo if set(r.needs) <= set(known)]
        if not ready:
            raise ValueError(f"resolvers wait for each other: {[r.provides for r in todo]}")
        for r in ready:
            known = r.resolve(spark, known) | known
            todo.remove(r)
    return {i.name: known[i.name] if i.name in known else i.value(None) for i in inputs}


def refresh(models: list[Model], load: Callable[[Model], None], parallel: int = 4, on_failure: str = "continue", selected: set[str] | None = None) -> dict[str, str]:
    """Loads models as soon as what they read is loaded, at most so many at a time. A failure leaves out what needs the
    failed model and, with on_failure="stop", all that has not begun. Returns ok, failed: ..., or skipped: ... by model."""
    graph = Graph(models)
    wanted = set(graph.models) if selected is None else selected
    state: dict[str, str] = {}
    waiting = [n for n in graph.order() if n in wanted]
    lock, running, stop = threading.Lock(), {}, False
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        while waiting or running:
            for n in list(waiting):
                reads = [r for r in graph.reads[n] if r in wanted]
                if bad := [r for r in reads if state.get(r, "ok") != "ok"]:
                    state[n] = f"skipped: {bad[0]} is not loaded"
                    waiting.remove(n)
                elif stop:
                    state[n] = "skipped: the run was stopped"
                    waiting.remove(n)
                elif len(running) < parallel and all(state.get(r) == "ok" for r in reads):
                    waiting.remove(n)
                    running[pool.submit(load, graph.models[n])] = n
            if not running:
                continue
            done, _ = wait(running, return_when=FIRST_COMPLETED)
            for f in done:
                n = running.pop(f)
                with lock:
                    error = f.exception()
                    state[n] = "ok" if error is None else ("skipped: nothing to load" if isinstance(error, SkipLoad) else f"failed: {error}")
                stop |= error is not None and not isinstance(error, SkipLoad) and on_failure == "stop"
    return state


@dataclass(frozen=True)
class Change:
    action: str
    column: str
    risk: str
    detail: str = ""


_WIDER = {("TINYINT", "SMALLINT"), ("TINYINT", "INTEGER"), ("TINYINT", "BIGINT"), ("SMALLINT", "INTEGER"), ("SMALLINT", "BIGINT"), ("INTEGER", "BIGINT"), ("FLOAT", "DOUBLE"), ("INTEGER", "DOUBLE"), ("DATE", "TIMESTAMP")}

#: Digits of the whole numbers, all of whose values such a decimal holds.
_DIGITS = {"TINYINT": 3, "SMALLINT": 5, "INTEGER": 10, "BIGINT": 19}


def schema_changes(declared: T.StructType, current: T.StructType, renames: dict[str, str] | None = None) -> list[Change]:
    """Steps from a table's schema to the declared one, with a risk: safe, lossy or destructive. renames: new to old."""
    renames, out = renames or {}, []
    have, want = {f.name: f for f in current.fields}, {f.name: f for f in declared.fields}
    for name, f in want.items():
        old = have.get(name) or have.get(renames.get(name, ""))
        if old is None:
            out.append(Change("add", name, "safe" if f.nullable else "destructive", types.from_spark(f.dataType)))
            continue
        if old.name != name:
            out.append(Change("rename", name, "safe", old.name))
        a, b = types.from_spark(old.dataType), types.from_spark(f.dataType)
        if a != b:
            wide = (a, b) in _WIDER or b == "VARCHAR"
            if a.startswith("DECIMAL") and b.startswith("DECIMAL"):
                wide = f.dataType.scale >= old.dataType.scale and f.dataType.precision - f.dataType.scale >= old.dataType.precision - old.dataType.scale
            elif b.startswith("DECIMAL") and a in _DIGITS:
                wide = f.dataType.precision - f.dataType.scale >= _DIGITS[a]
            out.append(Change("widen" if wide else "narrow", name, "safe" if wide else "lossy", f"{a} to {b}"))
        if old.nullable != f.nullable:
            out.append(Change("nullable" if f.nullable else "not null", name, "safe" if f.nullable else "lossy"))
        if old.metadata.get("collation", "") != f.metadata.get("collation", ""):
            out.append(Change("collation", name, "lossy", f.metadata.get("collation", "")))
    used = set(want) | {renames[n] for n in want if n in renames}
    out += [Change("drop", n, "destructive") for n in have if n not in used]
    return out


def apply_changes(df: DataFrame, declared: T.StructType, renames: dict[str, str] | None = None) -> DataFrame:
    from pyspark.sql import functions as F

    renames = renames or {}
    return df.select(*[
        (df[f.name] if f.name in df.columns else df[renames[f.name]] if renames.get(f.name) in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in declared.fields
    ])


def shape_hash(schema: T.StructType) -> str:
    """Drift shows as another hash; column order and metadata do not count."""
    text = "\n".join(sorted(f"{f.name.lower()} {types.from_spark(f.dataType)} {f.nullable}" for f in schema.fields))
    return hashlib.sha256(text.encode()).hexdigest()


#: Tracking tables, each a folder of Parquet files.
TRACKING = {
    "layout": "version int, at timestamp_ntz",
    "runs": "run_id string, started timestamp_ntz, ended timestamp_ntz, state string",
    "run_models": "run_id string, position int, model string, state string, rows long, definition string, started timestamp_ntz, ended timestamp_ntz, inputs string",
    "versions": "model string, shape_hash string, definition string, source string, at timestamp_ntz",
    "watermarks": "model string, column string, value string, at timestamp_ntz",
    "intervals": "run_id string, model string, first string, last string, shape_hash string",
    "plans": "plan_id string, plan_hash string, plan_text string, at timestamp_ntz",
    "plan_steps": "plan_id string, position int, model string, result string, rule string, risk string, detail string, state string, at timestamp_ntz",
    "blocks": "plan_id string, model string, rule string, detail string, at timestamp_ntz, acknowledged_by string, reason string",
    "members": "run_id string, position int, model string, selected boolean",
    "documents": "subject string, document string, document_hash string, at timestamp_ntz",
    "dependencies": "model string, depends_on string, depth int, at timestamp_ntz",
    "locks": "name string, owner string, at timestamp_ntz",
}

#: Raised when a tracking table gets another shape.
LAYOUT = 2


def _now() -> dt.datetime:
    return dt.datetime.now(dt.UTC).replace(tzinfo=None)


def track(spark: SparkSession, folder: str, name: str, rows: list[tuple]) -> None:
    """Appends; the first call says which layout the folder has, and a folder of another layout is refused."""
    _check_layout(spark, folder)
    if rows:
        _append(spark, folder, name, rows)


def _append(spark: SparkSession, folder: str, name: str, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, TRACKING[name]).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def _check_layout(spark: SparkSession, folder: str) -> None:
    if not _there(spark, f"{folder}/layout"):
        return _append(spark, folder, "layout", [(LAYOUT, _now())])
    found = {r.version for r in tracked(spark, folder, "layout").select("version").distinct().collect()}
    if found != {LAYOUT}:
        raise RuntimeError(f"{folder} has the tracking layout {sorted(found)}, not {LAYOUT}")


def tracked(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Empty if nothing was recorded."""
    path = f"{folder}/{name}"
    return spark.read.schema(TRACKING[name]).parquet(path) if _there(spark, path) else spark.createDataFrame([], TRACKING[name])


def recorded_refresh(spark: SparkSession, folder: str, models: list[Model], load: Callable[[Model], DataFrame | int | None], run_id: str | None = None, **options) -> dict[str, str]:
    """refresh, and its run, members, states, times, row counts, shapes and dependencies in the tracking tables. load returns
    the loaded table, a number of rows, or nothing. The run is recorded even if the last write of its loads failed."""
    from .planner import definition_hash

    run_id, started = run_id or uuid.uuid4().hex, _now()
    graph, seen = Graph(models), {}

    def timed(m: Model):
        begun = _now()
        seen[m.name] = (None, None, begun, begun)
        try:
            made = load(m)
            seen[m.name] = (made.count(), shape_hash(made.schema), begun, _now()) if isinstance(made, DataFrame) else (made, None, begun, _now())
        except BaseException:
            seen[m.name] = (None, None, begun, _now())
            raise

    state = refresh(models, timed, **options)
    at, order = _now(), graph.order()
    nothing = (None, None, None, None)
    track(spark, folder, "run_models", [(run_id, i, n, state[n], seen.get(n, nothing)[0], definition_hash(graph.models[n]), *seen.get(n, nothing)[2:], None) for i, n in enumerate(order) if n in state])
    track(spark, folder, "versions", [(n, shape, definition_hash(graph.models[n]), "load", at) for n, (_, shape, *_) in seen.items() if shape and state[n] == "ok"])
    track(spark, folder, "members", [(run_id, i, n, n in state) for i, n in enumerate(order)])
    track(spark, folder, "dependencies", [(n, up, depth, at) for n in order for up, depth in graph.ancestors(n).items()])
    track(spark, folder, "runs", [(run_id, started, at, "ok" if all(s == "ok" or s == "skipped: nothing to load" for s in state.values()) else "failed")])
    return state


def track_plan(spark: SparkSession, folder: str, plan_id: str, steps: list, states: list[str] | None = None) -> None:
    """A plan's text, its steps with their states (planned if it was not applied), and what it was blocked by."""
    at = _now()
    text = "\n".join(f"{s.model}\t{s.result}\t{s.rule}\t{s.risk}\t{s.detail}" for s in steps)
    track(spark, folder, "plans", [(plan_id, hashlib.sha256(text.encode()).hexdigest(), text, at)])
    track(spark, folder, "plan_steps", [(plan_id, i, s.model, s.result, s.rule, s.risk, s.detail, state, at) for i, (s, state) in enumerate(zip(steps, states or ["planned"] * len(steps), strict=True))])
    track(spark, folder, "blocks", [(plan_id, s.model, s.rule, s.detail, at, None, None) for s in steps if s.result == "block"])


def last_recorded(spark: SparkSession, folder: str) -> dict:
    """What the planner compares with: the last shape and definition of each model, found by one grouped pass."""
    from pyspark.sql import functions as F

    from .planner import Recorded

    last = tracked(spark, folder, "versions").groupBy("model").agg(F.max_by(F.struct("shape_hash", "definition"), "at").alias("v"))
    return {r.model: Recorded(r.v.shape_hash, r.v.definition or "") for r in last.collect()}
