"""What a deployment would do: declared models against the tables that are there and what was recorded of them.

plan is a function of its arguments alone. Models are taken in graph order; each gets steps, and each step names the rule
that made it. Results: ddl, track, load, question, block, skip. Questions wait for an answer; blocks need a change, or the
acknowledgement of exactly the shape or definition that was found; readers of blocked or asked models are skipped."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import types as T

from .graph import Graph
from .models import Model
from .refresh import Change, schema_changes, shape_hash

RISKS = ("safe", "lossy", "destructive")
_STOPS = ("question", "block", "skip")


@dataclass(frozen=True)
class Recorded:
    """What was last recorded of a table: the hash of its shape and that of the query that it was loaded by."""

    shape: str
    definition: str = ""


@dataclass(frozen=True)
class Step:
    model: str
    result: str
    rule: str
    risk: str = "safe"
    detail: str = ""


@dataclass
class Answers:
    """adopt: model to yes or no. history: (model, new column) to leave or reload. renames: by model, new name to old.
    acknowledged: shapes and definitions, by hash. reload: models whose load is to be run over all of their data."""

    adopt: dict[str, bool] = field(default_factory=dict)
    history: dict[tuple[str, str], str] = field(default_factory=dict)
    renames: dict[str, dict[str, str]] = field(default_factory=dict)
    acknowledged: set[str] = field(default_factory=set)
    reload: set[str] = field(default_factory=set)


def definition_hash(model: Model) -> str:
    """Of the query's words, so that blanks and line ends do not count."""
    text = " ".join(model.query.split()) if isinstance(model.query, str) else getattr(model.query, "__qualname__", "")
    return hashlib.sha256(text.encode()).hexdigest()


def plan(models: list[Model], live: dict[str, T.StructType], recorded: dict[str, Recorded], answers: Answers | None = None) -> list[Step]:
    answers, graph, out = answers or Answers(), Graph(models), []
    stopped: set[str] = set()
    for name in graph.order():
        if held := sorted(set(graph.reads[name]) & stopped):
            steps = [Step(name, "skip", "upstream", detail=held[0])]
        else:
            steps = _steps(graph.models[name], live.get(name), recorded.get(name), answers)
        # a table that is not as planned can't be loaded
        if any(s.result in _STOPS for s in steps):
            stopped.add(name)
            steps = [s for s in steps if s.result != "load"]
        out += steps
    return out


def _steps(model: Model, live: T.StructType | None, was: Recorded | None, answers: Answers) -> list[Step]:
    try:
        declared = model.schema()
    except ValueError as e:
        return [Step(model.name, "block", "type", detail=str(e))]
    loads = [] if model.kind == "view" else [Step(model.name, "load", "routine")]
    if model.name in answers.reload and loads:
        loads = [Step(model.name, "load", "reload", "lossy")]
    if live is None:
        return [Step(model.name, "ddl", "create"), *loads]
    out, shape = [], shape_hash(live)
    if was is None:
        if (adopt := answers.adopt.get(model.name)) is None:
            return [Step(model.name, "question", "adopt")]
        if not adopt:
            return [Step(model.name, "block", "not adopted")]
        out.append(Step(model.name, "track", "adopted", detail=shape))
    elif was.shape != shape:
        if shape not in answers.acknowledged:
            return [Step(model.name, "block", "drift", detail=shape)]
        out.append(Step(model.name, "track", "drift acknowledged", detail=shape))
    definition = definition_hash(model)
    changed = was is not None and was.definition not in ("", definition)
    if model.kind == "view":
        return [*out, Step(model.name, "ddl", "view changed")] if changed else out
    if changed and model.kind.startswith("incremental") and definition not in answers.acknowledged:
        return [*out, Step(model.name, "block", "definition changed", detail=definition)]
    renames = answers.renames.get(model.name, {})
    if bad := _unfit(renames, declared, live):
        return [*out, Step(model.name, "block", "rename", detail=bad)]
    for change in schema_changes(declared, live, renames) if model.columns else []:
        out += _column(model.name, change, answers)
        if change.action == "add" and answers.history.get((model.name, change.column)) == "reload":
            loads = [Step(model.name, "load", "reload", "lossy", change.column)]
    return out + loads


def _unfit(renames: dict[str, str], declared: T.StructType, live: T.StructType) -> str:
    """The new name of a rename that is not new, or whose old name is not to be had."""
    have, want = set(live.names), set(declared.names)
    return next((new for new, old in renames.items() if new not in want or new in have or old not in have or old in want), "")


def _column(name: str, change: Change, answers: Answers) -> list[Step]:
    step = Step(name, "ddl", change.action, change.risk, change.column)
    if change.action == "add" and (name, change.column) not in answers.history:
        return [Step(name, "question", "history", detail=change.column), step]
    return [step]


def apply(steps: list[Step], run: Callable[[Step], None], allow: str = "safe") -> list[tuple[Step, str]]:
    """Runs the steps in order, with the state of each. Nothing is run while a step is riskier than allowed. A failure
    leaves out the later steps of its model; questions, blocks and skips are passed over."""
    most = RISKS.index(allow)
    if over := [s for s in steps if RISKS.index(s.risk) > most]:
        raise PermissionError(f"not allowed: {over[0].model}, {over[0].rule} {over[0].detail} is {over[0].risk}")
    out, failed = [], {s.model for s in steps if s.result in ("question", "block", "skip")}
    for s in steps:
        if s.model in failed:
            out.append((s, s.result if s.result in _STOPS else "left out"))
            continue
        try:
            run(s)
            out.append((s, "ok"))
        except Exception as e:
            failed.add(s.model)
            out.append((s, f"failed: {e}"))
    return out
