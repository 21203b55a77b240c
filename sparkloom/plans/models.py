"""Models: a named query with declared columns, grain, kind and loads; macros, parameters and query heads."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import types

KINDS = ("view", "full", "incremental_by_unique_key", "incremental_by_time_range", "copy", "mapped", "native")
BUILT = KINDS[:5]


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    nullable: bool = True
    collation: str | None = None
    trimmed: bool = False
    info: str = ""


@dataclass
class Model:
    name: str
    query: str | Callable[..., DataFrame] | None = None
    columns: list[Column] = field(default_factory=list)
    grain: list[str] = field(default_factory=list)
    kind: str = "view"
    reads: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    time_column: str | None = None
    lookback: str | None = None
    slice: tuple[str, str] | None = None
    loads: list = field(default_factory=list)

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"{self.name}: unknown kind {self.kind}")
        if self.kind == "incremental_by_unique_key" and not self.grain:
            raise ValueError(f"{self.name}: a unique key needs a grain")
        if self.kind == "incremental_by_time_range" and not self.time_column:
            raise ValueError(f"{self.name}: a time range needs a time column")
        names = [c.name.lower() for c in self.columns]
        if len(set(names)) < len(names):
            raise ValueError(f"{self.name}: a column is declared twice")
        if self.columns and (bad := [g for g in self.grain if g.lower() not in names]):
            raise ValueError(f"{self.name}: the grain names undeclared columns {bad}")

    def schema(self, aliases: dict[str, str] | None = None) -> T.StructType:
        return T.StructType([T.StructField(c.name, types.to_spark(c.type, aliases), c.nullable, {"collation": c.collation or "", "trimmed": c.trimmed}) for c in self.columns])

    def check(self, df: DataFrame) -> list[str]:
        """How a result differs from the declaration."""
        found = {f.name.lower(): f for f in df.schema.fields}
        out = [f"{c.name} is missing" for c in self.columns if c.name.lower() not in found]
        out += [f"{n} is not declared" for n in found if n not in {c.name.lower() for c in self.columns}] if self.columns else []
        for c in self.columns:
            if (f := found.get(c.name.lower())) and not types.same(c.type, types.from_spark(f.dataType)):
                out.append(f"{c.name} is {types.from_spark(f.dataType)}, declared {c.type}")
        return out

    def conform(self, df: DataFrame) -> DataFrame:
        """Declared columns in order, cast to their types."""
        if not self.columns:
            return df
        return df.select(*[df[c.name].cast(types.to_spark(c.type)).alias(c.name) for c in self.columns])


HEAD = re.compile(r"^\s*CREATE\s+TABLE\s+([\w.]+)\s*(?:WITH\s*\((.*?)\)\s*)?AS\s+", re.I | re.S)


def query_head(text: str) -> tuple[str | None, dict[str, str], str]:
    """Name, options and body of CREATE TABLE x WITH (kind = full, ...) AS SELECT ...; or no name and the text."""
    m = HEAD.match(text)
    if not m:
        return None, {}, text
    options = {}
    for part in filter(None, (p.strip() for p in re.split(r",(?![^()]*\))", m[2] or ""))):
        k, eq, v = part.partition("=")
        if not eq:
            raise ValueError(f"not an option: {part}")
        names = [x.strip().strip("'\"") for x in v.strip().removeprefix("(").removesuffix(")").split(",")]
        options[k.strip().lower()] = ", ".join(names)
    if bad := set(options) - {"kind", "grain", "time_column", "tags", "lookback"}:
        raise ValueError(f"unknown options {sorted(bad)}")
    return m[1], options, text[m.end() :]


SCOPES = ("model", "origin", "connection", "project")
_PARAMETER = re.compile(r"\$\{(project|connection|origin|model)\.(\w+)\}")
_NAME = re.compile(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*")


def bind(text: str, scopes: dict[str, dict[str, object]], names: frozenset[str] = frozenset()) -> tuple[str, dict[str, object]]:
    """${scope.name} as named parameters, never as text; those in names as IDENTIFIER(:p), and only if they are names."""
    args: dict[str, object] = {}

    def put(m: re.Match) -> str:
        scope, name = m.groups()
        if name not in scopes.get(scope, {}):
            raise KeyError(f"{scope}.{name} has no value")
        key, value = f"{scope}_{name}", scopes[scope][name]
        if f"{scope}.{name}" in names and not _NAME.fullmatch(str(value)):
            raise ValueError(f"{scope}.{name} is not a name: {value!r}")
        args[key] = value
        return f"IDENTIFIER(:{key})" if f"{scope}.{name}" in names else f":{key}"

    return _PARAMETER.sub(put, text), args


@dataclass
class Macro:
    """A scalar macro or, with table=True, a table macro over fixed tables. types: of the parameters."""

    name: str
    parameters: dict[str, str]
    body: str
    table: bool = False

    def calls(self, known: set[str]) -> set[str]:
        return {w for w in re.findall(r"([A-Za-z_]\w*)\s*\(", self.body) if w in known and w != self.name}


def macro_order(macros: list[Macro]) -> list[Macro]:
    """Callees first; a cycle is refused."""
    by_name = {m.name: m for m in macros}
    done: list[Macro] = []
    state: dict[str, int] = {}

    def visit(m: Macro, path: tuple[str, ...]) -> None:
        if state.get(m.name) == 2:
            return
        if state.get(m.name) == 1:
            raise ValueError(f"macros call each other: {' > '.join((*path, m.name))}")
        state[m.name] = 1
        for callee in sorted(m.calls(set(by_name))):
            visit(by_name[callee], (*path, m.name))
        state[m.name] = 2
        done.append(m)

    for m in macros:
        visit(m, ())
    return done


def create_macros(spark: SparkSession, macros: list[Macro], aliases: dict[str, str] | None = None) -> None:
    for m in macro_order(macros):
        parameters = ", ".join(f"{n} {types.to_spark(t, aliases).simpleString()}" for n, t in m.parameters.items())
        returns = "RETURNS TABLE RETURN" if m.table else "RETURN"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {m.name}({parameters}) {returns} {m.body}")


#: Functions that call into the JVM.
_CALLS_OUT = re.compile(r"\b(?:java_method|reflect|try_reflect)\s*\(", re.I)


def read_only(text: str, spark: SparkSession | None = None) -> str:
    """The text if Spark parses it as one query; commands, inserts and calls into the JVM are refused."""
    spark = spark or SparkSession.active()
    jvm = spark.sparkContext._jvm
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text.rstrip().rstrip(";"))
    except Exception as e:
        raise PermissionError("only a single SELECT may be run here") from e
    logical = "org.apache.spark.sql.catalyst.plans.logical."
    forbidden = [jvm.java.lang.Class.forName(logical + n, False, jvm.java.lang.Thread.currentThread().getContextClassLoader()) for n in ("Command", "ParsedStatement")]

    def nodes(p):
        yield p
        for kind in ("children", "innerChildren"):
            for i in range((found := getattr(p, kind)()).size()):
                if forbidden_or_plan(found.apply(i)):
                    yield from nodes(found.apply(i))

    def forbidden_or_plan(x) -> bool:
        return jvm.java.lang.Class.forName(logical + "LogicalPlan", False, jvm.java.lang.Thread.currentThread().getContextClassLoader()).isInstance(x)

    if any(f.isInstance(n) for n in nodes(plan) for f in forbidden):
        raise PermissionError("only a SELECT may be run here")
    plain = re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|--[^\n]*|/\*.*?\*/", " ", text, flags=re.S).replace("`", "")
    if _CALLS_OUT.search(plain):
        raise PermissionError("calls into the JVM may not be run here")
    return text
