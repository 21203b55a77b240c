"""WITH RECURSIVE ... UNION: repeats a step until it brings no new rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..session import shared_top

#: Steps whose rows are kept apart before they are written together.
APART = 32


def _cut(df: DataFrame) -> DataFrame:
    shared_top(df.sparkSession)  # a local session without a folder gets one
    return df.checkpoint(eager=True)


def recursive_union(start: DataFrame, step: Callable[[DataFrame], DataFrame], most_steps: int = 1000) -> DataFrame:
    """Distinct rows of the start and of all steps. Each step sees the rows that were new in the one before; text and
    numbers of later steps take the start's types."""
    schema = start.schema
    known = new = _cut(start.distinct())
    for i in range(1, most_steps + 1):
        made = step(new)
        made = made.select(*[made[c].cast(f.dataType).alias(f.name) for c, f in zip(made.columns, schema.fields, strict=True)])
        # null-safe: rows that differ in nothing are equal, NULLs included
        fresh = _cut(made.distinct().join(known, [made[f.name].eqNullSafe(known[f.name]) for f in schema.fields], "left_anti"))
        if fresh.isEmpty():
            return known
        known, new = known.unionAll(fresh), fresh
        known = known if i % APART else _cut(known)
    raise RuntimeError(f"no fixpoint after {most_steps} steps")


def recursive_union_all(start: DataFrame, step: Callable[[DataFrame], DataFrame], most_steps: int = 1000) -> DataFrame:
    """All rows of the start and of each step, which sees the rows of the one before, until a step has none."""
    schema = start.schema
    out = new = _cut(start)
    for _ in range(most_steps):
        made = step(new)
        made = made.select(*[made[c].cast(f.dataType).alias(f.name) for c, f in zip(made.columns, schema.fields, strict=True)])
        new = _cut(made)
        if new.isEmpty():
            return out
        out = out.unionAll(new)
    raise RuntimeError(f"rows after {most_steps} steps")
