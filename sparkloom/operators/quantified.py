"""x op ANY (S), x op ALL (S) and row-value IN, with three-valued logic.

The set is summed up once (its size, whether it has NULLs, least and greatest value), so that each outer row needs a
comparison with one row or one key, not with the set. Equality with ANY and inequality with ALL look the value up."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FLIP = {"=": "<>", "<>": "=", "<": ">=", "<=": ">", ">": "<=", ">=": "<"}


def _summary(s: DataFrame, column: str, keys: list[str]) -> DataFrame:
    c = F.col(column)
    return s.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), (F.count(F.lit(1)) > F.count(c)).alias("__null"), F.min(c).alias("__min"), F.max(c).alias("__max"), F.count_distinct(c).alias("__d"))


def any_of(df: DataFrame, x: str, op: str, s: DataFrame, column: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """df with a boolean column: TRUE if one element fits; FALSE if none does and nothing is NULL; else NULL.

    keys: columns of the same name by which df and s are correlated."""
    keys = keys or []
    summary = _summary(s, column, keys)
    joined = df.join(summary, keys, "left") if keys else df.crossJoin(summary)
    v = F.col(x)
    if op == "=":
        found = s.select(*keys, F.col(column).alias("__v")).where(F.col("__v").isNotNull()).distinct().withColumn("__hit", F.lit(True))
        left = joined.withColumn("__v", v)
        joined = left.join(found, [*keys, "__v"], "left").drop("__v")
        hit = F.coalesce("__hit", F.lit(False))
    else:
        hit = {
            "<>": (F.col("__d") > 1) | ((F.col("__d") == 1) & (F.col("__min") != v)), "<": v < F.col("__max"), "<=": v <= F.col("__max"), ">": v > F.col("__min"), ">=": v >= F.col("__min"),
        }[op]
    empty = F.coalesce("__n", F.lit(0)) == 0
    result = F.when(empty, False).when(hit, True).when(v.isNull() | F.col("__null"), F.lit(None).cast("boolean")).otherwise(False)
    extra = ["__n", "__null", "__min", "__max", "__d", *(["__hit"] if op == "=" else [])]
    return joined.withColumn(name, result).drop(*extra)


def all_of(df: DataFrame, x: str, op: str, s: DataFrame, column: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """NOT (x opposite-op ANY (S))."""
    return any_of(df, x, _FLIP[op], s, column, name, keys).withColumn(name, ~F.col(name))


def row_in(df: DataFrame, columns: list[str], s: DataFrame, name: str, any_null_unknown: bool = True) -> DataFrame:
    """(a, b) IN (S). A row of S with a NULL leaves the answer unknown; with any_null_unknown=False only where its other
    parts are equal."""
    other = [f"__s{i}" for i in range(len(columns))]
    s = s.toDF(*other)
    whole = s.where(" AND ".join(f"{c} IS NOT NULL" for c in other)).distinct().withColumn("__hit", F.lit(True))
    partial = s.where(" OR ".join(f"{c} IS NULL" for c in other))
    joined = df.join(whole, [df[c] == whole[o] for c, o in zip(columns, other, strict=True)], "left").drop(*other)
    has_null = any_column_null(columns)
    facts = s.agg(F.count(F.lit(1)).alias("__n"), F.sum(F.expr("CASE WHEN " + " OR ".join(f"{c} IS NULL" for c in other) + " THEN 1 ELSE 0 END")).alias("__partial"))
    if any_null_unknown:
        unknown = has_null | (F.coalesce("__partial", F.lit(0)) > 0)
        joined = joined.crossJoin(facts)
    else:
        open_rows = _unknown_rows(df.select(*columns).distinct(), columns, partial, other)
        joined = joined.join(open_rows, [joined[c].eqNullSafe(open_rows[c]) for c in columns], "left").select(*[joined[c] for c in joined.columns], "__open").crossJoin(facts)
        unknown = has_null | F.coalesce("__open", F.lit(False))
    result = F.when(F.col("__n") == 0, False).when(F.coalesce("__hit", F.lit(False)), True).when(unknown, F.lit(None).cast("boolean")).otherwise(False)
    return joined.withColumn(name, result).drop("__hit", "__n", "__partial", "__open")


def _unknown_rows(rows: DataFrame, columns: list[str], partial: DataFrame, other: list[str]) -> DataFrame:
    """Rows without a NULL that equal a row of S in all parts that are there in it: an equi-join for each pattern of NULLs,
    so that nothing is compared row by row. A row of S that is NULL throughout leaves all of them open."""
    whole = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in columns))
    found = []
    for nulls in product((False, True), repeat=len(columns)):
        if not any(nulls):
            continue
        right = partial.where(" AND ".join(f"{o} IS {'' if null else 'NOT '}NULL" for o, null in zip(other, nulls, strict=True)))
        there = [(c, o) for c, o, null in zip(columns, other, nulls, strict=True) if not null]
        if there:
            found.append(whole.join(right, [whole[c] == right[o] for c, o in there], "left_semi"))
        else:
            found.append(whole.crossJoin(F.broadcast(right.limit(1).select(F.lit(1).alias("__any")))).select(*columns))
    return reduce(DataFrame.unionAll, found).distinct().withColumn("__open", F.lit(True))


def any_column_null(columns: list[str]) -> Column:
    out = F.col(columns[0]).isNull()
    for c in columns[1:]:
        out |= F.col(c).isNull()
    return out
