"""QUALIFY, DISTINCT ON, top-k, series, VALUES, unpivot, GROUPS frames and percent limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import orders


def qualify(df: DataFrame, windows: dict[str, Column], condition: Column, keep: bool = False) -> DataFrame:
    """Filter on window values; the values themselves go unless asked for."""
    out = df.withColumns(windows).where(condition)
    return out if keep else out.drop(*windows)


def distinct_on(df: DataFrame, keys: list[str], order: list[str], grain: list[str] | None = None) -> DataFrame:
    """The first row of each key. With a grain, the ordering must name all of it, so that the row is determined."""
    named = {*keys, *(k.lstrip("-") for k in order)}
    if grain and not set(grain) <= named:
        raise ValueError(f"the order does not determine a row: {sorted(set(grain) - named)} missing")
    w = Window.partitionBy(*keys).orderBy(*orders(*order))
    return qualify(df, {"__first": F.row_number().over(w)}, F.col("__first") == 1)


def top_per_group(df: DataFrame, keys: list[str], order: list[str], k: int, rank: str | None = None) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*orders(*order))
    name = rank or "__rank"
    return qualify(df, {name: F.row_number().over(w)}, F.col(name) <= k, keep=rank is not None)


def series(spark: SparkSession, start: int, stop: int, step: int = 1, inclusive: bool = True, name: str = "i") -> DataFrame:
    """generate_series (inclusive) or range; empty if the step leads away from the end."""
    if step == 0:
        raise ValueError("the step must not be 0")
    end = stop + (1 if step > 0 else -1) * inclusive
    return spark.range(start, end, step).toDF(name) if (end - start) * step > 0 else spark.range(0).toDF(name)


def series_column(start: Column, stop: Column, step: int = 1) -> Column:
    """An array; empty where Spark's sequence would count the other way or raise."""
    right_way = (start <= stop) if step > 0 else (start >= stop)
    return F.when(right_way, F.sequence(start, F.when(right_way, stop).otherwise(start), F.lit(step).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def date_series(spark: SparkSession, first: str, last: str, unit: str = "day", name: str = "d") -> DataFrame:
    return spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}', INTERVAL 1 {unit})) AS {name}")


def values(spark: SparkSession, rows: list[tuple], names: list[str], types: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in zip(names, types, strict=True)])
    return spark.createDataFrame(rows, schema)


def lateral_values(df: DataFrame, rows: list[list[Column]], names: list[str]) -> DataFrame:
    """A list of cells for each outer row; cells may read the outer columns."""
    cells = F.array(*[F.struct(*[c.alias(n) for c, n in zip(row, names, strict=True)]) for row in rows])
    return df.select("*", F.inline(cells))


def unpivot(df: DataFrame, ids: list[str], columns: list[str], name: str, value: str, keep_nulls: bool = False) -> DataFrame:
    out = df.unpivot(ids, columns, name, value)
    return out if keep_nulls else out.where(F.col(value).isNotNull())


def pivot(df: DataFrame, keys: list[str], on: str, aggregates: dict[str, Column], values: list | None = None) -> DataFrame:
    """One aggregate keeps the value's name, several are named value_aggregate. Without values they are looked up first."""
    grouped = df.groupBy(*keys).pivot(on, values) if values is not None else df.groupBy(*keys).pivot(on)
    return grouped.agg(*[a.alias(n) for n, a in aggregates.items()])


def groups_frame(df: DataFrame, keys: list[str], order: str, aggregate, before: int, after: int, name: str) -> DataFrame:
    """An aggregate over a GROUPS frame: peers count as one step, so a range frame over their dense rank is the same."""
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy(*orders(order)))
    frame = Window.partitionBy(*keys).orderBy("__peer").rangeBetween(-before, after)
    return df.withColumn("__peer", rank.cast("long")).withColumn(name, aggregate.over(frame)).drop("__peer")


def limit_percent(df: DataFrame, percent: float, order: list[str]) -> DataFrame:
    """The first rows, as many as percent of all, rounded down."""
    n = int(df.count() * percent / 100)
    return df.orderBy(*orders(*order)).limit(n)


def sample_rows(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    return df.sample(fraction=fraction, seed=seed)


def distinct_names(names: list[str]) -> list[str]:
    """Repeated output names get _2, _3, ..."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out
