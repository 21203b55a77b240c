"""Collects queries by name: as one SQL text for both engines, as a pair of texts, or as a function on DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import Tables

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# fixed values: edge rows of the probe table
_PROBE = """
(1, 7, 2, 2.5, 2.50, 'abc', '2024-01-15', '2024-01-15 10:30:45'),
(2, -7, 2, -2.5, -2.50, 'ABC', '2024-02-29', '2024-02-29 23:59:59'),
(3, 7, -2, 3.5, 3.50, ' abc ', '2024-03-31', '2024-03-31 00:00:00'),
(4, 0, 0, 0.5, 0.00, '', '2023-12-31', '2023-12-31 12:00:00'),
(5, NULL, 3, NULL, NULL, NULL, NULL, NULL),
(6, 5, 0, 1.005, 1.25, '😀a', '2024-06-30', '2024-06-30 08:15:30'),
(7, 2147483647, 1, -0.5, -0.50, 'héllo', '2024-01-31', '2024-01-31 18:45:00'),
(8, 10, 3, 10000000000, 12345.67, 'a,b,c', '2024-02-01', '2024-02-01 00:00:01')"""


def _probe(timestamp: str) -> str:
    return (
        "SELECT CAST(id AS INT) AS id, CAST(i AS INT) AS i, CAST(j AS INT) AS j, CAST(d AS DOUBLE) AS d, CAST(n AS DECIMAL(10,2)) AS n, "
        f"s, CAST(dt AS DATE) AS dt, CAST(ts AS {timestamp}) AS ts FROM (VALUES {_PROBE}) AS v(id, i, j, d, n, s, dt, ts)"
    )


def _with(text: str, name: str, body: str) -> str:
    """The text with one more common table expression, first."""
    m = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", text, re.I)
    if m:
        return f"WITH {m[1] or ''}{name} AS ({body}), {text[m.end():]}"
    return f"WITH {name} AS ({body}) {text}"


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def _put(self, name: str, fn: Callable[[Tables], DataFrame], duck: str | None) -> None:
        if name in self.queries:
            raise ValueError(f"{name} is registered twice")
        self.queries[name] = lambda spark, sf_dir: fn(tables(spark, sf_dir))
        if duck is not None:
            self.oracle[name] = _with(duck, "probe", _probe("TIMESTAMP")) if re.search(r"\bprobe\b", duck) else duck

    def both(self, name: str, text: str) -> None:
        self.sql(name, text, text)

    def sql(self, name: str, spark_text: str, duck_text: str | None) -> None:
        def run(t: Tables) -> DataFrame:
            use(t, spark_text)
            return t.spark.sql(spark_text)

        self._put(name, run, duck_text)

    def frame(self, name: str, duck_text: str | None = None):
        def register(fn: Callable[[Tables], DataFrame]):
            self._put(name, fn, duck_text)
            return fn

        return register

    def exprs(self, name: str, source: str, key: str, columns: dict[str, tuple]) -> None:
        """column: (Spark Column function of no arguments, or SQL text; DuckDB SQL text) over one table."""

        def run(t: Tables) -> DataFrame:
            from pyspark.sql import functions as F

            df = probe(t) if source == "probe" else getattr(t, source)
            return df.select(key, *[(F.expr(s) if isinstance(s, str) else s()).alias(c) for c, (s, _) in columns.items()])

        self._put(name, run, f"SELECT {key}, " + ", ".join(f"{d} AS {c}" for c, (_, d) in columns.items()) + f" FROM {source}")


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)


def probe(t: Tables) -> DataFrame:
    return t.spark.sql(_probe("TIMESTAMP_NTZ"))


def use(t: Tables, text: str) -> None:
    """Views of the tables that a text names."""
    words = set(re.findall(r"[A-Za-z_]+", text))
    t.views(*[n for n in TABLES if n in words])
    if "probe" in words:
        probe(t).createOrReplaceTempView("probe")
