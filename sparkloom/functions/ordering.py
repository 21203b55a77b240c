"""NULLs come last, ascending or descending."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def asc(x: str | Column) -> Column:
    return (F.col(x) if isinstance(x, str) else x).asc_nulls_last()


def desc(x: str | Column) -> Column:
    return (F.col(x) if isinstance(x, str) else x).desc_nulls_last()


def orders(*keys: str) -> list[Column]:
    """'-a' is descending."""
    return [desc(k[1:]) if k.startswith("-") else asc(k) for k in keys]
