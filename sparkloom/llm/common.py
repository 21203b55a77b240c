"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, shared_top


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: later reads survive lost executors."""
    shared_top(df.sparkSession)  # a local session without a folder gets one
    return df.checkpoint(eager=True)


def whole_text(column: str = "text"):
    """A null text counts as an empty one."""
    return F.coalesce(F.col(column), F.lit(""))


def hashable(df: DataFrame) -> list[str]:
    """Columns that a hash can take: all but maps and variants, also inside others."""
    return [f"`{f.name.replace('`', '``')}`" for f in df.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]


def few(df: DataFrame, rows: int, most: int = 20_000) -> DataFrame:
    """A broadcast hint for a table that was made of this many driver rows, where they are few."""
    return F.broadcast(df) if rows <= most else df


def written(df: DataFrame, codec: str | None = None) -> DataFrame:
    """df, written as Parquet to a folder that driver and executors share, and read again. Columns of hashes are better
    left uncompressed: they don't shrink, and each reader of a compressed column holds buffers outside the heap."""
    path = shared_folder(df.sparkSession, "table")
    df.write.options(**({"compression": codec} if codec else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
