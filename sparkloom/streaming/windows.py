"""Windows over event time. Each function works on streams and on plain tables, with equal results for rows in time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

AGGREGATES = {"n": lambda: F.count(F.lit(1)), "total": lambda: F.sum(F.col("value").cast("decimal(18,2)")).cast("decimal(38,2)")}


def _late(df: DataFrame, at: str, late: str) -> DataFrame:
    """Watermarks need zoned timestamps; the session's zone is UTC."""
    return df.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late) if df.isStreaming else df


def _flat(df: DataFrame) -> DataFrame:
    return df.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), F.col("window.end").cast("timestamp_ntz").alias("window_end"), *[c for c in df.columns if c != "window"])


def tumbling(df: DataFrame, at: str, size: str, keys: list[str] | None = None, aggregates: dict[str, Column] | None = None, late: str = "1 hour") -> DataFrame:
    made = aggregates or {n: f() for n, f in AGGREGATES.items()}
    return _flat(_late(df, at, late).groupBy(F.window(at, size).alias("window"), *(keys or [])).agg(*[c.alias(n) for n, c in made.items()]))


def sliding(df: DataFrame, at: str, size: str, slide: str, keys: list[str] | None = None, aggregates: dict[str, Column] | None = None, late: str = "1 hour") -> DataFrame:
    made = aggregates or {n: f() for n, f in AGGREGATES.items()}
    return _flat(_late(df, at, late).groupBy(F.window(at, size, slide).alias("window"), *(keys or [])).agg(*[c.alias(n) for n, c in made.items()]))


def sessions(df: DataFrame, at: str, gap: str, keys: list[str], aggregates: dict[str, Column] | None = None, late: str = "1 hour") -> DataFrame:
    """A session ends gap after its last event."""
    made = aggregates or {n: f() for n, f in AGGREGATES.items()}
    return _flat(_late(df, at, late).groupBy(F.session_window(at, gap).alias("window"), *keys).agg(*[c.alias(n) for n, c in made.items()]))


def deduplicated(df: DataFrame, at: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    return _late(df, at, late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_to_end(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is there now, as a table of files beside the checkpoint, also a view of that name; no rows reach the driver.
    A batch that runs again replaces its own files, and a later run from the checkpoint adds to those of earlier ones."""
    spark, out = df.sparkSession, f"{checkpoint.rstrip('/')}-rows"
    spark.createDataFrame([], df.schema).write.mode("ignore").parquet(f"{out}/none")  # to be read where no batch runs

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/{'all' if mode == 'complete' else batch}")

    q = df.writeStream.foreachBatch(put).queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    made = spark.read.schema(df.schema).parquet(f"{out}/*")
    made.createOrReplaceTempView(name)
    return made


def load_each_batch(df: DataFrame, checkpoint: str, load: Callable[[DataFrame, int], None]) -> None:
    """A load strategy for each micro-batch, e.g. watermark_append with a lookback: late rows inside it are replaced."""
    q = df.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def running_totals(df: DataFrame, key: str, value: str, timeout: str = "NoTimeout") -> DataFrame:
    """key, n, total after each micro-batch, from state that each key keeps."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for pdf in batches:
            n, total = n + len(pdf), total + float(pdf[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    schema = f"{key} {df.schema[key].dataType.simpleString()}, n long, total double"
    return df.groupBy(key).applyInPandasWithState(step, schema, "n long, total double", "update", timeout)
