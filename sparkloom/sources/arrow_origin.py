"""A read-only origin that gives Arrow batches, as a Python data source: format("arrow_origin").

Options: module and function name a callable(partition, partitions) -> iterator of record batches, and partitions how
many are read in parallel. With it, clients of other systems (ODBC, Flight SQL) read straight into Spark.
"""

from __future__ import annotations

import importlib

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

REFUSED = (T.ArrayType, T.StructType, T.MapType, T.DayTimeIntervalType, T.YearMonthIntervalType, T.CalendarIntervalType)


class ArrowOrigin(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrow_origin"

    def schema(self):
        raise ValueError("an origin's columns must be declared")

    def reader(self, schema: T.StructType) -> ArrowReader:
        if bad := [f.name for f in schema.fields if isinstance(f.dataType, REFUSED)]:
            raise ValueError(f"lists, structs, maps and intervals can't be copied: {bad}")
        return ArrowReader(self.options)


class ArrowReader(DataSourceReader):
    def __init__(self, options):
        self.module, self.function, self.n = options["module"], options["function"], int(options.get("partitions", 1))

    def partitions(self):
        return [InputPartition(i) for i in range(self.n)]

    def read(self, partition):
        yield from getattr(importlib.import_module(self.module), self.function)(partition.value, self.n)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArrowOrigin)
