"""File and database sources and sinks; types are declared, never guessed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("parquet", "orc", "csv", "json", "text", "binaryFile")


def read(spark: SparkSession, path: str, form: str = "parquet", schema: T.StructType | str | None = None, **options) -> DataFrame:
    if form not in FORMATS:
        raise ValueError(f"unknown format {form}")
    if form in ("csv", "json") and schema is None:
        raise ValueError(f"{form} needs declared columns")
    reader = spark.read.options(**({"header": True} | options if form == "csv" else options))
    if schema is not None and form not in ("text", "binaryFile"):
        reader = reader.schema(schema)
    return reader.format(form).load(path)


def write(df: DataFrame, path: str, form: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None, **options) -> None:
    writer = df.write.mode(mode).options(**({"header": True} | options if form == "csv" else options))
    (writer.partitionBy(*partition_by) if partition_by else writer).format(form).save(path)


def write_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int, sort: list[str] | None = None) -> None:
    """A table whose later joins and groupings by the keys need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*(sort or keys)).saveAsTable(name)


def jdbc(spark: SparkSession, url: str, table: str | None = None, query: str | None = None, partition: tuple[str, int, int, int] | None = None, **options) -> DataFrame:
    """A table or a query that the database runs. partition: column, least, greatest, number of parallel reads."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if (table is None) == (query is None):
        raise ValueError("either a table or a query")
    if query is not None:
        return reader.option("query", query).load()
    if partition:
        column, low, high, n = partition
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", n)
    return reader.option("dbtable", table).load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batch: int = 10_000, parallel: int = 8, **options) -> None:
    df.coalesce(parallel).write.format("jdbc").mode(mode).option("url", url).option("dbtable", table).option("batchsize", batch).options(**options).save()


def converted(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Values of a copy by declared type: text booleans, numbers from text, zoneless times."""
    found = {f.name.lower(): f for f in df.schema.fields}
    out = []
    for f in schema.fields:
        source = found.get(f.name.lower())
        if source is None:
            if not f.nullable:
                raise ValueError(f"{f.name} is missing and can't be NULL")
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        c = F.col(source.name)
        if isinstance(f.dataType, T.BooleanType) and isinstance(source.dataType, T.StringType):
            word = F.lower(F.trim(c))
            c = F.when(word.isin("1", "t", "true", "y", "yes", "on"), True).when(word.isin("0", "f", "false", "n", "no", "off"), False)
        elif isinstance(f.dataType, T.StringType) and isinstance(source.dataType, T.BooleanType):
            c = F.when(c, "true").when(~c, "false")
        else:
            c = c.cast(f.dataType)
        out.append(c.alias(f.name))
    return df.select(*out)


def bulk_copy(source: DataFrame, path: str, schema: T.StructType, rows_per_file: int = 1_000_000) -> int:
    """Converts and appends; returns the number of rows copied, counted while writing."""
    from pyspark.sql import Observation

    seen = Observation()
    converted(source, schema).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").option("maxRecordsPerFile", rows_per_file).parquet(path)
    return int(seen.get["n"])


def import_catalog(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """table, position, column, type, nullable for each file."""
    from ..plans import types

    rows = [(name, i, f.name, types.from_spark(f.dataType), f.nullable) for name, path in paths.items() for i, f in enumerate(spark.read.parquet(path).schema.fields)]
    return spark.createDataFrame(rows, "table string, position int, column string, type string, nullable boolean")
