"""Load strategies on directories of Parquet files.

A table is a folder of files and of numbered manifests; the manifest with the highest number lists the files of the
current version. A load computes its stage once, writes new files, and last puts the next manifest, which fails if another
writer has put it first. So a load that breaks off at any step leaves the table as it was, readers never see half of one,
and two loads at once can't both succeed. Files without a row that changes are listed again, not written again, once the
table has more than CARRIED_FROM of them.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.temporal import Interval, add_interval


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


#: Tables of no more files are written whole, which is as quick as looking for the files that change.
CARRIED_FROM = 16
_MANIFEST = re.compile(r"_manifest-(\d+)\.json")


class Conflict(RuntimeError):
    """Another load has put a version since this one read the table."""


class Table:
    """A versioned table; every path goes through Spark's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._seen: int | None = None

    def _names(self, pattern: re.Pattern, below: str = "") -> list[str]:
        fs, make = _fs(self.spark, self.path)
        top = make(self.path + below)
        return [s.getPath().getName() for s in fs.listStatus(top) if pattern.fullmatch(s.getPath().getName())] if fs.exists(top) else []

    def version(self) -> int:
        """The number of the current version, 0 if there is none."""
        return max((int(_MANIFEST.fullmatch(n)[1]) for n in self._names(_MANIFEST)), default=0)

    def manifest(self) -> dict | None:
        number = self.version()
        if not number:
            return None
        fs, make = _fs(self.spark, self.path)
        stream = fs.open(make(f"{self.path}/_manifest-{number:012d}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")) | {"version": number}
        finally:
            stream.close()

    def _put(self, number: int, text: str) -> None:
        """Written beside, then renamed to its number, which fails if that number is taken."""
        fs, make = _fs(self.spark, self.path)
        sc = self.spark.sparkContext
        fs.mkdirs(make(self.path))
        part, at = make(f"{self.path}/.manifest-{uuid.uuid4().hex}"), make(f"{self.path}/_manifest-{number:012d}.json")
        out = fs.create(part)
        out.write(bytearray(text, "utf-8"))
        out.close()
        context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri() if part.isAbsolute() and part.toUri().getScheme() else fs.getUri(), sc._jsc.hadoopConfiguration())
        try:
            context.rename(part, at, sc._gateway.new_array(sc._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            fs.delete(part, False)
            if fs.exists(at):
                raise Conflict(f"{self.path}: version {number} is there already") from e
            raise

    @property
    def exists(self) -> bool:
        return self.version() > 0

    def read(self, parts: list[str] | None = None) -> DataFrame:
        """The current version, or these files of it."""
        m = self.manifest()
        if m is None:
            raise FileNotFoundError(f"{self.path} has no version")
        self._seen = m["version"]
        schema, parts = T.StructType.fromJson(m["schema"]), m["parts"] if parts is None else parts
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in parts]) if parts else self.spark.createDataFrame([], schema)

    def write(self, df: DataFrame, append: bool = False, check: Column | None = None, keep: list[str] = ()) -> None:
        """A new version of new files and those to keep (with append, all). Rows for which check is false fail the load."""
        old = self.manifest()
        before, self._seen = (self._seen if self._seen is not None else old["version"] if old else 0), None
        if check is not None:
            df = df.withColumn("__ok", F.when(F.coalesce(check, F.lit(True)), F.lit(True)).otherwise(F.raise_error(F.lit("a row fails the table's check")).cast("boolean"))).where("__ok").drop("__ok")
        part = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{part}")
        made = [f"{part}/{n}" for n in sorted(self._names(re.compile(r"part-.*"), f"/{part}"))]
        schema = json.loads(self.spark.read.parquet(f"{self.path}/{part}").schema.json())
        carried = old["parts"] if old and append else list(keep)
        self._put(before + 1, json.dumps({"parts": [*carried, *made], "schema": old["schema"] if old and carried else schema}))

    def vacuum(self) -> int:
        """Removes files and manifests that the current version doesn't use; returns how many files."""
        fs, make = _fs(self.spark, self.path)
        m = self.manifest()
        keep, gone = set(m["parts"]), 0
        for folder in self._names(re.compile(r"v-.*")):
            names = self._names(re.compile(r"part-.*"), f"/{folder}")
            old = [n for n in names if f"{folder}/{n}" not in keep]
            gone += len(old)
            for n in old if len(old) < len(names) else []:
                fs.delete(make(f"{self.path}/{folder}/{n}"), False)
            if len(old) == len(names):
                fs.delete(make(f"{self.path}/{folder}"), True)
        for n in self._names(_MANIFEST):
            if int(_MANIFEST.fullmatch(n)[1]) < m["version"]:
                fs.delete(make(f"{self.path}/{n}"), False)
        return gone


def _split(table: Table, hit) -> tuple[DataFrame, list[str]]:
    """The rows of the files that have a row which hit (a function of the table with file names) finds, and the other
    files."""
    parts = table.manifest()["parts"]
    if len(parts) <= CARRIED_FROM:
        return table.read(), []
    named = table.read().withColumn("__file", F.substring_index(F.input_file_name(), "/", -2))
    touched = {r[0] for r in hit(named).select("__file").distinct().collect()}  # names of files, as the manifest has them
    return table.read([p for p in parts if p in touched]), [p for p in parts if p not in touched]


def _replace_where(table: Table, gone: Column, rows: DataFrame, check: Column | None = None) -> None:
    """Rows for which gone is true go, and new rows come in."""
    gone = F.coalesce(gone, F.lit(False))
    target, keep = _split(table, lambda df: df.where(gone))
    table.write(target.where(~gone).unionByName(rows.select(*target.columns)), check=check, keep=keep)


def _by_keys(table: Table, stage: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    wanted = stage.select(*keys).dropna(subset=keys).distinct()
    return _split(table, lambda df: df.join(wanted, keys, "left_semi"))


def full_replace(table: Table, stage: DataFrame, check: Column | None = None) -> None:
    table._seen = None  # whatever was read before, all of it goes
    table.write(stage, check=check)


def after_delete_insert(target: DataFrame, stage: DataFrame, keys: list[str]) -> DataFrame:
    """Target rows whose key is not in the stage, and the stage. NULL keys never match."""
    gone = stage.select(*keys).dropna(subset=keys).distinct()
    return target.join(gone, keys, "left_anti").select(*target.columns).unionByName(stage.select(*target.columns))


def delete_insert_by_key(table: Table, stage: DataFrame, keys: list[str], check: Column | None = None) -> None:
    if not table.exists:
        return table.write(stage, check=check)
    target, keep = _by_keys(table, stage, keys)
    return table.write(after_delete_insert(target, stage, keys), check=check, keep=keep)


def once(stage: DataFrame, keys: list[str]) -> DataFrame:
    """The stage; reading it fails if two rows have one key. Rows with a NULL in the key are not compared."""
    null = F.lit(False)
    for k in keys:
        null |= F.col(k).isNull()
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    bad = F.raise_error(F.lit(f"the stage has two rows of one key {keys}")).cast("boolean")
    return stage.withColumn("__n", n).where(F.when((F.col("__n") > 1) & ~null, bad).otherwise(F.lit(True))).drop("__n")


def after_merge(target: DataFrame, stage: DataFrame, keys: list[str]) -> DataFrame:
    """Matches take the stage's values, other stage rows come in, nothing goes. One shuffle: rows of both sides meet by
    key and the stage's side wins. A table of keys alone only takes in new ones. Two stage rows of one key fail."""
    nulls = F.lit(False)
    for k in keys:
        nulls |= F.col(k).isNull()
    values = [c for c in target.columns if c not in keys]
    s = stage.select(*target.columns)
    if not values:
        return target.unionAll(s.join(target.where(~nulls), keys, "left_anti").select(*target.columns))
    left = target.where(~nulls).select(*keys, F.struct(*values).alias("__t"), F.lit(True).alias("__in_t"))
    right = once(s.where(~nulls), keys).select(*keys, F.struct(*values).alias("__s"), F.lit(True).alias("__in_s"))
    merged = left.join(right, keys, "full").select(*keys, F.when(F.col("__in_s"), F.col("__s")).otherwise(F.col("__t")).alias("__v")).select(*keys, "__v.*").select(*target.columns)
    return merged.unionAll(target.where(nulls)).unionAll(s.where(nulls))


def merge_by_key(table: Table, stage: DataFrame, keys: list[str], check: Column | None = None) -> None:
    if table.exists:
        target, keep = _by_keys(table, stage, keys)
        return table.write(after_merge(target, stage, keys), check=check, keep=keep)
    if not stage.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError(f"the stage has two rows of one key {keys}")
    return table.write(stage, check=check)


def delete_insert_by_range(table: Table, stage: DataFrame, column: str, start, end, max_span=None, check: Column | None = None) -> None:
    """The table's rows in [start, end) go, those of the stage come in."""
    if end <= start:
        raise ValueError("the range is empty")
    if max_span is not None and end - start > max_span:
        raise ValueError("the range is wider than max_span")
    inside = (F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(end))
    if table.exists:
        _replace_where(table, inside, stage.where(inside), check)
    else:
        table.write(stage.where(inside), check=check)


@dataclass(frozen=True)
class Lookback:
    """A duration: minutes, hours, days, weeks or months. Dates take days or more."""

    interval: Interval

    @classmethod
    def parse(cls, text: str) -> Lookback:
        m = re.fullmatch(r"(\d+)\s*(minute|hour|day|week|month)s?", text.strip())
        if not m:
            raise ValueError(f"not a duration: {text}")
        return cls(Interval.parse(f"{m[1]} {m[2]}"))

    def before(self, column: Column, is_date: bool) -> Column:
        if is_date and self.interval.micros:
            raise ValueError("a date takes days, weeks or months")
        out = add_interval(column, -self.interval)
        return out.cast("date") if is_date else out


def watermark(table: Table, column: str):
    return table.read().agg(F.max(column)).first()[0] if table.exists else None


def watermark_append(table: Table, stage: DataFrame, column: str, lookback: str | None = None, initial=None, require: bool = False, check: Column | None = None) -> None:
    """Without lookback: append rows after the watermark. With one: replace rows at or after watermark - lookback. An
    empty target takes all rows, or those at or after initial; with require it is refused."""
    top = watermark(table, column)
    if top is None:
        if require:
            raise ValueError("the target has no watermark yet")
        first = stage.where(F.col(column) >= F.lit(initial)) if initial is not None else stage
        table.write(first, check=check)
        return
    if lookback is None:
        table.write(stage.where(F.col(column) > F.lit(top)).select(*table.read().columns), append=True, check=check)
        return
    is_date = isinstance(stage.schema[column].dataType, T.DateType)
    bound = Lookback.parse(lookback).before(F.lit(top), is_date)
    _replace_where(table, F.col(column) >= bound, stage.where(F.col(column) >= bound), check)


def copy_slices(table: Table, origins: dict[str, DataFrame], slice_column: str, time_column: str | None = None, lookback: str | None = None) -> None:
    """Each origin fills its own slice: all of it or, with a time column, what is newer than the slice's watermark. All
    origins make one new version."""
    tops = {}
    if time_column and table.exists:
        tops = {r[0]: r[1] for r in table.read().where(F.col(slice_column).isin(list(origins))).groupBy(slice_column).agg(F.max(time_column)).collect()}
    gone, rows = None, None
    for origin, df in origins.items():
        stage, mine, top = df.withColumn(slice_column, F.lit(origin)), F.col(slice_column) == origin, tops.get(origin)
        old = mine
        if top is not None and lookback is None:
            stage, old = stage.where(F.col(time_column) > F.lit(top)), None
        elif top is not None:
            bound = Lookback.parse(lookback).before(F.lit(top), isinstance(stage.schema[time_column].dataType, T.DateType))
            stage, old = stage.where(F.col(time_column) >= bound), mine & (F.col(time_column) >= bound)
        gone = old if gone is None else gone if old is None else gone | old
        rows = stage if rows is None else rows.unionByName(stage)
    if rows is None:
        return
    if not table.exists:
        table.write(rows)
    elif gone is None:
        table.write(rows.select(*table.read().columns), append=True)
    else:
        _replace_where(table, gone, rows)


def implicit_load(table: Table, model, stage: DataFrame) -> None:
    """The load that a model's kind stands for."""
    if model.kind == "full":
        full_replace(table, stage)
    elif model.kind == "incremental_by_unique_key":
        delete_insert_by_key(table, stage, model.grain)
    elif model.kind == "incremental_by_time_range":
        watermark_append(table, stage, model.time_column, model.lookback)
    elif model.kind == "copy" and model.slice:
        delete_insert_by_key(table, stage, [model.slice[0]])
    elif model.kind == "copy":
        full_replace(table, stage)
    elif model.kind == "view":
        stage.createOrReplaceTempView(model.name.replace(".", "_"))
    else:
        raise ValueError(f"{model.kind} models are not loaded")
