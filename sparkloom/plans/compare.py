"""Table comparison: keyed, and by digests in buckets for tables on different systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

#: Types without equality are not compared.
INCOMPARABLE = (T.MapType, T.VariantType)
#: Of a digest comparison, by key: few enough to send all their sums to the driver.
BUCKETS = 256


def pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[list[str], list[str]]:
    """Columns to compare, and those left out: on one side only, of different families, or without equality."""
    other = {f.name.lower(): f for f in right.schema.fields}

    def family(t: T.DataType) -> str:
        if isinstance(t, T.NumericType):
            return "number"
        return "time" if isinstance(t, (T.TimestampType, T.TimestampNTZType)) else t.typeName()

    compared, skipped = [], []
    for f in left.schema.fields:
        if f.name in keys:
            continue
        g = other.get(f.name.lower())
        ok = g is not None and family(f.dataType) == family(g.dataType) and not isinstance(f.dataType, INCOMPARABLE)
        (compared if ok else skipped).append(f.name)
    skipped += [f.name for n, f in other.items() if n not in {c.lower() for c in left.columns}]
    return compared, skipped


def _joined(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    a = left.select(*[F.col(k).alias(f"k_{k}") for k in keys], *[F.col(c).alias(f"l_{c}") for c in columns], F.lit(True).alias("in_l"))
    b = right.select(*[F.col(k).alias(f"q_{k}") for k in keys], *[F.col(c).alias(f"r_{c}") for c in columns], F.lit(True).alias("in_r"))
    return a.join(b, [a[f"k_{k}"] == b[f"q_{k}"] for k in keys], "full")


def keyed_summary(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: only_left, only_right, matched, differing, and d_<column> for each compared column. NULL values are
    equal to each other; NULL keys to nothing."""
    columns, _ = pairs(left, right, keys)
    both = F.col("in_l").isNotNull() & F.col("in_r").isNotNull()
    unequal = {c: both & ~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")) for c in columns}
    anywhere = F.lit(False)
    for u in unequal.values():
        anywhere |= u
    return _joined(left, right, keys, columns).agg(
        F.count_if(F.col("in_r").isNull()).alias("only_left"), F.count_if(F.col("in_l").isNull()).alias("only_right"), F.count_if(both).alias("matched"),
        F.count_if(anywhere).alias("differing"), *[F.count_if(u).alias(f"d_{c}") for c, u in unequal.items()],
    )


def differing_rows(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Matched rows with a difference: keys, and l_ and r_ columns."""
    columns, _ = pairs(left, right, keys)
    anywhere = F.lit(False)
    for c in columns:
        anywhere |= ~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))
    joined = _joined(left, right, keys, columns).where(F.col("in_l").isNotNull() & F.col("in_r").isNotNull() & anywhere)
    return joined.select(*[F.col(f"k_{k}").alias(k) for k in keys], *[F.col(f"{s}_{c}") for c in columns for s in ("l", "r")])


def one_sided(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left whose key right lacks."""
    return left.join(right.select(*keys), keys, "left_anti").select(*left.columns)


def column_stats(df: DataFrame) -> DataFrame:
    """A row for each column: non-null count, least and greatest value as text."""
    ordered = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType, T.BinaryType, T.VariantType))]
    row = df.agg(*[F.struct(F.count(c).alias("n"), F.min(c).cast("string").alias("lo"), F.max(c).cast("string").alias("hi")).alias(c) for c in ordered])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}.n").alias("nonnull"), F.col(f"{c}.lo").alias("least"), F.col(f"{c}.hi").alias("greatest")) for c in ordered])))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def canonical(c: Column, kind: T.DataType) -> Column:
    """A value's text, alike on every system: numbers without trailing zeros, times to the microsecond, NULL as a mark."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        d = c.cast("double")  # whole numbers without a point, others as the shortest text that reads back alike
        text = F.when((d == F.floor(d)) & (F.abs(d) < 1e15), F.floor(d).cast("string")).otherwise(d.cast("string"))
    elif isinstance(kind, T.DecimalType):
        text = F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    elif isinstance(kind, T.BooleanType):
        text = F.when(c, "1").otherwise("0")
    elif isinstance(kind, T.BinaryType):
        text = F.hex(c)
    elif isinstance(kind, (T.ArrayType, T.StructType)):
        text = F.to_json(c)
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("\x00"))


def _cells(left: DataFrame, right: DataFrame, columns: list[str]) -> tuple[dict[str, Column], dict[str, Column]]:
    """For each column, what both sides hash: the value itself if both have one type, else its canonical text."""
    kinds = [{f.name.lower(): f.dataType for f in df.schema.fields} for df in (left, right)]
    out = ({}, {})
    for c in columns:
        a, b = (k[c.lower()] for k in kinds)
        for cells, kind in zip(out, (a, b), strict=True):
            cells[c] = canonical(F.col(c), kind) if a != b else F.col(c) + F.lit(0.0).cast(kind) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.col(c)
    return out


def _row_digest(cells: dict[str, Column]) -> Column:
    """64 bits of a whole row. NULLs don't change a hash, so that their places are hashed as well."""
    values = list(cells.values())
    return F.xxhash64(*values, *[v.isNull() for v in values])


def _digests(df: DataFrame, keys: list[str], key_cells: dict[str, Column], cells: dict[str, Column]) -> DataFrame:
    """keys, bucket and row digest; rows with a NULL in the key, which equals nothing, are in the last bucket."""
    null = F.lit(False)
    for k in keys:
        null |= F.col(k).isNull()
    bucket = F.when(null, F.lit(BUCKETS)).otherwise(F.pmod(F.xxhash64(*key_cells.values()), F.lit(BUCKETS))).cast("int")
    return df.select(*keys, *[c for c in df.columns if c not in keys], bucket.alias("__bucket"), _row_digest({**key_cells, **cells}).alias("__digest"))


def _digested(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, list[str], dict[str, Column], dict[str, Column]]:
    columns, _ = pairs(left, right, keys)
    (a, b), (ka, kb) = _cells(left, right, columns), _cells(left, right, keys)
    return _digests(left, keys, ka, a), _digests(right, keys, kb, b), columns, a, b


def bucket_diff(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Level 1: the buckets (of BUCKETS, by key; the one after them has NULL keys) that differ, and their rows on each
    side. Row digests are summed and combined by exclusive or, whatever their order. For tables that differ in too much
    to list, this is the answer that stays small."""
    a, b = _digested(left, right, keys)[:2]

    def sums(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy("__bucket").agg(
            F.count(F.lit(1)).alias(f"n_{side}"), F.bit_xor("__digest").alias(f"x_{side}"), F.sum(F.shiftright("__digest", 32)).alias(f"s_{side}")
        ).withColumnRenamed("__bucket", f"b_{side}")

    x, y = sums(a, "left"), sums(b, "right")
    both = x.join(y, F.col("b_left") == F.col("b_right"), "full")
    same = F.col("n_left").eqNullSafe(F.col("n_right")) & F.col("x_left").eqNullSafe(F.col("x_right")) & F.col("s_left").eqNullSafe(F.col("s_right"))
    bucket = F.coalesce("b_left", "b_right")
    return both.where(~same | (bucket == BUCKETS)).select(bucket.alias("bucket"), F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))


def digest_diff(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose rows differ or are on one side only. status: only_left, only_right or differs; columns: those that
    differ. NULL keys equal nothing, as in ``keyed_summary``.

    The buckets that differ are found first; of their rows, keys and one digest each meet; columns are compared for the
    rows alone whose digests differ."""
    odd = [r["bucket"] for r in bucket_diff(left, right, keys).select("bucket").collect()]  # BUCKETS + 1 at most
    a, b, columns, cells_a, cells_b = _digested(left, right, keys)
    if len(odd) <= BUCKETS:
        a, b = a.where(F.col("__bucket").isin(odd)), b.where(F.col("__bucket").isin(odd))
    x = a.select(*[F.col(k).alias(f"l_{k}") for k in keys], F.col("__digest").alias("l"))
    y = b.select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col("__digest").alias("r"))
    met = x.join(y, [x[f"l_{k}"] == y[f"r_{k}"] for k in keys], "full")
    odd_rows = met.where(~F.col("l").eqNullSafe(F.col("r")))
    status = F.when(F.col("r").isNull(), "only_left").when(F.col("l").isNull(), "only_right").otherwise("differs")
    found = odd_rows.select(*[F.coalesce(f"l_{k}", f"r_{k}").alias(k) for k in keys], status.alias("status"))
    if not columns:
        return found.where("status <> 'differs'").withColumn("columns", F.lit(""))
    # columns of the rows that differ: these rows are written, so that the planner knows how few they are
    found = written(found)
    changed = found.where("status = 'differs'").select(*keys).distinct()
    cells = lambda df, made, s: df.select(*[F.col(k).alias(f"{s}_{k}") for k in keys], F.struct(*[F.when(c.isNotNull(), F.xxhash64(c)).alias(n) for n, c in made.items()]).alias(s))
    p, q = cells(left, cells_a, "l"), cells(right, cells_b, "r")
    both = changed.join(p, [changed[k] == p[f"l_{k}"] for k in keys]).join(q, [changed[k] == q[f"r_{k}"] for k in keys])
    names = F.array_join(F.filter(F.array(*[F.when(~F.col("l")[c].eqNullSafe(F.col("r")[c]), F.lit(c)) for c in columns]), lambda c: c.isNotNull()), ",")
    differs = both.select(*[F.col(k) for k in keys], F.lit("differs").alias("status"), names.alias("columns")).where(F.col("columns") != "")
    return found.where("status <> 'differs'").withColumn("columns", F.lit("")).unionByName(differs)
