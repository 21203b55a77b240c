"""Aggregates whose types or formulas differ from Spark's own, and statistics that Spark lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sum_wide(x: Column) -> Column:
    """Of integers, without overflow."""
    return F.sum(x.cast("decimal(38,0)"))


def avg_double(x: Column) -> Column:
    return F.avg(x.cast("double"))


def quantile_cont(x: Column, q: float) -> Column:
    return F.percentile(x.cast("double"), F.lit(q))


def quantile_disc(x: Column, q: float, to: str) -> Column:
    """A value of the column, in its own type."""
    return F.get(F.array_sort(F.collect_list(x)), F.greatest(F.ceil(F.count(x) * F.lit(q)).cast("int") - 1, F.lit(0))).cast(to)


def decimal_median(df: DataFrame, keys: list[str], x: str, precision: int = 18, scale: int = 2) -> DataFrame:
    """Exact medians of decimals by rank, cut to their scale."""
    w = Window.partitionBy(*keys).orderBy(F.col(x).asc_nulls_last())
    n = F.count(x).over(Window.partitionBy(*keys))
    ranked = df.where(F.col(x).isNotNull()).withColumn("__r", F.row_number().over(w)).withColumn("__n", n)
    middle = (F.col("__r") == F.floor((F.col("__n") + 1) / 2)) | (F.col("__r") == F.floor(F.col("__n") / 2) + 1)
    half = (F.min(F.when(middle, F.col(x))).cast("double") + F.max(F.when(middle, F.col(x))).cast("double")) / 2
    return ranked.groupBy(*keys).agg(half.alias("__m")).select(*keys, F.expr(f"cast(__m as decimal({precision},{scale}))").alias("median"))


def skewness(x: Column) -> Column:
    n = F.count(x).cast("double")
    return F.when(n >= 3, F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(x))


def kurtosis(x: Column) -> Column:
    n = F.count(x).cast("double")
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def sem(x: Column) -> Column:
    return F.stddev_pop(x) / F.sqrt(F.count(x))


def product(x: Column) -> Column:
    """Of doubles: sign and sum of logarithms would lose digits, so the values are multiplied one by one."""
    return F.aggregate(F.collect_list(x.cast("double")), F.lit(1.0), lambda a, b: a * b)


def geomean(x: Column) -> Column:
    return F.exp(F.avg(F.log(x)))


def weighted_avg(x: Column, w: Column) -> Column:
    return F.sum(x * w) / F.sum(F.when(x.isNotNull(), w))


def entropy(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Of the distribution of values, in bits."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("c"))
    total = F.sum("c").over(Window.partitionBy(*keys))
    p = counts.withColumn("p", F.col("c") / total)
    return p.groupBy(*keys).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def mad(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Median of the absolute deviations from the median."""
    medians = df.groupBy(*keys).agg(F.median(F.col(x)).alias("m"))
    joined = df.join(medians, keys) if keys else df.crossJoin(medians)
    return joined.groupBy(*keys).agg(F.median(F.abs(F.col(x) - F.col("m"))).alias("mad"))


def mode(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """The most frequent value; the least of several."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy(*keys).agg(F.min_by(x, F.struct(-F.col("c"), F.col(x))).alias("mode"))


def histogram(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(x, "c")))).alias("histogram"))


def string_agg(x: str, separator: str = ",", order: str | None = None) -> Column:
    """Skips NULLs; NULL over none."""
    return F.expr(f"listagg({x}, '{separator}') within group (order by {order or x})")


def arg_min(x: Column, by: Column, at: Column) -> Column:
    """x of the row with the least by, without rows where either is NULL; of equal rows the one with the least at."""
    return F.min_by(x, F.when(x.isNotNull() & by.isNotNull(), F.struct(by, at)))


def arg_max(x: Column, by: Column, at: Column) -> Column:
    """x of the row with the greatest by, a double (NaN is the greatest); rows that are NULL or equal as in arg_min."""
    by = by.cast("double")
    return F.min_by(x, F.when(x.isNotNull() & by.isNotNull(), F.struct(~F.isnan(by), -by, at)))


def exact_sum(x: Column) -> Column:
    """Of doubles below 1e37: whole parts are summed as decimals, so that only the fractions round."""
    x = x.cast("double")
    fraction = x % F.lit(1.0)
    return F.sum((x - fraction).cast("decimal(38,0)")).cast("double") + F.sum(fraction)


def exact_avg(x: Column) -> Column:
    return exact_sum(x) / F.count(x)


def bitstring(x: Column, low: int, high: int) -> Column:
    """A place for each number of the range: 1 if it occurs. State is as large as the range, whatever the rows; a number
    outside the range is an error."""
    checked = F.when(x.between(low, high) | x.isNull(), x).otherwise(F.raise_error(F.lit("value is out of the range")).cast("int"))
    seen = F.collect_set(checked.cast("int"))
    return F.array_join(F.transform(F.sequence(F.lit(low), F.lit(high)), lambda i: F.array_contains(seen, i).cast("int").cast("string")), "")


def approx_top_k(x: str, k: int) -> Column:
    """The most frequent values, by a bounded sketch."""
    return F.expr(f"transform(approx_top_k({x}, {k}), e -> e.item)")
