"""As-of, range and interval joins, and broadcasts behind a size check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20


def small_side(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint only if the plan's own size estimate, which is an upper bound for scans, is small."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= most_bytes else df


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, take: list[str], inclusive: bool = True, salt_seconds: int | None = None) -> DataFrame:
    """Each left row with the last right row of its key at or before its time; NULLs where there is none.

    Both sides are put in one order and the last right row is carried forward: one shuffle by key, and no row of one side
    meets more than one of the other. For keys with very many rows, salt_seconds cuts time into slots; each slot starts
    from the last right row of the slots before it, which is carried over slot by slot on one row each.
    """
    right_first = 0 if inclusive else 1
    payload = F.struct(*[F.col(c) for c in take])
    a = left.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col(left_at).alias("__t"), F.lit(1 - right_first).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).alias("__take"))
    b = right.where(F.col(right_at).isNotNull()).select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col(right_at).alias("__t"), F.lit(right_first).alias("__side"), F.lit(None).alias("__row"), payload.alias("__take"))
    keys = [f"__k{i}" for i in range(len(by))]
    union = b.withColumn("__row", F.lit(None).cast(a.schema["__row"].dataType)).unionByName(a.withColumn("__take", F.lit(None).cast(b.schema["__take"].dataType)))
    if salt_seconds is None:
        carry = F.last("__take", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0))
        found = union.withColumn("__found", carry)
    else:
        slot = F.floor(F.unix_micros(F.col("__t").cast("timestamp")) / (salt_seconds * 1_000_000))
        union = union.withColumn("__slot", slot)
        ends = union.where(F.col("__take").isNotNull()).groupBy(*keys, "__slot").agg(F.max_by("__take", "__t").alias("__end"))
        slots = union.select(*keys, "__slot").distinct().join(ends, [*keys, "__slot"], "left")
        before = F.last("__end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1))
        starts = slots.withColumn("__before", before).select(*[F.col(k).alias(f"{k}s") for k in keys], F.col("__slot").alias("__slot_s"), "__before")
        same = [F.col(k).eqNullSafe(F.col(f"{k}s")) for k in keys] + [F.col("__slot").eqNullSafe(F.col("__slot_s"))]
        carry = F.last("__take", ignorenulls=True).over(Window.partitionBy(*keys, "__slot").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0))
        found = union.withColumn("__inside", carry).join(starts, same, "left").withColumn("__found", F.coalesce("__inside", "__before"))
    return found.where(F.col("__row").isNotNull()).select("__row.*", *[F.col(f"__found.{c}").alias(c) for c in take])


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float, by: list[str] | None = None) -> DataFrame:
    """Points inside ranges (ends included; NULL high is open). Both sides are cut into bins of a width, so that the
    join is an equi-join on the bin; a range is copied to each bin it reaches, open ranges to the last bin of points."""
    by = by or []
    top = points.agg(F.max(F.floor(F.col(at) / width)).alias("__top"))
    binned = points.withColumn("__bin", F.floor(F.col(at) / width))
    reach = F.sequence(F.floor(F.col(low) / width), F.greatest(F.least(F.coalesce(F.floor(F.col(high) / width), F.col("__top")), F.col("__top")), F.floor(F.col(low) / width)))
    copies = ranges.crossJoin(F.broadcast(top)).where(F.col(high).isNull() | (F.col(high) >= F.col(low))).withColumn("__bin", F.explode(reach)).drop("__top")
    joined = binned.join(copies, [*by, "__bin"])
    return joined.where((F.col(at) >= F.col(low)) & (F.col(high).isNull() | (F.col(at) <= F.col(high)))).drop("__bin")


def interval_join(facts: DataFrame, history: DataFrame, on: Column, at: str, valid_from: str, valid_to: str, how: str = "left") -> DataFrame:
    """Validity ranges: an equality on the key, with the range as a residual."""
    inside = (F.col(at) >= F.col(valid_from)) & (F.col(valid_to).isNull() | (F.col(at) <= F.col(valid_to)))
    return facts.join(history, on & inside, how)


def salted_join(big: DataFrame, other: DataFrame, keys: list[str], salts: int, how: str = "inner") -> DataFrame:
    """An equi-join whose hot keys are dealt over salts: the other side is copied to each salt."""
    if how not in ("inner", "left"):
        raise ValueError("only inner and left joins can be salted on the left")
    a = big.withColumn("__salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    b = other.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return a.join(b, [*keys, "__salt"], how).drop("__salt")
