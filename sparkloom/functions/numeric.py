"""Arithmetic, rounding, casts and bit functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")


def divide(a: Column, b: Column) -> Column:
    """Floating division without errors: x/0 is an infinity of x's sign, 0/0 is NaN."""
    a, b = a.cast("double"), b.cast("double")
    zero = F.when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF)).when(a == 0, F.lit(float("nan")))
    return F.when(b == 0, zero).otherwise(a / F.when(b != 0, b))


def int_divide(a: Column, b: Column, to: str = "int") -> Column:
    """Truncating division; NULL on 0."""
    return F.call_function("div", a, F.nullif(b, F.lit(0))).cast(to)


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the dividend's sign; NULL on 0."""
    return a % F.nullif(b, F.lit(0))


def sign(x: Column) -> Column:
    return F.signum(x).cast("tinyint")


def round_double(x: Column, digits: int = 0) -> Column:
    """Scale, round half away from zero, unscale, in double arithmetic: 0.285 rounds to 0.28."""
    p = F.lit(float(10 ** abs(digits)))
    x = x.cast("double")
    scaled = x * p if digits >= 0 else x / p
    rounded = F.signum(x) * F.floor(F.abs(scaled) + 0.5).cast("double")
    out = rounded / p if digits >= 0 else rounded * p
    # beyond 2^53 there is nothing to round; floor would not fit a long
    return F.when(F.isnan(x) | (F.abs(scaled) >= 2.0**52), x).otherwise(out)


def trunc(x: Column, digits: int = 0) -> Column:
    p = F.lit(float(10**digits))
    x = x.cast("double")
    scaled = x * p
    return F.when(F.abs(scaled) >= 2.0**52, x).otherwise(F.when(scaled < 0, F.ceil(scaled)).otherwise(F.floor(scaled)).cast("double") / p)


def double_to_int(x: Column, to: str = "int") -> Column:
    """Round half to even."""
    return F.rint(x).cast(to)


def decimal_to_int(x: Column, to: str = "int") -> Column:
    """Round half away from zero."""
    return F.round(x, 0).cast(to)


def double_to_decimal(x: Column, precision: int, scale: int) -> Column:
    return round_double(x, scale).cast(T.DecimalType(precision, scale))


_RANGES = {"tinyint": 7, "smallint": 15, "int": 31, "bigint": 63}


def try_int(text: Column, to: str = "int") -> Column:
    """Text to an integer: '12.7' is 13, '1e3' is 1000, anything else is NULL."""
    trimmed = F.trim(text)
    d = F.rint(trimmed.try_cast("double"))
    top = float(2 ** _RANGES[to])
    fits = (d >= -top) & (d < top)
    return F.coalesce(trimmed.try_cast(to), F.when(fits, d).try_cast(to))


def try_date(text: Column) -> Column:
    return F.when(F.trim(text).rlike(r"^\d{1,4}-\d{1,2}-\d{1,2}$"), F.trim(text).try_cast("date"))


def double_text(x: Column) -> Column:
    """Doubles below 1e16 without an exponent: 10000000000.0."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(whole, F.concat(x.cast("long").cast("string"), F.lit(".0"))).otherwise(x.cast("string"))


def log(x: Column, base: Column | None = None) -> Column:
    """One argument: base 10."""
    return F.log10(x) if base is None else F.log(x) / F.log(base)


def factorial(n: Column) -> Column:
    """0..33 exactly, as DECIMAL(38,0); an error beyond."""
    product, value = [], 1
    for i in range(34):
        value = value * i if i else 1
        product.append(F.lit(str(value)).cast("decimal(38,0)"))
    table = F.array(*product)
    return F.when(n.between(0, 33), F.get(table, n)).when(n.isNull(), F.lit(None)).otherwise(F.raise_error(F.lit("factorial is out of range")).cast("decimal(38,0)"))


def shift_left(a: Column, n: Column, to: str = "bigint") -> Column:
    """a times 2^n, exactly; an error if it does not fit or n is negative."""
    powers = F.array(*[F.lit(str(2**i)).cast("decimal(20,0)") for i in range(64)])
    product = a.cast("decimal(18,0)") * F.get(powers, n)
    return F.when(a.isNull() | n.isNull(), F.lit(None)).when((n >= 0) & (n < 64), product.cast(to)).otherwise(F.raise_error(F.lit("shift count is out of range")).cast(to))


def shift_right(a: Column, n: Column, width: int = 64) -> Column:
    """Keeps the sign; 0 for counts outside 0 to width - 1."""
    return F.when((n >= 0) & (n < width), F.call_function("shiftright", a, F.when((n >= 0) & (n < width), n).otherwise(0).cast("int"))).when(n.isNotNull(), F.lit(0)).cast("bigint")


def gcd(a: Column, b: Column) -> Column:
    """Euclid's steps, at most 92 for 64 bits."""
    state = F.struct(F.abs(a).cast("long").alias("x"), F.abs(b).cast("long").alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.when(s["y"] != 0, s["y"])).alias("y")))
    return F.when(a.isNotNull() & b.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(92)), state, step, lambda s: s["x"]))


def lcm(a: Column, b: Column) -> Column:
    g = gcd(a, b)
    return F.when(g == 0, F.lit(0).cast("long")).otherwise(F.abs((a / F.when(g != 0, g)).cast("long") * b))


def is_nan(x: Column) -> Column:
    return F.when(x.isNotNull(), F.isnan(x))


def bit_count(x: Column, width: int = 64) -> Column:
    """Set bits of a two's complement of this width."""
    x = x.cast("bigint")
    return F.bit_count(x if width == 64 else x.bitwiseAND(F.lit((1 << width) - 1))).cast("bigint")


def is_inf(x: Column) -> Column:
    return F.abs(x) == INF


def is_finite(x: Column) -> Column:
    return ~(F.isnan(x) | is_inf(x))


def even(x: Column) -> Column:
    """The next even number away from zero."""
    return F.signum(x) * F.ceil(F.abs(x) / 2) * 2.0


def bankers_round(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def product(values: Column) -> Column:
    """Of an array of doubles, in order."""
    return F.aggregate(values, F.lit(1.0), lambda a, x: a * x)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def sign_bit(x: Column) -> Column:
    """Negative zero has it too."""
    return x.cast("double").cast("string").startswith("-")
