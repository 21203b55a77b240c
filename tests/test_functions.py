"""Exact functions against DuckDB on drawn values, and rules that raise."""

import datetime as dt

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import numeric as N
from sparkloom.functions import temporal as D
from sparkloom.functions import text as S
from sparkloom.functions.policy import FidelityPolicy

quick = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def both(spark, values, kind, column, sql):
    """Answers of both engines for a list of values."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind[0]}")
    got = [r[0] for r in df.select("i", column.alias("v")).orderBy("i").select("v").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE TABLE t(i INTEGER, x {kind[1]})")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(values)))
    want = [r[0] for r in con.execute(f"SELECT {sql} FROM t ORDER BY i").fetchall()]
    return got, want


@quick
@given(st.lists(st.one_of(st.none(), st.floats(-1e9, 1e9), st.integers(-10**6, 10**6).map(lambda n: n / 1000)), min_size=1, max_size=60))
def test_round(spark, values):
    for digits in (0, 2):
        got, want = both(spark, values, ("double", "DOUBLE"), N.round_double(F.col("x"), digits), f"round(x, {digits}) + 0")
        assert got == want


@quick
@given(st.lists(st.one_of(st.none(), st.floats(-1e9, 1e9), st.integers(-999, 999).map(lambda n: n / 2)), min_size=1, max_size=60))
def test_double_to_int(spark, values):
    got, want = both(spark, values, ("double", "DOUBLE"), N.double_to_int(F.col("x")), "CAST(x AS INTEGER)")
    assert got == want


@quick
@given(st.lists(st.text("aAbé😀 ,", max_size=8), min_size=1, max_size=40), st.integers(-5, 6), st.integers(-4, 5))
def test_substring(spark, values, start, length):
    got, want = both(spark, values, ("string", "VARCHAR"), S.substring(F.col("x"), start, length), f"substring(x, {start}, {length})")
    assert got == want
    for f in ("left", "right"):
        got, want = both(spark, values, ("string", "VARCHAR"), getattr(S, f)(F.col("x"), length), f'"{f}"(x, {length})')
        assert got == want


@quick
@given(st.lists(st.datetimes(dt.datetime(1900, 1, 1), dt.datetime(2100, 1, 1)), min_size=1, max_size=40))
def test_dates(spark, values):
    at = F.lit("2001-05-31 12:30:15").cast("timestamp_ntz")
    cases = [(D.date_trunc(u, F.col("x")), f"CAST(date_trunc('{u}', x) AS TIMESTAMP)") for u in ("week", "decade", "hour")]
    cases += [(D.date_diff(u, at, F.col("x")), f"date_diff('{u}', TIMESTAMP '2001-05-31 12:30:15', x)") for u in ("year", "month", "week", "hour", "second", "century")]
    cases += [(D.add_interval(F.col("x"), i), f"x + INTERVAL '{i}'") for i in ("1 month", "-13 months", "1 year 3 days 2 hours")]
    cases += [(D.date_part(u, F.col("x")), f"CAST(date_part('{u}', x) AS BIGINT)") for u in ("dow", "week", "isoyear", "century")]
    for column, sql in cases:
        got, want = both(spark, values, ("timestamp_ntz", "TIMESTAMP"), column, sql)
        assert got == want, sql


def test_factorial_and_shifts_raise(spark):
    one = spark.range(1)
    for bad in (N.factorial(F.lit(34)), N.shift_left(F.lit(1).cast("bigint"), F.lit(-1)), N.shift_left(F.lit(2**40), F.lit(40))):
        with pytest.raises(Exception):
            one.select(bad).collect()


def test_interval_texts():
    assert D.Interval.parse("1 year 2 months -3 days 04:05:06.5") == D.Interval(14, -3, 14_706_500_000)
    with pytest.raises(ValueError):
        D.Interval.parse("3 moons")


def test_policy():
    p = FidelityPolicy(disable=frozenset({"round-double"}))
    assert not p.active("round-double") and p.active("avg-double") and not FidelityPolicy("native").active("avg-double")
    with pytest.raises(ValueError):
        FidelityPolicy(disable=frozenset({"null-order"}))
