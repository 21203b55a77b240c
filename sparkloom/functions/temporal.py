"""Dates, timestamps and intervals. Timestamps are zoneless."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

NTZ = "timestamp_ntz"
DAY_US = 86_400_000_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970, of a zoneless timestamp or a date. The session's zone is UTC."""
    return F.unix_micros(ts.cast(NTZ).cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast(NTZ)


@dataclass(frozen=True)
class Interval:
    """Three independent parts, added in this order."""

    months: int = 0
    days: int = 0
    micros: int = 0

    # fixed values: units of interval texts
    MONTHS = {"month": 1, "mon": 1, "quarter": 3, "year": 12, "yr": 12, "decade": 120, "century": 1200, "millennium": 12000}
    DAYS = {"day": 1, "week": 7}
    MICROS = {"microsecond": 1, "us": 1, "millisecond": 1000, "ms": 1000, "second": 1_000_000, "sec": 1_000_000, "minute": 60_000_000, "min": 60_000_000, "hour": 3_600_000_000, "hr": 3_600_000_000}

    @classmethod
    def parse(cls, text: str) -> Interval:
        """'1 month 2 days -3 hours', '01:30:00', or both."""
        months = days = us = 0
        rest = text.strip()
        if clock := re.search(r"(-?)(\d+):(\d\d)(?::(\d\d)(?:\.(\d{1,6}))?)?$", rest):
            sign, h, m, s, frac = clock.groups()
            value = (int(h) * 3600 + int(m) * 60 + int(s or 0)) * 1_000_000 + int((frac or "0").ljust(6, "0"))
            us += -value if sign else value
            rest = rest[: clock.start()]
        for number, unit in re.findall(r"(-?\d+)\s*([A-Za-z]+)", rest):
            unit = unit.lower()
            unit = unit if unit in ("us", "ms") else {"centuries": "century", "millennia": "millennium"}.get(unit, unit.removesuffix("s"))
            n = int(number)
            if unit in cls.MONTHS:
                months += n * cls.MONTHS[unit]
            elif unit in cls.DAYS:
                days += n * cls.DAYS[unit]
            elif unit in cls.MICROS:
                us += n * cls.MICROS[unit]
            else:
                raise ValueError(f"unknown interval unit {unit}")
        if re.sub(r"(-?\d+)\s*([A-Za-z]+)", "", rest).strip():
            raise ValueError(f"not an interval: {text}")
        return cls(months, days, us)

    def __mul__(self, k: int) -> Interval:
        return Interval(self.months * k, self.days * k, self.micros * k)

    def __neg__(self) -> Interval:
        return self * -1

    def __add__(self, other: Interval) -> Interval:
        return Interval(self.months + other.months, self.days + other.days, self.micros + other.micros)


def add_interval(x: Column, interval: Interval | str) -> Column:
    """Months, then days, then the time; a date becomes a timestamp; month ends are clamped."""
    iv = Interval.parse(interval) if isinstance(interval, str) else interval
    ts = x.cast(NTZ)
    if iv.months:
        ts = ts + F.make_ym_interval(F.lit(0), F.lit(iv.months))
    if iv.days or iv.micros:
        ts = from_micros(micros(ts) + iv.days * DAY_US + iv.micros)
    return ts


def date_minus_date(a: Column, b: Column) -> Column:
    return F.datediff(a, b).cast("bigint")


def _floor_year(ts: Column, n: int) -> Column:
    return F.floor(F.year(ts) / n).cast("int") * n


def date_trunc(unit: str, x: Column) -> Column:
    """A zoneless timestamp; weeks start on Monday; decades and more by the floor of the year."""
    ts = x.cast(NTZ)
    if unit in ("decade", "century", "millennium"):
        n = {"decade": 10, "century": 100, "millennium": 1000}[unit]
        return F.make_date(_floor_year(ts, n), F.lit(1), F.lit(1)).cast(NTZ)
    return F.date_trunc(unit, ts).cast(NTZ)


def date_part(unit: str, x: Column) -> Column:
    ts = x.cast(NTZ)
    whole = {
        "year": lambda: F.year(ts), "month": lambda: F.month(ts), "day": lambda: F.dayofmonth(ts), "quarter": lambda: F.quarter(ts), "hour": lambda: F.hour(ts),
        "minute": lambda: F.minute(ts), "doy": lambda: F.dayofyear(ts), "dow": lambda: F.dayofweek(ts) - 1, "isodow": lambda: F.weekday(ts) + 1, "week": lambda: F.weekofyear(ts),
        "isoyear": lambda: F.date_part(F.lit("yearofweek"), ts), "yearweek": lambda: F.date_part(F.lit("yearofweek"), ts) * 100 + F.weekofyear(ts),
        "second": lambda: F.second(ts), "millisecond": lambda: F.floor(F.pmod(micros(ts), F.lit(60_000_000)) / 1000), "microsecond": lambda: F.pmod(micros(ts), F.lit(60_000_000)),
        "decade": lambda: F.floor(F.year(ts) / 10), "century": lambda: F.floor((F.year(ts) - 1) / 100) + 1, "millennium": lambda: F.floor((F.year(ts) - 1) / 1000) + 1,
        "era": lambda: F.when(F.year(ts) > 0, 1).otherwise(0),
    }
    if unit in whole:
        return whole[unit]().cast("bigint")
    if unit == "epoch":
        return micros(ts) / 1e6
    if unit == "julian":
        return F.datediff(ts, F.lit("1970-01-01").cast("date")) + F.lit(2440588) + F.pmod(micros(ts), F.lit(DAY_US)) / float(DAY_US)
    raise ValueError(f"unknown part {unit}")


def date_diff(unit: str, a: Column, b: Column) -> Column:
    """Boundaries crossed from a to b; weeks are whole periods of 7 days."""
    a, b = a.cast(NTZ), b.cast(NTZ)
    if unit == "day":
        out = F.datediff(b, a)
    elif unit == "week":
        out = F.call_function("div", F.datediff(b, a), F.lit(7))
    elif unit == "month":
        out = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    elif unit == "quarter":
        out = (F.year(b) - F.year(a)) * 4 + F.quarter(b) - F.quarter(a)
    elif unit in ("year", "decade", "century", "millennium"):
        n = {"year": 1, "decade": 10, "century": 100, "millennium": 1000}[unit]
        out = F.floor(F.year(b) / n) - F.floor(F.year(a) / n)
    else:
        size = Interval.MICROS[unit]
        out = F.floor(micros(b) / size) - F.floor(micros(a) / size) if size > 1 else micros(b) - micros(a)
    return out.cast("bigint")


def date_sub(unit: str, a: Column, b: Column) -> Column:
    """Whole periods from a to b."""
    return F.timestamp_diff(unit, a.cast("timestamp"), b.cast("timestamp"))


def age_parts(a: Column, b: Column) -> dict[str, Column]:
    """a - b as years, months, days and microseconds, borrowing from the greater part; negative if a is before b."""
    a, b = a.cast(NTZ), b.cast(NTZ)
    sign = F.when(a < b, -1).otherwise(1)
    hi, lo = F.greatest(a, b), F.least(a, b)
    months = (F.year(hi) - F.year(lo)) * 12 + F.month(hi) - F.month(lo)
    time_hi, time_lo = F.pmod(micros(hi), F.lit(DAY_US)), F.pmod(micros(lo), F.lit(DAY_US))
    short_time = (time_hi < time_lo).cast("int")
    days = F.dayofmonth(hi) - F.dayofmonth(lo) - short_time
    short_days = (days < 0).cast("int")
    months_kept = months - short_days
    # a borrowed month is as long as the month of the earlier time (of the one before hi, when counting forward)
    borrowed = F.dayofmonth(F.last_day(lo))
    days_kept = F.when(days < 0, days + borrowed).otherwise(days)
    us = time_hi - time_lo + short_time * F.lit(DAY_US)
    return {"months": (sign * months_kept).cast("bigint"), "days": (sign * days_kept).cast("bigint"), "micros": sign * us}


def normalized_micros(interval: Interval) -> int:
    """A month counts as 30 days."""
    return (interval.months * 30 + interval.days) * DAY_US + interval.micros


def day_name(x: Column) -> Column:
    return F.date_format(x, "EEEE")


def month_name(x: Column) -> Column:
    return F.date_format(x, "MMMM")


def time_bucket(width: str, ts: Column) -> Column:
    """Buckets of a fixed width up to a day; their origin lies on a Monday, 2000-01-03, for days and more."""
    iv = Interval.parse(width)
    if iv.months:
        months = (F.year(ts) - 2000) * 12 + F.month(ts) - 1
        start = F.floor(months / iv.months) * iv.months
        return F.make_date((F.floor(start / 12) + 2000).cast("int"), (F.pmod(start, F.lit(12)) + 1).cast("int"), F.lit(1)).cast(NTZ)
    size, origin = iv.days * DAY_US + iv.micros, 10_959 * DAY_US  # 2000-01-03
    return from_micros(F.floor((micros(ts) - origin) / size) * size + origin)
