"""Durations, calendar floors, flux bins, local time and seasons."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UTC_OFFSET = -7  # hours, without daylight saving
US = 1_000_000
#: Seconds of a unit.
UNIT_SECONDS = {"us": 1e-6, "ms": 1e-3, "s": 1, "sec": 1, "t": 60, "min": 60, "h": 3600, "d": 86400, "w": 604800}
#: Calendar unit of a period frequency.
PERIOD_UNITS = {
    "min": "MINUTE",
    "t": "MINUTE",
    "h": "HOUR",
    "d": "DAY",
    "w": "WEEK",
    "m": "MONTH",
    "q": "QUARTER",
    "y": "YEAR",
    "a": "YEAR",
}


def _split(freq: str) -> tuple[float, str]:
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)?\s*([A-Za-z]+)\s*", freq)
    if not m:
        raise ValueError(f"not a frequency: {freq!r}")
    return float(m[1] or 1), m[2]


def duration_us(text: str) -> int:
    """Microseconds of "10s", "14d", "2.8h"."""
    n, unit = _split(text)
    if unit.lower() not in UNIT_SECONDS:
        raise ValueError(f"not a fixed duration: {text!r}")
    return round(n * UNIT_SECONDS[unit.lower()] * US)


def freq_hours(freq: str) -> float:
    """Hours of a fixed frequency; calendar ones (W, MS, ...) raise."""
    n, unit = _split(freq)
    if unit.lower() not in UNIT_SECONDS or unit.lower() == "w" or unit == "MS":
        raise ValueError(f"not a fixed frequency: {freq!r}")
    return n * UNIT_SECONDS[unit.lower()] / 3600


def floor_period(ts: Column, freq: str) -> Column:
    """Start of the calendar period that holds ``ts``.  The multiplier does not count ("12h": the hour)."""
    _, unit = _split(freq)
    if unit.lower() not in PERIOD_UNITS:
        raise ValueError(f"not a period frequency: {freq!r}")
    return F.date_trunc(PERIOD_UNITS[unit.lower()], ts).cast("timestamp_ntz")


def week_start(ts: Column, start: str, weeks: int) -> Column:
    """Start of the bin of ``weeks`` weeks that holds ``ts``, as ``flux_bins`` lays them from the first Sunday on or after ``start``."""
    day = datetime.fromisoformat(str(start)).date()
    first = day + timedelta(days=(6 - day.weekday()) % 7)
    width, origin = weeks * 604_800 * US, F.lit((first - date(1970, 1, 1)).days * 86_400 * US)
    return F.timestamp_micros(micros(ts) - F.pmod(micros(ts) - origin, F.lit(width))).cast("timestamp_ntz")


def truncated(unit: str | Callable[[Column], Column], ts: Column) -> Column:
    """Start of the period of ``ts``: a calendar unit, or whatever a function makes of it."""
    return (F.date_trunc(unit, ts) if isinstance(unit, str) else unit(ts)).cast("timestamp_ntz")


def tumbling(ts: Column, freq: str) -> Column:
    """Start of the fixed window of full length ``freq`` (the multiplier counts here)."""
    width = duration_us(freq)
    us = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_micros(us - F.pmod(us, F.lit(width))).cast("timestamp_ntz")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def local_time(ts: Column, offset: int = UTC_OFFSET) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(offset))


def utc_hours(hours: list[int], offset: int = UTC_OFFSET) -> list[int]:
    return [(h - offset) % 24 for h in hours]


def season(ts: Column) -> Column:
    quarter = F.floor(F.pmod(F.month(ts), F.lit(12)) / 3)
    return F.element_at(F.array(*map(F.lit, ("DJF", "MAM", "JJA", "SON"))), (quarter + 1).cast("int"))


def decimal_year(ts: Column) -> Column:
    days = F.when(F.dayofyear(F.make_date(F.year(ts), F.lit(12), F.lit(31))) == 366, 366).otherwise(365)
    return F.year(ts) + (F.dayofyear(ts) - 1) / days


def exact_year(ts: Column) -> Column:
    """Decimal year to the microsecond: the share of the year that has passed is counted from its first moment."""
    start = lambda more: micros(F.make_date(F.year(ts) + more, F.lit(1), F.lit(1)).cast("timestamp_ntz"))
    return F.year(ts) + (micros(ts) - start(0)) / (start(1) - start(0))


def flux_bins(spark: SparkSession, start: str, end: str, freq: str = "MS") -> DataFrame:
    """(bin_start, bin_end) of the left-closed bins that lie wholly in [start, end]; partial edges go."""
    n, unit = _split(freq)
    #: Step of a bin frequency and the unit its edges fall on.
    steps = {"MS": ("MONTH", "MONTH"), "QS": ("QUARTER", "QUARTER"), "YS": ("YEAR", "YEAR"), "W": ("WEEK", "DAY"), "D": ("DAY", None), "H": ("HOUR", None)}
    key = unit if unit in steps else unit.upper()
    if key not in steps:
        raise ValueError(f"not a bin frequency: {freq!r}")
    step, edge = steps[key]
    step_sql = f"INTERVAL {int(n) * (3 if step == 'QUARTER' else 1)} {'MONTH' if step == 'QUARTER' else step}"
    lo, hi = (f"timestamp_ntz'{datetime.fromisoformat(str(x)).isoformat(sep=' ')}'" for x in (start, end))
    if key == "W":  # weeks end on Sundays
        first = f"date_trunc('DAY', {lo} + make_dt_interval(pmod(8 - dayofweek({lo}), 7)))"
    elif edge:
        first = f"date_trunc('{edge}', {lo})"
    else:
        first = lo
    edges = f"sequence(cast({first} as timestamp_ntz), {hi}, {step_sql})"
    table = spark.range(1).selectExpr(f"explode(filter({edges}, x -> x >= {lo})) as bin_start")
    return table.selectExpr("bin_start", f"bin_start + {step_sql} as bin_end").where(f"bin_end <= {hi}")
