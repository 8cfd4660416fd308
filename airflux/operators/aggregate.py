"""Space-time aggregation of stationary and mobile observations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import grid_snap
from ..functions.timeutil import floor_period, freq_hours
from ..sources.registry import expected_per_hour
from . import spatial
from .joins import nearest_point

#: Aggregates by name.
FUNCS = {
    "mean": F.avg,
    "median": F.median,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "count": F.count,
    "first": F.first,
    "last": F.last,
}
PLACE = ("latitude", "longitude", "height", "altitude", "is_mobile")


def joined_names(column: str) -> Column:
    """Sorted distinct values joined by blanks."""
    return F.array_join(F.array_sort(F.collect_set(column)), " ")


def _grouped(df: DataFrame, keys: list[str], exclude: list[str], func) -> DataFrame:
    agg = FUNCS[func] if isinstance(func, str) else func
    numbers = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in {*keys, *exclude}]
    outs = [agg(c).alias(c) for c in numbers]
    if "instrument" in df.columns and "instrument" not in keys:
        outs.append(joined_names("instrument").alias("instrument"))
    return df.dropna(subset=keys).groupBy(*keys).agg(*outs)


def complete_groups(df: DataFrame, keys: list[str], freq: str, least: float, expected: dict[str, float] | None = None) -> DataFrame:
    """Rows of groups with at least ``least`` of the expected readings.

    The expectation is that of the group's earliest reading.  Groups are counted before the
    shuffle and joined back, so a large group is never one task's.
    """
    hours = freq_hours(freq)
    pairs = [F.lit(x) for kv in (expected or expected_per_hour()).items() for x in (kv[0], float(kv[1]) * hours)]
    wanted = F.element_at(F.create_map(*pairs), F.min_by("instrument", F.struct("Time_UTC", "instrument")))
    groups = df.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("__n"), wanted.alias("__wanted"))
    return df.join(groups.where(f"__n / __wanted >= {least}").select(*keys), keys, "left_semi")


def aggregate_obs(
    obs: DataFrame,
    by: list[str] | str | None = None,
    freq: str | None = None,
    func="mean",
    mobile_points: list[tuple[float, float]] | None = None,
    mobile_grid_res: float | None = None,
    stationary_min_percent: float | None = None,
    mobile_min_count: int | None = None,
    place: list[str] | None = None,
    expected: dict[str, float] | None = None,
) -> DataFrame:
    """Stationary rows by site, period and position; mobile rows by point or grid cell, and period.

    ``by`` replaces the keys (and skips the completeness gate).  Without ``by`` and ``freq``
    stationary rows pass through.  ``place`` names the position columns that hold values; where
    it is not given, one pass over the table finds them.
    """
    if isinstance(func, str) and func not in FUNCS:
        raise ValueError(f"unknown aggregate {func!r}")
    by = [by] if isinstance(by, str) else by
    parts, mobile_col = [], "is_mobile" in obs.columns
    still = obs.where(~F.col("is_mobile")) if mobile_col else obs
    if by is None and freq is None:
        parts.append(still)
    else:
        if by is None:
            still = still.withColumn("agg_time", floor_period(F.col("Time_UTC"), freq))
            there = [c for c in PLACE if c in obs.columns]
            if place is None and there:
                has = still.agg(*(F.max(F.col(c).isNotNull()).alias(c) for c in there)).first()
                place = [c for c in there if has[c]]
            keys = ["site", "agg_time", *(place or [])]
            if stationary_min_percent is not None:
                still = complete_groups(still, keys, freq, stationary_min_percent, expected)
        else:
            keys = by
        parts.append(_grouped(still, keys, [], func).withColumnsRenamed({"agg_time": "Time_UTC"}))
    if mobile_col:
        moving = obs.where("is_mobile")
        keys, exclude = ["is_mobile", "height"], []
        if mobile_points is not None:
            of = spatial.nearest if isinstance(mobile_points, DataFrame) else nearest_point  # a table (point, x, y) of any size, or a list
            moving = of(moving, mobile_points)
            keys += ["site", "agg_lat", "agg_lon"]
            exclude = ["latitude", "longitude", "point"]
        elif mobile_grid_res is not None:
            moving = moving.withColumns(
                {"agg_lat": grid_snap(F.col("latitude"), mobile_grid_res), "agg_lon": grid_snap(F.col("longitude"), mobile_grid_res)}
            )
            keys += ["site", "agg_lat", "agg_lon"]
            exclude = ["latitude", "longitude"]
        else:
            keys += [c for c in ("site", "latitude", "longitude", "altitude") if c in obs.columns]
        if by is not None:
            keys = by
        elif freq is not None:
            moving = moving.withColumn("agg_time", floor_period(F.col("Time_UTC"), freq))
            keys.append("agg_time")
        out = _grouped(moving, keys, exclude, func)
        if mobile_min_count is not None:
            counted = moving.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("__n"))
            out = out.join(counted.where(f"__n >= {mobile_min_count}").drop("__n"), keys, "left_semi")
        parts.append(out.withColumnsRenamed({"agg_time": "Time_UTC", "agg_lat": "latitude", "agg_lon": "longitude"}))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def require_rows(df: DataFrame) -> DataFrame:
    """``df``, or ValueError where it has no row."""
    if df.isEmpty():
        raise ValueError("no data: all observations were filtered out")
    return df


def hourly_with_gaps(df: DataFrame, time: str, value: str) -> DataFrame:
    """Hourly means, hours without data as null, from the first to the last hour."""
    means = df.where(F.col(value).isNotNull()).groupBy(F.date_trunc("HOUR", time).cast("timestamp_ntz").alias("hour")).agg(F.avg(value).alias(value))
    span = means.agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    spine = span.where("a is not null").selectExpr("explode(sequence(a, b, interval 1 hour)) as hour")
    return spine.join(means, "hour", "left")


def domain_total(fluxes: DataFrame, dlon: float, dlat: float, unit: float = 1.0) -> DataFrame:
    """Sum over the domain of flux times cell area, by time."""
    from ..functions.geo import cell_area_m2

    amount = F.col("flux") * cell_area_m2(F.col("lat"), dlon, dlat) * F.lit(unit)
    return fluxes.groupBy("time").agg(F.sum(amount).alias("total"))


def numbered(df: DataFrame, keys: list[str], order: list[str], every: int) -> DataFrame:
    """Every n-th row of each track (``keys``) in the given order, for wind barbs.

    The rows of one track meet in a task: take a day with the platform as a key, as figures do."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", number).where((F.col("__n") - 1) % every == 0).drop("__n")

