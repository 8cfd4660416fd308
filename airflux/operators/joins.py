"""Joins over time and space: as-of, interpolating, nearest point, interval, daily."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_POINTS = 5000


def nearest_point(df: DataFrame, points: list[tuple[float, float]], x: str = "agg_lon", y: str = "agg_lat") -> DataFrame:
    """Coordinates of the nearest of a bounded list of (lon, lat) points, in plain degrees; ties: the first.

    The list is part of the expression (no join), so its length is checked.
    """
    if not 0 < len(points) <= MOST_POINTS:
        raise ValueError(f"1 to {MOST_POINTS} points, not {len(points)}")
    listed = F.array(*(F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in points))
    square = lambda c: c * c
    ranked = F.transform(
        listed,
        lambda p, i: F.struct(
            (square(p["x"] - F.col("longitude")) + square(p["y"] - F.col("latitude"))).alias("d2"), i.alias("i"), p["x"].alias("x"), p["y"].alias("y")
        ),
    )
    near = df.withColumn("__near", F.array_min(ranked))
    return near.withColumns(
        {x: F.col("__near.x"), y: F.col("__near.y"), "point": F.col("__near.i")}
    ).drop("__near")


def _carried(rows: DataFrame, keys: list[str], time: str, value: str, forward: bool) -> Column | DataFrame:
    """``rows`` plus ``__got``: the last (or next) non-null ``value`` at or before (after) each row.

    Days are ordered on their own, and the last value of each day is carried over a table of one
    row per key and day: a key with very many rows is still worked on by the day.
    """
    rows = rows.withColumn("__day", F.to_date(time))
    order = [F.col(time).asc(), F.col("__side").asc()] if forward else [F.col(time).desc(), F.col("__side").asc()]
    inside = Window.partitionBy(*keys, "__day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    pick = F.max_by if forward else F.min_by
    days = rows.groupBy(*keys, "__day").agg(pick(value, F.when(F.col(value).isNotNull(), F.col(time))).alias("__last"))
    across = Window.partitionBy(*keys).orderBy(F.col("__day").asc() if forward else F.col("__day").desc())
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*keys, "__day", F.last("__last", ignorenulls=True).over(before).alias("__before"))
    rows = rows.withColumn("__in", F.last(value, ignorenulls=True).over(inside))
    return rows.join(days, [*keys, "__day"]).withColumn("__got", F.coalesce("__in", "__before")).drop("__in", "__before", "__day")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, columns: list[str], tolerance_us: int | None = None) -> DataFrame:
    """Left rows with the columns of the latest right row at or before them (by key), no older than the tolerance."""
    value = F.struct(F.col(time).alias("t"), *columns)
    a = left.withColumns({"__side": F.lit(1), "__v": F.lit(None).cast(right.select(value).schema[0].dataType)})
    b = right.select(*keys, time, F.lit(0).alias("__side"), value.alias("__v"))
    both = a.unionByName(b, allowMissingColumns=True)
    got = _carried(both, keys, time, "__v", True).where("__side = 1")
    if tolerance_us is not None:
        age = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.col("__got.t").cast("timestamp"))
        got = got.withColumn("__got", F.when(age <= tolerance_us, F.col("__got")))
    return got.select(*left.columns, *(F.col("__got")[c].alias(c) for c in columns))


def lerp_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, columns: list[str]) -> DataFrame:
    """Left rows with the right columns interpolated in time; beyond the ends the end value holds."""
    value = F.struct(F.col(time).alias("t"), *columns)
    kind = right.select(value).schema[0].dataType
    a = left.withColumns({"__side": F.lit(1), "__v": F.lit(None).cast(kind), "__id": F.monotonically_increasing_id()})
    b = right.select(*keys, time, F.lit(0).alias("__side"), value.alias("__v"))
    both = a.unionByName(b, allowMissingColumns=True)
    below = _carried(both, keys, time, "__v", True).withColumnRenamed("__got", "__a")
    got = _carried(below, keys, time, "__v", False).withColumnRenamed("__got", "__b").where("__side = 1")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")).cast("double")
    share = (us(time) - us("__a.t")) / (us("__b.t") - us("__a.t"))

    def between(c: str) -> Column:
        p, q = F.col("__a")[c], F.col("__b")[c]
        inner = F.when(F.col("__a.t") == F.col("__b.t"), p).otherwise(p + (q - p) * share)
        return F.when(F.col("__a").isNull(), q).when(F.col("__b").isNull(), p).otherwise(inner)

    return got.select(*left.columns, *(between(c).alias(c) for c in columns))


def exclude_events(df: DataFrame, events: list[tuple[str, str]], time: str = "Time_UTC") -> DataFrame:
    """Rows outside a bounded list of closed [start, end] intervals."""
    if len(events) > MOST_POINTS:
        raise ValueError(f"at most {MOST_POINTS} events")
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    inside = F.lit(False)
    if events:
        listed = F.array(*(F.struct(ts(a).alias("a"), ts(b).alias("b")) for a, b in events))
        inside = F.exists(listed, lambda e: F.col(time).between(e["a"], e["b"]))
    return df.where(~F.coalesce(inside, F.lit(False)))


def daily_join(obs: DataFrame, daily: DataFrame, time: str, value: str) -> DataFrame:
    """Left join by calendar day; days without a value give null."""
    return obs.withColumn("day", F.to_date(time)).join(daily.select("day", value), "day", "left").drop("day")


def location_map(ids: DataFrame, sites: list[tuple[str, float, float, float]], column: str = "location_id") -> DataFrame:
    """(location_id, site) where exactly one site of a bounded list lies at lon_lat_height (within 1e-8 + 1e-5 |x|)."""
    if not 0 < len(sites) <= MOST_POINTS:
        raise ValueError(f"1 to {MOST_POINTS} sites, not {len(sites)}")
    parts = F.split(F.col(column), "_")
    got = ids.select(column).distinct().where(F.size(parts) == 3)
    got = got.withColumns({n: F.expr(f"try_cast(split({column}, '_')[{k}] as double)") for k, n in enumerate(("__x", "__y", "__z"))}).dropna()
    close = lambda a, v: F.abs(F.col(a) - F.lit(v)) <= 1e-8 + 1e-5 * F.abs(F.col(a))
    hits = F.array_compact(F.array(*(F.when(close("__y", lat) & close("__x", lon) & close("__z", z), F.lit(s)) for s, lat, lon, z in sites)))
    return got.withColumn("__hits", hits).where(F.size("__hits") == 1).select(column, F.col("__hits")[0].alias("site"))
