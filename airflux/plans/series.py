"""Stored intermediate results: hourly archive series, cold-pool events, route points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import utm_inverse
from ..operators import spatial
from ..operators.aggregate import hourly_with_gaps
from ..operators.mobile import Line, route_points
from ..operators.windows import heat_deficit, pcap_events, rolling_baseline
from ..scratch import written
from ..sources.writers import write_points_geojson
from .cache import table_exists

EVENTS = "start timestamp_ntz, end timestamp_ntz, n long"


class HourlySeries:
    """Hourly means of sites by key, each worked out once: ``site``, or ``site_base`` for its baseline."""

    def __init__(self, load: Callable[[str], DataFrame], value: str = "CH4", time: str = "Time_UTC", **baseline):
        self.load, self.value, self.time, self.baseline, self.known = load, value, time, baseline, {}

    def __getitem__(self, key: str) -> DataFrame:
        if key not in self.known:
            site, _, base = key.partition("_")
            if base not in ("", "base"):
                raise KeyError(key)
            hourly = hourly_with_gaps(self.load(site), self.time, self.value) if not base else self[site]
            if base:
                hourly = rolling_baseline(hourly, [], "hour", self.value, name="baseline", **self.baseline).select("hour", "baseline")
            self.known[key] = written(hourly, "hourly")
        return self.known[key]


def stored_pcap_events(spark: SparkSession, path: str | None, soundings: Callable[[], DataFrame], threshold: float = 4.04, min_periods: int = 3) -> DataFrame:
    """(start, end, n) of cold-air pools: read where ``path`` has them, else found in soundings and stored there."""
    if path and table_exists(spark, path):
        return spark.read.schema(EVENTS).option("header", True).csv(path)
    events = pcap_events(heat_deficit(soundings(), ["time"]), "time", threshold, min_periods)
    if path:
        events.select("start", "end", "n").coalesce(1).write.mode("overwrite").option("header", True).csv(path)
        return spark.read.schema(EVENTS).option("header", True).csv(path)
    return events


def event_list(events: DataFrame, most: int = 10_000) -> list[tuple[str, str]]:
    """Events as the bounded list that ``exclude_events`` takes."""
    rows = events.select("start", "end").orderBy("start").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} events")
    return [(str(r[0]), str(r[1])) for r in rows]


def stored_route_points(spark: SparkSession, folder: str, routes: dict[str, Line] | DataFrame, spacing: float = 2000.0, meters: bool = True) -> DataFrame:
    """(longitude, latitude, routes) of points along routes, kept in ``folder`` by their spacing and kind.

    ``routes``: a few lines by name, or a table of segments (``spatial.segments_of``) of any size, both in metres.
    Without ``meters`` the points are in degrees, to five decimals; a point of a table of segments has
    the routes within half the spacing of it, one of listed lines those that have that very point.
    """
    path = f"{folder}/points_{spacing:g}" + ("" if meters else "_degrees")
    if not table_exists(spark, path):
        if isinstance(routes, DataFrame):
            table = spatial.route_points(routes, spacing)
        else:
            rows = [(float(x), float(y), names) for x, y, names in route_points(routes, spacing)]
            table = spark.createDataFrame(rows, "x double, y double, routes string").coalesce(1)
        if not meters:
            lat, lon = utm_inverse(F.col("x"), F.col("y"))
            table = table.select(F.round(lon, 5).alias("x"), F.round(lat, 5).alias("y"), "routes")
        write_points_geojson(table.select(F.col("x").alias("longitude"), F.col("y").alias("latitude"), "routes"), path)
    raw = spark.read.schema("geometry struct<coordinates:array<double>>, properties struct<routes:string>").json(path)
    at = F.col("geometry.coordinates")
    return raw.select(at[0].alias("longitude"), at[1].alias("latitude"), F.col("properties.routes").alias("routes"))
