"""Mobile platforms: GPS tracks, routes, storage yards, and positions of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import in_polygon, points_along, utm, within_line
from . import spatial
from .joins import asof_join
from .qa import outliers_trimmed

Line = list[tuple[float, float]]


def in_metres(gps: DataFrame, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Track plus easting and northing, as columns of their own so that predicates do not repeat the projection."""
    east, north = utm(F.col(lat), F.col(lon))
    return gps.withColumns({"easting": east, "northing": north})


def on_routes(gps: DataFrame, routes: dict[str, Line] | DataFrame, buffer_m: float = 50.0, dedupe: bool = True) -> DataFrame:
    """Rows within ``buffer_m`` of a route (in metres).  Without ``dedupe`` a row appears for each route it lies on,
    with the route's name.  Routes are a few lines, or a table of segments of any size (``spatial.routes_at``)."""
    if isinstance(routes, DataFrame):
        found = spatial.routes_at(gps, routes, buffer_m, out="__routes").where(F.size("__routes") > 0)
        return found.drop("__routes") if dedupe else found.withColumn("route", F.explode("__routes")).drop("__routes")
    x, y = F.col("easting"), F.col("northing")
    hits = F.array_compact(F.array(*(F.when(within_line(x, y, line, buffer_m), F.lit(name)) for name, line in routes.items())))
    found = gps.withColumn("__routes", hits).where(F.size("__routes") > 0)
    return found.drop("__routes") if dedupe else found.withColumn("route", F.explode("__routes")).drop("__routes")


def outside(gps: DataFrame, ring: Line, x: str = "longitude", y: str = "latitude") -> DataFrame:
    """Rows not in the polygon."""
    return gps.where(~in_polygon(F.col(x), F.col(y), ring))


def route_points(routes: dict[str, Line], spacing: float = 2000.0) -> list[tuple[float, float, str]]:
    """Points every ``spacing`` metres along all routes, each with the joined names of the routes it lies on."""
    names: dict[tuple[float, float], list[str]] = {}
    for name, line in sorted(routes.items()):
        for p in points_along(line, spacing):
            names.setdefault(p, []).append(name)
    return [(x, y, "".join(n)) for (x, y), n in names.items()]


def shapes_of(given: dict[str, Line] | Line | None | bool, default):
    """Routes or a polygon as given; None: the default; False: none.  True raises ValueError."""
    if given is True:
        raise ValueError("give the shapes, None for the default ones or False for none")
    return None if given is False else default if given is None else given


#: Routes and storage yards of platforms by the beginning of their site's name, where a caller has set some.
DEFAULTS: dict[str, dict] = {"trx": {"routes": None, "storage": None, "buffer_m": 50.0}}


def with_defaults(site: str, routes=None, storage=None) -> dict:
    """Arguments of ``merge_with_gps`` for a site: its platform's defaults where None is given, none where False is."""
    own = next((d for prefix, d in DEFAULTS.items() if site.startswith(prefix)), {})
    out = {"routes": shapes_of(routes, own.get("routes")), "storage": shapes_of(storage, own.get("storage"))}
    return out | {"buffer_m": own.get("buffer_m", 50.0)}


def merge_with_gps(
    obs: DataFrame,
    gps: DataFrame,
    org: str,
    time: str = "Time_UTC",
    routes: dict[str, Line] | DataFrame | None = None,
    storage: Line | None = None,
    buffer_m: float = 50.0,
    tolerance_us: int = 60_000_000,
) -> DataFrame:
    """Readings with the position of the latest GPS fix of their site within the tolerance; readings without one go.

    The track is trimmed strictly between the 1 % and 99 % quantiles of altitude, to the routes, and
    to fixes outside the storage yard, where those are given.
    """
    if org != "UATAQ":
        raise ValueError(f"no GPS of organization {org!r}")
    track = outliers_trimmed(gps, "altitude")
    if routes is not None and (isinstance(routes, DataFrame) or routes):
        track = on_routes(in_metres(track), routes, buffer_m).drop("easting", "northing")
    if storage:
        track = outside(track, storage)
    place = ["latitude", "longitude", "altitude"]
    bare = obs.drop(*[c for c in place if c in obs.columns])
    return asof_join(bare, track, ["site"], time, place, tolerance_us).dropna(subset=["latitude"])
