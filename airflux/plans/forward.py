"""Which simulations and footprints a forward operator is built from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timeutil import truncated


def finest(resolutions: dict[str, float]) -> str:
    """The footprint with the smallest cell width of those configured; none: ValueError."""
    if not resolutions:
        raise ValueError("no footprints are configured")
    return min(resolutions, key=lambda name: (resolutions[name], name))


def site_of(location: Column, mapping: dict[str, str]) -> Column:
    """The site of a location id, or the id itself (moving platforms are their own locations)."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), location), location) if pairs else location


def simulations(foot: DataFrame) -> DataFrame:
    """(location_id, run_time) of all simulations in a footprint table."""
    return foot.select("location_id", "run_time").distinct()


def relevant(
    foot: DataFrame,
    obs_locations: list[str],
    mapping: dict[str, str] | None = None,
    hours_utc: list[int] | None = None,
    footprint: str | None = None,
) -> DataFrame:
    """Footprint rows (obs_location, obs_time, foot_time, lon, lat, foot) that observations need.

    ``foot`` has location_id, run_time, foot_time, lon, lat, foot and, where several grids are kept,
    footprint.  Rows stay if their location's site is among ``obs_locations``, their receptor's hour
    among ``hours_utc``, and they are of the named footprint.  The filters are on columns of the scan.
    """
    mapping = mapping or {}
    wanted = {k for k, v in mapping.items() if v in obs_locations} | {x for x in obs_locations if x not in mapping}
    rows = foot.where(F.col("location_id").isin(sorted(wanted)))
    if hours_utc is not None:
        rows = rows.where(F.hour("run_time").isin(list(hours_utc)))
    if footprint is not None and "footprint" in foot.columns:
        rows = rows.where(F.col("footprint") == footprint)
    return rows.select(
        site_of(F.col("location_id"), mapping).alias("obs_location"), F.col("run_time").alias("obs_time"), "foot_time", "lon", "lat", "foot"
    )


def enough_simulations(foot: DataFrame, least: int, unit: str = "MONTH") -> DataFrame:
    """Bins (bin) that ``least`` or more simulations of ``relevant`` rows fall into."""
    sims = foot.select("obs_location", "obs_time").distinct()
    return sims.groupBy(truncated(unit, F.col("obs_time")).alias("bin")).agg(F.count("*").alias("n")).where(f"n >= {least}").select("bin")
