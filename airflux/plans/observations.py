"""Observation plan: adapter of the event table, quality control, aggregation, backgrounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeutil import UTC_OFFSET, exact_year
from ..operators import qa
from ..operators.aggregate import aggregate_obs
from ..operators.curvefit import fitted_background
from ..operators.joins import daily_join, exclude_events
from ..operators.windows import rolling_baseline

MOST_SITES = 1000  # of a rolling background: each gets a row for every hour that any of them has


def observations(events: DataFrame) -> DataFrame:
    """Events as readings: a deterministic adapter to the observation schema."""
    return events.select(
        "event_id",
        F.col("ts").alias("Time_UTC"),
        F.col("event_type").alias("site"),
        F.concat(F.lit("inst_"), (F.col("user_id") % 4).cast("string")).alias("instrument"),
        F.col("value").alias("CH4"),
        (F.col("event_id") % 4 - 1).alias("QAQC_Flag"),
        F.when(F.col("event_id") % 10 == 0, -9).otherwise(-10).alias("ID_CH4"),
        (F.col("event_type") == "view").alias("is_mobile"),
        (F.lit(40.45) + (F.col("user_id") % 48) * 0.01).alias("latitude"),
        (F.lit(-112.2) + (F.col("user_id") % 45) * 0.01).alias("longitude"),
        (F.lit(4.0) + F.col("user_id") % 3).alias("height"),
    )


def observation_vector(
    obs: DataFrame,
    hours: list[int] | None = None,
    events: list[tuple[str, str]] = (),
    spike_percentile: float | None = None,
    points: list[tuple[float, float]] | None = None,
    min_percent: float | None = 0.75,
    mobile_count: int | None = 10,
    expected: dict[str, float] | None = None,
    place: list[str] | None = None,
    utc_offset: int = UTC_OFFSET,
    sites: list[str] = (),
) -> DataFrame:
    """(obs_location, obs_time, CH4): checked, filtered, hourly, completeness-gated, keyed by location.

    ``hours`` are local ones at ``utc_offset``; with ``sites`` the readings of others are left out, as are those
    whose site is null."""
    rows = qa.with_valid(obs.where(F.col("site").isin(list(sites))) if sites else obs, ["CH4"])
    if hours:
        rows = qa.local_hours(rows, hours, utc_offset)
    if events:
        rows = exclude_events(rows, list(events))
    if spike_percentile is not None:
        rows = qa.drop_spike_days(rows, spike_percentile)
    hourly = aggregate_obs(
        rows, freq="1h", mobile_points=points, stationary_min_percent=min_percent, mobile_min_count=mobile_count, expected=expected, place=place
    )
    place_name = qa.obs_location() if "is_mobile" in hourly.columns else F.col("site")
    return hourly.select(place_name.alias("obs_location"), F.col("Time_UTC").alias("obs_time"), "CH4")


def site_hours(obs: DataFrame, expected: dict[str, float] | None = None, place: list[str] | None = None) -> DataFrame:
    """(site, obs_time, CH4): checked hourly means of all hours, mobile ones by grid cells, for the rolling background."""
    hourly = aggregate_obs(
        qa.with_valid(obs, ["CH4"]), freq="1h", mobile_grid_res=0.02, stationary_min_percent=0.75, mobile_min_count=10, expected=expected, place=place
    )
    return hourly.select("site", F.col("Time_UTC").alias("obs_time"), "CH4")


def site_baselines(hours: DataFrame, **kwargs) -> DataFrame:
    """(obs_time, site, baseline) of every site at every time that any site has a value.

    A site has a low percentile of its own window also where it has no value itself; null where its window holds too few.
    Several values of a site at one time count as their mean; rows with a null site or time are left out.
    The sites (at most ``MOST_SITES``) meet at a time in one short row."""
    means = hours.dropna(subset=["site", "obs_time"]).groupBy("obs_time", "site").agg(F.avg("CH4").alias("CH4"))
    sites = sorted(r[0] for r in hours.select("site").dropna().distinct().limit(MOST_SITES + 1).collect())
    if len(sites) > MOST_SITES:
        raise ValueError(f"more than {MOST_SITES} sites")
    if not sites:
        return means.select("obs_time", "site", F.col("CH4").alias("baseline"))
    known = means.groupBy("obs_time").agg(F.map_from_entries(F.collect_list(F.struct("site", "CH4"))).alias("known"))
    dense = known.select("obs_time", "known", F.explode(F.array(*map(F.lit, sites))).alias("site"))
    dense = dense.select("obs_time", "site", F.try_element_at("known", F.col("site")).alias("CH4"))
    return rolling_baseline(dense, ["site"], "obs_time", "CH4", **kwargs).select("obs_time", "site", "baseline")


def background(kind: str, obs: DataFrame, daily: DataFrame | None = None, hours: DataFrame | None = None, samples: DataFrame | None = None, **kwargs) -> DataFrame:
    """(obs_time, background) by kind; an unknown one, or one without its table, raises ValueError.

    "rolling": mean over the sites of ``hours`` (site, obs_time, CH4) of each one's rolling low percentile.
    "gml": curve fitted to ``samples`` (obs_time, value in ppb) of a station, at the times of ``obs``.
    "ct_stilt": the daily product ``daily`` (day, background)."""
    if kind == "rolling" and hours is not None:
        return site_baselines(hours, **kwargs).groupBy("obs_time").agg(F.avg("baseline").alias("background"))
    if kind == "gml" and samples is not None:
        dated = lambda df, *more: df.select("obs_time", exact_year(F.col("obs_time")).alias("year"), *more)
        return fitted_background(dated(samples, "value"), dated(obs.select("obs_time").distinct()), **{"site": "mbo", **kwargs})
    if kind == "ct_stilt" and daily is not None:
        return daily_join(obs.select("obs_time").distinct(), daily, "obs_time", "background")
    raise ValueError(f"unknown background {kind!r}, or one without its table")


def with_background(obs: DataFrame, bg: DataFrame) -> DataFrame:
    """Observations that have a background, with it."""
    return obs.join(bg, "obs_time", "left").dropna(subset=["background"])
