"""The inputs of an inversion, put together from its configuration and raw tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeutil import flux_bins, truncated, week_start
from ..operators import covariance
from ..operators import inversion as inv
from ..operators import qa
from ..operators.joins import exclude_events
from ..scratch import written
from ..sources import registry
from . import forward, graph, observations
from .config import InversionConfig
from .inversion import Inputs, Result, enough, run

UNITS = {"MS": "MONTH", "QS": "QUARTER", "YS": "YEAR", "D": "DAY"}


def unit_of(config: InversionConfig):
    """Period of the flux bins: a calendar unit, or a function for bins of weeks; others raise ValueError."""
    if config.flux_freq in UNITS:
        return UNITS[config.flux_freq]
    weeks = re.fullmatch(r"(\d*)W", config.flux_freq)
    if not weeks:
        raise ValueError(f"not a flux frequency: {config.flux_freq!r}")
    return lambda ts: week_start(ts, config.tstart, int(weeks[1] or 1))


@dataclass
class Tables:
    """readings: raw observations (Time_UTC, site, instrument, CH4, ...); foot: footprints by simulation.

    inventory (time, lon, lat, sector, value) for prior "inventory", with ``monthly`` of the same columns the sectors
    that vary by month; daily (day, background) for background "ct_stilt", samples (obs_time, value) for "gml"; events: cold-air pools to leave out; orgs: organization of each site; versions: a name of the
    state of each of these tables, by which stored tables made from them are found again."""

    readings: DataFrame
    foot: DataFrame
    inventory: DataFrame | None = None
    monthly: DataFrame | None = None
    daily: DataFrame | None = None
    samples: DataFrame | None = None
    events: list[tuple[str, str]] = ()
    orgs: dict[str, str] | None = None
    expected: dict[str, float] | None = None
    resolutions: dict[str, float] | None = None
    versions: dict[str, str] = field(default_factory=dict)


def prior_of(spark: SparkSession, tables: Tables, config: InversionConfig) -> DataFrame:
    """(time, lon, lat, value) on the grid and the flux bins; an unknown prior raises ValueError.

    Sectors of the yearly inventory that the monthly one lacks are filled forward to its months; with the option
    ``express``, or without a monthly one, the inventory stands alone.  Options: express, cell, freq, units; value."""
    bins, options = flux_bins(spark, config.tstart, config.tend, config.flux_freq), dict(config.prior_kwargs)
    if config.prior == "constant":
        grid = inv.regular_grid(spark, *config.extent, config.dx, config.dy)
        return inv.constant_prior(grid, bins, options.get("value", 0.01))
    if config.prior != "inventory" or tables.inventory is None:
        raise ValueError(f"unknown prior {config.prior!r}, or one without its table")
    merge = tables.monthly is not None and not options.get("express", False)
    src, have = options.get("cell", (config.dx, config.dy)), options.get("freq", "YS" if options.get("express") else "MS")
    sectors = inv.merged_inventory(tables.inventory, tables.monthly) if merge else tables.inventory
    field = inv.regrid(inv.sector_sum(sectors), src, (config.dx, config.dy), (config.xmin, config.ymin))
    inside = F.col("lon").between(config.xmin, config.xmax) & F.col("lat").between(config.ymin, config.ymax)
    field = inv.resample(field.where(inside), inv.CELL, have, config.flux_freq)
    field = inv.in_units(field, options.get("units", config.output_units), config.output_units)
    return inv.nearest_time(field, bins.select(F.col("bin_start").alias("time")), inv.CELL)


def assembled(spark: SparkSession, tables: Tables, config: InversionConfig, write: Callable[[DataFrame, str], DataFrame]) -> Inputs:
    """Observations, prior, operator, constant, covariances and, with ``bias_std``, the bias block.

    Observations are those of the configuration's sites, range and hours (at its offset from UTC), outside its events and spike days,
    with a background, of bins with enough observations and simulations; the operator has rows for
    these.  ``write(df, name)`` stores a table that several of them read.
    """
    unit, orgs = unit_of(config), tables.orgs or {r[0]: r[2] for r in registry.SITES}
    vector = observations.observation_vector(
        tables.readings,
        hours=list(config.subset_hours),
        events=tables.events if config.filter_pcaps else (),
        spike_percentile=config.spike_percentile if config.filter_spikes else None,
        expected=tables.expected,
        place=[],
        utc_offset=config.utc_offset,
        sites=list(config.sites),
    )
    vector = qa.trim(vector, config.tstart, config.tend, "obs_time")
    hours_of = None
    if config.background == "rolling":  # over all hours of the configuration's sites, not those of the observations alone
        rows = tables.readings.where(F.col("site").isin(list(config.sites))) if config.sites else tables.readings
        rows = qa.time_slice(rows, config.tstart, config.tend, "Time_UTC")
        rows = exclude_events(rows, list(tables.events)) if config.filter_pcaps and tables.events else rows
        hours_of = observations.site_hours(rows, tables.expected, place=[])
    background = observations.background(config.background, vector, tables.daily, hours_of, tables.samples, **config.background_kwargs)
    both = observations.with_background(vector, background)
    footprint = forward.finest(tables.resolutions) if tables.resolutions else None
    places = sorted(r[0] for r in both.select("obs_location").distinct().collect())  # sites and route points: few
    foot = forward.relevant(tables.foot, places, config.location_site_map, config.subset_hours_utc, footprint)
    both = enough(both, config.min_obs_per_interval, unit)
    bins = forward.enough_simulations(foot, config.min_sims_per_interval, unit).withColumnRenamed("bin", "__bin")
    both = both.withColumn("__bin", truncated(unit, F.col("obs_time"))).join(F.broadcast(bins), "__bin", "left_semi").drop("__bin")
    if config.aggregate_obs:
        both = write(both, "hours")
        hours, step = both.select(*inv.OBS), {True: "DAY", "D": "DAY", "1D": "DAY"}[config.aggregate_obs]
        means = both.withColumn("obs_time", F.date_trunc(step, "obs_time").cast("timestamp_ntz"))
        n = means.groupBy(*inv.OBS).agg(F.count("*").alias("__n"))
        foot = foot.join(both.select(*inv.OBS), inv.OBS, "left_semi")
        foot = foot.withColumn("obs_time", F.date_trunc(step, "obs_time").cast("timestamp_ntz")).join(n, inv.OBS)
        foot = foot.withColumn("foot", F.col("foot") / F.col("__n")).drop("__n")
        both = means.groupBy(*inv.OBS).agg(F.avg("CH4").alias("CH4"), F.avg("background").alias("background"))
    both = write(both.select(*inv.OBS, "CH4", "background"), "observations")
    kept = foot.join(both.select(*inv.OBS), inv.OBS, "left_semi")
    prior = write(prior_of(spark, tables, config), "prior")
    jac = inv.footprint_jacobian(kept, config.dx, config.dy, config.xmin, config.ymin, unit)
    jac = write(jac.join(prior.select(*inv.STATE), inv.STATE, "left_semi"), "operator")
    bias = entries = None
    if config.bias_std is not None:
        months = flux_bins(spark, config.tstart, config.tend, config.flux_freq)
        bias = inv.bias_states(months, config.bias_grouping, places, orgs)
        entries = inv.bias_jacobian(both, months, config.bias_grouping, orgs)
        if "grp" not in bias.columns:
            bias, entries = (t.withColumn("grp", F.lit("all")) for t in (bias, entries))
    value = lambda c: both.select(*inv.OBS, F.col(c).alias("value"))

    def mismatch(z: DataFrame) -> DataFrame:
        """Covariance of the observations ``z``: of means, where they are means, W S W' of the hours behind them."""
        if not config.aggregate_obs:
            return inv.mdm_matrix(z, config.mdm, orgs)
        own = hours.withColumn("__mean", F.date_trunc(step, "obs_time").cast("timestamp_ntz"))
        own = own.join(z.select("obs_location", F.col("obs_time").alias("__mean")), ["obs_location", "__mean"], "left_semi")
        return covariance.aggregated_mismatch(own.select(*inv.OBS), config.mdm, step, orgs)

    straight = {} if config.aggregate_obs else {
        "obs_product": lambda x: covariance.mismatch_product(x, config.mdm, orgs, ["probe"]),
        "obs_variance": lambda z: covariance.mismatch_variance(z, config.mdm, orgs),
    }
    return Inputs(value("CH4"), prior, jac, value("background"), mismatch, bias, entries, **straight)


def store_of(spark: SparkSession, tables: Tables, config: InversionConfig) -> Callable[[DataFrame, str], DataFrame]:
    """Where a run keeps its tables: in the configuration's cache, else in the shared folder.

    With a cache every table needs a version, lest a stored one be taken for another's: ValueError."""
    if not config.cache:
        return written
    there = [n for n in graph.RAW if getattr(tables, n) is not None]
    if missing := [n for n in there if n not in tables.versions]:
        raise ValueError(f"tables without a version: {missing}")
    plain = {n: getattr(tables, n) for n in graph.PLAIN}
    plain["events"] = [list(map(str, e)) for e in tables.events]
    return graph.Store(spark, config, plain | {n: tables.versions[n] for n in there})


def run_from(spark: SparkSession, tables: Tables, config: InversionConfig, write: Callable[[DataFrame, str], DataFrame] | None = None) -> Result:
    """The whole run: inputs from the configuration, coverage filter, solve and metrics; tables go to ``store_of``, or to ``write``."""
    return run(assembled(spark, tables, config, write or store_of(spark, tables, config)), config)
