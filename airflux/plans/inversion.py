"""The whole inversion: inputs, optional coverage filter, solve, summary; each stage timed."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeutil import duration_us, truncated
from ..operators import covariance, solvers
from ..operators import inversion as inv
from ..scratch import written
from .config import InversionConfig, config_id

logger = logging.getLogger(__name__)

BIAS_LON = 1000.0  # bias states of the iterative solve lie beyond all longitudes, one for each group

Unit = str | Callable  # of a period: a calendar unit, or a function from times to their period's start


@dataclass
class Inputs:
    """obs, constant: (obs_location, obs_time, value); prior: (time, lon, lat, value); jacobian: their product's entries.

    obs_cov(z): entries of the observations' covariance; obs_product(x), if given, its product with vectors (probe, OBS, value)
    and obs_variance(z) its diagonal, without the entries.
    bias: (time, grp, value) states with a deviation each of ``bias_std``; bias_jacobian: their entries."""

    obs: DataFrame
    prior: DataFrame
    jacobian: DataFrame
    constant: DataFrame
    obs_cov: Callable[[DataFrame], DataFrame]
    bias: DataFrame | None = None
    bias_jacobian: DataFrame | None = None
    obs_product: Callable[[DataFrame], DataFrame] | None = None
    obs_variance: Callable[[DataFrame], DataFrame] | None = None


@dataclass
class Result:
    posterior: DataFrame
    full_posterior: DataFrame
    metrics: dict[str, float | None]
    bias: DataFrame | None = None
    seconds: dict[str, float] = field(default_factory=dict)
    enhancement: DataFrame | None = None  # observations less the constant: what the states explain
    jacobian: DataFrame | None = None  # of the states that were solved for
    prior: DataFrame | None = None


def enough(obs: DataFrame, least: int, unit: Unit = "MONTH") -> DataFrame:
    """Observations of intervals that hold ``least`` or more."""
    rows = obs.withColumn("__bin", truncated(unit, F.col("obs_time")))
    kept = rows.groupBy("__bin").agg(F.count("*").alias("n")).where(f"n >= {least}").select("__bin")
    return rows.join(kept, "__bin", "left_semi").drop("__bin")


def prior_covariance(prior: list, config: InversionConfig) -> np.ndarray:
    """Dense prior covariance of a bounded state: time decay (x) spatial decay of the deviations."""
    t = np.array([r["time"].timestamp() * 1e6 for r in prior])
    lon, lat = np.radians([r["lon"] for r in prior]), np.radians([r["lat"] for r in prior])
    s = config.prior_base_std + config.prior_std_frac * np.array([r["value"] for r in prior])
    a = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat[:, None]) * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
    km = 2 * 6371.0088 * np.arcsin(np.sqrt(np.minimum(a, 1)))
    return np.outer(s, s) * np.exp(-np.abs(t[:, None] - t) / duration_us(config.prior_time_scale)) * np.exp(-km / config.prior_spatial_scale)


def is_large(z: DataFrame, prior: DataFrame, bias: DataFrame | None) -> bool:
    """More observations or states than a dense solve takes; no table is counted beyond the bound."""
    size = lambda df: 0 if df is None else df.limit(inv.MOST_DENSE + 1).count()
    return size(z) > inv.MOST_DENSE or size(prior) + size(bias) > inv.MOST_DENSE


def iterated(inputs: Inputs, z: DataFrame, prior: DataFrame, jac: DataFrame, config: InversionConfig, write, probes: int, tol: float, steps: int):
    """(flux posterior, bias posterior or None, metrics) without dense matrices, at any size.

    The prior covariance is the same Kronecker product as in the dense solve, made for the states that the coverage
    filter left.  Bias states are solved for along with the fluxes, as independent states of deviation ``bias_std``.  Chi-square is
    exact; DOFS is an estimate from ``probes`` random vectors with its standard error (none: null); the reduction
    of uncertainty would need every posterior variance and is null."""
    z, gamma = write(z, "enhancement"), config.gamma or 1.0
    states = write(inv.prior_sigma(prior.select(*inv.STATE, "value"), config.prior_base_std, config.prior_std_frac), "states")
    times = write(inv.kernel_table(states, "time", float(duration_us(config.prior_time_scale))), "times")
    cells = write(covariance.spatial_kernel(states, config.prior_spatial_scale), "cells")
    flux = lambda x: covariance.kronecker_product(x, states, times, cells, ["probe"])
    full, entries, product, groups = states, jac.select(*inv.OBS, *inv.STATE, "value"), flux, []
    if inputs.bias is not None:
        if not config.bias_std:
            raise ValueError("bias states need bias_std")
        groups = [r[0] for r in inputs.bias.select("grp").distinct().orderBy("grp").limit(inv.MOST_DENSE + 1).collect()]
        if len(groups) > inv.MOST_DENSE:
            raise ValueError(f"over {inv.MOST_DENSE} groups of the bias")
        at = F.create_map(*(F.lit(x) for k, g in enumerate(groups) for x in (g, BIAS_LON + k)))
        placed = lambda df, *more: df.select(*more, "time", F.try_element_at(at, F.col("grp")).alias("lon"), F.lit(0.0).alias("lat"), "value")
        full = write(states.unionByName(placed(inputs.bias).withColumn("sigma", F.lit(float(config.bias_std)))), "states")
        entries = entries.unionByName(placed(inputs.bias_jacobian, *inv.OBS))
        own = config.bias_std**2
        product = lambda x: flux(x.where(F.col("lon") < BIAS_LON)).unionByName(
            x.where(F.col("lon") >= BIAS_LON).select("probe", *inv.STATE, (F.col("value") * own).alias("value"))
        )
    entries = write(entries.join(z.select(*inv.OBS), inv.OBS, "left_semi"), "operator")
    apply, variance = inputs.obs_product, inputs.obs_variance
    if apply is None or variance is None:
        cov = write(inputs.obs_cov(z), "mismatch")
        variance = lambda z: cov.where("time_i = time_j").select("obs_location", F.col("time_i").alias("obs_time"), "value")
        right = cov.select("obs_location", F.col("time_j").alias("obs_time"), "time_i", "value")
        apply = lambda x: solvers.through(right, x, inv.OBS, ["obs_location", "time_i"]).withColumnRenamed("time_i", "obs_time")
    less = lambda df: df.withColumn("value", F.col("value") / gamma)
    solved = solvers.solve(
        entries, z, full, write(less(variance(z)), "variance"), write, steps, tol, prior_product=product, obs_product=lambda x: less(apply(x)), probes=probes
    )
    found = write(solved.posterior, "posterior")
    fit = inv.spmv(entries, found, inv.STATE, inv.OBS, "fit")
    both = z.join(fit, inv.OBS, "left").select(F.col("value").alias("z"), F.coalesce("fit", F.lit(0.0)).alias("fit"))
    r = F.col("z") - F.col("fit")
    row = both.agg(F.corr("z", "fit").alias("r"), F.sqrt(F.avg(r * r)).alias("rmse")).first()
    metrics = {"reduced_chi2": solved.figures["reduced_chi2"], "R2": None if row["r"] is None else row["r"] ** 2, "RMSE": row["rmse"]}
    metrics |= {"DOFS": solved.figures.get("DOFS"), "DOFS_error": solved.figures.get("DOFS_error"), "uncertainty_reduction": None}
    bias = None
    if groups:
        names = F.array(*map(F.lit, groups))
        named = F.get(names, (F.col("lon") - BIAS_LON).cast("int"))
        bias = found.where(F.col("lon") >= BIAS_LON).select("time", named.alias("grp"), "value")
    return found.where(F.col("lon") < BIAS_LON).select(*inv.STATE, "value"), bias, metrics


def collect_metrics(result: Result, config: InversionConfig, unit: float = 1.0) -> dict[str, float | None]:
    """Figures of a run in one row: goodness of fit, totals of the fluxes over the domain, residuals of the concentrations.

    Each of the latter two blocks stands alone: where one fails its figures are null, the failure is logged, and the others stay.
    Totals are over all cells of the prior, those that a coverage filter left out with their prior value."""
    chi2 = result.metrics["reduced_chi2"]
    out = {**result.metrics, "chi2_distance": None if chi2 is None else abs(chi2 - 1.0)}

    def totals():
        from ..operators.aggregate import domain_total

        total = lambda df: domain_total(df.withColumnRenamed("value", "flux"), config.dx, config.dy, unit)
        return inv.flux_metrics(total(result.prior), total(result.full_posterior)).first().asDict()

    def residuals():
        solved = result.prior.join(result.posterior.select(*inv.STATE), inv.STATE, "left_semi")
        fit = lambda states, name: inv.spmv(result.jacobian, states, inv.STATE, inv.OBS, name)
        table = result.enhancement.withColumnRenamed("value", "observed").join(fit(solved, "prior"), inv.OBS, "left").join(fit(result.posterior, "posterior"), inv.OBS, "left")
        return {**inv.fit_metrics(table.fillna(0.0, ["prior", "posterior"])).first().asDict(), "n_state": solved.count()}

    blocks = {
        totals: ("prior_flux_mean", "posterior_flux_mean", "posterior_flux_std", "flux_change_pct"),
        residuals: ("prior_conc_rmse", "posterior_conc_rmse", "prior_conc_bias", "posterior_conc_bias", "n_obs", "n_state"),
    }
    for block, names in blocks.items():
        try:
            out |= block()
        except Exception:  # one block must not take the others with it
            logger.warning("no %s of %s", block.__name__, config_id(config), exc_info=True)
            out |= dict.fromkeys(names)
    return out


def run(inputs: Inputs, config: InversionConfig, write=written, probes: int = 8, tol: float = 1e-8, steps: int = 1000, large: bool | None = None) -> Result:
    """Posterior of the problem: a dense solve up to ``MOST_DENSE`` observations and states, beyond it ``iterated``.

    ``large`` chooses by hand; ``write(df, name)`` keeps the tables of the iterative solve, in the shared folder unless given."""
    seconds: dict[str, float] = {}

    def timed(name: str, work):
        began = time.time()
        out = work()
        seconds[name] = time.time() - began
        return out

    prior, jac, const = inputs.prior, inputs.jacobian, inputs.constant
    if config.jacobian_coverage_percentile is not None:
        prior, jac, const, _ = timed("coverage", lambda: inv.coverage_filter(prior, jac, const, config.jacobian_coverage_percentile))
    z = inputs.obs.join(const.withColumnRenamed("value", "c"), inv.OBS).select(*inv.OBS, (F.col("value") - F.col("c")).alias("value"))
    if is_large(z, prior, inputs.bias) if large is None else large:
        posterior, bias, metrics = timed("solve", lambda: iterated(inputs, z, prior, jac, config, write, probes, tol, steps))
        return Result(posterior, inv.reconstruct(inputs.prior, posterior), metrics, bias, seconds, z, jac, inputs.prior)

    def gather():
        limit = inv.MOST_DENSE + 1
        rows, states = z.orderBy(*inv.OBS).limit(limit).collect(), prior.orderBy(*inv.STATE).limit(limit).collect()
        if max(len(rows), len(states)) >= limit:
            raise ValueError(f"over {inv.MOST_DENSE} observations or states")
        i = {(r["obs_location"], r["obs_time"]): k for k, r in enumerate(rows)}
        biases = [] if inputs.bias is None else inputs.bias.select("time", "grp", "value").orderBy("time", "grp").limit(limit).collect()
        if len(states) + len(biases) >= limit:
            raise ValueError(f"over {inv.MOST_DENSE} states")
        j = {(r["time"], r["lon"], r["lat"]): k for k, r in enumerate(states)}
        b = {(r["time"], r["grp"]): len(states) + k for k, r in enumerate(biases)}
        states = [*states, *biases]
        h, cov = np.zeros((len(rows), len(states))), np.zeros((len(rows), len(rows)))
        keep = jac.join(z.select(*inv.OBS), inv.OBS, "left_semi").join(prior.select(*inv.STATE), inv.STATE, "left_semi")
        for r in keep.toLocalIterator():
            h[i[(r["obs_location"], r["obs_time"])], j[(r["time"], r["lon"], r["lat"])]] += r["value"]
        if biases:
            for r in inputs.bias_jacobian.join(z.select(*inv.OBS), inv.OBS, "left_semi").toLocalIterator():
                h[i[(r["obs_location"], r["obs_time"])], b[(r["time"], r["grp"])]] += r["value"]
        for r in inputs.obs_cov(z).toLocalIterator():
            cov[i[(r["obs_location"], r["time_i"])], i[(r["obs_location"], r["time_j"])]] += r["value"]
        return rows, states, len(biases), h, cov

    rows, states, n_bias, h, cov = timed("gather", gather)
    n_flux = len(states) - n_bias
    s0, before = np.array([r["value"] for r in states]), np.zeros((len(states), len(states)))
    before[:n_flux, :n_flux] = prior_covariance(states[:n_flux], config)
    if n_bias:
        if not config.bias_std:
            raise ValueError("bias states need bias_std")
        before[n_flux:, n_flux:] = np.eye(n_bias) * config.bias_std**2
    out = timed("solve", lambda: inv.solve_dense(h, np.array([r["value"] for r in rows]), s0, before, cov, config.gamma))
    spark = inputs.obs.sparkSession
    table = [(r["time"], r["lon"], r["lat"], float(v)) for r, v in zip(states[:n_flux], out["posterior"])]
    posterior = spark.createDataFrame(table, "time timestamp_ntz, lon double, lat double, value double")
    metrics = {k: out[k] for k in ("reduced_chi2", "R2", "RMSE", "DOFS", "uncertainty_reduction")}
    bias = None
    if n_bias:
        found = [(r["time"], r["grp"], float(v)) for r, v in zip(states[n_flux:], out["posterior"][n_flux:])]
        bias = spark.createDataFrame(found, "time timestamp_ntz, grp string, value double")
    return Result(posterior, inv.reconstruct(inputs.prior, posterior), metrics, bias, seconds, z, jac, inputs.prior)
