"""Grids, priors, sparse operators, structured covariances and the linear Bayesian solve.

Matrices are long tables: forward operator (obs_location, obs_time, lon, lat, time, value),
state (time, lon, lat, value).  Products are joins followed by sums, so they scale with the number
of non-zeros; covariances are kept as deviations and kernels and are not written out unless asked.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import cell_area_m2
from ..functions.timeutil import duration_us, micros, season, truncated
from .qa import exact_percentiles

MOST_DENSE = 5000  # observations or states of a dense solve on the driver
MOST_TIMES = 100_000  # distinct times matched on the driver
CELL = ["lon", "lat"]
STATE = ["time", "lon", "lat"]
OBS = ["obs_location", "obs_time"]


# --- grids and priors --------------------------------------------------------------------------


def regular_grid(spark: SparkSession, xmin: float, xmax: float, ymin: float, ymax: float, dx: float, dy: float) -> DataFrame:
    """(lon, lat) centres of the cells in the box."""
    nx, ny = round((xmax - xmin) / dx), round((ymax - ymin) / dy)
    return spark.range(nx * ny).select(
        F.round(F.lit(xmin) + (F.floor(F.col("id") / ny) + 0.5) * dx, 9).alias("lon"),
        F.round(F.lit(ymin) + (F.pmod("id", F.lit(ny)) + 0.5) * dy, 9).alias("lat"),
    )


def constant_prior(grid: DataFrame, bins: DataFrame, value: float) -> DataFrame:
    """The value in every cell and bin."""
    starts = bins.select(F.col("bin_start").cast("timestamp_ntz").alias("time"))
    return grid.crossJoin(starts).select(*STATE, F.lit(float(value)).alias("value"))


def sector_sum(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy(*STATE).agg(F.sum("value").alias("value"))


def regrid(field: DataFrame, src: tuple[float, float], dst: tuple[float, float], origin: tuple[float, float]) -> DataFrame:
    """Conservative regridding of (time, lon, lat, value): means weighted by overlap in lon x sin(lat).

    Each source cell is exploded over the target cells that it overlaps; no join.
    """
    (sx, sy), (dx, dy), (ox, oy) = src, dst, origin
    low = lambda c, s, o, d: F.floor((F.col(c) - s / 2 - o) / d + 1e-9)
    high = lambda c, s, o, d: F.ceil((F.col(c) + s / 2 - o) / d - 1e-9) - 1
    cells = field.withColumn("i", F.explode(F.sequence(low("lon", sx, ox, dx), high("lon", sx, ox, dx)))).withColumn(
        "j", F.explode(F.sequence(low("lat", sy, oy, dy), high("lat", sy, oy, dy)))
    )
    x0, y0 = F.lit(ox) + F.col("i") * dx, F.lit(oy) + F.col("j") * dy
    wide = F.least(F.col("lon") + sx / 2, x0 + dx) - F.greatest(F.col("lon") - sx / 2, x0)
    sine = lambda y: F.sin(F.radians(y))
    tall = sine(F.least(F.col("lat") + sy / 2, y0 + dy)) - sine(F.greatest(F.col("lat") - sy / 2, y0))
    full = F.lit(dx) * (sine(y0 + dy) - sine(y0))
    return (
        cells.withColumn("w", wide * tall / full)
        .groupBy("time", F.round(x0 + dx / 2, 9).alias("lon"), F.round(y0 + dy / 2, 9).alias("lat"))
        .agg(F.sum(F.col("w") * F.col("value")).alias("value"))
    )


def _few(df: DataFrame, column: str) -> list:
    """The distinct values of a column, in order; more than ``MOST_TIMES`` raise ValueError, nulls are left out."""
    rows = df.select(column).dropna().distinct().orderBy(column).limit(MOST_TIMES + 1).collect()
    if len(rows) > MOST_TIMES:
        raise ValueError(f"more than {MOST_TIMES} times")
    return [r[0] for r in rows]


def filled_forward(annual: DataFrame, times: DataFrame, keys: list[str]) -> DataFrame:
    """The annual value in force at each of the (few) times: the latest at or before it, by keys."""
    _few(times, "time")
    listed = times.agg(F.array_sort(F.collect_set("time")).alias("t"))
    from pyspark.sql import Window

    after = F.lead("time").over(Window.partitionBy(*keys).orderBy("time"))
    spans = annual.withColumn("__to", after).withColumnRenamed("time", "__from")
    slots = F.filter("t", lambda t: (t >= F.col("__from")) & (F.col("__to").isNull() | (t < F.col("__to"))))
    return spans.join(F.broadcast(listed)).withColumn("time", F.explode(slots)).drop("t", "__from", "__to")


def nearest_time(field: DataFrame, times: DataFrame, keys: list[str]) -> DataFrame:
    """Field values at each of the (few) times, taken from the nearest one there is; ties: the earlier."""
    have = _few(field, "time")

    def nearest(t):
        near = have[max(bisect.bisect_left(have, t) - 1, 0) :][:2]
        return min(near, key=lambda h: (abs((h - t).total_seconds()), h))

    pairs = [(t, nearest(t)) for t in _few(times, "time")] if have else []
    return _taken(field, pairs, keys)


def _taken(field: DataFrame, pairs: list[tuple], keys: list[str]) -> DataFrame:
    """Rows of ``field`` under other times: ``pairs`` of the time wanted and the one whose values it gets."""
    table = field.sparkSession.createDataFrame(pairs, "time timestamp_ntz, __have timestamp_ntz")
    return field.withColumnRenamed("time", "__have").join(F.broadcast(table), "__have").drop("__have").select("time", *keys, "value")


def merged_inventory(annual: DataFrame, monthly: DataFrame) -> DataFrame:
    """(time, lon, lat, sector, value) at the times of ``monthly``: its sectors, and those that only ``annual`` has.

    The latter are taken, at each of the (few) times, from the latest annual time at or before it; times before the first
    have them not, and a cell that an annual time lacks is lacking then, whatever earlier ones have.  Rows with
    a null time or sector are left out; an empty monthly table gives an empty result."""
    columns = ["time", *CELL, "sector", "value"]
    monthly, annual = (df.select(*columns).dropna(subset=["time", "sector"]) for df in (monthly, annual))
    alone = annual.join(monthly.select("sector").distinct(), "sector", "left_anti")
    have = _few(alone, "time")
    pairs = [(t, have[k - 1]) for t in _few(monthly, "time") if (k := bisect.bisect_right(have, t))]
    return monthly.unionByName(_taken(alone, pairs, [*CELL, "sector"]))


def state_blocks(flux: DataFrame, bias: DataFrame | None = None) -> DataFrame:
    """Flux and bias states under each other, with the name of their block."""
    out = flux.withColumn("block", F.lit("flux"))
    return out if bias is None else out.unionByName(bias.withColumn("block", F.lit("bias")), allowMissingColumns=True)


# --- bias --------------------------------------------------------------------------------------


def bias_states(bins: DataFrame, grouping: str | None = None, sites: list[str] = (), orgs: dict[str, str] | None = None) -> DataFrame:
    """(time [, grp], value 0.0) by time, site or organization of the site (in order, once each)."""
    if grouping in (None, "time"):
        return bins.select(F.col("bin_start").alias("time"), F.lit(0.0).alias("value"))
    names = list(sites) if grouping == "site" else [(orgs or {}).get(s, "unknown") for s in sites]
    if grouping not in ("site", "site_group"):
        raise ValueError(f"unknown bias grouping {grouping!r}")
    listed = F.array(*map(F.lit, dict.fromkeys(names)))
    return bins.select(F.col("bin_start").alias("time"), F.explode(listed).alias("grp"), F.lit(0.0).alias("value"))


def bias_jacobian(obs: DataFrame, bins: DataFrame, grouping: str | None = None, orgs: dict[str, str] | None = None) -> DataFrame:
    """One 1.0 per observation in its (of few) bin (and group); observations outside all bins have no row."""
    _few(bins, "bin_start")
    span = F.array_sort(F.collect_list(F.struct("bin_start", "bin_end"))).alias("bins")
    rows = obs.select(*OBS).join(F.broadcast(bins.agg(span)))
    hit = F.filter("bins", lambda b: (b["bin_start"] <= F.col("obs_time")) & (F.col("obs_time") < b["bin_end"]))
    rows = rows.withColumn("time", F.get(hit, F.lit(0))["bin_start"]).dropna(subset=["time"]).drop("bins")
    if grouping == "site":
        rows = rows.withColumn("grp", F.col("obs_location"))
    elif grouping == "site_group":
        pairs = [F.lit(x) for kv in (orgs or {"": "unknown"}).items() for x in kv]
        rows = rows.withColumn("grp", F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("obs_location")), F.lit("unknown")))
    elif grouping not in (None, "time"):
        raise ValueError(f"unknown bias grouping {grouping!r}")
    return rows.withColumn("value", F.lit(1.0))


# --- forward operator --------------------------------------------------------------------------


def footprint_jacobian(foot: DataFrame, dx: float, dy: float, xmin: float, ymin: float, bin_unit: str = "MONTH") -> DataFrame:
    """Footprint cells summed to grid cells and flux bins, by receptor."""
    snap = lambda c, o, d: F.round(F.lit(o) + (F.floor((F.col(c) - o) / d + 1e-9) + 0.5) * d, 9)
    rows = foot.select(
        *OBS, truncated(bin_unit, F.col("foot_time")).alias("time"), snap("lon", xmin, dx).alias("lon"), snap("lat", ymin, dy).alias("lat"), "foot"
    )
    return rows.groupBy(*OBS, *STATE).agg(F.sum("foot").alias("value"))


def filled(entries: DataFrame, states: DataFrame, keys: list[str], value: float = 0.0) -> DataFrame:
    """(keys, value) of every state, once each: its entry, or ``value`` where there is none; entries of no state are left out."""
    have = entries.select(*keys, F.col("value").alias("__have"))
    return states.select(*keys).distinct().join(have, keys, "left").select(*keys, F.coalesce("__have", F.lit(float(value))).alias("value"))


def spmv(matrix: DataFrame, vector: DataFrame, on: list[str], rows: list[str], name: str = "value") -> DataFrame:
    """matrix x vector: join on the columns ``on``, summed by the columns ``rows``."""
    v = vector.select(*on, F.col("value").alias("__x"))
    return matrix.join(v, on).groupBy(*rows).agg(F.sum(F.col("value") * F.col("__x")).alias(name))


def coverage(jacobian: DataFrame, location: str = "obs_location", cell: list[str] = CELL) -> DataFrame:
    """Sum of absolute sensitivities of each cell per observation location."""
    n = jacobian.agg(F.count_distinct(location)).first()[0]
    return jacobian.groupBy(*cell).agg((F.sum(F.abs("value")) / F.lit(float(n or 1))).alias("coverage"))


def split_cells(cover: DataFrame, percentile: float, cell: list[str] = CELL) -> tuple[DataFrame, DataFrame]:
    """(retained, removed) cells; those at or above the percentile of coverage stay."""
    limit = cover.agg(F.percentile("coverage", F.lit(percentile / 100))).first()[0]
    limit = float("-inf") if limit is None else limit
    return cover.where(F.col("coverage") >= limit).select(*cell), cover.where(F.col("coverage") < limit).select(*cell)


def coverage_filter(prior: DataFrame, jacobian: DataFrame, constant: DataFrame, percentile: float):
    """Prior and operator without weak cells, and the constant with their prior contribution added.

    The contribution is joined by observation, so order does not matter.
    """
    retained, removed = split_cells(coverage(jacobian), percentile)
    keep = lambda df, cells: df.join(cells, CELL, "left_semi")
    gone = spmv(keep(jacobian, removed), keep(prior, removed), STATE, OBS, "removed")
    constant = constant.join(gone, OBS, "left").withColumn("value", F.col("value") + F.coalesce("removed", F.lit(0.0)))
    return keep(prior, retained), keep(jacobian, retained), constant.drop("removed"), removed


def reconstruct(prior: DataFrame, posterior: DataFrame, keys: list[str] = STATE) -> DataFrame:
    """The posterior where it was estimated, else the prior."""
    post = posterior.select(*keys, F.col("value").alias("__post"))
    return prior.join(post, keys, "left").withColumn("value", F.coalesce("__post", "value")).drop("__post")


def aggregate_space(table: DataFrame, keys: list[str], unit: str = "DAY", others: list[str] = ()) -> DataFrame:
    """Mean by location and period: the same weights for observations, constant and operator rows.

    ``others`` are further keys (state columns); a missing operator entry counts as 0, so entries are
    divided by the number of observations of the period, given as ``__n``.
    """
    rows = table.withColumn("obs_time", F.date_trunc(unit, "obs_time").cast("timestamp_ntz"))
    size = F.max("__n") if "__n" in table.columns else F.count("value")
    return rows.groupBy(*keys, *others).agg((F.sum("value") / size).alias("value"))


# --- covariances ---------------------------------------------------------------------------------

#: Default components of the model-data mismatch (ppm).
MDM = {
    "part": {"std": 0.000765, "correlated": False},
    "instr": {"std": {"UATAQ": 0.0033, "DAQ": 0.0099}, "correlated": False},
    "aggr": {"std": 0.0257, "scale": None, "interday": False},
    "bg": {"std": 0.011, "scale": "7d", "interday": True},
    "transport_wind": {
        "std": {
            "bv": {"DJF": 0.01631, "JJA": 0.00849, "MAM": 0.00977, "SON": 0.00977},
            "ed": {"DJF": 0.0171, "JJA": 0.00498, "MAM": 0.00598, "SON": 0.00846},
            "hw": {"DJF": 0.01643, "JJA": 0.00466, "MAM": 0.01141, "SON": 0.00677},
            "rb": {"DJF": 0.01914, "JJA": 0.00445, "MAM": 0.00849, "SON": 0.00892},
            "ut": {"DJF": 0.0096, "JJA": 0.00966, "MAM": 0.0084, "SON": 0.00597},
            "wbb": {"DJF": 0.01311, "JJA": 0.00536, "MAM": 0.00949, "SON": 0.00658},
            "zz": {"DJF": 0.00568, "JJA": 0.00859, "MAM": math.nan, "SON": 0.01174},
        },
        "scale": "2.8h",
        "interday": False,
    },
    "transport_pbl": {"std": 0.00771, "scale": "2.8h", "interday": False},
}


def mdm_components(config: dict[str, dict]) -> list[dict]:
    """Default components, each with what ``config`` says about it; unknown names are left out."""
    return [{"name": name, **default, **config.get(name, {})} for name, default in MDM.items()]


def sigma(std, orgs: dict[str, str] | None = None) -> Column:
    """Deviation of an observation: one number, by organization, or by site and season; none known: an error at run time."""
    if not isinstance(std, dict):
        return F.lit(float(std))
    nested = isinstance(next(iter(std.values())), dict)
    if nested:
        flat = {f"{s}|{k}": float(v) for s, by in std.items() for k, v in by.items()}
        key = F.concat_ws("|", "obs_location", season(F.col("obs_time")))
    else:
        if orgs is None:
            raise ValueError("deviations by organization need the sites' organizations")
        flat = {s: float(std[o]) for s, o in orgs.items() if o in std}
        key = F.col("obs_location")
    pairs = [F.lit(x) for kv in flat.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), key) if pairs else F.lit(None).cast("double")
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("no deviation for "), key)).cast("double"))


def mdm_entries(obs: DataFrame, std, correlated: bool = True, scale: str | None = None, interday: bool = False, orgs=None, **_) -> DataFrame:
    """Entries (location, time_i, time_j, value) of one component.

    Blocks are locations (and days, unless ``interday``).  Within a block all pairs are entries of the
    matrix by definition; use ``mdm_product`` where only products with vectors are needed.
    """
    rows = obs.select(*OBS).distinct().withColumn("s", sigma(std, orgs))
    if not correlated:
        return rows.select("obs_location", F.col("obs_time").alias("time_i"), F.col("obs_time").alias("time_j"), (F.col("s") * F.col("s")).alias("value"))
    rows = rows.withColumn("__day", F.lit(None).cast("date") if interday else F.to_date("obs_time"))
    side = lambda k: rows.select("obs_location", "__day", F.col("obs_time").alias(f"time_{k}"), F.col("s").alias(f"s_{k}"))
    pairs = side("i").join(side("j"), ["obs_location"] if interday else ["obs_location", "__day"])
    kernel = F.lit(1.0)
    if scale is not None:
        kernel = F.exp(-F.abs(micros(F.col("time_i")) - micros(F.col("time_j"))) / F.lit(float(duration_us(scale))))
    return pairs.select("obs_location", "time_i", "time_j", (F.col("s_i") * F.col("s_j") * kernel).alias("value"))


def mdm_matrix(obs: DataFrame, components: list[dict], orgs=None) -> DataFrame:
    """Sum of all components, by entry."""
    from functools import reduce

    parts = [mdm_entries(obs, orgs=orgs, **{k: v for k, v in c.items() if k != "name"}) for c in components]
    return reduce(DataFrame.unionByName, parts).groupBy("obs_location", "time_i", "time_j").agg(F.sum("value").alias("value"))


def mdm_product(obs: DataFrame, std, scale: str, interday: bool = False, orgs=None, carry: list[str] = ()) -> DataFrame:
    """Component x vector ``value`` without its matrix: the exponential kernel is a recurrence over time.

    A task scans the rows of one location and day in both directions; with ``interday`` what the days
    before and behind add is carried from day to day, over one short row a day.  The cost is linear in
    the rows.  Rows with a null key or value are left out.  ``carry`` names further keys: vectors side by side.
    """
    tau, carry = float(duration_us(scale)), list(carry)
    also = "".join(f"{c} {dict(obs.dtypes)[c]}, " for c in carry)

    def apart(pdf: pd.DataFrame) -> np.ndarray:
        """Where a row begins another vector than the one before: nothing is carried over."""
        return pdf[carry].ne(pdf[carry].shift()).any(axis=1).to_numpy()[1:] if carry else np.zeros(max(len(pdf) - 1, 0), bool)

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*carry, "us"], ignore_index=True)
        x = (pdf["s"] * pdf["value"]).to_numpy(np.float64)
        decay = np.exp(-np.abs(np.diff(pdf["us"].to_numpy(np.float64))) / tau) * ~apart(pdf)
        left, right = x.copy(), x.copy()
        for i in range(1, len(x)):
            left[i] += decay[i - 1] * left[i - 1]
            right[-1 - i] += decay[-i] * right[-i]
        pdf["left"], pdf["right"] = left, right
        pdf["value"] = pdf["s"] * (left + right - x)
        return pdf[[*carry, "obs_location", "obs_time", "us", "s", "left", "right", "value"]]

    rows = obs.select(*carry, *OBS, F.col("value").cast("double").alias("value")).dropna()
    rows = rows.withColumns({"s": sigma(std, orgs), "us": micros(F.col("obs_time")), "day": F.to_date("obs_time")})
    kind = f"{also}obs_location string, obs_time timestamp_ntz, us long, s double, left double, right double, value double"
    within = rows.groupBy("obs_location", "day").applyInPandas(scan, kind)
    if not interday:
        return within.select(*carry, *OBS, "value")

    def over_days(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*carry, "day"], ignore_index=True)
        first, last, left, right = (pdf[c].to_numpy(np.float64) for c in ("first", "last", "left", "right"))
        before, behind = np.zeros(len(pdf)), np.zeros(len(pdf))  # as seen from a day's first and last row
        across, gap = np.exp((first - last) / tau), np.exp(-np.abs(first[1:] - last[:-1]) / tau) * ~apart(pdf)
        for i in range(1, len(pdf)):
            before[i] = (left[i - 1] + before[i - 1] * across[i - 1]) * gap[i - 1]
            k = len(pdf) - 1 - i
            behind[k] = (right[k + 1] + behind[k + 1] * across[k + 1]) * gap[k]
        pdf["before"], pdf["behind"] = before, behind
        return pdf[[*carry, "obs_location", "day", "first", "last", "before", "behind"]]

    within = within.withColumn("day", F.to_date("obs_time"))
    days = within.groupBy(*carry, "obs_location", "day").agg(
        F.min("us").alias("first"), F.max("us").alias("last"), F.max_by("left", "us").alias("left"), F.min_by("right", "us").alias("right")
    )
    kind = f"{also}obs_location string, day date, first long, last long, before double, behind double"
    carried = days.groupBy("obs_location").applyInPandas(over_days, kind)
    decayed = lambda c, a, b: F.col(c) * F.exp((F.col(a) - F.col(b)) / F.lit(tau))
    more = F.col("s") * (decayed("before", "first", "us") + decayed("behind", "us", "last"))
    return within.join(carried, [*carry, "obs_location", "day"]).select(*carry, *OBS, (F.col("value") + more).alias("value"))


def prior_sigma(prior: DataFrame, base_std: float = 0.019, std_frac: float = 0.5) -> DataFrame:
    return prior.withColumn("sigma", F.lit(base_std) + F.lit(std_frac) * F.col("value"))


def kernel_table(left: DataFrame, key: str, scale_us: float) -> DataFrame:
    """(key_i, key_j, k): exponential decay between the (few) times of a state."""
    times = [r[0] for r in left.select(key).distinct().orderBy(key).limit(MOST_DENSE + 1).collect()]
    if len(times) > MOST_DENSE:
        raise ValueError(f"more than {MOST_DENSE} times")
    listed = F.array(*(F.lit(str(t)).cast("timestamp_ntz") for t in times))
    pairs = left.sparkSession.range(1).select(F.explode(listed).alias("key_i")).withColumn("key_j", F.explode(listed))
    return pairs.withColumn("k", F.exp(-F.abs(micros(F.col("key_i")) - micros(F.col("key_j"))) / F.lit(scale_us)))


# --- solve ---------------------------------------------------------------------------------------


def solve_dense(h: np.ndarray, z: np.ndarray, s0: np.ndarray, prior_cov: np.ndarray, obs_cov: np.ndarray, gamma: float | None = None) -> dict:
    """Posterior of the linear Gaussian problem z = H s + e (Rodgers 2000), on the driver.

    For problems of at most ``MOST_DENSE`` observations and states; larger ones: ``solvers.solve``.
    """
    if max(h.shape) > MOST_DENSE:
        raise ValueError(f"over {MOST_DENSE} rows or columns; use solvers.solve")
    obs_cov = obs_cov / gamma if gamma else obs_cov
    hs = h @ prior_cov
    inner = hs @ h.T + obs_cov
    gain = np.linalg.solve(inner, hs).T
    post = s0 + gain @ (z - h @ s0)
    post_cov = prior_cov - gain @ hs
    resid = z - h @ post
    step = post - s0
    chi2 = resid @ np.linalg.solve(obs_cov, resid) + step @ np.linalg.solve(prior_cov, step)
    fitted = h @ post
    corr = np.corrcoef(z, fitted)[0, 1] if len(z) > 1 else np.nan
    return {
        "posterior": post,
        "posterior_cov": post_cov,
        "reduced_chi2": float(chi2 / len(z)),
        "R2": float(corr**2),
        "RMSE": float(np.sqrt(np.mean(resid**2))),
        "DOFS": float(np.trace(gain @ h)),
        "uncertainty_reduction": float(1 - np.sqrt(np.diag(post_cov)).sum() / np.sqrt(np.diag(prior_cov)).sum()),
    }


# --- diagnostics ---------------------------------------------------------------------------------


def desroziers(table: DataFrame, keys: list[str], prior: str = "prior_residual", post: str = "posterior_residual", specified: str = "specified") -> DataFrame:
    """Diagnosed over specified error variance by group: mean of (z - H s_post)(z - H s_prior)."""
    out = table.groupBy(*keys).agg(F.avg(F.col(post) * F.col(prior)).alias("diagnosed"), F.avg(specified).alias("specified"))
    return out.withColumn("ratio", F.try_divide("diagnosed", "specified"))


def flux_metrics(prior: DataFrame, posterior: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Means of totals (keys, time, total) over time, deviation of the posterior (null for one time), change in percent.

    The change is null where the prior's mean is 0 or there is none; a group that only one table has keeps nulls for the other."""
    side = lambda df, a, b: df.select(*keys, F.col("total").cast("double").alias(a), F.lit(None).cast("double").alias(b))
    both = side(prior, "p", "q").unionByName(side(posterior, "q", "p"))
    out = both.groupBy(*keys).agg(F.avg("p").alias("prior_flux_mean"), F.avg("q").alias("posterior_flux_mean"), F.stddev_samp("q").alias("posterior_flux_std"))
    change = F.col("posterior_flux_mean") - F.col("prior_flux_mean")
    return out.withColumn("flux_change_pct", F.try_divide(change, "prior_flux_mean") * 100)


def fit_metrics(table: DataFrame, keys: list[str] = ()) -> DataFrame:
    """RMSE, bias and number of prior and posterior residuals of (observed, prior, posterior)."""
    rp, rq = F.col("observed") - F.col("prior"), F.col("observed") - F.col("posterior")
    return table.groupBy(*keys).agg(
        F.sqrt(F.avg(rp * rp)).alias("prior_conc_rmse"),
        F.sqrt(F.avg(rq * rq)).alias("posterior_conc_rmse"),
        F.avg(rp).alias("prior_conc_bias"),
        F.avg(rq).alias("posterior_conc_bias"),
        F.count("observed").alias("n_obs"),
    )


def trend(table: DataFrame, x: str, y: str, keys: list[str] = ()) -> DataFrame:
    """Least-squares slope, intercept and R2 of groups with more than two points."""
    return (
        table.groupBy(*keys)
        .agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))
        .where("n > 2")
    )


def trend_p_value(r2: float, n: int) -> float:
    """Two-sided p of the slope: Student's t with n - 2 degrees of freedom, by quadrature."""
    if n <= 2 or r2 >= 1:
        return 0.0 if r2 >= 1 else math.nan
    v = n - 2
    t = math.sqrt(r2 * v / (1 - r2))
    grid = np.linspace(0.0, math.atan(t / math.sqrt(v)), 20001)
    density = np.cos(grid) ** (v - 1)
    total = math.sqrt(math.pi) * math.gamma(v / 2) / math.gamma((v + 1) / 2) if v < 300 else math.sqrt(2 * math.pi / v)
    return float(max(0.0, 1 - 2 * np.trapezoid(density, grid) / total))


def frobenius(entries: DataFrame, keys: list[str]) -> DataFrame:
    return entries.groupBy(*keys).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))


def five_numbers(table: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    names = ("low", "q1", "median", "q3", "high")
    return exact_percentiles(table, value, [0.0, 0.25, 0.5, 0.75, 1.0], list(keys)).select(*keys, *(F.col("q")[k].alias(n) for k, n in enumerate(names)))


def emissions(fluxes: DataFrame, dlon: float, dlat: float, seconds: float) -> DataFrame:
    """Amount per cell and step of fluxes per area and second."""
    return fluxes.withColumn("value", F.col("value") * cell_area_m2(F.col("lat"), dlon, dlat) * F.lit(float(seconds)))


#: Seconds of an inventory step by flux frequency.
STEP_SECONDS = {"YS": 31_557_600, "QS": 7_889_400, "MS": 2_629_800, "2W": 1_209_600, "D": 86_400}


def inventory_seconds(freq: str) -> int:
    return STEP_SECONDS[freq]


def resample(fluxes: DataFrame, keys: list[str], have: str, want: str) -> DataFrame:
    """Means of (time, keys, value) over longer steps; a step that is not longer leaves the table as it is."""
    if inventory_seconds(want) <= inventory_seconds(have):
        return fluxes
    unit = {"YS": "YEAR", "QS": "QUARTER", "MS": "MONTH"}[want]
    start = F.date_trunc(unit, "time").cast("timestamp_ntz").alias("time")
    return fluxes.groupBy(start, *keys).agg(F.avg("value").alias("value"))


#: Powers of ten from g/m2/s to a unit of mass.
MASS = {"g": 0, "kg": -3, "Mg": -6, "Gg": -9, "Tg": -12}


def in_units(fluxes: DataFrame, have: str, want: str) -> DataFrame:
    """Values of mass per area and time in another unit of mass; area and time must agree ("Gg/m2/s")."""
    (a, _, rest), (b, _, other) = have.partition("/"), want.partition("/")
    if rest != other or a not in MASS or b not in MASS:
        raise ValueError(f"cannot turn {have!r} into {want!r}")
    return fluxes.withColumn("value", F.col("value") * F.lit(10.0 ** (MASS[b] - MASS[a])))
