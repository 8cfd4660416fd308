"""Structured covariances without their matrices: Kronecker priors, model-data mismatch, its aggregates.

A vector is a table with a ``value`` for each key (STATE or OBS); further columns, such as the number of a
right-hand side, may ride along and are named by ``carry``.  Rows with a null key or value are left out; a
vector without rows gives one without rows; rows that repeat a key count as several entries of it.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_M, haversine_km
from ..functions.timeutil import duration_us, micros
from .inversion import OBS, STATE, mdm_product, sigma

FORGOTTEN = 28.0  # lengths of decay after which exp() is below the rounding of a sum


# --- Kronecker prior -----------------------------------------------------------------------------


def spatial_kernel(cells: DataFrame, scale_km: float, reach_km: float | None = None) -> DataFrame:
    """(lon_i, lat_i, lon_j, lat_j, k): exponential decay with the distance of cells within ``reach_km``.

    Cells meet by blocks as wide as the reach and their eight neighbours, not each with each.  The reach is 28
    scales unless given: what lies beyond is below rounding.  The grid must not cross the date line."""
    reach = FORGOTTEN * scale_km if reach_km is None else reach_km
    cells = cells.select("lon", "lat").dropna().distinct()
    far = cells.agg(F.max(F.abs("lat"))).first()[0] or 0.0
    degree = EARTH_M / 1000 * math.pi / 180
    tall, wide = reach / degree * 1.001, reach / (degree * max(math.cos(math.radians(min(far + reach / degree, 90.0))), 0.01)) * 1.001
    at = lambda c, d: F.floor(F.col(c) / F.lit(d)).cast("long")
    left = cells.toDF("lon_i", "lat_i").withColumns({"x": at("lon_i", wide), "y": at("lat_i", tall)})
    right = cells.toDF("lon_j", "lat_j").withColumns({"x": at("lon_j", wide), "y": at("lat_j", tall)})
    near = lambda c: F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.col(c) + k))
    left = left.withColumn("x", near("x")).withColumn("y", near("y"))
    pairs = left.join(right, ["x", "y"]).withColumn("km", haversine_km(F.col("lat_i"), F.col("lon_i"), F.col("lat_j"), F.col("lon_j")))
    return pairs.where(F.col("km") <= reach).select("lon_i", "lat_i", "lon_j", "lat_j", F.exp(-F.col("km") / F.lit(float(scale_km))).alias("k"))


def kronecker_product(x: DataFrame, spread: DataFrame, times: DataFrame, cells: DataFrame, carry: list[str] = ()) -> DataFrame:
    """diag(s) (T x S) diag(s) times the vector ``x`` (carry, STATE, value).

    ``spread`` (STATE, sigma) lists the states, ``times`` (key_i, key_j, k) is T, ``cells`` is S as
    ``spatial_kernel`` gives it: one join over times and one over cells, each summed at once."""
    s = spread.select(*STATE, F.col("sigma").alias("__s"))
    scaled = x.join(s, STATE).select(*carry, *STATE, (F.col("value") * F.col("__s")).alias("__v"))
    t = times.select(F.col("key_j").alias("time"), "key_i", "k")
    over = scaled.join(t, "time").groupBy(*carry, F.col("key_i").alias("time"), "lon", "lat").agg(F.sum(F.col("__v") * F.col("k")).alias("__v"))
    c = cells.select(F.col("lon_j").alias("lon"), F.col("lat_j").alias("lat"), "lon_i", "lat_i", "k")
    over = over.join(c, ["lon", "lat"]).groupBy(*carry, "time", F.col("lon_i").alias("lon"), F.col("lat_i").alias("lat"))
    over = over.agg(F.sum(F.col("__v") * F.col("k")).alias("__v"))
    return over.join(s, STATE).select(*carry, *STATE, (F.col("__v") * F.col("__s")).alias("value"))


# --- model-data mismatch ---------------------------------------------------------------------------


def mismatch_product(x: DataFrame, components: list[dict], orgs: dict[str, str] | None = None, carry: list[str] = ()) -> DataFrame:
    """Sum of all components times the vector ``x`` (carry, OBS, value), in linear scans.

    Uncorrelated components are a factor a row; those without a scale are constant within a block (location and
    day, or location where ``interday``): two sums a block; the others are recurrences over time."""
    rows = x.select(*carry, *OBS, F.col("value").cast("double").alias("value")).dropna()
    parts = []
    for c in components:
        s = sigma(c["std"], orgs)
        if not c.get("correlated", True):
            parts.append(rows.withColumn("value", s * s * F.col("value")))
        elif c.get("scale") is None:
            block = [*carry, "obs_location", *([] if c.get("interday") else ["__day"])]
            own = rows.withColumns({"__s": s, "__day": F.to_date("obs_time")})
            total = own.groupBy(*block).agg(F.sum(F.col("__s") * F.col("value")).alias("__sum"))
            parts.append(own.join(total, block).select(*carry, *OBS, (F.col("__s") * F.col("__sum")).alias("value")))
        else:
            parts.append(mdm_product(rows, c["std"], c["scale"], bool(c.get("interday")), orgs, list(carry)))
    return reduce(DataFrame.unionByName, parts).groupBy(*carry, *OBS).agg(F.sum("value").alias("value"))


def mismatch_variance(obs: DataFrame, components: list[dict], orgs: dict[str, str] | None = None) -> DataFrame:
    """(OBS, value): the diagonal of the sum of all components."""
    total = sum((sigma(c["std"], orgs) * sigma(c["std"], orgs) for c in components), F.lit(0.0))
    return obs.select(*OBS).dropna().distinct().withColumn("value", total)


def mismatch_row_sums(obs: DataFrame, components: list[dict], orgs: dict[str, str] | None = None) -> DataFrame:
    """(OBS, value, n): sum and number of the entries of each row of the matrix, from linear scans."""
    rows = obs.select(*OBS).dropna().distinct().withColumn("value", F.lit(1.0))
    linked = [c for c in components if c.get("correlated", True)]
    sums = mismatch_product(rows, components, orgs)
    if not linked:
        return sums.withColumn("n", F.lit(1).cast("long"))
    keys = ["obs_location", *([] if any(c.get("interday") for c in linked) else ["__day"])]
    sums = sums.withColumn("__day", F.to_date("obs_time"))
    return sums.join(sums.groupBy(*keys).agg(F.count("*").alias("n")), keys).select(*OBS, "value", "n")


PART = "obs_location string, __block date, __bin timestamp_ntz, n long, first long, last long, left double, right double, inside double"


def _bin_parts(obs: DataFrame, component: dict, unit: str, orgs: dict[str, str] | None) -> DataFrame:
    """One row for each block and period: what other periods need of it, and the sum over its own pairs."""
    tau = float(duration_us(component["scale"])) if component.get("scale") is not None else math.inf

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("us", ignore_index=True)
        us, s = pdf["us"].to_numpy(np.float64), pdf["s"].to_numpy(np.float64)
        decay, left, inside = np.exp(-np.diff(us) / tau), 0.0, 0.0
        for i in range(len(s)):
            before = left * decay[i - 1] if i else 0.0
            inside += s[i] * (2 * before + s[i])
            left = before + s[i]
        head = pdf.iloc[0]
        right = float((s * np.exp(-(us - us[0]) / tau)).sum())
        return pd.DataFrame(
            [(head["obs_location"], head["__block"], head["__bin"], len(s), int(us[0]), int(us[-1]), left, right, inside)],
            columns=["obs_location", "__block", "__bin", "n", "first", "last", "left", "right", "inside"],
        )

    day = F.lit(None).cast("date") if component.get("interday") else F.to_date("obs_time")
    rows = obs.select(*OBS).dropna().distinct().withColumns({"s": sigma(component["std"], orgs), "us": micros(F.col("obs_time")), "__block": day})
    rows = rows.withColumn("__bin", F.date_trunc(unit, "obs_time").cast("timestamp_ntz"))
    return rows.groupBy("obs_location", "__block", "__bin").applyInPandas(scan, PART)


def aggregated_mismatch(obs: DataFrame, components: list[dict], unit: str = "DAY", orgs: dict[str, str] | None = None) -> DataFrame:
    """Entries (obs_location, time_i, time_j, value) of W S W': the mismatch of means by location and period.

    A pair of periods has the sum over all pairs of their observations, divided by both numbers of them.
    Within a period it is a recurrence over time; between periods the kernel factorises, so a period meets the
    others as one row.  Periods are linked within a location only where a component spans days, as the
    result itself has these entries; elsewhere only periods shorter than a day meet, within the day."""
    counts = obs.select(*OBS).dropna().distinct().groupBy("obs_location", F.date_trunc(unit, "obs_time").cast("timestamp_ntz").alias("__bin")).agg(F.count("*").alias("n"))
    entries = []
    for c in components:
        if not c.get("correlated", True):
            s = sigma(c["std"], orgs)
            own = obs.select(*OBS).dropna().distinct().groupBy("obs_location", F.date_trunc(unit, "obs_time").cast("timestamp_ntz").alias("time_i")).agg(F.sum(s * s).alias("value"))
            entries.append(own.select("obs_location", "time_i", F.col("time_i").alias("time_j"), "value"))
            continue
        parts = _bin_parts(obs, c, unit, orgs)
        entries.append(parts.select("obs_location", F.col("__bin").alias("time_i"), F.col("__bin").alias("time_j"), F.col("inside").alias("value")))
        if c.get("interday") or unit.upper() in ("HOUR", "MINUTE", "SECOND"):
            side = lambda k, *more: parts.select("obs_location", F.coalesce("__block", F.lit("1970-01-01").cast("date")).alias("__block"), F.col("__bin").alias(f"time_{k}"), *(F.col(m).alias(f"{m}_{k}") for m in more))
            tau = F.lit(float(duration_us(c["scale"]))) if c.get("scale") is not None else None
            pairs = side("i", "last", "left").join(side("j", "first", "right"), ["obs_location", "__block"]).where("time_i < time_j")
            k = F.exp((F.col("last_i") - F.col("first_j")) / tau) if tau is not None else F.lit(1.0)
            pairs = pairs.withColumn("value", F.col("left_i") * F.col("right_j") * k)
            entries += [pairs.select("obs_location", "time_i", "time_j", "value"), pairs.select("obs_location", F.col("time_j").alias("time_i"), F.col("time_i").alias("time_j"), "value")]
    total = reduce(DataFrame.unionByName, entries).groupBy("obs_location", "time_i", "time_j").agg(F.sum("value").alias("value"))
    size = lambda k: counts.select("obs_location", F.col("__bin").alias(f"time_{k}"), F.col("n").alias(f"n_{k}"))
    sized = total.join(size("i"), ["obs_location", "time_i"]).join(size("j"), ["obs_location", "time_j"])
    return sized.select("obs_location", "time_i", "time_j", (F.col("value") / (F.col("n_i") * F.col("n_j"))).alias("value"))
