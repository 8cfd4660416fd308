"""Curve fit of a background series (Thoning, Tans & Komhyr, 1989)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_SAMPLES = 200_000  # fitted on the driver
SAMPLE_TYPES = {"mbo": "pfp", "uta": "flask"}


def design(t: np.ndarray, poly: int = 3, harmonics: int = 4) -> np.ndarray:
    cols = [t**k for k in range(poly)]
    for k in range(1, harmonics + 1):
        cols += [np.sin(2 * np.pi * k * t), np.cos(2 * np.pi * k * t)]
    return np.column_stack(cols)


@dataclass(frozen=True)
class Curve:
    """A fitted curve: coefficients from the year ``base`` on, and the low-passed residual by day."""

    base: float
    coef: np.ndarray
    days: np.ndarray
    low: np.ndarray
    poly: int
    harmonics: int

    def at(self, year: np.ndarray) -> np.ndarray:
        return design(year - self.base, self.poly, self.harmonics) @ self.coef + np.interp(year, self.days, self.low)


def fitted_curve(t: np.ndarray, y: np.ndarray, cutoff_days: float = 80.0, poly: int = 3, harmonics: int = 4) -> Curve:
    """Polynomial and harmonics by least squares over samples in the order of ``t`` (decimal years), and the low-passed residual."""
    base = t.min()
    coef, *_ = np.linalg.lstsq(design(t - base, poly, harmonics), y, rcond=None)
    days = np.arange(t.min(), t.max() + 1 / 365.25, 1 / 365.25)
    resid = np.interp(days, t, y - design(t - base, poly, harmonics) @ coef)
    freq = np.fft.rfftfreq(len(days), d=1 / 365.25)
    keep = np.exp(-np.log(2) * (freq * cutoff_days / 365.25) ** 6)
    return Curve(base, coef, days, np.fft.irfft(np.fft.rfft(resid) * keep, n=len(days)), poly, harmonics)


def smooth_curve(t: np.ndarray, y: np.ndarray, at: np.ndarray, cutoff_days: float = 80.0) -> np.ndarray:
    """The fitted curve at decimal years ``at``."""
    return fitted_curve(t, y, cutoff_days).at(at)


def fitted_background(samples: DataFrame, obs: DataFrame, site: str, sample_type: str | None = None, **shape) -> DataFrame:
    """(obs_time, background in ppm) at the times of ``obs`` (obs_time, year) from discrete samples (year, value in ppb).

    A site's samples are weekly, so a record of decades is a few thousand rows; they are fitted once on the
    driver, the curve (a value a day) is evaluated on the executors.  Samples with a null are left out, a null time
    has a null background, and without samples there is none.  A site without a known type of samples needs ``sample_type``;
    ``shape``: cutoff_days, poly, harmonics.
    """
    if site.lower() not in SAMPLE_TYPES and sample_type is None:
        raise ValueError(f"no samples of {site!r}")
    pdf = samples.select("year", "value").dropna().orderBy("year", "value").limit(MOST_SAMPLES + 1).toPandas()
    if len(pdf) > MOST_SAMPLES:
        raise ValueError(f"more than {MOST_SAMPLES} samples")
    if pdf.empty:
        return obs.select("obs_time", F.lit(None).cast("double").alias("background"))
    curve = fitted_curve(pdf["year"].to_numpy(float), pdf["value"].to_numpy(float), **shape)

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"obs_time": b["obs_time"], "background": curve.at(b["year"].to_numpy(float)) / 1000})

    return obs.select("obs_time", "year").mapInPandas(run, "obs_time timestamp_ntz, background double")
