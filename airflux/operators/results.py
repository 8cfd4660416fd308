"""Selectors and summaries of sweep results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_distance(results: DataFrame, target: float = 1.0) -> DataFrame:
    if "chi2_distance" in results.columns:
        return results
    return results.withColumn("chi2_distance", F.abs(F.col("reduced_chi2") - target))


def ranked(results: DataFrame) -> DataFrame:
    return with_distance(results).orderBy(F.asc_nulls_last("chi2_distance"))


def best(results: DataFrame, target: float = 1.0, tol: float = 0.1) -> DataFrame:
    return results.where(F.abs(F.col("reduced_chi2") - target) < tol)


def failed(results: DataFrame) -> DataFrame:
    return results.where(F.col("error").isNotNull())


def stability(results: DataFrame, params: list[str], metric: str) -> DataFrame:
    """Mean, deviation and number of a metric by parameters, the most stable first (in the sort, where wanted)."""
    return results.dropna(subset=params).groupBy(*params).agg(
        F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.count(metric).alias("count")
    )


def sensitivity(results: DataFrame, params: list[str], metric: str) -> DataFrame:
    """By parameter: range of the group means, and the value with the least mean."""
    long = results.select(metric, *(F.col(p).cast("string").alias(p) for p in params)).unpivot(metric, params, "param", "setting")
    means = long.where("setting is not null").groupBy("param", "setting").agg(F.avg(metric).alias("m"))
    return means.groupBy("param").agg((F.max("m") - F.min("m")).alias("range"), F.min_by("setting", F.struct("m", "setting")).alias("best_setting"))


def heatmap(results: DataFrame, x: str, y: str, metric: str, values: list) -> DataFrame:
    return results.groupBy(y).pivot(x, values).agg(F.avg(metric))


def best_row(results: DataFrame) -> DataFrame:
    """The row whose chi2_distance is least: one row, or none."""
    return results.orderBy(F.asc_nulls_last("chi2_distance"), "config_id").limit(1)
