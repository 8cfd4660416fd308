"""Hourly means over a stream of observations, with late data dropped behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_stream(obs: DataFrame, time: str = "Time_UTC", value: str = "CH4", late: str = "2 hours") -> DataFrame:
    """(site, hour, mean, n); works on streams and on tables.  Watermarks need TIMESTAMP, so times are cast."""
    rows = obs.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    out = rows.groupBy("site", F.window("__t", "1 hour")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return out.select("site", F.col("window.start").cast("timestamp_ntz").alias("hour"), "mean", "n")


def sessions(obs: DataFrame, time: str = "Time_UTC", gap: str = "3 hours", late: str = "6 hours") -> DataFrame:
    """Stretches of readings of a site without a longer gap."""
    rows = obs.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    out = rows.groupBy("site", F.session_window("__t", gap)).agg(F.count("*").alias("n"))
    return out.select("site", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
