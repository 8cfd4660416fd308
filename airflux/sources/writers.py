"""Writers: receptors, route points, events, sweep rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def receptors(obs: DataFrame) -> DataFrame:
    """Receptor rows: site, time, lati, long, zagl and sim_id (yyyyMMddHHmm_lon_lat_z)."""
    number = lambda c: F.col(c).cast("string")
    sim = F.concat_ws("_", F.date_format("Time_UTC", "yyyyMMddHHmm"), number("longitude"), number("latitude"), number("height"))
    return obs.select(
        "site",
        F.col("Time_UTC").alias("time"),
        F.col("latitude").alias("lati"),
        F.col("longitude").alias("long"),
        F.col("height").alias("zagl"),
        sim.alias("sim_id"),
    )


def row_hash(columns: list[str], digits: int = 12) -> Column:
    """First hex digits of the SHA-256 of the columns as text, parted by bars; null columns are left out."""
    return F.substring(F.sha2(F.concat_ws("|", *columns), 256), 1, digits)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Result rows with a fixed schema; each write adds files, so writers do not meet."""
    df.write.mode("append").parquet(path)


def write_sorted(df: DataFrame, path: str, order: list[str] = ("Time_UTC", "site")) -> None:
    """Parquet in the order of the columns: ranges of it are sorted side by side, nothing meets in one task."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def write_points_geojson(df: DataFrame, path: str, lon: str = "longitude", lat: str = "latitude") -> None:
    """One GeoJSON feature a line: a point, with the other columns as properties."""
    others = [c for c in df.columns if c not in (lon, lat)]
    shape = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    rows = df.select(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*others).alias("properties"))
    rows.write.mode("overwrite").json(path)


def log_errors(results: DataFrame, path: str) -> None:
    """The failed rows of a sweep, appended as lines "id: error"."""
    failed = results.where("error is not null").select(F.concat_ws(": ", "config_id", "error").alias("value"))
    failed.write.mode("append").text(path)
