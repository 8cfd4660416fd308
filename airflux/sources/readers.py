"""Readers of raw files.  All are lazy and take any path that Spark can open."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The columns of a mobile-lab meteorology file.
MET_COLUMNS = [
    "PC",
    "UTC hhmmss",
    "UTC Year",
    "UTC Month",
    "UTC Day",
    "Latitude (DD.ddd +N)",
    "Longitude (DDD.ddd -W)",
    "GPS Quality",
    "Altitude (m)",
    "Air Temperature (C)",
    "RH(%)",
    "Dew Point (C)",
    "Wind Direction (Deg True)",
    "Wind Direction (Deg Mag)",
    "Wind Speed (m/s)",
    "Pressure (bar)",
    "PCB1 Temperature (C)",
    "PCB2 Temperature (C)",
    "Supply Voltage (VDC)",
    "Heading(deg)",
    "GPSCorWindDirTrue (deg)",
    "GPSCorWindDirMag (deg)",
    "GPSCorWindSpeed (kts)",
    "GPSCorWindSpeed (m/s)",
    "VehicleSpeed",
]
#: Those that are kept, and the names of two of them.
MET_KEPT = [
    "Latitude (DD.ddd +N)",
    "Longitude (DDD.ddd -W)",
    "GPS Quality",
    "Altitude (m)",
    "Air Temperature (C)",
    "RH(%)",
    "Dew Point (C)",
    "Pressure (bar)",
    "GPSCorWindDirTrue (deg)",
    "GPSCorWindSpeed (kts)",
    "VehicleSpeed",
]
MET_NAMES = {"Latitude (DD.ddd +N)": "latitude", "Longitude (DDD.ddd -W)": "longitude"}


def data_dir(variable: str = "AIRFLUX_DATA") -> Path:
    """Folder named by an environment variable; unset raises OSError."""
    value = os.environ.get(variable)
    if not value:
        raise OSError(f"{variable} is not set")
    return Path(value)


def read_site_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("nullValue", "NA").csv(path)


def read_archive(spark: SparkSession, path: str, site: str, instrument: str, level: str, start: str, end: str) -> DataFrame:
    """Readings from a Hive-style archive (site=, instrument=, lvl=): partitions pruned, time pushed down, both ends included."""
    table = spark.read.parquet(path).where(
        (F.col("site") == site) & (F.col("instrument") == instrument) & (F.col("lvl") == level)
    )
    return table.where(F.col("Time_UTC").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def read_dat_files(spark: SparkSession, folder: str, start: str, end: str) -> DataFrame:
    """Instrument text files under ``folder``: Time_UTC parsed, slice with both ends, ID serves CH4 and H2CO."""
    raw = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.dat").csv(folder)
    numeric = [c for c in raw.columns if c not in ("Time_UTC", "ID")]
    out = raw.withColumns(
        {c: F.expr(f"try_cast(`{c}` as double)") for c in numeric}
        | {"Time_UTC": F.expr("try_cast(Time_UTC as timestamp_ntz)")}
    )
    if "ID" in raw.columns:
        out = out.withColumn("ID_CH4", F.expr("try_cast(ID as int)")).withColumn("ID_H2CO", F.col("ID_CH4")).drop("ID")
    return out.where(F.col("Time_UTC").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def read_gas_csv(spark: SparkSession, path: str) -> DataFrame:
    """Mobile-lab gas file: time stamps with 1 to 6 fractional digits, rows without one go, CH4 in ppb."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).csv(path)
    padded = F.regexp_replace(F.concat(F.col("Time Stamp"), F.lit("000000")), r"(\.\d{6})\d*$", "$1")
    time = F.try_to_timestamp(padded, F.lit("MM/dd/yyyy HH:mm:ss.SSSSSS")).cast("timestamp_ntz")
    number = lambda c: F.expr(f"try_cast(`{c}` as double)")
    return raw.select(
        time.alias("Time_UTC"),
        (number("CH4 (ppm)") * 1000).alias("CH4_ppb"),
        number("C2H6 (ppb)").alias("C2H6_ppb"),
        number("R").alias("R"),
        number("C2/C1").alias("C2C1"),
    ).dropna(subset=["Time_UTC"])


def read_met_csv(spark: SparkSession, path: str, skip: int = 4) -> DataFrame:
    """Mobile-lab meteorology files: ``skip`` heading lines each, fixed columns, time put together from its parts.

    Shorter lines have nulls at their end, longer ones go, as do those without a valid time (a heading
    that is left is one of them); a file in which no line has one raises at run time.  In order of time.
    """
    schema = ", ".join(f"`{c}` string" for c in MET_COLUMNS)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("filename"))
    lines = lines.withColumn("__id", F.monotonically_increasing_id())
    fields = F.transform(F.split(F.regexp_replace("value", r",\s*$", ""), ","), lambda x: F.nullif(F.trim(x), F.lit("")))
    lines = lines.where(F.trim("value") != "").withColumn("__f", fields)
    number = F.row_number().over(Window.partitionBy("filename").orderBy("__id"))
    parts = lines.withColumn("__n", number).where((F.col("__n") > skip) & (F.size("__f") <= len(MET_COLUMNS)))
    parts = parts.select("filename", *(F.get("__f", F.lit(k)).alias(f"c{k}") for k in range(len(MET_COLUMNS))))
    at = {name: f"c{k}" for k, name in enumerate(MET_COLUMNS)}
    clock = at["UTC hhmmss"]
    time = F.expr(
        f"try_make_timestamp(try_cast({at['UTC Year']} as int), try_cast({at['UTC Month']} as int), try_cast({at['UTC Day']} as int),"
        f" try_cast(substr({clock}, 1, 2) as int), try_cast(substr({clock}, 3, 2) as int), try_cast(substr({clock}, 5) as decimal(16, 6)))"
    ).cast("timestamp_ntz")
    rows = parts.withColumn("Time_UTC", time)
    found = F.max(F.col("Time_UTC").isNotNull()).over(Window.partitionBy("filename"))
    checked = F.when(found, F.col("Time_UTC")).otherwise(F.raise_error(F.concat(F.lit("no line fits in "), "filename")).cast("timestamp_ntz"))
    rows = rows.withColumn("Time_UTC", checked).dropna(subset=["Time_UTC"])
    keep = [F.expr(f"try_cast({at[c]} as double)").alias(MET_NAMES.get(c, c)) for c in MET_KEPT]
    return rows.select("Time_UTC", *keep, "filename").orderBy("Time_UTC")


def read_gps(spark: SparkSession, path: str, site: str, time: str = "Time_UTC", start: str | None = None, end: str | None = None) -> DataFrame:
    """Track of a platform: (site, Time_UTC, latitude, longitude, altitude) of fixes with a time, both ends included.

    ``time`` is the clock that readings are matched by: the receiver's, or that of the data logger (Pi_Time)."""
    raw = spark.read.parquet(path)
    rows = raw.select(
        F.lit(site).alias("site"),
        F.col(time).cast("timestamp_ntz").alias("Time_UTC"),
        F.col("Latitude_deg").cast("double").alias("latitude"),
        F.col("Longitude_deg").cast("double").alias("longitude"),
        F.col("Altitude_msl").cast("double").alias("altitude"),
    ).dropna(subset=["Time_UTC"])
    if start is not None:
        rows = rows.where(F.col("Time_UTC") >= F.lit(start).cast("timestamp_ntz"))
    return rows if end is None else rows.where(F.col("Time_UTC") <= F.lit(end).cast("timestamp_ntz"))


def read_soundings(
    spark: SparkSession, path: str, station: str = "SLC", start: str | None = None, end: str | None = None, months: list[int] | None = None
) -> DataFrame:
    """Levels (station, time, z, theta, rho) of a station's soundings in a range and, if given, in some months."""
    rows = spark.read.parquet(path).where(F.col("station") == station)
    if start is not None:
        rows = rows.where(F.col("time") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        rows = rows.where(F.col("time") <= F.lit(end).cast("timestamp_ntz"))
    return rows if months is None else rows.where(F.month("time").isin(list(months)))


def read_cell(spark: SparkSession, path: str, lon: float, lat: float, dx: float, dy: float) -> DataFrame:
    """Series of the one cell of a gridded field that holds a point."""
    table = read_grid(spark, path, (lon - dx / 2, lat - dy / 2, lon + dx / 2, lat + dy / 2))
    inside = (F.col("lon") - dx / 2 <= lon) & (F.lit(lon) < F.col("lon") + dx / 2) & (F.col("lat") - dy / 2 <= lat) & (F.lit(lat) < F.col("lat") + dy / 2)
    return table.where(inside)


def read_inventory(
    spark: SparkSession, path: str, start: str | None = None, end: str | None = None, sectors: list[str] | None = None, bbox=None
) -> DataFrame:
    """Emissions (time, lon, lat, sector, value): half-open range of time, box and sectors, all pushed to the scan."""
    table = read_grid(spark, path, bbox)
    if start is not None:
        table = table.where(F.col("time") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        table = table.where(F.col("time") < F.lit(end).cast("timestamp_ntz"))
    return table if sectors is None else table.where(F.col("sector").isin(list(sectors)))


def read_discrete(spark: SparkSession, path: str, specie: str, flag_pattern: str = r"^\.\.P|^\.\.\.") -> DataFrame:
    """Discrete samples: rows whose flag fits, value column named after the specie."""
    raw = spark.read.option("header", True).csv(path)
    return raw.where(F.col("qcflag").rlike(flag_pattern)).select(
        F.expr("try_cast(datetime as timestamp)").cast("timestamp_ntz").alias("obs_time"),
        F.expr("try_cast(value as double)").alias(specie),
        F.expr("try_cast(latitude as double)").alias("latitude"),
        F.expr("try_cast(longitude as double)").alias("longitude"),
    )


def read_daily_background(spark: SparkSession, path: str, value: str = "ct_ch4_ppm") -> DataFrame:
    """(day, background), times in UTC; a day listed twice raises at run time."""
    raw = spark.read.option("header", True).csv(path)
    daily = raw.select(
        F.to_date(F.expr("try_cast(obs_time as timestamp)")).alias("day"), F.expr(f"try_cast({value} as double)").alias("background")
    ).dropna(subset=["day"])
    one = daily.groupBy("day").agg(F.count("*").alias("__n"), F.first("background").alias("background"))
    return one.select("day", F.when(F.col("__n") > 1, F.raise_error(F.lit("a day is listed twice"))).otherwise(F.col("background")).alias("background"))


#: Discrete-sample stations by preset: pollutant and site.
FLASK_PRESETS = {"UTA": ("ch4", "uta")}


def read_flask(spark: SparkSession, path: str, preset: str = "UTA") -> DataFrame:
    """Discrete samples of a preset; ``path`` may hold {specie} and {site}."""
    specie, site = FLASK_PRESETS[preset]
    return read_discrete(spark, path.format(specie=specie, site=site), specie)


def read_geojson_lines(spark: SparkSession, path: str, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(feature, line, vertex, lon, lat) of the LineStrings and MultiLineStrings of a GeoJSON file.

    With ``bbox`` (xmin, ymin, xmax, ymax) only lines whose own box meets it."""
    shape = "struct<type:string,coordinates:string>"
    raw = spark.read.option("multiLine", True).schema(f"features array<struct<geometry:{shape}>>").json(path)
    feats = raw.select(F.posexplode("features").alias("feature", "f")).select("feature", "f.geometry.*")
    many = F.when(F.col("type") == "MultiLineString", F.from_json("coordinates", "array<array<array<double>>>"))
    one = F.when(F.col("type") == "LineString", F.array(F.from_json("coordinates", "array<array<double>>")))
    lines = feats.select("feature", F.posexplode(F.coalesce(many, one)).alias("line", "xy"))
    if bbox:
        xmin, ymin, xmax, ymax = bbox
        side = lambda k, f: f(F.transform("xy", lambda p: p[k]))
        lines = lines.where(
            (side(0, F.array_max) >= xmin) & (side(0, F.array_min) <= xmax) & (side(1, F.array_max) >= ymin) & (side(1, F.array_min) <= ymax)
        )
    rows = lines.select("feature", "line", F.posexplode("xy").alias("vertex", "p"))
    return rows.select("feature", "line", "vertex", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))


def read_grid(spark: SparkSession, path: str, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Gridded field in long form (time, lon, lat, value); the box is pushed down to the scan."""
    table = spark.read.parquet(path)
    if bbox:
        xmin, ymin, xmax, ymax = bbox
        table = table.where(F.col("lon").between(xmin, xmax) & F.col("lat").between(ymin, ymax))
    return table
