"""Tables behind figures: maps, series, boxes, overlays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import centered_mean, gaps


def by_type(sites: DataFrame) -> DataFrame:
    """Sites with a position, by type."""
    return sites.where("latitude is not null").select("type", "stid", "longitude", "latitude", "active")


def time_mean(field: DataFrame, cell: list[str] = ("lon", "lat")) -> DataFrame:
    return field.groupBy(*cell).agg(F.avg("value").alias("value"))


def removed_cells(full: DataFrame, retained: DataFrame, cell: list[str] = ("lon", "lat")) -> DataFrame:
    return full.select(*cell).distinct().join(retained.select(*cell).distinct(), list(cell), "left_anti")


def cell_corners(cells: DataFrame, dx: float, dy: float) -> DataFrame:
    """Rectangles of cells for drawing."""
    return cells.withColumns(
        {"xmin": F.col("lon") - dx / 2, "xmax": F.col("lon") + dx / 2, "ymin": F.col("lat") - dy / 2, "ymax": F.col("lat") + dy / 2}
    )


def by_location(obs: DataFrame, locations: list[str], value: str = "CH4") -> DataFrame:
    """Concentrations with one column a location; two values of a location at one time raise."""
    one = F.when(F.count(value) > 1, F.raise_error(F.lit("two values at one time"))).otherwise(F.first(value))
    return obs.groupBy("obs_time").pivot("obs_location", locations).agg(one)


def residual_series(table: DataFrame, keys: list[str], time: str, value: str, window: str = "30d", longer: str = "7d") -> tuple[DataFrame, DataFrame]:
    """Smoothed residuals, and the gaps over which the line is broken."""
    return centered_mean(table, keys, time, value, window), gaps(table, keys, time, longer)


def same_everywhere(table: DataFrame, time: str, value: str) -> bool:
    """All locations have the same value at every time."""
    spread = table.groupBy(time).agg((F.max(value) - F.min(value)).alias("d"))
    return spread.where("d > 0").isEmpty()


def markers(points: DataFrame, marks: dict[str, str]) -> DataFrame:
    """Point sources with the marker of their category; unknown categories have none."""
    pairs = [F.lit(x) for kv in marks.items() for x in kv]
    return points.withColumn("marker", F.try_element_at(F.create_map(*pairs), F.col("category")))


def density(population: Column, area_m2: Column) -> Column:
    """Thousands per square kilometre; thin ones (below 0.1) are null."""
    d = F.try_divide(population, area_m2 / 1e6) / 1000
    return F.when(d >= 0.1, d)


def major_roads(roads: DataFrame, codes: range = range(1, 7)) -> DataFrame:
    return roads.where(F.col("code").isin(list(codes)))


def stations(table: DataFrame, status: str | None = None, networks: list[int] | None = None) -> DataFrame:
    if status:
        table = table.where(F.col("status") == status)
    return table.where(F.col("network").isin(networks)) if networks else table


def aligned(parts: dict[str, DataFrame], keys: list[str], value: str = "value") -> DataFrame:
    """One column for each part, aligned by the keys: all keys of any part, null where a part has none.

    The parts are united and met in one shuffle.  A key that a part holds twice raises at run time; null keys are a key."""
    names = list(parts)
    column = lambda n, m: (F.col(value) if n == m else F.lit(None)).cast("double").alias(m)
    rows = [df.select(*keys, F.lit(n).alias("__part"), *(column(n, m) for m in names)) for n, df in parts.items()]
    one = lambda n: F.when(F.count_if(F.col("__part") == n) > 1, F.raise_error(F.lit(f"a key is twice in {n}")).cast("double")).otherwise(F.max(n))
    return reduce(DataFrame.unionByName, rows).groupBy(*keys).agg(*(one(n).alias(n) for n in names))


def summary(prior: DataFrame, posterior: DataFrame) -> DataFrame:
    """Total, prior and posterior, by time, with the change in percent (null where the prior is 0)."""
    a = prior.select("time", F.col("total").alias("prior"))
    b = posterior.select("time", F.col("total").alias("posterior"))
    change = 100 * F.try_divide(F.col("posterior") - F.col("prior"), F.col("prior"))
    return a.join(b, "time", "outer").withColumn("change_pct", change)
