"""Model levels: pressures from hybrid coefficients, and fields at given pressures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interface_pressure(surface: Column, a: Column, b: Column) -> Column:
    """Pressure of a level from its hybrid coefficients: a + b * surface pressure (units of a)."""
    return a + b * surface


def with_pressure(field: DataFrame, coefficients: DataFrame, surface: str = "surface", level: str = "level", out: str = "pressure", most: int = 1000) -> DataFrame:
    """Rows with the pressure in the middle of their level: the mean of the pressures at its two interfaces.

    ``coefficients`` (level, a, b) holds interfaces 1 .. L + 1, from the ground up; level k lies between k and
    k + 1.  The table is small by nature: its size is checked.  Rows of levels that it does not have, and rows
    without a surface pressure, get null.
    """
    rows = [(int(r[0]), float(r[1]), float(r[2])) for r in coefficients.select("level", "a", "b").limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} levels")
    if len({r[0] for r in rows}) < len(rows):
        raise ValueError("a level is given twice")
    known = {k: (a, b) for k, a, b in rows}
    mids = [(k, (a + known[k + 1][0]) / 2, (b + known[k + 1][1]) / 2) for k, (a, b) in sorted(known.items()) if k + 1 in known]
    if not mids:
        return field.withColumn(out, F.lit(None).cast("double"))
    spark = field.sparkSession
    table = spark.createDataFrame(mids, "__level long, __a double, __b double")
    joined = field.join(F.broadcast(table), F.col(level) == F.col("__level"), "left")
    return joined.withColumn(out, interface_pressure(F.col(surface), F.col("__a"), F.col("__b"))).drop("__level", "__a", "__b")


def at_pressures(field: DataFrame, keys: list[str], targets: list[float], value: str = "value", pressure: str = "pressure") -> DataFrame:
    """(keys, target, value): each column's value at the target pressures, linear in the logarithm of pressure.

    A column is the rows that share the keys; neighbouring levels are found by one sort of a column, and a pair yields the
    targets between them, so nothing wider than two levels is held.  Targets beyond a column's ends give
    no row.  Rows with a null, or a pressure not above zero, are left out; of rows of a column
    with the same pressure the least value stands.
    """
    if not targets or not all(t > 0 for t in targets):
        raise ValueError("targets must be pressures above zero")
    rows = field.where(F.col(value).isNotNull() & (F.col(pressure) > 0) & ~F.isnan(F.col(pressure).cast("double")))
    rows = rows.groupBy(*keys, F.col(pressure).cast("double").alias("__p")).agg(F.min(value).cast("double").alias("__v"))
    column = Window.partitionBy(*keys).orderBy("__p")
    rows = rows.withColumns({"__q": F.lead("__p").over(column), "__w": F.lead("__v").over(column), "__first": F.row_number().over(column) == 1})
    wanted = F.array(*(F.lit(float(t)) for t in sorted(set(targets))))
    # A target on a level belongs to the pair below it in the order; the lowest level answers for itself.
    between = F.filter(wanted, lambda t: (t > F.col("__p")) & (t <= F.col("__q")) | F.col("__first") & (t == F.col("__p")))
    rows = rows.select(*keys, "__p", "__v", "__q", "__w", F.explode(between).alias("target"))
    share = F.log(F.col("target") / F.col("__p")) / F.log(F.col("__q") / F.col("__p"))
    inner = F.when(F.col("target") == F.col("__p"), F.col("__v")).when(F.col("target") == F.col("__q"), F.col("__w"))
    return rows.select(*keys, "target", inner.otherwise(F.col("__v") + (F.col("__w") - F.col("__v")) * share).alias("value"))
