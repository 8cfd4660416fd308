"""Quality control, filters and projections of observation tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeutil import UTC_OFFSET, local_time
from ..scratch import written
from ..sources.registry import BASE_FLAGS, POLLUTANTS

ORDER = "Time_UTC Time_MST site org instrument CH4 CO2 H2O CO H2CO is_mobile latitude longitude height altitude".split()


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing; inside the engine that is null."""
    floats = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def normalize_pollutant(
    df: DataFrame,
    pollutant: str,
    valid_range: tuple[float, float] | None = None,
    valid_flags: set[int] | None = None,
) -> Column:
    """The pollutant where identifier, flag and range are valid, else null (the row stays)."""
    if pollutant not in df.columns:
        raise ValueError(f"no column {pollutant}")
    known_range, known_flags = POLLUTANTS.get(pollutant, (None, set()))
    flags = BASE_FLAGS | known_flags if valid_flags is None else valid_flags
    bounds = known_range if valid_range is None else valid_range
    valid = F.lit(True)
    if f"ID_{pollutant}" in df.columns:
        valid &= F.col(f"ID_{pollutant}") == -10
    if "QAQC_Flag" in df.columns:
        valid &= F.col("QAQC_Flag").isin(sorted(flags))
    if bounds is not None:
        valid &= F.col(pollutant).between(*bounds)
    return F.when(F.coalesce(valid, F.lit(False)), F.col(pollutant))


def with_valid(df: DataFrame, pollutants: list[str]) -> DataFrame:
    """All pollutants checked; rows without any valid one go."""
    return df.withColumns({p: normalize_pollutant(df, p) for p in pollutants}).dropna(how="all", subset=pollutants)


def with_local_time(df: DataFrame, offset: int = UTC_OFFSET) -> DataFrame:
    return df.withColumn("Time_MST", local_time(F.col("Time_UTC"), offset))


def local_hours(df: DataFrame, hours: list[int], offset: int = UTC_OFFSET) -> DataFrame:
    return df.where(F.hour(local_time(F.col("Time_UTC"), offset)).isin(hours))


def time_slice(df: DataFrame, start: str, end: str, time: str = "Time_UTC") -> DataFrame:
    """Both ends included, as for raw files."""
    return df.where(F.col(time).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def trim(df: DataFrame, start: str, end: str, time: str) -> DataFrame:
    """Half-open [start, end), as for observation and state vectors."""
    t = F.col(time)
    return df.where((t >= F.lit(start).cast("timestamp_ntz")) & (t < F.lit(end).cast("timestamp_ntz")))


def in_box(df: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    return df.where(F.col("longitude").between(xmin, xmax) & F.col("latitude").between(ymin, ymax))


def choose_sites(sites: DataFrame, names: list[str] | None = None, orgs: list[str] | None = None) -> DataFrame:
    """Sites by organization or by name (any letter case); one of both is needed, unknown names yield nothing."""
    if orgs:
        return sites.where(F.col("organization").isin(orgs))
    if names:
        return sites.where(F.col("stid").isin([n.lower() for n in names]))
    raise ValueError("sites or organizations are needed")


def measuring(instrument_columns: DataFrame, pollutants: list[str]) -> DataFrame:
    """Instruments that measure one of the pollutants at least."""
    return instrument_columns.where(F.col("pollutant").isin(pollutants)).select("instrument").distinct()


def obs_location() -> Column:
    """Site name, or lon_lat_height of the snapped point for mobile rows."""
    point = F.concat_ws(
        "_",
        F.bround("longitude", 5).cast("string"),
        F.bround("latitude", 5).cast("string"),
        F.bround("height", 0).cast("int").cast("string"),
    )
    return F.when(F.coalesce(F.col("is_mobile"), F.lit(False)), point).otherwise(F.col("site"))


def project_present(df: DataFrame, order: list[str] = ORDER) -> DataFrame:
    return df.select([c for c in order if c in df.columns])


def to_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns as numbers where all their values are numbers; one pass over the table decides."""
    test = df.agg(*(F.count_if(F.expr(f"`{c}` is not null and try_cast(`{c}` as double) is null")).alias(c) for c in columns)).first()
    return df.withColumns({c: F.col(c).cast("double") for c in columns if not test[c]})


SKETCH = 10_000  # accuracy of the sketch that brackets a percentile: a bracket holds about six rows in so many


def exact_percentiles(df: DataFrame, column: str, shares: list[float], keys: list[str] = ()) -> DataFrame:
    """(keys, q): exact percentiles at the ``shares`` as ``percentile`` has them, without all values of a key in one task.

    A sketch brackets each percentile; rows below a bracket are counted, and only those within it are put in order.
    Were a rank outside its bracket, which the counts show, the aggregate over all values is taken."""
    names = [f"__k{k}" for k in range(len(keys))] or ["__all"]
    named = [F.col(c).alias(n) for c, n in zip(keys, names)] or [F.lit(0).alias("__all")]
    rows = df.select(*named, F.col(column).cast("double").alias("__v"))
    m, margin = len(shares), 2 / SKETCH
    ends = [F.lit(min(max(q + by, 0.0), 1.0)) for by in (-margin, margin) for q in shares]
    sketch = rows.groupBy(*names).agg(F.count("__v").alias("__n"), F.percentile_approx("__v", F.array(*ends), F.lit(SKETCH)).alias("__e"))
    sketch = written(sketch, "sketch")
    wide = sketch.select(*(F.col(n).alias(f"{n}_") for n in names), "__e")
    same = reduce(lambda a, b: a & b, (F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names))
    met = rows.where("__v is not null").join(wide, same)
    low, high = (lambda i: F.get("__e", i)), (lambda i: F.get("__e", i + m))
    below = met.groupBy(*names).agg(F.array(*(F.count_if(F.col("__v") < low(F.lit(i))) for i in range(m))).alias("__below"))
    inside = F.filter(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: (F.col("__v") >= low(i)) & (F.col("__v") <= high(i)))
    inside = met.select(*names, "__v", F.explode(inside).alias("__i")).groupBy(*names, "__i", "__v").agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*names, "__i").orderBy("__v"))
    inside = inside.withColumn("__upto", upto)
    counts = sketch.select(*names, "__n").join(below.select(*(F.col(n).alias(f"{n}_") for n in names), "__below"), same).drop(*(f"{n}_" for n in names))
    counts = counts.select(*(F.col(n).alias(f"{n}_") for n in names), "__n", "__below")
    at = F.get(F.array(*(F.lit(float(q)) for q in shares)), F.col("__i")) * (F.col("__n") - 1)
    ranked = inside.join(counts, same).withColumns({"__at": at, "__to": F.get("__below", F.col("__i")) + F.col("__upto")})
    holds = lambda r: F.max(F.when((r < F.col("__to")) & (r >= F.col("__to") - F.col("__c")), F.col("__v")))
    lower, higher = F.floor("__at"), F.ceil("__at")
    ranked = ranked.groupBy(*names, "__i").agg(holds(lower).alias("a"), holds(higher).alias("b"), F.max("__at").alias("__at"))
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((higher - F.col("__at")) * F.col("a") + (F.col("__at") - lower) * F.col("b"))
    q = F.transform(F.array_sort(F.collect_list(F.struct("__i", value.alias("v")))), lambda x: x["v"])
    found = ranked.groupBy(*(F.col(n).alias(f"{n}_") for n in names)).agg(q.alias("q"))
    out = written(sketch.select(*names, "__n").join(found, same, "left"), "percentiles")
    back = [F.col(n).alias(c) for c, n in zip(keys, names)]
    missed = out.where((F.col("__n") > 0) & (F.col("q").isNull() | (F.size("q") < m) | F.exists("q", lambda v: v.isNull())))
    if missed.count():
        return df.groupBy(*keys).agg(F.percentile(F.col(column).cast("double"), F.array(*map(F.lit, shares))).alias("q"))
    return out.select(*back, "q")


def outliers_trimmed(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows strictly between two exact quantiles of the whole column (two numbers go to the driver)."""
    q = exact_percentiles(df, column, [low, high]).first()
    q = q and q["q"]
    return df.where((F.col(column) > q[0]) & (F.col(column) < q[1])) if q else df.limit(0)


def min_count(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Rows of groups of ``n`` or more; groups with a null key go."""
    groups = df.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("__n")).where(f"__n >= {n}")
    return df.join(groups.drop("__n"), keys, "left_semi")


def drop_spike_days(obs: DataFrame, percentile: float = 0.9, value: str = "CH4") -> DataFrame:
    """Without (site, day)s whose mean within-hour deviation is above the site's percentile of it.

    Days without an hour of two readings stay.  Sums before each shuffle; flagged days are few.
    """
    day, hour = F.date_trunc("DAY", "Time_UTC"), F.date_trunc("HOUR", "Time_UTC")
    rows = obs.select("site", day.alias("__day"), hour.alias("__hour"), value).dropna(subset=["site", "__day"])
    daily = (
        rows.groupBy("site", "__day", "__hour")
        .agg(F.stddev_samp(value).alias("sd"))
        .groupBy("site", "__day")
        .agg(F.avg("sd").alias("sd"))
    )
    limits = daily.groupBy("site").agg(F.percentile("sd", F.lit(percentile)).alias("limit"))
    flagged = daily.join(limits, "site").where("sd > limit").select("site", "__day")
    return obs.withColumn("__day", day).join(flagged, ["site", "__day"], "left_anti").drop("__day")
