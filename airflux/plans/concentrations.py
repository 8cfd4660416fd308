"""Concentrations of several sites and instruments from an archive of raw readings."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import qa
from ..operators.joins import exclude_events
from ..operators.mobile import merge_with_gps
from ..sources import registry

DIM = (
    "site string, instrument string, lvl string, org string, __mobile boolean, __lat double, __lon double, height double"
)


def sources_of(pollutants: list[str], orgs: list[str] | None, sites: list[str] | None) -> list[tuple]:
    """(site, instrument, level, org, mobile, latitude, longitude, height) of what measures one of the pollutants.

    Sites by name (any letter case) or else by organization; unknown ones are left out.
    """
    if not sites and not orgs:
        raise ValueError("sites or organizations are needed")
    wanted = {s.lower() for s in sites} if sites else {r[0] for r in registry.SITES if r[2] in orgs}
    known = {name: (cal, set(cols)) for name, _, _, _, cal, cols in registry.INSTRUMENTS}
    out = []
    for stid, _, org, kind, _, lat, lon, height, names in registry.SITES:
        for name in (names or "").split() if stid in wanted else []:
            if name in known and known[name][1] & set(pollutants):
                out.append((stid, name, "calibrated" if known[name][0] else "qaqc", org, kind == "mobile", lat, lon, height))
    if not out:
        raise ValueError("no site or instrument measures these pollutants")
    return out


def load_concentrations(
    archive: DataFrame,
    pollutants: list[str] | str,
    orgs: list[str] | str | None = None,
    sites: list[str] | str | None = None,
    time_range: tuple[str, str] | None = None,
    include_location: bool = False,
    valid_range: dict[str, tuple[float, float]] | None = None,
    valid_flags: dict[str, set[int]] | None = None,
    hours: list[int] | None = None,
    events: list[tuple[str, str]] = (),
    gps: DataFrame | None = None,
    mobile: dict | None = None,
) -> DataFrame:
    """Checked readings with site, organization and position, from raw ones.

    ``archive`` has site, instrument, lvl, Time_UTC, the instruments' own concentration columns and,
    where they exist, QAQC_Flag and ID_<pollutant>; stored by site, instrument and lvl it is pruned to
    what is asked for.  The instruments' columns are renamed to pollutants and checked; rows without a
    valid one go; local time, hours and excluded events follow.  With a moving site, rows get
    is_mobile, and its positions come from ``gps`` (site, Time_UTC, latitude, longitude, altitude).
    The site table is a bounded list and is broadcast.  Rows with a null site, instrument or time go.
    Order is left to the sink (``writers.write_sorted``).
    """
    listed = lambda x: [x] if isinstance(x, str) else x
    pollutants, valid_range, valid_flags = listed(pollutants), valid_range or {}, valid_flags or {}
    dims = sources_of(pollutants, listed(orgs), listed(sites))
    moving = any(d[4] for d in dims)
    asked = reduce(or_, ((F.col("site") == d[0]) & (F.col("instrument") == d[1]) & (F.col("lvl") == d[2]) for d in dims))
    rows = archive.where(asked).dropna(subset=["Time_UTC"])
    if time_range:
        rows = qa.time_slice(rows, *time_range)
    columns = {}
    for pol in pollutants:
        named = [(name, cols[pol]) for name, _, _, _, _, cols in registry.INSTRUMENTS if cols.get(pol) in archive.columns]
        chosen = F.coalesce(*(F.when(F.col("instrument") == n, F.col(c)) for n, c in named), F.lit(None).cast("double")) if named else F.lit(None)
        columns[pol] = chosen.cast("double")
    rows = rows.withColumns(columns)
    rows = rows.withColumns({p: qa.normalize_pollutant(rows, p, valid_range.get(p), valid_flags.get(p)) for p in pollutants})
    rows = rows.dropna(how="all", subset=pollutants).select("site", "instrument", "lvl", "Time_UTC", *pollutants)
    dim = archive.sparkSession.createDataFrame(dims, DIM)
    rows = rows.join(F.broadcast(dim), ["site", "instrument", "lvl"])
    if moving or include_location:
        rows = rows.withColumns({"latitude": F.col("__lat"), "longitude": F.col("__lon")})
    else:
        rows = rows.drop("height")
    if moving:
        rows = rows.withColumn("is_mobile", F.col("__mobile"))
        placed = [rows.where(~F.col("is_mobile")).withColumn("altitude", F.lit(None).cast("double"))]
        for org in sorted({d[3] for d in dims if d[4]}):
            if gps is None:
                raise ValueError("moving sites need their positions")
            placed.append(merge_with_gps(rows.where(F.col("is_mobile") & (F.col("org") == org)), gps, org, **mobile or {}))
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), placed)
    rows = qa.with_local_time(rows)
    if hours is not None:
        rows = qa.local_hours(rows, hours)
    if events:
        rows = exclude_events(rows, list(events))
    order = ["Time_UTC", "Time_MST", "site", "org", "instrument", *pollutants, "is_mobile", "latitude", "longitude", "height", "altitude"]
    return qa.project_present(rows, order)
