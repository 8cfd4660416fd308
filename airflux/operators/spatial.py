"""Nearest points, and routes that pass by, for point and line tables of any size: joins by grid cell.

Rows at the same position are looked up once, so a platform that stands still costs one place.
Positions that are null or not a number have no nearest point and lie on no route; such rows stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.geo import utm_inverse
from ..scratch import written

STEP = 3  # bits of a coordinate that a level adds: a cell has 64 children at most
LEVELS = 8
#: Cells or points that are sent to all tasks: about 5 MB; larger tables are joined by a shuffle.
BROADCAST_ROWS = 100_000
BLOCK = 4096
PAIRS = 1 << 24  # places times pieces that meet in a group: bounds the routes that a task gives out at once

SEGMENT = ["ax", "ay", "bx", "by"]


def _real(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull() & ~F.isnan(F.col(n).cast("double"))
    return out


def _places(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(_real(x, y)).select(F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).distinct()


def _with_places(df: DataFrame, found: DataFrame, x: str, y: str) -> DataFrame:
    """Rows with what was found for their place; the others with null."""
    same = (F.col(x).cast("double") == F.col("__x")) & (F.col(y).cast("double") == F.col("__y"))
    return df.join(found, same, "left").drop("__x", "__y")


def _small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def _gap(low: Column, high: Column, at: Column) -> Column:
    return F.greatest(low - at, F.lit(0.0), at - high)


def nearest(
    df: DataFrame,
    points: DataFrame,
    x: str = "longitude",
    y: str = "latitude",
    px: str = "x",
    py: str = "y",
    number: str = "point",
    out_x: str = "agg_lon",
    out_y: str = "agg_lat",
    leaf: int = 16,
) -> DataFrame:
    """Rows with ``number`` and coordinates of the nearest of ``points`` in the plane; ties: the least number.

    Cells of points form levels of an eight-by-eight tree; each cell knows the box of its points.  A
    place goes down level by level with the cells that may hold its nearest point: those whose box
    begins no farther than the nearest box ends.  These bounds are rounded like the distances, so no
    nearest point is lost.  Levels go on until no cell has over ``leaf`` points.  While a level is
    small enough to be broadcast, going down it takes no shuffle: places stay where they are.

    Points with a null coordinate are left out; without points the three columns are null.  Columns
    of ``df`` under the names of the new ones are replaced.
    """
    spark = df.sparkSession
    points = points.where(_real(px, py)).select(F.col(px).cast("double").alias("__px"), F.col(py).cast("double").alias("__py"), F.col(number).alias("__n"))
    points = written(points.groupBy("__px", "__py").agg(F.min("__n").alias("__n")), "points")
    ends = points.agg(F.min("__px"), F.max("__px"), F.min("__py"), F.max("__py"), F.count("*")).first()
    kind = points.schema["__n"].dataType
    df = df.drop(number, out_x, out_y)
    if not ends[4]:
        return df.withColumns({number: F.lit(None).cast(kind), out_x: F.lit(None).cast("double"), out_y: F.lit(None).cast("double")})
    side, top = max(ends[1] - ends[0], ends[3] - ends[2]) or 1.0, 1 << STEP * LEVELS
    digit = lambda c, first: F.least(F.lit(top - 1), F.floor((F.col(c) - first) / side * top)).cast("long")
    points = points.withColumns({"__cx": digit("__px", ends[0]), "__cy": digit("__py", ends[2])})
    levels = F.transform(
        F.sequence(F.lit(1), F.lit(LEVELS)),
        lambda k: F.struct(k.alias("level"), *(F.call_function("shiftright", F.col(c), (LEVELS - k) * STEP).alias(c) for c in ("__cx", "__cy"))),
    )
    cells = points.select("__px", "__py", F.explode(levels).alias("c")).groupBy("c.level", "c.__cx", "c.__cy")
    cells = cells.agg(F.min("__px").alias("x0"), F.max("__px").alias("x1"), F.min("__py").alias("y0"), F.max("__py").alias("y1"), F.count("*").alias("n"))
    cells = written(cells, "cells")
    sizes = {r["level"]: r for r in cells.groupBy("level").agg(F.max("n").alias("fullest"), F.count("*").alias("cells")).collect()}  # a row a level
    depth = next((k for k in range(1, LEVELS) if sizes[k]["fullest"] <= leaf), LEVELS)

    here = _places(df, x, y)
    for k in range(1, depth + 1):
        up = [F.shiftright(c, STEP).alias(c) for c in ("__cx", "__cy")]
        box = F.struct("x0", "x1", "y0", "y1", F.col("__cx").alias("cx"), F.col("__cy").alias("cy"))
        level = cells.where(F.col("level") == k)
        if k == 1:  # the root's children, 64 at most, are part of the expression
            rows = level.select("x0", "x1", "y0", "y1", F.col("__cx").alias("cx"), F.col("__cy").alias("cy")).collect()
            met = here.withColumn("kids", F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in r.asDict().items())) for r in rows)))
        else:
            kids = level.select(*up, box.alias("box")).groupBy("__cx", "__cy").agg(F.collect_list("box").alias("kids"))
            met = here.join(_small(kids, sizes[k]["cells"]), ["__cx", "__cy"])

        def bounds(b: Column) -> Column:
            near_x, near_y = _gap(b["x0"], b["x1"], F.col("__x")), _gap(b["y0"], b["y1"], F.col("__y"))
            far_x = F.greatest(F.abs(b["x0"] - F.col("__x")), F.abs(b["x1"] - F.col("__x")))
            far_y = F.greatest(F.abs(b["y0"] - F.col("__y")), F.abs(b["y1"] - F.col("__y")))
            return F.struct((near_x * near_x + near_y * near_y).alias("low"), (far_x * far_x + far_y * far_y).alias("high"), b["cx"].alias("cx"), b["cy"].alias("cy"))

        own = met.select("__x", "__y", F.transform("kids", bounds).alias("kids"))
        own = own.withColumn("high", F.array_min(F.transform("kids", lambda b: b["high"])))
        own = own.withColumn("kids", F.filter("kids", lambda b: b["low"] <= F.col("high")))
        own = own.groupBy("__x", "__y").agg(F.min("high").alias("high"), F.flatten(F.collect_list("kids")).alias("kids"))
        own = own.select("__x", "__y", F.explode(F.filter("kids", lambda b: b["low"] <= F.col("high"))).alias("b"))
        here = own.select("__x", "__y", F.col("b.cx").alias("__cx"), F.col("b.cy").alias("__cy"))
    shift = (LEVELS - depth) * STEP
    leaves = points.withColumns({c: F.shiftright(c, shift) for c in ("__cx", "__cy")})
    dx, dy = F.col("__px") - F.col("__x"), F.col("__py") - F.col("__y")
    near = here.join(_small(leaves, ends[4]), ["__cx", "__cy"]).select("__x", "__y", F.struct((dx * dx + dy * dy).alias("d2"), "__n", "__px", "__py").alias("near"))
    near = near.groupBy("__x", "__y").agg(F.min("near").alias("__near"))
    out = _with_places(df, near, x, y)
    return out.withColumns({number: F.col("__near.__n"), out_x: F.col("__near.__px"), out_y: F.col("__near.__py")}).drop("__near")


def segments_of(vertices: DataFrame, route: str = "route", order: str = "n", x: str = "x", y: str = "y") -> DataFrame:
    """(route, n, ax, ay, bx, by) from vertices in order: each segment runs to the next vertex of its route.

    The order is whole numbers from one vertex to the next without a gap, so the next vertex is found by a join
    on its number, and a route of very many vertices is no single task."""
    a = vertices.select(F.col(route).alias("route"), F.col(order).cast("long").alias("n"), F.col(x).cast("double").alias("ax"), F.col(y).cast("double").alias("ay"))
    b = a.select("route", (F.col("n") - 1).alias("n"), F.col("ax").alias("bx"), F.col("ay").alias("by"))
    return a.join(b, ["route", "n"])


def routes_at(df: DataFrame, segments: DataFrame, radius: float, x: str = "easting", y: str = "northing", out: str = "routes") -> DataFrame:
    """Rows with the sorted array of the distinct routes that pass within ``radius`` of them (round caps).

    ``segments`` (route, ax, ay, bx, by) is cut into pieces of at most a cell's side (four radii), each of which
    reaches a few cells; places meet the segments of their own cell and are measured against the
    whole segment.  Segments with a null end or no name are left out.  An existing column ``out`` is replaced.
    """
    found = _passing(_places(df, x, y), segments, radius)
    got = _with_places(df.drop(out), found, x, y)
    none = F.array().cast(found.schema["__routes"].dataType)
    return got.withColumn(out, F.coalesce("__routes", none)).drop("__routes")


def _passing(places: DataFrame, segments: DataFrame, radius: float) -> DataFrame:
    """(__x, __y, __routes) of every place (__x, __y): each is measured against the pieces of its own cell in one group,
    so a pair of place and route is never a row and never moves.  A cell of many pairs is several groups."""
    if not radius > 0:
        raise ValueError(f"not a radius: {radius!r}")
    cell, reach = 4.0 * radius, radius * 1.000001 + 1e-6
    segments = segments.where(_real(*SEGMENT) & F.col("route").isNotNull()).select("route", *(F.col(c).cast("double").alias(c) for c in SEGMENT)).distinct()
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    count = F.greatest(F.lit(1), F.ceil(length / cell)).cast("long")
    pieces = segments.withColumn("m", count).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))

    def span(a: str, b: str) -> Column:
        at = lambda k: F.col(a) + (F.col(b) - F.col(a)) * k / F.col("m")
        one, two = at(F.col("k")), at(F.col("k") + 1)
        return F.sequence(F.floor((F.least(one, two) - reach) / cell), F.floor((F.greatest(one, two) + reach) / cell))

    pieces = pieces.withColumn("__cx", F.explode(span("ax", "bx"))).withColumn("__cy", F.explode(span("ay", "by"))).drop("m", "k").distinct()
    places = places.withColumns({"__cx": F.floor(F.col("__x") / cell), "__cy": F.floor(F.col("__y") / cell)})
    places, pieces = written(places, "places"), written(pieces, "pieces")
    cell_of = ["__cx", "__cy"]
    busy = places.groupBy(*cell_of).agg(F.count("*").alias("n")).join(pieces.groupBy(*cell_of).agg(F.count("*").alias("m")), cell_of)
    busy = busy.select(*cell_of, F.ceil(F.col("n") * F.col("m") / PAIRS).alias("__parts")).where("__parts > 1")
    parts = F.coalesce("__parts", F.lit(1).cast("long"))
    places = places.join(busy, cell_of, "left").withColumn("__part", F.pmod(F.xxhash64("__x", "__y"), parts)).drop("__parts")
    pieces = pieces.join(busy, cell_of, "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("__parts")
    group = [*cell_of, "__part"]
    kind = pa.list_(to_arrow_type(pieces.schema["route"].dataType))

    def measure(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right["route"]))
        names = right["route"].combine_chunks()
        new = pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False) if len(names) > 1 else np.zeros(0, bool)
        route = np.append(0, np.cumsum(new)) if len(names) else np.zeros(0, np.int64)
        xs, ys = (left[c].to_numpy() for c in ("__x", "__y"))
        ax, ay, bx, by = (right[c].to_numpy() for c in SEGMENT)
        dx, dy = bx - ax, by - ay
        length = dx * dx + dy * dy
        over = np.where(length > 0, length, 1.0)
        hits, counts, step = [], [], max(1, (1 << 18) // max(1, len(ax)))
        for at in range(0, len(xs), step):
            px, py = xs[at : at + step, None], ys[at : at + step, None]
            t = np.clip(np.where(length > 0, ((px - ax) * dx + (py - ay) * dy) / over, 0.0), 0.0, 1.0)
            row, col = np.nonzero(np.hypot(px - (ax + t * dx), py - (ay + t * dy)) <= radius)
            first = np.ones(len(row), bool)  # of the segments of a route at a place
            first[1:] = (row[1:] != row[:-1]) | (route[col[1:]] != route[col[:-1]])
            hits.append(col[first])
            counts.append(np.bincount(row[first], minlength=len(px)))
        ends = np.append(0, np.cumsum(np.concatenate(counts))) if counts else np.zeros(1, np.int64)
        taken = names.take(pa.array(np.concatenate(hits))) if hits else names[:0]
        routes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), taken)
        return pa.table({"__x": left["__x"], "__y": left["__y"], "__routes": routes.cast(kind)})

    schema = f"__x double, __y double, __routes array<{pieces.schema['route'].dataType.simpleString()}>"
    return places.groupBy(*group).cogroup(pieces.groupBy(*group)).applyInArrow(measure, schema)


def line_points(segments: DataFrame, spacing: float) -> DataFrame:
    """(x, y): distinct whole-metre points every ``spacing`` metres along each route from its first vertex.

    Lengths up to a segment are summed in two levels (blocks of a route's segments, then within a
    block), so a long route is many tasks.  Routes of no length have their first vertex only.
    """
    if not spacing > 0:
        raise ValueError(f"not a spacing: {spacing!r}")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    rows = segments.where(_real(*SEGMENT)).withColumns({"len": F.sqrt(dx * dx + dy * dy), "block": F.floor(F.col("n") / BLOCK)})
    blocks = rows.groupBy("route", "block").agg(F.sum("len").alias("__sum"))
    before = lambda *keys, order, value: F.coalesce(
        F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)
    )
    blocks = blocks.select("route", "block", before("route", order="block", value="__sum").alias("__base"))
    rows = rows.withColumn("__in", before("route", "block", order="n", value="len")).join(blocks, ["route", "block"])
    start = F.col("__base") + F.col("__in")
    rows = rows.withColumns({"from": start, "first": F.ceil(start / spacing), "last": F.floor((start + F.col("len")) / spacing)})
    rows = rows.where("last >= first").withColumn("k", F.explode(F.sequence("first", "last")))
    share = F.when(F.col("len") > 0, (F.col("k") * F.lit(spacing) - F.col("from")) / F.col("len")).otherwise(F.lit(0.0))
    return rows.select(F.round(F.col("ax") + dx * share).alias("x"), F.round(F.col("ay") + dy * share).alias("y")).distinct()


def route_points(segments: DataFrame, spacing: float = 2000.0, meters: bool = True, zone: int = 12) -> DataFrame:
    """Points along all routes with the joined names of the routes within half the spacing of them.

    (x, y, routes) in metres, or (longitude, latitude, routes) to five decimals."""
    points = _passing(_places(line_points(segments, spacing), "x", "y"), segments, spacing / 2)
    points = points.select(F.col("__x").alias("x"), F.col("__y").alias("y"), F.array_join(F.col("__routes").cast("array<string>"), "").alias("routes"))
    if meters:
        return points
    lat, lon = utm_inverse(F.col("x"), F.col("y"), zone)
    return points.select(F.round(lon, 5).alias("longitude"), F.round(lat, 5).alias("latitude"), "routes")
