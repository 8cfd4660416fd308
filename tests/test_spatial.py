"""Spatial joins, points along routes, projection there and back, model levels: against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from airflux.functions import geo
from airflux.operators import levels, spatial
from airflux.scratch import written


def brute_nearest(places, points):
    out = []
    for x, y in places:
        d = [((px - x) * (px - x) + (py - y) * (py - y), i) for i, px, py in points]
        out.append(min(d)[1])
    return out


@pytest.mark.parametrize("shape", ["uniform", "cluster", "line", "one"])
@pytest.mark.parametrize("small", [True, False])
def test_nearest(spark, shape, small, monkeypatch):
    if not small:
        monkeypatch.setattr(spatial, "BROADCAST_ROWS", 0)
    rng = np.random.default_rng(7)
    xy = {
        "uniform": rng.uniform(0, 100, (400, 2)),
        "cluster": np.vstack([50 + rng.normal(0, 1e-4, (300, 2)), rng.uniform(0, 100, (20, 2))]),
        "line": np.c_[np.arange(200.0), np.full(200, 5.0)],
        "one": np.array([[3.0, 4.0]]),
    }[shape].round(6)
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate(xy)]
    points += [(i + 1000, a, b) for i, a, b in points[:50]]  # ties: the least number
    places = [tuple(map(float, p)) for p in np.vstack([rng.uniform(-50, 150, (60, 2)), 50 + rng.normal(0, 1e-3, (20, 2)), xy[:5]])]
    places += [(k + 0.5, 5.0) for k in range(5)]  # between two points of the line
    given = [(n, x, y, "kept") for n, (x, y) in enumerate(places)]
    df = spark.createDataFrame(given, "n int, longitude double, latitude double, agg_lat string")
    table = spark.createDataFrame([*points, (-1, None, 1.0), (-2, 1.0, float("nan"))], "point int, x double, y double")
    got = {r["n"]: r for r in spatial.nearest(df, table).collect()}
    want = brute_nearest(places, points)
    assert [got[n]["point"] for n in range(len(places))] == want
    where = {i: (a, b) for i, a, b in points}
    assert all((got[n]["agg_lon"], got[n]["agg_lat"]) == where[i] for n, i in enumerate(want))


def test_nearest_edges(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.0, 0.0), (2, None, 0.0), (3, float("nan"), 1.0)], "n int, longitude double, latitude double")
    points = spark.createDataFrame([(5, 1.0, 1.0), (4, -1.0, 1.0)], "point int, x double, y double")
    got = sorted((r["n"], r["point"]) for r in spatial.nearest(df, points).select("n", F.coalesce("point", F.lit(-1)).alias("point")).collect())
    assert got == [(1, 4), (1, 4), (2, -1), (3, -1)]
    none = spatial.nearest(df, points.limit(0)).collect()
    assert len(none) == 4 and all(r["point"] is None and r["agg_lon"] is None for r in none)
    assert spatial.nearest(df.limit(0), points).count() == 0


def distance(x, y, ax, ay, bx, by):
    dx, dy = bx - ax, by - ay
    d = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / d)) if d else 0.0
    return math.hypot(x - ax - t * dx, y - ay - t * dy)


def test_routes_at(spark):
    rng = np.random.default_rng(3)
    segments = [(f"r{k % 12}", k // 12, *map(float, rng.uniform(-200, 200, 4))) for k in range(36)]
    segments += [("long", 0, -5000.0, 0.1, 5000.0, 0.2), ("dot", 0, 7.0, 7.0, 7.0, 7.0)]
    places = [tuple(map(float, p)) for p in rng.uniform(-220, 220, (150, 2))] + [(4900.0, 3.0), (1e4, 1e4)]
    df = spark.createDataFrame([(n, x, y, "old") for n, (x, y) in enumerate([*places, *places[:3]])], "n int, easting double, northing double, routes string")
    df = df.unionByName(spark.createDataFrame([(-1, None, 0.0, "old")], df.schema))
    table = spark.createDataFrame([*segments, ("gone", 0, None, 0.0, 1.0, 1.0)], "route string, n int, ax double, ay double, bx double, by double")
    got = {r["n"]: r["routes"] for r in spatial.routes_at(df, table, 12.5).collect()}
    for n, (x, y) in enumerate([*places, *places[:3]]):
        assert got[n] == sorted({s[0] for s in segments if distance(x, y, *s[2:]) <= 12.5})
    assert got[-1] == [] and len(got) == len(places) + 4
    assert spatial.routes_at(df, table.limit(0), 12.5).where("size(routes) = 0").count() == len(places) + 4
    with pytest.raises(ValueError):
        spatial.routes_at(df, table, 0)


def test_line_points_as_the_driver_helper(spark, monkeypatch):
    rng = np.random.default_rng(5)
    for block in (4096, 3):
        monkeypatch.setattr(spatial, "BLOCK", block)
        vertices = [(0.0, 0.0), *(tuple(map(float, p)) for p in rng.uniform(-3000, 3000, (15, 2)).round(1))]
        rows = spark.createDataFrame([("a", n, x, y) for n, (x, y) in enumerate(vertices)] + [("lone", 0, 1.0, 1.0)], "route string, n int, x double, y double")
        got = {(r["x"], r["y"]) for r in spatial.line_points(spatial.segments_of(rows), 250.0).collect()}
        assert got == {(float(a), float(b)) for a, b in geo.points_along(vertices, 250.0)}


def test_route_points_in_degrees(spark):
    rows = spark.createDataFrame([("b", 0, 424_000.0, 4_512_000.0), ("b", 1, 427_000.0, 4_512_000.0), ("a", 0, 426_000.0, 4_511_500.0), ("a", 1, 426_000.0, 4_513_500.0)], "route string, n int, x double, y double")
    segments = spatial.segments_of(rows)
    metres = {(r["x"], r["y"]): r["routes"] for r in spatial.route_points(segments, 1000.0).collect()}
    assert metres[(426_000.0, 4_512_000.0)] == "ab" and metres[(424_000.0, 4_512_000.0)] == "b" and metres[(426_000.0, 4_513_500.0 - 1000)] == "ab"
    degrees = spatial.route_points(segments, 1000.0, meters=False)
    e, n = geo.utm(F.col("latitude"), F.col("longitude"))
    back = {(round(r["e"]), round(r["n"])) for r in degrees.select(e.alias("e"), n.alias("n")).collect()}
    assert all(min(math.hypot(a - x, b - y) for a, b in back) < 1.5 for x, y in metres)  # five decimals: about a metre


def test_projection_and_back_under_a_millimetre(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), float(b)) for a, b in zip(rng.uniform(30, 48, 500), rng.uniform(-113.9, -108.1, 500))]
    df = spark.createDataFrame(rows, "lat double, lon double")
    e, n = geo.utm(F.col("lat"), F.col("lon"))
    lat, lon = geo.utm_inverse(F.col("e"), F.col("n"))
    for r in df.select("lat", "lon", e.alias("e"), n.alias("n")).select("lat", "lon", lat.alias("a"), lon.alias("b")).collect():
        north, east = (r["a"] - r["lat"]) * 111_200, (r["b"] - r["lon"]) * 111_200 * math.cos(math.radians(r["lat"]))
        assert math.hypot(north, east) < 1e-3


def test_levels(spark):
    field = [("c", k, 1000.0, float(k * k)) for k in range(1, 6)] + [("d", 1, 900.0, 3.0), ("e", 2, None, 1.0), ("f", 9, 900.0, 1.0)]
    df = spark.createDataFrame([*field, ("c", 2, 1000.0, 50.0)], "col string, level int, surface double, value double")
    table = [(k, 10.0 * (k - 1), 1 - (k - 1) / 6) for k in range(1, 7)]
    rows = levels.with_pressure(df, spark.createDataFrame(table, "level int, a double, b double"))
    mid = {k: (table[k - 1][1] + table[k][1]) / 2 + (table[k - 1][2] + table[k][2]) / 2 * 1000 for k in range(1, 6)}
    for r in rows.collect():
        want = None if r["col"] in "ef" else mid[r["level"]] if r["col"] == "c" else (10.0 / 2 + (1 + 5 / 6) / 2 * 900)
        assert r["pressure"] == pytest.approx(want) if want else r["pressure"] is None
    targets = [200.0, 500.0, mid[1], mid[5], 2000.0]
    got = {(r["col"], r["target"]): r["value"] for r in levels.at_pressures(rows, ["col"], targets).collect()}
    logs, values = [math.log(mid[k]) for k in range(5, 0, -1)], [float(k * k) for k in range(5, 0, -1)]
    inside = [t for t in targets if mid[5] <= t <= mid[1]]
    assert set(got) == {("c", t) for t in inside}
    for t in inside:
        assert got["c", t] == pytest.approx(np.interp(math.log(t), logs, values), abs=1e-9)
    assert levels.at_pressures(rows.limit(0), ["col"], targets).count() == 0
    with pytest.raises(ValueError):
        levels.with_pressure(df, spark.createDataFrame([(1, 0.0, 1.0), (1, 0.0, 1.0)], "level int, a double, b double"))


def test_pairs_of_places_and_routes_are_no_rows(spark, monkeypatch):
    """What moves is places and pieces; a full cell is several groups with the same result."""
    segments = written(spark.range(300).selectExpr("concat('r', id % 150) as route", "id as n", "double(id % 40) as ax", "double(id % 7) as ay", "double(id % 11) as bx", "double(id % 30) as by"), "s")
    places = spark.range(400).selectExpr("double(id % 20) as x", "double(id div 20) as y").union(spark.sql("select 900.0D, 900.0D"))
    want = {(r["x"], r["y"]): r["routes"] for r in spatial.routes_at(places, segments, 5.0, "x", "y").collect()}
    rows = {(s["route"], *(s[c] for c in spatial.SEGMENT)) for s in segments.collect()}
    for (x, y), routes in want.items():
        near = set()
        for route, ax, ay, bx, by in rows:
            dd = (bx - ax) ** 2 + (by - ay) ** 2
            t = min(max(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / dd, 0), 1) if dd else 0
            near |= {route} if ((x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by - ay)) ** 2) ** 0.5 <= 5.0 else set()
        assert routes == sorted(near)
    monkeypatch.setattr(spatial, "PAIRS", 1000)
    again = spatial.routes_at(places, segments, 5.0, "x", "y")
    assert {(r["x"], r["y"]): r["routes"] for r in again.collect()} == want
    plan = spatial.route_points(segments, 2.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan
