"""Distances, cell areas, projection, segments and polygons as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8
#: Fixed values of the WGS84 ellipsoid and of the transverse Mercator grid.
WGS_A, WGS_F, UTM_K0, FALSE_EAST = 6_378_137.0, 1 / 298.257223563, 0.9996, 500_000.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2
    )
    return 2 * EARTH_M / 1000 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def cell_area_m2(lat: Column, dlon: float, dlat: float) -> Column:
    """Area of the cell of that size around latitude ``lat``, on the sphere."""
    band = F.sin(F.radians(lat + dlat / 2)) - F.sin(F.radians(lat - dlat / 2))
    return F.lit(EARTH_M**2 * math.radians(dlon)) * band


def grid_snap(x: Column, res: float) -> Column:
    """Nearest multiple of ``res``; halves go to the even one."""
    return F.rint(x / F.lit(res)) * F.lit(res)


def utm(lat: Column, lon: Column, zone: int = 12) -> tuple[Column, Column]:
    """Easting and northing in metres (Snyder 1987, northern hemisphere)."""
    e2 = WGS_F * (2 - WGS_F)
    ep2 = e2 / (1 - e2)
    phi, dl = F.radians(lat), F.radians(lon - F.lit(zone * 6 - 183))
    n = F.lit(WGS_A) / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    t, c, a = F.pow(F.tan(phi), 2), ep2 * F.pow(F.cos(phi), 2), F.cos(phi) * dl
    m = WGS_A * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi)
        - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    east = UTM_K0 * n * (a + (1 - t + c) * F.pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(a, 5) / 120)
    north = UTM_K0 * (
        m
        + n * F.tan(phi)
        * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * F.pow(a, 6) / 720)
    )
    return east + FALSE_EAST, north


def utm_inverse(east: Column, north: Column, zone: int = 12) -> tuple[Column, Column]:
    """Latitude and longitude of an easting and northing (Snyder 1987, northern hemisphere).

    Within three degrees of the zone's meridian ``utm`` and back again moves a point by less than a millimetre."""
    e2 = WGS_F * (2 - WGS_F)
    ep2, root = e2 / (1 - e2), math.sqrt(1 - e2)
    e1 = (1 - root) / (1 + root)
    mu = north / F.lit(UTM_K0 * WGS_A * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    foot = (
        mu
        + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu)
        + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu)
        + (151 * e1**3 / 96) * F.sin(6 * mu)
        + (1097 * e1**4 / 512) * F.sin(8 * mu)
    )
    c, t = ep2 * F.pow(F.cos(foot), 2), F.pow(F.tan(foot), 2)
    w = 1 - e2 * F.pow(F.sin(foot), 2)
    n, r = F.lit(WGS_A) / F.sqrt(w), F.lit(WGS_A * (1 - e2)) / F.pow(w, 1.5)
    d = (east - FALSE_EAST) / (n * UTM_K0)
    lat = foot - (n * F.tan(foot) / r) * (
        F.pow(d, 2) / 2
        - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep2) * F.pow(d, 4) / 24
        + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep2 - 3 * c * c) * F.pow(d, 6) / 720
    )
    turn = (d - (1 + 2 * t + c) * F.pow(d, 3) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep2 + 24 * t * t) * F.pow(d, 5) / 120) / F.cos(foot)
    return F.degrees(lat), F.degrees(turn) + F.lit(float(zone * 6 - 183))


def segment_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of the point from the segment a-b."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length > 0, ((x - ax) * dx + (y - ay) * dy) / length).otherwise(F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(x - (ax + t * dx), y - (ay + t * dy))


def within_line(x: Column, y: Column, vertices: list[tuple[float, float]], radius: float) -> Column:
    """The point lies within ``radius`` of the line (round caps)."""
    hit = F.lit(False)
    for (ax, ay), (bx, by) in zip(vertices, vertices[1:]):
        hit = hit | (segment_distance(x, y, *map(F.lit, (ax, ay, bx, by))) <= radius)
    return hit


def in_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule; the ring need not repeat its first vertex."""
    odd = F.lit(0)
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if ay != by:
            crosses = ((F.lit(ay) > y) != (F.lit(by) > y)) & (x < F.lit(bx - ax) * (y - ay) / (by - ay) + ax)
            odd = odd + F.when(crosses, 1).otherwise(0)
    return odd % 2 == 1


def points_along(vertices: list[tuple[float, float]], spacing: float) -> list[tuple[float, float]]:
    """Whole-metre points every ``spacing`` along the line, from its first vertex (driver helper)."""
    out, left = [], 0.0
    for (ax, ay), (bx, by) in zip(vertices, vertices[1:]):
        length = math.hypot(bx - ax, by - ay)
        at = left
        while at <= length and length:
            out.append((round(ax + (bx - ax) * at / length), round(ay + (by - ay) * at / length)))
            at += spacing
        left = at - length
    return list(dict.fromkeys(out))


def wind_components(speed: Column, direction: Column) -> tuple[Column, Column]:
    return -speed * F.sin(F.radians(direction)), -speed * F.cos(F.radians(direction))


def wind_direction(u: Column, v: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(-u, -v)), F.lit(360.0))
