import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from airflux.functions import geo, timeutil


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


def test_durations():
    assert timeutil.duration_us("10s") == 10_000_000
    assert timeutil.duration_us("2.8h") == 10_080_000_000
    assert timeutil.freq_hours("12h") == 12
    for bad in ("MS", "W"):
        with pytest.raises(ValueError):
            timeutil.freq_hours(bad)


@pytest.mark.parametrize(
    "freq, want",
    [("12h", datetime(2024, 2, 14, 17)), ("2D", datetime(2024, 2, 14)), ("W", datetime(2024, 2, 12)), ("M", datetime(2024, 2, 1))],
)
def test_periods_ignore_the_multiplier(spark, freq, want):
    assert one(spark, timeutil.floor_period(ts("2024-02-14 17:45:01"), freq)) == want


def test_month_start_is_no_period():
    with pytest.raises(ValueError):
        timeutil.floor_period(F.lit(0), "MS")


def test_tumbling_windows_count_the_multiplier(spark):
    assert one(spark, timeutil.tumbling(ts("2024-02-14 17:45:01"), "12h")) == datetime(2024, 2, 14, 12)


def test_flux_bins_drop_partial_edges(spark):
    got = timeutil.flux_bins(spark, "2020-01-01", "2020-04-01").orderBy("bin_start").collect()
    assert [r[0].month for r in got] == [1, 2, 3] and got[-1][1] == datetime(2020, 4, 1)
    assert timeutil.flux_bins(spark, "2020-01-02", "2020-03-31").count() == 1
    assert timeutil.flux_bins(spark, "2020-01-01", "2020-01-11", "2D").count() == 5


def test_hours_shift_and_wrap():
    assert timeutil.utc_hours([12, 13], -7) == [19, 20]
    assert timeutil.utc_hours([23], -1) == [0]


def test_seasons(spark):
    got = [one(spark, timeutil.season(ts(f"2024-{m:02d}-15"))) for m in range(1, 13)]
    assert got == ["DJF"] * 2 + ["MAM"] * 3 + ["JJA"] * 3 + ["SON"] * 3 + ["DJF"]


def test_snap_is_half_even(spark):
    assert one(spark, geo.grid_snap(F.lit(2.5), 1.0)) == 2.0
    assert one(spark, geo.grid_snap(F.lit(3.5), 1.0)) == 4.0


def test_utm_against_known_point(spark):
    e, n = geo.utm(F.lit(40.766189), F.lit(-111.847672))
    got = spark.range(1).select(e, n).first()
    # distance east of the central meridian on the ellipsoid, to some metres
    n_radius = geo.WGS_A / math.sqrt(1 - geo.WGS_F * (2 - geo.WGS_F) * math.sin(math.radians(40.766189)) ** 2)
    east = 500000 + 0.9996 * n_radius * math.cos(math.radians(40.766189)) * math.radians(111 - 111.847672)
    assert abs(got[0] - east) < 10 and 4_510_000 < got[1] < 4_516_000


def test_polygon_and_segments(spark):
    ring = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]
    inside = lambda x, y: one(spark, geo.in_polygon(F.lit(float(x)), F.lit(float(y)), ring))
    assert inside(0.5, 1) and inside(3.8, 3) and not inside(2, 2) and not inside(5, 1)
    d = one(spark, geo.segment_distance(F.lit(5.0), F.lit(3.0), *map(F.lit, (0.0, 0.0, 2.0, 0.0))))
    assert abs(d - math.hypot(3, 3)) < 1e-12
    assert one(spark, geo.within_line(F.lit(1.0), F.lit(0.5), [(0.0, 0.0), (2.0, 0.0)], 0.5))


def test_points_along():
    assert geo.points_along([(0, 0), (100, 0), (100, 50)], 40) == [(0, 0), (40, 0), (80, 0), (100, 20)]


def test_wind_round_trip(spark):
    for d in (0.0, 45.0, 200.0, 359.0):
        u, v = geo.wind_components(F.lit(3.0), F.lit(d))
        assert abs(one(spark, geo.wind_direction(u, v)) - d) < 1e-9


def test_cell_areas_fill_the_sphere(spark):
    whole = one(spark, geo.cell_area_m2(F.lit(0.0), 360.0, 180.0))
    assert abs(whole - 4 * math.pi * geo.EARTH_M**2) / whole < 1e-12
