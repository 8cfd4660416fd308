"""Readers, writers, selectors and figure tables on small tables with nulls, ties and empties."""

from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest

from airflux import queries
from airflux.operators import curvefit, qa, report
from airflux.sources import readers, writers
from airflux.streaming import hourly

SF = "/root/testdata/sf0.001"
T = datetime(2024, 1, 1)


def test_archive(spark, tmp_path):
    rows = [(T + timedelta(hours=k), float(k), site, inst, lvl) for k in range(10) for site in "ab" for inst in ("x", "y") for lvl in ("raw", "calibrated")]
    table = spark.createDataFrame([*rows, (None, 1.0, "a", "x", "raw")], "Time_UTC timestamp_ntz, CH4 double, site string, instrument string, lvl string")
    table.write.partitionBy("site", "instrument", "lvl").parquet(str(tmp_path / "arch"))
    got = readers.read_archive(spark, str(tmp_path / "arch"), "a", "x", "raw", "2024-01-01 02:00:00", "2024-01-01 05:00:00")
    assert sorted(r["CH4"] for r in got.collect()) == [2.0, 3.0, 4.0, 5.0]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(site" in plan and "GreaterThanOrEqual(Time_UTC" in plan
    assert readers.read_archive(spark, str(tmp_path / "arch"), "c", "x", "raw", "2024-01-01", "2025-01-01").count() == 0


def test_site_csv(spark, tmp_path):
    (tmp_path / "sites.csv").write_text("stid,latitude,status,network\nwbb,40.7,ACTIVE,1\nhw,NA,INACTIVE,2\n,41.0,ACTIVE,\n")
    sites = readers.read_site_csv(spark, str(tmp_path / "sites.csv"), "stid string, latitude double, status string, network int")
    assert [tuple(r) for r in sites.collect()] == [("wbb", 40.7, "ACTIVE", 1), ("hw", None, "INACTIVE", 2), (None, 41.0, "ACTIVE", None)]
    assert report.stations(sites).count() == 3 and report.stations(sites, "ACTIVE").count() == 2
    assert [r["stid"] for r in report.stations(sites, None, [1, 2]).collect()] == ["wbb", "hw"] and report.stations(sites, "ACTIVE", [2]).count() == 0


def test_append_rows(spark, tmp_path):
    rows = spark.range(3)
    for _ in range(2):
        writers.append_rows(rows, str(tmp_path / "rows"))
    writers.append_rows(rows.limit(0), str(tmp_path / "rows"))
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "rows")).collect()) == [0, 0, 1, 1, 2, 2]


def test_sessions(spark):
    at = lambda *hours: [("a", T + timedelta(hours=h)) for h in hours]
    rows = spark.createDataFrame([*at(0, 1, 1, 3.5, 8, 20), ("b", T), ("b", None)], "site string, Time_UTC timestamp_ntz")
    got = sorted(((r["site"], r["n"]) for r in hourly.sessions(rows).collect()))
    assert got == [("a", 1), ("a", 1), ("a", 4), ("b", 1)]
    assert hourly.sessions(rows.limit(0)).count() == 0


def test_numbers_and_box(spark):
    rows = spark.createDataFrame([("1.5", "x", None, -112.0, 40.5), ("2", "3", None, -111.0, None), (None, None, None, -112.0, 41.0)], "a string, b string, c string, longitude double, latitude double")
    got = qa.to_numbers(rows, ["a", "b", "c"])
    assert dict(got.dtypes) == {"a": "double", "b": "string", "c": "double", "longitude": "double", "latitude": "double"}
    assert [r["a"] for r in got.collect()] == [1.5, 2.0, None] and qa.to_numbers(rows.limit(0), ["a", "b"]).count() == 0
    assert qa.in_box(rows, -112.0, 40.5, -111.0, 41.0).count() == 2 and qa.in_box(rows, -112.5, 40.6, -111.5, 40.9).count() == 0


def test_figures(spark):
    cells = report.cell_corners(spark.createDataFrame([(-112.0, 40.5), (None, 1.0)], "lon double, lat double"), 0.1, 0.2).collect()
    assert cells[0]["xmin"] == pytest.approx(-112.05) and cells[0]["ymax"] == pytest.approx(40.6) and cells[1]["xmax"] is None
    roads = spark.createDataFrame([(1,), (6,), (7,), (None,)], "code int")
    assert sorted(r[0] for r in report.major_roads(roads).collect()) == [1, 6]
    table = spark.createDataFrame([("a", T + timedelta(days=d), float(d)) for d in (0, 1, 2, 20, 21)], "k string, t timestamp_ntz, v double")
    smooth, gap = report.residual_series(table, ["k"], "t", "v", "4d", "7d")
    want = {0: 1.0, 1: 1.0, 2: 1.5, 20: 20.5, 21: 20.5}  # (t - 2d, t + 2d]
    got = {(r["t"] - T).days: r["smooth"] for r in smooth.collect()}
    assert got == pytest.approx(want)
    (only,) = gap.collect()
    assert {T + timedelta(days=2), T + timedelta(days=20)} <= set(only.asDict().values())


def test_curve_background_by_hand(spark):
    con = duckdb.connect()
    samples = con.sql(f"select date_trunc('day', o_orderdate)::timestamp as t, avg(o_totalprice) as v from '{SF}/orders.parquet' group by 1 order by 1").fetchall()
    hours = [r[0] for r in con.sql(f"select distinct date_trunc('hour', ts)::timestamp from '{SF}/events.parquet'").fetchall()]
    year = lambda t: t.year + (t - datetime(t.year, 1, 1)) / (datetime(t.year + 1, 1, 1) - datetime(t.year, 1, 1))
    t, v = np.array([year(r[0]) for r in samples]), np.array([r[1] for r in samples])
    want = curvefit.smooth_curve(t, v, np.array([year(h) for h in hours])) / 1000
    got = {r["obs_time"]: r["background"] for r in queries.QUERIES["curve_background"](spark, SF).collect()}
    assert got.keys() == set(hours) and all(abs(got[h] - w) < 2e-6 for h, w in zip(hours, want))
