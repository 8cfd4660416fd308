"""Readers of real layouts, concentrations, forward operator choices, assembly from a configuration, stored series."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from airflux.operators import aggregate, inversion, mobile, results
from airflux.plans import assembly, forward, series, sweep
from airflux.plans.concentrations import load_concentrations
from airflux.plans.config import InversionConfig
from airflux.sources import readers, registry, writers


def met_line(hms="030405", year="2024", day="2"):
    line = [str(k) for k in range(25)]
    line[1:5] = [hms, year, "1", day]
    return ", ".join(line)


def test_met_file(spark, tmp_path):
    head = "a\nb\nc\n" + ",".join(readers.MET_COLUMNS) + "\n"
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "one.csv").write_text(head + "\n".join([met_line(day="3"), met_line(), met_line(year="x"), met_line() + ",9,9", ", ".join(met_line("040506.5").split(", ")[:9])]))
    rows = readers.read_met_csv(spark, str(tmp_path / "m")).collect()
    assert [r["Time_UTC"] for r in rows] == [datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 4, 5, 6, 500000), datetime(2024, 1, 3, 3, 4, 5)]
    assert rows[0]["latitude"] == 5.0 and rows[0]["VehicleSpeed"] == 24.0 and rows[0]["Pressure (bar)"] == 15.0 and rows[1]["VehicleSpeed"] is None
    assert len(rows[0]) == 13 and rows[0]["filename"].endswith("one.csv")
    (tmp_path / "m" / "two.csv").write_text(head + "nothing fits\n")
    with pytest.raises(Exception, match="no line fits"):
        readers.read_met_csv(spark, str(tmp_path / "m")).collect()


def test_lines_of_geojson(spark, tmp_path):
    line, far = [[-111.9, 40.7], [-111.8, 40.8]], [[0.0, 0.0], [1.0, 1.0], [2.0, 2.0]]
    shapes = [("LineString", line), ("MultiLineString", [line, far]), ("Point", [0.0, 0.0])]
    feats = [{"type": "Feature", "properties": {}, "geometry": {"type": t, "coordinates": c}} for t, c in shapes]
    path = tmp_path / "l.json"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": feats}))
    got = {tuple(r) for r in readers.read_geojson_lines(spark, str(path)).collect()}
    assert got == {(0, 0, k, *p) for k, p in enumerate(line)} | {(1, 0, k, *p) for k, p in enumerate(line)} | {(1, 1, k, *p) for k, p in enumerate(far)}
    assert readers.read_geojson_lines(spark, str(path), (-112, 40, -111, 41)).count() == 4


def archive(spark):
    t = datetime(2024, 1, 1, 20)
    rows = []
    for k in range(4):
        at = t + timedelta(hours=k)
        rows += [
            ("wbb", "lgr_ugga", "calibrated", at, -10, 0, 2.0 + k, 400.0, None),
            ("wbb", "lgr_ugga", "qaqc", at, -10, 0, 9.0, 400.0, None),
            ("hw", "picarro_g2307", "calibrated", at, -10, 5 if k == 0 else 1, 3.0, None, 0.1),
            ("trx01", "lgr_ugga", "calibrated", at, -10, 0, 2.5, 410.0, None),
            ("nope", "lgr_ugga", "calibrated", at, -10, 0, 2.5, 410.0, None),
        ]
    return spark.createDataFrame(
        rows,
        "site string, instrument string, lvl string, Time_UTC timestamp_ntz, ID_CH4 int, QAQC_Flag int, CH4d_ppm_cal double, CO2d_ppm_cal double, H2COd_ppm_cal double",
    )


def test_concentrations(spark):
    rows = load_concentrations(archive(spark), "CH4", sites=["WBB", "hw", "nope"])
    assert rows.columns == ["Time_UTC", "Time_MST", "site", "org", "instrument", "CH4"]
    assert sorted((r["site"], r["CH4"]) for r in rows.collect()) == [("hw", 3.0)] * 3 + [("wbb", 2.0), ("wbb", 3.0), ("wbb", 4.0), ("wbb", 5.0)]
    some = load_concentrations(archive(spark), ["CH4", "CO2"], sites=["wbb"], include_location=True, hours=[13, 14], time_range=("2024-01-01 20:00:00", "2024-01-01 21:00:00"))
    assert sorted(r["Time_MST"].hour for r in some.collect()) == [13, 14] and some.first()["height"] == 35.0 and some.first()["CO2"] == 400.0
    flagged = load_concentrations(archive(spark), "CH4", sites=["hw"], valid_flags={"CH4": {5}}, valid_range={"CH4": (0.0, 5.0)})
    assert flagged.count() == 1
    gps = spark.createDataFrame(
        [("trx01", datetime(2024, 1, 1, 20) + timedelta(hours=h, seconds=-5), 40.7, -111.9, 1300.0 + h) for h in range(4)],
        "site string, Time_UTC timestamp_ntz, latitude double, longitude double, altitude double",
    )
    moved = load_concentrations(archive(spark), ["CH4"], sites=["wbb", "trx01"], gps=gps).collect()
    assert sum(r["is_mobile"] for r in moved) == 2 and {r["latitude"] for r in moved if r["is_mobile"]} == {40.7} and len(moved) == 6
    for wrong in ({}, {"sites": ["elsewhere"]}, {"sites": ["trx01"]}):
        with pytest.raises(ValueError):
            load_concentrations(archive(spark), ["CH4"], **wrong)
    assert load_concentrations(archive(spark).limit(0), ["CH4"], orgs=["DAQ"]).count() == 0


def test_tracks(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, h), datetime(2024, 1, 1, h, 1), -111.9, 40.7, 1300.0) for h in range(3)] + [(None, None, 0.0, 0.0, 0.0)]
    spark.createDataFrame(rows, "Time_UTC timestamp_ntz, Pi_Time timestamp_ntz, Longitude_deg double, Latitude_deg double, Altitude_msl double").write.parquet(str(tmp_path / "g"))
    assert readers.read_gps(spark, str(tmp_path / "g"), "trx01").count() == 3
    got = readers.read_gps(spark, str(tmp_path / "g"), "trx01", "Pi_Time", "2024-01-01 01:01:00", "2024-01-01 01:01:00").collect()
    assert [(r["site"], r["Time_UTC"], r["latitude"]) for r in got] == [("trx01", datetime(2024, 1, 1, 1, 1), 40.7)]
    assert mobile.with_defaults("trx01", routes=False)["routes"] is None and mobile.with_defaults("wbb", storage=[(0, 0)])["storage"] == [(0, 0)]
    with pytest.raises(ValueError):
        mobile.with_defaults("trx01", routes=True)


def test_forward_choices(spark):
    assert forward.finest({"a": 0.1, "b": 0.01}) == "b"
    with pytest.raises(ValueError):
        forward.finest({})
    t = datetime(2024, 1, 1, 19)
    foot = spark.createDataFrame(
        [(loc, t + timedelta(hours=h), t, 0.0, 0.0, 1.0, fp) for loc in ("l1", "p", "other") for h in (0, 5) for fp in ("a", "b")],
        "location_id string, run_time timestamp_ntz, foot_time timestamp_ntz, lon double, lat double, foot double, footprint string",
    )
    got = forward.relevant(foot, ["wbb", "p"], {"l1": "wbb"}, [19], "b").collect()
    assert sorted(r["obs_location"] for r in got) == ["p", "wbb"] and {r["obs_time"] for r in got} == {t}
    rows = forward.relevant(foot, ["wbb", "p"], {"l1": "wbb"})
    assert forward.simulations(foot).count() == 6 and forward.enough_simulations(rows, 4).count() == 1 and forward.enough_simulations(rows, 5).count() == 0


def inversion_tables(spark):
    readings, foot = [], []
    for d in range(40):
        for h in range(19, 24):
            at = datetime(2024, 1, 1) + timedelta(days=d, hours=h)
            readings += [(at + timedelta(minutes=20 * m), "wbb", "lgr_ugga", 2.0 + 0.01 * ((d * 5 + h) % 7), 0, -10) for m in range(3)]
            foot += [("loc", at, at - timedelta(hours=1), -112.1 + 0.1 * (k % 2), 40.5 + 0.1 * (k // 2), 0.1 + 0.05 * ((d + h + k) % 5)) for k in range(4)]
    return assembly.Tables(
        spark.createDataFrame(readings, "Time_UTC timestamp_ntz, site string, instrument string, CH4 double, QAQC_Flag int, ID_CH4 int"),
        spark.createDataFrame(foot, "location_id string, run_time timestamp_ntz, foot_time timestamp_ntz, lon double, lat double, foot double"),
        events=[("2024-01-03 00:00:00", "2024-01-04 12:00:00")],
        expected={"lgr_ugga": 3.0},
    )


def test_assembly(spark, tmp_path):
    count = iter(range(1000))

    def write(df, name):
        path = str(tmp_path / f"{name}{next(count)}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    tables = inversion_tables(spark)
    config = InversionConfig(
        tstart="2024-01-01", tend="2024-03-01", xmin=-112.15, xmax=-111.95, ymin=40.45, ymax=40.65, dx=0.1, dy=0.1, location_site_map={"loc": "wbb"},
        min_obs_per_interval=20, min_sims_per_interval=20, background_kwargs={"window": "10d", "min_periods": 5}, bias_std=0.05, bias_grouping="site_group",
        prior_kwargs={"value": 0.02},
    )
    made = assembly.assembled(spark, tables, config, write)
    keys = {tuple(r) for r in made.obs.select("obs_location", "obs_time").collect()}
    assert keys and all(place == "wbb" and t.hour in range(19, 24) and not datetime(2024, 1, 3) <= t <= datetime(2024, 1, 4, 12) for place, t in keys)
    assert {tuple(r) for r in made.jacobian.select("obs_location", "obs_time").distinct().collect()} <= keys
    assert made.bias.count() == 2 and made.bias_jacobian.count() == made.obs.count() and made.prior.count() == 8
    out = assembly.run_from(spark, tables, config, write)
    assert out.posterior.count() == 8 and out.bias.count() == 2 and 0 < out.metrics["DOFS"] < 10
    import dataclasses

    daily = assembly.assembled(spark, tables, dataclasses.replace(config, aggregate_obs="1D", bias_std=None), write)
    assert daily.bias is None and 0 < daily.obs.count() < made.obs.count() / 3
    whole, part = (x.jacobian.agg(F.sum("value")).first()[0] / x.obs.count() for x in (made, daily))
    assert abs(whole - part) < 0.05 * whole
    # The covariance of daily means is W S W' of the hourly one.
    entries = {tuple(r)[:3]: r["value"] for r in made.obs_cov(made.obs).collect()}
    days = {}
    for place, t in keys:
        days.setdefault((place, t.replace(hour=0)), []).append(t)
    got = {(r["obs_location"], r["time_i"], r["time_j"]): r["value"] for r in daily.obs_cov(daily.obs).collect()}
    assert len(got) == len(days) ** 2
    for (p, a), left in days.items():
        for (_, b), right in days.items():
            want = sum(entries.get((p, t, u), 0.0) for t in left for u in right) / (len(left) * len(right))
            assert abs(got[p, a, b] - want) < 1e-12
    # Sites and the offset from UTC count: another site's readings go, other hours stay.
    more = dataclasses.replace(tables, readings=tables.readings.unionByName(tables.readings.withColumn("site", F.lit("hw"))))
    assert {tuple(r) for r in assembly.assembled(spark, more, config, write).obs.select("obs_location", "obs_time").collect()} == keys
    shifted = assembly.assembled(spark, tables, dataclasses.replace(config, utc_offset=-5, subset_hours=(14, 15), min_obs_per_interval=5, min_sims_per_interval=5), write)
    assert {r["obs_time"].hour for r in shifted.obs.collect()} == {19, 20} and shifted.jacobian.select("obs_time").distinct().count() == shifted.obs.count()
    # Bins of two weeks.
    weekly = assembly.assembled(spark, tables, dataclasses.replace(config, flux_freq="2W", min_obs_per_interval=5, min_sims_per_interval=5), write)
    starts = {r[0] for r in weekly.prior.select("time").distinct().collect()}
    assert starts == {datetime(2024, 1, 7), datetime(2024, 1, 21), datetime(2024, 2, 4)}
    assert {r[0] for r in weekly.jacobian.select("time").distinct().collect()} <= starts and weekly.jacobian.count() > 0
    with pytest.raises(ValueError):
        assembly.unit_of(dataclasses.replace(config, flux_freq="3D"))
    few = assembly.assembled(spark, tables, dataclasses.replace(config, min_sims_per_interval=10_000), write)
    assert few.obs.count() == 0
    with pytest.raises(ValueError):
        assembly.prior_of(spark, tables, dataclasses.replace(config, prior="other"))
    field = spark.createDataFrame(
        [(datetime(2024, m, 1), -112.1 + 0.1 * i, 40.5 + 0.1 * j, s, 1.0) for m in (1, 2) for i in range(2) for j in range(2) for s in ("a", "b")],
        "time timestamp_ntz, lon double, lat double, sector string, value double",
    )
    prior = assembly.prior_of(spark, dataclasses.replace(tables, inventory=field), dataclasses.replace(config, prior="inventory", prior_kwargs={"units": "Mg/m2/s"}))
    assert prior.count() == 8 and all(abs(r["value"] - 0.002) < 1e-9 for r in prior.collect())


def test_inventory_steps(spark):
    rows = spark.createDataFrame([(datetime(2024, 1, d), 1, float(d)) for d in range(1, 5)], "time timestamp_ntz, k int, value double")
    assert inversion.resample(rows, ["k"], "D", "MS").collect() == [(datetime(2024, 1, 1), 1, 2.5)]
    assert inversion.resample(rows, ["k"], "MS", "D") is rows and inversion.resample(rows, ["k"], "MS", "MS") is rows
    assert inversion.in_units(rows, "g/m2/s", "kg/m2/s").agg(F.sum("value")).first()[0] == pytest.approx(0.01)
    with pytest.raises(ValueError):
        inversion.in_units(rows, "g/m2/s", "g/m2/h")
    both = inversion.state_blocks(rows, rows.select("time", "value"))
    assert both.groupBy("block").count().count() == 2


def test_interday_product_by_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    times = sorted({datetime(2024, 1, 1) + timedelta(hours=int(h)) for h in rng.integers(0, 400, 60)})
    values = rng.normal(size=len(times))
    df = spark.createDataFrame([("a", t, float(v)) for t, v in zip(times, values)] + [("b", times[0], 1.0), ("b", None, 1.0)], "obs_location string, obs_time timestamp_ntz, value double")
    got = {(r[0], r[1]): r[2] for r in inversion.mdm_product(df, 0.5, "2d", True).collect()}
    h = np.array([t.timestamp() for t in times]) / 3600
    want = 0.25 * np.exp(-np.abs(h[:, None] - h) / 48) @ values
    assert all(abs(got["a", t] - w) < 1e-9 for t, w in zip(times, want)) and got["b", times[0]] == 0.25 and len(got) == len(times) + 1


def test_stored_series(spark, tmp_path):
    hours = spark.createDataFrame([(datetime(2024, 1, 1, h % 24) + timedelta(days=h // 24), float(h % 5)) for h in range(60)], "Time_UTC timestamp_ntz, CH4 double")
    asked = []
    known = series.HourlySeries(lambda site: asked.append(site) or hours, window="1d", min_periods=3)
    assert known["uta"].count() == 60 and known["uta_base"].where("baseline is not null").count() == 58 and known["uta"] is known["uta"] and asked == ["uta"]
    with pytest.raises(KeyError):
        known["uta_top"]
    levels = [(datetime(2024, 1, 1) + timedelta(hours=12 * k), float(z), 280.0 + (20.0 if 1 <= k <= 4 else 0.01) * (z - 1200) / 1000, 1.1) for k in range(8) for z in range(1200, 2201, 100)]
    soundings = spark.createDataFrame(levels, "time timestamp_ntz, z double, theta double, rho double")
    path, calls = str(tmp_path / "events"), []
    for _ in range(2):
        events = series.stored_pcap_events(spark, path, lambda: calls.append(1) or soundings)
    assert calls == [1] and series.event_list(events) == [("2024-01-01 12:00:00", "2024-01-03 00:00:00")]
    points = series.stored_route_points(spark, str(tmp_path), {"g": [(0, 0), (100, 0)]}, 50)
    assert sorted(tuple(r) for r in points.collect()) == sorted(tuple(r) for r in series.stored_route_points(spark, str(tmp_path), {}, 50).collect())
    assert points.count() == 3


def test_other_readers(spark, tmp_path):
    t = datetime(2024, 1, 1)
    spark.createDataFrame([("SLC", t, 1200.0, 280.0, 1.1), ("SLC", datetime(2024, 6, 1), 1200.0, 280.0, 1.1), ("X", t, 1.0, 1.0, 1.0)], "station string, time timestamp_ntz, z double, theta double, rho double").write.parquet(str(tmp_path / "s"))
    assert readers.read_soundings(spark, str(tmp_path / "s"), months=[1]).count() == 1 and readers.read_soundings(spark, str(tmp_path / "s"), start="2024-02-01", end="2024-07-01").count() == 1
    grid = [(t, -112.0 + 0.1 * i, 40.0 + 0.1 * j, s, 1.0) for i in range(3) for j in range(3) for s in ("a", "b")]
    spark.createDataFrame(grid, "time timestamp_ntz, lon double, lat double, sector string, value double").write.parquet(str(tmp_path / "i"))
    assert readers.read_inventory(spark, str(tmp_path / "i"), "2024-01-01", "2024-02-01", ["a"], (-112.05, 39.9, -111.85, 40.05)).count() == 2
    assert readers.read_inventory(spark, str(tmp_path / "i"), end="2024-01-01").count() == 0
    cell = readers.read_cell(spark, str(tmp_path / "i"), -111.96, 40.02, 0.1, 0.1)
    assert {(round(r["lon"], 6), round(r["lat"], 6)) for r in cell.collect()} == {(-112.0, 40.0)}
    (tmp_path / "ch4_uta.csv").write_text("datetime,value,qcflag,latitude,longitude\n2024-01-01T00:00:00Z,1900.0,...,39.9,-113.7\n2024-01-02T00:00:00Z,1.0,*..,1,1\n")
    assert readers.read_flask(spark, str(tmp_path / "{specie}_{site}.csv")).collect()[0]["ch4"] == 1900.0
    assert registry.point_sources(spark, "landfill").count() == 5 and registry.point_sources(spark).count() == 44


def test_sinks_and_selectors(spark, tmp_path):
    rows = spark.range(100).select((F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=(97 * F.col("id") % 100).cast("int"))).alias("Time_UTC"), F.lit("a").alias("site"))
    writers.write_sorted(rows.repartition(4), str(tmp_path / "sorted"))
    import glob

    import pyarrow.parquet as pq

    parts = [pq.read_table(f)["Time_UTC"].to_pylist() for f in sorted(glob.glob(f"{tmp_path}/sorted/part-*"))]
    flat = [x for p in parts for x in p]
    assert flat == sorted(flat) and len(flat) == 100
    table = spark.createDataFrame([("a", 0.2), ("b", 0.1), ("c", None)], "config_id string, chi2_distance double")
    assert results.best_row(table).collect()[0]["config_id"] == "b" and results.best_row(table.limit(0)).count() == 0
    tracks = spark.createDataFrame([(k, t) for k in "ab" for t in range(7)], "k string, t int")
    assert sorted(tuple(r) for r in aggregate.numbered(tracks, ["k"], ["t"], 3).collect()) == [(k, t) for k in "ab" for t in (0, 3, 6)]
    writers.log_errors(spark.createDataFrame([("x", "bad"), ("y", None)], "config_id string, error string"), str(tmp_path / "log"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "log")).collect()] == ["x: bad"]


def test_job_array(spark, tmp_path, monkeypatch):
    path, calls = str(tmp_path / "sweep"), []

    def solve(config):
        calls.append(config.prior_base_std)
        return {"reduced_chi2": config.prior_base_std}

    with pytest.raises(FileNotFoundError):
        sweep.run_index(spark, path, solve, 0)
    configs = sweep.build_grid(InversionConfig(), {"prior_base_std": [0.1, 0.2]})
    sweep.run(spark, configs, solve, path, jobs=0)
    monkeypatch.setenv("AIRFLUX_TASK", "1")
    sweep.run_index(spark, path, solve)
    assert sweep.run_index(spark, path, solve).count() == 1 and calls == [0.2]
    with pytest.raises(IndexError):
        sweep.run_index(spark, path, solve, 2)
    assert sweep.run(spark, configs, solve, path, jobs=1).count() == 2 and calls == [0.2, 0.1]
