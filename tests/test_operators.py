import dataclasses
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from airflux.operators import aggregate, curvefit, inversion, joins, qa, results, solvers, windows
from airflux.plans import sweep
from airflux.plans.cache import cached
from airflux.plans.config import InversionConfig, component_hash, config_id
from airflux.plans.observations import observation_vector, with_background
from airflux.sources import readers, registry, writers
from airflux.streaming.hourly import hourly_stream

BASE = datetime(2024, 1, 1)
PLACES = {"A": (40.76, -111.89, 10.0), "B": (40.72, -111.83, 15.0)}


def stationary(spark, n=4, hours=3, per_site=None, instrument="lgr_ugga", mobile=True):
    rows = []
    for site, (lat, lon, z) in PLACES.items():
        count = (per_site or {}).get(site, n)
        for h in range(hours):
            for i in range(count):
                rows.append((BASE + timedelta(hours=h, seconds=i * (3600 // count)), site, instrument, False, lat, lon, z, 1.9 + 0.01 * i, 400.0))
    df = spark.createDataFrame(
        rows,
        "Time_UTC timestamp_ntz, site string, instrument string, is_mobile boolean, latitude double, longitude double, height double, CH4 double, CO2 double",
    )
    return df if mobile else df.drop("is_mobile")


def test_pass_through_without_keys(spark):
    assert aggregate.aggregate_obs(stationary(spark)).count() == 24


@pytest.mark.parametrize("func, want", [("mean", 1.915), ("median", 1.915), ("min", 1.9), ("count", 4)])
def test_hourly_aggregate(spark, func, want):
    got = aggregate.aggregate_obs(stationary(spark), freq="h", func=func).collect()
    assert len(got) == 6 and all(abs(r["CH4"] - want) < 1e-9 and r["instrument"] == "lgr_ugga" for r in got)
    assert {(r["latitude"], r["longitude"]) for r in got} == {p[:2] for p in PLACES.values()}


def test_without_mobile_column(spark):
    assert aggregate.aggregate_obs(stationary(spark, mobile=False), freq="h").count() == 6


def test_null_keys_go(spark):
    df = stationary(spark).withColumn("site", F.when(F.col("site") == "A", F.col("site")))
    assert aggregate.aggregate_obs(df, freq="h").count() == 3


def test_completeness_gate(spark):
    assert aggregate.aggregate_obs(stationary(spark, 309, 1), freq="h", stationary_min_percent=1.0).count() == 2
    mixed = aggregate.aggregate_obs(stationary(spark, hours=1, per_site={"A": 309, "B": 1}), freq="h", stationary_min_percent=0.75)
    assert [r["site"] for r in mixed.collect()] == ["A"]
    rate = aggregate.aggregate_obs(stationary(spark, 1000, 1, instrument="picarro_g2401"), freq="h", stationary_min_percent=0.5)
    assert rate.count() == 2
    with pytest.raises(ValueError):
        aggregate.require_rows(aggregate.aggregate_obs(stationary(spark, 1, 1), freq="h", stationary_min_percent=0.9))


def moving(spark, counts):
    rows = []
    for k, n in enumerate(counts):
        for i in range(n):
            rows.append((BASE + timedelta(seconds=10 * len(rows)), "mobile", "lgr_ugga", True, 40.72 + 0.11 * k, -111.92 + 0.09 * k, 2.0, 1300.0, 2.0 + k))
    return spark.createDataFrame(
        rows, "Time_UTC timestamp_ntz, site string, instrument string, is_mobile boolean, latitude double, longitude double, height double, altitude double, CH4 double"
    )


def test_mobile_grid_and_points(spark):
    df = moving(spark, [10, 2, 2])
    assert aggregate.aggregate_obs(df, mobile_grid_res=0.1).count() == 3
    kept = aggregate.aggregate_obs(df, mobile_grid_res=0.1, mobile_min_count=5).collect()
    assert len(kept) == 1 and abs(kept[0]["latitude"] - 40.7) < 1e-9
    points = [(-111.9, 40.7), (-111.85, 40.8), (-111.8, 40.9)]
    got = aggregate.aggregate_obs(df, freq="h", mobile_points=points)
    assert {(r["longitude"], r["latitude"]) for r in got.collect()} <= set(points)
    assert aggregate.aggregate_obs(df, mobile_grid_res=0.1, mobile_min_count=99).count() == 0


def test_mixed(spark):
    both = stationary(spark).unionByName(moving(spark, [4]), allowMissingColumns=True)
    got = aggregate.aggregate_obs(both, freq="h", mobile_grid_res=0.1).collect()
    assert len(got) == 7 and {r["is_mobile"] for r in got} == {True, False}


def test_unknown_aggregate(spark):
    with pytest.raises(ValueError):
        aggregate.aggregate_obs(stationary(spark), freq="h", func="mode")


def test_qa(spark):
    df = spark.createDataFrame(
        [(1, -10, 0, 2.0), (2, -9, 0, 2.0), (3, -10, 7, 2.0), (4, -10, -64, 2.0), (5, -10, 0, 1.0), (6, None, 0, 2.0), (7, -10, 0, None)],
        "i int, ID_CH4 int, QAQC_Flag int, CH4 double",
    )
    got = {r["i"]: r["v"] for r in df.select("i", qa.normalize_pollutant(df, "CH4").alias("v")).collect()}
    assert [i for i, v in got.items() if v is not None] == [1, 4]
    only = df.select("i", qa.normalize_pollutant(df, "CH4", valid_flags={7}).alias("v")).where("v is not null")
    assert [r["i"] for r in only.collect()] == [3]
    with pytest.raises(ValueError):
        qa.normalize_pollutant(df, "CO2")
    nan = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert qa.nan_to_null(nan).where("x is null").count() == 1


def test_sites(spark):
    sites = registry.sites(spark)
    assert sites.count() == 13
    assert [r["stid"] for r in qa.choose_sites(sites, ["WBB", "nowhere"]).collect()] == ["wbb"]
    with pytest.raises(ValueError):
        qa.choose_sites(sites)
    with pytest.raises(ValueError):
        registry.site_position("trx01")
    assert registry.expected_per_hour()["picarro_g2401"] == 1800
    assert qa.measuring(registry.instrument_columns(spark), ["H2CO"]).collect()[0][0] == "picarro_g2307"


def test_spike_days_keep_days_without_deviation(spark):
    rows = [("s", BASE + timedelta(days=d, minutes=10 * i), 2.0 + (i % 2) * (5.0 if d == 3 else 0.1)) for d in range(8) for i in range(6)]
    rows.append(("s", BASE + timedelta(days=20), 9.0))
    df = spark.createDataFrame(rows, "site string, Time_UTC timestamp_ntz, CH4 double")
    days = {r["Time_UTC"].date() for r in qa.drop_spike_days(df, 0.9).collect()}
    assert (BASE + timedelta(days=3)).date() not in days and (BASE + timedelta(days=20)).date() in days and len(days) == 8


def series(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    t = [BASE + timedelta(minutes=int(m)) for m in np.sort(rng.choice(60 * 24 * 9, n, replace=False))]
    pdf = pd.DataFrame({"site": rng.choice(["a", "b"], n), "t": t, "x": rng.normal(size=n), "y": rng.normal(size=n)})
    return pdf, spark.createDataFrame([(a, b.to_pydatetime(), x, y) for a, b, x, y in pdf.itertuples(index=False)], "site string, t timestamp_ntz, x double, y double")


def test_rolling_windows_against_pandas(spark):
    pdf, df = series(spark)
    got = windows.rolling_baseline(df, ["site"], "t", "x", "30h", 0.1, 4).toPandas().sort_values(["site", "t"], ignore_index=True)
    want = pdf.sort_values(["site", "t"]).set_index("t").groupby("site")["x"].rolling("30h", min_periods=4).quantile(0.1).reset_index()
    np.testing.assert_allclose(got["baseline"].to_numpy(float), want["x"].to_numpy(), atol=1e-12)
    got = windows.rolling_corr(df, ["site"], "t", "x", "y", "12h").toPandas().sort_values(["site", "t"], ignore_index=True)
    want = pd.concat([g.set_index("t")["x"].rolling("12h").corr(g.set_index("t")["y"]) for _, g in pdf.sort_values(["site", "t"]).groupby("site")])
    # a window of two points has r = +-1; pandas may lose digits there
    np.testing.assert_allclose(got["r"].to_numpy(float), want.to_numpy(), atol=1e-6)


def test_joins_against_pandas(spark):
    pdf, df = series(spark)
    left = df.select("site", "t", "x").where("x > 0")
    right = df.select("site", "t", "y").where("x <= 0")
    l_pdf, r_pdf = pdf[pdf.x > 0][["site", "t", "x"]], pdf[pdf.x <= 0][["site", "t", "y"]]
    want = pd.merge_asof(l_pdf.sort_values("t"), r_pdf.sort_values("t"), on="t", by="site").sort_values(["site", "t"])
    got = joins.asof_join(left, right, ["site"], "t", ["y"]).toPandas().sort_values(["site", "t"])
    np.testing.assert_allclose(got["y"].to_numpy(float), want["y"].to_numpy())
    near = joins.asof_join(left, right, ["site"], "t", ["y"], tolerance_us=3_600_000_000)
    tol = pd.merge_asof(l_pdf.sort_values("t"), r_pdf.sort_values("t"), on="t", by="site", tolerance=pd.Timedelta("1h"))
    assert near.where("y is null").count() == tol["y"].isna().sum()
    got = joins.lerp_join(left, right, ["site"], "t", ["y"]).toPandas().sort_values(["site", "t"])
    for site, g in got.groupby("site"):
        r = r_pdf[r_pdf.site == site].sort_values("t")
        want_y = np.interp(g["t"].astype("int64"), r["t"].astype("int64"), r["y"])
        np.testing.assert_allclose(g["y"].to_numpy(float), want_y, atol=1e-9)


def test_location_map(spark):
    ids = spark.createDataFrame([("-111.847672_40.766189_35",), ("x_1_2",), ("1_2",), ("-111.0_40.0_4",)], "location_id string")
    got = joins.location_map(ids, [("wbb", 40.766189, -111.847672, 35.0), ("hw", 40.734367, -111.872221, 4.0)]).collect()
    assert [tuple(r) for r in got] == [("-111.847672_40.766189_35", "wbb")]
    twice = joins.location_map(ids, [("a", 40.766189, -111.847672, 35.0), ("b", 40.766189, -111.847672, 35.0)])
    assert twice.count() == 0


def test_gaps_and_islands(spark):
    rows = [(BASE + timedelta(hours=12 * k), d) for k, d in enumerate([1.0, 5.0, 5.0, 5.0, 1.0, 5.0, 5.0, None, 5.0, 6.0, 7.0, 8.0])]
    df = spark.createDataFrame(rows, "time timestamp_ntz, heat_deficit double")
    got = sorted((r["n"], r["start"]) for r in windows.pcap_events(df).collect())
    assert [n for n, _ in got] == [3, 4]
    holes = spark.createDataFrame([(BASE,), (BASE + timedelta(days=10),), (BASE + timedelta(days=11),)], "t timestamp_ntz")
    assert windows.gaps(holes, [], "t", "7d").count() == 1


def test_heat_deficit(spark):
    df = spark.createDataFrame([(1, 1300.0, 270.0, 1.1), (1, 1800.0, 280.0, 1.0), (1, 2200.0, 290.0, 1.0), (1, 3000.0, 300.0, 0.9)], "s int, z double, theta double, rho double")
    d = [1005 * 1.1 * 20, 1005 * 10.0, 0.0]
    want = ((d[0] + d[1]) / 2 * 500 + (d[1] + d[2]) / 2 * 400) / 1e6
    assert abs(windows.heat_deficit(df, ["s"]).first()["heat_deficit"] - want) < 1e-9


# --- inversion -----------------------------------------------------------------------------------


def test_regrid_keeps_mass(spark):
    rng = np.random.default_rng(0)
    rows = [(BASE, -112.0 + 0.1 * (i + 0.5), 40.0 + 0.1 * (j + 0.5), float(rng.uniform())) for i in range(6) for j in range(6)]
    field = spark.createDataFrame(rows, "time timestamp_ntz, lon double, lat double, value double")
    out = inversion.regrid(field, (0.1, 0.1), (0.15, 0.2), (-112.0, 40.0))
    mass = lambda df, dx, dy: inversion.emissions(df, dx, dy, 1.0).agg(F.sum("value")).first()[0]
    assert abs(mass(out, 0.15, 0.2) / mass(field, 0.1, 0.1) - 1) < 1e-9


def toy(spark):
    rng = np.random.default_rng(1)
    cells = [(BASE, float(i), float(j)) for i in range(3) for j in range(2)]
    obs = [("l", BASE + timedelta(hours=h)) for h in range(8)]
    h = rng.uniform(size=(8, 6)) * (rng.uniform(size=(8, 6)) > 0.3)
    s0, z = rng.uniform(1, 2, 6), rng.uniform(3, 5, 8)
    jac = spark.createDataFrame([(*obs[i], *cells[j], float(h[i, j])) for i in range(8) for j in range(6) if h[i, j]], "obs_location string, obs_time timestamp_ntz, time timestamp_ntz, lon double, lat double, value double")
    prior = spark.createDataFrame([(*c, float(v)) for c, v in zip(cells, s0)], "time timestamp_ntz, lon double, lat double, value double")
    return h, s0, z, jac, prior, obs, cells


def test_sparse_product_and_coverage(spark):
    h, s0, z, jac, prior, obs, cells = toy(spark)
    got = {r["obs_time"]: r["value"] for r in inversion.spmv(jac, prior, inversion.STATE, inversion.OBS).collect()}
    for i, (_, t) in enumerate(obs):
        assert abs(got.get(t, 0.0) - (h @ s0)[i]) < 1e-12
    const = spark.createDataFrame([(*o, 1.0) for o in obs], "obs_location string, obs_time timestamp_ntz, value double")
    kept_prior, kept_jac, new_const, removed = inversion.coverage_filter(prior, jac, const, 40)
    gone = {(r["lon"], r["lat"]) for r in removed.collect()}
    cover = np.abs(h).sum(axis=0)
    assert gone == {cells[j][1:] for j in range(6) if cover[j] < np.percentile(cover, 40)}
    keep = np.array([c[1:] not in gone for c in cells])
    want = 1.0 + h[:, ~keep] @ s0[~keep]
    for r in new_const.collect():
        assert abs(r["value"] - want[[t for _, t in obs].index(r["obs_time"])]) < 1e-12
    assert inversion.reconstruct(prior, kept_prior.withColumn("value", F.lit(0.0))).where("value = 0").count() == keep.sum()


def test_solvers_agree(spark, tmp_path):
    def written(df, name):
        path = str(tmp_path / f"{name}{len(list(tmp_path.iterdir()))}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    h, s0, z, jac, prior, obs, cells = toy(spark)
    sigma, var = 0.5, 0.04
    dense = inversion.solve_dense(h, z, s0, np.eye(6) * sigma**2, np.eye(8) * var)
    k = sigma**2 * h.T @ np.linalg.inv(sigma**2 * h @ h.T + var * np.eye(8))
    np.testing.assert_allclose(dense["posterior"], s0 + k @ (z - h @ s0), atol=1e-10)
    assert abs(dense["DOFS"] - np.trace(k @ h)) < 1e-10 and 0 < dense["uncertainty_reduction"] < 1
    obs_df = spark.createDataFrame([(*o, float(v)) for o, v in zip(obs, z)], "obs_location string, obs_time timestamp_ntz, value double")
    got = solvers.solve_cg(jac, obs_df, prior.withColumn("sigma", F.lit(sigma)), obs_df.withColumn("value", F.lit(var)), written, steps=12)
    by = {(r["lon"], r["lat"]): r["value"] for r in got.collect()}
    np.testing.assert_allclose([by[c[1:]] for c in cells], dense["posterior"], atol=1e-6)


def test_mdm(spark):
    obs = spark.createDataFrame([("wbb", BASE + timedelta(hours=20 + h)) for h in range(8)], "obs_location string, obs_time timestamp_ntz")
    full = inversion.mdm_matrix(obs, inversion.mdm_components({}), {"wbb": "UATAQ"})
    diag = full.where("time_i = time_j").first()["value"]
    want = 0.000765**2 + 0.0033**2 + 0.0257**2 + 0.011**2 + 0.01311**2 + 0.00771**2
    assert abs(diag - want) < 1e-12 and full.count() == 64
    intraday = inversion.mdm_entries(obs, 0.1, scale="2.8h", interday=False)
    assert intraday.count() == 4 * 4 * 2
    vec = obs.withColumn("value", F.hour("obs_time") + 1.0)
    got = {r["obs_time"]: r["value"] for r in inversion.mdm_product(vec, 0.1, "2.8h").collect()}
    for t, v in got.items():
        same = [BASE + timedelta(hours=20 + h) for h in range(8) if (BASE + timedelta(hours=20 + h)).date() == t.date()]
        want = sum(0.01 * np.exp(-abs((t - u).total_seconds()) / 3600 / 2.8) * (u.hour + 1) for u in same)
        assert abs(v - want) < 1e-12
    with pytest.raises(Exception, match="no deviation"):
        inversion.mdm_entries(obs, {"hw": {"DJF": 1.0}}, correlated=False).collect()
    merged = inversion.mdm_components({"bg": {"std": 1.0}, "other": {"std": 2.0}})
    assert [c["name"] for c in merged] == list(inversion.MDM) and merged[3]["std"] == 1.0 and merged[3]["scale"] == "7d"


def test_bias(spark):
    from airflux.functions.timeutil import flux_bins

    bins = flux_bins(spark, "2020-01-01", "2020-04-01")
    assert inversion.bias_states(bins).count() == 3
    assert inversion.bias_states(bins, "site", ["wbb", "hw"]).count() == 6
    assert inversion.bias_states(bins, "site_group", ["wbb", "hw", "rb"], {"wbb": "UATAQ", "hw": "DAQ", "rb": "DAQ"}).count() == 6
    with pytest.raises(ValueError):
        inversion.bias_states(bins, "planet")
    obs = spark.createDataFrame([("wbb", datetime(2020, 1, 5)), ("x", datetime(2020, 3, 31)), ("wbb", datetime(2021, 1, 1))], "obs_location string, obs_time timestamp_ntz")
    got = inversion.bias_jacobian(obs, bins, "site_group", {"wbb": "UATAQ"}).collect()
    assert sorted(r["grp"] for r in got) == ["UATAQ", "unknown"] and all(r["value"] == 1.0 for r in got)


def test_inventory_times(spark):
    annual = spark.createDataFrame([(datetime(2019, 1, 1), 1.0), (datetime(2020, 1, 1), 2.0)], "time timestamp_ntz, value double")
    times = spark.createDataFrame([(datetime(2019, 6, 1),), (datetime(2020, 1, 1),), (datetime(2018, 1, 1),)], "time timestamp_ntz")
    got = {r["time"]: r["value"] for r in inversion.filled_forward(annual.withColumn("k", F.lit(1)), times, ["k"]).collect()}
    assert got == {datetime(2019, 6, 1): 1.0, datetime(2020, 1, 1): 2.0}
    near = {r["time"]: r["value"] for r in inversion.nearest_time(annual.withColumn("k", F.lit(1)), times, ["k"]).collect()}
    assert near[datetime(2018, 1, 1)] == 1.0 and near[datetime(2020, 1, 1)] == 2.0


def test_trend_p_value():
    assert abs(inversion.trend_p_value(0.5, 10) - 0.0220) < 2e-3
    assert inversion.trend_p_value(0.0, 10) == pytest.approx(1.0, abs=1e-3)


def test_curve_fit_recovers_a_season():
    t = np.arange(2015, 2020, 1 / 52)
    y = 1900 + 5 * (t - 2015) + 10 * np.sin(2 * np.pi * t)
    at = np.linspace(2015.5, 2019, 50)
    np.testing.assert_allclose(curvefit.smooth_curve(t, y, at), 1900 + 5 * (at - 2015) + 10 * np.sin(2 * np.pi * at), atol=0.05)


# --- plans, sources, streams -----------------------------------------------------------------------


def test_observation_vector(spark):
    got = observation_vector(stationary(spark, 309, 2).drop("CO2"), place=["latitude", "longitude", "height", "is_mobile"]).collect()
    assert {r["obs_location"] for r in got} == {"A", "B"} and len(got) == 4
    bg = spark.createDataFrame([(BASE, 1.8)], "obs_time timestamp_ntz, background double")
    assert with_background(spark.createDataFrame(got), bg).count() == 2


def test_config_identity(tmp_path):
    base = InversionConfig()
    assert len(config_id(base)) == 16
    assert config_id(base) == config_id(dataclasses.replace(base, cache=str(tmp_path)))
    assert config_id(base) != config_id(dataclasses.replace(base, prior_base_std=0.02))
    assert component_hash(base, ["sites"]) == component_hash(dataclasses.replace(base, gamma=2.0), ["sites"])
    assert base.subset_hours_utc == [19, 20, 21, 22, 23] and base.resolution == "0.05x0.05"
    assert base.map_extent[0] == pytest.approx(-112.25)


def test_cache(spark, tmp_path):
    calls = []

    @cached("obs")
    def build(spark, config):
        calls.append(1)
        return spark.range(3)

    config = InversionConfig(cache=str(tmp_path / "cache"))
    assert build(spark, config).count() == 3 and build(spark, config).count() == 3 and len(calls) == 1
    build(spark, dataclasses.replace(config, gamma=2.0))
    assert len(calls) == 1
    build(spark, dataclasses.replace(config, sites=("hw",)))
    build(spark, dataclasses.replace(config, cache_overwrite=("obs",)))
    assert len(calls) == 3
    build(spark, InversionConfig())
    assert len(calls) == 4


def test_sweep(spark, tmp_path):
    base, path = InversionConfig(), str(tmp_path / "sweep")
    configs = sweep.build_grid(base, {"prior_base_std": [0.01, 0.02], "gamma": [None, 2.0]})
    assert len(configs) == 4 and len(sweep.build_grid(base, {"gamma": [None]}, configs[:1])) == 2
    with pytest.raises(ValueError):
        sweep.build_grid(base, {"nothing": [1]})
    with pytest.raises(ValueError):
        sweep.build_grid(base, {})
    assert sweep.run(spark, configs, None, path, jobs=0).count() == 0
    calls = []

    def solve(c):
        calls.append(c)
        if c.gamma:
            raise RuntimeError("singular")
        return {"reduced_chi2": 1 + c.prior_base_std}

    got = sweep.run(spark, configs, solve, path, jobs=2)
    assert got.count() == 4 and results.failed(got).count() == 2 and len(calls) == 4
    assert sweep.run(spark, configs, solve, path).count() == 4 and len(calls) == 4
    assert results.best(got, tol=0.015).count() == 1
    row = sweep.grid_table(spark, configs).orderBy("index").first()
    assert config_id(sweep.from_row(row)) == config_id(configs[0])


def test_result_selectors(spark):
    df = spark.createDataFrame([("a", 0.95, 10.0, 0.01), ("b", 1.5, 12.0, 0.02), ("c", 1.08, 10.5, 0.01)], "config_id string, reduced_chi2 double, m double, cfg_s double")
    assert [r["config_id"] for r in results.ranked(df).collect()] == ["a", "c", "b"]
    assert {r["config_id"] for r in results.best(df).collect()} == {"a", "c"} and results.best(df, tol=0.01).count() == 0
    assert results.sensitivity(df, ["cfg_s"], "m").first()["range"] == pytest.approx(1.75)


def test_readers(spark, tmp_path, monkeypatch):
    gas = tmp_path / "gas.csv"
    gas.write_text("Time Stamp,CH4 (ppm),C2H6 (ppb),R,C2/C1\n01/02/2024 03:04:05.5,2.0,1,0.9,0.1\nbad,1,1,1,1\n")
    got = readers.read_gas_csv(spark, str(gas)).collect()
    assert len(got) == 1 and got[0]["CH4_ppb"] == 2000.0 and got[0]["Time_UTC"] == datetime(2024, 1, 2, 3, 4, 5, 500000)
    folder = tmp_path / "hw" / "x"
    folder.mkdir(parents=True)
    (folder / "a.dat").write_text("Time_UTC,ID,CH4d_ppm_cal\n2024-01-01 00:00:00,-10,2.0\n2024-02-01 00:00:00,-10,2.0\n")
    dat = readers.read_dat_files(spark, str(tmp_path), "2024-01-01", "2024-01-31").collect()
    assert len(dat) == 1 and dat[0]["ID_CH4"] == dat[0]["ID_H2CO"] == -10
    day = tmp_path / "bg.csv"
    day.write_text("obs_time,ct_ch4_ppm\n2024-01-01T05:00:00Z,1.9\n2024-01-02T05:00:00Z,1.8\n")
    assert readers.read_daily_background(spark, str(day)).count() == 2
    geo = tmp_path / "l.json"
    geo.write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{},"geometry":{"type":"LineString","coordinates":[[-111.9,40.7],[-111.8,40.8]]}}]}')
    assert readers.read_geojson_lines(spark, str(geo)).count() == 2
    monkeypatch.delenv("AIRFLUX_DATA", raising=False)
    with pytest.raises(OSError):
        readers.data_dir()


def test_writers(spark, tmp_path):
    out = writers.receptors(stationary(spark, 1, 1))
    assert out.where("site = 'A'").first()["sim_id"] == "202401010000_-111.89_40.76_10.0"
    writers.write_csv(out, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 2


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    stationary(spark).select("Time_UTC", "site", "CH4").write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = hourly_stream(stream).writeStream.outputMode("complete").format("memory").queryName("hourly_out").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select * from hourly_out").count() == 6


def test_gps_merge(spark):
    from airflux.operators import mobile

    rows = [("t", BASE + timedelta(seconds=10 * k), -111.9 + 0.001 * k, 40.7, 1300.0 + k) for k in range(100)]
    gps = spark.createDataFrame(rows, "site string, Time_UTC timestamp_ntz, longitude double, latitude double, altitude double")
    obs = spark.createDataFrame([("t", BASE + timedelta(seconds=s), 2.0) for s in (205, 505, 99999)], "site string, Time_UTC timestamp_ntz, CH4 double")
    got = mobile.merge_with_gps(obs, gps, "UATAQ").orderBy("Time_UTC").collect()
    assert [r["longitude"] for r in got] == pytest.approx([-111.88, -111.85])
    ring = [(-111.885, 40.6), (-111.875, 40.6), (-111.875, 40.8), (-111.885, 40.8)]
    assert mobile.merge_with_gps(obs, gps, "UATAQ", storage=ring, tolerance_us=70_000_000).count() == 2
    assert mobile.merge_with_gps(obs, gps, "UATAQ", storage=ring).count() == 1
    with pytest.raises(ValueError):
        mobile.merge_with_gps(obs, gps, "DAQ")
    metres = mobile.in_metres(gps).orderBy("Time_UTC")
    first, last = metres.first(), metres.tail(1)[0]
    line = [(first["easting"], first["northing"]), (last["easting"], last["northing"])]
    assert mobile.on_routes(mobile.in_metres(gps), {"g": line, "b": line}).count() == 100
    assert mobile.on_routes(mobile.in_metres(gps), {"g": line, "b": line}, dedupe=False).count() == 200
    assert mobile.on_routes(mobile.in_metres(gps), {"g": [(x, y + 99999) for x, y in line]}).count() == 0
    assert mobile.route_points({"g": [(0, 0), (100, 0)], "b": [(0, 0), (0, 100)]}, 50)[0] == (0, 0, "bg")


def test_whole_inversion(spark):
    from airflux.plans.inversion import Inputs, run

    h, s0, z, jac, prior, obs, cells = toy(spark)
    frame = lambda v: spark.createDataFrame([(*o, float(x)) for o, x in zip(obs, v)], "obs_location string, obs_time timestamp_ntz, value double")
    cov = lambda o: inversion.mdm_entries(o, 0.2, correlated=False)
    out = run(Inputs(frame(z), prior, jac, frame(np.full(8, 0.5)), cov), InversionConfig())
    assert out.posterior.count() == 6 and 0 < out.metrics["DOFS"] < 6 and set(out.seconds) == {"gather", "solve"}
    part = run(Inputs(frame(z), prior, jac, frame(np.full(8, 0.5)), cov), InversionConfig(jacobian_coverage_percentile=40))
    assert part.posterior.count() < 6 and part.full_posterior.count() == 6 and "coverage" in part.seconds


def test_report_tables(spark):
    from airflux.operators import report

    same = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 3.0)], "t int, v double")
    assert report.same_everywhere(same, "t", "v") and not report.same_everywhere(same.union(spark.createDataFrame([(2, 4.0)], same.schema)), "t", "v")
    assert report.by_type(registry.sites(spark)).count() == 10
    obs = spark.createDataFrame([(1, "a", 2.0), (1, "b", 3.0)], "obs_time int, obs_location string, CH4 double")
    assert report.by_location(obs, ["a", "b"]).first()["b"] == 3.0
    with pytest.raises(Exception, match="two values"):
        report.by_location(obs.union(obs), ["a", "b"]).collect()
    marks = report.markers(spark.createDataFrame([("lpg",), ("cng",)], "category string"), {"cng": "o"})
    assert {r["category"]: r["marker"] for r in marks.collect()} == {"lpg": None, "cng": "o"}
    d = spark.range(1).select(report.density(F.lit(500.0), F.lit(1e6)).alias("a"), report.density(F.lit(50.0), F.lit(1e6)).alias("b")).first()
    assert d["a"] == 0.5 and d["b"] is None
