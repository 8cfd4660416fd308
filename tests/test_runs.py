"""Runs of any size, their figures, merged inventories and backgrounds, against plain computations."""

import dataclasses
import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from airflux.functions import timeutil
from airflux.operators import curvefit, inversion, report
from airflux.plans import assembly
from airflux.plans import inversion as plan
from airflux.plans import observations
from airflux.plans.config import InversionConfig
from airflux.scratch import written
from tests.test_plans import inversion_tables

T = datetime(2024, 1, 1)
FIELD = "time timestamp_ntz, lon double, lat double, sector string, value double"
CONFIG = InversionConfig(
    tstart="2024-01-01", tend="2024-03-01", xmin=-112.15, xmax=-111.95, ymin=40.45, ymax=40.65, dx=0.1, dy=0.1, location_site_map={"loc": "wbb"},
    min_obs_per_interval=5, min_sims_per_interval=5, background_kwargs={"window": "10d", "min_periods": 5}, prior_kwargs={"value": 0.02},
    bias_std=0.05, bias_grouping="site_group", aggregate_obs="1D", jacobian_coverage_percentile=30,
)


def values(df, *keys):
    return {tuple(r[k] for k in keys): r["value"] for r in df.collect()}


def test_iterative_run_equals_the_dense_one(spark):
    inputs = assembly.assembled(spark, inversion_tables(spark), CONFIG, written)
    dense = plan.run(inputs, CONFIG)
    assert "gather" in dense.seconds and not plan.is_large(inputs.obs, inputs.prior, inputs.bias)
    large = plan.run(inputs, CONFIG, large=True, probes=6)
    a, b = values(dense.posterior, *inversion.STATE), values(large.posterior, *inversion.STATE)
    assert a.keys() == b.keys() and len(a) < 8 and all(abs(a[k] - b[k]) < 1e-6 for k in a)
    a, b = values(dense.bias, "time", "grp"), values(large.bias, "time", "grp")
    assert a.keys() == b.keys() and a and all(abs(a[k] - b[k]) < 1e-6 for k in a)
    assert large.full_posterior.count() == 8
    for name in ("reduced_chi2", "RMSE"):
        assert large.metrics[name] == pytest.approx(dense.metrics[name], rel=1e-6)
    assert abs(large.metrics["DOFS"] - dense.metrics["DOFS"]) < 5 * large.metrics["DOFS_error"] + 1e-6
    # The figures of the run, by hand.
    got = plan.collect_metrics(dense, CONFIG)
    z, h = values(dense.enhancement, *inversion.OBS), dense.jacobian.collect()
    prior, post = values(inputs.prior, *inversion.STATE), values(dense.posterior, *inversion.STATE)

    def rmse(states):
        fit = dict.fromkeys(z, 0.0)
        for r in h:
            fit[r["obs_location"], r["obs_time"]] += r["value"] * states.get((r["time"], r["lon"], r["lat"]), 0.0)
        return math.sqrt(np.mean([(z[k] - fit[k]) ** 2 for k in z]))

    assert got["prior_conc_rmse"] == pytest.approx(rmse({k: prior[k] for k in post})) and got["posterior_conc_rmse"] == pytest.approx(rmse(post))
    assert got["n_obs"] == len(z) and got["n_state"] == len(post) and got["chi2_distance"] == abs(got["reduced_chi2"] - 1)
    assert got["flux_change_pct"] == pytest.approx(100 * (got["posterior_flux_mean"] / got["prior_flux_mean"] - 1))
    # A block that fails leaves nulls, and the other its figures.
    broken = plan.collect_metrics(dataclasses.replace(dense, jacobian=None), CONFIG)
    assert broken["n_obs"] is None and broken["prior_conc_rmse"] is None and broken["prior_flux_mean"] == got["prior_flux_mean"]
    broken = plan.collect_metrics(dataclasses.replace(dense, full_posterior=None), CONFIG)
    assert broken["flux_change_pct"] is None and broken["n_obs"] == got["n_obs"]


def test_linear_products_of_the_assembly(spark):
    config = dataclasses.replace(CONFIG, aggregate_obs=False, tend="2024-01-08", jacobian_coverage_percentile=None, gamma=2.0, min_obs_per_interval=1)
    inputs = assembly.assembled(spark, inversion_tables(spark), config, written)
    z = inputs.obs.withColumn("value", F.sin(F.hour("obs_time").cast("double")))
    cov, x = inputs.obs_cov(z).collect(), values(z, *inversion.OBS)
    want = dict.fromkeys(x, 0.0)
    for r in cov:
        want[r["obs_location"], r["time_i"]] += r["value"] * x[r["obs_location"], r["time_j"]]
    got = values(inputs.obs_product(z.withColumn("probe", F.lit(0))), *inversion.OBS)
    assert got.keys() == want.keys() and len(got) > 10 and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    diag = {(r["obs_location"], r["time_i"]): r["value"] for r in cov if r["time_i"] == r["time_j"]}
    assert all(abs(v - diag[k]) < 1e-12 for k, v in values(inputs.obs_variance(z), *inversion.OBS).items())


def test_flux_metrics(spark):
    table = lambda rows: spark.createDataFrame(rows, "k string, time int, total double")
    prior = table([("a", 1, 2.0), ("a", 2, 4.0), ("zero", 1, 0.0), ("prior", 1, 1.0), (None, 1, 1.0)])
    post = table([("a", 1, 3.0), ("a", 2, 6.0), ("zero", 1, 5.0), ("post", 1, 1.0), (None, 1, 2.0)])
    got = {r["k"]: tuple(r)[1:] for r in inversion.flux_metrics(prior, post, ["k"]).collect()}
    assert got["a"] == (3.0, 4.5, pytest.approx(math.sqrt(4.5)), 50.0) and got["zero"] == (0.0, 5.0, None, None)
    assert got["prior"] == (1.0, None, None, None) and got["post"] == (None, 1.0, None, None) and got[None][3] == 100.0
    assert tuple(inversion.flux_metrics(prior.limit(0), post.limit(0)).first()) == (None,) * 4


def test_merged_inventory(spark):
    at = lambda *d: datetime(*d)
    annual = [(at(2019, 1, 1), 0.0, 0.0, s, v) for s, v in (("only", 1.0), ("both", 50.0))] + [(at(2020, 1, 1), 0.0, 0.0, "only", 2.0), (at(2020, 1, 1), 1.0, 0.0, "only", 3.0)]
    annual += [(at(2021, 1, 1), 1.0, 0.0, "only", 4.0), (None, 0.0, 0.0, "only", 9.0), (at(2019, 1, 1), 0.0, 0.0, None, 9.0)]
    months = [at(2018, 6, 1), at(2019, 6, 1), at(2020, 1, 1), at(2021, 5, 1)]
    monthly = [(t, 0.0, 0.0, "both", 10.0 * k) for k, t in enumerate(months)]
    a, m = (spark.createDataFrame(rows, FIELD) for rows in (annual, monthly))
    got = sorted(map(tuple, inversion.merged_inventory(a, m.withColumn("extra", F.lit(1))).collect()))
    want = [*monthly, (months[1], 0.0, 0.0, "only", 1.0), (months[2], 0.0, 0.0, "only", 2.0), (months[2], 1.0, 0.0, "only", 3.0), (months[3], 1.0, 0.0, "only", 4.0)]
    assert got == sorted(want)
    assert inversion.merged_inventory(a, m.limit(0)).count() == 0 and inversion.merged_inventory(a.limit(0), m).count() == 4
    # By the configuration: merged, and alone where express.
    cell = lambda rows: spark.createDataFrame([(t, -112.1 + 0.1 * i, 40.5, s, v) for t, s, v in rows for i in range(2)], FIELD)
    tables = dataclasses.replace(
        inversion_tables(spark), inventory=cell([(at(2023, 1, 1), "b", 7.0), (at(2024, 1, 1), "a", 1.0), (at(2024, 1, 1), "b", 5.0)]),
        monthly=cell([(at(2024, m, 1), "a", 10.0 * m) for m in (1, 2)]),
    )
    config = dataclasses.replace(CONFIG, prior="inventory", prior_kwargs={})
    by_month = lambda c: {r["time"].month: round(r["v"], 9) for r in assembly.prior_of(spark, tables, c).groupBy("time").agg(F.avg("value").alias("v")).collect()}
    assert by_month(config) == {1: 15.0, 2: 25.0}
    assert by_month(dataclasses.replace(config, prior_kwargs={"express": True})) == {1: 6.0, 2: 6.0}


def test_rolling_background_by_site(spark):
    rng = np.random.default_rng(4)
    rows = [(s, T + timedelta(hours=int(h)), float(rng.normal(2, 0.1))) for s, n in (("a", 60), ("b", 40), ("c", 5)) for h in rng.choice(200, n, replace=False)]
    rows += [("a", rows[0][1], 3.0), (None, T, 1.0), ("a", None, 1.0)]
    df = spark.createDataFrame(rows, "site string, obs_time timestamp_ntz, CH4 double")
    got = {r["obs_time"]: r["background"] for r in observations.background("rolling", df, hours=df, window="1d", min_periods=4).collect()}
    wide = pd.DataFrame(rows, columns=["site", "t", "v"]).dropna().pivot_table(index="t", columns="site", values="v").sort_index()
    want = wide.rolling("1d", min_periods=4).quantile(0.01).mean(axis=1)
    assert set(got) == set(want.index.to_pydatetime()) and sum(v is not None for v in got.values()) == want.notna().sum() > 20
    assert all((got[t] is None and math.isnan(v)) or abs(got[t] - v) < 1e-9 for t, v in want.items())
    assert observations.background("rolling", df, hours=df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        observations.background("rolling", df)
    with pytest.raises(ValueError):
        observations.background("other", df, hours=df)


def test_background_sees_all_hours(spark):
    """Low values at night belong to the background of the afternoon's observations."""
    tables = inversion_tables(spark)
    night = tables.readings.withColumn("Time_UTC", F.expr("Time_UTC - interval 12 hours")).withColumn("CH4", F.lit(1.8))
    both = dataclasses.replace(tables, readings=tables.readings.unionByName(night))
    config = dataclasses.replace(CONFIG, aggregate_obs=False, bias_std=None)
    low = assembly.assembled(spark, both, config, written)
    assert low.constant.agg(F.max("value")).first()[0] < 1.9 and {r["obs_time"].hour for r in low.obs.collect()} <= set(range(19, 24))


def test_fitted_background(spark):
    days = [T + timedelta(days=7 * k) for k in range(160)]
    y = [1900 + 0.01 * k + 10 * math.sin(k / 8) + 3 * math.cos(k / 2.5) for k in range(160)]
    samples = spark.createDataFrame([*zip(days, y), (None, 1.0), (T, None)], "obs_time timestamp_ntz, value double")
    at = [T + timedelta(hours=37 * k) for k in range(500)]
    obs = spark.createDataFrame([(t,) for t in [*at, at[0]]], "obs_time timestamp_ntz").repartition(3)
    got = {r["obs_time"]: r["background"] for r in observations.background("gml", obs, samples=samples).collect()}
    year = lambda t: t.year + (t - datetime(t.year, 1, 1)) / (datetime(t.year + 1, 1, 1) - datetime(t.year, 1, 1))
    want = curvefit.smooth_curve(np.array([year(t) for t in days]), np.array(y), np.array([year(t) for t in at])) / 1000
    assert len(got) == 500 and all(abs(got[t] - w) < 1e-9 for t, w in zip(at, want))
    assert obs.select(timeutil.exact_year(F.lit(datetime(2024, 7, 2)).cast("timestamp_ntz")).alias("y")).first()["y"] == 2024.5
    assert {r[1] for r in observations.background("gml", obs, samples=samples.limit(0)).collect()} == {None}
    assert observations.background("gml", obs, samples=samples, site="other", sample_type="flask").count() == 500
    with pytest.raises(ValueError, match="no samples"):
        observations.background("gml", obs, samples=samples, site="other")
    config = dataclasses.replace(CONFIG, background="gml", background_kwargs={"site": "uta"}, bias_std=None, tend="2024-02-01")
    made = assembly.assembled(spark, dataclasses.replace(inversion_tables(spark), samples=samples), config, written)
    assert made.obs.count() > 5 and made.constant.where("value is null").count() == 0


def test_aligned_and_filled(spark):
    part = lambda rows: spark.createDataFrame(rows, "k string, value double")
    parts = {"one": part([("a", 1.0), ("b", 2.0), (None, 3.0)]), "two": part([("b", 5.0), ("c", None), (None, 4.0)]), "none": part([])}
    got = {r["k"]: tuple(r)[1:] for r in report.aligned(parts, ["k"]).collect()}
    assert got == {"a": (1.0, None, None), "b": (2.0, 5.0, None), "c": (None, None, None), None: (3.0, 4.0, None)}
    with pytest.raises(Exception, match="twice in one"):
        report.aligned({"one": part([("a", 1.0), ("a", 1.0)]), "two": part([])}, ["k"]).collect()
    states = spark.createDataFrame([("a",), ("z",), ("z",)], "k string")
    assert {tuple(r) for r in inversion.filled(parts["one"], states, ["k"]).collect()} == {("a", 1.0), ("z", 0.0)}
