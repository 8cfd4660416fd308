"""Structured covariances and the matrix-free solver against dense algebra."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from airflux import queries
from airflux.operators import covariance, inversion, solvers
from airflux.scratch import written

SF = "/root/testdata/sf0.001"
STATES = "time timestamp_ntz, lon double, lat double, value double, sigma double"
OBSERVED = "obs_location string, obs_time timestamp_ntz, value double"


def km(a, b):
    lon, lat = np.radians(np.array([a[0], b[0]])), np.radians(np.array([a[1], b[1]]))
    h = np.sin((lat[1] - lat[0]) / 2) ** 2 + np.cos(lat[0]) * np.cos(lat[1]) * np.sin((lon[1] - lon[0]) / 2) ** 2
    return 2 * 6371.0088 * np.arcsin(np.sqrt(min(h, 1)))


def dense_prior(states, tau_us, scale):
    t = np.array([s[0].timestamp() * 1e6 for s in states])
    sig = np.array([s[4] for s in states])
    d = np.array([[km(a[1:3], b[1:3]) for b in states] for a in states])
    return np.outer(sig, sig) * np.exp(-np.abs(t[:, None] - t) / tau_us) * np.exp(-d / scale)


def states_of(rng, times, cells):
    return [(datetime(2024, 1 + t, 1), -112.0 + 0.4 * (c % 4), 40.0 + 0.3 * (c // 4), float(rng.normal()), float(rng.uniform(0.1, 1))) for t in range(times) for c in range(cells)]


@pytest.mark.parametrize("reach", [None, 40.0])
def test_kronecker_product(spark, reach):
    rng = np.random.default_rng(0)
    states = states_of(rng, 3, 11)
    x = rng.normal(size=(2, len(states)))
    x[:, ::5] = 0
    c = dense_prior(states, 40 * 86400e6, 12.0)
    if reach:
        c *= np.array([[km(a[1:3], b[1:3]) <= reach for b in states] for a in states])
    prior = spark.createDataFrame(states, STATES)
    vectors = spark.createDataFrame([(p, *s[:3], float(x[p, k])) for p in range(2) for k, s in enumerate(states) if x[p, k]], "probe int, time timestamp_ntz, lon double, lat double, value double")
    got = covariance.kronecker_product(vectors, prior, inversion.kernel_table(prior, "time", 40 * 86400e6), covariance.spatial_kernel(prior, 12.0, reach), ["probe"])
    got = {(r["probe"], r["time"], r["lon"], r["lat"]): r["value"] for r in got.collect()}
    want = x @ c
    assert len(got) == 2 * len(states)
    assert all(abs(got[(p, *s[:3])] - want[p, k]) < 1e-9 for p in range(2) for k, s in enumerate(states))


def readings(rng, n=80):
    times = sorted({datetime(2024, 1, 1) + timedelta(hours=int(h)) for h in rng.integers(0, 24 * 20, n)})
    return [(place, t) for place in ("wbb", "hw") for t in times[:: 1 if place == "wbb" else 2]]


COMPONENTS = [
    {"std": 0.3, "correlated": False}, {"std": {"UATAQ": 0.2, "DAQ": 0.5}, "correlated": False}, {"std": 0.4, "scale": None, "interday": False},
    {"std": 0.1, "scale": None, "interday": True}, {"std": 0.25, "scale": "2.8h", "interday": False}, {"std": 0.15, "scale": "7d", "interday": True},
]
ORGS = {"wbb": "UATAQ", "hw": "DAQ"}


def dense_mismatch(rows, components=COMPONENTS):
    out = np.zeros((len(rows), len(rows)))
    for c in components:
        for i, (p, t) in enumerate(rows):
            for j, (q, u) in enumerate(rows):
                s = [c["std"] if isinstance(c["std"], float) else c["std"][ORGS[k]] for k in (p, q)]
                same = (p, t) == (q, u) if not c.get("correlated", True) else p == q and (c["interday"] or t.date() == u.date())
                scale = {None: np.inf, "2.8h": 2.8, "7d": 168.0}[c.get("scale")]
                out[i, j] += same * s[0] * s[1] * np.exp(-abs((t - u).total_seconds()) / 3600 / scale)
    return out


def test_mismatch_product_and_row_sums(spark):
    rng = np.random.default_rng(1)
    rows = readings(rng)
    s, x = dense_mismatch(rows), rng.normal(size=(2, len(rows)))
    df = spark.createDataFrame([(p, *r, float(x[p, k])) for p in range(2) for k, r in enumerate(rows)] + [(0, "wbb", None, 1.0), (1, "hw", rows[0][1], None)], f"probe int, {OBSERVED}")
    got = {(r["probe"], r["obs_location"], r["obs_time"]): r["value"] for r in covariance.mismatch_product(df.dropna(), COMPONENTS, ORGS, ["probe"]).collect()}
    assert all(abs(got[(p, *r)] - (s @ x[p])[k]) < 1e-9 for p in range(2) for k, r in enumerate(rows))
    obs = spark.createDataFrame(rows + rows[:3], "obs_location string, obs_time timestamp_ntz")
    sums = {(r["obs_location"], r["obs_time"]): (r["value"], r["n"]) for r in covariance.mismatch_row_sums(obs, COMPONENTS, ORGS).collect()}
    assert all(abs(sums[r][0] - s[k].sum()) < 1e-9 and sums[r][1] == (s[k] > 0).sum() for k, r in enumerate(rows))
    assert all(abs(r["value"] - s[k, k]) < 1e-12 for r in covariance.mismatch_variance(obs, COMPONENTS, ORGS).collect() for k in [rows.index((r["obs_location"], r["obs_time"]))])
    few = covariance.mismatch_row_sums(obs, COMPONENTS[:1], ORGS)
    assert few.where("n = 1").count() == len(rows) and covariance.mismatch_row_sums(obs.limit(0), COMPONENTS, ORGS).count() == 0


@pytest.mark.parametrize("unit, start", [("DAY", lambda t: t.replace(hour=0)), ("MONTH", lambda t: t.replace(day=1, hour=0)), ("HOUR", lambda t: t)])
def test_aggregated_mismatch(spark, unit, start):
    rows = readings(np.random.default_rng(2), 40)
    s = dense_mismatch(rows)
    bins = sorted({(p, start(t)) for p, t in rows})
    w = np.array([[(p, start(t)) == b for p, t in rows] for b in bins], float)
    w /= w.sum(axis=1, keepdims=True)
    want = w @ s @ w.T
    got = covariance.aggregated_mismatch(spark.createDataFrame(rows, "obs_location string, obs_time timestamp_ntz"), COMPONENTS, unit, ORGS)
    got = {(r["obs_location"], r["time_i"], r["time_j"]): r["value"] for r in got.collect()}
    for i, (p, a) in enumerate(bins):
        for j, (q, b) in enumerate(bins):
            assert abs(got.get((p, a, b), 0.0) * (p == q) - want[i, j]) < 1e-12


def test_solution_against_dense(spark):
    """Correlated prior and correlated mismatch: posterior and chi-square equal the dense ones, estimates within their errors."""
    rng = np.random.default_rng(4)
    states, rows, parts = states_of(rng, 2, 6), readings(rng, 12), [COMPONENTS[0], COMPONENTS[5]]
    h = rng.normal(size=(len(rows), len(states))) * (rng.random((len(rows), len(states))) < 0.3)
    z = rng.normal(size=len(rows))
    c, s = dense_prior(states, 40 * 86400e6, 12.0), dense_mismatch(rows, parts)
    dense = inversion.solve_dense(h, z, np.array([x[3] for x in states]), c, s)
    jac = written(spark.createDataFrame(
        [(*r, *x[:3], float(h[i, j])) for i, r in enumerate(rows) for j, x in enumerate(states) if h[i, j]] + [(*rows[0], datetime(1999, 1, 1), 0.0, 0.0, 5.0)],
        "obs_location string, obs_time timestamp_ntz, time timestamp_ntz, lon double, lat double, value double"), "h")
    obs = spark.createDataFrame([(*r, float(v)) for r, v in zip(rows, z)], OBSERVED)
    prior = written(spark.createDataFrame(states, STATES), "prior")
    times, cells = written(inversion.kernel_table(prior, "time", 40 * 86400e6), "t"), written(covariance.spatial_kernel(prior, 12.0), "c")
    out = solvers.solve(
        jac, obs, prior, covariance.mismatch_variance(obs, parts, ORGS), written, tol=1e-9,
        prior_product=lambda x: covariance.kronecker_product(x, prior, times, cells, ["probe"]),
        obs_product=lambda x: covariance.mismatch_product(x, parts, ORGS, ["probe"]), probes=8, variances=True)
    got = {(r["time"], r["lon"], r["lat"]): r for r in out.posterior.collect()}
    np.testing.assert_allclose([got[x[:3]]["value"] for x in states], dense["posterior"], atol=1e-6)
    assert out.figures["reduced_chi2"] == pytest.approx(dense["reduced_chi2"], rel=1e-6) and out.figures["n_obs"] == len(rows)
    assert abs(out.figures["DOFS"] - dense["DOFS"]) < 4 * out.figures["DOFS_error"] + 1e-9
    off = [(got[x[:3]]["variance"] - dense["posterior_cov"][k, k]) / got[x[:3]]["variance_error"] for k, x in enumerate(states)]
    assert np.mean(np.square(off)) < 4
    none = solvers.solve(jac.limit(0), obs, prior, covariance.mismatch_variance(obs, parts, ORGS), written)
    assert none.posterior.count() == len(states) and {r["value"] for r in none.posterior.collect()} == {x[3] for x in states}


def test_whole_lineitem_with_correlated_prior(spark):
    got = {(r["time"], r["lon"], r["lat"]): r["value"] for r in queries.QUERIES["kronecker_posterior"](spark, SF).collect()}
    h, z, prior = (x.toPandas() for x in queries._yearly_problem(spark, SF))
    states = [(t.to_pydatetime(), a, b, v, s) for t, a, b, v, s in prior.itertuples(index=False)]
    at = {x[:3]: k for k, x in enumerate(states)}
    row = {p: k for k, p in enumerate(z["obs_location"])}
    m = np.zeros((len(row), len(states)))
    for p, t, a, b, v in h[["obs_location", "time", "lon", "lat", "value"]].itertuples(index=False):
        m[row[p], at[(t.to_pydatetime(), a, b)]] = v
    c = dense_prior(states, 730 * 86400e6, 10.0)
    dense = inversion.solve_dense(m, z["value"].to_numpy(), np.ones(len(states)), c, np.eye(len(row)) * 25)
    assert len(got) == len(states)
    np.testing.assert_allclose([got[x[:3]] for x in states], dense["posterior"], atol=2e-6)
    info = queries.QUERIES["posterior_information"](spark, SF).collect()[0]
    assert info["reduced_chi2"] == pytest.approx(dense["reduced_chi2"], rel=1e-5) and abs(info["dofs"] - dense["DOFS"]) < 4 * info["dofs_error"]
