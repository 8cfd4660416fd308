"""Few states: the operator is read once, whatever the number of observations, and the result is that of the steps."""

from datetime import datetime

import numpy as np
import pytest

from airflux import queries
from airflux.operators import covariance, inversion, solvers
from airflux.scratch import written

SF = "/root/testdata/sf0.001"
T = datetime(2024, 1, 1)
OBSERVED = "obs_location string, obs_time timestamp_ntz, value double"


def problem(spark):
    rng = np.random.default_rng(11)
    states = [(datetime(2024, 1 + k % 2, 1), -112.0 + 0.2 * (k // 2), 40.0, float(rng.normal()), float(rng.uniform(0.2, 1))) for k in range(8)]
    h = rng.normal(size=(30, 8)) * (rng.random((30, 8)) < 0.4)
    h[3] = 0  # an observation that no state reaches
    jac = [(str(i), T, *states[j][:3], float(h[i, j])) for i in range(30) for j in range(8) if h[i, j]]
    jac += [("elsewhere", T, *states[0][:3], 7.0), ("1", T, T, 0.0, 0.0, 9.0), ("2", T, *states[1][:3], 0.5)]  # no observation; no state; an entry twice
    jac = spark.createDataFrame(jac, "obs_location string, obs_time timestamp_ntz, time timestamp_ntz, lon double, lat double, value double")
    obs = spark.createDataFrame([(str(i), T, float(rng.normal())) for i in range(31)], OBSERVED)  # the last has no variance
    var = spark.createDataFrame([(str(i), T, float(rng.uniform(0.1, 2))) for i in range(30)], OBSERVED)
    prior = written(spark.createDataFrame(states, "time timestamp_ntz, lon double, lat double, value double, sigma double"), "prior")
    return written(jac, "h"), obs, prior, var


@pytest.mark.parametrize("correlated", [False, True])
def test_equals_the_steps(spark, correlated):
    jac, obs, prior, var = problem(spark)
    product = None
    if correlated:
        times, cells = written(inversion.kernel_table(prior, "time", 40 * 86400e6), "t"), written(covariance.spatial_kernel(prior, 12.0), "c")
        product = lambda x: covariance.kronecker_product(x, prior, times, cells, ["probe"])
    steps, once = (solvers.solve(jac, obs, prior, var, written, prior_product=product, probes=3, tol=1e-11, by_states=k) for k in (False, True))
    want, got = ({(r["time"], r["lon"], r["lat"]): r["value"] for r in x.posterior.collect()} for x in (steps, once))
    assert want.keys() == got.keys() and all(abs(want[k] - got[k]) < 1e-8 for k in want)
    assert once.figures == pytest.approx(steps.figures, rel=1e-7) and once.figures["n_obs"] == 30


def test_bounds(spark, monkeypatch):
    jac, obs, prior, var = problem(spark)
    with pytest.raises(ValueError):
        solvers.solve(jac, obs, prior, var.selectExpr("obs_location", "obs_time", "0.0D as value"), written, by_states=True)
    monkeypatch.setattr(solvers, "MOST_STATES", 7)
    with pytest.raises(ValueError):
        solvers.solve(jac, obs, prior, var, written, by_states=True)


@pytest.mark.parametrize("name", ["kronecker_posterior", "posterior_information", "cg_posterior"])
def test_queries_take_no_steps(spark, monkeypatch, name):
    def steps(*_, **__):
        raise AssertionError("steps over all observations")

    monkeypatch.setattr(solvers, "conjugate_gradients", steps)
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_yearly_problem_is_written_and_whole(spark):
    h, z, _ = queries._yearly_problem(spark, SF)
    assert all(df.inputFiles() and "Join" not in df._jdf.queryExecution().executedPlan().toString() for df in (h, z))  # read, not worked out again
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").toPandas()
    rows["year"], rows["cell"] = rows["l_shipdate"].astype("datetime64[ns]").dt.year, rows["l_partkey"] % 90
    want = rows.groupby(["l_orderkey", "year", "cell"])["l_quantity"].sum() / 100
    place = lambda k: (round(-112.2 + k % 10 * 0.05, 6), round(40.45 + k // 10 * 0.05, 6))
    want = {(f"p{o}", y, *place(k)): float(v) for (o, y, k), v in want.items()}
    got = {(r["obs_location"], r["time"].year, r["lon"], r["lat"]): r["value"] for r in h.collect()}
    assert got == pytest.approx(want)
    orders = spark.read.parquet(f"{SF}/orders.parquet").toPandas()
    orders = orders[orders["o_orderkey"].isin(rows["l_orderkey"])]
    assert dict(z.select("obs_location", "value").collect()) == pytest.approx({f"p{k}": float(v) / 1e5 for k, v in zip(orders["o_orderkey"], orders["o_totalprice"])})
