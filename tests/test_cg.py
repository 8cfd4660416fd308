"""Conjugate gradients end at the tolerance or with an error, never at a step bound in silence."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from airflux import queries
from airflux.operators import solvers

SF = "/root/testdata/sf0.001"


def test_step_bound_raises(spark, tmp_path):
    def written(df, name):
        path = str(tmp_path / f"{name}{len(list(tmp_path.iterdir()))}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    t, rng = datetime(2024, 1, 1), np.random.default_rng(3)
    h = rng.normal(size=(6, 6))
    jac = spark.createDataFrame(
        [(str(i), t, t, float(j), 0.0, float(h[i, j])) for i in range(6) for j in range(6)],
        "obs_location string, obs_time timestamp_ntz, time timestamp_ntz, lon double, lat double, value double",
    )
    obs = spark.createDataFrame([(str(i), t, float(i)) for i in range(6)], "obs_location string, obs_time timestamp_ntz, value double")
    prior = spark.createDataFrame([(t, float(j), 0.0, 1.0, 1.0) for j in range(6)], "time timestamp_ntz, lon double, lat double, value double, sigma double")
    with pytest.raises(ArithmeticError):
        solvers.solve_cg(jac, obs, prior, obs.withColumn("value", F.lit(0.01)), written, steps=1)


def test_whole_operator_against_normal_equations(spark):
    got = dict(map(tuple, queries.QUERIES["cg_posterior"](spark, SF).collect()))
    coo = queries.coo(spark, SF).toPandas()
    price = {r[0]: r[1] / 1000 for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_totalprice").collect()}
    orders, cells = sorted(price), sorted(got)
    h = np.zeros((len(orders), len(cells)))
    row, col = ({k: i for i, k in enumerate(x)} for x in (orders, cells))
    for o, c, v in coo.itertuples(index=False):
        if o in row:
            h[row[o], col[c]] = v
    z = np.array([price[o] for o in orders])
    want = 1 + np.linalg.solve(h.T @ h / 1e5 + np.eye(len(cells)) / 0.25, h.T @ (z - h.sum(axis=1)) / 1e5)
    np.testing.assert_allclose([got[c] for c in cells], want, atol=2e-6)
