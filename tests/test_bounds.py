"""Nothing beyond a bound is dropped in silence: it is either used or an error."""

import pytest

from airflux.operators import curvefit, inversion


def test_constant_prior_has_every_bin(spark):
    bins = spark.range(100_001).selectExpr("cast(timestamp_seconds(id * 60) as timestamp_ntz) as bin_start")
    grid = spark.range(1).selectExpr("0.0D as lon", "0.0D as lat")
    assert inversion.constant_prior(grid, bins, 1.0).count() == 100_001


def test_bounds_raise(spark):
    times = spark.range(100_001).selectExpr("cast(timestamp_seconds(id * 60) as timestamp_ntz) as time")
    field = times.limit(1).selectExpr("time", "1 as cell", "2.0D as value")
    with pytest.raises(ValueError, match="times"):
        inversion.nearest_time(field, times, ["cell"])
    samples = spark.range(200_001).selectExpr("2000 + id / 10000 as year", "1900.0D as value")
    with pytest.raises(ValueError, match="samples"):
        curvefit.fitted_background(samples, samples, "uta")
