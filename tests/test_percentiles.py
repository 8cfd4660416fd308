"""Exact percentiles of a whole column: equal to the aggregate, without all its values in one task."""

import pytest
from pyspark.sql import functions as F

from airflux.operators import qa

SHARES = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
ROWS = "select if(id % 3 = 0, null, id % 3) as k, if(id % 7 = 0, null, cast(pmod(id * 7919, 4001) as double) / 7) as v from range(9000)"


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("accuracy", [10_000, 40])
def test_equal_to_the_aggregate(spark, monkeypatch, keys, accuracy):
    monkeypatch.setattr(qa, "SKETCH", accuracy)
    rows = spark.sql(ROWS).union(spark.sql("select 9, cast(null as double)")).union(spark.sql("select 8, 5.0D from range(50)"))
    want = {tuple(r)[:-1]: r["q"] for r in rows.groupBy(*keys).agg(F.percentile("v", F.array(*map(F.lit, SHARES))).alias("q")).collect()}
    got = {tuple(r)[:-1]: r["q"] for r in qa.exact_percentiles(rows, "v", SHARES, keys).collect()}
    assert got == want
    assert qa.outliers_trimmed(rows.limit(0), "v").count() == 0


def test_trimming_holds_no_values_of_all_rows(spark, monkeypatch):
    def percentile(*_):
        raise AssertionError("all values in one task")

    monkeypatch.setattr(F, "percentile", percentile)
    rows = spark.range(1, 20_001).selectExpr("cast(id as double) as v")
    assert qa.outliers_trimmed(rows, "v").count() == 19_600


def test_wrong_brackets_are_seen(spark, monkeypatch):
    """A sketch that brackets no rank: the counts tell, and the aggregate over all values is taken."""
    rows = spark.range(101).selectExpr("1 as k", "cast(id as double) as v")
    sketch = lambda c, q, a: F.first(F.array(*(F.lit(-5.0) for _ in range(4))))
    monkeypatch.setattr(F, "percentile_approx", sketch)
    assert qa.exact_percentiles(rows, "v", [0.0, 0.5], ["k"]).collect()[0]["q"] == [0.0, 50.0]
