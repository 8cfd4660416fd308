"""Sliding windows and islands against plain loops."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from airflux.operators import windows

KIND = "k string, t timestamp_ntz, a double, b double, id int, us string"


def some(n, seed):
    rng = np.random.default_rng(seed)
    hours = np.sort(rng.integers(0, 24 * 30, n)) / 2
    pick = lambda: None if rng.random() < 0.1 else float(rng.choice([1.0, 1.0, 2.5, 1e6, float(rng.normal())]))
    rows = [(["x", "y", None][int(rng.integers(0, 3))], datetime(2024, 1, 1) + timedelta(hours=float(h)), pick(), pick(), k, "") for k, h in enumerate(hours)]
    return rows + [("x", None, 1.0, 1.0, n, ""), ("z", datetime(2024, 1, 1), None, None, n + 1, "")]


def window(rows, row, before, after):
    return [r for r in rows if r[0] == row[0] and r[1] is not None and -before < (r[1] - row[1]).total_seconds() / 3600 <= after]


@pytest.mark.parametrize("hours, least, q", [(6, 3, 0.01), (100, 1, 0.5), (400, 5, 1.0), (1, 0, 0.3)])
def test_percentile(spark, hours, least, q):
    rows = some(300, hours)
    got = {r["id"]: r for r in windows.rolling_baseline(spark.createDataFrame(rows, KIND), ["k"], "t", "a", f"{hours}h", q, least).collect()}
    assert set(got) == {r[4] for r in rows if r[1]}
    for r in rows[:-2] + rows[-1:]:
        v = [x[2] for x in window(rows, r, hours, 0) if x[2] is not None]
        want = float(np.percentile(v, 100 * q)) if v and len(v) >= least else None
        assert got[r[4]]["baseline"] == (want if want is None else pytest.approx(want, rel=1e-12)) and got[r[4]]["us"] == ""


def test_moments(spark):
    rows = some(300, 1)
    df = spark.createDataFrame(rows, KIND)
    mean = {r["id"]: r["smooth"] for r in windows.centered_mean(df, ["k"], "t", "a", "2d").collect()}
    corr = {r["id"]: r["r"] for r in windows.rolling_corr(df, ["k"], "t", "a", "b", "30h").collect()}
    for r in rows[:-2] + rows[-1:]:
        v = [x[2] for x in window(rows, r, 24, 24) if x[2] is not None]
        assert mean[r[4]] == (pytest.approx(np.mean(v), rel=1e-9) if v else None)
        both = [(x[2], x[3]) for x in window(rows, r, 30, 0) if x[2] is not None and x[3] is not None]
        a, b = np.array([x[0] for x in both]), np.array([x[1] for x in both])
        if len(both) < 2 or a.min() == a.max() or b.min() == b.max():
            assert corr[r[4]] is None
        else:
            assert corr[r[4]] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-6)
    assert windows.rolling_corr(df.limit(0), ["k"], "t", "a", "b").count() == 0


@pytest.mark.parametrize("stretch, by, keyed", [("30d", 64, True), ("1h", 2, True), ("5h", 3, False)])
def test_islands(spark, monkeypatch, stretch, by, keyed):
    monkeypatch.setattr(windows, "STRETCH", stretch)
    monkeypatch.setattr(windows, "MERGED", by)
    rng = np.random.default_rng(9)
    rows = [(["x", None][k % 2] if keyed else "x", datetime(2024, 1, 1) + timedelta(minutes=37 * k + (9000 if k > 90 else 0)), None if rng.random() < 0.05 else bool(rng.random() < 0.75)) for k in range(160)]
    rows += [("all", datetime(2024, 1, 1) + timedelta(hours=k), True) for k in range(40)] * keyed + [("no", datetime(2024, 1, 1), False), ("x", None, True)] * keyed
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, f boolean")
    keys = ["k"] if keyed else []
    want = []
    for key in {r[0] for r in rows}:
        run = []
        for _, t, f in [*sorted((r for r in rows if r[0] == key and r[1]), key=lambda r: r[1]), (None, None, False)]:
            if f:
                run.append(t)
            elif run:
                want += [(*[key] * keyed, run[0], run[-1], len(run))] * (len(run) >= 3)
                run = []
    out = windows.islands(df, keys, "t", F.col("f"), 3)
    assert out.columns == [*keys, "start", "end", "n"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert windows.islands(df.limit(0), keys, "t", F.col("f"), 3).count() == 0


def test_tasks_get_keys_times_and_values_alone(spark):
    """Wide rows stay where they are, and equal readings at a time are one row with a count."""
    rows = spark.range(400).selectExpr("if(id % 5 = 0, null, id % 2) as k", "timestamp_ntz'2024-01-01' + make_dt_interval(0, int(id div 8)) as t", "double(id % 3) as a", "repeat('x', 100) as wide", "id")
    out = windows.rolling_baseline(rows, ["k"], "t", "a", "5h", 0.3, 2)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    sent = plan[plan.index("FlatMapGroupsInArrow") :]
    assert "wide" not in sent[sent.index("Aggregate") :].split("Project")[1] and "__rows" in sent
    table = out.toPandas()
    assert sorted(table["id"]) == list(range(400)) and list(out.columns) == [*rows.columns, "baseline"]
    for r in table.itertuples():
        near = table[(table["k"].isna() if r.k != r.k else table["k"] == r.k) & (table["t"] <= r.t) & (table["t"] > r.t - np.timedelta64(5, "h"))]["a"]
        assert abs(r.baseline - np.percentile(near, 30)) < 1e-12 if len(near) >= 2 else r.baseline != r.baseline
