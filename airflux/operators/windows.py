"""Windows over time: rolling baselines, correlations, centred means, gaps, islands.

A rolling window by time needs only rows of its own and of neighbouring stretches of time, so
``stretched`` copies rows to the stretches that need them; windows then run by (key, stretch) and
not by key alone, and a long record is worked on in parallel.
"""

from __future__ import annotations

from array import array
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.timeutil import duration_us, micros
from ..scratch import written


MOMENTS = 4096


def stretched(df: DataFrame, time: str, before_us: int, after_us: int = 0, least_us: int = 86_400_000_000) -> DataFrame:
    """``df`` with __us, __stretch and __own: each row once as its own, and as a guest where a window reaches it."""
    return _spread(df.withColumn("__us", micros(F.col(time))), before_us, after_us, least_us)


def _spread(df: DataFrame, before_us: int, after_us: int = 0, least_us: int = 86_400_000_000) -> DataFrame:
    width = max(before_us, after_us, least_us)
    rows = df.where("__us is not null").withColumn("__at", F.expr(f"cast(floor(__us / {width}) as long)"))
    first = F.floor((F.col("__us") - after_us) / width).cast("long")
    last = F.floor((F.col("__us") + before_us) / width).cast("long")
    out = rows.withColumn("__stretch", F.explode(F.sequence(first, last)))
    return out.withColumn("__own", F.col("__stretch") == F.col("__at")).drop("__at")


def rolling(df: DataFrame, keys: list[str], time: str, before_us: int, after_us: int, columns: list[Column], name: str, evaluate, counted: bool = False) -> DataFrame:
    """``df`` plus the double ``name`` over the rows in [t - before, t + after] of each row.

    ``evaluate(values, first, stop, at)`` gets the ``columns`` as arrays (null: nan) in the order of time, and for
    each distinct time the rows first..stop of its window; ``at`` maps rows to distinct times.  It works on one
    stretch of one key in an Arrow batch, in linear or n log n time.  Rows with a null time are left out; rows with
    equal times have equal windows; null keys are a key; an empty table gives an empty one.

    Only keys, times and ``columns`` go to the tasks of a stretch, and one number for each time comes back and is joined to
    the rows.  With ``counted``, rows of equal key, time and columns are one there, and their number follows the columns."""
    inputs, names = [f"__in{k}" for k in range(len(columns))], [f"__key{k}" for k in range(len(keys))]
    rows = df.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), micros(F.col(time)).alias("__us"), *(c.cast("double").alias(n) for n, c in zip(inputs, columns)))
    if counted:
        rows = rows.groupBy(*names, "__us", *inputs).agg(F.count("*").cast("double").alias("__rows"))
        inputs = [*inputs, "__rows"]
    rows = _spread(rows, before_us, after_us)
    kind = StructType([*rows.select(*names, "__us").schema.fields, StructField("__out", DoubleType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table["__us"]))
        us = table["__us"].to_numpy()
        moments, at = np.unique(us, return_inverse=True)
        values = [pc.fill_null(table[c], np.nan).to_numpy() for c in inputs]
        first, stop = np.searchsorted(us, moments - before_us), np.searchsorted(us, moments + after_us, side="right")
        out = evaluate(values, first, stop, at)
        one = np.flatnonzero(np.append(True, us[1:] != us[:-1]) & table["__own"].to_numpy())[: len(us)]
        made = table.select([*names, "__us"]).take(pa.array(one))
        return made.append_column("__out", pa.array(out[at[one]], pa.float64(), mask=np.isnan(out[at[one]])))

    found = rows.groupBy(*names, "__stretch").applyInArrow(run, kind).withColumnRenamed("__us", "__when")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)), micros(F.col(time)) == F.col("__when"))
    return df.join(found, same).select(*df.columns, F.col("__out").alias(name))


class Ranks:
    """Counts by rank in a Fenwick tree: add, remove and find the k-th smallest in O(log n)."""

    def __init__(self, size: int):
        self.size, self.tree, self.top = size, array("q", bytes(8 * (size + 1))), 1 << max(size.bit_length() - 1, 0)

    def add(self, rank: int, by: int) -> None:
        tree, i = self.tree, rank + 1
        while i <= self.size:
            tree[i] += by
            i += i & -i

    def smallest(self, k: int) -> int:
        """Rank of the k-th smallest, k from 0."""
        tree, i, step, left = self.tree, 0, self.top, k + 1
        while step:
            j = i + step
            if j <= self.size and tree[j] < left:
                i, left = j, left - tree[j]
            step >>= 1
        return i


def sliding_percentile(q: float, least: int):
    """Exact percentile (between neighbours by share) of each window with ``least`` or more values, given with their counts."""

    def evaluate(values, first, stop, at) -> np.ndarray:
        v, rows = values
        some = ~np.isnan(v)
        ranked, rank = np.unique(v[some], return_inverse=True)
        place = np.full(len(v), -1, np.int64)
        place[some] = rank
        rows = rows.astype(np.int64)
        ranks, out = Ranks(len(ranked)), np.full(len(first), np.nan)
        listed = lambda a, b: list(zip(place[a:b].tolist(), rows[a:b].tolist()))
        lo = hi = n = 0
        for at in range(0, len(first), MOMENTS):  # Python's own numbers are made for so many windows only
            firsts, stops = first[at : at + MOMENTS].tolist(), stop[at : at + MOMENTS].tolist()
            gone, here = lo, hi
            come, go = listed(hi, stops[-1]), listed(lo, firsts[-1])
            for k, (a, b) in enumerate(zip(firsts, stops), at):
                for r, c in come[hi - here : b - here]:
                    if r >= 0:
                        ranks.add(r, c)
                        n += c
                for r, c in go[lo - gone : a - gone]:
                    if r >= 0:
                        ranks.add(r, -c)
                        n -= c
                lo, hi = a, b
                if n and n >= least:
                    x = q * (n - 1)
                    low, share = int(x), x - int(x)
                    below = ranked[ranks.smallest(low)]
                    out[k] = below if share == 0 else below * (1 - share) + ranked[ranks.smallest(low + 1)] * share
        return out

    return evaluate


def _sums(x: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Sums of the windows, by differences of running sums in extended precision."""
    run = np.append(np.longdouble(0), np.cumsum(x.astype(np.longdouble)))
    return run[stop] - run[first]


def _centred(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    return np.where(some, x - (x[some].mean() if some.any() else 0.0), 0.0)


def sliding_mean(values, first, stop, at) -> np.ndarray:
    (v,) = values
    some = ~np.isnan(v)
    n = _sums(some, first, stop)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n > 0, _sums(np.where(some, v, 0.0), first, stop) / n, np.nan).astype(np.float64)


def sliding_corr(values, first, stop, at) -> np.ndarray:
    """Correlation of each window; nan where a column has one value in it."""
    some = ~np.isnan(values[0]) & ~np.isnan(values[1])
    x, y = (_centred(v, some) for v in values)
    n, sx, sy, sxy, sxx, syy = (_sums(c, first, stop) for c in (some, x, y, x * y, x * x, y * y))
    kept = np.flatnonzero(some)
    # How often a value differs from the one before, among rows with both: none within a window, and it is constant.
    lo, hi = np.searchsorted(kept, first), np.searchsorted(kept, stop)
    varies = n > 1
    for v in values:
        changes = np.append(0, np.cumsum(np.append(0, v[kept][1:] != v[kept][:-1]))) if len(kept) else np.zeros(1, np.int64)
        varies &= changes[hi] > changes[np.minimum(lo + 1, len(kept))]
    with np.errstate(invalid="ignore", divide="ignore"):
        vx, vy = sxx - sx * sx / n, syy - sy * sy / n
        out = np.where(varies, (sxy - sx * sy / n) / np.sqrt(vx * vy), np.nan).astype(np.float64)
    # Where larger values elsewhere in the stretch have taken the digits of a window, it is summed by itself.
    total = lambda c: np.append(0, np.cumsum(c.astype(np.longdouble)))[stop]
    weak = varies & ((vx < 1e-9 * total(x * x)) | (vy < 1e-9 * total(y * y)))
    for k in np.flatnonzero(weak):
        u, w = (v[first[k] : stop[k]][some[first[k] : stop[k]]] for v in values)
        u, w = u - u.mean(), w - w.mean()
        spread = np.sqrt((u @ u) * (w @ w))
        out[k] = u @ w / spread if spread > 0 else np.nan
    return out


def rolling_baseline(df: DataFrame, keys: list[str], time: str, value: str, window: str = "14d", q: float = 0.01, min_periods: int = 84, name: str = "baseline") -> DataFrame:
    """Exact low percentile of the trailing window (t - w, t]; null where it has fewer than ``min_periods`` values."""
    return rolling(df, keys, time, duration_us(window) - 1, 0, [F.col(value)], name, sliding_percentile(q, min_periods), counted=True)


def rolling_corr(df: DataFrame, keys: list[str], time: str, a: str, b: str, window: str = "30s", name: str = "r") -> DataFrame:
    """Correlation over (t - w, t]; null where either column is constant there."""
    return rolling(df, keys, time, duration_us(window) - 1, 0, [F.col(a), F.col(b)], name, sliding_corr)


def centered_mean(df: DataFrame, keys: list[str], time: str, value: str, window: str = "30d", name: str = "smooth") -> DataFrame:
    """Mean over (t - w/2, t + w/2]."""
    half = duration_us(window) // 2
    return rolling(df, keys, time, half - 1, half, [F.col(value)], name, sliding_mean)


def enhancement(value: str, baseline: str) -> Column:
    return F.col(value) - F.col(baseline)


def ratio(a: str, b: str) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(F.col(a), F.col(b))


def gaps(df: DataFrame, keys: list[str], time: str, longer: str = "7d") -> DataFrame:
    """(keys, gap_start, gap_end) of stretches without rows longer than given."""
    before = F.lag(time).over(Window.partitionBy(*keys).orderBy(time))
    rows = df.select(*keys, time).distinct().withColumn("gap_start", before)
    return rows.where(micros(F.col(time)) - micros(F.col("gap_start")) > duration_us(longer)).select(*keys, "gap_start", F.col(time).alias("gap_end"))


STRETCH, MERGED = "30d", 64  # of islands: time of a first stretch, and stretches merged at a time


def islands(df: DataFrame, keys: list[str], time: str, flag: Column, least: int = 3) -> DataFrame:
    """Runs of ``least`` or more successive rows with ``flag``: (keys, start, end, n).  Null is not flagged.

    Runs are found within stretches of time, then stretches are merged by 64: only the runs at their ends
    can go on, so a stretch is one row and no key is one task.  Rows with a null time are left out; a null key is
    a key; the order of rows with equal times is not defined."""
    names = [f"k{k}" for k in range(len(keys))]
    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    span = duration_us(STRETCH)
    rows = df.where(F.col(time).isNotNull()).select(
        *(F.col(k).alias(n) for k, n in zip(keys, names)), F.col(time).alias("time"), F.coalesce(flag, F.lit(False)).alias("flag"), F.floor(micros(F.col(time)) / span).cast("long").alias("at")
    )
    ends = ["n", "start", "end"]
    cols = [*names, "at", "done", "solid", *(f"{side}_{c}" for side in "lr" for c in ends)]
    run_kind = lambda side: f"{side}_n long, {side}_start {kind[time]}, {side}_end {kind[time]}"
    out_kind = ", ".join([*(f"{n} {kind[k]}" for k, n in zip(keys, names)), "at long, done boolean, solid boolean", run_kind("l"), run_kind("r")])
    none = (0, None, None)

    def table(pdf: pd.DataFrame, made: list[tuple]) -> pd.DataFrame:
        head = tuple(pdf[n].iloc[0] for n in names)
        out = pd.DataFrame([(*head, int(pdf["at"].iloc[0]), *row) for row in made], columns=cols)
        return out.astype({c: "datetime64[us]" for c in cols if c.endswith(("_start", "_end"))})

    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("time", kind="stable", ignore_index=True)
        on, when = pdf["flag"].to_numpy(bool), pdf["time"]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
        runs = [(b - a, when[a], when[b - 1], a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]
        left = next((r[:3] for r in runs if r[3] == 0), none)
        right = next((r[:3] for r in runs if r[4] == len(on)), none)
        inner = [(True, False, *r[:3], *none) for r in runs if r[3] > 0 and r[4] < len(on)]
        return table(pdf, [(False, bool(on.all()), *left, *right), *inner])

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("before", ignore_index=True)
        join = lambda a, b: (a[0] + b[0], a[1] if a[0] else b[1], b[2] if b[0] else a[2])
        left, run, inner = None, none, []
        for solid, *row in pdf[["solid", *cols[-6:]]].itertuples(index=False):
            run = join(run, tuple(row[:3]))
            if not solid:
                if left is None:
                    left = run
                elif run[0]:
                    inner.append((True, False, *run, *none))
                run = tuple(row[3:])
        whole = (False, True, *run, *run) if left is None else (False, False, *left, *run)
        return table(pdf, [whole, *inner])

    span_of = rows.agg(F.min("at"), F.max("at")).first()
    parts = rows.groupBy(*names, "at").applyInPandas(found, out_kind)
    parts = [parts] if span_of[0] is None else [written(parts, "runs")]
    low, high = span_of[0] or 0, span_of[1] or 0
    while low != high:
        low, high = low // MERGED, high // MERGED
        ends_ = parts[-1].where("not done").withColumn("before", F.col("at")).withColumn("at", F.floor(F.col("at") / MERGED).cast("long"))
        parts.append(written(ends_.groupBy(*names, "at").applyInPandas(merged, out_kind), "runs"))
    pick = lambda df, side: df.select(*names, *(F.col(f"{side}_{c}").alias(c) for c in ends))
    done = reduce(DataFrame.unionByName, [pick(p.where("done"), "l") for p in parts])
    last = parts[-1].where("not done")
    done = done.unionByName(pick(last, "l")).unionByName(pick(last.where("not solid"), "r"))
    return done.where(f"n >= {least}").select(*(F.col(n).alias(k) for k, n in zip(keys, names)), "start", "end", "n")


def heat_deficit(soundings: DataFrame, keys: list[str], z: str = "z", theta: str = "theta", density: str = "rho", top: float = 2200.0) -> DataFrame:
    """Valley heat deficit of each sounding in MJ/m2 (Whiteman et al. 2014): trapezoids of
    cp * rho * (theta_top - theta) up to ``top``."""
    below = soundings.where(F.col(z) <= top)
    tops = below.groupBy(*keys).agg(F.max_by(theta, z).alias("__top"))
    rows = below.join(tops, keys).withColumn("__d", 1005.0 * F.col(density) * (F.col("__top") - F.col(theta)))
    w = Window.partitionBy(*keys).orderBy(z)
    step = (F.col(z) - F.lag(z).over(w)) * (F.col("__d") + F.lag("__d").over(w)) / 2
    return rows.withColumn("__step", step).groupBy(*keys).agg((F.sum("__step") / 1e6).alias("heat_deficit"))


def pcap_events(deficits: DataFrame, time: str = "time", threshold: float = 4.04, min_periods: int = 3) -> DataFrame:
    """Events of ``min_periods`` or more successive soundings with a deficit at or above the threshold."""
    return islands(deficits, [], time, F.col("heat_deficit") >= threshold, min_periods)
