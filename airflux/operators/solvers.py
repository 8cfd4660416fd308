"""The linear Gaussian problem z = H s + e without dense matrices, at any number of observations.

Conjugate gradients on A y = z - H s0 with A = H C Ht + S; C and S are products with vectors, so both may be
correlated.  Several right-hand sides are solved side by side, as rows of the same tables told apart by
``probe``: the data (probe 0) and random signs, from which the degrees of freedom of the signal and the
posterior variances are estimated with their errors.

Where S is diagonal and states are few, one pass over the operator sums Ht S^-1 H, a matrix of states, and no step
is taken: the observations, of which there may be any number, are read once.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .inversion import OBS, STATE

MOST_STATES = 1000  # states whose matrix the driver holds
KEYS = ["probe", *OBS]
Apply = Callable[[DataFrame], DataFrame]


def through(matrix: DataFrame, x: DataFrame, on: list[str], rows: list[str]) -> DataFrame:
    """``matrix`` times the vectors ``x`` (probe, on, value), summed by ``rows``."""
    v = x.select("probe", *on, F.col("value").alias("__x"))
    return matrix.join(v, on).groupBy("probe", *rows).agg(F.sum(F.col("value") * F.col("__x")).alias("value"))


def scaled_by(weights: DataFrame, keys: list[str]) -> Apply:
    """Product with a diagonal matrix: ``weights`` (keys, value)."""
    w = weights.select(*keys, F.col("value").alias("__w"))
    return lambda x: x.join(w, keys).select("probe", *keys, (F.col("value") * F.col("__w")).alias("value"))


def per_probe(values: dict[int, float]) -> Column:
    return F.create_map(*(F.lit(x) for k, v in values.items() for x in (k, float(v))))[F.col("probe")]


def dots(df: DataFrame, *pairs: tuple[str, str]) -> list[dict[int, float]]:
    """Inner products of columns, by probe: a few numbers."""
    rows = df.groupBy("probe").agg(*(F.sum(F.col(a) * F.col(b)).alias(f"d{k}") for k, (a, b) in enumerate(pairs))).collect()
    return [{r["probe"]: r[f"d{k}"] or 0.0 for r in rows} for k in range(len(pairs))]


def conjugate_gradients(apply: Apply, b: DataFrame, diagonal: DataFrame, write, steps: int = 1000, tol: float = 1e-8) -> DataFrame:
    """(probe, OBS, b, y) with A y = b for every probe; ``apply(x)`` is A x, ``diagonal`` (OBS, value) scales the steps.

    Each step is a table in the shared folder.  Ends when each residual, computed anew, is at most ``tol`` of its
    b; raises ArithmeticError if one is not after ``steps`` steps."""
    start = b.join(diagonal.select(*OBS, F.col("value").alias("d")), OBS).select(*KEYS, F.col("value").alias("b"), "d")
    start = start.withColumns({"y": F.lit(0.0), "r": F.col("b"), "z": F.col("b") / F.col("d")})
    state = write(start.withColumn("p", F.col("z")), "cg")
    (rr, rz), done = dots(state, ("r", "r"), ("r", "z")), 0
    bound = {k: tol**2 * v for k, v in rr.items()}
    open_ = lambda: any(rr[k] > bound[k] for k in rr)
    share = lambda a, b: {k: a[k] / b[k] if b.get(k) else 0.0 for k in a}
    while open_():
        while open_():
            if done == steps:
                worst = max(math.sqrt(rr[k] / bound[k]) for k in rr if bound[k]) * tol
                raise ArithmeticError(f"conjugate gradients: residual {worst:.3g} of the first after {steps} steps, not {tol:g}")
            ax = apply(state.select(*KEYS, F.col("p").alias("value"))).select(*KEYS, F.col("value").alias("ax"))
            joined = write(state.join(ax, KEYS), "cg")
            alpha = per_probe(share(rz, dots(joined, ("p", "ax"))[0]))
            r = F.col("r") - alpha * F.col("ax")
            moved = joined.withColumns({"y": F.col("y") + alpha * F.col("p"), "r": r, "z": r / F.col("d")}).drop("ax")
            rr, new = dots(moved, ("r", "r"), ("r", "z"))
            state = moved.withColumn("p", F.col("z") + per_probe(share(new, rz)) * F.col("p"))
            rz, done = new, done + 1
        # r is carried from step to step; what was lost by rounding shows only against b, and is solved for again.
        ax = apply(state.select(*KEYS, F.col("y").alias("value"))).select(*KEYS, F.col("value").alias("ax"))
        r = F.col("b") - F.col("ax")
        state = write(state.join(ax, KEYS).withColumns({"r": r, "z": r / F.col("d"), "p": r / F.col("d")}).drop("ax"), "cg")
        rr, rz = dots(state, ("r", "r"), ("r", "z"))
    return state.select(*KEYS, "b", "y")


def _sign(seed: int, probe: Column | str, keys: list[str]) -> Column:
    return 2.0 * F.pmod(F.xxhash64(F.lit(seed), probe, *keys), F.lit(2)) - 1.0


def signs(keys: list[str], first: int, count: int, seed: int) -> Callable[[DataFrame], DataFrame]:
    """Vectors of random signs on the rows of a table: the same for the same keys, wherever they are computed."""
    def made(df: DataFrame) -> DataFrame:
        rows = df.select(*keys).withColumn("probe", F.explode(F.sequence(F.lit(first), F.lit(first + count - 1))))
        return rows.select("probe", *keys, _sign(seed, "probe", keys).alias("value"))

    return made


@dataclass
class Solution:
    """posterior (STATE, value [, variance, variance_error]); figures: n_obs, chi2, reduced_chi2 [, DOFS, DOFS_error]."""

    posterior: DataFrame
    figures: dict[str, float]


def _listed(prior: DataFrame, obs_var: DataFrame) -> list | None:
    """The states in order, if they are at most ``MOST_STATES`` and differ, and all variances are above 0; else None."""
    rows = prior.select(F.col("time").cast("timestamp_ntz").alias("time"), *(F.col(c).cast("double").alias(c) for c in ("lon", "lat", "value"))).dropna().limit(MOST_STATES + 1).collect()
    if len(rows) > MOST_STATES or len({tuple(r)[:3] for r in rows}) < len(rows):
        return None
    least = obs_var.agg(F.min("value")).first()[0]
    return None if least is not None and least <= 0 else sorted(rows)


def _by_states(jacobian: DataFrame, obs: DataFrame, prior: DataFrame, obs_var: DataFrame, listed: list, prior_product: Apply, write, probes: int, seed: int) -> Solution:
    """``solve`` for diagonal S and the few states ``listed``: A^-1 = S^-1 - S^-1 H L (I + Lt G L)^-1 Lt Ht S^-1.

    G = Ht S^-1 H is summed over the pairs of entries of each observation; G and C = L Lt are all that the driver
    holds.  The probes are the vectors of signs of the iterative solve.  Observations with a null value are left out."""
    spark, p = prior.sparkSession, len(listed)
    numbers = F.broadcast(spark.createDataFrame([(*r, k) for k, r in enumerate(listed)], "time timestamp_ntz, lon double, lat double, __x double, __k int"))
    at = numbers.select(*STATE, "__k")
    entry = F.struct("__k", F.col("value").cast("double").alias("v"))
    entries = jacobian.dropna(subset=["value"]).join(numbers, STATE).groupBy(*OBS).agg(F.collect_list(entry).alias("h"), F.sum(F.col("value") * F.col("__x")).alias("fit"))
    data = obs.dropna(subset=["value"]).join(obs_var.select(*OBS, (1.0 / F.col("value")).alias("w")), OBS)
    lines = data.join(entries, OBS, "left").select(*OBS, "w", (F.col("value") - F.coalesce("fit", F.lit(0.0))).alias("r"), "h")
    lines = write(lines, "lines")
    n, rr = lines.agg(F.count("*"), F.sum(F.col("w") * F.col("r") * F.col("r"))).first()

    pairs = lines.select("w", "h", F.explode("h").alias("a")).select("w", "a", F.explode("h").alias("b")).where("a.__k <= b.__k")
    pairs = pairs.groupBy(F.col("a.__k").alias("i"), F.col("b.__k").alias("j")).agg(F.sum(F.col("w") * F.col("a.v") * F.col("b.v")).alias("value"))
    g = _matrix(pairs, p)
    g = g + np.triu(g, 1).T
    c = prior_product(at.select(F.col("__k").alias("probe"), *STATE, F.lit(1.0).alias("value"))).join(at, STATE)
    c = _matrix(c.select(F.col("probe").alias("i"), F.col("__k").alias("j"), "value"), p)

    v = {f"v{k}": _sign(seed, F.lit(k), OBS) for k in range(1, probes + 1)}
    single = lines.withColumns(v).select("w", "r", *v, F.explode("h").alias("a")).groupBy(F.col("a.__k").alias("k"))
    sums = {"r": F.sum(F.col("a.v") * F.col("w") * F.col("r"))}
    for name in v:
        sums |= {name: F.sum(F.col("a.v") * F.col(name)), f"w{name}": F.sum(F.col("a.v") * F.col("w") * F.col(name))}
    by = {name: np.zeros(p) for name in sums}
    for row in single.agg(*(s.alias(name) for name, s in sums.items())).collect():
        for name in sums:
            by[name][row["k"]] = row[name]

    share, vectors = np.linalg.eigh((c + c.T) / 2)
    root = vectors * np.sqrt(np.maximum(share, 0.0))
    inner = np.eye(p) + root.T @ g @ root
    step = lambda x: root @ np.linalg.solve(inner, root.T @ x)
    moved = step(by["r"])
    chi2 = float((rr or 0.0) - by["r"] @ moved)
    figures = {"n_obs": n, "chi2": chi2, "reduced_chi2": chi2 / n if n else math.nan}
    if probes:
        each = [float(by[name] @ step(by[f"w{name}"])) for name in v] if n else []
        figures |= _mean_of(each)
    added = F.broadcast(spark.createDataFrame([(k, float(x)) for k, x in enumerate(moved)], "__k int, __d double")) if p else None
    if added is None:
        return Solution(prior.select(*STATE, "value"), figures)
    posterior = prior.join(at, STATE, "left").join(added, "__k", "left").withColumn("value", F.col("value") + F.coalesce("__d", F.lit(0.0)))
    return Solution(posterior.select(*STATE, "value"), figures)


def _matrix(entries: DataFrame, size: int) -> np.ndarray:
    """A small matrix from its entries (i, j, value)."""
    table, out = entries.select("i", "j", "value").toArrow(), np.zeros((size, size))
    out[table["i"].to_numpy(), table["j"].to_numpy()] = table["value"].to_numpy()
    return out


def _mean_of(each: list[float]) -> dict[str, float]:
    """Degrees of freedom by several probes, and the standard error of their mean."""
    mean = sum(each) / len(each) if each else math.nan
    error = math.sqrt(sum((x - mean) ** 2 for x in each) / max(len(each) - 1, 1) / len(each)) if each else math.nan
    return {"DOFS": mean, "DOFS_error": error}


def solve(jacobian: DataFrame, obs: DataFrame, prior: DataFrame, obs_var: DataFrame, write, steps: int = 1000, tol: float = 1e-8,
          prior_product: Apply | None = None, obs_product: Apply | None = None, probes: int = 0, variances: bool = False, seed: int = 17,
          by_states: bool | None = None) -> Solution:
    """Posterior, chi-square and, with ``probes``, estimates of the degrees of freedom and posterior variances.

    jacobian (OBS, STATE, value); obs (OBS, value); prior (STATE, value, sigma); obs_var (OBS, value) is the
    diagonal of S.  ``prior_product`` and ``obs_product`` apply C and S to vectors (probe, keys, value); without them
    both are diagonal.  ``write(df, name)`` stores a table in the shared folder and returns it.

    chi2 = y . (z - H s0) is exact.  DOFS = n - tr(S A^-1) is a mean over ``probes`` vectors of signs, and a variance a
    mean of C_ii - w_i (C Ht A^-1 H C w)_i over as many (noise of other states is in it, and in its error); the errors
    are standard errors of these means.

    ``by_states``: by the matrix of states, without steps; unless given, where S is diagonal (no ``obs_product``), no
    variances are asked for and the states are at most ``MOST_STATES``."""
    s2 = prior.select(*STATE, (F.col("sigma") * F.col("sigma")).alias("value"))
    prior_product = prior_product or scaled_by(s2, STATE)
    listed = _listed(prior, obs_var) if by_states is not False and obs_product is None and not variances else None
    if listed is not None:
        return _by_states(jacobian, obs, prior, obs_var, listed, prior_product, write, probes, seed)
    if by_states:
        raise ValueError(f"by states: at most {MOST_STATES} of them, positive variances, no product or variances of states")
    obs_product = obs_product or scaled_by(obs_var, OBS)
    jacobian = jacobian.join(prior.select(*STATE), STATE, "left_semi")
    back = lambda x: prior_product(through(jacobian, x, OBS, STATE))

    def apply(x: DataFrame) -> DataFrame:
        far = through(jacobian, back(x), STATE, OBS).withColumnRenamed("value", "__far")
        own = obs_product(x).withColumnRenamed("value", "__own")
        total = F.coalesce("__far", F.lit(0.0)) + F.coalesce("__own", F.lit(0.0))
        return x.select(*KEYS).join(own, KEYS, "left").join(far, KEYS, "left").select(*KEYS, total.alias("value"))

    zero = lambda df: df.withColumn("probe", F.lit(0))
    fit = through(jacobian, zero(prior.select(*STATE, "value")), STATE, OBS).select(*OBS, F.col("value").alias("__fit"))
    b = obs.join(fit, OBS, "left").select(F.lit(0).alias("probe"), *OBS, (F.col("value") - F.coalesce("__fit", F.lit(0.0))).alias("value"))
    if probes:
        b = b.unionByName(signs(OBS, 1, probes, seed)(obs))
    if probes and variances:
        w = write(signs(STATE, probes + 1, probes, seed)(prior), "signs")
        hcw = through(jacobian, prior_product(w), STATE, OBS)
        b = b.unionByName(hcw.join(obs.select(*OBS), OBS, "left_semi"))
    spread = jacobian.join(s2.withColumnRenamed("value", "__s"), STATE).groupBy(*OBS).agg(F.sum(F.col("value") * F.col("value") * F.col("__s")).alias("__d"))
    diagonal = obs_var.join(spread, OBS, "left").select(*OBS, (F.col("value") + F.coalesce("__d", F.lit(0.0))).alias("value"))
    solved = conjugate_gradients(apply, write(b, "right"), diagonal, write, steps, tol)
    y = solved.select(*KEYS, F.col("y").alias("value"))
    head = solved.where("probe = 0").agg(F.sum(F.col("y") * F.col("b")), F.count("*")).first()
    chi2, n = head[0] or 0.0, head[1]
    figures = {"n_obs": n, "chi2": chi2, "reduced_chi2": chi2 / n if n else math.nan}
    if probes:
        sv = obs_product(solved.where(F.col("probe").between(1, probes)).select(*KEYS, F.col("b").alias("value"))).withColumnRenamed("value", "sv")
        each = [n - x for x in dots(solved.join(sv, KEYS), ("y", "sv"))[0].values()]
        figures |= _mean_of(each)
    moved = write(back(y.where("probe = 0" if not (probes and variances) else f"probe = 0 or probe > {probes}")), "moved")
    step = moved.where("probe = 0").select(*STATE, F.col("value").alias("__d"))
    posterior = prior.join(step, STATE, "left").withColumn("value", F.col("value") + F.coalesce("__d", F.lit(0.0)))
    if probes and variances:
        gain = w.join(moved.withColumnRenamed("value", "__m"), ["probe", *STATE], "left").withColumn("__g", F.col("value") * F.coalesce("__m", F.lit(0.0)))
        gain = gain.groupBy(*STATE).agg(F.avg("__g").alias("__g"), (F.stddev_samp("__g") / math.sqrt(probes)).alias("variance_error"))
        posterior = posterior.join(gain, STATE).withColumn("variance", F.col("sigma") * F.col("sigma") - F.col("__g"))
        return Solution(posterior.select(*STATE, "value", "variance", "variance_error"), figures)
    return Solution(posterior.select(*STATE, "value"), figures)


def solve_cg(jacobian: DataFrame, obs: DataFrame, prior: DataFrame, obs_var: DataFrame, write, steps: int = 1000, tol: float = 1e-8, **products) -> DataFrame:
    """The posterior (STATE, value) alone, by steps whatever the number of states."""
    return solve(jacobian, obs, prior, obs_var, write, steps, tol, by_states=False, **products).posterior
