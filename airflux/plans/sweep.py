"""Parameter sweeps: grid, resumable run, one row per configuration."""

from __future__ import annotations

import dataclasses
import itertools
import json
import os
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import InversionConfig, config_id

ROW = "config_id string, error string, runtime_seconds double, metrics map<string,double>, cfg map<string,string>"


def build_grid(base: InversionConfig, grid: dict[str, list], known: list[InversionConfig] = ()) -> list[InversionConfig]:
    """Product of the settings over the base; unknown names and empty grids raise, equal configurations appear once."""
    names = {f.name for f in dataclasses.fields(base)}
    if unknown := set(grid) - names:
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    made = [dataclasses.replace(base, **dict(zip(grid, combo))) for combo in itertools.product(*grid.values())] if grid else []
    unique = {config_id(c): c for c in [*known, *made]}
    if not unique:
        raise ValueError("no configurations")
    return list(unique.values())


def grid_table(spark: SparkSession, configs: list[InversionConfig]) -> DataFrame:
    rows = [(k, config_id(c), json.dumps(dataclasses.asdict(c), sort_keys=True, default=str)) for k, c in enumerate(configs)]
    return spark.createDataFrame(rows, "index int, config_id string, config string")


def from_row(row) -> InversionConfig:
    """The configuration of a row of the grid."""
    values = json.loads(row["config"])
    kinds = {f.name: getattr(InversionConfig(), f.name) for f in dataclasses.fields(InversionConfig)}
    return InversionConfig(**{k: tuple(v) if isinstance(kinds[k], tuple) else v for k, v in values.items()})


def run_one(config: InversionConfig, solve: Callable[[InversionConfig], dict[str, float]]) -> tuple:
    """One result row; an error is a row of the same shape."""
    began = time.time()
    cfg = {f.name: json.dumps(getattr(config, f.name), sort_keys=True, default=str) for f in dataclasses.fields(config)}
    try:
        metrics, error = {k: None if v is None else float(v) for k, v in solve(config).items()}, None
    except Exception as problem:  # a failed configuration must not end the sweep
        metrics, error = {}, f"{type(problem).__name__}: {problem}"
    return config_id(config), error, time.time() - began, metrics, cfg


def run(
    spark: SparkSession,
    configs: list[InversionConfig],
    solve: Callable[[InversionConfig], dict[str, float]],
    path: str,
    jobs: int = 4,
    only: list[str] | None = None,
) -> DataFrame:
    """Run what ``path`` has no row of yet; Spark jobs of several configurations run side by side.

    ``jobs`` 0 writes nothing but the grid; ``only`` names ids.  Each row is appended when it is done.
    """
    grid_table(spark, configs).write.mode("overwrite").json(f"{path}/grid")
    if jobs == 0:
        return spark.createDataFrame([], ROW)
    rows = f"{path}/rows"
    there = has_files(spark, rows)  # a path that is there but cannot be read raises
    done = {r[0] for r in spark.read.schema(ROW).parquet(rows).select("config_id").collect()} if there else set()
    pending = [c for c in configs if config_id(c) not in done and (only is None or config_id(c) in only)]

    # Solves run side by side; the rows are appended by one thread, so that writers never meet.
    with ThreadPoolExecutor(max_workers=jobs) as pool:
        for row in pool.map(lambda c: run_one(c, solve), pending):
            spark.createDataFrame([row], ROW).coalesce(1).write.mode("append").parquet(rows)
    return results(spark, path)


def has_files(spark: SparkSession, path: str) -> bool:
    """The folder exists and holds a file of rows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(at) and any(f.getPath().getName().startswith("part-") for f in fs.listStatus(at))


def run_index(spark: SparkSession, path: str, solve: Callable[[InversionConfig], dict[str, float]], index: int | None = None) -> DataFrame:
    """Run the configuration of one index of a stored grid, for arrays of jobs; what is done already is left.

    Without ``index`` it is $AIRFLUX_TASK.  No grid: FileNotFoundError; an index out of range: IndexError.
    """
    index = int(os.environ["AIRFLUX_TASK"]) if index is None else index
    if not has_files(spark, f"{path}/grid"):
        raise FileNotFoundError(f"no grid under {path}; run with jobs=0 first")
    row = spark.read.schema("index int, config_id string, config string").json(f"{path}/grid").where(F.col("index") == index).first()
    if row is None:
        raise IndexError(f"the grid has no index {index}")
    rows = f"{path}/rows"
    if not has_files(spark, rows) or spark.read.schema(ROW).parquet(rows).where(F.col("config_id") == row["config_id"]).isEmpty():
        spark.createDataFrame([run_one(from_row(row), solve)], ROW).coalesce(1).write.mode("append").parquet(rows)
    return results(spark, path)


def results(spark: SparkSession, path: str) -> DataFrame:
    """Result rows with their reduced chi2 and its distance from 1."""
    table = spark.read.schema(ROW).parquet(f"{path}/rows")
    chi2 = F.col("metrics")["reduced_chi2"]
    return table.withColumns({"reduced_chi2": chi2, "chi2_distance": F.abs(chi2 - 1.0)})
