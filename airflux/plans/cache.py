"""Content-addressed tables: a component is computed once for each setting of the fields it depends on."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .config import InversionConfig, component_hash

#: Fields that each component depends on.
SPACE = ["tstart", "tend", "flux_freq"]
HOURS = ["tstart", "tend", "subset_hours", "utc_offset", "sites", "filter_pcaps", "filter_spikes", "spike_percentile"]
#: What decides which observations stay: those with a background, in bins with enough of them and of simulations.
CHOSEN = [*HOURS, "flux_freq", "background", "background_kwargs", "min_obs_per_interval", "min_sims_per_interval", "location_site_map", "footprint_path", "aggregate_obs"]
GRID = [*SPACE, "xmin", "xmax", "ymin", "ymax", "dx", "dy", "prior", "prior_kwargs", "output_units"]
DEPENDS = {
    "obs": CHOSEN,
    "constant": CHOSEN,
    "prior": [*GRID, "bias_std", "bias_grouping"],
    "modeldata_mismatch": [*CHOSEN, "mdm_config"],
}
DEPENDS["forward_operator"] = sorted({*CHOSEN, *DEPENDS["prior"]})
DEPENDS["prior_error"] = [*DEPENDS["prior"], "prior_base_std", "prior_std_frac", "prior_time_scale", "prior_spatial_scale"]


def table_exists(spark: SparkSession, path: str) -> bool:
    """The table was written to its end (the commit marker is there)."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def cached(component: str, version: str = "1"):
    """Decorator of ``f(spark, config) -> DataFrame``: read the stored table, or compute and store it.

    ``config.cache`` is the folder (None: no cache); components in ``config.cache_overwrite`` (or
    "all") are computed again, which replaces the table of exactly this setting.
    """

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(f)
        def inner(spark: SparkSession, config: InversionConfig, *args) -> DataFrame:
            if not config.cache:
                return f(spark, config, *args)
            path = f"{config.cache}/{version}/{component}/{component_hash(config, DEPENDS[component])}"
            again = component in config.cache_overwrite or "all" in config.cache_overwrite
            if again or not table_exists(spark, path):
                f(spark, config, *args).write.mode("overwrite").parquet(path)
            return spark.read.parquet(path)

        return inner

    return wrap
