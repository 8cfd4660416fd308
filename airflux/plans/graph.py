"""The tables of an inversion as a graph: what each is made from, and a store that makes each of them once."""

from __future__ import annotations

import time
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .cache import CHOSEN, DEPENDS, GRID, table_exists
from .config import InversionConfig, digest


@dataclass(frozen=True)
class Node:
    """A table: the fields of the configuration that it reads itself, and the nodes it is made from."""

    fields: tuple[str, ...] = ()
    inputs: tuple[str, ...] = ()


#: Raw inputs, known by a version that the caller states; tables of a run follow.
RAW = ("readings", "foot", "inventory", "monthly", "daily", "samples")
#: Plain values that come with the raw inputs, known by themselves.
PLAIN = ("events", "orgs", "expected", "resolutions")
NODES: dict[str, Node] = {name: Node() for name in (*RAW, *PLAIN)} | {
    "hours": Node(tuple(f for f in CHOSEN if f != "aggregate_obs"), ("readings", "foot", "daily", "samples", "events", "expected", "resolutions")),
    "observations": Node(("aggregate_obs",), ("hours",)),
    "prior": Node(tuple(f for f in GRID), ("inventory", "monthly")),
    "operator": Node(("dx", "dy", "xmin", "ymin", "flux_freq", "location_site_map", "footprint_path"), ("observations", "prior", "foot", "resolutions")),
}


def follows(names: set[str]) -> set[str]:
    """The named nodes and all that is made from them."""
    out = set(names)
    while more := {n for n, node in NODES.items() if n not in out and out & set(node.inputs)}:
        out |= more
    return out


def hashes(config: InversionConfig, given: dict[str, Any]) -> dict[str, str]:
    """12 hex digits of every node: of its own fields, and of the hashes of what it is made from.

    ``given`` has the version of each raw input and the plain values; one that is left out counts as absent."""
    out: dict[str, str] = {}

    def of(name: str) -> str:
        if name not in out:
            node = NODES[name]
            own = {f: getattr(config, f) for f in node.fields}
            out[name] = digest([name, own, {i: of(i) for i in node.inputs}, given.get(name) if name in (*RAW, *PLAIN) else None], 6)
        return out[name]

    for name in NODES:
        of(name)
    return out


class Store:
    """``store(df, name)``: the node's table, read where it is stored, else written from ``df``; once in a run.

    Tables lie in ``config.cache``/version/node/hash.  A node in ``config.cache_overwrite`` (or "all") is written
    anew, and so is every node made from it.  ``seconds`` holds the time that each node took, ``made`` those
    that were written.  A table whose writing broke off has no commit marker and is written again.
    """

    def __init__(self, spark: SparkSession, config: InversionConfig, given: dict[str, Any], version: str = "1"):
        unknown = set(config.cache_overwrite) - set(NODES) - set(DEPENDS) - {"all"}
        if unknown or not config.cache:
            raise ValueError(f"unknown components {sorted(unknown)}" if unknown else "the configuration names no cache")
        self.spark, self.folder, self.hashes = spark, f"{config.cache}/{version}", hashes(config, given)
        self.again = set(NODES) if "all" in config.cache_overwrite else follows(set(config.cache_overwrite) & set(NODES))
        self.known: dict[str, DataFrame] = {}
        self.made: list[str] = []
        self.seconds: dict[str, float] = {}

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        if name not in self.known:
            began, path = time.monotonic(), f"{self.folder}/{name}/{self.hashes[name]}"
            if name in self.again or not table_exists(self.spark, path):
                df.write.mode("overwrite").parquet(path)
                self.made.append(name)
            self.known[name] = self.spark.read.schema(df.schema).parquet(path)
            self.seconds[name] = time.monotonic() - began
        return self.known[name]
