"""The graph of a run's tables: hashes follow what changes them; each table is made once and found again."""

import dataclasses

import pytest

from airflux.plans import assembly, graph
from airflux.plans.config import InversionConfig
from airflux.scratch import written
from tests.test_plans import inversion_tables

CONFIG = InversionConfig(
    tstart="2024-01-01", tend="2024-03-01", xmin=-112.15, xmax=-111.95, ymin=40.45, ymax=40.65, dx=0.1, dy=0.1, location_site_map={"loc": "wbb"},
    min_obs_per_interval=5, min_sims_per_interval=5, background_kwargs={"window": "10d", "min_periods": 5}, aggregate_obs="1D", prior_kwargs={"value": 0.02},
)
#: Other settings, each of which changes at least one table.
OTHERS = {
    "tstart": "2024-01-10", "ymax": 40.55, "flux_freq": "2W", "utc_offset": -5, "filter_pcaps": False,
    "background_kwargs": {"window": "1d", "min_periods": 3}, "prior_kwargs": {"value": 0.03}, "aggregate_obs": False,
}


def tables_of(spark, tables, config):
    got = {}

    def write(df, name):
        kept = written(df, name)
        got[name] = sorted(map(str, kept.collect()))
        return kept

    assembly.assembled(spark, tables, config, write)
    return got


def test_what_changes_a_table_changes_its_hash(spark):
    tables = inversion_tables(spark)
    base, first = tables_of(spark, tables, CONFIG), graph.hashes(CONFIG, {})
    assert set(base) == {"hours", "observations", "prior", "operator"}
    for field, value in OTHERS.items():
        config = dataclasses.replace(CONFIG, **{field: value})
        changed = {n for n, rows in tables_of(spark, tables, config).items() if rows != base[n]}
        moved = {n for n, h in graph.hashes(config, {}).items() if h != first[n]}
        assert changed and changed <= moved, field


def test_hashes_of_what_follows():
    first = graph.hashes(CONFIG, {"readings": "1"})
    assert len(set(first.values())) == len(graph.NODES)
    moved = lambda other, given: {n for n, h in graph.hashes(other, given).items() if h != first[n]}
    assert moved(CONFIG, {"readings": "2"}) == {"readings", "hours", "observations", "operator"}
    assert moved(CONFIG, {"readings": "1", "inventory": "1"}) == {"inventory", "prior", "operator"}
    assert moved(dataclasses.replace(CONFIG, gamma=2.0, parallel=9, prior_base_std=1.0), {"readings": "1"}) == set()
    assert moved(dataclasses.replace(CONFIG, aggregate_obs=False), {"readings": "1"}) == {"observations", "operator"}
    assert graph.follows({"foot"}) == {"foot", "hours", "observations", "operator"} and graph.follows({"operator"}) == {"operator"}


def test_store(spark, tmp_path):
    tables, config = inversion_tables(spark), dataclasses.replace(CONFIG, cache=str(tmp_path / "cache"))
    with pytest.raises(ValueError, match="version"):
        assembly.store_of(spark, tables, config)
    tables.versions = {"readings": "a", "foot": "a"}

    def made(config):
        store = assembly.store_of(spark, tables, config)
        inputs = assembly.assembled(spark, tables, config, store)
        assert set(store.seconds) == set(store.known)
        return store.made, sorted(map(tuple, inputs.obs.collect()))

    everything = ["hours", "observations", "prior", "operator"]
    first = made(config)
    assert first[0] == everything and made(config) == ([], first[1])
    assert made(dataclasses.replace(config, gamma=3.0))[0] == []
    assert made(dataclasses.replace(config, prior_kwargs={"value": 0.5}))[0] == ["prior", "operator"]
    assert made(dataclasses.replace(config, cache_overwrite=("observations",)))[0] == ["observations", "operator"]
    assert made(dataclasses.replace(config, cache_overwrite=("all",))) == first
    (tmp_path / "cache" / "1" / "prior" / graph.hashes(config, given(tables))["prior"] / "_SUCCESS").unlink()
    assert made(config)[0] == ["prior"]  # its writing broke off
    tables.versions = {"readings": "b", "foot": "a"}
    assert made(config)[0] == ["hours", "observations", "operator"]
    with pytest.raises(ValueError, match="unknown"):
        made(dataclasses.replace(config, cache_overwrite=("nothing",)))


def given(tables):
    plain = {n: getattr(tables, n) for n in graph.PLAIN}
    return plain | {"events": [list(e) for e in tables.events]} | tables.versions
