"""Queries that take their tables whole: every day of events has entries and products."""

from airflux import queries

SF = "/root/testdata/sf0.001"


def test_covariances_cover_every_day(spark):
    hours = {tuple(r) for r in spark.read.parquet(f"{SF}/events.parquet").selectExpr("event_type", "cast(date_trunc('HOUR', ts) as timestamp_ntz)").distinct().collect()}
    product = queries.QUERIES["mdm_product"](spark, SF).collect()
    entries = queries.QUERIES["mdm_block_cov"](spark, SF).where("time_i = time_j").collect()
    assert {(r["obs_location"], r["obs_time"]) for r in product} == hours
    assert {(r["obs_location"], r["time_i"]) for r in entries} == hours


def test_coverage_decides_the_cells(spark):
    """A cell is removed if and only if coverage_filter drops it; all others have a posterior."""
    cover = {r["cell"]: r["kept"] for r in queries.QUERIES["coverage_filter"](spark, SF).collect()}
    removed = {r["cell"] for r in queries.QUERIES["removed_cells"](spark, SF).collect()}
    assert removed and {c for c, kept in cover.items() if not kept} <= removed and not {c for c, kept in cover.items() if kept} & removed
    mean = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/lineitem.parquet").groupBy("l_partkey").avg("l_extendedprice").collect()}
    prior = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_retailprice").collect()}
    for cell, value in queries.QUERIES["reconstruct_prior"](spark, SF).collect():
        want = mean[cell] if cell in mean and cover[cell % 90] else prior[cell]
        assert abs(value - want) < 1e-5
