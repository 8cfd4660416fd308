"""Every registered base query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from airflux import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list:
    def text(x):
        if x is None or (not isinstance(x, (list, dict)) and pd.isna(x)):
            return "null"
        return f"{x:.6g}" if isinstance(x, float) else str(x)

    df = df[sorted(df.columns)]
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df = df.assign(**{c: df[c].astype(str)})
    return sorted(map(tuple, df.map(text).values.tolist()))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows(spark, db, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = db.sql(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
