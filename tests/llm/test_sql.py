"""Corpus queries with SQL against DuckDB, on the smallest tables; the other queries run and give whole tables."""

import duckdb
import pytest

pytest.importorskip("public_tokenizers")

from airflux.llm import queries  # noqa: E402

from ..test_oracle import rows  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(con.sql(queries.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_whole_table(spark, name):
    got = queries.QUERIES[name](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    if "doc_id" in got.columns:
        assert got.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    else:
        assert got.selectExpr("explode(doc_ids) as d").distinct().count() == docs.select("doc_id").distinct().count()
