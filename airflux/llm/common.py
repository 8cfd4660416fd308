"""Small shared helpers: reading tables, words, and bucketed tables in the cluster's shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import shared_dir, written

__all__ = ["bucketed", "let", "shared_dir", "table", "words_of", "written"]

BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null and blank texts give an empty one."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """``df`` as an external table in the shared folder, bucketed by ``key``: later joins on it move the
    other side only."""
    spark = df.sparkSession
    table_name = f"{name}_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.format("parquet").option("path", f"{shared_dir(spark)}/{table_name}")
    writer.bucketBy(buckets, key).saveAsTable(table_name)
    return spark.table(table_name)
