"""Exact deduplication with heavy hitters split off (operator 12), DataFrame functions only.

Texts are equal when they are identical after every blank (``[\\x20\\x09-\\x0D]``) is deleted; equality is
that of the SHA-256 of what is left.  Of equal texts the row with the most code points in the original
text stays, then the one with the smallest doc_id.

1. One pass over the texts writes a short row for each document: doc_id, length, digest, row number.
2. Misra-Gries counters (``DataFrame.freqItems``, the algorithm as found again by Karp, Shenker and
   Papadimitriou) run over the digests, ``COUNTERS`` in each task, and are merged.  Every digest with more
   than 1 / (COUNTERS + 1) of all rows is among them; others may be, too.
3. The candidates are verified: a second pass counts their rows exactly and finds the row of each that
   stays.  A task sends one row a candidate.
4. These winners, ``COUNTERS`` rows or so, are broadcast: rows of frequent digests are settled where they
   are read and never shuffled.  All other rows are grouped by digest in an ordinary shuffle, in which no
   digest has more than that share of the rows; only groups of two or more are joined back.

Edge cases: a null text counts as empty, and all empty and blank texts are equal; doc_id null is larger than
all others; repeated rows are copies of each other, and one of them stays; texts of any length are read
whole; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, written

COUNTERS = 512
ROW = "doc_id long, n_chars long, text_sha256 string, row long"


def digest(text: str = "text"):
    """Lowercase hex SHA-256 of the text without blanks."""
    return F.sha2(F.translate(F.coalesce(F.col(text), F.lit("")), BLANKS, ""), 256)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars (code points of the original text), text_sha256 and the row's own number, written."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"), F.length(text).cast("long").alias("n_chars"), digest().alias("text_sha256"), F.monotonically_increasing_id().alias("row")
    )
    return written(rows, "digests")


def candidates(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(h): hashes of at most ``counters`` digests, all of those with more than 1 / (counters + 1) of the rows."""
    found = rows.select(F.xxhash64("text_sha256").alias("h")).freqItems(["h"], 1 / counters)
    return written(found.select(F.explode("h_freqItems").alias("h")), "candidates")


def groups(rows: DataFrame) -> DataFrame:
    """text_sha256, group_size and the row that stays (first: length, doc_id, row) of every digest with two rows or more."""
    order = F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    found = rows.groupBy("text_sha256").agg(F.count("*").alias("group_size"), F.min(order).alias("first"))
    return found.where("group_size > 1")


def frequent(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The verified groups of the frequent digests: a row for each, so they may be sent to all tasks."""
    listed = F.broadcast(candidates(rows, counters))
    return written(groups(rows.withColumn("h", F.xxhash64("text_sha256")).join(listed, "h", "left_semi")), "frequent")


def exact_groups(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Every document with keep_id, group_size, kept; ``tied`` marks rows that equal the one that stays in
    doc_id, length and digest (itself, and its repetitions)."""
    rows = digests(docs)
    return settled(rows, frequent(rows, counters))


def settled(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    # Both come from tables in the shared folder; `heavy` has at most as many rows as there are counters.
    hot = rows.join(F.broadcast(heavy), "text_sha256")
    rest = rows.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti")
    cold = rest.join(written(groups(rest), "groups"), "text_sha256", "left")
    alone = F.col("group_size").isNull()
    same = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.less") == -F.col("n_chars"))
    return hot.unionByName(cold).select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("first.row") == F.col("row"))).alias("kept"),
        "text_sha256",
        "n_chars",
        (alone | same).alias("tied"),
    )


def without_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Copies of frequent texts go where they are read; what is left meets the list of rows that stay."""
    rows = digests(docs)
    heavy = frequent(rows, counters)
    keepers = settled(rows, heavy).where("tied").groupBy("doc_id", "n_chars", "text_sha256").agg(F.count("*").alias("times"))
    keepers = written(keepers.toDF("__id", "__n", "__sha", "times"), "keepers")
    text = F.coalesce(F.col("text"), F.lit(""))
    first = F.broadcast(heavy.select(F.col("text_sha256").alias("__sha"), F.col("first.doc_id").alias("__first"), F.lit(True).alias("__hot")))
    own = docs.withColumns({"__own": F.col("doc_id").cast("long"), "__n": F.length(text).cast("long"), "__sha": digest()})
    own = own.join(first, "__sha", "left").where(F.col("__hot").isNull() | F.col("__own").eqNullSafe(F.col("__first")))

    def taken(some: DataFrame) -> DataFrame:
        k = some.select("__id", F.col("__n").alias("__m"), F.col("__sha").alias("__hash"))
        return own.join(k, (F.col("__sha") == F.col("__hash")) & (F.col("__n") == F.col("__m")) & F.col("__own").eqNullSafe(F.col("__id")), "left_semi")

    again = keepers.where("times > 1")
    out = taken(keepers.where("times = 1"))
    if not again.isEmpty():  # repeated rows, the only ones whose copies still have to meet
        out = out.unionByName(taken(again).dropDuplicates(["__sha"]))
    return out.select(*docs.columns)


ORACLE_SQL = r"""
with d as (select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as text_sha256 from documents),
g as (select text_sha256, count(*) as group_size, arg_min(doc_id, struct_pack(a := -n, b := doc_id)) as keep_id from d group by 1)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from d join g using (text_sha256)
"""
