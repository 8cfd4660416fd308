"""Corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before kept; all
but the last return the columns of ``documents``; further columns of the input, whatever their
names, are dropped.  A row is known by its doc_id and its text: rows that share a doc_id (or have
none) are judged apart where their texts differ.  Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airflux.llm import hyperminhash, langid, packing, quality, repeats
from airflux.llm.common import table, written
from airflux.llm.queries import tokenizer_path

LEAST_SHARE = 0.34  # of letters in the language of the document

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null, empty and blank texts fail the base rules and go; rows with the same doc_id and text share their
    verdict and stay or go together, at a tie with the threshold they stay."""
    docs = docs.select(*COLUMNS)
    verdict = quality.quality_rules(docs, table(spark, sf_dir, "labels"), prior=quality.PRIOR)
    gone = verdict.where(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    same = docs["doc_id"].eqNullSafe(gone["__id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["__hash"])
    return docs.join(gone, same, "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of undetermined language go, and those without a leading one.

    Null texts and texts without a letter are undetermined; equal scores go to the language first in the
    alphabet; repeated rows stay or go together, each in its own right."""
    labelled = langid.language_id(docs.select(*COLUMNS), carry=True)
    fine = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SHARE)
    return labelled.where(fine).select(*(F.col("row")[c].alias(c) for c in COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the least doc_id.

    A null doc_id is larger than all others; of rows that share a doc_id the least text hash stays, of
    repeated rows one.  Texts without words are in no group: all of them stay."""
    return hyperminhash.one_of_each(docs.select(*COLUMNS))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that a document with a smaller doc_id has, too, are cut out of the texts.

    Every row stays.  A null doc_id is larger than all others; rows with equal doc_ids cut nothing out of
    each other; null texts become empty, texts that are cut out whole, too."""
    left = repeats.removed_repeats(docs.select(*COLUMNS), keep_text=True, carry=True)
    return left.select(
        "doc_id", "text", F.col("row.lang").alias("lang"), F.col("row.source").alias("source"), F.length("text").cast("long").alias("n_chars")
    )


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces packed into sequences of at most 2048 tokens.

    A null or empty text is one piece of one token; repeated rows are packed as often as they occur."""
    return packing.best_fit_packing(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: The stages learn models and run a tokenizer, which SQL cannot; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
