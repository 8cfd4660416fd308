"""One query per operator, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, hilbert, hyperminhash, langid, merkle, ogg, oracle, packing, pieces, quality, repeats, search, urls
from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op2_packed_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_matrices(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), prior=quality.PRIOR)


def op5_url_list_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = urls.temporal_list_join(urls.captures_of(pages), urls.listed_history(pages))
    return out.withColumns({c: F.col(c).cast("string") for c in ("day", "active_since")})


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.hilbert_shards(table(spark, sf_dir, "documents"))


def op9_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.ogg_features(ogg.with_ogg(table(spark, sf_dir, "documents")))


def op4_piece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op7_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed_repeats(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_check(table(spark, sf_dir, "documents"))


def op12_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_packed_matrices,
        op3_near_duplicates,
        op4_piece_viterbi,
        op5_url_list_join,
        op6_hilbert_shards,
        op7_repeated_strings,
        op8_best_fit_packing,
        op9_ogg_media,
        op10_language_spans,
        op11_merkle_manifest,
        op12_exact_copies,
        op13_ranked_search,
    )
}
ORACLE: dict[str, str] = {
    "op3_near_duplicates": oracle.NEAR_DUPLICATES,
    "op5_url_list_join": urls.ORACLE_SQL,
    "op7_repeated_strings": oracle.REPEATED_STRINGS,
    "op11_merkle_manifest": merkle.ORACLE_SQL,
    "op12_exact_copies": exact.ORACLE_SQL,
    "op13_ranked_search": search.ORACLE_SQL,
}
