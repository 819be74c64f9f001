"""The registered queries of the training-data operators, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, exact_dedup, fill_in_middle, fingerprints, mixing, near_dedup, passages, quality, secrets, sentence_pieces, sharding, token_files, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), words=3, percent=85)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is; the files aren't part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.tokens_through_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_repeats(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode_and_decode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.document_secrets(table(spark, sf_dir, "documents"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.middle_digests(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_conversations(table(spark, sf_dir, "conversations"), damage=True)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_near_dedup, op3_fingerprints, op4_exact_dedup, op5_token_files, op6_quality, op7_repeated_passages, op8_toxicity, op9_sentence_pieces, op10_secret_scan, op11_sharding,
        op12_fill_in_middle, op13_conversation_repair,
    )
}
ORACLES: dict[str, str] = {
    "op1_mix_sources": mixing.SQL,
    "op2_near_dedup": near_dedup.SQL,
    "op4_exact_dedup": exact_dedup.SQL,
    "op7_repeated_passages": passages.SQL,
    "op10_secret_scan": secrets.SQL,
    "op11_sharding": sharding.SQL,
    "op12_fill_in_middle": fill_in_middle.SQL,
    "op13_conversation_repair": conversations.SQL,
}
