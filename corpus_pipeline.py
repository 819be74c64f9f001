"""The corpus pipeline: each stage works on all that the one before it kept.

Quality classifier, exact dedup, near dedup, mixing to target weights, SentencePiece ids. Between stages ``run`` writes Parquet to the
folder that the session's spark.checkpoint.dir names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import exact_dedup, mixing, near_dedup, quality, sentence_pieces
from veilspark.llm.common import materialize, table
from veilspark.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't predict to be of low quality. Each row is judged by its text; nulls, empty texts, repeated rows and
    empty tables as in ``quality.good_documents``."""
    small_batches(spark)
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, null and empty ones being equal; ties, repeated rows and empty tables as in ``drop_exact_copies``."""
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more. Rows without id and texts without words stay; repeated ids and
    empty tables as in ``drop_near_copies``."""
    return near_dedup.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row that the mix takes twice is there twice; one that it doesn't take is gone, as is any without words. Null sources and ids, repeated
    rows and empty tables as in ``mixed_documents``."""
    return mixing.mixed_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every row's whole text; nulls, repeated rows and empty tables as in ``encode_and_decode``."""
    small_batches(spark)
    return sentence_pieces.encode_and_decode(docs, tokenizer_path("piece_bpe_32k.model"))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 documents in this application's session: both sides hold a batch of whole texts several times over."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


STAGES = [("quality classifier", keep_quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("SentencePiece", pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier and the tokenizer can't be written in SQL; tests hold each stage against brute force.
ORACLE_SQL = None
