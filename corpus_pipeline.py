"""Corpus pipeline: quality, near-duplicates, personal data, mixing, and encoding, over documents.

Each stage takes (spark, docs, sf_dir) and is written as Parquet before the next one reads it; all but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import minmax_dedup, mixing, pii, quality, sentencepiece_codec
from tallyspark.llm.common import stored, table
from tallyspark.llm.queries import SENTENCEPIECE_MODEL, TARGET_SHARES, surrogate_key


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the positive-unlabelled classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minmax_dedup.keep_one(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data; n_chars follows the text."""
    out = pii.with_surrogates(docs, surrogate_key(spark))
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Poor and toxic documents thinned by their fitted rates to their target shares; documents that are likely good all stay."""
    return mixing.resample(docs, table(spark, sf_dir, "labels"), TARGET_SHARES)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return sentencepiece_codec.encode_documents(docs, SENTENCEPIECE_MODEL)


STAGES = [("quality classifier", quality_stage), ("min-max near-dedup", dedup_stage), ("surrogates", pii_stage), ("mixing to target weights", mixing_stage), ("SentencePiece encoding", encoding_stage)]
#: Fitted models, near-duplicate search and token search have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
