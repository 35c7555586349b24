"""A corpus from raw documents to packed sequences; every stage is one operator of :mod:`shelfspark.llm`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfspark.llm import mixing, near_copies, packing, quality_crf, quality_rules
from shelfspark.llm.queries import TOKENIZER, table
from shelfspark.llm.scratch import rows_per_batch, written

ROWS_PER_BATCH = 512


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as good; the model learns from the labelled ones among them."""
    return quality_crf.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies, the one with the smallest id.

    Near-copies share 0.8 or more of their five-word shingles.
    """
    return near_copies.keep_one(docs, shingle=5, least=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs, weights=(1, 2, 3), max_repeat=3)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens.

    The rows are few and short, so they are written here, while the texts go to Python in small batches.
    """
    with rows_per_batch(spark, ROWS_PER_BATCH):
        return written(packing.pack(docs, TOKENIZER, window=2048, end_id=1), "packed")


STAGES = [
    ("quality_rules", apply_quality_rules),
    ("quality_classifier", classify_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Fingerprints, fitted models, sampling and packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read by the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
