"""The training-data pipeline: each stage takes what the one before it kept.

Quality classifier, exact deduplication, near deduplication, mixing to target weights, and BPE. Every stage
is written as Parquet to the shared folder and read again, which cuts the lineage: after a lost executor
only the running stage is computed again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm import bpe, exact_dedup, mixing, near_dedup, quality
from corpusforge.llm.common import documents, materialise


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from labels, does not reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity 0.8 or more."""
    return near_dedup.near_dedup(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mixture of sources takes them."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count, and digests of the token ids and of their decoding, for each document taken."""
    encoded = docs.select("doc_id", "source", bpe.round_trip(spark, bpe.default_tokenizer(), F.col("text")).alias("r"))
    return encoded.select("doc_id", "source", "r.*")


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", tokens),
]
#: The classifier and MinHash have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
