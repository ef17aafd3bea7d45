"""The corpus pipeline: quality, near duplicates, repeated passages, secrets, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lithoframe.llm import packing, quality, repeats, secrets, simhash
from lithoframe.llm.common import bounded_batches, documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    bounded_batches(spark)
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, a cosine (the similarity that SimHash measures) of 0.8 or more."""
    bounded_batches(spark)
    return simhash.keep_one(docs, words=5, percent=80, measure="cosine", recall=0.9)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur elsewhere go from the texts: strings of 240 bytes, shorter than 51 words of prose."""
    bounded_batches(spark)
    return repeats.remove_repeats(docs, length=240)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts."""
    bounded_batches(spark)
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    bounded_batches(spark)
    p = public_tokenizers
    return packing.pack_documents(docs, p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN)


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_dedup), ("suffix-array dedup", passage_dedup), ("secret scans", secret_scan), ("packing", pack)]

#: the measures, fingerprints and tokens of the stages can't be expressed in SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
