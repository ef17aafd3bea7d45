"""The queries of the training-data operators, with the parameters they run with in production."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lithoframe.llm import bpe, licenses, packing, quality, repeats, secrets, sharding, simhash, tiff, token_counts
from lithoframe.llm.common import documents

MULTI = "byte_bpe_multi_50k.tiktoken"


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_table(licenses.document_paths(documents(spark, sf_dir)))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes go; passages of 240, shorter than 51 words of prose, are reported beside them."""
    return repeats.repeats_table(documents(spark, sf_dir), length=400, also=240)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_table(documents(spark, sf_dir), words=3, radius=3)


def op4_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.store_texts(documents(spark, sf_dir))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_table(documents(spark, sf_dir))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_texts(documents(spark, sf_dir), public_tokenizers.path(MULTI), public_tokenizers.PATTERN)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(documents(spark, sf_dir), shards=16)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_table(documents(spark, sf_dir), public_tokenizers.path(MULTI), public_tokenizers.PATTERN)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_table(documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = public_tokenizers
    return packing.pack_documents(documents(spark, sf_dir), p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN)


QUERIES = {f.__name__: f for f in (op1_licenses, op2_suffix_dedup, op3_simhash, op4_media_tiff, op5_quality, op6_byte_bpe, op7_sharding, op8_token_counts, op9_secrets, op10_packing)}
ORACLES: dict[str, str] = {"op9_secrets": secrets.ORACLE_SQL}
