"""The training-data queries: one for each operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audio, bpe, langid, licenses, neardup, packing, secrets, sharding, sql, urls
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_collision_ann(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "embeddings")
    return ann.nearest(df, F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)), 20)


def op2_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    return secrets.scan(table(spark, d, "documents"))


def op3_license_scan(spark: SparkSession, d: str) -> DataFrame:
    return licenses.scan(table(spark, d, "documents"))


def op4_hilbert_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_url_filter(spark: SparkSession, d: str) -> DataFrame:
    return urls.judge(table(spark, d, "pages"))


def op6_bagminhash(spark: SparkSession, d: str) -> DataFrame:
    return neardup.classes(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "class_id", "class_size", F.col("first").alias("stays"))


def op7_mpeg_audio(spark: SparkSession, d: str) -> DataFrame:
    return audio.store_column(table(spark, d, "documents"))


def op8_rendezvous_sharding(spark: SparkSession, d: str) -> DataFrame:
    return sharding.assign(table(spark, d, "documents"), "doc_id", "text", [1.0] * 8)


def op9_language_id(spark: SparkSession, d: str) -> DataFrame:
    return langid.identify(table(spark, d, "documents"))


def op10_tree_bpe(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_column(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def pipeline(spark: SparkSession, d: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)


def queries() -> dict[str, Query]:
    ops = (op1_collision_ann, op2_secret_scan, op3_license_scan, op4_hilbert_packing, op5_url_filter, op6_bagminhash, op7_mpeg_audio, op8_rendezvous_sharding, op9_language_id, op10_tree_bpe)
    return {f.__name__: f for f in ops} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    """Rules and models of characters, classes and shards have SQL; networks, forests, checksums of media and tokenizers don't: tests/llm holds those against brute force."""
    return dict(sql.SQL)
