"""Registered queries of the operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorgrid.llm import (
    curve_search, embedding_dedup, language_id, lexical_search, packing, period_runs, quality, secret_scan, sentencepiece_scan, sharding, simhash,
    token_counts, toxicity)
from spoorgrid.llm.common import documents


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_scan.round_trip(documents(spark, sf_dir))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), n_shards=40)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.95)


def op6_curve_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve_search.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, k=20)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), words=3, bits=3)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), documents(spark, sf_dir), k=20)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), limit=512)


def op13_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period_runs.periodic_runs(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_packing, op2_sentencepiece, op3_sharding, op4_language_id, op5_embedding_dedup, op6_curve_search, op7_secret_scan,
    op8_toxicity, op9_simhash, op10_quality, op11_lexical_search, op12_token_counts, op13_period_runs)}
#: The others are not expressible in SQL as a whole: each is tested against brute force, a library or held-out rows.
SQL: dict[str, str] = {"op11_lexical_search": lexical_search.SQL}
