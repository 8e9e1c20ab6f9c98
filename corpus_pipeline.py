"""A training corpus from raw documents: quality, toxicity, near copies, secrets, packing.

Each stage takes the documents that the one before kept, with all their columns, and works on all of them; what it
returns is written as Parquet and read again. Only the last one changes the columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorgrid.llm import near_copies, packing, quality, secret_scan, toxicity
from spoorgrid.session import shared_folder


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine doesn't reject: those that op10_quality calls good."""
    model = quality.train(docs, _labels(spark, sf_dir))
    return quality.score(docs, model, "_stage_quality").where(F.col("_stage_quality") >= quality.GOOD).drop("_stage_quality")


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of the weakly supervised labels doesn't call toxic."""
    model = toxicity.train(docs, _labels(spark, sf_dir))
    return toxicity.score(docs, model, "_stage_toxic").where("_stage_toxic < 0.5").drop("_stage_toxic")


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: candidates by the SimHash join of op9_simhash and by shingle minima, both held
    to a similarity of five-word shingles of 0.8 or more."""
    return near_copies.without_copies(docs, words=5, similarity=0.8)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret span masked; n_chars follows a text that changed."""
    masked = secret_scan.masked(docs.withColumn("_text_unmasked", F.col("text")))
    changed = ~F.col("text").eqNullSafe(F.col("_text_unmasked"))
    return masked.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", keep_good), ("toxicity", keep_civil), ("near_copies", keep_one_copy), ("secrets", mask_secrets), ("packing", pack)]
#: Models, sketches and tokens are beyond SQL; tests compare the stages with plain versions of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, from the documents of a table folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
