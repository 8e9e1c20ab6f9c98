"""Table persistence: descriptor banks and map stores, fingerprinted results, report sinks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_bank(descriptors: DataFrame, path: str, files_per_map: int = 64) -> None:
    """Descriptors (map_id, patch_id, model_id, embedding) as Parquet, partitioned by map, each written by several tasks."""
    (descriptors.withColumn("embedding", F.col("embedding").cast("array<float>"))
     .repartition("map_id", F.pmod(F.xxhash64("patch_id"), F.lit(files_per_map))).sortWithinPartitions("patch_id").write.mode("overwrite").partitionBy("map_id").parquet(path))


def load_bank(spark: SparkSession, path: str, map_id: str | None = None) -> DataFrame:
    """The bank, or one map of it by partition pruning."""
    bank = spark.read.parquet(path)
    return bank if map_id is None else bank.where(F.col("map_id") == map_id)


def save_store(store: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Cell stores, label histograms and map lookups."""
    writer = store.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def fingerprint(spark: SparkSession, sources: list[str], params: dict) -> str:
    """md5 over parameters and the path, time and size of every source file (order-free, contents unread)."""
    marks = []
    for s in sources:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(s).select("path", "modificationTime", "length")
        row = files.agg(F.count("*").alias("n"), F.sum("length").alias("b"),
                        F.bit_xor(F.xxhash64("path", "modificationTime", "length")).alias("x")).first()
        marks.append([s, row.n, row.b, row.x])
    return hashlib.md5(json.dumps([marks, params], sort_keys=True).encode()).hexdigest()


def build_or_load(spark: SparkSession, root: str, sources: list[str], params: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The table under its fingerprint; built and written only when a finished one is not there yet."""
    path = f"{root}/{fingerprint(spark, sources, params)}"
    try:
        spark.read.schema("done boolean").parquet(f"{path}/done")
    except AnalysisException:  # written last, so an unfinished table has none
        build().write.mode("overwrite").parquet(f"{path}/table")
        spark.range(1).select(F.lit(True).alias("done")).write.mode("overwrite").parquet(f"{path}/done")
    return spark.read.parquet(f"{path}/table")


def write_report(summary: DataFrame, rows: DataFrame, path: str, run_id: str) -> None:
    """Summary as JSON and rows as CSV under the run."""
    summary.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").json(f"{path}/summary/run_id={run_id}")
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/rows/run_id={run_id}")


def write_cell_csv(initial: DataFrame, updated: DataFrame, size: float, min_observations: float, path: str) -> None:
    """Cells of two stores side by side with scores, zero where a store lacks the cell."""
    from spoorgrid.operators.vote import stability

    names = ("observed", "n_static", "n_semi", "n_dynamic")
    a = initial.select("ix", "iy", *[F.col(n).alias("a_" + n) for n in names])
    b = updated.select("ix", "iy", *[F.col(n).alias("b_" + n) for n in names])
    j = a.join(b, ["ix", "iy"], "full_outer").fillna(0, [p + n for p in ("a_", "b_") for n in names])
    out = j.select("ix", "iy", (F.col("ix") * size).alias("x_min"), (F.col("iy") * size).alias("y_min"), *[p + n for p in ("a_", "b_") for n in names],
                   stability(min_observations, "a_").alias("initial_stability"), stability(min_observations, "b_").alias("updated_stability"))
    out.write.mode("overwrite").option("header", True).csv(path)
