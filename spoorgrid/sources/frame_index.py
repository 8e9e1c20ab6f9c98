"""Frame tables: listing, consistency checks, strides and sequence splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def list_frames(spark: SparkSession, root: str, modality: str, suffix: str) -> DataFrame:
    """Frame files of one modality as (sequence, frame_idx, path); contents are not read.

    Files are laid out as <root>/<sequence>/<modality>/<six digits>.<suffix>.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}")
             .load(f"{root}/*/{modality}").select("path"))
    pattern = rf"([^/]+)/{modality}/(\d{{6}})\.{suffix}$"
    return files.select(F.regexp_extract("path", pattern, 1).alias("sequence"),
                        F.regexp_extract("path", pattern, 2).cast("int").alias("frame_idx"),
                        F.lit(modality).alias("modality"), "path")


def frame_checks(frames: DataFrame, keys=("sequence",)) -> DataFrame:
    """Per key: frame count, index range, contiguity and uniqueness."""
    per_frame = frames.groupBy(*keys, "frame_idx").agg(F.count("*").alias("_n"))
    return per_frame.groupBy(*keys).agg(
        F.sum("_n").alias("frames"), F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"),
        (F.count("*") == F.max("frame_idx") - F.min("frame_idx") + 1).alias("contiguous"),
        (F.max("_n") == 1).alias("unique_frames"))


def modality_violations(files: DataFrame) -> DataFrame:
    """Sequences whose modalities differ in count, do not start at zero or have holes; empty when consistent."""
    per = frame_checks(files, ("sequence", "modality"))
    bad = ~F.col("contiguous") | ~F.col("unique_frames") | (F.col("first_frame") != 0)
    total = files.groupBy("sequence").agg(F.max("frame_idx").alias("_last"))
    return per.join(total, "sequence").where(bad | (F.col("last_frame") != F.col("_last"))).drop("_last")


def time_mismatches(left: DataFrame, right: DataFrame, tolerance: float = 1.0e-6) -> DataFrame:
    """Frames missing on one side or whose time stamps differ by more than the tolerance."""
    r = right.withColumnRenamed("ts_sec", "_other")
    both = left.join(r, ["sequence", "frame_idx"], "full_outer")
    return both.where(F.col("ts_sec").isNull() | F.col("_other").isNull()
                      | (F.abs(F.col("ts_sec") - F.col("_other")) > tolerance))


def require_empty(df: DataFrame, message: str) -> None:
    """Raise when a violations table has any row (reads at most one)."""
    first = df.limit(1).collect()
    if first:
        raise ValueError(f"{message}: {first[0]}")


def select_frames(frames: DataFrame, start: int, count: int, stride: int, bound: str = "index") -> DataFrame:
    """Strided frames from `start`; `count` bounds the index range or, with bound='count', the rows kept."""
    out = frames.where((F.col("frame_idx") >= start) & (F.pmod(F.col("frame_idx") - start, F.lit(stride)) == 0))
    if bound == "index":
        return out.where(F.col("frame_idx") < start + count)
    w = Window.partitionBy("sequence").orderBy("frame_idx")
    return out.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= count).drop("_rn")


def split_sequences(sequences: DataFrame, name: str, explicit: str | None = None, names: list | None = None) -> DataFrame:
    """Add `split`: an explicit column ('val' means validation), a list of names, or the last sequence.

    An empty side is an error at run time.
    """
    if explicit:
        is_val = F.lower(F.coalesce(F.col(explicit), F.lit("train"))) == "val"
    elif names:
        is_val = F.col(name).isin(*names)
    else:
        is_val = F.col(name) == sequences.agg(F.max(name)).scalar()
    flagged = sequences.withColumn("_val", is_val)
    counts = flagged.agg(F.count_if("_val").alias("v"), F.count_if(~F.col("_val")).alias("t"))
    ok = counts.select((F.col("v") > 0) & (F.col("t") > 0)).scalar()
    split = F.when(F.col("_val"), "validation").otherwise("train")
    guarded = F.when(ok, split).otherwise(F.raise_error(F.lit("a split side is empty")).cast("string"))
    return flagged.withColumn("split", guarded).drop("_val")
