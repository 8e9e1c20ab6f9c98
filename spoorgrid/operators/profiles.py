"""Profiles of sequences, maps and plain value columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorgrid.functions import pose as P
from spoorgrid.operators.chunks import CHUNK_ROWS, lagged
from spoorgrid.operators.quantiles import with_quantiles


def value_summary(df: DataFrame, keys: list[str], value: str, suffix: str) -> DataFrame:
    """min, max, mean and median of a column; NULLs when there is no value."""
    base = df.groupBy(*keys).agg(F.min(value).alias(f"min_{suffix}"), F.max(value).alias(f"max_{suffix}"),
                                 F.avg(value).alias(f"mean_{suffix}"))
    return with_quantiles(base, df, keys, value, {f"median_{suffix}": 0.5})


def step_deltas(frames: DataFrame, chunk: int = CHUNK_ROWS) -> DataFrame:
    """Time step, planar step length and wrapped yaw step from the previous frame (NULL for the first)."""
    out = lagged(frames, ["sequence"], "frame_idx",
                 {"_t": ("ts_sec", 1), "_x": ("gt_x", 1), "_y": ("gt_y", 1), "_w": ("gt_yaw", 1)}, chunk)
    return out.withColumns({"dt": F.col("ts_sec") - F.col("_t"), "step": P.xy_error("gt_x", "gt_y", "_x", "_y"),
                            "dyaw": P.wrap_to_pi(F.col("gt_yaw") - F.col("_w"))}).drop("_t", "_x", "_y", "_w")


def sequence_profile(frames: DataFrame, chunk: int = CHUNK_ROWS) -> DataFrame:
    """Duration, frame rate, sampling frequency from the median positive time step, extents and steps."""
    d = step_deltas(frames, chunk)
    span = F.max("ts_sec") - F.min("ts_sec")
    out = d.groupBy("sequence").agg(
        F.count("*").alias("frames"), span.alias("duration"),
        F.when(span > 0, (F.count("*") - 1) / span).alias("rate_hz"),
        F.min("gt_x").alias("min_x"), F.max("gt_x").alias("max_x"), F.avg("step").alias("mean_step"),
        F.max("step").alias("max_step"), F.min("dyaw").alias("min_dyaw"), F.max("dyaw").alias("max_dyaw"))
    out = with_quantiles(out, d, ["sequence"], "step", {"median_step": 0.5})
    out = with_quantiles(out, d.where("dt > 0"), ["sequence"], "dt", {"_mdt": 0.5})
    return out.withColumn("median_hz", 1.0 / F.col("_mdt")).drop("_mdt")


def map_profile(points: DataFrame, normals: tuple | None = None) -> DataFrame:
    """Count, bounds, extents and (with normals) the mean normal length of a map."""
    aggs = [F.count("*").alias("points")]
    for c in ("x", "y", "z"):
        aggs += [F.min(c).alias(f"{c}0"), F.max(c).alias(f"{c}1"), (F.max(c) - F.min(c)).alias(f"extent_{c}")]
    if normals:
        nx, ny, nz = (F.col(n) for n in normals)
        aggs.append(F.avg(F.sqrt(nx * nx + ny * ny + nz * nz)).alias("normal_norm"))
    return points.agg(*aggs)
