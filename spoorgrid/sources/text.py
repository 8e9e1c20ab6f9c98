"""Text sources: trajectories, inertial series, frame times, calibration files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorgrid.functions.pose import pose_from_quaternion
from spoorgrid.operators.chunks import dense_ordinal

_NAME = r"([^/]+)/[^/]+$"


def read_numbers(spark: SparkSession, path: str, names: list[str], sequence: str = _NAME) -> DataFrame:
    """Whitespace-separated numbers with a fixed column count; any other line is an error. '#' lines are skipped."""
    lines = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), sequence, 1).alias("sequence"), F.trim("value").alias("_t"))
    lines = lines.where((F.col("_t") != "") & ~F.col("_t").startswith("#"))
    parts = F.split("_t", r"\s+")
    checked = F.when(F.size(parts) == len(names), parts).otherwise(
        F.raise_error(F.concat(F.lit(f"expected {len(names)} values: "), F.col("_t"))).cast("array<string>"))
    return lines.select("sequence", checked.alias("_p")).select("sequence", *[F.col("_p")[i].cast("double").alias(n) for i, n in enumerate(names)])


def read_trajectory(spark: SparkSession, path: str) -> DataFrame:
    """poses(sequence, frame_idx, ts_sec, px..qw, pose); frames are numbered in time order."""
    names = ["ts_sec", "px", "py", "pz", "qx", "qy", "qz", "qw"]
    rows = dense_ordinal(read_numbers(spark, path, names), ["sequence"], "ts_sec", F.floor(F.col("ts_sec") / 600.0), "frame_idx")
    return rows.withColumn("frame_idx", F.col("frame_idx").cast("int")).withColumn("pose", pose_from_quaternion(*names[1:]))


def read_imu(spark: SparkSession, path: str) -> DataFrame:
    """imu(sequence, ts_sec, gx, gy, gz, ax, ay, az)."""
    return read_numbers(spark, path, ["ts_sec", "gx", "gy", "gz", "ax", "ay", "az"])


def read_frame_times(spark: SparkSession, path: str) -> DataFrame:
    """frames(sequence, frame_idx, ts_sec)."""
    rows = read_numbers(spark, path, ["ts_sec"])
    return dense_ordinal(rows, ["sequence"], "ts_sec", F.floor(F.col("ts_sec") / 600.0), "frame_idx").withColumn(
        "frame_idx", F.col("frame_idx").cast("int"))


def read_calibration_entries(spark: SparkSession, path: str, calib_id: str = r"([^/]+)$") -> DataFrame:
    """(calib_id, key, value) of `key: value` or `key = value` lines; comments are skipped, other lines are errors. `calib_id` is a pattern
    of its place in the file's path."""
    lines = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), calib_id, 1).alias("calib_id"), F.trim("value").alias("_t"))
    lines = lines.where((F.col("_t") != "") & ~F.col("_t").startswith("#"))
    pattern = r"^([^:=]+?)\s*[:=]\s*(.+)$"
    ok = F.when(F.col("_t").rlike(pattern), F.col("_t")).otherwise(
        F.raise_error(F.concat(F.lit("unsupported calibration line: "), F.col("_t"))).cast("string"))
    return lines.select("calib_id", ok.alias("_t")).select("calib_id", F.regexp_extract("_t", pattern, 1).alias("key"),
                                                           F.trim(F.regexp_replace(F.regexp_extract("_t", pattern, 2), '^"|"$', "")).alias("value"))


def _need(prefix: str, name: str, kind: str) -> Column:
    value = F.max(F.when(F.col("key") == f"{prefix}.{name}", F.col("value")))
    present = F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(f"missing calibration field {prefix}.{name}")).cast("string"))
    return (F.from_json(present, "array<double>") if kind == "array" else present.cast(kind)).alias(name)


def cameras(entries: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """cameras(calib_id, camera, fx, fy, cx, cy, width, height, k1, k2, p1, p2, k3); `prefixes` maps camera to key prefix."""
    out = None
    for camera, prefix in prefixes.items():
        one = entries.groupBy("calib_id").agg(*[_need(prefix, n, "double") for n in ("fx", "fy", "cx", "cy")],
                                              *[_need(prefix, n, "int") for n in ("width", "height")], _need(prefix, "D", "array"))
        one = one.select("calib_id", F.lit(camera).alias("camera"), "fx", "fy", "cx", "cy", "width", "height",
                         *[F.col("D")[i].alias(n) for i, n in enumerate(("k1", "k2", "p1", "p2", "k3"))])
        out = one if out is None else out.unionByName(one)
    return out


def transforms(entries: DataFrame, names: list[str]) -> DataFrame:
    """transforms(calib_id, name, pose) of pose fields px..qw under each name."""
    fields = ("px", "py", "pz", "qx", "qy", "qz", "qw")
    out = None
    for name in names:
        one = entries.groupBy("calib_id").agg(*[_need(name, f, "double") for f in fields]).select(
            "calib_id", F.lit(name).alias("name"), pose_from_quaternion(*fields).alias("pose"))
        out = one if out is None else out.unionByName(one)
    return out
