"""Label images as pixel rows: ratios, dilation, point labels, dynamic filters, overlap quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorgrid.functions import camera as C
from spoorgrid.functions import pose as P
from spoorgrid.session import cut, dealt

FRAME = ["sequence", "frame_idx"]
D5 = ["k1", "k2", "p1", "p2", "k3"]


def label_ratios(pixels: DataFrame, frames: DataFrame, sets: dict[str, tuple]) -> DataFrame:
    """Share of pixels in each label set, the larger of the cameras; 0 for frames without an image."""
    per = pixels.groupBy(*FRAME, "camera").agg(
        *[F.avg(F.col("label").isin(*s).cast("double")).alias(n) for n, s in sets.items()])
    best = per.groupBy(*FRAME).agg(*[F.max(n).alias(n) for n in sets])
    return frames.select(*FRAME).join(best, FRAME, "left").select(
        *FRAME, *[F.coalesce(n, F.lit(0.0)).alias(n) for n in sets])


def dilated(pixels: DataFrame, sets: dict[str, tuple], radius: int, width: int, height: int) -> DataFrame:
    """Pixels covered by any label set after a square dilation, with one flag per set, clipped to the image.

    All sets share one pass. The dilation is separable: columns first, then rows, combined in between.
    """
    every = sorted({label for s in sets.values() for label in s})
    hit = pixels.where(F.col("label").isin(*every)).select(
        *FRAME, "camera", "u", "v", *[F.col("label").isin(*s).alias(n) for n, s in sets.items()])
    side = range(-radius, radius + 1)
    hit = cut(hit)
    hit = dealt(hit, hit.count() * len(side), *FRAME, "camera")  # an image stays together, so its aggregates need no further shuffle
    for axis, size in (("u", width), ("v", height)):
        if radius > 0:
            hit = hit.withColumn(axis, F.explode(F.array(*[F.col(axis) + i for i in side])))
            hit = hit.where(F.col(axis).between(0, size - 1))
        if radius > 0 or axis == "v":
            hit = hit.groupBy(*FRAME, "camera", "u", "v").agg(*[F.max(n).alias(n) for n in sets])
    return hit


def with_pixels(points: DataFrame, cameras: DataFrame, camera: str) -> DataFrame:
    """Add the integer pixel `u_<camera>`, `v_<camera>` of each point (NULL when not visible).

    `cameras` holds one row per (sequence, camera): a small dimension with `cam_pose` and intrinsics.
    """
    cam = cameras.where(F.col("camera") == camera).drop("camera")
    j = points.join(cam, "sequence", "left")
    x, y, z = P.apply_pose("cam_pose", "x", "y", "z")
    j = j.withColumns({"_x": x, "_y": y, "_z": z})
    u, v = C.project_distorted("_x", "_y", "_z", "fx", "fy", "cx", "cy", D5)
    j = j.withColumns({"_u": u, "_v": v})
    ui, vi = C.pixel_index(F.col("_u"), F.col("_v"), "width", "height")
    return j.select(*points.columns, ui.alias(f"u_{camera}"), vi.alias(f"v_{camera}"))


def with_lookup(points: DataFrame, table: DataFrame, camera: str, values: dict[str, str], rows: int = 0) -> DataFrame:
    """Attach pixel columns (`name -> column`) of one camera's image to the points that fall on a pixel. `rows`: how many points there are,
    if known; many are dealt to more tasks."""
    t = table.where(F.col("camera") == camera).select(
        *FRAME, F.col("u").alias(f"u_{camera}"), F.col("v").alias(f"v_{camera}"), *[F.col(c).alias(n) for n, c in values.items()])
    at = [*FRAME, f"u_{camera}", f"v_{camera}"]
    return dealt(points, rows, *at).join(t, at, "left")


def _seen(points: DataFrame, cameras: DataFrame) -> DataFrame:
    """Pixels of both cameras at once, so that a position which nobody reads later is not shuffled."""
    return with_pixels(with_pixels(points, cameras, "left"), cameras, "right")


def stereo_labels(points: DataFrame, pixels: DataFrame, cameras: DataFrame) -> DataFrame:
    """Label per point: the left image if it shows the point, else the right, else -1 (0 is a valid label)."""
    out, rows = _seen(points, cameras), points.count()
    for cam in ("left", "right"):
        out = with_lookup(out, pixels, cam, {f"label_{cam}": "label"}, rows)
    return out.withColumn("point_label", F.coalesce("label_left", "label_right", F.lit(-1)))


def mask_hits(points: DataFrame, masks: DataFrame, names: list[str], cameras: DataFrame) -> DataFrame:
    """Add one boolean per flag of a mask table: TRUE where either camera sees the point on a flagged pixel."""
    out, rows = _seen(points, cameras), points.count()
    for cam in ("left", "right"):
        out = with_lookup(out, masks, cam, {f"_{n}_{cam}": n for n in names}, rows)
    return out.withColumns({n: F.coalesce(f"_{n}_left", F.lit(False)) | F.coalesce(f"_{n}_right", F.lit(False))
                            for n in names}).select(*points.columns, *names)


def exposure_decision(flagged: DataFrame, threshold: float) -> DataFrame:
    """Per frame: point share in semi-dynamic masks and whether it triggers the stricter filter (>=)."""
    out = flagged.groupBy(*FRAME).agg(F.avg(F.col("semi").cast("double")).alias("semi_ratio"))
    return out.withColumn("triggered", F.col("semi_ratio") >= F.lit(float(threshold)))


def query_points(flagged: DataFrame, decisions: DataFrame, filter_without_trigger: bool = True) -> DataFrame:
    """Points kept for matching: dynamic ones go, semi-dynamic ones too where the frame is triggered."""
    j = flagged.join(decisions, FRAME)
    drop_dynamic = F.col("dynamic") & (F.col("triggered") | F.lit(filter_without_trigger))
    return j.where(~drop_dynamic & ~(F.col("semi") & F.col("triggered")))


def mask_overlap(pairs: DataFrame, predicted: str, target: str, keys: list[str] | None = None) -> DataFrame:
    """Pixel IoU, pixel recall and image recall of a predicted mask over paired pixels."""
    keys = keys or []
    p, t = F.col(predicted), F.col(target)
    per = pairs.groupBy(*keys, *FRAME).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"),
                                           F.count_if(~p & t).alias("fn"))
    safe = F.lit(1)
    return per.groupBy(*keys).agg(
        (F.sum("tp") / F.greatest(F.sum(F.col("tp") + F.col("fp") + F.col("fn")), safe)).alias("pixel_iou"),
        (F.sum("tp") / F.greatest(F.sum(F.col("tp") + F.col("fn")), safe)).alias("pixel_recall"),
        (F.count_if(F.col("tp") > 0) / F.greatest(F.count_if(F.col("tp") + F.col("fn") > 0), safe)).alias("image_recall"))


def cross_view_support(pixels: DataFrame, other: DataFrame, cam: DataFrame, target_pose: Column, label: int) -> DataFrame:
    """Share of each component's depth pixels whose re-projection shows the label in the other view.

    `pixels` has component_id, u, v, depth; `cam` the shared intrinsics per sequence. 0.0 when nothing
    lands inside the other image, absent (NULL) when the component has no depth.
    """
    j = pixels.join(cam, "sequence")
    j = C.undistorted_columns(j, "u", "v", "fx", "fy", "cx", "cy", D5)
    x, y, z = P.apply_pose(target_pose, F.col("un") * F.col("depth"), F.col("vn") * F.col("depth"), F.col("depth"))
    j = j.withColumns({"_x": x, "_y": y, "_z": z})
    u, v = C.project_distorted("_x", "_y", "_z", "fx", "fy", "cx", "cy", D5)
    ui, vi = C.pixel_index(u, v, "width", "height")
    j = j.withColumns({"_u": ui, "_v": vi}).select(*FRAME, "component_id", "depth", "_u", "_v")
    o = other.select(*FRAME, F.col("u").alias("_u"), F.col("v").alias("_v"), F.col("label").alias("_l"))
    j = j.join(o, [*FRAME, "_u", "_v"], "left")
    has = F.col("depth").isNotNull()
    inside = has & F.col("_u").isNotNull()
    hit = F.coalesce(F.col("_l") == label, F.lit(False)).cast("double")
    return j.groupBy(*FRAME, "component_id").agg(
        F.when(F.count_if(has) > 0, F.coalesce(F.avg(F.when(inside, hit)), F.lit(0.0))).alias("support"))
