"""Batch registration: planar rigid fits, iterative closest points, sparse raster correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoorgrid.functions import pose as P
from spoorgrid.operators.points import voxel_first
from spoorgrid.operators.spatial import nearest_within, small_targets
from spoorgrid.session import cut

S, T = ("x", "y", "z"), ("tx", "ty", "tz")


def planar_fit(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares planar rotation and translation (plus mean height offset) of matched pairs per key.

    One pass of sums; in two dimensions the optimal angle is atan2 of the centred cross and dot sums.
    """
    c = F.col
    sums = pairs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("tx").alias("nx"),
        F.avg("ty").alias("ny"), F.avg(c("tz") - c("z")).alias("dz"),
        F.avg(c("x") * c("tx") + c("y") * c("ty")).alias("_dot"), F.avg(c("x") * c("ty") - c("y") * c("tx")).alias("_cross"),
        F.sqrt(F.avg(F.pow(c("x") - c("tx"), 2) + F.pow(c("y") - c("ty"), 2) + F.pow(c("z") - c("tz"), 2))).alias("rmse"))
    yaw = F.atan2(c("_cross") - (c("mx") * c("ny") - c("my") * c("nx")), c("_dot") - (c("mx") * c("nx") + c("my") * c("ny")))
    out = sums.withColumn("yaw", yaw)
    rx, ry = P.rotate_xy("mx", "my", "yaw")
    return out.select(*keys, "n", "yaw", (c("nx") - rx).alias("dx"), (c("ny") - ry).alias("dy"), "dz", "rmse")


def register(query: DataFrame, target: DataFrame, poses: DataFrame, keys: list[str], voxel: float = 0.3,
             max_iterations: int = 20, cutoff: float = 1.0, min_pairs: int = 24, trim: float | None = None,
             order: str = "point_idx") -> DataFrame:
    """Iterative closest points for all keys at once.

    query: keys + point_idx, x, y, z in the sensor frame; target: point_idx, x, y, z in the world; poses:
    keys + pose. Finished keys leave the loop. With `trim`, each step fits only the closest share of the
    pairs (never fewer than `min_pairs`).
    """
    q = cut(voxel_first(query, keys, voxel, order).select(*keys, F.monotonically_increasing_id().alias("_pid"), *S))
    t = cut(voxel_first(target, [], voxel, order).select(*[F.col(a).alias(b) for a, b in zip(S, T)]))
    small = small_targets(t, list(T))
    sizes = q.groupBy(*keys).agg(F.count("*").alias("n_query"))
    state = cut(poses.select(*keys, "pose").join(sizes, keys, "left").select(
        *keys, "pose", F.coalesce("n_query", F.lit(0)).alias("n_query"), F.lit(0).cast("bigint").alias("inliers"),
        F.lit(float("inf")).alias("rmse"), F.lit(False).alias("converged"), F.lit(0).alias("iterations"),
        F.lit(True).alias("active")))
    for step in range(1, max(1, max_iterations) + 1):
        live = state.where("active")
        moved = q.join(live.select(*keys, "pose"), keys)
        moved = moved.select(*keys, "_pid", *[c.alias(n) for n, c in zip(S, P.apply_pose("pose", *S))])
        near = nearest_within(moved, t, ["_pid", *keys, *S], list(T), cutoff, small=small)
        if trim is not None:
            w = Window.partitionBy(*keys)
            near = near.withColumns({"_rn": F.row_number().over(w.orderBy("d2", "_pid")), "_n": F.count("*").over(w)})
            near = near.where(F.col("_rn") <= F.greatest(F.lit(min_pairs), F.floor(F.col("_n") * F.lit(trim))))
        fit = planar_fit(near, keys).where(F.col("n") >= min_pairs).withColumnRenamed("rmse", "_rmse")
        j = state.join(fit, keys, "left")
        has = F.col("active") & F.col("n").isNotNull()
        better = has & ((F.col("n") > F.col("inliers")) | ((F.col("n") == F.col("inliers")) & (F.col("_rmse") < F.col("rmse"))))
        settled = has & (F.abs("yaw") < 1.0e-3) & (F.sqrt(
            F.pow("dx", F.lit(2)) + F.pow("dy", F.lit(2)) + F.pow("dz", F.lit(2))) < 1.0e-3)
        moved_pose = P.compose(P.pose_from_planar("dx", "dy", "yaw", "dz"), "pose")
        state = cut(j.select(
            *keys, F.when(has, moved_pose).otherwise(F.col("pose")).alias("pose"), "n_query",
            F.when(better, F.col("n")).otherwise(F.col("inliers")).alias("inliers"),
            F.when(better, F.col("_rmse")).otherwise(F.col("rmse")).alias("rmse"),
            (F.col("converged") | F.coalesce(settled, F.lit(False))).alias("converged"),
            F.when(F.col("active"), F.lit(step)).otherwise(F.col("iterations")).alias("iterations"),
            (has & ~F.coalesce(settled, F.lit(False))).alias("active")))
        if state.where("active").limit(1).count() == 0:
            break
    return state.select(*keys, "pose", "inliers", (F.col("inliers") / F.greatest("n_query", F.lit(1))).alias("inlier_ratio"),
                        "rmse", "converged", F.when(F.col("n_query") == 0, 0).otherwise(F.col("iterations")).alias("iterations"))


def accept_refinement(min_pairs: int = 36, min_ratio: float = 0.55, max_shift: float = 0.45, max_yaw: float = 3.0):
    """Acceptance of a refinement delta given columns inliers, inlier_ratio, rmse, delta_xy, delta_yaw_deg."""
    return ((F.col("inliers") >= min_pairs) & (F.col("inlier_ratio") >= F.lit(min_ratio)) & F.col("rmse").isNotNull()
            & ~F.isnan("rmse") & (F.col("rmse") < F.lit(float("inf"))) & (F.col("delta_xy") <= F.lit(max_shift))
            & (F.col("delta_yaw_deg") <= F.lit(max_yaw)))


def raster_correlation(template: DataFrame, pair_keys: list[str], search: DataFrame, search_keys: list[str],
                       size: tuple[int, int], area: tuple[int, int], method: str = "ccoeff") -> DataFrame:
    """Best placement of each sparse template in its search raster.

    template: pair_keys + search_keys + row, col, val inside `size`; search: search_keys + row, col, val
    inside `area`. Each template cell meets only the search cells a placement can put on it, and the window
    sums of the search raster are computed once per raster, not per pair. Ties go to the first placement in
    row-major order. Returns the score and the top-left corner per pair.
    """
    (th, tw), (sh, sw) = size, area
    n_cells = F.lit(float(th * tw))
    rows, cols = sh - th + 1, sw - tw + 1
    grid = F.array(*[F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc")) for i in range(rows) for j in range(cols)])
    q = template.groupBy(*pair_keys, *search_keys).agg(F.sum("val").alias("q1"), F.sum(F.col("val") * F.col("val")).alias("q2"))
    win = search.select(*search_keys, "row", "col", "val", F.inline(grid)).where(
        (F.col("row") >= F.col("dr")) & (F.col("row") < F.col("dr") + th) & (F.col("col") >= F.col("dc"))
        & (F.col("col") < F.col("dc") + tw))
    win = win.groupBy(*search_keys, "dr", "dc").agg(F.sum("val").alias("s1"), F.sum(F.col("val") * F.col("val")).alias("s2"))
    placed = template.select(*pair_keys, *search_keys, F.col("row").alias("_r"), F.col("col").alias("_c"),
                             F.col("val").alias("_v"), F.inline(grid))
    placed = placed.withColumns({"row": F.col("_r") + F.col("dr"), "col": F.col("_c") + F.col("dc")})
    cross = placed.join(search, [*search_keys, "row", "col"]).groupBy(*pair_keys, *search_keys, "dr", "dc").agg(
        F.sum(F.col("_v") * F.col("val")).alias("qs"))
    every = q.select("*", F.inline(grid)).join(cross, [*pair_keys, *search_keys, "dr", "dc"], "left").join(
        win, [*search_keys, "dr", "dc"], "left")
    qs, s1, s2 = (F.coalesce(c, F.lit(0.0)) for c in ("qs", "s1", "s2"))
    if method == "ccoeff":
        den = F.sqrt(F.greatest((F.col("q2") - F.col("q1") * F.col("q1") / n_cells) * (s2 - s1 * s1 / n_cells), F.lit(0.0)))
        score = F.when(den > 1.0e-12, (qs - F.col("q1") * s1 / n_cells) / den).otherwise(0.0)
    else:
        den = F.sqrt(F.col("q2") * s2)
        score = 1.0 - F.when(den > 1.0e-12, (F.col("q2") - 2.0 * qs + s2) / den).otherwise(1.0)
    scored = every.withColumn("_score", F.round(score, 9))
    best = F.max_by(F.struct("_score", "dr", "dc"), F.struct(F.col("_score"), -F.col("dr"), -F.col("dc"))).alias("_b")
    return scored.groupBy(*pair_keys, *search_keys).agg(best).select(
        *pair_keys, *search_keys, F.col("_b._score").alias("score"), F.col("_b.dr").alias("top"), F.col("_b.dc").alias("left"))


def local_submap(map_points: DataFrame, centers: DataFrame, key: str, size: float) -> DataFrame:
    """Map points in the square around each centre (inclusive), with centre-relative coordinates."""
    from spoorgrid.operators.spatial import points_in_boxes

    half = float(size) / 2.0
    boxes = centers.select(key, "center_x", "center_y", (F.col("center_x") - half).alias("_a"),
                           (F.col("center_x") + half).alias("_b"), (F.col("center_y") - half).alias("_c"),
                           (F.col("center_y") + half).alias("_d"))
    out = points_in_boxes(map_points, boxes, "x", "y", ["_a", "_b", "_c", "_d"], size)
    return out.select(key, *map_points.columns, (F.col("x") - F.col("center_x")).alias("lx"),
                      (F.col("y") - F.col("center_y")).alias("ly"))
