"""Point tables: crop, transform, grid rasters, tiling and down-sampling. One row per point."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorgrid.functions import pose as P
from spoorgrid.functions.cells import cell_of

FRAME = ["sequence", "frame_idx"]


def crop(points: DataFrame, x: tuple, y: tuple, z: tuple) -> DataFrame:
    """Inclusive 3-D box on finite points; plain predicates, so they reach the Parquet scan."""
    keep = F.lit(True)
    for name, (lo, hi) in (("x", x), ("y", y), ("z", z)):
        # NaN sorts above every number, so the upper bound already rejects it together with infinity
        keep = keep & (F.col(name) >= F.lit(float(lo))) & (F.col(name) <= F.lit(float(hi)))
    return points.where(keep)


def to_world(points: DataFrame, poses: DataFrame, names=("wx", "wy", "wz")) -> DataFrame:
    """Transform points by the 4x4 `pose` of their frame."""
    joined = points.join(poses.select(*FRAME, "pose"), FRAME)
    return joined.withColumns(dict(zip(names, P.apply_pose("pose", "x", "y", "z")))).drop("pose")


def planar_poses(poses: DataFrame) -> DataFrame:
    """Add a 4x4 `pose` to a table with px, py, pz and yaw."""
    return poses.withColumn("pose", P.pose_from_planar("px", "py", "yaw", "pz"))


def grid_raster(points: DataFrame, keys: list[str], bounds: tuple, resolution: float,
                x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """Sparse raster: count, highest and mean z, occupancy per cell; rows run from the top.

    The raster is half-open, so a point on the upper bound that survives an inclusive crop is dropped here.
    """
    x_min, x_max, y_min, y_max = map(float, bounds)
    width, height = round((x_max - x_min) / resolution), round((y_max - y_min) / resolution)
    cx = F.floor((F.col(x) - F.lit(x_min)) / F.lit(float(resolution)))
    cy = F.floor((F.col(y) - F.lit(y_min)) / F.lit(float(resolution)))
    cells = points.select(*keys, (F.lit(height - 1) - cy).cast("int").alias("row"), cx.cast("int").alias("col"),
                          F.col(z).alias("_z"))
    cells = cells.where(F.col("col").between(0, width - 1) & F.col("row").between(0, height - 1))
    return cells.groupBy(*keys, "row", "col").agg(
        F.count("*").alias("cnt"), F.max("_z").alias("max_h"), F.avg("_z").alias("mean_h"),
        F.lit(1).alias("occupancy"))


def aligned_bounds(points: DataFrame, resolution: float) -> DataFrame:
    """One row with the global bounds, padded by a thousandth of a cell and aligned to the grid."""
    r = F.lit(float(resolution))
    eps = F.lit(float(resolution) * 1.0e-3)
    return points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"),
                      F.max("y").alias("y1")).select(
        (F.floor((F.col("x0") - eps) / r) * r).alias("x_min"), (F.ceil((F.col("x1") + eps) / r) * r).alias("x_max"),
        (F.floor((F.col("y0") - eps) / r) * r).alias("y_min"), (F.ceil((F.col("y1") + eps) / r) * r).alias("y_max"))


def global_raster(points: DataFrame, resolution: float) -> DataFrame:
    """Raster over the aligned bounds of the whole table."""
    b = aligned_bounds(points, resolution).select(F.struct("*")).scalar()
    r = F.lit(float(resolution))
    out = points.withColumn("_b", b)
    height = F.round((F.col("_b.y_max") - F.col("_b.y_min")) / r)
    cells = out.select((height - 1 - F.floor((F.col("y") - F.col("_b.y_min")) / r)).cast("int").alias("row"),
                       F.floor((F.col("x") - F.col("_b.x_min")) / r).cast("int").alias("col"), "z")
    return cells.groupBy("row", "col").agg(F.count("*").alias("cnt"), F.max("z").alias("max_h"),
                                           F.avg("z").alias("mean_h"))


def patch_tiles(points: DataFrame, resolution: float, size: float, stride: float) -> DataFrame:
    """Row-major sliding windows over the aligned bounds, with sequential ids, centre, box and grid range."""
    r = float(resolution)
    size_c, stride_c = round(size / r), round(stride / r)
    b = aligned_bounds(points, r)
    h = F.round((F.col("y_max") - F.col("y_min")) / r).cast("int")
    w = F.round((F.col("x_max") - F.col("x_min")) / r).cast("int")
    small = F.raise_error(F.lit("patch larger than the raster")).cast("int")
    b = b.withColumn("_h", F.when(h >= size_c, h).otherwise(small)).withColumn(
        "_w", F.when(w >= size_c, w).otherwise(small))
    rows = F.floor((F.col("_h") - size_c) / stride_c).cast("int")
    cols = F.floor((F.col("_w") - size_c) / stride_c).cast("int")
    tiles = b.withColumn("_nc", cols + 1).withColumn("_i", F.explode(F.sequence(F.lit(0), rows)))
    tiles = tiles.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_nc") - 1)))
    r0, c0 = F.col("_i") * stride_c, F.col("_j") * stride_c
    tiles = tiles.select((F.col("_i") * F.col("_nc") + F.col("_j")).alias("patch_id"),
                         r0.alias("r0"), (r0 + size_c).alias("r1"), c0.alias("c0"), (c0 + size_c).alias("c1"),
                         (F.col("x_min") + c0 * F.lit(r)).alias("bx0"), (F.col("y_max") - r0 * F.lit(r)).alias("by1"))
    tiles = tiles.withColumn("bx1", F.col("bx0") + F.lit(float(size))).withColumn(
        "by0", F.col("by1") - F.lit(float(size)))
    return tiles.withColumn("center_x", (F.col("bx0") + F.col("bx1")) / 2.0).withColumn(
        "center_y", (F.col("by0") + F.col("by1")) / 2.0)


def cells_to_patches(cells: DataFrame, tiles: DataFrame, size_cells: int, stride_cells: int) -> DataFrame:
    """Give every raster cell to each window that covers it (about (size / stride)^2 copies).

    The window indices follow from the cell by arithmetic; the join only attaches ids and drops windows
    outside the tiling.
    """
    def windows(c):
        first = F.greatest(F.ceil((F.col(c) - F.lit(size_cells - 1)) / F.lit(float(stride_cells))), F.lit(0))
        last = F.floor(F.col(c) / F.lit(float(stride_cells)))
        return F.filter(F.sequence(first, F.greatest(last, first)), lambda i: i <= last)

    out = cells.withColumn("_i", F.explode(windows("row"))).withColumn("_j", F.explode(windows("col")))
    out = out.withColumn("r0", (F.col("_i") * stride_cells).cast("int")).withColumn(
        "c0", (F.col("_j") * stride_cells).cast("int"))
    out = out.join(tiles.select("patch_id", "r0", "c0"), ["r0", "c0"])
    return out.select("patch_id", (F.col("row") - F.col("r0")).alias("prow"), (F.col("col") - F.col("c0")).alias("pcol"),
                      "cnt", "max_h", "mean_h")


def voxel_first(points: DataFrame, keys: list[str], size: float, order: str) -> DataFrame:
    """Keep the first point of every voxel; `order` must be unique within the keys.

    Primitive minima keep this in the hash aggregate, combined on the map side.
    """
    v = [cell_of(c, size).alias(f"v{c}") for c in ("x", "y", "z")]
    first = [F.min(order).alias(order), *[F.min_by(c, order).alias(c) for c in ("x", "y", "z")]]
    return points.select(*keys, *v, order, "x", "y", "z").groupBy(*keys, "vx", "vy", "vz").agg(*first)


def shift_raster(cells: DataFrame, dx: int, dy: int, width: int, height: int) -> DataFrame:
    """Translate a sparse raster; cells moved outside vanish, uncovered cells stay absent (zero)."""
    out = cells.withColumn("row", F.col("row") + dy).withColumn("col", F.col("col") + dx)
    return out.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))


def rotate_raster(cells: DataFrame, angle_deg: float, width: int, height: int) -> DataFrame:
    """Rotate a sparse raster about its centre with nearest sampling and zero fill.

    A target cell takes the source cell its centre maps back to. Each source cell only proposes the nine
    targets around its forward image, so the raster is never enumerated.
    """
    a = math.radians(angle_deg)
    c, s = math.cos(a), math.sin(a)
    cx, cy = (width - 1) / 2.0, (height - 1) / 2.0
    u, v = F.col("col") - cx, F.col("row") - cy
    near = F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    out = cells.withColumn("_n", F.explode(near))
    tx = (F.rint(u * c + v * s + cx) + F.col("_n.dx")).cast("int")
    ty = (F.rint(-u * s + v * c + cy) + F.col("_n.dy")).cast("int")
    out = out.withColumn("_tx", tx).withColumn("_ty", ty)
    bu, bv = F.col("_tx") - cx, F.col("_ty") - cy
    back = (F.rint(bu * c - bv * s + cx) == F.col("col")) & (F.rint(bu * s + bv * c + cy) == F.col("row"))
    out = out.where(back & F.col("_tx").between(0, width - 1) & F.col("_ty").between(0, height - 1))
    return out.withColumn("row", F.col("_ty")).withColumn("col", F.col("_tx")).drop("_n", "_tx", "_ty")


def match_channel(name: str) -> Column:
    """Matching channel of a sparse raster cell."""
    channels = {
        "occupancy": F.when(F.col("cnt") > 0, 1.0).otherwise(0.0),
        "count": F.log1p(F.col("cnt").cast("double")),
        "max_height": F.col("max_h"),
        "mean_height": F.col("mean_h"),
        "count_height": F.log1p(F.col("cnt").cast("double")) + 0.25 * F.col("max_h"),
    }
    return channels[name]


def search_angles(step_deg: float, enabled: bool = True) -> list[float]:
    """Rotation search grid over [0, 360); zero is always a member."""
    if not enabled:
        return [0.0]
    if step_deg <= 0:
        raise ValueError("the step must be positive")
    return [i * step_deg for i in range(math.ceil((360.0 - 1.0e-6) / step_deg))]


def yaw_offsets(half_range_deg: float, step_deg: float) -> list[float]:
    """Symmetric yaw offsets, both ends included."""
    step = max(step_deg, 1.0e-3)
    return [-half_range_deg + i * step for i in range(math.floor(2.0 * half_range_deg / step + 0.5) + 1)]


def nearest_bin(value, centers: list[float], circular: bool = False) -> Column:
    """Zero-based index of the nearest bin centre, lowest index on ties."""
    c = P.col(value)
    gaps = [F.abs(F.atan2(F.sin(c - F.lit(b)), F.cos(c - F.lit(b)))) if circular else F.abs(c - F.lit(b))
            for b in centers]
    return (F.array_position(F.array(*gaps), F.least(*gaps)) - 1).cast("int")


def bin_residual(value, index, centers: list[float], width: float, circular: bool = False) -> Column:
    """Offset from the bin centre in half-widths, clipped to [-1, 1]."""
    delta = P.col(value) - F.element_at(F.array(*[F.lit(b) for b in centers]), P.col(index) + 1)
    if circular:
        delta = F.atan2(F.sin(delta), F.cos(delta))
    scaled = delta / F.lit(max(width * 0.5, 1.0e-6))
    return F.greatest(F.least(scaled, F.lit(1.0)), F.lit(-1.0))
