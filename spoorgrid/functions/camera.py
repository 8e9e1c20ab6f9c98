"""Pinhole camera expressions. Intrinsics are columns (or literals), so a calibration join feeds them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spoorgrid.functions.pose import col


def scaled(fx, fy, cx, cy, scale_x, scale_y) -> tuple[Column, Column, Column, Column]:
    """Intrinsics after an image resize."""
    return col(fx) * scale_x, col(fy) * scale_y, col(cx) * scale_x, col(cy) * scale_y


def project(x, y, z, fx, fy, cx, cy) -> tuple[Column, Column]:
    """Undistorted pixel; NULL behind the camera."""
    ok = col(z) > 0
    return (F.when(ok, col(fx) * col(x) / col(z) + col(cx)),
            F.when(ok, col(fy) * col(y) / col(z) + col(cy)))


def _distort(xn, yn, d) -> tuple[Column, Column]:
    k1, k2, p1, p2, k3 = d
    r2 = xn * xn + yn * yn
    radial = 1.0 + r2 * (k1 + r2 * (k2 + r2 * k3))
    return (xn * radial + 2.0 * p1 * xn * yn + p2 * (r2 + 2.0 * xn * xn),
            yn * radial + p1 * (r2 + 2.0 * yn * yn) + 2.0 * p2 * xn * yn)


def project_distorted(x, y, z, fx, fy, cx, cy, d) -> tuple[Column, Column]:
    """Real-valued pixel under the five-coefficient model; NULL behind the camera."""
    ok = col(z) > 0
    xd, yd = _distort(col(x) / col(z), col(y) / col(z), [col(k) for k in d])
    return F.when(ok, col(fx) * xd + col(cx)), F.when(ok, col(fy) * yd + col(cy))


def pixel_index(u, v, width, height, limit: float = 1.0e9) -> tuple[Column, Column]:
    """Half-to-even integer pixel, NULL outside the image or beyond the numeric limit."""
    sane = (F.abs(u) < limit) & (F.abs(v) < limit)
    ui = F.when(sane, F.rint(u).cast("int"))
    vi = F.when(sane, F.rint(v).cast("int"))
    inside = (ui >= 0) & (ui < col(width)) & (vi >= 0) & (vi < col(height))
    return F.when(inside, ui), F.when(inside, vi)


def unproject(u, v, depth, fx, fy, cx, cy) -> tuple[Column, Column, Column]:
    """Camera-frame point of a pixel with depth."""
    return ((col(u) - col(cx)) * col(depth) / col(fx), (col(v) - col(cy)) * col(depth) / col(fy), col(depth))


def undistorted_columns(df, u, v, fx, fy, cx, cy, d, rounds: int = 5):
    """Add normalised undistorted coordinates `un`, `vn` by fixed-point inversion.

    The rounds are a fold inside one expression: unrolled columns would be substituted into each other by
    the optimiser and grow exponentially.
    """
    k1, k2, p1, p2, k3 = [col(k) for k in d]
    x0, y0 = (col(u) - col(cx)) / col(fx), (col(v) - col(cy)) / col(fy)

    def improve(s, _):
        x, y = s["un"], s["vn"]
        r2 = x * x + y * y
        shrink = 1.0 + r2 * (k1 + r2 * (k2 + r2 * k3))
        return F.struct(((x0 - (2.0 * p1 * x * y + p2 * (r2 + 2.0 * x * x))) / shrink).alias("un"),
                        ((y0 - (p1 * (r2 + 2.0 * y * y) + 2.0 * p2 * x * y)) / shrink).alias("vn"))

    start = F.struct(x0.alias("un"), y0.alias("vn"))
    folded = df.withColumn("_uv", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, improve))
    return folded.withColumns({"un": F.col("_uv.un"), "vn": F.col("_uv.vn")}).drop("_uv")


def stereo_features(depth_raw, fx: float, baseline: float, scale: float, dmin: float, dmax: float,
                    disparity_norm: float) -> tuple[Column, Column, Column]:
    """Normalised inverse depth, normalised disparity and validity of a raw depth value."""
    depth = col(depth_raw) * F.lit(float(scale))
    valid = depth > 0
    clipped = F.greatest(F.least(depth, F.lit(float(dmax))), F.lit(float(dmin)))
    safe = F.greatest(clipped, F.lit(1.0e-6))
    top = 1.0 / max(float(dmin), 1.0e-6)

    def unit(c):
        return F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))

    inv = unit(F.when(valid, 1.0 / safe).otherwise(0.0) / max(top, 1.0e-6))
    disp = unit(F.when(valid, F.lit(float(fx) * float(baseline)) / safe).otherwise(0.0)
                / max(float(disparity_norm), 1.0))
    return inv, disp, valid.cast("double")
