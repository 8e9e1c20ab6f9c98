"""Rigid-transform, quaternion and yaw expressions. A 4x4 pose is a row-major ARRAY<DOUBLE> of 16."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTITY = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def wrap_to_pi(angle) -> Column:
    """Wrap into [-pi, pi)."""
    return F.pmod(col(angle) + F.lit(math.pi), F.lit(2.0 * math.pi)) - F.lit(math.pi)


def yaw_gap_deg(a, b) -> Column:
    """Absolute wrapped yaw difference in degrees."""
    return F.abs(F.degrees(wrap_to_pi(col(a) - col(b))))


def yaw_from_quaternion(qx, qy, qz, qw) -> Column:
    x, y, z, w = map(col, (qx, qy, qz, qw))
    return F.atan2(2.0 * (w * z + x * y), 1.0 - 2.0 * (y * y + z * z))


def pose_from_quaternion(px, py, pz, qx, qy, qz, qw) -> Column:
    """4x4 pose from position and a quaternion of any non-zero norm; zero norm is an error."""
    x, y, z, w = map(col, (qx, qy, qz, qw))
    n2 = x * x + y * y + z * z + w * w
    s = F.when(n2 > 0, 2.0 / n2).otherwise(F.raise_error(F.lit("quaternion with zero norm")).cast("double"))
    return F.array(
        1.0 - s * (y * y + z * z), s * (x * y - z * w), s * (x * z + y * w), col(px),
        s * (x * y + z * w), 1.0 - s * (x * x + z * z), s * (y * z - x * w), col(py),
        s * (x * z - y * w), s * (y * z + x * w), 1.0 - s * (x * x + y * y), col(pz),
        F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0),
    )


def pose_from_planar(x, y, yaw, z=None) -> Column:
    """4x4 pose that only turns about z."""
    c, s = F.cos(col(yaw)), F.sin(col(yaw))
    zero, one = F.lit(0.0), F.lit(1.0)
    height = zero if z is None else col(z)
    return F.array(c, -s, zero, col(x), s, c, zero, col(y), zero, zero, one, height, zero, zero, zero, one)


def entry(pose, r: int, c: int) -> Column:
    return col(pose)[4 * r + c]


def pose_x(pose) -> Column:
    return entry(pose, 0, 3)


def pose_y(pose) -> Column:
    return entry(pose, 1, 3)


def pose_yaw(pose) -> Column:
    return F.atan2(entry(pose, 1, 0), entry(pose, 0, 0))


def compose(left, right) -> Column:
    """Matrix product of two 4x4 poses."""
    return F.array(*[
        sum((entry(left, r, k) * entry(right, k, c) for k in range(1, 4)), entry(left, r, 0) * entry(right, 0, c))
        for r in range(4) for c in range(4)
    ])


def invert(pose) -> Column:
    """Inverse of a rigid pose: transposed rotation, rotated and negated translation."""
    rows = []
    for r in range(3):
        rows += [entry(pose, c, r) for c in range(3)]
        rows.append(-(entry(pose, 0, r) * entry(pose, 0, 3) + entry(pose, 1, r) * entry(pose, 1, 3)
                      + entry(pose, 2, r) * entry(pose, 2, 3)))
    return F.array(*rows, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def apply_pose(pose, x, y, z) -> tuple[Column, Column, Column]:
    """Transformed coordinates of a point."""
    p = [col(x), col(y), col(z)]
    return tuple(
        entry(pose, r, 0) * p[0] + entry(pose, r, 1) * p[1] + entry(pose, r, 2) * p[2] + entry(pose, r, 3)
        for r in range(3)
    )


def rotate_xy(x, y, yaw) -> tuple[Column, Column]:
    c, s = F.cos(col(yaw)), F.sin(col(yaw))
    return c * col(x) - s * col(y), s * col(x) + c * col(y)


def xy_error(x1, y1, x2, y2) -> Column:
    dx, dy = col(x1) - col(x2), col(y1) - col(y2)
    return F.sqrt(dx * dx + dy * dy)
