"""Grid keys, label groups and small lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spoorgrid.functions.pose import col

# Semantic label groups and the class prior of the later study.
STATIC_LABELS = (1, 2, 4, 6, 8)
SEMI_DYNAMIC_LABELS = (5, 7, 9, 10, 11)
DYNAMIC_LABELS = (12, 13, 14, 15)
STRUCTURAL_LABELS = (1, 4, 6, 8)
SUPPORT_SURFACE_LABELS = (2,)
LABEL_WEIGHT_STATIC = 1.0
LABEL_WEIGHT_SEMI = 0.35


def cell_of(value, size: float) -> Column:
    return F.floor(col(value) / F.lit(float(size))).cast("int")


def packed_cell(ix, iy) -> Column:
    """One BIGINT key for a cell; the composite (ix, iy) is preferred for joins."""
    return (col(ix).cast("bigint") + F.lit(100000)) * F.lit(1000000) + (col(iy).cast("bigint") + F.lit(100000))


def label_group(label) -> Column:
    """0 static, 1 semi-dynamic, 2 dynamic, -1 otherwise."""
    c = col(label)
    return (F.when(c.isin(*STATIC_LABELS), 0).when(c.isin(*SEMI_DYNAMIC_LABELS), 1)
            .when(c.isin(*DYNAMIC_LABELS), 2).otherwise(-1))


def label_weight(label) -> Column:
    c = col(label)
    return (F.when(c.isin(*STATIC_LABELS), LABEL_WEIGHT_STATIC)
            .when(c.isin(*SEMI_DYNAMIC_LABELS), LABEL_WEIGHT_SEMI).otherwise(0.0))


def spatial_block_is_validation(ix, iy, block: int = 8, group: int = 1) -> Column:
    """Leak-safe split: whole blocks of cells go to one side."""
    b = F.floor(col(ix) / F.lit(float(block))) + 3 * F.floor(col(iy) / F.lit(float(block)))
    return F.pmod(b, F.lit(5)) == group


def box_iou(a: list, b: list) -> Column:
    """IoU of two boxes given as four columns each: x1, y1, x2, y2."""
    ax1, ay1, ax2, ay2 = map(col, a)
    bx1, by1, bx2, by2 = map(col, b)
    zero = F.lit(0.0)
    inter = (F.greatest(F.least(ax2, bx2) - F.greatest(ax1, bx1), zero)
             * F.greatest(F.least(ay2, by2) - F.greatest(ay1, by1), zero))
    area_a = F.greatest(ax2 - ax1, zero) * F.greatest(ay2 - ay1, zero)
    area_b = F.greatest(bx2 - bx1, zero) * F.greatest(by2 - by1, zero)
    return inter / F.greatest(area_a + area_b - inter, F.lit(1.0e-6))


def null_if_nan(value) -> Column:
    return F.when(~F.isnan(col(value)), col(value))


def finite(value) -> Column:
    c = col(value).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
