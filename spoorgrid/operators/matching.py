"""Box agreement and one-to-one matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorgrid.functions.cells import box_iou
from spoorgrid.session import cut

BOX = ["x1", "y1", "x2", "y2"]


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str,
                bucket: float = 64.0) -> DataFrame:
    """Pairs of boxes of the same frame that overlap, with `iou`.

    Boxes are spread over the grid cells they touch; a pair is kept only in the cell of its intersection
    corner, so it appears once, and a crowded frame is split by place.
    """
    def spread(df, p):
        lo = [F.floor(F.col(p + c) / bucket).cast("bigint") for c in ("x1", "y1")]
        hi = [F.floor(F.col(p + c) / bucket).cast("bigint") for c in ("x2", "y2")]
        return df.withColumn("_bx", F.explode(F.sequence(lo[0], hi[0]))).withColumn("_by", F.explode(F.sequence(lo[1], hi[1])))

    a = spread(left.select(*keys, left_id, *[F.col(c).alias("l" + c) for c in BOX],
                           *[c for c in left.columns if c not in (*keys, left_id, *BOX)]), "l")
    b = spread(right.select(*keys, right_id, *[F.col(c).alias("r" + c) for c in BOX],
                            *[c for c in right.columns if c not in (*keys, right_id, *BOX)]), "r")
    j = a.join(b, [*keys, "_bx", "_by"])
    home = ((F.floor(F.greatest("lx1", "rx1") / bucket) == F.col("_bx"))
            & (F.floor(F.greatest("ly1", "ry1") / bucket) == F.col("_by")))
    j = j.where(home).withColumn("iou", box_iou(["l" + c for c in BOX], ["r" + c for c in BOX])).drop("_bx", "_by")
    return j.where(F.col("iou") > 0)


def detector_agreement(references: DataFrame, detections: DataFrame, keys: list[str], ref_id: str, det_id: str) -> DataFrame:
    """Per reference box the detection with the largest IoU * score; zeros when nothing overlaps."""
    pairs = overlapping(references, detections, keys, ref_id, det_id).withColumn("_m", F.col("iou") * F.col("score"))
    best = pairs.groupBy(*keys, ref_id).agg(
        F.max_by(F.struct("iou", "score", det_id), F.struct(F.col("_m"), -F.col(det_id))).alias("_b"))
    out = references.select(*keys, ref_id).join(best, [*keys, ref_id], "left")
    return out.select(*keys, ref_id, F.coalesce("_b.iou", F.lit(0.0)).alias("iou"),
                      F.coalesce("_b.score", F.lit(0.0)).alias("score"), F.col(f"_b.{det_id}").alias(det_id))


def greedy_matches(pairs: DataFrame, keys: list[str], left_id: str, right_id: str, weight: str) -> DataFrame:
    """One-to-one matches in descending weight (then lowest ids), as a greedy scan would take them.

    A pair that is the best one of both its ends can be taken at once wherever it stands in the order, so
    all frames advance together and a crowded frame is never handled by one task. Every round takes at least the
    best pair that is left, so rounds end.
    """
    order = F.struct(F.col(weight), -F.col(left_id), -F.col(right_id))
    rest = cut(pairs.select(*keys, left_id, right_id, weight))
    taken = None
    while True:
        top_l = rest.groupBy(*keys, left_id).agg(F.max(order).alias("_l"))
        top_r = rest.groupBy(*keys, right_id).agg(F.max(order).alias("_r"))
        won = rest.join(top_l, [*keys, left_id]).join(top_r, [*keys, right_id])
        won = cut(won.where((order == F.col("_l")) & (order == F.col("_r"))).select(*keys, left_id, right_id, weight))
        taken = won if taken is None else taken.unionByName(won)
        rest = cut(rest.join(won.select(*keys, left_id), [*keys, left_id], "left_anti")
                       .join(won.select(*keys, right_id), [*keys, right_id], "left_anti"))
        if rest.limit(1).count() == 0:
            return taken
