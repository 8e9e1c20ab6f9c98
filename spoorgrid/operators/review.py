"""Review queues: priorities, quotas, case-control rows, windows, linked boxes, world centres."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorgrid.operators.chunks import top_n
from spoorgrid.operators.matching import overlapping
from spoorgrid.operators.quantiles import exact_quantiles, exact_quantiles_of
from spoorgrid.session import cut

# Priority of each motion hint.
MOTION_PRIORITY = {"potentially_moving": 3, "ambiguous_motion": 2, "likely_static_relative_to_map": 1,
                   "insufficient_3d_evidence": 0}


def _numbers(text: str) -> Column:
    return F.filter(F.coalesce(F.from_json(F.col(text), "array<double>"), F.array()), lambda v: v.isNotNull())


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(values) > 0, total / F.greatest(F.size(values), F.lit(1))).otherwise(0.0)


def review_scores(manifest: DataFrame) -> DataFrame:
    """Evidence, uncertainty, priority and tier of each manifest row."""
    n = F.coalesce(F.col("observation_count"), F.lit(0))
    score = _mean(_numbers("scores_json"))
    overlap = _mean(F.filter(_numbers("overlaps_json"), lambda v: v > 0))
    out = manifest.withColumns({"_s": score, "_o": overlap})
    evidence = 0.45 * F.least(n / 5.0, F.lit(1.0)) + 0.35 * F.col("_s") + 0.20 * F.col("_o")
    doubt = 0.65 * (1.0 - F.col("_s")) + 0.35 * (1.0 - F.col("_o"))
    top = float(max(MOTION_PRIORITY.values()))
    motion = F.coalesce(*[F.when(F.col("motion_hint") == k, F.lit(v / top)) for k, v in MOTION_PRIORITY.items()], F.lit(0.0))
    tier = (F.when(F.col("motion_hint").isin("potentially_moving", "ambiguous_motion") & (n >= 3), "A")
            .when(n >= 3, "B").otherwise("C"))
    return out.withColumns({"evidence": evidence, "uncertainty": doubt,
                            "priority": 0.50 * motion + 0.35 * evidence + 0.15 * doubt, "tier": tier}).drop("_s", "_o")


def walk_quotas(pdf: pd.DataFrame, n: int) -> pd.DataFrame:
    """The sequential quota walk over an ordered, bounded table; returns chosen rows with their position."""
    limits = {"A": max(6, round(n * 0.45)), "B": max(4, round(n * 0.30))}
    per_sequence, validation = max(2, -(-n // 8)), max(4, round(n / 3))
    chosen, later, seq, tier, val = [], [], {}, {}, 0
    for i, r in enumerate(pdf.itertuples(index=False)):
        if len(chosen) == n:
            break
        full = (seq.get(r.sequence, 0) >= per_sequence or tier.get(r.tier, 0) >= limits.get(r.tier, n)
                or (r.split == "validation" and val >= validation))
        if full:
            later.append(i)
            continue
        chosen.append(i)
        seq[r.sequence] = seq.get(r.sequence, 0) + 1
        tier[r.tier] = tier.get(r.tier, 0) + 1
        val += r.split == "validation"
    chosen += later[: n - len(chosen)]
    out = pdf.iloc[chosen].copy()
    out["position"] = range(1, len(out) + 1)
    return out


def balanced_queue(scored: DataFrame, row_id: str, n: int) -> DataFrame:
    """Quota-balanced selection of n rows (tier, sequence and split quotas, deferred rows refill).

    Only rows that can matter reach the walk: within each (tier, split) the first 2n rows, and the first 2n
    after capping each sequence at its quota. At most n rows are ever chosen, so a row behind either prefix
    is preceded by enough chosen or deferred rows never to be reached. The walk sees at most
    4n rows per tier and split, whatever the size of the table.
    """
    per_sequence = max(2, -(-n // 8))
    cols = ["tier", "priority", "sequence", "anchor_frame", "split", row_id]
    order = [F.desc("priority"), F.col("sequence"), F.col("anchor_frame"), F.col(row_id)]
    s = scored.select(*cols)
    head = top_n(s, ["tier", "split"], order, 2 * n).drop("rank")
    capped = top_n(top_n(s, ["tier", "split", "sequence"], order, per_sequence).drop("rank"), ["tier", "split"], order, 2 * n).drop("rank")
    pool = head.unionByName(capped).distinct()
    ddl = ", ".join(f"{c} {t}" for c, t in pool.dtypes) + ", position int"

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tier", "priority", "sequence", "anchor_frame", row_id], ascending=[True, False, True, True, True])
        return walk_quotas(pdf.drop(columns="_all"), n)

    return pool.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(walk, ddl)


def anchor_windows(rows: DataFrame, last_frames: DataFrame, anchor: str, radius: int) -> DataFrame:
    """Window of +-radius frames around an anchor, clipped to the sequence."""
    j = rows.join(last_frames.select("sequence", "last_frame"), "sequence")
    return j.withColumns({"window_start": F.greatest(F.lit(0), F.col(anchor) - radius),
                          "window_end": F.least(F.col("last_frame"), F.col(anchor) + radius)}).drop("last_frame")


def link_boxes(anchors: DataFrame, detections: DataFrame, radius: int, min_score: float = 0.20) -> DataFrame:
    """Follow an anchor box frame by frame in both directions, stopping at the first miss.

    Each step meets the current boxes of all anchors with the overlapping detections of the next frame and keeps
    the largest IoU * score (an aggregate per anchor). anchors: anchor_id, sequence, frame_idx, box;
    detections: sequence, frame_idx, det_id, box, score.
    """
    box = ["x1", "y1", "x2", "y2"]
    d = detections.where(F.col("score") >= F.lit(min_score)).select("sequence", "frame_idx", "det_id", "score", *box)
    start = anchors.select("anchor_id", "sequence", "frame_idx", *box, F.lit(1.0).alias("score"), F.lit(0.0).alias("iou"), F.lit(0).alias("offset"))
    out = start
    for direction in (-1, 1):
        now = start
        for k in range(1, radius + 1):
            probe = now.select("anchor_id", "sequence", (F.col("frame_idx") + direction).alias("frame_idx"), *box)
            j = overlapping(probe, d, ["sequence", "frame_idx"], "anchor_id", "det_id")
            best = j.groupBy("anchor_id", "sequence", "frame_idx").agg(
                F.max_by(F.struct(*["r" + c for c in box], "score", "iou"), F.struct(F.col("iou") * F.col("score"), -F.col("det_id"))).alias("b"))
            now = cut(best.select("anchor_id", "sequence", "frame_idx", *[F.col(f"b.r{c}").alias(c) for c in box], "b.score", "b.iou",
                                  F.lit(direction * k).alias("offset")))  # each step is read by the next one and by the result
            out = out.unionByName(now)
    return out


def front_cluster(points: DataFrame, keys: list[str], share: float = 0.30, minimum: int = 3) -> DataFrame:
    """Median position of the nearest depth share of the points in a box (all points when the share is tiny)."""
    limit = exact_quantiles(points, keys, "depth", {"_front": share})
    j = points.join(limit, keys).withColumn("_in", F.col("depth") <= F.col("_front"))
    sizes = j.groupBy(*keys).agg(F.count("*").alias("_n"), F.count_if("_in").alias("_m")).where(F.col("_n") >= minimum)
    used = j.join(sizes, keys).where(F.col("_in") | (F.col("_m") < minimum))
    return exact_quantiles_of(used, keys, {c: {f"center_{c}": 0.5} for c in ("x", "y", "z")})


def best_centers(boxes: DataFrame, from_depth: DataFrame, from_points: DataFrame, keys: list[str]) -> DataFrame:
    """Depth-based centre where there is one, else the front cluster; `center_source` says which."""
    names = ["center_x", "center_y", "center_z"]
    a = from_depth.select(*keys, *[F.col(n).alias("a" + n) for n in names])
    b = from_points.select(*keys, *[F.col(n).alias("b" + n) for n in names])
    j = boxes.select(*keys).join(a, keys, "left").join(b, keys, "left")
    return j.select(*keys, *[F.coalesce("a" + n, "b" + n).alias(n) for n in names],
                    F.when(F.col("acenter_x").isNotNull(), "depth_box_interior").when(
                        F.col("bcenter_x").isNotNull(), "lidar_front_cluster").alias("center_source"))


def review_packets(linked: DataFrame, centres: DataFrame) -> DataFrame:
    """One packet per anchor: its linked boxes and the world centre of each frame as text in window order, path, displacement and a motion hint.

    linked: anchor_id, sequence, frame_idx, offset and box; centres: sequence, frame_idx, center_x, center_y, center_z and center_source, as
    best_centers gives them. Frames without a centre count as boxes, not as observations.
    """
    from spoorgrid.operators.sequence import motion_hint

    seen = linked.join(centres, ["sequence", "frame_idx"], "left")
    hint = motion_hint(seen.select("anchor_id", "offset", *[F.col(f"center_{c}").alias(c) for c in ("x", "y", "z")]), ["anchor_id"], "offset")
    box = F.concat_ws(",", F.col("offset"), *[F.col(c).cast("bigint") for c in ("x1", "y1", "x2", "y2")])
    parts = F.sort_array(F.collect_list(F.struct("offset", box.alias("box"), F.coalesce("center_source", F.lit("none")).alias("source"))))  # a window of frames
    boxes = seen.groupBy("anchor_id").agg(F.first("sequence").alias("sequence"), F.count("*").alias("boxes"), parts.alias("_p"))
    text = F.concat(F.lit("["), F.array_join("_p.box", ";"), F.lit("]"))
    return boxes.select("anchor_id", "sequence", "boxes", text.alias("track_boxes"), F.array_join("_p.source", ";").alias("center_sources")).join(hint, "anchor_id")
