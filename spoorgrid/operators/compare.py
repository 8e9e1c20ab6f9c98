"""Run comparisons, threshold choices and study reports composed from the basic operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorgrid.functions.plan import settled
from spoorgrid.operators import metrics as M
from spoorgrid.operators.chunks import ranked, run_starts, top_n
from spoorgrid.operators.quantiles import exact_quantiles, with_quantiles
from spoorgrid.operators.sequence import islands
from spoorgrid.session import cut, dealt


def strict_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which a left row without partner is an error at run time."""
    r = right.withColumn("_there", F.lit(True))
    j = left.join(r, keys, "left")
    guard = F.when(F.col("_there"), F.lit(True)).otherwise(F.raise_error(F.concat(
        F.lit("missing partner for "), F.to_json(F.struct(*keys)))).cast("boolean"))
    return j.where(guard).drop("_there")


def filter_comparison(base: DataFrame, new: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Error report of two runs on their shared frames, per group and overall."""
    j = base.join(new, keys).join(groups, keys)
    rows = j.select(F.explode(F.array(F.col("grp"), F.lit("all"))).alias("grp"), F.inline(F.array(
        F.struct(F.lit("baseline").alias("method"), F.col("base_error").alias("position_error")),
        F.struct(F.lit("filtered").alias("method"), F.col("new_error").alias("position_error")))))
    return M.error_summary(rows, ["grp", "method"], "position_error")


def hybrid_thresholds(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """Errors when the structural result replaces the dynamic one at exposure >= threshold."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds]))
    r = rows.withColumn("threshold", t)
    use = F.col("semi_ratio") >= F.col("threshold")
    r = r.withColumn("position_error", F.when(use, F.col("structural_error")).otherwise(F.col("dynamic_error")))
    return M.error_summary(r, "threshold", "position_error", [F.avg(use.cast("double")).alias("structural_share")])


def choose_threshold(hybrid: DataFrame, baseline_p95: Column, frozen: float | None = None) -> DataFrame:
    """Lowest mean among thresholds whose P95 does not exceed the baseline (or the frozen one); first on ties."""
    if frozen is not None:
        return hybrid.where(F.col("threshold") == F.lit(float(frozen)))
    ok = hybrid.where(F.col("p95_error") <= baseline_p95)
    return ok.agg(F.min_by(F.struct(*ok.columns), F.struct("mean_error", "threshold")).alias("b")).select("b.*")


def gate_report(rows: DataFrame, keys: list[str], decision: str = "decision") -> DataFrame:
    """Accuracy, errors, improvement and headroom of gate decisions.

    rows: keys, decision, label_source, baseline_source, baseline_error, oracle_error and the error columns
    bev_error, deep_error, tracker_error. A decision without an error falls back to the baseline's.
    """
    err = F.coalesce(F.when(F.col(decision) == "bev_init", F.col("bev_error")).when(F.col(decision) == "deep_init", F.col("deep_error"))
                     .when(F.col(decision) == "tracker_init", F.col("tracker_error")), F.col("baseline_error"))
    r = settled(rows, {"position_error": err, "_right": (F.col(decision) == F.col("label_source")).cast("double"),
                       "_moved": (F.col(decision) != F.col("baseline_source")).cast("double")})
    return M.error_summary(r, keys, "position_error", [
        F.avg("_right").alias("action_accuracy"), F.avg("_moved").alias("apply_rate"),
        F.avg("baseline_error").alias("baseline_mean"), F.avg("oracle_error").alias("oracle_mean"),
        (F.avg("baseline_error") - F.avg("position_error")).alias("improvement"),
        (F.avg("baseline_error") - F.avg("oracle_error")).alias("headroom")])


def best_margin(scan: DataFrame) -> DataFrame:
    """Lowest mean among non-degrading margins (all of them when none qualifies), highest apply rate on ties."""
    bad = (F.col("mean_error") > F.col("baseline_mean") + 1.0e-9).cast("int")
    return scan.agg(F.min_by(F.struct(*scan.columns), F.struct(bad, F.col("mean_error"), -F.col("apply_rate"), F.col("margin"))
                             ).alias("b")).select("b.*")


def presence_audit(rows: DataFrame, max_gap: int, min_frames: int) -> DataFrame:
    """Per target: presence, segments, availability in all three splits, errors with and without it."""
    total = rows.select("sequence", "frame_idx").distinct().agg(F.count("*")).scalar()
    here = F.col("present")
    out = rows.groupBy("target").agg(
        F.count_if(here).alias("present_frames"), F.collect_set(F.when(here, F.col("split"))).alias("_splits"),
        F.avg(F.when(here, F.col("position_error"))).alias("mean_present"),
        F.avg(F.when(~here, F.col("position_error"))).alias("mean_absent"))
    seg = islands(rows.where(here), ["sequence", "target"], "frame_idx", [], max_gap, min_frames)
    out = out.join(seg.groupBy("target").agg(F.count("*").alias("segments")), "target", "left")
    every = F.lit(True)
    for s in ("train", "validation", "blind_test"):
        every = every & F.array_contains("_splits", s)
    return out.select("target", "present_frames", (F.col("present_frames") / F.greatest(total, F.lit(1))).alias("present_ratio"),
                      F.coalesce("segments", F.lit(0)).alias("segments"), every.alias("cross_split"), "mean_present", "mean_absent")


def hard_frames(rows: DataFrame, quantile: float) -> DataFrame:
    """Present rows at or above their sequence's error quantile."""
    limit = exact_quantiles(rows, "sequence", "position_error", {"_limit": quantile})
    return rows.where("present").join(limit, "sequence").where(F.col("position_error") >= F.col("_limit")).drop("_limit")


def spike_study(frames: DataFrame, person: float, spike: float) -> DataFrame:
    """Counts, conditional means and correlations of errors with exposure per sequence."""
    p, s, e = F.col("person_ratio") >= F.lit(person), F.col("position_error") >= F.lit(spike), F.col("position_error")
    return frames.groupBy("sequence").agg(
        F.count("*").alias("frames"), F.count_if(p).alias("person_frames"), F.count_if(s).alias("spike_frames"),
        F.count_if(p & s).alias("person_spikes"), F.avg(F.when(p, e)).alias("mean_person"), F.avg(F.when(~p, e)).alias("mean_other"),
        M.safe_correlation("position_error", "person_ratio").alias("corr_person"),
        M.safe_correlation("position_error", "semi_ratio").alias("corr_dynamic"))


def map_rerank(scores: dict[str, DataFrame], weight: float) -> DataFrame:
    """(method, sequence, frame_idx, position_error, patch_id): the candidate chosen by the first score alone, by each map's blend and by the oracle.

    scores: method name to candidates (sequence, frame_idx, cand, patch_id, final_score, position_error, semantic_score), the same candidates
    scored against different stability layers.
    """
    keys, out = ["sequence", "frame_idx", "cand"], None
    for name, one in scores.items():
        one = one.withColumnRenamed("semantic_score", f"_s_{name}")
        out = one if out is None else out.join(one.select(*keys, f"_s_{name}"), keys)
    methods = {name: F.round(F.col("final_score") + F.lit(weight) * F.col(f"_s_{name}"), 9) for name in scores}
    return rerank_methods(out, {"candidate_final_score": F.col("final_score"), **methods, "oracle_topk": -F.col("position_error")})


def spike_runs(frames: DataFrame, spike: float) -> DataFrame:
    """Runs of consecutive frames with an error of at least `spike`: ends, length, peak and greatest exposures, ranked by peak over all."""
    rows = run_starts(frames.where(F.col("position_error") >= F.lit(spike)), "sequence", "frame_idx")
    runs = rows.groupBy("sequence", F.col("run_start").alias("frame_start")).agg(
        F.max("frame_idx").alias("frame_end"), F.count("*").alias("frames"), F.max("position_error").alias("peak_error"),
        F.max(F.struct("position_error", -F.col("frame_idx"))).alias("_p"), F.max("person_ratio").alias("max_person"), F.max("semi_ratio").alias("max_dynamic"))
    runs = runs.withColumn("peak_frame", -F.col("_p.col2")).drop("_p")
    return ranked(runs, [], "peak_error", [F.col("sequence"), F.col("frame_start")], name="position")


def top_frames(frames: DataFrame, n: int) -> DataFrame:
    """The n frames of each sequence with the greatest error, and those with the greatest person exposure (the earlier one on ties)."""
    lists = [top_n(frames, ["sequence"], [F.desc(c), F.col("frame_idx")], n).select(F.lit(name).alias("list"), "sequence", "frame_idx", F.col(c).alias("value"), "rank")
             for name, c in (("error", "position_error"), ("person", "person_ratio"))]
    return lists[0].unionByName(lists[1])


def stability_diagnostic(frames: DataFrame, local: DataFrame) -> DataFrame:
    """How position errors go with the map's stability around a frame: correlation, and mean errors of the lowest and highest quarter.

    frames: sequence, frame_idx, position_error; local: sequence, frame_idx, local_stability. Frames without cells nearby don't count.
    """
    rows = cut(frames.select("sequence", "frame_idx", "position_error").join(local, ["sequence", "frame_idx"]))
    out = rows.agg(M.safe_correlation("local_stability", "position_error").alias("correlation"), F.count("*").alias("frames"))
    q = M.quartile_contrast(rows, "local_stability", "position_error")
    return out.withColumns({c: q.select(c).scalar() for c in ("low_n", "high_n", "low_mean", "high_mean")})


def exposure_by_group(rows: DataFrame, group: str, ratio: str, trigger: float) -> DataFrame:
    """Frames, mean and median exposure and share strictly above the trigger (missing exposures do not count)."""
    out = rows.groupBy(group).agg(F.count("*").alias("frames"), F.avg(ratio).alias("mean_ratio"),
                                  F.avg((F.col(ratio) > F.lit(trigger)).cast("double")).alias("trigger_rate"))
    return with_quantiles(out, rows, group, ratio, {"median_ratio": 0.5})


def case_control_queue(picked: DataFrame, controls: DataFrame, radius: int) -> DataFrame:
    """Interleaved review rows: each chosen error segment, then its control if there is one.

    The queue is bounded by the number of chosen segments.
    """
    cases = picked.select("split", "position", F.lit(0).alias("_side"), F.lit("high_error").alias("condition"), "sequence",
                          "anchor_frame", "start_frame", "end_frame")
    ctl = controls.where(F.col("control_frame").isNotNull()).select(
        "split", "position", F.lit(1).alias("_side"), F.lit("normal_control").alias("condition"), "sequence",
        F.col("control_frame").alias("anchor_frame"), "start_frame", "end_frame")
    rows = cases.unionByName(ctl)
    code = F.when(F.col("split") == "train", 1).when(F.col("split") == "validation", 2).otherwise(0)
    rows = rows.withColumn("_order", code * 1.0e9 + F.col("position") * 2 + F.col("_side"))
    out = ranked(rows, [], "_order", [], descending=False, name="review_order")
    return out.select("review_order", "split", "condition", "sequence", "anchor_frame",
                      F.greatest(F.lit(0), F.col("anchor_frame") - radius).alias("window_start"),
                      (F.col("anchor_frame") + radius).alias("window_end"), "start_frame", "end_frame")


def pose_success(candidates: DataFrame, error: str, limit: float = 0.5) -> DataFrame:
    """Mean reciprocal rank of the first candidate below the limit, and how often there is one, per sequence."""
    rank = F.min(F.when(F.col(error) < F.lit(limit), F.col("cand") + 1))
    per = candidates.groupBy("sequence", "frame_idx").agg(rank.alias("r"))
    return per.groupBy("sequence").agg(F.avg(F.coalesce(1.0 / F.col("r"), F.lit(0.0))).alias("mrr"),
                                       F.avg(F.col("r").isNotNull().cast("double")).alias("recall"))


SALTS = 8  # tasks that share the points of one map cell


def semantic_candidate_scores(points: DataFrame, candidates: DataFrame, probabilities: DataFrame, stability: DataFrame,
                              size: float) -> DataFrame:
    """Agreement of each candidate pose with the map: weighted label share * (0.5 + 0.5 stability) * sqrt(coverage).

    points: frame, x, y, label; candidates: frame, cand, planar pose; probabilities: ix, iy, label, p;
    stability: ix, iy, stability. Labels without weight do not take part.
    """
    from spoorgrid.functions.cells import cell_of, label_weight
    from spoorgrid.functions.pose import rotate_xy

    frame = ["sequence", "frame_idx"]
    rows, each = points.count(), candidates.groupBy(*frame).count().agg(F.max("count")).first()[0] or 0
    p = points.withColumn("_w", label_weight("label")).where((F.col("label") > 0) & (F.col("_w") > 0))
    p = dealt(p.select(*frame, F.col("x").alias("_px"), F.col("y").alias("_py"), "label", "_w"), rows, *frame)
    j = candidates.select(*frame, "cand", "x", "y", "yaw").join(p, frame)
    rx, ry = rotate_xy("_px", "_py", "yaw")
    j = j.withColumns({"ix": cell_of(rx + F.col("x"), size), "iy": cell_of(ry + F.col("y"), size)})
    # points of one pose share cells, so they are combined before they meet the map
    j = j.groupBy(*frame, "cand", "ix", "iy", "label").agg(F.sum("_w").alias("_w"), F.count("*").alias("_c"))
    # one row per cell and salt, so that a cell seen from many frames is several tasks' work
    shares = probabilities.groupBy("ix", "iy").agg(F.map_from_entries(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "p")))).alias("_shares"))
    cells = shares.join(stability, ["ix", "iy"], "left").select(
        "ix", "iy", "_shares", F.lit(True).alias("_known"), F.coalesce("stability", F.lit(0.0)).alias("_s"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    j = dealt(j.withColumn("_salt", F.pmod(F.xxhash64(*frame), F.lit(SALTS)).cast("int")), rows * each, "ix", "iy", "_salt")
    j = j.join(cells, ["ix", "iy", "_salt"], "left").withColumn("p", F.try_element_at("_shares", F.col("label")))
    known = F.col("_known").isNotNull()
    value = F.coalesce("p", F.lit(0.0)) * (0.5 + 0.5 * F.col("_s")) * F.col("_w")
    g = j.groupBy(*frame, "cand").agg(F.sum("_w").alias("_all"), F.sum(F.when(known, F.col("_w"))).alias("_hit"),
                                      F.sum(F.when(known, value)).alias("_v"), F.sum(F.when(known, F.col("_c"))).alias("_n"))
    cover = F.coalesce(F.col("_hit"), F.lit(0.0)) / F.greatest("_all", F.lit(1.0e-6))
    score = F.when(F.col("_hit") > 0, F.col("_v") / F.col("_hit") * F.sqrt(cover)).otherwise(0.0)
    out = candidates.join(g, [*frame, "cand"], "left")
    return out.select(*candidates.columns, F.coalesce(score, F.lit(0.0)).alias("semantic_score"),
                      F.coalesce(cover, F.lit(0.0)).alias("semantic_coverage"), F.coalesce("_n", F.lit(0)).alias("semantic_points"))


def rerank_methods(candidates: DataFrame, methods: dict[str, Column]) -> DataFrame:
    """For each method the chosen candidate (highest value, first on ties) per frame, in one pass."""
    aggs = [F.max_by(F.struct("patch_id", "position_error"), F.struct(v, -F.col("cand"))).alias(m) for m, v in methods.items()]
    g = candidates.groupBy("sequence", "frame_idx").agg(*aggs)
    rows = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m + ".patch_id").alias("patch_id"),
                              F.col(m + ".position_error").alias("position_error")) for m in methods])
    return g.select("sequence", "frame_idx", F.inline(rows))
