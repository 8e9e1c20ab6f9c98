"""Per-frame decision rules. Candidates of a frame are a short array, so every rule is one projection.

Ordered rules that carry state along a sequence live in `relay`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorgrid.functions.cells import finite
from spoorgrid.functions.plan import settled
from spoorgrid.functions.pose import yaw_gap_deg


@dataclass(frozen=True)
class DecisionConfig:
    """Weights and limits of the localisation decisions (defaults are the published ones)."""

    retrieval_weight: float = 0.2
    bev_weight: float = 0.35
    inlier_weight: float = 0.35
    rmse_weight: float = 0.10
    invalid_penalty: float = 1.0
    temporal_weight: float = 0.0
    position_sigma: float = 1.5
    yaw_sigma: float = 20.0
    max_position_jump: float | None = None
    max_yaw_jump: float | None = None
    deep_weight: float = 0.35
    confidence_weight: float = 0.10
    gate_min_bev: float = 0.10
    gate_min_inlier: float = 0.60
    valid_bonus: float = 0.5
    xy_consistency: float = 0.05
    yaw_consistency: float = 0.01
    low_prob: float | None = None
    low_margin: float = 0.0
    high_prob: float | None = None
    high_margin: float = 0.0
    release_streak: int | None = None
    release_prob: float | None = None
    release_margin: float = 0.0
    sticky_streak: int | None = None
    sticky_prev_prob: float | None = None
    sticky_prob: float | None = None
    sticky_margin: float = 0.0
    occlusion_limit: float | None = None
    stabilizer_jump: float = 2.5
    stabilizer_yaw: float = 20.0
    stabilizer_min_inlier: float = 0.55
    stabilizer_min_bev: float = 0.08
    stabilizer_margin: float = 0.20
    stabilizer_bonus: float = 0.10
    stabilizer_fallback: bool = True
    confusion_gap: float = 0.30
    confusion_bev: float = 0.80
    confusion_inlier: float = 1.20
    confusion_rmse: float = 0.30
    confusion_margin: float = 0.0
    rerank_prob: float = 0.80
    rerank_margin: float = 0.20
    rerank_gap: float = 0.25
    pair_weight: float = 0.20
    pair_gap: float = 0.30


def first_best(value, score: str, order: str = "cand") -> Column:
    """Aggregate: value of the row with the highest score, the first in `order` on ties."""
    return F.max_by(value, F.struct(F.col(score), -F.col(order)))


def _clip01(c) -> Column:
    return F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))


def finite_rmse(rmse) -> Column:
    """Missing or infinite rmse counts as 10."""
    return F.when(finite(rmse), rmse).otherwise(F.lit(10.0))


def temporal_score(dxy: Column, dyaw_deg: Column, cfg: DecisionConfig, predicted: Column | None = None) -> Column:
    """Gaussian agreement with a predicted pose; 0 without prediction or weight."""
    if cfg.temporal_weight <= 0:
        return F.lit(0.0)
    sx, sy = max(cfg.position_sigma, 1.0e-6), max(cfg.yaw_sigma, 1.0e-6)
    score = F.exp(-0.5 * F.pow(dxy / sx, F.lit(2.0)) - 0.5 * F.pow(dyaw_deg / sy, F.lit(2.0)))
    known = dxy.isNotNull() if predicted is None else predicted
    return F.when(known, score).otherwise(0.0)


def temporal_gate(dxy: Column, dyaw_deg: Column, cfg: DecisionConfig) -> Column:
    """FALSE when a known jump exceeds its limit."""
    ok = F.lit(True)
    if cfg.max_position_jump is not None:
        ok = ok & ~F.coalesce(dxy > F.lit(cfg.max_position_jump), F.lit(False))
    if cfg.max_yaw_jump is not None:
        ok = ok & ~F.coalesce(dyaw_deg > F.lit(cfg.max_yaw_jump), F.lit(False))
    return ok


def geometry_gate(valid: Column, bev: Column, inlier: Column, cfg: DecisionConfig) -> Column:
    """How much the learned terms count, given the geometric support."""
    floor = min(max(cfg.gate_min_inlier, 0.0), 0.999999)
    bev_support = _clip01(bev / F.lit(max(cfg.gate_min_bev, 1.0e-6)))
    return F.when(valid, bev_support * _clip01((inlier - floor) / (1.0 - floor))).otherwise(0.0)


def geometric_score(coarse, bev, inlier, rmse, valid, temporal, gate_ok, cfg: DecisionConfig) -> Column:
    """Score without learned terms; candidates outside the temporal gate sink to -1e9."""
    s = (cfg.retrieval_weight * coarse + cfg.bev_weight * bev + cfg.inlier_weight * inlier
         - cfg.rmse_weight * finite_rmse(rmse) + cfg.temporal_weight * temporal
         - F.when(valid, 0.0).otherwise(cfg.invalid_penalty))
    return F.when(gate_ok, s).otherwise(F.lit(-1.0e9))


def unary_score(coarse, bev, inlier, rmse, deep, confidence, valid, cfg: DecisionConfig) -> Column:
    """Candidate score with learned terms gated by geometry."""
    gate = geometry_gate(valid, bev, inlier, cfg)
    return (cfg.retrieval_weight * coarse + cfg.bev_weight * bev + cfg.inlier_weight * inlier
            - cfg.rmse_weight * finite_rmse(rmse) + cfg.deep_weight * deep * gate + cfg.confidence_weight * confidence * gate
            - F.when(valid, 0.0).otherwise(cfg.invalid_penalty))


def tracker_admissible(inlier, rmse, min_inlier: float | None, max_rmse: float | None) -> Column:
    """Quality bounds of the tracker hypothesis."""
    ok = F.lit(True)
    if min_inlier is not None:
        ok = ok & (inlier >= F.lit(min_inlier))
    if max_rmse is not None:
        ok = ok & finite(rmse) & (rmse <= F.lit(max_rmse))
    return ok


def consistent_with_any(x, y, yaw, references: Column, max_xy: float | None, max_yaw: float | None) -> Column:
    """TRUE when some valid reference (array of structs x, y, yaw, valid) is within both limits."""
    if max_xy is None or max_yaw is None:
        return F.lit(True)
    return F.exists(references, lambda r: r["valid"] & (F.sqrt((x - r["x"]) * (x - r["x"]) + (y - r["y"]) * (y - r["y"])) <= F.lit(max_xy))
                    & (yaw_gap_deg(yaw, r["yaw"]) <= F.lit(max_yaw)))


def choose_hypothesis(df: DataFrame, hypotheses: Column, cfg: DecisionConfig, deep: str, streak: str | None = None,
                      sticky: Column | None = None, occlusion: str | None = None, out: str = "chosen") -> DataFrame:
    """Pick one initialisation per candidate.

    `hypotheses` is an array of structs (source, valid, bev, inlier, rmse, temporal, xy_gap, yaw_gap) in the
    order bev_init, deep_init, tracker_init, NULL entries skipped. Under each active margin rule the tracker
    needs to beat the best other source by that margin. An occluded deep winner takes the tracker's pose.
    """
    def score(h):
        bonus = F.when(h["valid"], F.lit(cfg.valid_bonus)).otherwise(F.lit(-cfg.invalid_penalty))
        return (bonus + cfg.bev_weight * h["bev"] + cfg.inlier_weight * h["inlier"] - cfg.rmse_weight * finite_rmse(h["rmse"])
                + cfg.temporal_weight * h["temporal"] - cfg.xy_consistency * h["xy_gap"] - cfg.yaw_consistency * h["yaw_gap"])

    given = F.filter(hypotheses, lambda h: h.isNotNull())
    scored = F.transform(given, lambda h, i: F.struct(score(h).alias("score"), (-i).alias("first"), h["source"].alias("source"),
                                                      h["temporal"].alias("temporal")))
    df = df.withColumn("_h", scored)
    p = F.col(deep)
    rules: list[tuple[Column, float]] = []
    if cfg.low_prob is not None:
        rules.append((p < F.lit(cfg.low_prob), cfg.low_margin))
    if cfg.high_prob is not None:
        rules.append((p >= F.lit(cfg.high_prob), cfg.high_margin))
    if cfg.release_streak is not None and streak is not None:
        on = F.col(streak) >= cfg.release_streak
        rules.append((on if cfg.release_prob is None else on & (p >= F.lit(cfg.release_prob)), cfg.release_margin))
    if cfg.sticky_streak is not None and sticky is not None:
        rules.append((sticky if cfg.sticky_prob is None else sticky & (p >= F.lit(cfg.sticky_prob)), cfg.sticky_margin))
    need = F.lit(float("-inf"))
    for on, margin in rules:
        need = F.greatest(need, F.when(F.coalesce(on, F.lit(False)), F.lit(float(margin))).otherwise(F.lit(float("-inf"))))
    df = df.withColumn("_need", need)
    other = F.array_max(F.transform(F.filter("_h", lambda h: h["source"] != "tracker_init"), lambda h: h["score"]))
    df = df.withColumn("_other", other)
    kept = F.filter("_h", lambda h: (h["source"] != "tracker_init") | (F.col("_need") == F.lit(float("-inf")))
                    | (h["score"] >= F.col("_other") + F.col("_need")))
    df = df.withColumn("_kept", kept).withColumn("_best", F.array_max("_kept"))
    tracker = F.get(F.filter("_kept", lambda h: h["source"] == "tracker_init"), F.lit(0))
    best = F.struct(F.col("_best.source").alias("source"), F.col("_best.score").alias("score"), F.col("_best.temporal").alias("temporal"))
    if cfg.occlusion_limit is not None and occlusion is not None:
        swap = ((F.col("_best.source") == "deep_init") & (F.coalesce(F.col(occlusion), F.lit(0.0)) >= F.lit(cfg.occlusion_limit))
                & tracker.isNotNull())
        moved = F.struct(F.lit("deep_score_tracker_pose").alias("source"), F.col("_best.score").alias("score"),
                         tracker["temporal"].alias("temporal"))
        best = F.when(swap, moved).otherwise(best)
    return df.withColumn(out, best).drop("_h", "_need", "_other", "_kept", "_best")


def gate_features(f: dict[str, Column]) -> Column:
    """Nineteen reliability features: missing to zero, rmse clipped to three and scaled, availability flags."""
    def zero(name):
        return F.when(finite(f[name]), f[name].cast("double")).otherwise(0.0)

    def rmse(name):
        return F.when(finite(f[name]), F.greatest(F.least(f[name], F.lit(3.0)), F.lit(0.0)) / 3.0).otherwise(1.0)

    deep_bev = F.coalesce(f["deep_bev"], f["bev"])
    return F.array(zero("deep_prob"), zero("confidence"), zero("bev"), F.when(finite(deep_bev), deep_bev).otherwise(0.0),
                   zero("bev_inlier"), zero("deep_inlier"), zero("tracker_inlier"), rmse("bev_rmse"), rmse("deep_rmse"),
                   rmse("tracker_rmse"), zero("bev_temporal"), zero("deep_temporal"), zero("tracker_temporal"), F.lit(1.0),
                   f["deep_available"].cast("double"), f["tracker_available"].cast("double"), zero("person"), zero("dynamic"),
                   zero("movable"))


SOURCES = ("bev_init", "deep_init", "tracker_init")


def baseline_source(init_source) -> Column:
    """Source behind a selection mode; unknown modes count as bev_init."""
    c = F.col(init_source)
    return F.when(c == "deep_score_tracker_pose", "tracker_init").when(c.isin(*SOURCES), c).otherwise("bev_init")


def _pick(values: list[Column], available: list[Column], lowest: bool) -> Column:
    """Struct (value, source) of the extreme available source, the first on ties."""
    rows = F.array(*[F.when(a, F.struct((-v if lowest else v).alias("v"), F.lit(-i).alias("o"), F.lit(s).alias("source")))
                     for i, (v, a, s) in enumerate(zip(values, available, SOURCES))])
    return F.array_max(F.filter(rows, lambda r: r.isNotNull()))


def gate_by_probability(probabilities: list[Column], available: list[Column], baseline: Column, minimum: float) -> Column:
    """The most probable available source when confident enough, else the baseline."""
    best = _pick(probabilities, available, False)
    return F.when(best["v"] >= F.lit(float(minimum)), best["source"]).otherwise(baseline)


def gate_by_risk(df: DataFrame, logits: list[str], available: list[Column], baseline: str, gain) -> DataFrame:
    """Add `decision` and the predicted `improvement`: the lowest-risk available source if it promises at least
    `gain` (number or column), else the baseline. The risk of a source is expm1 of its logit, at least 0.
    """
    risks = [F.greatest(F.expm1(c), F.lit(0.0)) for c in logits]
    base = F.coalesce(*[F.when(F.col(baseline) == s, r) for s, r in zip(SOURCES, risks)])
    df = settled(df, {"_best": _pick(risks, available, True), "_base": base})
    df = df.withColumn("improvement", F.col("_base") + F.col("_best.v")).drop("_base")
    need = F.lit(float(gain)) if isinstance(gain, (int, float)) else gain
    take = (F.col("_best.source") != F.col(baseline)) & (F.col("improvement") >= need)
    return df.withColumn("decision", F.when(take, F.col("_best.source")).otherwise(F.col(baseline))).drop("_best")


def confusion_score(c: Column, cfg: DecisionConfig) -> Column:
    """Geometric score used by the confusion rules; -1e9 for invalid candidates."""
    s = cfg.confusion_bev * c["bev_score"] + cfg.confusion_inlier * c["icp_inlier_ratio"] - cfg.confusion_rmse * finite_rmse(c["icp_rmse"])
    return F.when(c["icp_valid"], s).otherwise(F.lit(-1.0e9))


def _pair_listed(a: Column, b: Column, pairs: list[tuple[int, int]]) -> Column:
    hit = F.lit(False)
    for p, q in pairs:
        hit = hit | (F.least(a, b) == min(p, q)) & (F.greatest(a, b) == max(p, q))
    return hit


def confusion_override(candidates: Column, pairs: list[tuple[int, int]], cfg: DecisionConfig) -> Column:
    """TRUE when the runner-up of a listed pair, close in score, has clearly better geometry."""
    a, b = F.get(candidates, F.lit(0)), F.get(candidates, F.lit(1))
    ok = (_pair_listed(a["patch_id"], b["patch_id"], pairs) & (a["final_score"] - b["final_score"] <= F.lit(cfg.confusion_gap))
          & (confusion_score(b, cfg) > confusion_score(a, cfg) + F.lit(cfg.confusion_margin)))
    return F.coalesce(ok, F.lit(False))


def rerank_override(candidates: Column, cfg: DecisionConfig, pairs: list[tuple[int, int]] | None = None) -> Column:
    """TRUE when the re-ranker's best candidate is the runner-up, confident and close enough."""
    probs = F.transform(candidates, lambda c, i: F.struct(F.coalesce(c["rerank_probability"], F.lit(0.0)).alias("p"), (-i).alias("o")))
    order = F.sort_array(probs, asc=False)
    a, b = F.get(candidates, F.lit(0)), F.get(candidates, F.lit(1))
    first, second = F.get(order, F.lit(0)), F.get(order, F.lit(1))
    ok = ((first["o"] == -1) & (first["p"] >= F.lit(cfg.rerank_prob)) & (first["p"] - second["p"] >= F.lit(cfg.rerank_margin))
          & (a["final_score"] - b["final_score"] <= F.lit(cfg.rerank_gap)))
    if pairs:
        ok = ok & _pair_listed(a["patch_id"], b["patch_id"], pairs)
    return F.coalesce(ok, F.lit(False))


def pair_adjusted(frames: DataFrame, pair_scores: DataFrame, cfg: DecisionConfig, top2_only: bool = True,
                  skip_bev: float | None = None, skip_inlier: float | None = None, skip_lower_by: float | None = None) -> DataFrame:
    """Shift both members of a resolved confusion pair by weight * (p - 0.5).

    frames: sequence, frame_idx, candidate_results ordered by score; pair_scores: sequence, frame_idx,
    patch_a, patch_b, p_a (probability that a is right). Adds `adjusted`: an array of final scores.
    """
    a, b = F.get("candidate_results", F.lit(0)), F.get("candidate_results", F.lit(1))
    j = frames.join(pair_scores, ["sequence", "frame_idx"], "left")

    def member(patch):
        return F.get(F.filter("candidate_results", lambda c: c["patch_id"] == patch), F.lit(0))

    ca, cb = member(F.col("patch_a")), member(F.col("patch_b"))
    ok = ca.isNotNull() & cb.isNotNull()
    if top2_only:
        top = (F.array_sort(F.array(a["patch_id"], b["patch_id"])) == F.array_sort(F.array("patch_a", "patch_b")))
        ok = ok & top & (a["final_score"] - b["final_score"] <= F.lit(cfg.pair_gap))
        if skip_bev is not None and skip_inlier is not None:
            ok = ok & ~((a["bev_score"] >= F.lit(skip_bev)) & (a["icp_inlier_ratio"] >= F.lit(skip_inlier)))
    if skip_lower_by is not None:
        wins = F.col("p_a") >= 0.5
        winner = F.when(wins, ca["deep_match_probability"]).otherwise(cb["deep_match_probability"])
        loser = F.when(wins, cb["deep_match_probability"]).otherwise(ca["deep_match_probability"])
        ok = ok & ~(winner + F.lit(skip_lower_by) < loser)
    j = j.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    shift = F.lit(cfg.pair_weight) * (F.col("p_a") - 0.5)

    def adjust(c):
        return c["final_score"] + F.when(F.col("_ok") & (c["patch_id"] == F.col("patch_a")), shift).when(
            F.col("_ok") & (c["patch_id"] == F.col("patch_b")), -shift).otherwise(0.0)

    return j.withColumn("adjusted", F.transform("candidate_results", adjust)).drop("_ok", "patch_a", "patch_b", "p_a")


def support(c: Column, cfg: DecisionConfig) -> Column:
    """Clipped geometric support of a candidate."""
    s = (_clip01(c["bev_score"] / F.lit(max(cfg.stabilizer_min_bev, 1.0e-6)))
         * _clip01(c["icp_inlier_ratio"] / F.lit(max(cfg.stabilizer_min_inlier, 1.0e-6))))
    return F.when(c["icp_valid"], s).otherwise(0.0)


def stabilised(candidates: Column, cfg: DecisionConfig, selected: Column | None = None) -> Column:
    """Struct (mode, idx) after the stabiliser; candidates carry jump_xy, jump_yaw and temporal_score.

    The best candidate within both jump limits replaces the selection if it is not much worse; when none is
    within the limits and the selection lacks support, the predicted pose is used (idx -1).
    """
    selected = F.lit(0) if selected is None else selected

    def value(c):
        return c["final_score"] + cfg.stabilizer_bonus * c["temporal_score"]

    rows = F.transform(candidates, lambda c, i: F.struct(value(c).alias("s"), (-i).alias("o"), c["jump_xy"].alias("xy"), c["jump_yaw"].alias("w")))
    inside = F.filter(rows, lambda r: (r["xy"] <= F.lit(cfg.stabilizer_jump)) & (r["w"] <= F.lit(cfg.stabilizer_yaw)))
    best = F.array_max(F.transform(inside, lambda r: F.struct(r["s"].alias("s"), r["o"].alias("o"))))
    current = F.get(candidates, selected)
    move = best.isNotNull() & (-best["o"] != selected) & (best["s"] >= value(current) - F.lit(cfg.stabilizer_margin))
    fall = best.isNull() & F.lit(cfg.stabilizer_fallback) & (support(current, cfg) < 1.0)

    def result(mode, idx):
        return F.struct(F.lit(mode).alias("mode"), idx.cast("int").alias("idx"))

    return F.when(move, result("online_stabilized", -best["o"])).when(fall, result("online_tracker_fallback", F.lit(-1))).otherwise(
        result("unchanged", selected))


def merge_filtered(filtered: DataFrame, raw: DataFrame, keys: list[str]) -> DataFrame:
    """Per patch the filtered geometry if valid and not worse on inliers and rmse, else the raw one."""
    r = raw.select(*keys, F.col("inlier").alias("_i"), F.col("rmse").alias("_r"), F.col("valid").alias("_v"))
    j = filtered.join(r, keys, "left")
    use = F.col("_v").isNull() | (F.col("valid") & (~F.col("_v") | ((F.col("inlier") >= F.col("_i")) & (F.col("rmse") <= F.col("_r")))))
    return j.select(*keys, use.alias("accepted"), F.when(use, F.col("inlier")).otherwise(F.col("_i")).alias("inlier"),
                    F.when(use, F.col("rmse")).otherwise(F.col("_r")).alias("rmse"))


def persistent_override(frames: DataFrame, pairs: dict[int, int], cfg: DecisionConfig, topn: int = 4, min_run: int = 6,
                        min_score: float = 1.10, chunk: int | None = None) -> DataFrame:
    """Replace a patch by its listed target over runs in which the target stays near the top with good geometry.

    One target per source patch (then run islands decide exactly). Adds `override_patch` (NULL if none).
    """
    from spoorgrid.operators.chunks import CHUNK_ROWS, run_starts

    source = F.get("candidate_results", F.lit(0))["patch_id"]
    target = F.coalesce(*[F.when(source == s, F.lit(t)) for s, t in pairs.items()])
    f = frames.withColumn("_t", target)
    hit = F.get(F.filter(F.slice("candidate_results", 1, topn), lambda c: c["patch_id"] == F.col("_t")), F.lit(0))
    ok = f.withColumn("_g", F.when(hit.isNotNull(), confusion_score(hit, cfg))).where(F.col("_g") >= F.lit(min_score))
    ok = ok.select("sequence", "frame_idx", F.col("_t").alias("override_patch"), source.alias("_source"))
    runs = run_starts(ok, ["sequence"], "frame_idx", "_source", chunk=chunk or CHUNK_ROWS)
    long = runs.groupBy("sequence", "run_start").agg(F.count("*").alias("_n")).where(F.col("_n") >= max(2, min_run))
    kept = runs.join(long, ["sequence", "run_start"]).select("sequence", "frame_idx", "override_patch", F.col("_n").alias("run_length"))
    return f.drop("_t").join(kept, ["sequence", "frame_idx"], "left")


def failure_category(selected, oracle, high: float = 0.20, usable: float = 0.20, coarse: float = 0.50) -> Column:
    """normal, selection failure, partial recovery or absence of a good candidate."""
    s, o = F.col(selected), F.col(oracle)
    return (F.when(s < high, "normal").when(o < usable, "topk_selection_failure")
            .when(o < coarse, "topk_partial_recovery_only").otherwise("topk_candidate_absence"))


def margin(values: Column, descending: bool) -> Column:
    """First minus second of the sorted finite values, NULL with fewer than two (ascending margins are <= 0)."""
    order = F.sort_array(F.filter(values, lambda v: finite(v)), asc=not descending)
    return F.when(F.size(order) >= 2, F.get(order, F.lit(0)) - F.get(order, F.lit(1)))


def high_quality(prefix: str = "") -> Column:
    """Component quality rule: tall, large, mostly valid depth and near."""
    c = {n: F.col(prefix + n) for n in ("height", "pixel_area", "valid_depth_ratio", "median_depth")}
    return ((c["height"] >= 32) & (c["pixel_area"] >= 400) & (c["valid_depth_ratio"] >= 0.70)
            & c["median_depth"].isNotNull() & (c["median_depth"] <= 8.0))


def sidecar(raw: DataFrame, refined: DataFrame, keys: list[str]) -> DataFrame:
    """Refined pose where the frame is triggered and the refinement is not worse; gain features either way.

    raw: keys, x, y, yaw, inlier, rmse, valid, triggered; refined: keys, rx, ry, ryaw, r_inlier, r_rmse, r_valid.
    """
    j = raw.join(refined, keys, "left")
    use = (F.col("triggered") & F.col("valid") & F.coalesce("r_valid", F.lit(False)) & (F.col("r_inlier") >= F.col("inlier"))
           & (F.col("r_rmse") <= F.col("rmse")))
    use = F.coalesce(use, F.lit(False))
    dx, dy = F.col("rx") - F.col("x"), F.col("ry") - F.col("y")
    return j.select(*raw.columns, use.alias("applied"), F.when(use, F.col("rx")).otherwise(F.col("x")).alias("out_x"),
                    F.when(use, F.col("ry")).otherwise(F.col("y")).alias("out_y"),
                    F.when(use, F.col("ryaw")).otherwise(F.col("yaw")).alias("out_yaw"),
                    F.when(use, F.col("r_inlier") - F.col("inlier")).alias("inlier_gain"),
                    F.when(use, F.col("rmse") - F.col("r_rmse")).alias("rmse_gain"),
                    F.when(use, F.sqrt(dx * dx + dy * dy)).alias("shift"),
                    F.when(use, yaw_gap_deg("ryaw", "yaw")).alias("turn_deg"))


