"""Queries on candidate decisions, gates, reruns and review queues."""

from pyspark.sql import functions as F

from spoorgrid.functions import cells as G
from spoorgrid.functions import pose as P
from spoorgrid.functions.plan import settled
from spoorgrid.operators import chunks, compare, decisions as D, learning, metrics, paths, registration, relay, review, sequence, spatial, vote
from spoorgrid.plans.catalog_maps import STORES, _labels, _store
from spoorgrid.plans.catalog_retrieval import _SUM, _SUM_REAL
from spoorgrid.plans.catalog_sequences import HIGH_QUALITY, diverse_sql
from spoorgrid.plans.registry import query
from spoorgrid.session import cut
from spoorgrid.sources import manifests, reports

FRAME = ["sequence", "frame_idx"]
C = ["patch_id", "final_score", "coarse_score", "bev_score", "icp_inlier_ratio", "icp_rmse", "icp_valid",
     "deep_match_probability", "init_source", "x", "y", "yaw", "rerank_probability"]


def _nested(src, *fields):
    """Frames with their candidates and the fields a rule reads, in the order of C: what is nested travels whole."""
    return reports.nest_candidates(src.candidates, list(fields) or C)


def _wrap_sql(a: str) -> str:
    return f"(({a} + pi()) - 2 * pi() * floor(({a} + pi()) / (2 * pi())) - pi())"


_JUMP = f"""j as (select *, sqrt(pow(x - pred_x, 2) + pow(y - pred_y, 2)) as dxy,
    abs(degrees({_wrap_sql('(yaw - pred_yaw)')})) as dyaw from candidates)"""
_GATE = "case when icp_valid then least(bev_score / 1e-1, 1) * greatest((icp_inlier_ratio - 6e-1) / 4e-1, 0) else 0 end"


@query("D1_unary_score", "candidates", f"""select event_id, cand, 2e-1 * coarse_score + 35e-2 * bev_score + 35e-2 * icp_inlier_ratio
    - 1e-1 * icp_rmse + 35e-2 * deep_match_probability * {_GATE} + 1e-1 * deep_pose_confidence * {_GATE}
    - case when icp_valid then 0 else 1 end as score from candidates""", real="score", whole="cand")
def _(src):
    s = D.unary_score(*[F.col(c) for c in ("coarse_score", "bev_score", "icp_inlier_ratio", "icp_rmse", "deep_match_probability",
                                           "deep_pose_confidence", "icp_valid")], D.DecisionConfig())
    return src.candidates.select("event_id", "cand", s.alias("score"))


@query("D2_temporal_score", "candidates", f"""with {_JUMP} select event_id, cand, dxy, dyaw,
    exp(-5e-1 * pow(dxy / 15e-1, 2) - 5e-1 * pow(dyaw / 20, 2)) as temporal_score, dxy <= 8e-1 and dyaw <= 10 as gate_ok from j""",
       real="dxy dyaw temporal_score", whole="cand")
def _(src):
    cfg = D.DecisionConfig(temporal_weight=0.1, max_position_jump=0.8, max_yaw_jump=10.0)
    c = src.candidates.withColumns({"dxy": P.xy_error("x", "y", "pred_x", "pred_y"), "dyaw": P.yaw_gap_deg("yaw", "pred_yaw")})
    return c.select("event_id", "cand", "dxy", "dyaw", D.temporal_score(F.col("dxy"), F.col("dyaw"), cfg).alias("temporal_score"),
                    D.temporal_gate(F.col("dxy"), F.col("dyaw"), cfg).alias("gate_ok"))


# three initialisations per candidate, by arithmetic on its columns
_HYP = """h as (select event_id, cand, deep_match_probability as p, event_id % 5 as streak, rerank_probability as occ,
    icp_valid as vb, bev_score as bb, icp_inlier_ratio as ib, icp_rmse as rb, coarse_score as tb,
    deep_pose_confidence > 3e-1 as vd, deep_pose_confidence * 3e-1 as bd, rerank_probability as id_, icp_rmse * 9e-1 as rd,
    rerank_probability > 6e-1 as vt, bev_score as bt, deep_match_probability as it, icp_rmse * 11e-1 as rt,
    event_id % 3 <> 0 as has_deep, event_id % 4 <> 0 as has_tracker from candidates),
    s as (select *, case when vb then 5e-1 else -1 end + 35e-2 * bb + 35e-2 * ib - 1e-1 * rb as sb,
    case when has_deep then case when vd then 5e-1 else -1 end + 35e-2 * bd + 35e-2 * id_ - 1e-1 * rd end as sd,
    case when has_tracker then case when vt then 5e-1 else -1 end + 35e-2 * bt + 35e-2 * it - 1e-1 * rt end as st from h),
    n as (select *, greatest(case when p < 3e-1 then 2e-1 else -1e9 end, case when p >= 8e-1 then 1e-1 else -1e9 end,
          case when streak >= 3 and p >= 5e-1 then 3e-1 else -1e9 end) as need, greatest(sb, coalesce(sd, -1e9)) as other from s),
    k as (select *, st is not null and (need < -1e8 or st >= other + need) as keep from n),
    b as (select *, case when keep and st > other then 'tracker_init' when sd is not null and sd > sb then 'deep_init'
          else 'bev_init' end as best, case when keep and st > other then st else other end as score from k)"""


@query("D3_hypothesis_choice", "candidates", f"""with {_HYP} select event_id, cand, case when best = 'deep_init' and occ >= 7e-1 and keep
    then 'deep_score_tracker_pose' else best end as source, score from b""", real="score", whole="cand")
def _(src):
    cfg = D.DecisionConfig(low_prob=0.3, low_margin=0.2, high_prob=0.8, high_margin=0.1, release_streak=3, release_prob=0.5,
                           release_margin=0.3, occlusion_limit=0.7)
    c = src.candidates.withColumn("streak", F.pmod("event_id", F.lit(5)))

    def hyp(source, valid, bev, inlier, rmse):
        return F.struct(F.lit(source).alias("source"), valid.alias("valid"), bev.alias("bev"), inlier.alias("inlier"),
                        rmse.alias("rmse"), F.lit(0.0).alias("temporal"), F.lit(0.0).alias("xy_gap"), F.lit(0.0).alias("yaw_gap"))

    k = F.col
    rows = F.array(
        hyp("bev_init", k("icp_valid"), k("bev_score"), k("icp_inlier_ratio"), k("icp_rmse")),
        F.when(k("event_id") % 3 != 0, hyp("deep_init", k("deep_pose_confidence") > 0.3, k("deep_pose_confidence") * 0.3,
                                           k("rerank_probability"), k("icp_rmse") * 0.9)),
        F.when(k("event_id") % 4 != 0, hyp("tracker_init", k("rerank_probability") > 0.6, k("bev_score"),
                                           k("deep_match_probability"), k("icp_rmse") * 1.1)))
    out = D.choose_hypothesis(c, rows, cfg, "deep_match_probability", "streak", None, "rerank_probability")
    return out.select("event_id", "cand", "chosen.source", "chosen.score")


@query("P27_hypothesis_predicates", "candidates", f"""select event_id, cand, icp_inlier_ratio >= 5e-1 and icp_rmse <= 4e-1 as quality,
    icp_valid and sqrt(pow(x - pred_x, 2) + pow(y - pred_y, 2)) <= 7e-1 and abs(degrees({_wrap_sql('(yaw - pred_yaw)')})) <= 8
    or sqrt(pow(x - gt_x, 2) + pow(y - gt_y, 2)) <= 7e-1 and abs(degrees({_wrap_sql('(yaw - gt_yaw)')})) <= 8 as consistent
    from candidates""", whole="cand")
def _(src):
    refs = F.array(F.struct(F.col("pred_x").alias("x"), F.col("pred_y").alias("y"), F.col("pred_yaw").alias("yaw"), F.col("icp_valid").alias("valid")),
                   F.struct(F.col("gt_x").alias("x"), F.col("gt_y").alias("y"), F.col("gt_yaw").alias("yaw"), F.lit(True).alias("valid")))
    return src.candidates.select("event_id", "cand", D.tracker_admissible(F.col("icp_inlier_ratio"), F.col("icp_rmse"), 0.5, 0.4).alias("quality"),
                                 D.consistent_with_any(F.col("x"), F.col("y"), F.col("yaw"), refs, 0.7, 8.0).alias("consistent"))


@query("P22_gate_features", "candidates", """select event_id, cand, 3 + case when event_id % 4 <> 0 then 1 else 0 end * 0 as base,
    deep_match_probability + deep_pose_confidence + bev_score + bev_score + icp_inlier_ratio as head,
    case when event_id % 3 <> 0 then rerank_probability else 0 end as deep_inlier, least(icp_rmse * 8, 3) / 3 as bev_rmse,
    case when event_id % 3 <> 0 then icp_rmse / 3 else 1 end as deep_rmse, 1e0 as tracker_rmse,
    1e0 + case when event_id % 3 <> 0 then 1 else 0 end as flags, 19 as size from candidates""",
       real="head deep_inlier bev_rmse deep_rmse tracker_rmse flags", whole="cand base size")
def _(src):
    has = F.col("event_id") % 3 != 0
    none = F.lit(None).cast("double")
    f = D.gate_features({
        "deep_prob": F.col("deep_match_probability"), "confidence": F.col("deep_pose_confidence"), "bev": F.col("bev_score"),
        "deep_bev": none, "bev_inlier": F.col("icp_inlier_ratio"), "deep_inlier": F.when(has, F.col("rerank_probability")),
        "tracker_inlier": F.lit(float("nan")), "bev_rmse": F.col("icp_rmse") * 8, "deep_rmse": F.when(has, F.col("icp_rmse")),
        "tracker_rmse": F.lit(float("inf")), "bev_temporal": none, "deep_temporal": none, "tracker_temporal": none,
        "deep_available": has, "tracker_available": F.lit(False), "person": none, "dynamic": none, "movable": none})
    c = src.candidates.withColumn("f", f)
    return c.select("event_id", "cand", F.lit(3).alias("base"), (F.col("f")[0] + F.col("f")[1] + F.col("f")[2] + F.col("f")[3] + F.col("f")[4]).alias("head"),
                    F.col("f")[5].alias("deep_inlier"), F.col("f")[7].alias("bev_rmse"), F.col("f")[8].alias("deep_rmse"),
                    F.col("f")[9].alias("tracker_rmse"), (F.col("f")[13] + F.col("f")[14] + F.col("f")[15]).alias("flags"),
                    F.size("f").alias("size"))


@query("W8_score_margins", "candidates", """with r as (select sequence, frame_idx,
    list_sort(list(final_score), 'DESC') as f, list_sort(list(icp_rmse)) as r, list_sort(list(icp_inlier_ratio), 'DESC') as i
    from candidates group by all)
    select sequence, frame_idx, f[1] - f[2] as final_margin, r[1] - r[2] as rmse_margin, i[1] - i[2] as inlier_margin from r""",
       real="final_margin rmse_margin inlier_margin", whole="sequence frame_idx")
def _(src):
    def values(name):
        return F.transform("candidate_results", lambda c: c[name])

    return _nested(src).select(*FRAME, D.margin(values("final_score"), True).alias("final_margin"),
                               D.margin(values("icp_rmse"), False).alias("rmse_margin"),
                               D.margin(values("icp_inlier_ratio"), True).alias("inlier_margin"))


_TOP2 = """t as (select sequence, frame_idx, max(patch_id) filter (where cand = 0) as pa, max(patch_id) filter (where cand = 1) as pb,
    max(final_score) filter (where cand = 0) - max(final_score) filter (where cand = 1) as gap,
    max(case when icp_valid then 8e-1 * bev_score + 12e-1 * icp_inlier_ratio - 3e-1 * icp_rmse else -1e9 end) filter (where cand = 0) as ga,
    max(case when icp_valid then 8e-1 * bev_score + 12e-1 * icp_inlier_ratio - 3e-1 * icp_rmse else -1e9 end) filter (where cand = 1) as gb,
    arg_max(cand, (rerank_probability, -cand)) as rbest, list_sort(list(rerank_probability), 'DESC') as rp,
    max(bev_score) filter (where cand = 0) as bev0, max(icp_inlier_ratio) filter (where cand = 0) as in0,
    max(deep_match_probability) filter (where cand = 0) as d0, max(deep_match_probability) filter (where cand = 1) as d1,
    max(final_score) filter (where cand = 0) as f0, max(final_score) filter (where cand = 1) as f1
    from candidates group by all)"""


@query("D5_confusion_override", "candidates", f"""with {_TOP2} select sequence, frame_idx, case when (least(pa, pb), greatest(pa, pb)) in
    ((3, 6), (0, 3), (9, 12), (5, 8)) and gap <= 3e-1 and gb > ga then pb else pa end as patch_id from t""",
       whole="sequence frame_idx patch_id")
def _(src):
    n = _nested(src)
    hit = D.confusion_override(F.col("candidate_results"), [(6, 3), (0, 3), (9, 12), (5, 8)], D.DecisionConfig())
    return n.select(*FRAME, F.when(hit, F.col("candidate_results")[1]["patch_id"]).otherwise(
        F.col("candidate_results")[0]["patch_id"]).alias("patch_id"))


@query("D6_rerank_override", "candidates", f"""with {_TOP2} select sequence, frame_idx, case when rbest = 1 and rp[1] >= 6e-1
    and rp[1] - rp[2] >= 1e-1 and gap <= 25e-2 then pb else pa end as patch_id from t""", whole="sequence frame_idx patch_id")
def _(src):
    hit = D.rerank_override(F.col("candidate_results"), D.DecisionConfig(rerank_prob=0.6, rerank_margin=0.1))
    return _nested(src).select(*FRAME, F.when(hit, F.col("candidate_results")[1]["patch_id"]).otherwise(
        F.col("candidate_results")[0]["patch_id"]).alias("patch_id"))


@query("D7_pair_adjustment", "candidates frames", f"""with {_TOP2}, a as (select t.*, f.semi_ratio * 4 as p_a, gap <= 3e-1
    and not (bev0 >= 2e-1 and in0 >= 8e-1) and not (case when f.semi_ratio * 4 >= 5e-1 then d0 else d1 end + 4e-1
    < case when f.semi_ratio * 4 >= 5e-1 then d1 else d0 end) as ok from t join frames f using (sequence, frame_idx))
    select sequence, frame_idx, f0 + case when ok then 2e-1 * (p_a - 5e-1) else 0 end as s0,
           f1 - case when ok then 2e-1 * (p_a - 5e-1) else 0 end as s1 from a""", real="s0 s1", whole="sequence frame_idx")
def _(src):
    n = _nested(src, "patch_id", "final_score", "bev_score", "icp_inlier_ratio", "deep_match_probability")
    pairs = n.join(src.frames.select(*FRAME, "semi_ratio"), FRAME).select(
        *FRAME, F.col("candidate_results")[0]["patch_id"].alias("patch_a"), F.col("candidate_results")[1]["patch_id"].alias("patch_b"),
        (F.col("semi_ratio") * 4).alias("p_a"))
    out = D.pair_adjusted(n, pairs, D.DecisionConfig(), True, 0.2, 0.8, 0.4)
    return out.select(*FRAME, F.col("adjusted")[0].alias("s0"), F.col("adjusted")[1].alias("s1"))


@query("D8_pose_stabiliser", "candidates", f"""with {_JUMP}, v as (select *, dxy <= 6e-1 and dyaw <= 8 as ok,
    final_score + 1e-1 * exp(-5e-1 * pow(dxy / 15e-1, 2) - 5e-1 * pow(dyaw / 20, 2)) as s,
    case when icp_valid then least(bev_score / 8e-2, 1) * least(icp_inlier_ratio / 55e-2, 1) else 0 end as sup from j),
    g as (select sequence, frame_idx, bool_or(ok) as any_ok, arg_max(cand, (s, -cand)) filter (where ok) as best,
          max(s) filter (where ok) as best_s, max(s) filter (where cand = 0) as cur, max(sup) filter (where cand = 0) as sup
          from v group by all)
    select sequence, frame_idx, case when any_ok and best <> 0 and best_s >= cur - 2e-1 then 'online_stabilized'
           when not any_ok and sup < 1 then 'online_tracker_fallback' else 'unchanged' end as mode,
           case when any_ok and best <> 0 and best_s >= cur - 2e-1 then best when not any_ok and sup < 1 then -1 else 0 end as idx from g""",
       whole="sequence frame_idx idx")
def _(src):
    cfg = D.DecisionConfig(temporal_weight=0.1, stabilizer_jump=0.6, stabilizer_yaw=8.0)
    c = src.candidates.withColumns({"jump_xy": P.xy_error("x", "y", "pred_x", "pred_y"), "jump_yaw": P.yaw_gap_deg("yaw", "pred_yaw")})
    c = c.withColumn("temporal_score", D.temporal_score(F.col("jump_xy"), F.col("jump_yaw"), cfg))
    n = reports.nest_candidates(c, ["final_score", "bev_score", "icp_inlier_ratio", "icp_valid", "jump_xy", "jump_yaw", "temporal_score"])
    return n.withColumn("r", D.stabilised(F.col("candidate_results"), cfg)).select(*FRAME, "r.mode", "r.idx")


@query("D10_persistent_override", "candidates", """with t as (select sequence, frame_idx, cand, patch_id, case when icp_valid then
    8e-1 * bev_score + 12e-1 * icp_inlier_ratio - 3e-1 * icp_rmse else -1e9 end as g from candidates),
    b as (select a.sequence, a.frame_idx, a.patch_id as source, a.patch_id + 3 as target from t a join t c
          on a.sequence = c.sequence and a.frame_idx = c.frame_idx and c.cand < 4 and c.patch_id = (a.patch_id + 3) % 16 and c.g >= 5e-1
          where a.cand = 0 and a.patch_id < 13),
    r as (select *, frame_idx - row_number() over (partition by sequence, source order by frame_idx) as grp from b),
    n as (select *, count(*) over (partition by sequence, source, grp) as run_length from r)
    select sequence, frame_idx, target as override_patch, run_length from n where run_length >= 2""",
       whole="sequence frame_idx override_patch")
def _(src):
    out = D.persistent_override(_nested(src), {s: s + 3 for s in range(13)}, D.DecisionConfig(), 4, 2, 0.5)
    return out.where("override_patch is not null").select(*FRAME, "override_patch", "run_length")


@query("D9_patch_hysteresis")
def _(src):
    cfg = relay.HysteresisConfig(margin=0.15, strong_prob=0.4, streak=2, release_streak=1, scale_min=0.5, scale_max=1.5,
                                 tracker_factor=1.2, min_advantage=0.02)
    return relay.patch_hysteresis(_nested(src), cfg, 1000)


@query("D11_sequence_smoothing", "candidates", """with recursive f as materialized (select sequence, frame_idx, cand, patch_id, x, y, yaw, final_score,
      dense_rank() over (partition by sequence order by frame_idx) as t from candidates),
    v as materialized (select sequence, t, cand, x, y, yaw, patch_id, final_score as s, -1 as back from f where t = 1
      union all
      select sequence, t, cand, any_value(x), any_value(y), any_value(yaw), any_value(patch_id), max(w) + any_value(final_score), arg_max(parent, w)
      from (select c.*, p.cand as parent, p.s - 5e-1 * (pow(c.x - p.x, 2) + pow(c.y - p.y, 2)) / 4e0 - 5e-1 * pow(degrees(abs(c.yaw - p.yaw + pi()
              - 2 * pi() * floor((c.yaw - p.yaw + pi()) / (2 * pi())) - pi())) / 3e1, 2) + case when c.patch_id = p.patch_id then 3e-1 else 0e0 end as w
            from v p join f c on c.sequence = p.sequence and c.t = p.t + 1) group by sequence, t, cand),
    ends as materialized (select sequence, max(t) as t from f group by sequence),
    path as (select sequence, t, arg_max(cand, s) as cand from v semi join ends using (sequence, t) group by sequence, t
      union all
      select p.sequence, p.t - 1, v.back from path p join v on v.sequence = p.sequence and v.t = p.t and v.cand = p.cand where p.t > 1)
    select f.sequence, f.frame_idx, f.cand as selected_idx, f.patch_id, v.s as path_score from path p
      join f on f.sequence = p.sequence and f.t = p.t and f.cand = p.cand join v on v.sequence = p.sequence and v.t = p.t and v.cand = p.cand""",
       real="path_score", whole="sequence frame_idx selected_idx patch_id")
def _(src):
    return paths.smooth_sequence(_nested(src), chunk=500)


@query("D12_beam_tracking")
def _(src):
    return relay.track_beam(_nested(src, "patch_id", "final_score", "x", "y", "yaw"), relay.BeamConfig())


@query("D13_prediction_rules", "frames", """with f as (select sequence, frame_idx, patch_id, semi_ratio < 15e-2 as tracker, event_type = 'view' as hysteresis,
    semi_ratio * 4 as prob, event_type = 'click' as overridden from frames),
    s as (select *, hysteresis and tracker and prob >= 1e-1 as held, overridden and tracker and prob >= 3e-1 as after from f),
    p as (select sequence, frame_idx, row_number() over w as rn, lag(held) over w and lag(held, 2) over w as streak,
          coalesce(lag(after) over w, false) or coalesce(lag(after, 2) over w, false) or coalesce(lag(after, 3) over w, false) as recent,
          lag(patch_id) over w is distinct from lag(patch_id, 2) over w as moved from s window w as (partition by sequence order by frame_idx))
    select sequence, frame_idx, rn > 2 and not coalesce(streak, false) and not recent and not moved as use_prediction from p""", whole="sequence frame_idx")
def _(src):
    f = src.frames.select(
        *FRAME, "patch_id", F.when(F.col("event_type") == "view", "online_patch_hysteresis").otherwise("online_best").alias("selection_mode"),
        F.when(F.col("semi_ratio") < 0.15, "tracker_init").otherwise("bev_init").alias("previous_source"),
        F.lit(1).alias("proposed_patch"), F.lit(2).alias("previous_patch"), (F.col("semi_ratio") * 4).alias("proposed_prob"),
        (F.col("event_type") == "click").alias("overridden"))
    return relay.relay(f, "sequence", "frame_idx", relay.suppression_step(2, 0.1, 3, 0.3, 2),
                       "sequence int, frame_idx int, use_prediction boolean")


_GATED = """g as (select *, case when init_source = 'deep_score_tracker_pose' then 'tracker_init' else init_source end as b0,
    exp(bev_logit) - 1 as rb, exp(deep_logit) - 1 as rd, greatest(exp(tracker_logit) - 1, 0) as rt from gate),
    h as (select *, case when b0 = 'deep_init' and deep_error is null or b0 = 'tracker_init' and tracker_error is null then 'bev_init'
          else b0 end as baseline_source, case when deep_error is null then 1e9 else rd end as rd2,
          case when tracker_error is null then 1e9 else rt end as rt2, coalesce(deep_error, 1e9) as de, coalesce(tracker_error, 1e9) as te from g),
    i as (select *, case when rb <= rd2 and rb <= rt2 then 'bev_init' when rd2 <= rt2 then 'deep_init' else 'tracker_init' end as low_source,
          least(rb, rd2, rt2) as low, case baseline_source when 'bev_init' then rb when 'deep_init' then rd else rt end as base_risk,
          case baseline_source when 'bev_init' then bev_error when 'deep_init' then deep_error else tracker_error end as baseline_error,
          least(bev_error, de, te) as oracle_error,
          case when bev_error <= de and bev_error <= te then 'bev_init' when de <= te then 'deep_init' else 'tracker_init' end as oracle_source
          from h),
    smp as (select *, base_risk - low as improvement, case when baseline_error - oracle_error < 2e-2 then baseline_source
            else oracle_source end as label_source from i)"""


def _gate(src):
    """Gate samples: baseline, oracle and label source per frame (Q9)."""
    g = src.gate
    avail = [F.lit(True), F.col("deep_error").isNotNull(), F.col("tracker_error").isNotNull()]
    errs = [F.col("bev_error"), F.col("deep_error"), F.col("tracker_error")]
    base = D.baseline_source("init_source")
    base = F.when((base == "deep_init") & ~avail[1] | (base == "tracker_init") & ~avail[2], "bev_init").otherwise(base)
    g = settled(g, {"baseline_source": base, "_o": D._pick(errs, avail, True)})
    g = settled(g, {"baseline_error": F.coalesce(*[F.when(F.col("baseline_source") == s, e) for s, e in zip(D.SOURCES, errs)]),
                       "oracle_error": -F.col("_o.v"), "oracle_source": F.col("_o.source")}).drop("_o")
    keep = F.col("baseline_error") - F.col("oracle_error") < 0.02
    return settled(g, {"label_source": F.when(keep, F.col("baseline_source")).otherwise(F.col("oracle_source"))}), avail


def _risk(g, avail, gain):
    """Decision and predicted improvement; `gain` is a number or a column."""
    return D.gate_by_risk(g, ["bev_logit", "deep_logit", "tracker_logit"], avail, "baseline_source", gain)


@query("D4_gate_by_risk", "gate", f"""with {_GATED} select sequence, frame_idx, case when low_source <> baseline_source
    and improvement >= 3e-2 then low_source else baseline_source end as decision, improvement from smp""", real="improvement",
       whole="sequence frame_idx")
def _(src):
    g, avail = _gate(src)
    return _risk(g, avail, 0.03).select(*FRAME, "decision", "improvement")


@query("D4_gate_by_probability", "gate", f"""with {_GATED}, p as (select *, bev_logit * 2 as pb, case when deep_error is null then -1 else
    deep_logit * 2 end as pd, case when tracker_error is null then -1 else tracker_logit * 2 end as pt from smp)
    select sequence, frame_idx, case when greatest(pb, pd, pt) >= 55e-2 then case when pb >= pd and pb >= pt then 'bev_init'
    when pd >= pt then 'deep_init' else 'tracker_init' end else baseline_source end as decision from p""", whole="sequence frame_idx")
def _(src):
    g, avail = _gate(src)
    p = [F.col(f"{s}_logit") * 2 for s in ("bev", "deep", "tracker")]
    return g.select(*FRAME, D.gate_by_probability(p, avail, F.col("baseline_source"), 0.55).alias("decision"))


@query("Q9_gate_samples", "gate", f"""with {_GATED} select sequence, frame_idx, baseline_source, oracle_source, label_source,
    baseline_error, oracle_error from smp""", real="baseline_error oracle_error", whole="sequence frame_idx")
def _(src):
    return _gate(src)[0].select(*FRAME, "baseline_source", "oracle_source", "label_source", "baseline_error", "oracle_error")


_ERR = """case decision when 'bev_init' then bev_error when 'deep_init' then deep_error else tracker_error end"""
_GQ = f"""avg((decision = label_source)::int) as action_accuracy, avg((decision <> baseline_source)::int) as apply_rate,
    avg(baseline_error) as baseline_mean, avg(oracle_error) as oracle_mean, avg(baseline_error) - avg(position_error) as improvement,
    avg(baseline_error) - avg(oracle_error) as headroom"""
_GQ_REAL = "action_accuracy apply_rate baseline_mean oracle_mean improvement headroom"


@query("Q10_gate_quality", "gate", f"""with {_GATED}, d as (select *, case when low_source <> baseline_source and improvement >= 3e-2
    then low_source else baseline_source end as decision from smp), e as (select sequence, label_source, baseline_source, baseline_error,
    oracle_error, decision, {_ERR} as position_error from d)
    select sequence, {_SUM}, {_GQ} from e group by sequence""", real=f"{_SUM_REAL} {_GQ_REAL}", whole="sequence")
def _(src):
    g, avail = _gate(src)
    return compare.gate_report(_risk(g, avail, 0.03).drop("improvement"), ["sequence"])


_SCAN = f"""{_GATED}, d as (select *, case when low_source <> baseline_source and improvement >= m then low_source else baseline_source end
    as decision, m as margin from smp, (select unnest([0e0, 3e-2, 1e-1, 2e-1]) as m) t),
    e as (select margin, label_source, baseline_source, baseline_error, oracle_error, decision, {_ERR} as position_error from d),
    sc as (select margin, {_SUM}, {_GQ} from e group by margin)"""


def _scan(src):
    g, avail = _gate(src)
    g = g.withColumn("margin", F.explode(F.array(*[F.lit(m) for m in (0.0, 0.03, 0.1, 0.2)])))
    return compare.gate_report(_risk(g, avail, F.col("margin")).drop("improvement"), ["margin"])


@query("Q8_margin_scan", "gate", f"with {_SCAN} select * from sc", real=f"margin {_SUM_REAL} {_GQ_REAL}")
def _(src):
    return _scan(src)


@query("Q8_best_margin", "gate", f"""with {_SCAN} select * from sc order by (mean_error > baseline_mean + 1e-9), mean_error, apply_rate desc,
    margin limit 1""", real=f"margin {_SUM_REAL} {_GQ_REAL}")
def _(src):
    return compare.best_margin(_scan(src))


_HYB = f"""r as (select position_error as dynamic_error, position_error * (8e-1 + semi_ratio) as structural_error, semi_ratio from frames),
    t as (select m as threshold, semi_ratio >= m as use_, case when semi_ratio >= m then structural_error else dynamic_error end
          as position_error from r, (select unnest([5e-2, 1e-1, 15e-2, 2e-1]) as m) x),
    hy as (select threshold, {_SUM}, avg(use_::int) as structural_share from t group by threshold)"""


def _hybrid(src):
    f = src.frames.select(F.col("position_error").alias("dynamic_error"), (F.col("position_error") * (0.8 + F.col("semi_ratio"))).alias("structural_error"), "semi_ratio")
    return f, compare.hybrid_thresholds(f, [0.05, 0.1, 0.15, 0.2])


@query("Q7_hybrid_thresholds", "frames", f"with {_HYB} select * from hy", real=f"threshold structural_share {_SUM_REAL}")
def _(src):
    return _hybrid(src)[1]


@query("Q7_chosen_threshold", "frames", f"""with {_HYB} select * from hy where p95_error <= (select quantile_cont(dynamic_error, 95e-2) from r)
    order by mean_error, threshold limit 1""", real=f"threshold structural_share {_SUM_REAL}")
def _(src):
    from spoorgrid.operators.quantiles import exact_quantiles

    f, h = _hybrid(src)
    return compare.choose_threshold(h, exact_quantiles(f, [], "dynamic_error", {"p": 0.95}).scalar())


@query("J23_geometry_merge", "candidates", """select event_id, patch_id, f_ok as accepted, case when f_ok then icp_inlier_ratio
    else deep_match_probability end as inlier, case when f_ok then icp_rmse else r end as rmse from (select *, icp_rmse * (8e-1
    + rerank_probability / 2) as r, icp_valid and (not (rerank_probability > 2e-1) or (icp_inlier_ratio >= deep_match_probability
    and icp_rmse <= icp_rmse * (8e-1 + rerank_probability / 2))) as f_ok from candidates) t""", real="inlier rmse", whole="patch_id")
def _(src):
    c = src.candidates
    a = c.select("event_id", "patch_id", F.col("icp_inlier_ratio").alias("inlier"), F.col("icp_rmse").alias("rmse"), F.col("icp_valid").alias("valid"))
    b = c.select("event_id", "patch_id", F.col("deep_match_probability").alias("inlier"),
                 (F.col("icp_rmse") * (0.8 + F.col("rerank_probability") / 2)).alias("rmse"), (F.col("rerank_probability") > 0.2).alias("valid"))
    return D.merge_filtered(a, b, ["event_id", "patch_id"])


_SIDE = f"""r as (select *, event_id % 3 = 0 as triggered, sqrt(pow(x - gt_x, 2) + pow(y - gt_y, 2)) as raw_error from candidates where cand = 0),
    s as (select *, pred_x as rx, pred_y as ry, pred_yaw as ryaw, rerank_probability as r_inlier, icp_rmse * 9e-1 as r_rmse from r),
    sd as (select *, triggered and icp_valid and event_id % 2 = 0 and r_inlier >= icp_inlier_ratio and r_rmse <= icp_rmse as applied from s)"""


def _side(src):
    c = src.candidates.where("cand = 0")
    raw = c.select(*FRAME, "event_id", "x", "y", "yaw", F.col("icp_inlier_ratio").alias("inlier"), F.col("icp_rmse").alias("rmse"),
                   F.col("icp_valid").alias("valid"), (F.col("event_id") % 3 == 0).alias("triggered"), "gt_x", "gt_y")
    ref = c.select(*FRAME, F.col("pred_x").alias("rx"), F.col("pred_y").alias("ry"), F.col("pred_yaw").alias("ryaw"),
                   F.col("rerank_probability").alias("r_inlier"), (F.col("icp_rmse") * 0.9).alias("r_rmse"), (F.col("event_id") % 2 == 0).alias("r_valid"))
    return D.sidecar(raw, ref, FRAME)


@query("D16_sidecar", "candidates", f"""with {_SIDE} select event_id, applied, case when applied then rx else x end as out_x,
    case when applied then ry else y end as out_y, case when applied then r_inlier - icp_inlier_ratio end as inlier_gain,
    case when applied then icp_rmse - r_rmse end as rmse_gain, case when applied then sqrt(pow(rx - x, 2) + pow(ry - y, 2)) end as shift,
    case when applied then abs(degrees({_wrap_sql('(ryaw - yaw)')})) end as turn_deg from sd""",
       real="out_x out_y inlier_gain rmse_gain shift turn_deg")
def _(src):
    return _side(src).select("event_id", "applied", "out_x", "out_y", "inlier_gain", "rmse_gain", "shift", "turn_deg")


@query("Q19_sidecar_examples", "candidates", f"""with {_SIDE}, e as (select sequence, sqrt(pow(rx - gt_x, 2) + pow(ry - gt_y, 2)) - raw_error as delta
    from sd where applied) select sequence, count(*) as examples, avg(delta) as mean_delta, count(*) filter (where delta <= -1e-2) as benefits,
    count(*) filter (where delta >= 1e-2) as regressions from e group by sequence""", real="mean_delta", whole="sequence")
def _(src):
    s = _side(src).where("applied")
    s = s.withColumn("delta", P.xy_error("out_x", "out_y", "gt_x", "gt_y") - P.xy_error("x", "y", "gt_x", "gt_y"))
    return s.groupBy("sequence").agg(F.count("*").alias("examples"), F.avg("delta").alias("mean_delta"),
                                     F.count_if(F.col("delta") <= -0.01).alias("benefits"), F.count_if(F.col("delta") >= 0.01).alias("regressions"))


_CE = "ce as (select *, sqrt(pow(x - gt_x, 2) + pow(y - gt_y, 2)) as e from candidates)"
_AUD = f"""{_CE}, f as (select sequence, frame_idx, max(e) filter (where cand = 0) as selected_error, min(e) as oracle_error,
    arg_min(cand, (e, cand)) + 1 as oracle_rank, arg_min(patch_id, (e, cand)) as oracle_patch from ce group by all),
    c as (select *, case when selected_error < 2e-1 then 'normal' when oracle_error < 2e-1 then 'topk_selection_failure'
          when oracle_error < 5e-1 then 'topk_partial_recovery_only' else 'topk_candidate_absence' end as category from f)"""


def _errors(src):
    return src.candidates.withColumn("position_error", P.xy_error("x", "y", "gt_x", "gt_y"))


def _audit(src):
    order = F.struct("position_error", "cand")
    g = _errors(src).groupBy(*FRAME).agg(
        F.max(F.when(F.col("cand") == 0, F.col("position_error"))).alias("selected_error"), F.min("position_error").alias("oracle_error"),
        (F.min_by("cand", order) + 1).alias("oracle_rank"), F.min_by("patch_id", order).alias("oracle_patch"))
    return g.withColumn("category", D.failure_category("selected_error", "oracle_error"))


@query("P19_failure_category", "candidates", f"with {_AUD} select * from c", real="selected_error oracle_error",
       whole="sequence frame_idx oracle_rank oracle_patch")
def _(src):
    return _audit(src)


@query("Q6_error_mechanisms", "candidates", f"""with {_AUD} select sequence, count(*) as frames, avg(selected_error) as mean_selected,
    avg(oracle_error) as mean_oracle, quantile_cont(selected_error, 95e-2) as p95_selected,
    count(*) filter (where category = 'topk_selection_failure') as selection_failures,
    count(*) filter (where category = 'topk_partial_recovery_only') as partial_recoveries,
    count(*) filter (where category = 'topk_candidate_absence') as absences from c group by sequence""",
       real="mean_selected mean_oracle p95_selected", whole="sequence")
def _(src):
    from spoorgrid.operators.quantiles import with_quantiles

    a = _audit(src)
    out = a.groupBy("sequence").agg(
        F.count("*").alias("frames"), F.avg("selected_error").alias("mean_selected"), F.avg("oracle_error").alias("mean_oracle"),
        F.count_if(F.col("category") == "topk_selection_failure").alias("selection_failures"),
        F.count_if(F.col("category") == "topk_partial_recovery_only").alias("partial_recoveries"),
        F.count_if(F.col("category") == "topk_candidate_absence").alias("absences"))
    return with_quantiles(out, a, "sequence", "selected_error", {"p95_selected": 0.95})


@query("Q6_mechanism_segments", "candidates", f"""with {_AUD}, s as (select *, frame_idx - row_number() over (partition by sequence
    order by frame_idx) as g from c where category <> 'normal')
    select sequence, min(frame_idx) as start_frame, max(frame_idx) as end_frame, count(*) as frames, max(selected_error) as max_error,
           avg(oracle_error) as mean_oracle, count(*) filter (where category = 'topk_selection_failure') as selection_failures
    from s group by sequence, g""", real="max_error mean_oracle", whole="sequence start_frame end_frame")
def _(src):
    bad = _audit(src).where("category <> 'normal'")
    return sequence.islands(bad, "sequence", "frame_idx", [
        F.max("selected_error").alias("max_error"), F.avg("oracle_error").alias("mean_oracle"),
        F.count_if(F.col("category") == "topk_selection_failure").alias("selection_failures")])


@query("Q5_pose_success", "candidates", f"""with {_CE}, r as (select sequence, frame_idx, min(cand + 1) filter (where e < 1e-1) as r from ce group by all)
    select sequence, avg(coalesce(1e0 / r, 0)) as mrr, avg((r is not null)::int) as recall from r group by sequence""", real="mrr recall",
       whole="sequence")
def _(src):
    return compare.pose_success(_errors(src), "position_error", 0.1)


# Semantic re-ranking: the frames of `poses` with three shifted candidate poses each.
_SEM = f"""{STORES}, cd as (select sequence, frame_idx, c as cand, c * 3 as patch_id, 1e0 - c * 1e-1 as final_score, px + c * 4e-1 as cx,
    py - c * 3e-1 as cy, yaw + c * 1e-1 as cw, sqrt(pow(c * 4e-1 - 2e-1, 2) + pow(c * 3e-1, 2)) as position_error
    from poses, (select unnest([0, 1, 2]) as c) t),
    pw as (select sequence, frame_idx, x, y, label, case when label in (1,2,4,6,8) then 1e0 else 35e-2 end as w from points
           where label in (1,2,4,6,8,5,7,9,10,11)),
    wp as (select cd.sequence, cd.frame_idx, cand, label, w, floor(cos(cw) * x - sin(cw) * y + cx) as ix, floor(sin(cw) * x + cos(cw) * y + cy) as iy
           from cd join pw on cd.sequence = pw.sequence and cd.frame_idx = pw.frame_idx),
    lp as (select ix, iy, label, n / sum(n) over (partition by ix, iy) as p from ls where role = 'initial'),
    kc as (select distinct l.ix, l.iy, coalesce(s.stability, 0) as s from lp l left join (select * from st where role = 'initial') s
           on s.ix = l.ix and s.iy = l.iy),
    ag as (select wp.sequence, wp.frame_idx, cand, sum(w) as all_, sum(w) filter (where s is not null) as hit, count(s) as n,
           sum(w * coalesce(p, 0) * (5e-1 + 5e-1 * s)) as v from wp left join kc on kc.ix = wp.ix and kc.iy = wp.iy
           left join lp on lp.ix = wp.ix and lp.iy = wp.iy and lp.label = wp.label group by all),
    sc as (select cd.*, round(coalesce(case when hit > 0 then v / hit * sqrt(hit / all_) end, 0), 9) as semantic_score,
           coalesce(hit, 0) / coalesce(all_, 1) as semantic_coverage, coalesce(n, 0) as semantic_points from cd
           left join ag using (sequence, frame_idx, cand))"""


def _semantic(src, layer=None):
    c = src.poses.withColumn("cand", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    k = F.col("cand")
    c = c.select(*FRAME, "cand", (k * 3).alias("patch_id"), (1.0 - k * 0.1).alias("final_score"), (F.col("px") + k * 0.4).alias("x"),
                 (F.col("py") - k * 0.3).alias("y"), (F.col("yaw") + k * 0.1).alias("yaw"),
                 F.sqrt(F.pow(k * 0.4 - 0.2, F.lit(2)) + F.pow(k * 0.3, F.lit(2))).alias("position_error"))
    s = _store(src, "initial").select("ix", "iy", vote.stability(6.0).alias("stability")) if layer is None else layer
    out = compare.semantic_candidate_scores(src.points.select(*FRAME, "x", "y", "label"), c, vote.label_probabilities(_labels(src, "initial")), s, 1.0)
    return out.withColumn("semantic_score", F.round("semantic_score", 9))


@query("Q3_semantic_scores", "points poses", f"""with {_SEM} select sequence, frame_idx, cand, semantic_score, semantic_coverage, semantic_points
    from sc""", real="semantic_score semantic_coverage", whole="sequence frame_idx cand")
def _(src):
    return _semantic(src).select(*FRAME, "cand", "semantic_score", "semantic_coverage", "semantic_points")


def _method_sql(methods: dict[str, str]) -> str:
    return " union all ".join(f"select '{m}' as method, sequence, frame_idx, arg_max(position_error, ({v}, -cand)) as position_error, "
                              f"arg_max(patch_id, ({v}, -cand)) as patch_id from sc group by sequence, frame_idx" for m, v in methods.items())


_METHODS = {"candidate_final_score": "final_score", "semantic_blend": "round(final_score + 2e0 * semantic_score, 9)", "semantic_only": "semantic_score",
            "oracle_topk": "-position_error"}


@query("Q3_rerank_report", "points poses", f"""with {_SEM}, m as ({_method_sql(_METHODS)}),
    z as (select method, cast(sequence as varchar) as sequence, position_error from m union all select method, 'combined', position_error from m)
    select method, sequence, {_SUM} from z group by all""", real=_SUM_REAL)
def _(src):
    m = compare.rerank_methods(_semantic(src), {
        "candidate_final_score": F.col("final_score"), "semantic_blend": F.round(F.col("final_score") + 2.0 * F.col("semantic_score"), 9),
        "semantic_only": F.col("semantic_score"), "oracle_topk": -F.col("position_error")})
    return metrics.error_summary(metrics.with_combined(m, "sequence"), ["method", "sequence"], "position_error")


def _heuristic_layer(src):
    return _store(src, "initial").select("ix", "iy", vote.heuristic_stability(3.0).alias("stability"))


@query("Q4_heuristic_map_rerank", "points poses", f"""with {_SEM.replace('coalesce(s.stability, 0) as s', 'coalesce((s.n_static + 5e-1 * s.n_semi) / greatest(s.observed, 1) * (1 - exp(-greatest(s.observed, 1) / 3e0)), 0) as s')},
    m as ({_method_sql({'candidate_final_score': 'final_score', 'heuristic_map_blend': 'round(final_score + 2e0 * semantic_score, 9)', 'oracle_topk': '-position_error'})})
    select method, {_SUM} from m group by method""", real=_SUM_REAL)
def _(src):
    m = compare.map_rerank({"heuristic_map_blend": _semantic(src, _heuristic_layer(src))}, 2.0)
    return metrics.error_summary(m, "method", "position_error")


@query("Q4_learned_map_rerank")
def _(src):
    before = _store(src, "initial")
    t = vote.learning_table(before, vote.merge_stores(before, _store(src, "crossday")), 2, 2)
    t = t.join(vote.feature_patches(t.select("ix", "iy"), vote.cell_features(before), 1), ["ix", "iy"])
    layer = cut(learning.learned_layer(learning.fit_cell_reliability(t.where("not validation"), trees=60), before))
    m = compare.map_rerank({"heuristic_map_blend": _semantic(src, _heuristic_layer(src)), "learned_map_blend": _semantic(src, layer)}, 2.0)
    return metrics.error_summary(metrics.with_combined(m, "sequence"), ["method", "sequence"], "position_error")


_REF = """rf as (select sequence, event_id, cand, cast(floor(icp_inlier_ratio * 60) as int) as inliers, icp_inlier_ratio as inlier_ratio, icp_rmse as rmse,
    abs(x - gt_x) as delta_xy, abs(degrees(yaw - gt_yaw)) as delta_yaw_deg, sqrt(pow(pred_x - gt_x, 2) + pow(pred_y - gt_y, 2)) as base_error,
    sqrt(pow(x - gt_x, 2) + pow(y - gt_y, 2)) as new_error from candidates),
    ac as (select *, inliers >= 36 and inlier_ratio >= 55e-2 and delta_xy <= 45e-2 and delta_yaw_deg <= 3 as accepted from rf),
    er as (select *, case when accepted then new_error else base_error end as refined from ac)"""


@query("Q23_refinement_evaluation", "candidates", f"""with {_REF} select coalesce(cast(sequence as varchar), 'combined') as sequence, count(*) as frames,
    avg(base_error) as baseline_mean, avg(refined) as refined_mean, avg(base_error - refined) as improvement, avg(accepted::int) as accepted_rate,
    avg((refined < base_error)::int) as improved_rate from er group by grouping sets ((sequence), ())""",
       real="baseline_mean refined_mean improvement accepted_rate improved_rate")
def _(src):
    r = src.candidates.select("sequence", F.floor(F.col("icp_inlier_ratio") * 60).alias("inliers"), F.col("icp_inlier_ratio").alias("inlier_ratio"),
                              F.col("icp_rmse").alias("rmse"), F.abs(F.col("x") - F.col("gt_x")).alias("delta_xy"),
                              F.abs(F.degrees(F.col("yaw") - F.col("gt_yaw"))).alias("delta_yaw_deg"),
                              P.xy_error("pred_x", "pred_y", "gt_x", "gt_y").alias("base_error"), P.xy_error("x", "y", "gt_x", "gt_y").alias("new_error"))
    r = r.withColumn("accepted", registration.accept_refinement()).withColumn(
        "refined", F.when(F.col("accepted"), F.col("new_error")).otherwise(F.col("base_error")))
    return metrics.with_combined(r, "sequence").groupBy("sequence").agg(
        F.count("*").alias("frames"), F.avg("base_error").alias("baseline_mean"), F.avg("refined").alias("refined_mean"),
        F.avg(F.col("base_error") - F.col("refined")).alias("improvement"), F.avg(F.col("accepted").cast("double")).alias("accepted_rate"),
        F.avg((F.col("refined") < F.col("base_error")).cast("double")).alias("improved_rate"))


# ---- components and review queues --------------------------------------------------------------------------

_HQ = HIGH_QUALITY


@query("P20_component_quality", "components", f"select component_id, coalesce({_HQ}, false) as high from components")
def _(src):
    return src.components.select("component_id", F.coalesce(D.high_quality(), F.lit(False)).alias("high"))


@query("A37_component_report", "components", f"""select split, count(*) as components, avg((coalesce({_HQ}, false))::int) as high_share,
    quantile_cont(height, 1e-1) as h10, quantile_cont(height, 5e-1) as h50, quantile_cont(height, 9e-1) as h90,
    quantile_cont(median_depth, 5e-1) as d50, quantile_cont(right_support, 9e-1) as s90 from components group by split""",
       real="high_share h10 h50 h90 d50 s90")
def _(src):
    from spoorgrid.operators.quantiles import with_quantiles

    c = src.components
    out = c.groupBy("split").agg(F.count("*").alias("components"), F.avg(F.coalesce(D.high_quality(), F.lit(False)).cast("double")).alias("high_share"))
    out = with_quantiles(out, c.withColumn("height", F.col("height").cast("double")), "split", "height", {"h10": 0.1, "h50": 0.5, "h90": 0.9})
    out = with_quantiles(out, c, "split", "median_depth", {"d50": 0.5})
    return with_quantiles(out, c, "split", "right_support", {"s90": 0.9})


@query("P21_review_issues", "manifest", """with p as (select doc_id, person_label, motion_label, instance_id, case when json_valid(box_json)
    and json_array_length(box_json) = 4 then cast(cast(box_json as json) as double[]) end as box from manifest)
    select doc_id, case when person_label not in ('person', 'not_person') then 'person_label' when person_label = 'person' and motion_label
    not in ('moving', 'static', 'uncertain') then 'motion_label' when person_label = 'person' and instance_id in ('', 'pending') then 'instance_id'
    when person_label = 'person' and (box is null or box[3] <= box[1] or box[4] <= box[2]) then 'box_json' end as issue from p""")
def _(src):
    return src.manifest.select("doc_id", manifests.review_issue().alias("issue"))


_REV = """nm as (select *, cast(cast(scores_json as json) as double[]) as sc, list_filter(cast(cast(overlaps_json as json) as double[]), lambda v: v > 0) as ov
    from manifest), av as (select *, list_avg(sc) as ms, coalesce(list_avg(ov), 0) as mo from nm),
    ev as (select *, 45e-2 * least(observation_count / 5e0, 1) + 35e-2 * ms + 2e-1 * mo as evidence, 65e-2 * (1 - ms) + 35e-2 * (1 - mo) as uncertainty,
    case motion_hint when 'potentially_moving' then 1e0 when 'ambiguous_motion' then 2 / 3e0 when 'likely_static_relative_to_map' then 1 / 3e0 else 0e0 end
    as ml from av), rv as (select doc_id, split, sequence, anchor_frame, evidence, uncertainty, 5e-1 * ml + 35e-2 * evidence + 15e-2 * uncertainty as priority,
    case when motion_hint in ('potentially_moving', 'ambiguous_motion') and observation_count >= 3 then 'A' when observation_count >= 3 then 'B'
    else 'C' end as tier from ev)"""


@query("Q15_review_scores", "manifest", f"with {_REV} select doc_id, evidence, uncertainty, priority, tier from rv",
       real="evidence uncertainty priority")
def _(src):
    return review.review_scores(src.manifest).select("doc_id", "evidence", "uncertainty", "priority", "tier")


@query("L3_queue_order", "manifest", f"""with {_REV} select doc_id, row_number() over (order by tier, round(priority, 9) desc, sequence, anchor_frame)
    as position from rv""")
def _(src):
    # tier and priority as one number, so that the whole queue is ranked in ranges of it
    r = review.review_scores(src.manifest).withColumn("p", F.round("priority", 9) - 10 * F.ascii("tier"))
    return chunks.ranked(r, [], "p", [F.col("sequence"), F.col("anchor_frame")], name="position").select("doc_id", "position")


# the quota walk, one row after the other: n = 48, six rows a sequence, 22 and 14 of tiers A and B, 16 for validation
_QUEUE = f"""{_REV}, o as (select *, row_number() over (order by tier, priority desc, sequence, anchor_frame, doc_id) as place from rv),
    w as (select cast(0 as bigint) as rn, cast([] as bigint[]) as ch, cast([] as int[]) as sq, cast([] as varchar[]) as ti, cast(0 as bigint) as va,
          cast([] as bigint[]) as la
    union all select place, case when f then ch else list_append(ch, doc_id) end, case when f then sq else list_append(sq, sequence) end,
          case when f then ti else list_append(ti, tier) end, case when not f and split = 'validation' then va + 1 else va end,
          case when f then list_append(la, doc_id) else la end
    from (select w.*, o.place, o.doc_id, o.sequence, o.tier, o.split, len(list_filter(sq, lambda x: x = o.sequence)) >= 6
          or len(list_filter(ti, lambda x: x = o.tier)) >= case o.tier when 'A' then 22 when 'B' then 14 else 48 end
          or (o.split = 'validation' and va >= 16) as f from w join o on o.place = w.rn + 1 where len(ch) < 48) u),
    q as (select list_concat(ch, la[1:greatest(48 - len(ch), 0)]) as l from w order by rn desc limit 1),
    k as (select unnest(l) as doc_id, unnest(range(1, len(l) + 1)) as position from q)"""


@query("W22_balanced_queue", "manifest", f"""with recursive {_QUEUE} select tier, priority, sequence, anchor_frame, split, doc_id, position
    from k join rv using (doc_id)""", real="priority", whole="sequence anchor_frame position")
def _(src):
    return review.balanced_queue(review.review_scores(src.manifest), "doc_id", 48)


@query("Q16_agreement_ranking", "components detections", f"""with hq as (select * from components where {_HQ}),
    pr as (select c.component_id, d.score, greatest(least(c.x2, d.x2) - greatest(c.x1, d.x1), 0) * greatest(least(c.y2, d.y2) - greatest(c.y1, d.y1), 0) as i,
    (c.x2 - c.x1) * (c.y2 - c.y1) + (d.x2 - d.x1) * (d.y2 - d.y1) as a, det_id from hq c join detections d on d.sequence = c.sequence
    and d.frame_idx = c.frame_idx),
    b as (select component_id, arg_max(i / (a - i), (i / (a - i) * score, -det_id)) as iou, arg_max(score, (i / (a - i) * score, -det_id)) as score
          from pr where i > 0 group by component_id)
    select component_id, split, coalesce(iou, 0) as iou, coalesce(score, 0) as score, coalesce(iou * score, 0) as agreement,
           coalesce(iou >= 1e-1 and score >= 3e-1, false) as prioritise, row_number() over (order by coalesce(iou * score, 0) desc, component_id) as position
    from hq left join b using (component_id)""", real="iou score agreement")
def _(src):
    from spoorgrid.operators.matching import detector_agreement

    c = src.components.where(D.high_quality())
    a = detector_agreement(c.select(*FRAME, "component_id", "x1", "y1", "x2", "y2"), src.detections.drop("is_reference"), FRAME, "component_id", "det_id")
    a = a.join(c.select("component_id", "split"), "component_id")
    a = a.select("component_id", "split", "iou", "score", (F.col("iou") * F.col("score")).alias("agreement"),
                 ((F.col("iou") >= 0.1) & (F.col("score") >= 0.3)).alias("prioritise"))
    return chunks.ranked(a, [], "agreement", [F.col("component_id")], name="position")


@query("Q20_anchor_windows", "components", f"""with l as (select sequence, max(frame_idx) as last_frame from components group by sequence)
    select component_id, frame_idx, greatest(0, frame_idx - 2) as window_start, least(last_frame, frame_idx + 2) as window_end
    from components join l using (sequence) where {_HQ}""", whole="frame_idx window_start window_end")
def _(src):
    c = src.components
    last = c.groupBy("sequence").agg(F.max("frame_idx").alias("last_frame"))
    return review.anchor_windows(c.where(D.high_quality()).select("component_id", "sequence", "frame_idx"), last, "frame_idx", 2).drop("sequence")


def _link_sql(direction: int, k: int) -> str:
    prev = "st" if k == 1 else f"l{'m' if direction < 0 else 'p'}{k - 1}"
    name = f"l{'m' if direction < 0 else 'p'}{k}"
    iou = "greatest(least(a.x2, d.x2) - greatest(a.x1, d.x1), 0) * greatest(least(a.y2, d.y2) - greatest(a.y1, d.y1), 0)"
    return f"""{name} as (select anchor_id, sequence, frame_idx, x1, y1, x2, y2, score, iou, {direction * k} as off from (select a.anchor_id, d.sequence,
        d.frame_idx, d.x1, d.y1, d.x2, d.y2, d.score, {iou} / ((a.x2 - a.x1) * (a.y2 - a.y1) + (d.x2 - d.x1) * (d.y2 - d.y1) - {iou}) as iou, d.det_id
        from {prev} a join detections d on d.sequence = a.sequence and d.frame_idx = a.frame_idx + {direction} and d.score >= 2e-1) t where iou > 0
        qualify row_number() over (partition by anchor_id order by iou * score desc, det_id) = 1)"""


@query("D15_box_linking", "components detections", f"""with st as (select component_id as anchor_id, sequence, frame_idx, x1, y1, x2, y2, 1e0 as score,
    0e0 as iou, 0 as off from components where {_HQ}), {_link_sql(-1, 1)}, {_link_sql(-1, 2)}, {_link_sql(1, 1)}, {_link_sql(1, 2)}
    select anchor_id, frame_idx, x1, y1, score, iou, off as offset_ from (select * from st union all select * from lm1 union all select * from lm2
    union all select * from lp1 union all select * from lp2) u""", real="x1 y1 score iou", whole="frame_idx offset_")
def _(src):
    a = src.components.where(D.high_quality()).withColumnRenamed("component_id", "anchor_id")
    return review.link_boxes(a, src.detections, 2).select("anchor_id", "frame_idx", "x1", "y1", "score", "iou", F.col("offset").alias("offset_"))


_CENTRES = """n as (select *, count(*) over (partition by sequence, frame_idx) as n, quantile_cont(z, 3e-1) over
    (partition by sequence, frame_idx) as front from points), m as (select *, count(*) filter (where z <= front) over (partition by sequence, frame_idx) as m
    from n where n >= 3), u as (select * from m where z <= front or m < 3),
    f as (select sequence, frame_idx, quantile_cont(x, 5e-1) as fx, quantile_cont(y, 5e-1) as fy, quantile_cont(z, 5e-1) as fz from u group by all),
    d as (select sequence, frame_idx, quantile_cont(x, 5e-1) as dx, quantile_cont(y, 5e-1) as dy, quantile_cont(z, 5e-1) as dz from points where label = 13 group by all),
    k as (select distinct sequence, frame_idx from points),
    centres as (select k.sequence, k.frame_idx, coalesce(dx, fx) as center_x, coalesce(dy, fy) as center_y, coalesce(dz, fz) as center_z,
      case when dx is not null then 'depth_box_interior' when fx is not null then 'lidar_front_cluster' end as center_source
      from k left join f using (sequence, frame_idx) left join d using (sequence, frame_idx))"""


def _centres(src):
    from spoorgrid.operators.components import extent_stats

    p = src.points
    front = review.front_cluster(p.withColumn("depth", F.col("z")), FRAME)
    depth = extent_stats(p.where("label = 13").select(*FRAME, "x", "y", "z"), FRAME)
    return review.best_centers(p.select(*FRAME).distinct(), depth, front, FRAME)


@query("D17_world_centres", "points", f"with {_CENTRES} select sequence, frame_idx, center_x, center_y, center_source from centres",
       real="center_x center_y", whole="sequence frame_idx")
def _(src):
    return _centres(src).select(*FRAME, "center_x", "center_y", "center_source")


@query("Q24_detection_manifest", "detections", "with recursive " + diverse_sql(
    "select sequence, frame_idx, det_id, score from detections where score >= 5e-1 and frame_idx % 2 = 0", "sequence", "score desc, det_id", 6, 20) + """,
    l as (select sequence, max(frame_idx) as last_frame from detections group by sequence)
    select c.*, greatest(0, frame_idx - 2) as window_start, least(last_frame, frame_idx + 2) as window_end from chosen c join l using (sequence)""",
       real="score", whole="sequence frame_idx window_start window_end")
def _(src):
    d = src.detections.where((F.col("score") >= 0.5) & (F.pmod("frame_idx", F.lit(2)) == 0))
    last = src.detections.groupBy("sequence").agg(F.max("frame_idx").alias("last_frame"))
    chosen = sequence.diverse(d.select("sequence", "frame_idx", "det_id", "score"), ["sequence"], "frame_idx", [F.col("score"), -F.col("det_id")], 6, 20)
    return review.anchor_windows(chosen, last, "frame_idx", 2)


@query("Q25_review_packets", "components detections points", f"""with st as (select component_id as anchor_id, sequence, frame_idx, x1, y1, x2, y2, 1e0 as score,
    0e0 as iou, 0 as off from components where {_HQ}), {_link_sql(-1, 1)}, {_link_sql(-1, 2)}, {_link_sql(1, 1)}, {_link_sql(1, 2)},
    linked as (select * from st union all select * from lm1 union all select * from lm2 union all select * from lp1 union all select * from lp2), {_CENTRES},
    s as (select l.*, center_x as x, center_y as y, center_z as z, center_source from linked l left join centres c using (sequence, frame_idx)),
    p as (select *, lag(x) over w as lx, lag(y) over w as ly, lag(z) over w as lz from s where x is not null window w as (partition by anchor_id order by off)),
    g as (select anchor_id, count(*) as observed, coalesce(sum(sqrt(pow(x - lx, 2) + pow(y - ly, 2) + pow(z - lz, 2))), 0) as path,
          sqrt(pow(arg_max(x, off) - arg_min(x, off), 2) + pow(arg_max(y, off) - arg_min(y, off), 2) + pow(arg_max(z, off) - arg_min(z, off), 2)) as net from p group by all),
    b as (select anchor_id, any_value(sequence) as sequence, count(*) as boxes, string_agg(concat_ws(',', off, cast(x1 as bigint), cast(y1 as bigint), cast(x2 as bigint),
          cast(y2 as bigint)), ';' order by off) as track_boxes, string_agg(coalesce(center_source, 'none'), ';' order by off) as center_sources from s group by anchor_id)
    select anchor_id, sequence, boxes, '[' || track_boxes || ']' as track_boxes, center_sources, coalesce(observed, 0) as observed, case when observed >= 3 then path end as path_length,
           case when observed >= 3 then net end as net_displacement, case when coalesce(observed, 0) < 3 then 'insufficient_3d_evidence'
           when net < 2e-1 and path < 35e-2 then 'likely_static_relative_to_map' when net >= 5e-1 or path >= 8e-1 then 'potentially_moving' else 'ambiguous_motion' end
           as motion_hint from b left join g using (anchor_id)""", real="path_length net_displacement", whole="sequence boxes observed")
def _(src):
    a = src.components.where(D.high_quality()).withColumnRenamed("component_id", "anchor_id")
    return review.review_packets(review.link_boxes(a, src.detections, 2), _centres(src))


@query("Q22_stability_diagnostic", "points poses frames", f"""with {STORES},
    c as (select ix + 5e-1 as cx, iy + 5e-1 as cy, observed, stability from st where role = 'initial'),
    near as (select sequence, frame_idx, sum(observed * stability) / sum(observed) as s from poses join c
      on (px * 5 - cx) * (px * 5 - cx) + (py * 5 - cy) * (py * 5 - cy) <= 4 group by all),
    r as (select near.s, f.position_error as e from near join frames f using (sequence, frame_idx)),
    q as (select quantile_cont(s, 25e-2) as q1, quantile_cont(s, 75e-2) as q3 from r)
    select corr(s, e) as correlation, count(*) as frames, count(*) filter (where s <= q1) as low_n, count(*) filter (where s >= q3) as high_n,
           avg(e) filter (where s <= q1) as low_mean, avg(e) filter (where s >= q3) as high_mean from r, q""", real="correlation low_mean high_mean")
def _(src):
    c = _store(src, "initial").select((F.col("ix") + 0.5).alias("cx"), (F.col("iy") + 0.5).alias("cy"), "observed", vote.stability(6.0).alias("stability"))
    p = src.poses.select(*FRAME, (F.col("px") * 5).alias("x"), (F.col("py") * 5).alias("y"))
    near = spatial.within_radius(p, c, "x", "y", "cx", "cy", 2.0).groupBy(*FRAME).agg(
        (F.sum(F.col("observed") * F.col("stability")) / F.sum("observed")).alias("local_stability"))
    return compare.stability_diagnostic(src.frames, near)
