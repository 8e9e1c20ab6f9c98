"""Queries on frame sequences: interval joins, segments, tracks, selections, comparisons."""

from pyspark.sql import functions as F

from spoorgrid.operators import chunks, matching, metrics, relay, sequence, spatial
from spoorgrid.plans.catalog_retrieval import _SUM, _SUM_REAL
from spoorgrid.plans.registry import query

FRAME = ["sequence", "frame_idx"]
HIGH_QUALITY = "height >= 32 and pixel_area >= 400 and valid_depth_ratio >= 7e-1 and median_depth is not null and median_depth <= 8"


@query("J1_frame_dimensions", "points poses cameras", """
    select p.sequence, p.frame_idx, count(*) as points, max(px) as px, max(fx) as fx,
           case when p.sequence = 4 then 'validation' else 'train' end as split
    from points p join poses q on p.sequence = q.sequence and p.frame_idx = q.frame_idx
    join cameras c on c.sequence = p.sequence group by all""", real="px fx", whole="sequence frame_idx")
def _(src):
    from spoorgrid.sources.frame_index import split_sequences

    n = src.points.groupBy(*FRAME).agg(F.count("*").alias("points"))
    split = split_sequences(src.cameras.select("sequence", "fx"), "sequence")
    return n.join(src.poses.select(*FRAME, "px"), FRAME).join(split, "sequence").select(
        *FRAME, "points", "px", "fx", "split")


@query("J2_centred_time_window", "frames", """
    select a.sequence, a.frame_idx, count(*) as samples, avg(b.semi_ratio) as mean_ratio, min(b.frame_idx) as first_sample
    from frames a join frames b on a.sequence = b.sequence and b.ts_sec between a.ts_sec - 4000 and a.ts_sec + 4000
    group by all""", real="mean_ratio", whole="sequence frame_idx first_sample")
def _(src):
    f = src.frames
    imu = f.select("sequence", F.col("ts_sec").alias("t"), F.col("semi_ratio").alias("g"), F.col("frame_idx").alias("sample"))
    j = spatial.in_time_window(f.select(*FRAME, "ts_sec"), imu, ["sequence"], "ts_sec", "t", 4000.0, 4000.0,
                               {"n": ("count", "t"), "m": ("count", "g"), "s": ("sum", "g"), "first": ("min", "sample")})
    j = j.groupBy(*FRAME).agg(F.sum("n").alias("samples"), F.sum("m").alias("m"), F.sum("s").alias("s"), F.min("first").alias("first_sample"))
    return j.where("samples > 0").select(*FRAME, "samples", F.when(F.col("m") > 0, F.col("s") / F.col("m")).alias("mean_ratio"), "first_sample")


_FUT = """(select a.track, a.frame_idx, b.ts_sec as future_ts_sec, b.x as future_x, b.y as future_y, b.z as future_z
    from tracks a join tracks b on a.track = b.track and b.ts_sec > a.ts_sec and abs(b.ts_sec - (a.ts_sec + 5e-1)) <= 25e-2
    qualify row_number() over (partition by a.track, a.frame_idx order by abs(b.ts_sec - (a.ts_sec + 5e-1)), b.ts_sec) = 1)"""


@query("J9_nearest_future", "tracks", f"select * from {_FUT} t", real="future_ts_sec future_x future_y future_z",
       whole="track frame_idx")
def _(src):
    out = spatial.nearest_future(src.tracks, ["track"], "ts_sec", 0.5, 0.25, ["x", "y", "z"])
    return out.select("track", "frame_idx", "future_ts_sec", "future_x", "future_y", "future_z")


_RUNS = """a as (select sequence, frame_idx, position_error as e from frames),
    b as (select sequence, frame_idx, position_error * (8e-1 + semi_ratio) as e from frames where patch_id <> 3)"""


def _runs(src):
    f = src.frames
    a = f.select(*FRAME, F.col("position_error").alias("base_error"))
    b = f.where("patch_id <> 3").select(*FRAME, (F.col("position_error") * (0.8 + F.col("semi_ratio"))).alias("new_error"))
    return a, b


@query("J12_run_comparison", "frames", f"""with {_RUNS}
    select a.sequence, count(*) as frames, avg(a.e) as base_mean, avg(b.e) as new_mean, avg(a.e - b.e) as improvement,
           avg((b.e < a.e)::int) as improved, quantile_cont(b.e, 95e-2) as new_p95
    from a join b using (sequence, frame_idx) group by a.sequence""", real="base_mean new_mean improvement improved new_p95",
       whole="sequence")
def _(src):
    from spoorgrid.operators.quantiles import with_quantiles

    a, b = _runs(src)
    j = a.join(b, FRAME)
    out = j.groupBy("sequence").agg(
        F.count("*").alias("frames"), F.avg("base_error").alias("base_mean"), F.avg("new_error").alias("new_mean"),
        F.avg(F.col("base_error") - F.col("new_error")).alias("improvement"),
        F.avg((F.col("new_error") < F.col("base_error")).cast("double")).alias("improved"))
    return with_quantiles(out, j, "sequence", "new_error", {"new_p95": 0.95})


@query("J13_strict_pairing", "frames", """select sequence, frame_idx, position_error as dynamic_error,
    position_error * (8e-1 + semi_ratio) as structural_error from frames""", real="dynamic_error structural_error",
       whole="sequence frame_idx")
def _(src):
    from spoorgrid.operators.compare import strict_pairs

    f = src.frames
    return strict_pairs(f.select(*FRAME, F.col("position_error").alias("dynamic_error")),
                        f.select(*FRAME, (F.col("position_error") * (0.8 + F.col("semi_ratio"))).alias("structural_error")), FRAME)


@query("J21_semi_and_anti", "frames", f"""with {_RUNS}
    select sequence, frame_idx, 'shared' as side from a where exists (select 1 from b where b.sequence = a.sequence
    and b.frame_idx = a.frame_idx)
    union all select sequence, frame_idx, 'only_first' from a where not exists (select 1 from b where b.sequence = a.sequence
    and b.frame_idx = a.frame_idx)""", whole="sequence frame_idx")
def _(src):
    a, b = _runs(src)
    return (a.join(b, FRAME, "left_semi").select(*FRAME, F.lit("shared").alias("side"))
             .unionByName(a.join(b, FRAME, "left_anti").select(*FRAME, F.lit("only_first").alias("side"))))


@query("U1_union_of_runs", "frames", f"""with {_RUNS} select 'base' as run, sequence, frame_idx, e from a
    union all select 'new', sequence, frame_idx, e from b""", real="e", whole="sequence frame_idx")
def _(src):
    a, b = _runs(src)
    return (a.select(F.lit("base").alias("run"), *FRAME, F.col("base_error").alias("e"))
             .unionByName(b.select(F.lit("new").alias("run"), *FRAME, F.col("new_error").alias("e"))))


_IOU = """greatest(least(r.x2, d.x2) - greatest(r.x1, d.x1), 0) * greatest(least(r.y2, d.y2) - greatest(r.y1, d.y1), 0)"""
_AREA = "(r.x2 - r.x1) * (r.y2 - r.y1) + (d.x2 - d.x1) * (d.y2 - d.y1)"
_PAIRS = f"""pr as (select r.sequence, r.frame_idx, r.det_id as ref_id, d.det_id, d.score, {_IOU} / ({_AREA} - {_IOU}) as iou
    from detections r join detections d on r.sequence = d.sequence and r.frame_idx = d.frame_idx
    where r.is_reference and not d.is_reference)"""


def _boxes(src):
    d = src.detections
    refs = d.where("is_reference").select("sequence", "frame_idx", F.col("det_id").alias("ref_id"), "x1", "y1", "x2", "y2")
    return refs, d.where("not is_reference").drop("is_reference")


@query("J15_detector_agreement", "detections", f"""with {_PAIRS}, b as (select sequence, frame_idx, ref_id,
    arg_max(iou, (iou * score, -det_id)) as iou, arg_max(score, (iou * score, -det_id)) as score,
    arg_max(det_id, (iou * score, -det_id)) as det_id from pr where iou > 0 group by all)
    select r.sequence, r.frame_idx, r.det_id as ref_id, coalesce(iou, 0) as iou, coalesce(b.score, 0) as score, b.det_id
    from detections r left join b on b.ref_id = r.det_id where r.is_reference""", real="iou score",
       whole="sequence frame_idx")
def _(src):
    refs, dets = _boxes(src)
    return matching.detector_agreement(refs, dets, FRAME, "ref_id", "det_id")


# one pair of a frame after the other, best first; a pair is taken if both its boxes are free
_GREEDY = f"""{_PAIRS}, ordered as (select *, row_number() over (partition by sequence, frame_idx order by iou desc, ref_id, det_id) as rn
    from pr where iou >= 1e-1),
    walk as (select sequence, frame_idx, rn, iou, ref_id, det_id, true as taken, [ref_id] as refs, [det_id] as dets from ordered where rn = 1
    union all select o.sequence, o.frame_idx, o.rn, o.iou, o.ref_id, o.det_id,
           not list_contains(refs, o.ref_id) and not list_contains(dets, o.det_id),
           case when list_contains(refs, o.ref_id) or list_contains(dets, o.det_id) then refs else list_append(refs, o.ref_id) end,
           case when list_contains(refs, o.ref_id) or list_contains(dets, o.det_id) then dets else list_append(dets, o.det_id) end
    from walk w join ordered o on o.sequence = w.sequence and o.frame_idx = w.frame_idx and o.rn = w.rn + 1)"""


@query("J16_greedy_matching", "detections", f"with recursive {_GREEDY} select sequence, frame_idx, ref_id, det_id, iou from walk where taken",
       real="iou", whole="sequence frame_idx")
def _(src):
    refs, dets = _boxes(src)
    p = matching.overlapping(refs, dets, FRAME, "ref_id", "det_id").where(F.col("iou") >= 0.1)
    return matching.greedy_matches(p, FRAME, "ref_id", "det_id", "iou")


_SWEEP = f"""{_PAIRS}, t as (select unnest([2e-1, 5e-1, 8e-1]) as threshold),
    ordered as (select pr.*, threshold, row_number() over (partition by sequence, frame_idx, threshold order by iou desc, ref_id, det_id) as rn
    from pr join t on score >= threshold where iou >= 1e-1),
    walk as (select sequence, frame_idx, threshold, rn, true as taken, [ref_id] as refs, [det_id] as dets from ordered where rn = 1
    union all select o.sequence, o.frame_idx, o.threshold, o.rn, not list_contains(refs, o.ref_id) and not list_contains(dets, o.det_id),
           case when list_contains(refs, o.ref_id) or list_contains(dets, o.det_id) then refs else list_append(refs, o.ref_id) end,
           case when list_contains(refs, o.ref_id) or list_contains(dets, o.det_id) then dets else list_append(dets, o.det_id) end
    from walk w join ordered o on o.sequence = w.sequence and o.frame_idx = w.frame_idx and o.threshold = w.threshold and o.rn = w.rn + 1),
    n as (select threshold, count(*) as predictions from detections join t on score >= threshold where not is_reference group by threshold),
    c as (select n.threshold, count(w.rn) as tp, any_value(predictions) - count(w.rn) as fp, (select count(*) from detections where is_reference) - count(w.rn) as fn
          from n left join (select * from walk where taken) w on w.threshold = n.threshold group by n.threshold),
    p as (select *, tp / greatest(tp + fp, 1) as precision, tp / greatest(tp + fn, 1) as recall from c)"""


@query("A19_detection_sweep", "detections", f"with recursive {_SWEEP} select *, 2 * precision * recall / greatest(precision + recall, 1e-8) as f1 from p",
       real="threshold precision recall f1", whole="tp fp fn")
def _(src):
    refs, dets = _boxes(src)
    cuts = F.array(*[F.lit(t) for t in (0.2, 0.5, 0.8)])
    per = dets.withColumn("threshold", F.explode(cuts)).where(F.col("score") >= F.col("threshold"))
    p = matching.overlapping(refs, dets, FRAME, "ref_id", "det_id").where(F.col("iou") >= 0.1)
    p = p.withColumn("threshold", F.explode(cuts)).where(F.col("score") >= F.col("threshold"))
    m = matching.greedy_matches(p, [*FRAME, "threshold"], "ref_id", "det_id", "iou")
    n = per.groupBy("threshold").agg(F.count("*").alias("predictions"))
    t = m.groupBy("threshold").agg(F.count("*").alias("tp")).join(n, "threshold", "right")
    t = t.withColumn("references", refs.agg(F.count("*")).scalar()).withColumn("tp", F.coalesce("tp", F.lit(0)))
    return metrics.prf(t.select("threshold", "tp", (F.col("predictions") - F.col("tp")).alias("fp"),
                                (F.col("references") - F.col("tp")).alias("fn")))


_HIGH = "(select * from frames where position_error >= 2e-1)"
_SEG = f"""seg as (select sequence, split, min(frame_idx) as start_frame, max(frame_idx) as end_frame, count(*) as frames,
    max(position_error) as peak_error, arg_max(frame_idx, (position_error, -frame_idx)) as anchor_frame,
    arg_max(patch_id, (position_error, -frame_idx)) as patch_id, avg(semi_ratio) as mean_ratio,
    count(*) filter (where event_type = 'error') as error_events
    from (select *, frame_idx - row_number() over (partition by sequence order by frame_idx) as g from {_HIGH} h)
    group by sequence, split, g)"""


def _segments(src):
    high = src.frames.where(F.col("position_error") >= 0.2)
    peak = F.struct(F.col("position_error"), -F.col("frame_idx"))
    return sequence.islands(high, ["sequence", "split"], "frame_idx", [
        F.max("position_error").alias("peak_error"), F.max_by("frame_idx", peak).alias("anchor_frame"),
        F.max_by("patch_id", peak).alias("patch_id"), F.avg("semi_ratio").alias("mean_ratio"),
        F.count_if(F.col("event_type") == "error").alias("error_events")])


@query("W9_error_islands", "frames", f"with {_SEG} select * from seg", real="peak_error mean_ratio",
       whole="sequence start_frame end_frame anchor_frame patch_id")
def _(src):
    return _segments(src)


@query("L4_segments_by_peak", "frames", f"with {_SEG} select *, row_number() over (order by peak_error desc, sequence, start_frame) as position from seg",
       real="peak_error mean_ratio", whole="sequence start_frame end_frame anchor_frame patch_id")
def _(src):
    return chunks.ranked(_segments(src), [], "peak_error", [F.col("sequence"), F.col("start_frame")], name="position")


@query("L1_top_error_frames", "frames", """(select 'error' as list, sequence, frame_idx, position_error as value from frames
    order by position_error desc, sequence, frame_idx limit 30) union all (select 'person' as list, sequence, frame_idx, person_ratio as value from frames
    order by person_ratio desc, sequence, frame_idx limit 30)""", real="value", whole="sequence frame_idx")
def _(src):
    def top(name, column):
        rows = src.frames.select(F.lit(name).alias("list"), *FRAME, F.col(column).alias("value"))
        return rows.orderBy(F.desc("value"), *FRAME).limit(30)

    return top("error", "position_error").unionByName(top("person", "person_ratio"))


@query("W10_presence_segments", "presence", """
    with p as (select *, frame_idx - lag(frame_idx) over (partition by sequence, target order by frame_idx) as d
               from presence where present),
    g as (select *, sum(case when d is null or d > 3 then 1 else 0 end) over (partition by sequence, target
          order by frame_idx) as grp from p)
    select sequence, target, min(frame_idx) as start_frame, max(frame_idx) as end_frame, count(*) as frames,
           avg(position_error) as mean_error, max(position_error) as max_error from g group by sequence, target, grp
    having count(*) >= 3""", real="mean_error max_error", whole="sequence start_frame end_frame", digits=9)
def _(src):
    return sequence.islands(src.presence.where("present"), ["sequence", "target"], "frame_idx",
                            [F.avg("position_error").alias("mean_error"), F.max("position_error").alias("max_error")], 2, 3)


@query("W11_trailing_streaks", "frames", """
    with c as (select sequence, frame_idx, v, case when v is distinct from lag(v) over w then 1 else 0 end as b
               from (select sequence, frame_idx, event_type in ('view', 'click') as v from frames) f
               window w as (partition by sequence order by frame_idx)),
    g as (select *, sum(b) over (partition by sequence order by frame_idx) as grp from c)
    select sequence, frame_idx, row_number() over (partition by sequence, grp order by frame_idx) as streak from g""",
       whole="sequence frame_idx")
def _(src):
    f = src.frames.select(*FRAME, F.col("event_type").isin("view", "click").alias("v"))
    return sequence.streaks(f, "sequence", "frame_idx", "v", "streak").drop("v")


@query("W12_switch_counts", "frames", """select sequence, count(*) as rows, sum(s) as switches from
    (select sequence, case when patch_id <> lag(patch_id) over (partition by sequence order by frame_idx) then 1 else 0 end as s
     from frames) t group by sequence""", whole="sequence switches")
def _(src):
    return sequence.switch_counts(src.frames.select(*FRAME, "patch_id"), "sequence", "frame_idx", "patch_id")


def _ordinal(src):
    return chunks.dense_ordinal(src.tracks, ["track"], ["ts_sec", "frame_idx"], F.floor(F.col("ts_sec") / 100.0))


_PAST = """p as (select *, first_value(ts_sec) over w as pt, first_value(x) over w as px, first_value(y) over w as py,
    first_value(z) over w as pz from tracks window w as (partition by track order by ts_sec, frame_idx rows between 3 preceding
    and 1 preceding)),
    s as (select track, frame_idx, ts_sec, x, y, z, coalesce(sqrt(pow(x - px, 2) + pow(y - py, 2) + pow(z - pz, 2))
          / greatest(ts_sec - pt, 1e-6), 0) as past_speed from p)"""


@query("W13_past_speed", "tracks", f"with {_PAST} select track, frame_idx, past_speed from s", real="past_speed",
       whole="track frame_idx")
def _(src):
    return sequence.past_speed(_ordinal(src), ["track"], "ts_sec").select("track", "frame_idx", "past_speed")


@query("W14_motion_labels", "tracks", f"""with {_PAST}, f as (select * from {_FUT} t),
    n as (select track, count(*) as track_observations from tracks group by track)
    select s.track, s.frame_idx, past_speed, sqrt(pow(future_x - x, 2) + pow(future_y - y, 2) + pow(future_z - z, 2))
           / greatest(future_ts_sec - ts_sec, 1e-6) as future_speed,
           sqrt(pow(future_x - x, 2) + pow(future_y - y, 2) + pow(future_z - z, 2))
           / greatest(future_ts_sec - ts_sec, 1e-6) >= 35e-2 as pseudo_dynamic, track_observations
    from s join f on s.track = f.track and s.frame_idx = f.frame_idx join n on n.track = s.track
    where track_observations >= 7""", real="past_speed future_speed", whole="track frame_idx")
def _(src):
    return sequence.motion_labels(_ordinal(src), ["track"], "ts_sec", 0.5, 0.25, 0.35, 7).select(
        "track", "frame_idx", "past_speed", "future_speed", "pseudo_dynamic", "track_observations")


@query("W15_step_deltas", "frames", """
    with d as (select sequence, frame_idx, ts_sec - lag(ts_sec) over w as dt,
               sqrt(pow(gt_x - lag(gt_x) over w, 2) + pow(gt_y - lag(gt_y) over w, 2)) as step,
               gt_yaw - lag(gt_yaw) over w as r from frames window w as (partition by sequence order by frame_idx))
    select sequence, frame_idx, dt, step, (r + pi()) - 2 * pi() * floor((r + pi()) / (2 * pi())) - pi() as dyaw from d""",
       real="dt step dyaw", whole="sequence frame_idx")
def _(src):
    from spoorgrid.operators.profiles import step_deltas

    return step_deltas(src.frames).select(*FRAME, "dt", "step", "dyaw")


@query("W16_motion_prediction", "frames", """
    with l as (select sequence, frame_idx, lag(gt_x) over w as x1, lag(gt_x, 2) over w as x2, lag(gt_y) over w as y1,
               lag(gt_y, 2) over w as y2, lag(gt_yaw) over w as w1, lag(gt_yaw, 2) over w as w2
               from frames window w as (partition by sequence order by frame_idx))
    select sequence, frame_idx, case when x2 is null then x1 else 2 * x1 - x2 end as pred_x,
           case when x2 is null then y1 else 2 * y1 - y2 end as pred_y, case when x2 is null then w1 else
           w1 + (w1 - w2 + pi()) - 2 * pi() * floor((w1 - w2 + pi()) / (2 * pi())) - pi() end as pred_yaw from l""",
       real="pred_x pred_y pred_yaw", whole="sequence frame_idx")
def _(src):
    f = src.frames.select(*FRAME, F.col("gt_x").alias("x"), F.col("gt_y").alias("y"), F.col("gt_yaw").alias("yaw"))
    return sequence.motion_prediction(f, "sequence", "frame_idx").select(*FRAME, "pred_x", "pred_y", "pred_yaw")


@query("W17_motion_hint", "tracks", """
    with p as (select *, floor(frame_idx / 5) as packet, lag(x) over w as lx, lag(y) over w as ly, lag(z) over w as lz
               from tracks window w as (partition by track, floor(frame_idx / 5) order by frame_idx)),
    g as (select track, packet, count(*) as observed, sum(sqrt(pow(x - lx, 2) + pow(y - ly, 2) + pow(z - lz, 2))) as path,
          sqrt(pow(arg_max(x, frame_idx) - arg_min(x, frame_idx), 2) + pow(arg_max(y, frame_idx) - arg_min(y, frame_idx), 2)
               + pow(arg_max(z, frame_idx) - arg_min(z, frame_idx), 2)) as net from p group by all)
    select track, packet, observed, case when observed >= 3 then path end as path_length,
           case when observed >= 3 then net end as net_displacement,
           case when observed < 3 then 'insufficient_3d_evidence' when net < 2e-1 and path < 35e-2
                then 'likely_static_relative_to_map' when net >= 5e-1 or path >= 8e-1 then 'potentially_moving'
                else 'ambiguous_motion' end as motion_hint from g""", real="path_length net_displacement", whole="track packet")
def _(src):
    t = src.tracks.withColumn("packet", F.floor(F.col("frame_idx") / 5))
    return sequence.motion_hint(t, ["track", "packet"], "frame_idx")


_ROBIN = """t as (select *, row_number() over (partition by split, sequence order by peak_error desc, anchor_frame) as turn from seg),
    rr as (select *, row_number() over (partition by split order by turn, sequence) as position from t)"""


def _robin(src, n):
    return sequence.round_robin(_segments(src), "split", "sequence", [F.desc("peak_error"), F.col("anchor_frame")], n)


@query("W18_round_robin", "frames", f"""with {_SEG}, {_ROBIN} select split, sequence, anchor_frame, peak_error, turn, position
    from rr where position <= 40""", real="peak_error", whole="sequence anchor_frame")
def _(src):
    return _robin(src, 40).select("split", "sequence", "anchor_frame", "peak_error", "turn", "position")


def diverse_sql(rows: str, keys: str, order: str, n: int, gap: int) -> str:
    """Rows in rank order, each taken unless a taken one of its key is closer than the gap, until n are."""
    ks = [k.strip() for k in keys.split(",")]
    same = " and ".join(f"o.{k} = w.{k}" for k in ks)
    far = f"len(list_filter(fr, lambda x: abs(x - o.frame_idx) < {gap})) = 0"
    return f"""base as ({rows}), ordered as (select *, row_number() over (partition by {keys} order by {order}) as rn from base),
    walk as (select {keys}, rn, [frame_idx] as fr, true as taken from ordered where rn = 1
    union all select {', '.join('o.' + k for k in ks)}, o.rn, case when {far} then list_append(fr, o.frame_idx) else fr end, {far}
    from walk w join ordered o on {same} and o.rn = w.rn + 1 where len(fr) < {n}),
    chosen as (select o.* exclude (rn) from ordered o join walk w on {same} and o.rn = w.rn where taken)"""


@query("W19_diverse_selection", "components", "with recursive " + diverse_sql(f"select * from components where {HIGH_QUALITY}", "split, sequence",
       "height desc, pixel_area desc, valid_depth_ratio desc, frame_idx", 6, 30) + " select * from chosen",
       real="valid_depth_ratio median_depth right_support x1 y1 x2 y2", whole="sequence frame_idx height pixel_area")
def _(src):
    from spoorgrid.operators.decisions import high_quality

    c = src.components.where(high_quality())
    return sequence.diverse(c, ["split", "sequence"], "frame_idx",
                            [F.col("height"), F.col("pixel_area"), F.col("valid_depth_ratio"), -F.col("frame_idx")], 6, 30)


_CTRL = """ctl as (select s.sequence, s.start_frame, s.anchor_frame,
    arg_min(f.frame_idx, (f.patch_id <> s.patch_id, abs(f.frame_idx - s.anchor_frame), f.frame_idx)) as control_frame,
    bool_or(f.patch_id = s.patch_id) as same_patch
    from seg s join frames f on f.sequence = s.sequence and f.position_error <= 1e-1 and abs(f.frame_idx - s.anchor_frame) > 30
    where not exists (select 1 from seg x where x.sequence = f.sequence and x.anchor_frame = f.frame_idx) group by all)"""


def _controls(src, seg):
    high = seg.select("sequence", F.col("anchor_frame").alias("frame_idx"))
    return sequence.choose_controls(seg, src.frames, high)


@query("J19_case_control", "frames", f"""with {_SEG}, {_CTRL} select s.sequence, s.anchor_frame, control_frame,
    coalesce(same_patch, false) as same_patch from seg s left join ctl using (sequence, start_frame, anchor_frame)""",
       whole="sequence anchor_frame control_frame")
def _(src):
    s = _segments(src)
    return _controls(src, s).select("sequence", "anchor_frame", "control_frame", "same_patch")


@query("J24_history_window", "frames", """
    with p as (select sequence, frame_idx, gt_x + semi_ratio * 8 as x, gt_y as y from frames)
    select sequence, frame_idx, history, rank from (select a.sequence, a.frame_idx, b.frame_idx as history,
           row_number() over (partition by a.sequence, a.frame_idx order by b.frame_idx desc) as rank
    from p a join p b on a.sequence = b.sequence and b.frame_idx between a.frame_idx - 9 and a.frame_idx
    where sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 1) t where rank <= 3""", whole="sequence frame_idx history")
def _(src):
    p = src.frames.select(*FRAME, (F.col("gt_x") + F.col("semi_ratio") * 8).alias("x"), F.col("gt_y").alias("y"))
    return sequence.history_window(p, ["sequence"], "frame_idx", 3, 1.0)


@query("D14_track_association")
def _(src):
    return relay.associate_tracks(src.objects.select("sequence", "target", "frame_idx", "obs_id", "x", "y", "z"), chunk=500)


# ---- studies composed from the above -----------------------------------------------------------------------


@query("Q12_presence_audit", "presence", """
    with n as (select count(*) as n from (select distinct sequence, frame_idx from presence)),
    p as (select *, frame_idx - lag(frame_idx) over (partition by sequence, target order by frame_idx) as d
          from presence where present),
    g as (select *, sum(case when d is null or d > 3 then 1 else 0 end) over (partition by sequence, target
          order by frame_idx) as grp from p),
    sg as (select target, count(*) as segments from (select sequence, target, grp from g group by all having count(*) >= 3) x
           group by target)
    select t.target, count(*) filter (where present) as present_frames, count(*) filter (where present) / max(n.n) as present_ratio,
           max(segments) as segments, count(distinct case when present then split end) = 3 as cross_split,
           avg(position_error) filter (where present) as mean_present, avg(position_error) filter (where not present) as mean_absent
    from presence t cross join n left join sg on sg.target = t.target group by t.target""",
       real="present_ratio mean_present mean_absent")
def _(src):
    from spoorgrid.operators.compare import presence_audit

    return presence_audit(src.presence, 2, 3)


@query("Q12_hard_frames", "presence", """
    with q as (select sequence, quantile_cont(position_error, 95e-2) as limit_ from presence group by sequence)
    select sequence, frame_idx, target, position_error from presence join q using (sequence)
    where present and position_error >= limit_""", real="position_error", whole="sequence frame_idx")
def _(src):
    from spoorgrid.operators.compare import hard_frames

    return hard_frames(src.presence, 0.95).select("sequence", "frame_idx", "target", "position_error")


@query("Q13_spike_study", "frames", """
    select sequence, count(*) as frames, count(*) filter (where person_ratio >= 2e-1) as person_frames,
           count(*) filter (where position_error >= 5e-1) as spike_frames,
           count(*) filter (where position_error >= 5e-1 and person_ratio >= 2e-1) as person_spikes,
           avg(position_error) filter (where person_ratio >= 2e-1) as mean_person,
           avg(position_error) filter (where person_ratio < 2e-1) as mean_other,
           corr(position_error, person_ratio) as corr_person, corr(position_error, semi_ratio) as corr_dynamic
    from frames group by sequence""", real="mean_person mean_other corr_person corr_dynamic", whole="sequence")
def _(src):
    from spoorgrid.operators.compare import spike_study

    return spike_study(src.frames, 0.2, 0.5)


@query("Q13_spike_runs", "frames", """with s as (select *, frame_idx - row_number() over (partition by sequence order by frame_idx) as grp from frames where position_error >= 5e-1),
    r as (select sequence, min(frame_idx) as frame_start, max(frame_idx) as frame_end, count(*) as frames, max(position_error) as peak_error,
          max(person_ratio) as max_person, max(semi_ratio) as max_dynamic, arg_max(frame_idx, (position_error, -frame_idx)) as peak_frame from s group by sequence, grp)
    select *, row_number() over (order by peak_error desc, sequence, frame_start) as position from r""",
       real="peak_error max_person max_dynamic", whole="sequence frame_start frame_end peak_frame")
def _(src):
    from spoorgrid.operators.compare import spike_runs

    return spike_runs(src.frames, 0.5)


@query("Q13_top_frames", "frames", """with l as (select 'error' as list, sequence, frame_idx, position_error as value from frames
      union all select 'person', sequence, frame_idx, person_ratio from frames)
    select * from (select *, row_number() over (partition by list, sequence order by value desc, frame_idx) as rank from l) where rank <= 30""",
       real="value", whole="sequence frame_idx")
def _(src):
    from spoorgrid.operators.compare import top_frames

    return top_frames(src.frames, 30)


@query("Q14_case_control_queue", "frames", f"""with {_SEG}, {_ROBIN}, {_CTRL},
    pick as (select * from rr where position <= 20),
    rows_ as (select split, position, 0 as side, 'high_error' as condition, sequence, anchor_frame, start_frame, end_frame from pick
      union all select split, position, 1, 'normal_control', p.sequence, control_frame, p.start_frame, p.end_frame
      from pick p join ctl c on c.sequence = p.sequence and c.start_frame = p.start_frame)
    select row_number() over (order by split, position, side) as review_order, split, condition, sequence, anchor_frame,
           greatest(anchor_frame - 2, 0) as window_start, anchor_frame + 2 as window_end, start_frame, end_frame from rows_""",
       whole="sequence anchor_frame start_frame end_frame window_start window_end")
def _(src):
    from spoorgrid.operators.compare import case_control_queue

    seg = _segments(src)
    pick = sequence.round_robin(seg, "split", "sequence", [F.desc("peak_error"), F.col("anchor_frame")], 20)
    return case_control_queue(pick, sequence.choose_controls(
        pick, src.frames, seg.select("sequence", F.col("anchor_frame").alias("frame_idx"))), 2)


_AB = """ab as (select sequence, frame_idx, position_error as base, position_error * (8e-1 + semi_ratio) as new_,
    case when person_ratio >= 15e-2 then 'person' else 'no_person' end as grp from frames where patch_id <> 3),
    both_ as (select grp, 'baseline' as method, base as position_error from ab union all select grp, 'filtered', new_ from ab
      union all select 'all', 'baseline', base from ab union all select 'all', 'filtered', new_ from ab)"""


@query("Q18_filter_comparison", "frames", f"with {_AB} select grp, method, {_SUM} from both_ group by grp, method", real=_SUM_REAL)
def _(src):
    from spoorgrid.operators.compare import filter_comparison

    a, b = _runs(src)
    g = src.frames.select(*FRAME, F.when(F.col("person_ratio") >= 0.15, "person").otherwise("no_person").alias("grp"))
    return filter_comparison(a, b, g, FRAME)


@query("Q17_exposure_by_failure", "frames", """
    with g as (select case when position_error <= 1e-1 then 'normal' when position_error >= 2e-1 then 'high' end as grp,
               case when event_type <> 'signup' then semi_ratio end as ratio from frames)
    select grp, count(*) as frames, avg(ratio) as mean_ratio, quantile_cont(ratio, 5e-1) as median_ratio,
           avg((ratio > 1e-1)::int) as trigger_rate from g where grp is not null group by grp""",
       real="mean_ratio median_ratio trigger_rate")
def _(src):
    from spoorgrid.operators.compare import exposure_by_group

    e = F.col("position_error")
    g = src.frames.select(F.when(e <= 0.1, "normal").when(e >= 0.2, "high").alias("grp"),
                          F.when(F.col("event_type") != "signup", F.col("semi_ratio")).alias("ratio"))
    return exposure_by_group(g.where("grp is not null"), "grp", "ratio", 0.10)
