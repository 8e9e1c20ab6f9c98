"""Queries on point tables: geometry, crops, rasters, tiles, voxels, profiles."""

from pyspark.sql import functions as F

from spoorgrid.functions import camera as C
from spoorgrid.functions import cells as G
from spoorgrid.functions import pose as P
from spoorgrid.operators import points as pts
from spoorgrid.operators import profiles
from spoorgrid.plans.registry import query
from spoorgrid.sources import frame_index, manifests, reports

BOX = ((-10, 10), (-10, 10), (0.5, 4.5))
IN_BOX = "x between -10 and 10 and y between -10 and 10 and z between 5e-1 and 45e-1"


@query("S1_frame_index_checks", "frames", """
    select sequence, count(*) as frames, min(frame_idx) as first_frame, max(frame_idx) as last_frame,
           count(distinct frame_idx) = max(frame_idx) - min(frame_idx) + 1 as contiguous,
           count(distinct frame_idx) = count(*) as unique_frames
    from frames group by sequence""", whole="sequence first_frame last_frame")
def _(src):
    return frame_index.frame_checks(src.frames)


@query("S7_report_unnest", "candidates", """
    select sequence, frame_idx, count(*) as candidates, max(case when cand = 0 then patch_id end) as selected_patch_id,
           max(case when cand = 0 then final_score end) as selected_score
    from candidates group by sequence, frame_idx""", real="selected_score",
       whole="sequence frame_idx selected_patch_id")
def _(src):
    nested = reports.nest_candidates(src.candidates, ["patch_id", "final_score"])
    rows = reports.unnest_candidates(nested)
    flat = rows.groupBy("sequence", "frame_idx").agg(F.count("*").alias("candidates"))
    sel = nested.select("sequence", "frame_idx", reports.selected_candidate(F.lit(None).cast("int")).alias("s"))
    return flat.join(sel, ["sequence", "frame_idx"]).select(
        "sequence", "frame_idx", "candidates", F.col("s.patch_id").alias("selected_patch_id"),
        F.col("s.final_score").alias("selected_score"))


@query("S11_detection_export", "manifest", """
    with rows_ as (select *, row_number() over (order by doc_id) as image_id from manifest),
    boxed as (select *, try_cast(box_json as json) as j from rows_),
    parsed as (select *, case when json_valid(box_json) and json_array_length(box_json) = 4
        then cast(cast(box_json as json) as double[]) end as box from rows_),
    good as (select *, case
        when person_label not in ('person', 'not_person') then 'person_label'
        when person_label = 'person' and motion_label not in ('moving', 'static', 'uncertain') then 'motion_label'
        when person_label = 'person' and instance_id in ('', 'pending') then 'instance_id'
        when person_label = 'person' and (box is null or box[3] <= box[1] or box[4] <= box[2]) then 'box_json'
        end as issue from parsed)
    select row_number() over (order by image_id) as annotation_id, image_id, box[1] as x, box[2] as y,
           box[3] - box[1] as w, box[4] - box[2] as h, (box[3] - box[1]) * (box[4] - box[2]) as area,
           sequence, anchor_frame, motion_label, instance_id,
           concat(split_part(json_extract_string(paths_json, '$[1]'), '/', 1), '/', cast(doc_id as varchar), '_b.png')
               as file_name
    from good where issue is null and person_label = 'person'""",
       real="x y w h area", whole="annotation_id image_id sequence anchor_frame")
def _(src):
    return manifests.detection_annotations(src.manifest, "doc_id")


@query("P1_box_crop", "points", f"""
    select sequence, frame_idx, point_idx, x, y, z, label from points where {IN_BOX}""", real="x y z",
       whole="sequence frame_idx label")
def _(src):
    return pts.crop(src.points, *BOX).select("sequence", "frame_idx", "point_idx", "x", "y", "z", "label")


@query("P2_transform_points", "points poses", """
    select p.sequence, p.frame_idx, point_idx, label, cos(yaw) * x - sin(yaw) * y + px as wx,
           sin(yaw) * x + cos(yaw) * y + py as wy, z + pz as wz
    from points p join poses q on p.sequence = q.sequence and p.frame_idx = q.frame_idx""",
       real="wx wy wz", whole="sequence frame_idx label")
def _(src):
    return pts.to_world(src.points, pts.planar_poses(src.poses)).select(
        "sequence", "frame_idx", "point_idx", "label", "wx", "wy", "wz")


@query("P3_invert_and_compose", "poses", """
    select sequence, frame_idx, -(cos(yaw) * px + sin(yaw) * py) as ix, sin(yaw) * px - cos(yaw) * py as iy,
           -pz as iz, 0e0 as identity_gap, cos(2 * yaw) as squared_r00,
           cos(yaw) * px - sin(yaw) * py + px as squared_tx from poses""",
       real="ix iy iz identity_gap squared_r00 squared_tx", whole="sequence frame_idx")
def _(src):
    p = pts.planar_poses(src.poses)
    p = p.withColumn("inv", P.invert("pose")).withColumn("ident", P.compose("inv", "pose")).withColumn(
        "sq", P.compose("pose", "pose"))
    gap = sum((F.abs(F.col("ident")[i] - v) for i, v in enumerate(P.IDENTITY)), F.lit(0.0))
    return p.select("sequence", "frame_idx", P.pose_x("inv").alias("ix"), P.pose_y("inv").alias("iy"),
                    P.entry("inv", 2, 3).alias("iz"), gap.alias("identity_gap"),
                    P.entry("sq", 0, 0).alias("squared_r00"), P.pose_x("sq").alias("squared_tx"))


@query("P4_quaternion_to_pose", "points", """
    with q as (select point_idx, l, x, y, z, x*x + y*y + z*z + 1e0 as n from
        (select point_idx, label as l, x / 10 as x, y / 10 as y, z as z from points) t)
    select point_idx, 1 - 2 * (y*y + z*z) / n as r00, 2 * (x*y - z) / n as r01, 2 * (x*z + y) / n as r02,
           2 * (x*y + z) / n as r10, 1 - 2 * (x*x + z*z) / n as r11, 2 * (y*z + x) / n as r21,
           1 - 2 * (x*x + y*y) / n as r22 from q""", real="r00 r01 r02 r10 r11 r21 r22")
def _(src):
    q = src.points.withColumn("m", P.pose_from_quaternion(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.col("x") / 10,
                                                          F.col("y") / 10, F.col("z"), F.lit(1.0)))
    return q.select("point_idx", *[P.entry("m", int(n[0]), int(n[1])).alias(f"r{n}")
                                   for n in ("00", "01", "02", "10", "11", "21", "22")])


@query("P5_yaw_and_wrap", "poses", """
    select sequence, frame_idx, atan2(2 * cos(yaw / 2) * sin(yaw / 2), 1 - 2 * sin(yaw / 2) * sin(yaw / 2)) as q_yaw,
           (3 * yaw + pi()) - 2 * pi() * floor((3 * yaw + pi()) / (2 * pi())) - pi() as wrapped from poses""",
       real="q_yaw wrapped", whole="sequence frame_idx")
def _(src):
    half = F.col("yaw") / 2.0
    return src.poses.select("sequence", "frame_idx",
                            P.yaw_from_quaternion(F.lit(0.0), F.lit(0.0), F.sin(half), F.cos(half)).alias("q_yaw"),
                            P.wrap_to_pi(3.0 * F.col("yaw")).alias("wrapped"))


_CAMERA = "p.sequence, frame_idx, point_idx, x / (z + 1) as xn, y / (z + 1) as yn, fx, fy, cx, cy, width, height, " \
          "k1, k2, p1, p2, k3 from points p join cameras c on p.sequence = c.sequence"


@query("P6_pinhole_projection", "points cameras", """
    select p.sequence, frame_idx, point_idx, case when z > 1 then fx * x / z + cx end as u,
           case when z > 1 then fy * y / z + cy end as v
    from points p join cameras c on p.sequence = c.sequence""", real="u v", whole="sequence frame_idx")
def _(src):
    j = src.points.join(src.cameras, "sequence")
    depth = F.when(F.col("z") > 1, F.col("z")).otherwise(F.lit(-1.0))
    u, v = C.project("x", "y", depth, "fx", "fy", "cx", "cy")
    return j.select("sequence", "frame_idx", "point_idx", u.alias("u"), v.alias("v"))


@query("P7_distorted_pixel", "points cameras", f"""
    with n as (select {_CAMERA}),
    r as (select *, xn * xn + yn * yn as r2 from n),
    d as (select *, 1 + r2 * (k1 + r2 * (k2 + r2 * k3)) as rad from r),
    uv as (select *, round_even(fx * (xn * rad + 2 * p1 * xn * yn + p2 * (r2 + 2 * xn * xn)) + cx, 0) as ru,
                  round_even(fy * (yn * rad + p1 * (r2 + 2 * yn * yn) + 2 * p2 * xn * yn) + cy, 0) as rv from d),
    i as (select *, ru >= 0 and ru < width and rv >= 0 and rv < height as ok from uv)
    select sequence, frame_idx, point_idx, case when ok then cast(ru as bigint) end as u,
           case when ok then cast(rv as bigint) end as v from i""", whole="sequence frame_idx u v")
def _(src):
    j = src.points.join(src.cameras, "sequence")
    u, v = C.project_distorted("x", "y", F.col("z") + 1.0, "fx", "fy", "cx", "cy", ["k1", "k2", "p1", "p2", "k3"])
    j = j.withColumns({"_u": u, "_v": v})
    ui, vi = C.pixel_index(F.col("_u"), F.col("_v"), "width", "height")
    return j.select("sequence", "frame_idx", "point_idx", ui.alias("u"), vi.alias("v"))


@query("P8_back_projection", "pixels cameras", """
    select p.sequence, frame_idx, camera, u, v, (u - cx) * depth / fx as x, (v - cy) * depth / fy as y, depth as z
    from pixels p join cameras c on p.sequence = c.sequence""", real="x y z", whole="sequence frame_idx u v")
def _(src):
    x, y, z = C.unproject("u", "v", "depth", "fx", "fy", "cx", "cy")
    return src.pixels.join(src.cameras, "sequence").select(
        "sequence", "frame_idx", "camera", "u", "v", x.alias("x"), y.alias("y"), z.alias("z"))


def _undistort_sql(rounds: int = 5) -> str:
    steps = ["u0 as (select p.sequence, frame_idx, camera, u, v, (u - cx) / fx as x0, (v - cy) / fy as y0, "
             "(u - cx) / fx as x, (v - cy) / fy as y, k1, k2, p1, p2, k3 "
             "from pixels p join cameras c on p.sequence = c.sequence)"]
    for i in range(rounds):
        steps.append(f"r{i} as (select *, x*x + y*y as r2 from u{i})")
        steps.append(f"u{i + 1} as (select sequence, frame_idx, camera, u, v, x0, y0, k1, k2, p1, p2, k3, "
                     "(x0 - (2*p1*x*y + p2*(r2 + 2*x*x))) / (1 + r2*(k1 + r2*(k2 + r2*k3))) as x, "
                     "(y0 - (p1*(r2 + 2*y*y) + 2*p2*x*y)) / (1 + r2*(k1 + r2*(k2 + r2*k3))) as y "
                     f"from r{i})")
    return f"with {', '.join(steps)} select sequence, frame_idx, camera, u, v, x as un, y as vn from u{rounds}"


@query("P9_undistort_pixels", "pixels cameras", _undistort_sql(), real="un vn", whole="sequence frame_idx u v")
def _(src):
    j = src.pixels.join(src.cameras, "sequence")
    return C.undistorted_columns(j, "u", "v", "fx", "fy", "cx", "cy", ["k1", "k2", "p1", "p2", "k3"]).select(
        "sequence", "frame_idx", "camera", "u", "v", "un", "vn")


@query("P11_planar_rotation", "points", """
    select point_idx, z, cos(7e-1) * x - sin(7e-1) * y as rx, sin(7e-1) * x + cos(7e-1) * y as ry from points""",
       real="z rx ry")
def _(src):
    rx, ry = P.rotate_xy("x", "y", F.lit(0.7))
    return src.points.select("point_idx", "z", rx.alias("rx"), ry.alias("ry"))


_RASTER = f"""select sequence, frame_idx, cast(39 - floor((y + 10) / 5e-1) as bigint) as row,
    cast(floor((x + 10) / 5e-1) as bigint) as col, count(*) as cnt, max(z) as max_h, avg(z) as mean_h
    from points where {IN_BOX} and x < 10 and y < 10 group by all"""


def _raster(src):
    return pts.grid_raster(pts.crop(src.points, *BOX), ["sequence", "frame_idx"], (-10, 10, -10, 10), 0.5)


@query("A1_grid_raster", "points", f"select *, 1 as occupancy from ({_RASTER})", real="max_h mean_h",
       whole="sequence frame_idx occupancy")
def _(src):
    return _raster(src)


@query("P12_raster_translate", "points", f"""
    select sequence, frame_idx, row - 2 as row, col + 3 as col, cnt, max_h from ({_RASTER})
    where row - 2 between 0 and 39 and col + 3 between 0 and 39""", real="max_h", whole="sequence frame_idx row col")
def _(src):
    return pts.shift_raster(_raster(src), 3, -2, 40, 40).select("sequence", "frame_idx", "row", "col", "cnt", "max_h")


@query("P12_raster_rotate", "points", f"""
    with cells as ({_RASTER}),
    t as (select sequence, frame_idx, tr, tc from (select distinct sequence, frame_idx from cells) f,
          (select unnest(range(40)) as tr) a, (select unnest(range(40)) as tc) b),
    b as (select *, cast(round_even((tc - 195e-1) * cos(radians(30)) - (tr - 195e-1) * sin(radians(30)) + 195e-1, 0)
                    as bigint) as col,
                 cast(round_even((tc - 195e-1) * sin(radians(30)) + (tr - 195e-1) * cos(radians(30)) + 195e-1, 0)
                    as bigint) as row from t)
    select b.sequence, b.frame_idx, tr as row, tc as col, cnt, max_h from b join cells c
      on b.sequence = c.sequence and b.frame_idx = c.frame_idx and b.row = c.row and b.col = c.col""",
       real="max_h", whole="sequence frame_idx row col")
def _(src):
    return pts.rotate_raster(_raster(src), 30.0, 40, 40).select("sequence", "frame_idx", "row", "col", "cnt", "max_h")


@query("P13_cell_keys", "points", """
    select point_idx, floor(x / 5e-1) as ix, floor(y / 5e-1) as iy,
           (floor(x / 5e-1) + 100000) * 1000000 + floor(y / 5e-1) + 100000 as packed from points""",
       whole="ix iy packed")
def _(src):
    p = src.points.select("point_idx", G.cell_of("x", 0.5).alias("ix"), G.cell_of("y", 0.5).alias("iy"))
    return p.withColumn("packed", G.packed_cell("ix", "iy"))


@query("P14_label_groups", "points", """
    select label, case when label in (1,2,4,6,8) then 0 when label in (5,7,9,10,11) then 1
           when label in (12,13,14,15) then 2 else -1 end as grp,
           case when label in (1,2,4,6,8) then 1e0 when label in (5,7,9,10,11) then 35e-2 else 0e0 end as weight,
           count(*) as points from points group by all""", real="weight", whole="label grp")
def _(src):
    return src.points.groupBy("label").agg(F.count("*").alias("points")).select(
        "label", G.label_group("label").alias("grp"), G.label_weight("label").alias("weight"), "points")


@query("P15_frame_stride", "frames", """
    with by_index as (select sequence, frame_idx from frames where frame_idx >= 10 and frame_idx < 10 + 500
                      and (frame_idx - 10) % 5 = 0),
    by_count as (select sequence, frame_idx, row_number() over (partition by sequence order by frame_idx) as rn
                 from frames where frame_idx >= 10 and (frame_idx - 10) % 5 = 0)
    select 'index' as variant, sequence, frame_idx from by_index
    union all select 'count', sequence, frame_idx from by_count where rn <= 50""", whole="sequence frame_idx")
def _(src):
    a = frame_index.select_frames(src.frames, 10, 500, 5, "index")
    b = frame_index.select_frames(src.frames, 10, 50, 5, "count")
    return (a.select(F.lit("index").alias("variant"), "sequence", "frame_idx")
             .unionByName(b.select(F.lit("count").alias("variant"), "sequence", "frame_idx")))


@query("P16_sequence_split", "frames", """
    with s as (select distinct sequence from frames)
    select sequence, case when sequence in (2, 5) then 'validation' else 'train' end as by_name,
           case when sequence = (select max(sequence) from s) then 'validation' else 'train' end as by_last from s""",
       whole="sequence")
def _(src):
    s = src.frames.select("sequence").distinct()
    a = frame_index.split_sequences(s, "sequence", names=[2, 5]).withColumnRenamed("split", "by_name")
    b = frame_index.split_sequences(s, "sequence").withColumnRenamed("split", "by_last")
    return a.join(b, "sequence")


@query("P17_spatial_block_split", "points", """
    with c as (select distinct floor(x / 5e-1) as ix, floor(y / 5e-1) as iy from points)
    select ix, iy, ((floor(ix / 8) + 3 * floor(iy / 8)) % 5 + 5) % 5 = 1 as validation from c""", whole="ix iy")
def _(src):
    c = src.points.select(G.cell_of("x", 0.5).alias("ix"), G.cell_of("y", 0.5).alias("iy")).distinct()
    return c.withColumn("validation", G.spatial_block_is_validation("ix", "iy"))


@query("P18_stereo_depth_features", "pixels", """
    with d as (select sequence, frame_idx, camera, u, v, round(depth * 1000) * 1e-3 as m from pixels),
    e as (select *, greatest(least(m, 12e0), 2e-1) as c from d)
    select sequence, frame_idx, camera, u, v,
           greatest(least((case when m > 0 then 1 / c else 0 end) / (1 / 2e-1), 1), 0) as inv_depth,
           greatest(least((case when m > 0 then 400 * 1e-1 / c else 0 end) / 64, 1), 0) as disparity,
           case when m > 0 then 1e0 else 0e0 end as valid from e""",
       real="inv_depth disparity valid", whole="sequence frame_idx u v")
def _(src):
    inv, disp, valid = C.stereo_features(F.round(F.col("depth") * 1000), 400.0, 0.1, 0.001, 0.2, 12.0, 64.0)
    return src.pixels.select("sequence", "frame_idx", "camera", "u", "v", inv.alias("inv_depth"),
                             disp.alias("disparity"), valid.alias("valid"))


@query("P23_pose_target_bins", "candidates", """
    with t as (select event_id, cand, greatest(least((x - gt_x) * 4, 2), -2) as tx, yaw as tyaw from candidates),
    c as (select * from (select unnest([-2e0, -1e0, 0e0, 1e0, 2e0]) as bx, unnest([0, 1, 2, 3, 4]) as bi) b),
    yc as (select * from (select unnest([-3e0, -15e-1, 0e0, 15e-1, 3e0]) as byaw, unnest([0, 1, 2, 3, 4]) as yi) b),
    xb as (select event_id, cand, tx, tyaw, arg_min(bi, abs(tx - bx)) as x_bin,
           arg_min(bx, abs(tx - bx)) as x_center from t, c group by all),
    yb as (select event_id, cand, tx, x_bin, x_center, tyaw,
           arg_min(yi, abs(atan2(sin(tyaw - byaw), cos(tyaw - byaw)))) as yaw_bin,
           arg_min(byaw, abs(atan2(sin(tyaw - byaw), cos(tyaw - byaw)))) as yaw_center from xb, yc group by all)
    select event_id, cand, x_bin, yaw_bin, greatest(least((tx - x_center) / 5e-1, 1), -1) as x_residual,
           greatest(least(atan2(sin(tyaw - yaw_center), cos(tyaw - yaw_center)) / 75e-2, 1), -1) as yaw_residual
    from yb""", real="x_residual yaw_residual", whole="cand x_bin yaw_bin")
def _(src):
    xs, yaws = [-2.0, -1.0, 0.0, 1.0, 2.0], [-3.0, -1.5, 0.0, 1.5, 3.0]
    t = src.candidates.withColumn(
        "tx", F.greatest(F.least((F.col("x") - F.col("gt_x")) * 4, F.lit(2.0)), F.lit(-2.0)))
    t = t.withColumn("x_bin", pts.nearest_bin("tx", xs)).withColumn("yaw_bin", pts.nearest_bin("yaw", yaws, True))
    return t.select("event_id", "cand", "x_bin", "yaw_bin",
                    pts.bin_residual("tx", "x_bin", xs, 1.0).alias("x_residual"),
                    pts.bin_residual("yaw", "yaw_bin", yaws, 1.5, True).alias("yaw_residual"))


@query("P25_relative_pose_targets", "candidates", """
    select event_id, cand, gt_x - x as dx, gt_y - y as dy,
           (gt_yaw - yaw + pi()) - 2 * pi() * floor((gt_yaw - yaw + pi()) / (2 * pi())) - pi() as dyaw
    from candidates""", real="dx dy dyaw", whole="cand")
def _(src):
    return src.candidates.select("event_id", "cand", (F.col("gt_x") - F.col("x")).alias("dx"),
                                 (F.col("gt_y") - F.col("y")).alias("dy"),
                                 P.wrap_to_pi(F.col("gt_yaw") - F.col("yaw")).alias("dyaw"))


@query("P28_candidate_errors", "candidates", """
    select event_id, cand, sqrt((x - gt_x) * (x - gt_x) + (y - gt_y) * (y - gt_y)) as position_error,
           abs(degrees((yaw - gt_yaw + pi()) - 2 * pi() * floor((yaw - gt_yaw + pi()) / (2 * pi())) - pi()))
               as yaw_error_deg from candidates""", real="position_error yaw_error_deg", whole="cand")
def _(src):
    return src.candidates.select("event_id", "cand", P.xy_error("x", "y", "gt_x", "gt_y").alias("position_error"),
                                 P.yaw_gap_deg("yaw", "gt_yaw").alias("yaw_error_deg"))


@query("P29_search_grid", "poses", """
    select sequence, frame_idx, 'rotation' as grid, a * 45e0 as angle_deg
    from poses, (select unnest(range(8)) as a) t
    union all select sequence, frame_idx, 'offset', -15 + b * 5e0 from poses, (select unnest(range(7)) as b) t""",
       real="angle_deg", whole="sequence frame_idx")
def _(src):
    grids = [F.struct(F.lit("rotation").alias("grid"), F.lit(a).alias("angle_deg")) for a in pts.search_angles(45.0)]
    grids += [F.struct(F.lit("offset").alias("grid"), F.lit(a).alias("angle_deg"))
              for a in pts.yaw_offsets(15.0, 5.0)]
    return src.poses.select("sequence", "frame_idx", F.inline(F.array(*grids)))


@query("P30_match_channels", "points", f"""
    select sequence, frame_idx, row, col, 1e0 as occupancy, ln(1 + cnt) as cnt_channel, max_h as max_height,
           mean_h as mean_height, ln(1 + cnt) + 25e-2 * max_h as count_height from ({_RASTER})""",
       real="occupancy cnt_channel max_height mean_height count_height", whole="sequence frame_idx")
def _(src):
    r = _raster(src)
    return r.select("sequence", "frame_idx", "row", "col", pts.match_channel("occupancy").alias("occupancy"),
                    pts.match_channel("count").alias("cnt_channel"), pts.match_channel("max_height").alias("max_height"),
                    pts.match_channel("mean_height").alias("mean_height"),
                    pts.match_channel("count_height").alias("count_height"))


@query("P32_planar_pose_matrix", "poses", """
    select sequence, frame_idx, cos(yaw) as m00, -sin(yaw) as m01, sin(yaw) as m10, px as m03, py as m13, pz as m23
    from poses""", real="m00 m01 m10 m03 m13 m23", whole="sequence frame_idx")
def _(src):
    return pts.planar_poses(src.poses).select("sequence", "frame_idx", *[
        P.entry("pose", int(n[0]), int(n[1])).alias(f"m{n}") for n in ("00", "01", "10", "03", "13", "23")])


_BOUNDS = """(select floor((min(x) - 5e-4) / 5e-1) * 5e-1 as x_min, ceil((max(x) + 5e-4) / 5e-1) * 5e-1 as x_max,
    floor((min(y) - 5e-4) / 5e-1) * 5e-1 as y_min, ceil((max(y) + 5e-4) / 5e-1) * 5e-1 as y_max from points)"""
_GLOBAL = f"""(select cast(round((y_max - y_min) / 5e-1) - 1 - floor((y - y_min) / 5e-1) as bigint) as row,
    cast(floor((x - x_min) / 5e-1) as bigint) as col, count(*) as cnt, max(z) as max_h, avg(z) as mean_h
    from points, {_BOUNDS} b group by all)"""
_TILES = f"""(select i * (floor((w - 8) / 4) + 1) + j as patch_id, i * 4 as r0, i * 4 + 8 as r1, j * 4 as c0,
    j * 4 + 8 as c1, x_min + j * 4 * 5e-1 as bx0, y_max - i * 4 * 5e-1 as by1
    from (select *, round((x_max - x_min) / 5e-1) as w, round((y_max - y_min) / 5e-1) as h from {_BOUNDS} b0) b,
         (select unnest(range(400)) as i) ti, (select unnest(range(400)) as j) tj
    where i <= floor((h - 8) / 4) and j <= floor((w - 8) / 4))"""


@query("A2_global_bounds_raster", "points", f"select * from {_GLOBAL} g", real="max_h mean_h", whole="row col")
def _(src):
    return pts.global_raster(src.points, 0.5)


@query("A3_patch_tiles", "points", f"""
    select patch_id, r0, r1, c0, c1, bx0, bx0 + 4 as bx1, by1 - 4 as by0, by1, bx0 + 2 as center_x,
           by1 - 2 as center_y from {_TILES} t""", real="bx0 bx1 by0 by1 center_x center_y",
       whole="patch_id r0 r1 c0 c1")
def _(src):
    return pts.patch_tiles(src.points, 0.5, 4.0, 2.0)


@query("A3_patch_cells", "points", f"""
    select patch_id, g.row - r0 as prow, g.col - c0 as pcol, cnt, max_h, mean_h
    from {_GLOBAL} g join {_TILES} t on g.row >= r0 and g.row < r1 and g.col >= c0 and g.col < c1""",
       real="max_h mean_h", whole="patch_id prow pcol cnt")
def _(src):
    p = src.points
    return pts.cells_to_patches(pts.global_raster(p, 0.5), pts.patch_tiles(p, 0.5, 4.0, 2.0), 8, 4)


@query("A4_voxel_first_point", "points", """
    with v as (select *, floor(x / 1e0) as vx, floor(y / 1e0) as vy, floor(z / 1e0) as vz from points)
    select sequence, frame_idx, vx, vy, vz, arg_min(point_idx, (point_idx, x, y, z)) as point_idx,
           arg_min(x, (point_idx, x, y, z)) as x, arg_min(y, (point_idx, x, y, z)) as y,
           arg_min(z, (point_idx, x, y, z)) as z from v group by sequence, frame_idx, vx, vy, vz""",
       real="x y z", whole="sequence frame_idx vx vy vz")
def _(src):
    return pts.voxel_first(src.points, ["sequence", "frame_idx"], 1.0, "point_idx")


@query("A15_sequence_profile", "frames poses", """
    with t as (select sequence, count(*) as frames, max(ts_sec) - min(ts_sec) as duration,
               (count(*) - 1) / (max(ts_sec) - min(ts_sec)) as rate_hz, min(gt_x) as min_x, max(gt_x) as max_x
               from frames group by sequence),
    d as (select sequence, ts_sec - lag(ts_sec) over w as dt,
                 sqrt(pow(gt_x - lag(gt_x) over w, 2) + pow(gt_y - lag(gt_y) over w, 2)) as step,
                 gt_yaw - lag(gt_yaw) over w as dyaw
          from frames window w as (partition by sequence order by frame_idx)),
    e as (select sequence, 1 / quantile_cont(dt, 5e-1) filter (where dt > 0) as median_hz, avg(step) as mean_step,
                 max(step) as max_step, quantile_cont(step, 5e-1) as median_step,
                 min((dyaw + pi()) - 2 * pi() * floor((dyaw + pi()) / (2 * pi())) - pi()) as min_dyaw,
                 max((dyaw + pi()) - 2 * pi() * floor((dyaw + pi()) / (2 * pi())) - pi()) as max_dyaw
          from d group by sequence)
    select * from t join e using (sequence)""",
       real="duration rate_hz min_x max_x median_hz mean_step max_step median_step min_dyaw max_dyaw",
       whole="sequence")
def _(src):
    return profiles.sequence_profile(src.frames)


@query("A16_map_profile", "map_points", """
    select count(*) as points, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, min(z) as z0, max(z) as z1,
           max(x) - min(x) as extent_x, max(y) - min(y) as extent_y, max(z) - min(z) as extent_z,
           avg(sqrt(x * x + y * y + z * z)) as normal_norm from map_points""",
       real="x0 x1 y0 y1 z0 z1 extent_x extent_y extent_z normal_norm")
def _(src):
    return profiles.map_profile(src.map_points, normals=("x", "y", "z"))


@query("A35_value_summary", "points", """
    select sequence, min(n) as min_points, max(n) as max_points, avg(n) as mean_points,
           quantile_cont(n, 5e-1) as median_points
    from (select sequence, frame_idx, count(*) as n from points group by all) t group by sequence""",
       real="mean_points median_points", whole="sequence")
def _(src):
    n = src.points.groupBy("sequence", "frame_idx").agg(F.count("*").alias("n"))
    return profiles.value_summary(n, ["sequence"], "n", "points")
