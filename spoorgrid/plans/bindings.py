"""Domain tables derived from the driver's parquet tables, as SQL that Spark and DuckDB both run.

Every binding is a projection (or a plain aggregate) of a whole table, so work grows with the data.
`@name(...)` marks the few spots where the two dialects differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
               "pages benchmark labels conversations").split()


def _h(salt: int) -> str:
    """A deterministic value in [0, 1) per (event, candidate)."""
    return f"(((event_id * 7919 + cand * 104729 + {salt * 1299721}) % 1009) / 1009e0)"


def _g(salt: int) -> str:
    """A deterministic value in [0, 1) per event."""
    return f"(((event_id * 6007 + {salt * 15485863}) % 997) / 997e0)"


BINDINGS: dict[str, str] = {
    # one localisation result per event; eight long sequences with dense frame numbers
    "frames": f"""
        select cast(event_id % 8 as int) as sequence, cast(floor(event_id / 8e0) as int) as frame_idx, event_id,
               @us(ts) / 1e6 as ts_sec, value / 1e2 as position_error, cast(@k(props) as int) % 16 as patch_id,
               case event_id % 8 % 3 when 0 then 'train' when 1 then 'validation' else 'blind_test' end as split,
               floor(event_id / 8e0) * 5e-2 as gt_x, {_g(1)} * 4e-1 as gt_y, {_g(2)} * 6e0 - 3e0 as gt_yaw,
               {_g(3)} * 25e-2 as semi_ratio, {_g(4)} * 3e-1 as person_ratio, {_g(5)} as occlusion_ratio,
               event_type, {_g(6)} < 5e-1 as filter_applied
        from {{events}}""",
    # five candidates per frame, already ordered by final_score (strictly decreasing in cand)
    "candidates": f"""
        select sequence, frame_idx, event_id, cand, (patch_k + cand * 3) % 16 as patch_id,
               15e-1 - 2e-1 * cand - 15e-2 * {_h(1)} as final_score,
               9e-1 - 1e-1 * cand - 5e-2 * {_h(2)} as coarse_score, 3e-1 * {_h(3)} as bev_score,
               4e-1 + 6e-1 * {_h(4)} as icp_inlier_ratio, 1e-1 + 5e-1 * {_h(5)} as icp_rmse,
               {_h(6)} as deep_match_probability, {_h(7)} as deep_pose_confidence,
               {_h(8)} > 2e-1 as icp_valid,
               case when {_h(9)} < 4e-1 then 'bev_init' when {_h(9)} < 7e-1 then 'deep_init' else 'tracker_init' end
                   as init_source,
               gt_x + ({_h(10)} - 5e-1) * 6e-1 as x, gt_y + ({_h(11)} - 5e-1) * 6e-1 as y,
               gt_yaw + ({_h(12)} - 5e-1) * 2e-1 as yaw, gt_x, gt_y, gt_yaw,
               gt_x + ({_h(13)} - 5e-1) * 2e0 as pred_x, gt_y + ({_h(14)} - 5e-1) * 2e0 as pred_y,
               gt_yaw + ({_h(15)} - 5e-1) * 4e-1 as pred_yaw, {_h(16)} as rerank_probability
        from (select cast(event_id % 8 as int) as sequence, cast(floor(event_id / 8e0) as int) as frame_idx,
                     event_id, cast(@k(props) as int) % 16 as patch_k, floor(event_id / 8e0) * 5e-2 as gt_x,
                     {_g(1)} * 4e-1 as gt_y, {_g(2)} * 6e0 - 3e0 as gt_yaw, @explode5 as cand from {{events}}) e""",
    # about a hundred labelled points per frame
    "points": """
        select cast(l_orderkey % 5 as int) as sequence, cast(floor(l_orderkey / 125e0) as int) as frame_idx,
               ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 100 + cast(l_quantity as bigint) as point_idx, (l_extendedprice - 5295e1) / 5e3 as x,
               (l_partkey * 37 % 2000) / 1e2 - 1e1 as y, l_quantity / 1e1 as z, cast(l_suppkey % 16 as int) as label,
               case l_returnflag when 'A' then 'initial' when 'N' then 'sameday' else 'crossday' end as role,
               l_orderkey % 3 as day
        from {lineitem}""",
    "poses": """
        select sequence, frame_idx, frame_idx / 1e1 as ts_sec,
               (min(o_custkey) % 100) / 5e1 - 1e0 + frame_idx * 2e-2 as px,
               (max(o_custkey) % 100) / 5e1 - 1e0 as py, (min(o_custkey) % 7) / 1e1 as pz,
               (sum(o_custkey) % 628) / 1e2 - 314e-2 as yaw
        from (select cast(o_orderkey % 5 as int) as sequence, cast(floor(o_orderkey / 125e0) as int) as frame_idx,
                     o_custkey from {orders}) o
        group by sequence, frame_idx""",
    "map_points": """
        select p_partkey as point_idx, p_size * 4e-1 - 1e1 as x, (p_partkey * 37 % 2000) / 1e2 - 1e1 as y,
               p_retailprice / 2e2 - 4e0 as z from {part}""",
    "pixels": """
        select cast(l_orderkey % 5 as int) as sequence, cast(floor(l_orderkey / 125e0) as int) as frame_idx,
               case l_linestatus when 'F' then 'left' else 'right' end as camera,
               cast(l_partkey % 32 as int) as u, cast((l_orderkey * 7 + l_linenumber) % 24 as int) as v,
               min(cast(l_suppkey % 16 as int)) as label, min(l_quantity) / 5e0 as depth
        from {lineitem} group by 1, 2, 3, 4, 5""",
    "cameras": """
        select cast(r_regionkey as int) as sequence, 16e0 as fx, 16e0 as fy, 16e0 as cx, 12e0 as cy, 32 as width,
               24 as height, 5e-2 as k1, -1e-2 as k2, 1e-3 as p1, -1e-3 as p2, 0e0 as k3 from {region}""",
    "embeds": "select vec_id, embedding, label from {embeddings}",
    "detections": """
        select cast(o_orderkey % 3 as int) as sequence, cast(floor(o_orderkey / 24e0) as int) as frame_idx,
               o_orderkey as det_id, (o_orderkey * 13 % 80) * 1e0 as x1, (o_custkey % 60) * 1e0 as y1,
               (o_orderkey * 13 % 80) + 10e0 + o_orderkey % 20 as x2, (o_custkey % 60) + 20e0 + o_custkey % 30 as y2,
               (o_orderkey % 97) / 97e0 as score, o_orderstatus = 'F' as is_reference
        from {orders}""",
    "objects": """
        select cast(o_orderkey % 3 as int) as sequence, cast(floor(o_orderkey / 24e0) as int) as frame_idx,
               case o_orderpriority when '1-URGENT' then 'person' when '2-HIGH' then 'cart' else 'forklift' end
                   as target,
               o_orderkey as obs_id, (o_custkey % 40) / 1e1 as x, (o_orderkey * 7 % 40) / 1e1 as y,
               (o_custkey % 5) / 1e1 as z, floor(o_orderkey / 24e0) / 1e1 as ts_sec
        from {orders}""",
    # tracked objects: one observation per (sequence, track, frame), with gaps
    "tracks": """
        select track, cast(f as int) as frame_idx, f * 11e-2 + (o_custkey % 5) / 1e2 as ts_sec,
               f * 2e-2 + (o_custkey % 30) / 1e2 as x, (o_custkey % 17) / 1e2 as y, (o_custkey % 3) / 1e1 as z
        from (select cast(o_orderkey % 16 as int) as track, o_custkey,
                     floor(o_orderkey / 16e0) + 4 * floor(o_orderkey / 368e0) + floor(o_orderkey / 112e0) as f from {orders}) o""",
    # one calibration file a rig: two cameras and where the first one sits
    "rigs": """
        select s_suppkey as calib_id, 4e2 + s_suppkey % 17 as fx, 4e2 + s_suppkey % 13 as fy, 32e1 + s_suppkey % 5 as cx, 24e1 + s_nationkey as cy,
               (s_suppkey % 9) / 1e2 as k1, -(s_suppkey % 7) / 1e3 as k2, s_acctbal / 1e4 as px, s_nationkey / 1e1 as py from {supplier}""",
    "presence": """
        select cast(event_id % 8 as int) as sequence, cast(floor(event_id / 8e0) as int) as frame_idx,
               case event_id % 8 % 3 when 0 then 'train' when 1 then 'validation' else 'blind_test' end as split,
               event_type as target, value / 1e2 as position_error, value > 3e0 as present
        from {events}""",
    "components": """
        select o_orderkey as component_id, cast(o_orderkey % 6 as int) as sequence,
               cast(floor(o_orderkey / 6e0) as int) as frame_idx,
               case o_orderkey % 6 % 2 when 0 then 'train' else 'validation' end as split,
               cast(10 + o_custkey % 50 as int) as height, cast(100 + o_orderkey % 800 as int) as pixel_area,
               (o_custkey % 100) / 1e2 as valid_depth_ratio,
               case when o_orderkey % 11 = 0 then null else (o_orderkey % 100) / 1e1 end as median_depth,
               (o_custkey % 71) / 71e0 as right_support,
               (o_orderkey * 13 % 80) * 1e0 as x1, (o_custkey % 60) * 1e0 as y1,
               (o_orderkey * 13 % 80) + 12e0 as x2, (o_custkey % 60) + 25e0 as y2
        from {orders}""",
    "manifest": """
        select d.doc_id, cast(d.doc_id % 7 as int) as sequence,
               case d.doc_id % 7 % 2 when 0 then 'train' else 'validation' end as split,
               cast(floor(d.doc_id / 7e0) as int) as anchor_frame,
               case when l.quality is null then 'pending' when l.quality = 1 then 'person' else 'not_person' end
                   as person_label,
               case when l.toxic is null then 'pending' when l.toxic = 1 then 'moving' else 'static' end
                   as motion_label,
               case when d.n_chars % 10 = 0 then '' else concat('i', cast(d.n_chars % 10 as varchar(9))) end
                   as instance_id,
               case when d.n_chars % 9 = 0 then 'not json' when d.n_chars % 9 = 1 then '[1, 2, 3]'
                    when d.n_chars % 9 = 2 then '[5, 5, 5, 9]'
                    else concat('[', cast(d.n_chars % 50 as varchar(9)), ', 10, ',
                                cast(d.n_chars % 50 + 20 as varchar(9)), ', 60]') end as box_json,
               cast(d.n_chars % 6 as int) as observation_count,
               concat('[0.', cast(d.n_chars % 9 as varchar(9)), ', 0.5, 0.', cast(d.doc_id % 9 as varchar(9)), ']')
                   as scores_json,
               concat('[0.0, 0.', cast(d.doc_id % 7 as varchar(9)), ', 0.', cast(d.n_chars % 7 as varchar(9)), ']')
                   as overlaps_json,
               case d.n_chars % 4 when 0 then 'potentially_moving' when 1 then 'ambiguous_motion'
                    when 2 then 'likely_static_relative_to_map' else 'insufficient_3d_evidence' end as motion_hint,
               concat('["', d.lang, '/', cast(d.doc_id as varchar(20)), '_a.png", "', d.lang, '/',
                      cast(d.doc_id as varchar(20)), '_b.png"]') as paths_json
        from {documents} d left join {labels} l on d.doc_id = l.doc_id""",
    # predicted risks and probabilities per source for each frame
    "gate": f"""
        select cast(event_id % 8 as int) as sequence, cast(floor(event_id / 8e0) as int) as frame_idx,
               value / 1e2 as bev_error, case when {_g(11)} < 8e-1 then value / 1e2 * (5e-1 + {_g(12)}) end
                   as deep_error,
               case when {_g(13)} < 6e-1 then value / 1e2 * (4e-1 + {_g(14)} * 12e-1) end as tracker_error,
               case when {_g(15)} < 3e-1 then 'bev_init' when {_g(15)} < 6e-1 then 'deep_init'
                    when {_g(15)} < 8e-1 then 'tracker_init' else 'deep_score_tracker_pose' end as init_source,
               {_g(16)} * 5e-1 as bev_logit, {_g(17)} * 5e-1 as deep_logit, {_g(18)} * 5e-1 - 5e-2 as tracker_logit,
               {_g(19)} as person_ratio
        from {{events}}""",
}

_SPARK_DIALECT = {
    r"@us\((\w+)\)": r"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', \1)",
    r"@k\((\w+)\)": r"get_json_object(\1, '$.k')",
    r"@explode5": "explode(sequence(0, 4))",
}
_DUCK_DIALECT = {
    r"@us\((\w+)\)": r"epoch_us(\1)",
    r"@k\((\w+)\)": r"json_extract_string(\1, '$.k')",
    r"@explode5": "unnest([0, 1, 2, 3, 4])",
}


def _dialect(sql: str, rules: dict[str, str]) -> str:
    for pattern, text in rules.items():
        sql = re.sub(pattern, text, sql)
    return sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A binding as a Spark DataFrame."""
    sql = _dialect(BINDINGS[name], _SPARK_DIALECT)
    used = {t: table(spark, sf_dir, t) for t in BASE_TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def duck(name: str) -> str:
    """The same binding as a DuckDB query."""
    sql = _dialect(BINDINGS[name], _DUCK_DIALECT)
    for t in BASE_TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def with_duck(names: str, body: str) -> str:
    """Prefix an oracle query with the bindings it uses."""
    ctes = ",\n".join(f"{n} as ({duck(n)})" for n in names.split())
    body = body.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {ctes},\n{body[15:]}"
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
