"""Queries on repeated-observation maps, masks, spatial joins and admission policies."""

from pyspark.sql import functions as F

from spoorgrid.functions import cells as G
from spoorgrid.functions import pose as P
from spoorgrid.operators import components, masks, policy, registration, spatial, vote
from spoorgrid.operators import points as pts
from spoorgrid.plans.catalog_points import _TILES
from spoorgrid.plans.registry import query
from spoorgrid.session import kept

ROLE = ["role"]
FRAME = ["sequence", "frame_idx"]

GRP = """case when label in (1,2,4,6,8) then 0 when label in (5,7,9,10,11) then 1
         when label in (12,13,14,15) then 2 else -1 end"""
STORES = f"""
    cp as (select role, sequence, frame_idx, floor(x) as ix, floor(y) as iy, label, {GRP} as grp from points),
    gv as (select role, sequence, frame_idx, ix, iy, grp, count(*) as n from cp where grp >= 0 group by all),
    gd as (select * from gv qualify row_number() over (partition by role, sequence, frame_idx, ix, iy
           order by n desc, grp) = 1),
    gs as (select role, ix, iy, count(*) as observed, count(*) filter (where grp = 0) as n_static,
           count(*) filter (where grp = 1) as n_semi, count(*) filter (where grp = 2) as n_dynamic
           from gd group by all),
    lv as (select role, sequence, frame_idx, ix, iy, label, count(*) as n from cp where label >= 1 group by all),
    ld as (select * from lv qualify row_number() over (partition by role, sequence, frame_idx, ix, iy
           order by n desc, label) = 1),
    ls as (select role, ix, iy, label, count(*) as n from ld group by all),
    st as (select *, (n_static + 5e-1 * n_semi) / greatest(n_static + n_semi + n_dynamic, 1)
           * (1 - exp(-observed / 6e0)) as stability,
           case when n_static >= n_semi and n_static >= n_dynamic then 0 when n_semi >= n_dynamic then 1 else 2 end
           as dominant_group from gs),
    dl as (select role, ix, iy, label, n, sum(n) over (partition by role, ix, iy) as support from ls
           qualify row_number() over (partition by role, ix, iy order by n desc, label) = 1)"""


def _cells(src):
    return vote.with_groups(src.points).withColumns({"ix": G.cell_of("x", 1.0), "iy": G.cell_of("y", 1.0)})


def _store(src, role=None):
    p = _cells(src)
    return vote.group_store(p, ROLE, FRAME) if role is None else vote.group_store(p.where(F.col("role") == role), [], FRAME)


def _labels(src, role):
    return vote.label_store(_cells(src).where(F.col("role") == role), [], FRAME)


@query("A5_two_stage_vote", "points", f"with {STORES} select * from gs",
       whole="ix iy")
def _(src):
    return _store(src)


@query("A5_label_histogram", "points", f"with {STORES} select * from ls", whole="ix iy label")
def _(src):
    return vote.label_store(_cells(src), ROLE, FRAME)


@query("A8_store_merge", "points", f"""with {STORES}
    select ix, iy, sum(observed) as observed, sum(n_static) as n_static, sum(n_semi) as n_semi,
           sum(n_dynamic) as n_dynamic from gs where role <> 'crossday' group by all""",
       whole="ix iy observed n_static n_semi n_dynamic")
def _(src):
    return vote.merge_stores(_store(src, "initial"), _store(src, "sameday"))


@query("A9_stability_score", "points", f"""with {STORES}
    select role, ix, iy, stability, (n_static + 5e-1 * n_semi) / greatest(observed, 1)
           * (1 - exp(-greatest(observed, 1) / 6e0)) as heuristic from st""", real="stability heuristic", whole="ix iy")
def _(src):
    return _store(src).select("role", "ix", "iy", vote.stability(6.0).alias("stability"),
                              vote.heuristic_stability(6.0).alias("heuristic"))


@query("A10_store_consistency", "points", f"""with {STORES}
    select count(*) as shared_cells, count(*) filter (where ok) as eligible_cells,
           avg(case when ok then (ag = bg)::int end) as dominant_agreement,
           avg(case when ok then abs(sa - sb) end) as mean_change
    from (select a.observed >= 6 and b.observed >= 6 as ok, a.dominant_group as ag, b.dominant_group as bg,
                 a.stability as sa, b.stability as sb
          from st a join st b on a.ix = b.ix and a.iy = b.iy where a.role = 'initial' and b.role = 'crossday') t""",
       real="dominant_agreement mean_change")
def _(src):
    return vote.store_consistency(_store(src, "initial"), _store(src, "crossday"), 6)


@query("A11_evidence_mix", "points", f"""with {STORES}
    select role, count(*) as cells, sum(observed) as observed, sum(n_static) as n_static, sum(n_semi) as n_semi,
           sum(n_dynamic) as n_dynamic, avg(stability) as mean_stability from st group by role""",
       real="mean_stability", whole="observed n_static n_semi n_dynamic")
def _(src):
    return _store(src).withColumn("s", vote.stability(6.0)).groupBy("role").agg(
        F.count("*").alias("cells"), F.sum("observed").alias("observed"), F.sum("n_static").alias("n_static"),
        F.sum("n_semi").alias("n_semi"), F.sum("n_dynamic").alias("n_dynamic"), F.avg("s").alias("mean_stability"))


@query("A25_cell_features", "points", f"""with {STORES},
    m as (select ln(1 + max(observed)) as m from gs where role = 'initial'),
    p as (select ix, iy, observed, n_static / observed as f2, n_semi / observed as f3, n_dynamic / observed as f4
          from gs where role = 'initial')
    select ix, iy, 1e0 as f0, ln(1 + observed) / greatest(m, 1) as f1, f2, f3, f4,
           (f2 + 5e-1 * f3) * (1 - exp(-observed / 6e0)) as f5,
           -(f2 * ln(greatest(f2, 1e-8)) + f3 * ln(greatest(f3, 1e-8)) + f4 * ln(greatest(f4, 1e-8))) / ln(3e0) as f6
    from p, m""", real="f0 f1 f2 f3 f4 f5 f6", whole="ix iy")
def _(src):
    return vote.cell_features(_store(src, "initial")).drop("observed", "n_static", "n_semi", "n_dynamic")


_TARGET = f"""{STORES},
    paired as (select a.ix, a.iy, a.observed as ao, a.n_static as a0, a.n_semi as a1, a.n_dynamic as a2,
             b.observed as bo, b.n_static as b0, b.n_semi as b1, b.n_dynamic as b2
             from gs a join gs b on a.ix = b.ix and a.iy = b.iy where a.role = 'initial' and b.role = 'crossday')"""
_TVAL = """(b0 + 5e-1 * b1) / greatest(bo, 1) * (1 - exp(-greatest(bo, 1) / 6e0))
    * (a0 * b0 + a1 * b1 + a2 * b2) / (greatest(ao, 1) * greatest(bo, 1))"""


@query("A26_future_target", "points", f"with {_TARGET} select ix, iy, {_TVAL} as target from paired", real="target",
       whole="ix iy")
def _(src):
    names = ("observed", "n_static", "n_semi", "n_dynamic")
    a = _store(src, "initial").select("ix", "iy", *[F.col(n).alias("a_" + n) for n in names])
    b = _store(src, "crossday").select("ix", "iy", *[F.col(n).alias("b_" + n) for n in names])
    return a.join(b, ["ix", "iy"]).select("ix", "iy", vote.future_target().alias("target"))


@query("J17_neighbourhood_patches", "points", f"""with {STORES},
    o as (select * from (select unnest([-1, 0, 1]) as ox) a, (select unnest([-1, 0, 1]) as oy) b),
    s as (select * from st where role = 'initial')
    select s.ix, s.iy, ox, oy, coalesce(n.stability, 0) as stability, coalesce(n.observed, 0) as observed
    from s cross join o left join s n on n.ix = s.ix + ox and n.iy = s.iy + oy""", real="stability observed",
       whole="ix iy ox oy")
def _(src):
    s = _store(src, "initial").select("ix", "iy", F.col("observed").cast("double").alias("observed"),
                                      vote.stability(6.0).alias("stability"))
    return vote.neighbourhood(s, s, 1, ["stability", "observed"])


@query("Q11_learning_table", "points", f"""with {STORES},
    u as (select ix, iy, sum(observed) as uo, sum(n_static) as u0, sum(n_semi) as u1, sum(n_dynamic) as u2
          from gs where role <> 'sameday' group by all),
    d as (select a.ix, a.iy, a.observed as ao, a.n_static as a0, a.n_semi as a1, a.n_dynamic as a2,
          greatest(uo - a.observed, 0) as bo, greatest(u0 - a.n_static, 0) as b0, greatest(u1 - a.n_semi, 0) as b1,
          greatest(u2 - a.n_dynamic, 0) as b2 from gs a join u on a.ix = u.ix and a.iy = u.iy
          where a.role = 'initial')
    select ix, iy, ao as observed, {_TVAL} as target,
           (a0 + 5e-1 * a1) / greatest(ao, 1) * (1 - exp(-greatest(ao, 1) / 6e0)) as heuristic, bo as gained,
           ((floor(ix / 8) + 3 * floor(iy / 8)) % 5 + 5) % 5 = 1 as validation
    from d where ao >= 2 and bo >= 2""", real="target heuristic", whole="ix iy gained")
def _(src):
    a = _store(src, "initial")
    return vote.learning_table(a, vote.merge_stores(a, _store(src, "crossday")), 2, 2).select(
        "ix", "iy", "observed", "target", "heuristic", "gained", "validation")


@query("A36_map_lookup", "points", f"""with {STORES}
    select s.ix, s.iy, observed as evidence, dominant_group, stability, coalesce(d.label, 0) as dominant_label
    from st s left join dl d on s.role = d.role and s.ix = d.ix and s.iy = d.iy where s.role = 'initial'""",
       real="stability", whole="ix iy dominant_group dominant_label")
def _(src):
    return vote.map_lookup(_store(src, "initial"), _labels(src, "initial"), 6.0)


@query("A36_label_probabilities", "points", f"""with {STORES}
    select ix, iy, label, n, n / sum(n) over (partition by ix, iy) as p from ls where role = 'initial'""", real="p",
       whole="ix iy label n")
def _(src):
    return vote.label_probabilities(_labels(src, "initial"))


@query("J7_cell_lookup", "points", f"""with {STORES}
    select p.sequence, p.frame_idx, count(*) as points, count(s.stability) as matched,
           coalesce(sum(s.stability), 0) as stability_sum
    from cp p left join (select * from st where role = 'initial') s on p.ix = s.ix and p.iy = s.iy group by all""",
       real="stability_sum", whole="sequence frame_idx")
def _(src):
    s = _store(src, "initial").select("ix", "iy", vote.stability(6.0).alias("stability"))
    return _cells(src).join(s, ["ix", "iy"], "left").groupBy(*FRAME).agg(
        F.count("*").alias("points"), F.count("stability").alias("matched"),
        F.coalesce(F.sum("stability"), F.lit(0.0)).alias("stability_sum"))


@query("J20_store_full_outer", "points", f"""with {STORES}
    select coalesce(a.ix, b.ix) as ix, coalesce(a.iy, b.iy) as iy, coalesce(a.observed, 0) as before_observed,
           coalesce(b.observed, 0) as after_observed
    from (select * from gs where role = 'initial') a full outer join (select * from gs where role = 'crossday') b
      on a.ix = b.ix and a.iy = b.iy""", whole="ix iy")
def _(src):
    a = _store(src, "initial").select("ix", "iy", F.col("observed").alias("before_observed"))
    b = _store(src, "crossday").select("ix", "iy", F.col("observed").alias("after_observed"))
    return a.join(b, ["ix", "iy"], "full_outer").select(
        "ix", "iy", F.coalesce("before_observed", F.lit(0)).alias("before_observed"),
        F.coalesce("after_observed", F.lit(0)).alias("after_observed"))


@query("U2_shared_cells", "points", f"""with {STORES}
    select ix, iy from gs where role = 'initial' intersect select ix, iy from gs where role = 'crossday'""",
       whole="ix iy")
def _(src):
    c = _cells(src)
    return c.where("role = 'initial' and grp >= 0").select("ix", "iy").intersect(
        c.where("role = 'crossday' and grp >= 0").select("ix", "iy"))


@query("U3_all_cells", "points", f"""with {STORES}
    select ix, iy from gs where role = 'initial' union select ix, iy from gs where role = 'crossday'""", whole="ix iy")
def _(src):
    c = _cells(src)
    return c.where("role = 'initial' and grp >= 0").select("ix", "iy").unionByName(
        c.where("role = 'crossday' and grp >= 0").select("ix", "iy")).distinct()


@query("U4_label_except", "points", """
    select distinct frame_idx, sequence, label from points where label in (5, 7, 9, 10, 11, 12)
    except select frame_idx, sequence, label from points where label in (12, 13, 14, 15)""",
       whole="sequence frame_idx label")
def _(src):
    p = src.points.select("frame_idx", "sequence", "label")
    return p.where(F.col("label").isin(*G.SEMI_DYNAMIC_LABELS, 12)).distinct().subtract(
        p.where(F.col("label").isin(*G.DYNAMIC_LABELS)))


_SAFETY = f"""{STORES},
    cells as (select c.ix, c.iy, c.label, c.support, f.label as future_label, m.observed as evidence, m.dominant_group,
              m.stability, coalesce(l.label, 0) as dominant_label
              from (select * from dl where role = 'sameday') c
              left join (select * from dl where role = 'crossday') f on c.ix = f.ix and c.iy = f.iy
              left join (select * from st where role = 'initial') m on c.ix = m.ix and c.iy = m.iy
              left join (select * from dl where role = 'initial') l on c.ix = l.ix and c.iy = l.iy),
    j as (select *, label in (1,2,4,6,8) as static_,
          case when future_label is not null then label in (1,2,4,6,8) and future_label = label end as ok from cells)"""
_REPORT = """select policy, count(*) filter (where acc) as accepted_cells, count(*) filter (where acc) / count(*) as coverage,
    count(ok) filter (where acc) as observed_cells, count(*) filter (where acc and ok) as confirmed_cells,
    count(*) filter (where acc and ok) / greatest(count(ok) filter (where acc), 1) as confirmation_rate,
    count(*) filter (where acc and not ok) / greatest(count(ok) filter (where acc), 1) as contradiction_rate
    from u group by policy"""


@query("Q1_update_safety", "points", f"""with {_SAFETY},
    k as (select *, coalesce(static_ and dominant_group = 0 and stability >= 3e-1 and evidence >= 3, false) as stable
          from j),
    u as (select 'naive' as policy, true as acc, ok from k union all select 'semantic_static', static_, ok from k
          union all select 'stable_static', stable, ok from k
          union all select 'persistent_label', stable and support >= 3 and dominant_label = label, ok from k)
    {_REPORT}""", real="coverage confirmation_rate contradiction_rate")
def _(src):
    lookup = vote.map_lookup(_store(src, "initial"), _labels(src, "initial"), 6.0)
    cells = policy.update_safety_cells(_labels(src, "sameday"), _labels(src, "crossday"), lookup, 3, 0.3, 3)
    return policy.safety_report(cells)


_STRUCT = f"""{_SAFETY},
    k as (select *, coalesce(static_ and dominant_label = label and stability >= 3e-1 and evidence >= 3
          and support >= 3, false) as known from j),
    u as (select 'naive' as policy, label, true as acc, ok from k union all select 'current_static', label, static_, ok from k
          union all select 'persistent_static', label, known, ok from k
          union all select 'structural_persistent', label, known and label in (1,4,6,8), ok from k)"""


def _structural(src):
    lookup = vote.map_lookup(_store(src, "initial"), _labels(src, "initial"), 6.0)
    return policy.structural_safety_cells(_labels(src, "sameday"), _labels(src, "crossday"), lookup, 3, 0.3, 3)


@query("Q2_structural_safety", "points", f"with {_STRUCT} {_REPORT}", real="coverage confirmation_rate contradiction_rate")
def _(src):
    return policy.safety_report(_structural(src))


@query("Q2_structural_by_label", "points", f"""with {_STRUCT}
    select policy, label, count(*) as observed_cells, count(*) filter (where ok) as confirmed_cells
    from u where acc and ok is not null group by all""", whole="label")
def _(src):
    return policy.safety_report(_structural(src), by_label=True)


# ---- masks -------------------------------------------------------------------------------------------------

RATIO_SETS = {"person": (13,), "dynamic": (12, 13, 14, 15), "movable": (5, 7, 9, 10, 11)}


@query("A13_label_ratios", "pixels poses", """
    with per as (select sequence, frame_idx, camera, avg((label = 13)::int) as person,
        avg((label in (12,13,14,15))::int) as dynamic, avg((label in (5,7,9,10,11))::int) as movable
        from pixels group by all),
    best as (select sequence, frame_idx, max(person) as person, max(dynamic) as dynamic, max(movable) as movable
             from per group by all)
    select sequence, frame_idx, coalesce(person, 0) as person, coalesce(dynamic, 0) as dynamic,
           coalesce(movable, 0) as movable from poses left join best using (sequence, frame_idx)""",
       real="person dynamic movable", whole="sequence frame_idx")
def _(src):
    return masks.label_ratios(src.pixels, src.poses, RATIO_SETS)


def _rig(src):
    left = P.pose_from_planar(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    right = P.pose_from_planar(F.lit(-0.5), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    rows = F.array(F.struct(F.lit("left").alias("camera"), left.alias("cam_pose")),
                   F.struct(F.lit("right").alias("camera"), right.alias("cam_pose")))
    c = src.cameras
    return c.select(*c.columns, F.inline(rows))


def _pix_sql(shift: str, name: str) -> str:
    return f"""
    n_{name} as (select p.*, (x - {shift}) / (z + 1) as xn, y / (z + 1) as yn, fx, fy, cx, cy, width, height, k1, k2, p1,
                 p2, k3 from points p join cameras c on p.sequence = c.sequence),
    r_{name} as (select *, xn * xn + yn * yn as r2 from n_{name}),
    d_{name} as (select *, 1 + r2 * (k1 + r2 * (k2 + r2 * k3)) as rad from r_{name}),
    e_{name} as (select sequence, frame_idx, point_idx, x, y, z, width, height,
                 round_even(fx * (xn * rad + 2 * p1 * xn * yn + p2 * (r2 + 2 * xn * xn)) + cx, 0) as u,
                 round_even(fy * (yn * rad + p1 * (r2 + 2 * yn * yn) + 2 * p2 * xn * yn) + cy, 0) as v from d_{name}),
    {name} as (select sequence, frame_idx, point_idx, x, y, z, case when u between 0 and width - 1
               and v between 0 and height - 1 then u end as u, case when u between 0 and width - 1
               and v between 0 and height - 1 then v end as v from e_{name})"""


_STEREO = f"""{_pix_sql('0e0', 'lp')}, {_pix_sql('5e-1', 'rp')}"""


@query("J10_pixel_labels", "points cameras pixels", f"""with {_pix_sql('0e0', 'lp')}
    select lp.sequence, lp.frame_idx, point_idx, x, y, z, label as label_left
    from lp left join (select * from pixels where camera = 'left') m
      on lp.sequence = m.sequence and lp.frame_idx = m.frame_idx and lp.u = m.u and lp.v = m.v""", real="x y z",
       whole="sequence frame_idx label_left")
def _(src):
    p = src.points.select("sequence", "frame_idx", "point_idx", "x", "y", "z")
    out = masks.with_lookup(masks.with_pixels(p, _rig(src), "left"), src.pixels, "left", {"label_left": "label"})
    return out.select("sequence", "frame_idx", "point_idx", "x", "y", "z", "label_left")


@query("J11_stereo_labels", "points cameras pixels", f"""with {_STEREO},
    l as (select lp.*, label from lp left join (select * from pixels where camera = 'left') m
          on lp.sequence = m.sequence and lp.frame_idx = m.frame_idx and lp.u = m.u and lp.v = m.v),
    r as (select rp.*, label from rp left join (select * from pixels where camera = 'right') m
          on rp.sequence = m.sequence and rp.frame_idx = m.frame_idx and rp.u = m.u and rp.v = m.v)
    select l.sequence, l.frame_idx, l.point_idx, l.x, coalesce(l.label, r.label, -1) as point_label
    from l join r on l.point_idx = r.point_idx and l.x = r.x and l.y = r.y and l.z = r.z""", real="x",
       whole="sequence frame_idx point_label")
def _(src):
    p = src.points.select("sequence", "frame_idx", "point_idx", "x", "y", "z")
    return masks.stereo_labels(p, src.pixels, _rig(src)).select("sequence", "frame_idx", "point_idx", "x", "point_label")


def _mask_sql(name: str, labels: str, radius: int) -> str:
    span = f"range({-radius}, {radius + 1})"
    return f"""{name} as (select distinct sequence, frame_idx, camera, u + du as u, v + dv as v from pixels,
        (select unnest({span}) as du) a, (select unnest({span}) as dv) b
        where label in ({labels}) and u + du between 0 and 31 and v + dv between 0 and 23)"""


def _hit_sql(mask: str) -> str:
    return " or ".join(f"""exists (select 1 from {mask} m where m.camera = '{cam}' and m.sequence = {t}.sequence
        and m.frame_idx = {t}.frame_idx and m.u = {t}.u and m.v = {t}.v)""" for cam, t in (("left", "lp"), ("right", "rp")))


_FLAGGED = f"""{_STEREO}, {_mask_sql('dm', '12,13,14,15', 1)}, {_mask_sql('sm', '5,7,9,10,11', 1)},
    fl as (select lp.sequence, lp.frame_idx, lp.point_idx, lp.x, {_hit_sql('dm')} as dynamic, {_hit_sql('sm')} as semi_f
           from lp join rp on lp.point_idx = rp.point_idx and lp.x = rp.x and lp.y = rp.y and lp.z = rp.z),
    dec as (select sequence, frame_idx, avg(semi_f::int) as semi_ratio from fl group by all)"""


def _flagged(src):
    p = src.points.select("sequence", "frame_idx", "point_idx", "x", "y", "z")
    m = masks.dilated(src.pixels, {"dynamic": G.DYNAMIC_LABELS, "semi": G.SEMI_DYNAMIC_LABELS}, 1, 32, 24)
    return masks.mask_hits(p, m, ["dynamic", "semi"], _rig(src))


@query("A14_exposure_trigger", "points cameras pixels", f"""with {_FLAGGED}
    select sequence, frame_idx, semi_ratio, semi_ratio >= 3e-1 as triggered from dec""", real="semi_ratio",
       whole="sequence frame_idx")
def _(src):
    return masks.exposure_decision(_flagged(src), 0.3)


@query("P31_effective_points", "points cameras pixels", f"""with {_FLAGGED}
    select fl.sequence, fl.frame_idx, point_idx, x from fl join dec using (sequence, frame_idx)
    where not dynamic and not (semi_f and semi_ratio >= 3e-1)""", real="x", whole="sequence frame_idx")
def _(src):
    fl = kept(_flagged(src).select("sequence", "frame_idx", "point_idx", "x", "dynamic", "semi"))
    return masks.query_points(fl, masks.exposure_decision(fl, 0.3)).select("sequence", "frame_idx", "point_idx", "x")


@query("P34_positive_repeat", "pixels", """
    with p as (select sequence, frame_idx, bool_or(label = 13) as positive from pixels group by all)
    select sequence, frame_idx, positive, n as copy from p, (select unnest([1, 2, 3]) as n) t where positive or n = 1""",
       whole="sequence frame_idx copy")
def _(src):
    p = src.pixels.groupBy(*FRAME).agg(F.bool_or(F.col("label") == 13).alias("positive"))
    return p.select(*FRAME, "positive", F.explode(F.sequence(F.lit(1), F.when(F.col("positive"), 3).otherwise(1))).alias("copy"))


@query("A30_mask_overlap", "pixels", """
    with per as (select camera, sequence, frame_idx, count(*) filter (where p and t) as tp,
        count(*) filter (where p and not t) as fp, count(*) filter (where not p and t) as fn
        from (select *, label in (12, 13, 14) as p, label in (13, 14, 15) as t from pixels) x group by all)
    select camera, sum(tp) / greatest(sum(tp + fp + fn), 1) as pixel_iou, sum(tp) / greatest(sum(tp + fn), 1) as pixel_recall,
           count(*) filter (where tp > 0) / greatest(count(*) filter (where tp + fn > 0), 1) as image_recall
    from per group by camera""", real="pixel_iou pixel_recall image_recall")
def _(src):
    px = src.pixels.withColumns({"p": F.col("label").isin(12, 13, 14), "t": F.col("label").isin(13, 14, 15)})
    return masks.mask_overlap(px, "p", "t", ["camera"])


@query("A24_connected_components", "pixels", """with recursive n as (select *, v * 1000000 + u as a from pixels where label in (9, 13, 14)),
    e as (select x.sequence, x.frame_idx, x.camera, x.a, y.a as b from n x join n y on x.sequence = y.sequence and x.frame_idx = y.frame_idx
          and x.camera = y.camera and x.label = y.label and abs(x.u - y.u) <= 1 and abs(x.v - y.v) <= 1),
    r as (select * from e union select r.sequence, r.frame_idx, r.camera, r.a, e.b from r join e on r.sequence = e.sequence
          and r.frame_idx = e.frame_idx and r.camera = e.camera and r.b = e.a),
    c as (select sequence, frame_idx, camera, a, min(b) as component from r group by all),
    p as (select n.*, component, depth between 2e-1 and 12e0 as ok from n join c using (sequence, frame_idx, camera, a))
    select sequence, frame_idx, camera, label, component, count(*) as pixel_area, min(u) as bbox_x, min(v) as bbox_y,
           max(u) - min(u) + 1 as bbox_width, max(v) - min(v) + 1 as bbox_height, avg(ok::int) as valid_depth_ratio,
           count(*) filter (where ok) as valid_depth_pixels, quantile_cont(depth, 5e-1) filter (where ok) as median_depth
    from p group by all having count(*) >= 2""", real="valid_depth_ratio median_depth",
       whole="sequence frame_idx label component bbox_x bbox_y bbox_width bbox_height")
def _(src):
    px = src.pixels.where(F.col("label").isin(9, 13, 14))
    return components.component_stats(components.connected_components(px), 2)


@query("A23_component_statistics", "pixels", """
    with v as (select *, depth between 2e-1 and 12e0 as ok from pixels)
    select sequence, frame_idx, camera, label, count(*) as pixel_area, min(u) as bbox_x, min(v) as bbox_y,
           max(u) - min(u) + 1 as bbox_width, max(v) - min(v) + 1 as bbox_height, avg(ok::int) as valid_depth_ratio,
           count(*) filter (where ok) as valid_depth_pixels, quantile_cont(depth, 5e-1) filter (where ok) as median_depth
    from v group by all having count(*) >= 4""", real="valid_depth_ratio median_depth",
       whole="sequence frame_idx label bbox_x bbox_y bbox_width bbox_height")
def _(src):
    px = src.pixels.withColumn("component", F.col("label"))
    return components.component_stats(px, 4).drop("component")


@query("A23_even_sampling", "pixels cameras", """
    with n as (select *, row_number() over w - 1 as i, count(*) over (partition by sequence, frame_idx, camera) as n
               from pixels window w as (partition by sequence, frame_idx, camera order by v, u)),
    j as (select distinct sequence, frame_idx, camera, cast(trunc(s * (n - 1) / 7e0) as bigint) as i
          from n, (select unnest(range(8)) as s) t where n > 8),
    kept as (select n.* from n left join j using (sequence, frame_idx, camera, i) where n.n <= 8 or j.i is not null),
    xyz as (select k.*, (u - cx) * depth / fx as x, (v - cy) * depth / fy as y, depth as z
            from kept k join cameras c on k.sequence = c.sequence)
    select sequence, frame_idx, camera, quantile_cont(x, 5e-1) as center_x, quantile_cont(y, 5e-1) as center_y,
           quantile_cont(z, 5e-1) as center_z,
           sqrt(pow(quantile_cont(x, 9e-1) - quantile_cont(x, 1e-1), 2) + pow(quantile_cont(y, 9e-1)
                - quantile_cont(y, 1e-1), 2) + pow(quantile_cont(z, 9e-1) - quantile_cont(z, 1e-1), 2)) as radial_extent
    from xyz group by all""", real="center_x center_y center_z radial_extent", whole="sequence frame_idx")
def _(src):
    from spoorgrid.functions.camera import unproject

    keys = ["sequence", "frame_idx", "camera"]
    s = components.evenly_spaced(src.pixels, keys, ["v", "u"], 8).join(src.cameras, "sequence")
    x, y, z = unproject("u", "v", "depth", "fx", "fy", "cx", "cy")
    return components.extent_stats(s.select(*keys, x.alias("x"), y.alias("y"), z.alias("z")), keys)


@query("A34_cross_view_support")
def _(src):
    px = src.pixels
    left = px.where((F.col("camera") == "left") & F.col("label").isin(13)).withColumn("component_id", F.col("label"))
    other = px.where(F.col("camera") == "right")
    shift = P.pose_from_planar(F.lit(-0.05), F.lit(0.0), F.lit(0.0))
    return masks.cross_view_support(left, other, src.cameras, shift, 13)


# ---- spatial joins -----------------------------------------------------------------------------------------

_T = f"(select *, bx0 + 4 as bx1, by1 - 4 as by0, bx0 + 2 as center_x, by1 - 2 as center_y from {_TILES} t)"


def _tiles(src):
    return pts.patch_tiles(src.points, 0.5, 4.0, 2.0)


@query("J3_covering_patches", "points poses", f"""
    select sequence, frame_idx, patch_id from poses join {_T} t on px * 5 between bx0 and bx1 and py * 9 between by0 and by1""",
       whole="sequence frame_idx patch_id")
def _(src):
    p = src.poses.select("sequence", "frame_idx", (F.col("px") * 5).alias("x"), (F.col("py") * 9).alias("y"))
    return spatial.points_in_boxes(p, _tiles(src), "x", "y", ["bx0", "bx1", "by0", "by1"], 4.0).select(
        "sequence", "frame_idx", "patch_id")


_TRUTH = f"""(select sequence, frame_idx, arg_min(patch_id, (not cov, d2, patch_id)) as patch_id, bool_or(cov) as covered
    from (select sequence, frame_idx, patch_id, px * 5 between bx0 and bx1 and py * 9 between by0 and by1 as cov,
          (center_x - px * 5) * (center_x - px * 5) + (center_y - py * 9) * (center_y - py * 9) as d2
          from poses, {_T} t) x group by all)"""


def _truth(src):
    p = src.poses.select("sequence", "frame_idx", (F.col("px") * 5).alias("x"), (F.col("py") * 9).alias("y"))
    return spatial.assign_patch(p, _tiles(src), FRAME, "x", "y", 4.0)


@query("J4_truth_patch", "points poses", f"select * from {_TRUTH} t", whole="sequence frame_idx patch_id")
def _(src):
    return _truth(src)


_NEG = f"""truth as (select * from {_TRUTH} t), tl as (select * from {_T} t), pc as (select count(*) as p from tl),
    band as (select a.patch_id as site, b.patch_id as other, row_number() over (partition by a.patch_id
             order by pow(a.center_x - b.center_x, 2) + pow(a.center_y - b.center_y, 2), b.patch_id) as rk
             from tl a join tl b on a.patch_id <> b.patch_id
              and sqrt(pow(a.center_x - b.center_x, 2) + pow(a.center_y - b.center_y, 2)) between 2e0 and 5e0),
    hard as (select sequence, frame_idx, patch_id, other, rk from truth join band on patch_id = site where rk <= 3),
    walk as (select sequence, frame_idx, t.patch_id, j, ((cast(frame_idx as bigint) * 10 + sequence) * 1103515245 + 12345
             + cast(j as bigint) * 2147483647) % p as w from truth t, pc, (select unnest(range(6)) as j) jj),
    fresh as (select sequence, frame_idx, patch_id, w, row_number() over (partition by sequence, frame_idx order by j) as rk
              from walk where w <> patch_id and not exists (select 1 from hard h where h.sequence = walk.sequence
              and h.frame_idx = walk.frame_idx and h.other = walk.w))
    select sequence, frame_idx, patch_id, rk - 1 as slot, other as negative_id from hard
    union all select sequence, frame_idx, patch_id, 3 + rk - 1, w from fresh where rk <= 2"""


def _negatives(src):
    seed = F.col("frame_idx").cast("bigint") * 10 + F.col("sequence")
    return spatial.negative_patches(_truth(src), _tiles(src), FRAME, "patch_id", seed, 2.0, 5.0, 3, 2, 5)


@query("J5_negative_patches", "points poses", f"with {_NEG}", whole="sequence frame_idx patch_id slot negative_id")
def _(src):
    return _negatives(src)


@query("P33_training_samples", "points poses", f"""with t0 as (select 1), neg as (with {_NEG})
    select n.sequence, n.frame_idx, n.patch_id, slot, negative_id, px * 5 - center_x as target_dx,
           py * 9 - center_y as target_dy, yaw as target_yaw, n.frame_idx * 10 + n.sequence as seed
    from neg n join poses p on n.sequence = p.sequence and n.frame_idx = p.frame_idx
         join {_T} t on t.patch_id = n.patch_id""", real="target_dx target_dy target_yaw",
       whole="sequence frame_idx patch_id slot negative_id seed")
def _(src):
    t = _tiles(src).select("patch_id", "center_x", "center_y")
    p = src.poses.select("sequence", "frame_idx", "px", "py", "yaw")
    out = _negatives(src).join(p, FRAME).join(t, "patch_id")
    return out.select(*FRAME, "patch_id", "slot", "negative_id", (F.col("px") * 5 - F.col("center_x")).alias("target_dx"),
                      (F.col("py") * 9 - F.col("center_y")).alias("target_dy"), F.col("yaw").alias("target_yaw"),
                      (F.col("frame_idx") * 10 + F.col("sequence")).alias("seed"))


@query("J8_radius_stability", "points poses", f"""with {STORES},
    c as (select ix + 5e-1 as cx, iy + 5e-1 as cy, observed, stability from st where role = 'initial')
    select sequence, frame_idx, count(*) as cells, sum(observed * stability) / sum(observed) as local_stability
    from poses join c on (px * 5 - cx) * (px * 5 - cx) + (py * 5 - cy) * (py * 5 - cy) <= 4 group by all""",
       real="local_stability", whole="sequence frame_idx")
def _(src):
    c = _store(src, "initial").select((F.col("ix") + 0.5).alias("cx"), (F.col("iy") + 0.5).alias("cy"), "observed",
                                      vote.stability(6.0).alias("stability"))
    p = src.poses.select("sequence", "frame_idx", (F.col("px") * 5).alias("x"), (F.col("py") * 5).alias("y"))
    return spatial.within_radius(p, c, "x", "y", "cx", "cy", 2.0).groupBy(*FRAME).agg(
        F.count("*").alias("cells"),
        (F.sum(F.col("observed") * F.col("stability")) / F.sum("observed")).alias("local_stability"))


@query("J14_nearest_map_point", "points map_points", """
    with d as (select p.sequence, p.frame_idx, p.point_idx, p.x, m.point_idx as target_idx, (p.x - m.x) * (p.x - m.x)
               + (p.y - m.y) * (p.y - m.y) + (p.z - m.z) * (p.z - m.z) as d2 from points p join map_points m
               on abs(p.x - m.x) <= 8e-1 and abs(p.y - m.y) <= 8e-1)
    select sequence, frame_idx, point_idx, x, min(d2) as d2 from d where d2 <= 8e-1 * 8e-1 group by all""", real="x d2",
       whole="sequence frame_idx")
def _(src):
    q = src.points.select("sequence", "frame_idx", "point_idx", "x", "y", "z")
    t = src.map_points.select(F.col("point_idx").alias("target_idx"), F.col("x").alias("tx"), F.col("y").alias("ty"),
                              F.col("z").alias("tz"))
    return spatial.nearest_within(q, t, ["sequence", "frame_idx", "point_idx", "x", "y", "z"], ["target_idx"], 0.8).select(
        "sequence", "frame_idx", "point_idx", "x", "d2")


@query("J18_local_submap", "points map_points", f"""
    select patch_id, point_idx, x - center_x as lx, y - center_y as ly, z from {_T} t join map_points m
    on x between center_x - 3 and center_x + 3 and y between center_y - 3 and center_y + 3""", real="lx ly z",
       whole="patch_id")
def _(src):
    return registration.local_submap(src.map_points, _tiles(src), "patch_id", 6.0).select(
        "patch_id", "point_idx", "lx", "ly", "z")


@query("W23_patch_layout", "points", f"""
    select patch_id, dense_rank() over (order by round(center_y, 6) desc) - 1 as layout_row,
           dense_rank() over (order by round(center_x, 6)) - 1 as layout_col from {_T} t""",
       whole="patch_id layout_row layout_col")
def _(src):
    from spoorgrid.operators.sequence import patch_layout

    return patch_layout(_tiles(src))


@query("W24_channel_normalise", "points", """
    with g as (select floor(x) as ix, floor(y) as iy, count(*) as cnt from points group by all)
    select ix, iy, cast(trunc(greatest(least((cnt - (select min(cnt) from g)) * 255e0
           / ((select max(cnt) from g) - (select min(cnt) from g)), 255), 0)) as int) as grey from g""", whole="ix iy grey")
def _(src):
    from spoorgrid.operators.sequence import normalise_channel

    g = _cells(src).groupBy("ix", "iy").agg(F.count("*").cast("double").alias("cnt"))
    return normalise_channel(g, "cnt", "grey").drop("cnt")


@query("A21_planar_fit", "points", """
    with p as (select sequence, frame_idx, x, y, z, cos(3e-1) * x - sin(3e-1) * y + 1 + z / 10 as tx,
               sin(3e-1) * x + cos(3e-1) * y - 2 as ty, z + 5e-1 as tz from points),
    s as (select sequence, frame_idx, avg(x) as mx, avg(y) as my, avg(tx) as nx, avg(ty) as ny, avg(tz - z) as dz,
          sum(x * tx + y * ty) - count(*) * (avg(x) * avg(tx) + avg(y) * avg(ty)) as dot,
          sum(x * ty - y * tx) - count(*) * (avg(x) * avg(ty) - avg(y) * avg(tx)) as crs, count(*) as n from p group by all)
    select sequence, frame_idx, n, atan2(crs, dot) as yaw, nx - (cos(atan2(crs, dot)) * mx - sin(atan2(crs, dot)) * my) as dx,
           ny - (sin(atan2(crs, dot)) * mx + cos(atan2(crs, dot)) * my) as dy, dz from s""",
       real="yaw dx dy dz", whole="sequence frame_idx")
def _(src):
    rx, ry = P.rotate_xy("x", "y", F.lit(0.3))
    p = src.points.select(*FRAME, "x", "y", "z", (rx + 1 + F.col("z") / 10).alias("tx"), (ry - 2).alias("ty"),
                          (F.col("z") + 0.5).alias("tz"))
    return registration.planar_fit(p, FRAME).drop("rmse")


@query("A22_batch_registration")
def _(src):
    poses = src.poses.select(*FRAME, P.pose_from_planar(F.lit(0.2), F.lit(-0.1), F.lit(0.02)).alias("pose"))
    out = registration.register(src.points.select(*FRAME, "point_idx", "x", "y", "z"), src.map_points, poses, FRAME,
                                0.3, 3, 1.0, 12)
    return out.select(*FRAME, P.pose_x("pose").alias("x"), P.pose_y("pose").alias("y"), P.pose_yaw("pose").alias("yaw"),
                      "inliers", "inlier_ratio", "rmse", "converged", "iterations")


@query("J22_raster_correlation", "points map_points", """
    with q as (select distinct sequence, frame_idx, cast(floor(y + 10) as int) as r, cast(floor(x + 10) as int) as c
               from points where x >= -10 and x < 10 and y >= -10 and y < 10),
    s as (select distinct cast(floor(y + 12) as int) as r, cast(floor(x + 12) as int) as c from map_points
          where x >= -12 and x < 12 and y >= -12 and y < 12),
    sh as (select * from (select unnest(range(5)) as dr) a, (select unnest(range(5)) as dc) b),
    qn as (select sequence, frame_idx, count(*) as q1 from q group by all),
    sn as (select dr, dc, count(*) as s1 from s, sh where r >= dr and r < dr + 20 and c >= dc and c < dc + 20 group by all),
    qs as (select sequence, frame_idx, dr, dc, count(*) as qs from q join sh on true join s on s.r = q.r + dr
           and s.c = q.c + dc group by all),
    e as (select sequence, frame_idx, dr, dc, round((coalesce(qs, 0) - q1 * coalesce(s1, 0) / 400e0)
          / sqrt((q1 - q1 * q1 / 400e0) * (s1 - s1 * s1 / 400e0)), 9) as score
          from qn join sh on true left join qs using (sequence, frame_idx, dr, dc) left join sn using (dr, dc))
    select sequence, frame_idx, max(score) as score, arg_max(dr, (score, -dr, -dc)) as top,
           arg_max(dc, (score, -dr, -dc)) as left_ from e group by all""", real="score",
       whole="sequence frame_idx top left_")
def _(src):
    q = src.points.select(*FRAME, F.lit(0).alias("patch_id"), F.floor(F.col("y") + 10).cast("int").alias("row"),
                          F.floor(F.col("x") + 10).cast("int").alias("col"))
    q = q.where(F.col("row").between(0, 19) & F.col("col").between(0, 19)).distinct().withColumn("val", F.lit(1.0))
    s = src.map_points.select(F.lit(0).alias("patch_id"), F.floor(F.col("y") + 12).cast("int").alias("row"),
                              F.floor(F.col("x") + 12).cast("int").alias("col"))
    s = s.where(F.col("row").between(0, 23) & F.col("col").between(0, 23)).distinct().withColumn("val", F.lit(1.0))
    out = registration.raster_correlation(q, FRAME, s, ["patch_id"], (20, 20), (24, 24))
    return out.drop("patch_id").withColumnRenamed("left", "left_")
