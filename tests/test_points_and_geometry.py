import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from spoorgrid.functions import camera, cells, pose
from spoorgrid.operators import points as pts
from spoorgrid.operators import registration, spatial


def test_grid_raster_rows_run_from_the_top(spark):
    p = spark.createDataFrame([(0, -9.95, -9.95, 1.0), (0, -9.95, -9.95, 3.0), (0, 9.95, 9.95, 2.0), (0, 10.0, 0.0, 9.0)], "f int, x double, y double, z double")
    got = rows(pts.grid_raster(p, ["f"], (-10, 10, -10, 10), 0.1).select("row", "col", "cnt", "max_h", "mean_h"), "row")
    assert got == [(0, 199, 1, 2.0, 2.0), (199, 0, 2, 3.0, 2.0)]


def test_crop_is_inclusive_and_drops_non_finite(spark):
    nan, inf = float("nan"), float("inf")
    p = spark.createDataFrame([(10.0, 0.0, 0.0), (10.01, 0.0, 0.0), (nan, 0.0, 0.0), (0.0, inf, 0.0), (-10.0, 1.0, 1.0)], "x double, y double, z double")
    assert rows(pts.crop(p, (-10, 10), (-5, 5), (0, 1)), "x") == [(-10.0, 1.0, 1.0), (10.0, 0.0, 0.0)]


def test_pose_round_trip_and_zero_quaternion(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 0.1, -0.2, 0.3, 0.9)], "px double, py double, pz double, qx double, qy double, qz double, qw double")
    m = df.select(pose.pose_from_quaternion("px", "py", "pz", "qx", "qy", "qz", "qw").alias("m"))
    out = m.select(pose.compose("m", pose.invert(F.col("m"))).alias("i")).first().i
    assert np.allclose(out, pose.IDENTITY)
    bad = spark.range(1).select(pose.pose_from_quaternion(*[F.lit(0.0)] * 7).alias("m"))
    with pytest.raises(Exception, match="zero norm"):
        bad.collect()


def test_wrap_to_pi(spark):
    df = spark.createDataFrame([(math.pi,), (-math.pi,), (3.5 * math.pi,)], "a double")
    got = [r[0] for r in df.select(pose.wrap_to_pi("a")).collect()]
    assert np.allclose(got, [-math.pi, -math.pi, -0.5 * math.pi])


def test_undistort_inverts_distortion(spark):
    df = spark.createDataFrame([(0.1, -0.2, 1.0)], "x double, y double, z double")
    d = [F.lit(v) for v in (0.05, -0.01, 0.001, -0.001, 0.0)]
    k = [F.lit(v) for v in (100.0, 110.0, 50.0, 40.0)]
    u, v = camera.project_distorted("x", "y", "z", *k, d)
    out = camera.undistorted_columns(df.select(u.alias("u"), v.alias("v")), "u", "v", *k, d, 8).first()
    assert abs(out.un - 0.1) < 1e-6 and abs(out.vn + 0.2) < 1e-6


def test_voxel_keeps_first_point(spark):
    p = spark.createDataFrame([(2, 0.1, 0.1, 0.1), (1, 0.2, 0.2, 0.2), (3, 1.5, 0.0, 0.0)], "point_idx int, x double, y double, z double")
    assert [r.point_idx for r in pts.voxel_first(p, [], 1.0, "point_idx").orderBy("point_idx").collect()] == [1, 3]


def test_patch_tiles_reject_small_rasters(spark):
    p = spark.createDataFrame([(0.0, 0.0, 0.0), (1.0, 1.0, 0.0)], "x double, y double, z double")
    with pytest.raises(Exception, match="patch larger"):
        pts.patch_tiles(p, 0.5, 40.0, 2.0).collect()


def test_search_grids():
    assert pts.search_angles(90.0) == [0.0, 90.0, 180.0, 270.0]
    assert pts.yaw_offsets(2.0, 1.0) == [-2.0, -1.0, 0.0, 1.0, 2.0]
    with pytest.raises(ValueError):
        pts.search_angles(0.0)


def test_packed_cell_and_block_split(spark):
    df = spark.createDataFrame([(0, 0), (-1, -1), (10, 0)], "ix int, iy int")
    got = rows(df.select("ix", cells.packed_cell("ix", "iy").alias("k"), cells.spatial_block_is_validation("ix", "iy").alias("v")), "ix")
    for ix, k, v in got:
        iy = {0: 0, -1: -1, 10: 0}[ix]
        assert k == (ix + 100000) * 1000000 + iy + 100000
        assert v == ((ix // 8 + 3 * (iy // 8)) % 5 == 1)


def test_registration_recovers_a_translation(spark):
    rng = np.random.default_rng(1)
    world = rng.uniform(-5, 5, (300, 3)) * [1, 1, 0.2]
    t = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(world)], "point_idx int, x double, y double, z double")
    q = spark.createDataFrame([(k, i, *map(float, p - [0.2, -0.1, 0])) for k in (1, 2) for i, p in enumerate(world)],
                              "k int, point_idx int, x double, y double, z double")
    start = spark.createDataFrame([(1,), (2,)], "k int").withColumn("pose", F.array(*[F.lit(v) for v in pose.IDENTITY]))
    out = registration.register(q, t, start, ["k"], voxel=0.01, max_iterations=15, cutoff=1.0).orderBy("k").collect()
    for r in out:
        assert r.converged and abs(r.pose[3] - 0.2) < 1e-3 and abs(r.pose[7] + 0.1) < 1e-3 and r.rmse < 1e-2


def test_nearest_within_dense_targets_ties_and_odd_keys(spark):
    rng = np.random.default_rng(3)
    world = np.round(rng.uniform(0, 1.5, (1500, 3)), 2)
    at = np.round(np.vstack([rng.uniform(0.3, 1.2, (60, 3)), rng.uniform(-1, 2.5, (6, 3))]), 2)
    t = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(np.vstack([world, world[:50]]))], "target_idx int, tx double, ty double, tz double")
    points = [(i, "r", *map(float, p)) for i, p in enumerate(at)] + [(0, "s", *map(float, at[1])), (None, "r", 0.5, 0.5, 0.5), (70, "r", None, 0.5, 0.5)]
    q = spark.createDataFrame(points, "k int, tag string, x double, y double, z double")
    want = {}
    for k, tag, *p in points:
        if k is None or None in p:
            continue
        d2 = [(p[0] - w[0]) ** 2 + (p[1] - w[1]) ** 2 + (p[2] - w[2]) ** 2 for w in world.tolist()]
        if min(d2) <= 1.0:
            want[k] = min(want.get(k, (9.0, 0, "")), (min(d2), d2.index(min(d2)), tag))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = spatial.nearest_within(q, t, ["k"], ["target_idx"], 1.0)
        got = {r.k: (r.d2, r.target_idx, r.tag) for r in out.collect()}

        def made(plan) -> int:
            own = plan.metrics().apply("numOutputRows").value() if plan.nodeName().endswith("Join") else 0
            below = plan.children()
            return own + sum(made(below.apply(i)) for i in range(below.size()))

        pairs = made(out._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert set(got) == set(want) and all(abs(got[k][0] - want[k][0]) < 1e-12 and got[k][1:] == want[k][1:] for k in want)
    near = sum(sum((p[0] - w[0]) ** 2 + (p[1] - w[1]) ** 2 + (p[2] - w[2]) ** 2 <= 1.0 for w in world.tolist()) for p in at.tolist())
    assert pairs < near / 2  # not all targets within the cut-off


@pytest.mark.parametrize("rows", [500_000, 40])
def test_nearest_within_large_target_meets_points_in_blocks(spark, monkeypatch, rows):
    monkeypatch.setattr(spatial, "SMALL_TARGETS", 0, raising=False)
    monkeypatch.setattr(spatial, "BLOCK_ROWS", rows, raising=False)  # at 40, blocks are dealt to lanes and parts
    rng = np.random.default_rng(11)
    world = np.round(rng.normal(0, 1.2, (400, 3)), 1)  # many ties
    at = np.round(rng.normal(0, 1.5, (300, 3)), 1)
    t = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(world)], "target_idx int, tx double, ty double, tz double")
    q = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)] + [(0, *map(float, at[0]))], "k int, x double, y double, z double")
    want = {}
    for k, p in enumerate(at.tolist()):
        d2 = [(p[0] - w[0]) ** 2 + (p[1] - w[1]) ** 2 + (p[2] - w[2]) ** 2 for w in world.tolist()]
        if min(d2) <= 0.25:
            want[k] = (min(d2), d2.index(min(d2)))
    out = spatial.nearest_within(q, t, ["k", "x", "y", "z"], ["target_idx"], 0.5)
    got = out.collect()
    assert len(got) == len(want) and all(abs(r.d2 - want[r.k][0]) < 1e-12 and r.target_idx == want[r.k][1] for r in got)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" in plan and (rows < 500_000 or "Join" not in plan)  # copies of the targets are never broadcast
