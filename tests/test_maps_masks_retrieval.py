from unittest import mock

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import rows
from spoorgrid import session
from spoorgrid.operators import compare, components, masks, metrics, policy, pruned, retrieval, spatial, vote
from spoorgrid.functions import pose as P
from spoorgrid.plans import catalog_maps
from spoorgrid.plans.catalog import REGISTRY


def test_two_stage_vote_counts_frames_not_points(spark):
    pts = [(0, 0, 1)] * 5 + [(0, 0, 13)] * 2 + [(1, 0, 13)] * 9 + [(2, 0, 1), (2, 0, 13)]
    df = vote.with_groups(spark.createDataFrame(pts, "frame_idx int, ix int, label int").withColumn("iy", F.lit(0)))
    assert rows(vote.group_store(df, [], ["frame_idx"])) == [(0, 0, 3, 2, 0, 1)]  # the tie in frame 2 goes to the lower id


def test_reliability_target_prefers_stable_cells(spark):
    df = spark.createDataFrame([(10, 10, 0, 0, 10, 10, 0, 0), (10, 0, 0, 10, 10, 0, 0, 10)],
                               "a_observed int, a_n_static int, a_n_semi int, a_n_dynamic int, b_observed int, b_n_static int, b_n_semi int, b_n_dynamic int")
    a, b = [r[0] for r in df.select(vote.future_target()).collect()]
    assert a > 0.7 and a > b


def test_feature_patches(spark):
    s = spark.createDataFrame([(0, 0, 5, 5, 0, 0), (1, 0, 5, 0, 5, 0), (10, 0, 5, 0, 0, 5)], "ix int, iy int, observed int, n_static int, n_semi int, n_dynamic int")
    got = vote.feature_patches(s.select("ix", "iy"), vote.cell_features(s), 1).orderBy("ix").collect()
    assert len(got) == 3 and all(len(r.features) == 63 for r in got)
    assert got[0].features[4] == 1.0 and got[0].features[7] == 1.0 and got[2].features[7] == 0.0


def test_structural_admission(spark):
    cur = spark.createDataFrame([(i, 0, lab, 4) for i, lab in enumerate((6, 7, 13))], "ix int, iy int, label int, n int")
    look = spark.createDataFrame([(i, 0, 6, 0, 0.9, lab) for i, lab in enumerate((6, 7, 13))],
                                 "ix int, iy int, evidence int, dominant_group int, stability double, dominant_label int")
    out = policy.structural_safety_cells(cur, cur, look, 3, 0.7, 3)
    assert [r.label for r in out.where("policy = 'structural_persistent' and accepted").collect()] == [6]


def test_components_match_a_flood_fill(spark):
    rng = np.random.default_rng(0)
    px = [(0, f, "left", int(u), int(v), int(lab)) for f in (0, 1) for v in range(14) for u in range(14)
          if (lab := rng.choice([0, 13, 14], p=[0.5, 0.3, 0.2]))]
    df = spark.createDataFrame(px, "sequence int, frame_idx int, camera string, u int, v int, label int")
    got = {}
    for r in components.connected_components(df).collect():
        got.setdefault((r.frame_idx, r.component), set()).add((r.u, r.v))
    want = []
    left = {(f, u, v): lab for _, f, _, u, v, lab in px}
    while left:
        (f, u, v), lab = next(iter(left.items()))
        stack, comp = [(u, v)], set()
        while stack:
            a, b = stack.pop()
            if left.get((f, a, b)) == lab:
                del left[(f, a, b)]
                comp.add((a, b))
                stack += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        want.append((f, frozenset(comp)))
    assert sorted((f, sorted(c)) for (f, _), c in got.items()) == sorted((f, sorted(c)) for f, c in want)


@pytest.mark.parametrize("n,limit", [(5, 8), (23, 8), (9, 8), (8, 8)])
def test_even_sampling_equals_truncated_linspace(spark, n, limit):
    df = spark.createDataFrame([(0, i) for i in range(n)], "k int, i int")
    got = [r.i for r in components.evenly_spaced(df, ["k"], ["i"], limit).orderBy("i").collect()]
    want = sorted(set(np.linspace(0, n - 1, limit).astype(int))) if n > limit else list(range(n))
    assert got == [int(w) for w in want]


def _rig(spark):
    d = [0.0] * 5
    c = spark.createDataFrame([(0, cam, 10.0, 10.0, 5.0, 5.0, 10, 10, *d) for cam in ("left", "right")],
                              "sequence int, camera string, fx double, fy double, cx double, cy double, width int, height int, k1 double, k2 double, p1 double, p2 double, k3 double")
    return c.withColumn("cam_pose", P.pose_from_planar(F.lit(0.0), F.lit(0.0), F.lit(0.0)))


def test_dynamic_filter_and_trigger(spark):
    pts = spark.createDataFrame([(0, 0, i, x, 0.0, z) for i, (x, z) in enumerate([(0.0, 1.0), (0.2, 1.0), (-0.2, 1.0), (0.0, -1.0)])],
                                "sequence int, frame_idx int, point_idx int, x double, y double, z double")
    px = spark.createDataFrame([(0, 0, "left", 5, 5, 13), (0, 0, "right", 7, 5, 9)], "sequence int, frame_idx int, camera string, u int, v int, label int")
    fl = masks.mask_hits(pts, masks.dilated(px, {"dynamic": (13,), "semi": (9,)}, 0, 10, 10), ["dynamic", "semi"], _rig(spark))
    assert rows(fl.select("point_idx", "dynamic", "semi"), "point_idx") == [(0, True, False), (1, False, True), (2, False, False), (3, False, False)]
    for limit, kept in ((0.25, [2, 3]), (0.26, [1, 2, 3])):
        d = masks.exposure_decision(fl, limit)
        assert [r.point_idx for r in masks.query_points(fl, d).orderBy("point_idx").collect()] == kept
    lab = masks.stereo_labels(pts, px, _rig(spark)).orderBy("point_idx").collect()
    assert [r.point_label for r in lab] == [13, 9, -1, -1]
    assert masks.dilated(px, {"dynamic": (13,)}, 1, 10, 10).count() == 9


def test_cross_view_support(spark):
    px = spark.createDataFrame([(0, 0, 1, 5, 5, 1.0), (0, 0, 1, 6, 5, 1.0), (0, 0, 2, 5, 5, None)], "sequence int, frame_idx int, component_id int, u int, v int, depth double")
    other = spark.createDataFrame([(0, 0, 5, 5, 13), (0, 0, 6, 5, 1)], "sequence int, frame_idx int, u int, v int, label int")
    got = rows(masks.cross_view_support(px, other, _rig(spark).where("camera = 'left'").drop("camera", "cam_pose"),
                                        P.pose_from_planar(F.lit(0.0), F.lit(0.0), F.lit(0.0)), 13).select("component_id", "support"), "component_id")
    assert got == [(1, 0.5), (2, None)]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 8))
    v[7] = v[3]  # an exact copy, so that ties occur
    bank = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "item long, bvec array<double>")
    return v, bank


@pytest.mark.parametrize("block", [5, 1000])
def test_block_retrieval_equals_brute_force(vectors, block):
    v, bank = vectors
    q = bank.select(F.col("item").alias("qid"), F.col("bvec").alias("qvec"))
    s = np.round(v @ v.T, 12)
    got = {}
    for r in retrieval.top_k(q, bank, 4, block_rows=block).collect():
        got.setdefault(r.qid, {})[r["rank"]] = r.item
    for i in range(60):
        want = sorted((j for j in range(60) if j != i), key=lambda j: (-s[i, j], j))[:4]
        assert [got[i][k] for k in (1, 2, 3, 4)] == want
    m = {r.qid: r for r in retrieval.score_moments(q, bank, block_rows=block).collect()}
    others = np.delete(s[5], 5)
    assert m[5].n == 59 and abs(m[5]["mean"][0] - others.mean()) < 1e-9 and abs(m[5]["std"][0] - others.std()) < 1e-9
    ranks = {r.qid: r.truth_rank for r in retrieval.truth_rank(q.withColumn("truth", F.pmod(F.col("qid") + 1, F.lit(60))), bank, block_rows=block).collect()}
    for i in range(60):
        t = (i + 1) % 60
        assert ranks[i] == 1 + sum(1 for j in range(60) if j not in (i, t) and (s[i, j], -j) > (s[i, t], -t))


def test_retrieval_of_clusters_reads_few_blocks_and_stays_exact(spark):
    rng = np.random.default_rng(11)
    centres = 10.0 * rng.normal(size=(12, 6))
    v = centres[rng.integers(0, 12, 900)] + 0.05 * rng.normal(size=(900, 6))
    v /= np.linalg.norm(v, axis=1)[:, None]
    v[::3] = v[0]  # a third of all rows is one vector
    bank = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(900, None)], "item long, bvec array<double>")
    placed, cells = pruned.cells_of(bank, 40)
    assert cells.rows.sum() == 900 and placed.count() == 900
    assert placed.groupBy("cell", "part").count().agg(F.max("count")).first()[0] <= 80  # copies are spread over blocks
    up = cells.upper(v[:, None, :])
    where = {r.item: r.cell for r in placed.collect()}
    s = np.round(v @ v.T, 12)
    assert all(s[i, j] <= up[i, where[j]] for i in range(0, 900, 7) for j in range(900))
    q = bank.where("item % 10 = 1").select(F.col("item").alias("qid"), F.col("bvec").alias("qvec"))
    got = {}
    for r in retrieval.top_k(q, bank, 5, block_rows=40).collect():
        got.setdefault(r.qid, {})[r["rank"]] = (r.item, r.score)
    for i in range(1, 900, 10):
        want = sorted((j for j in range(900) if j != i), key=lambda j: (-s[i, j], j))[:5]
        assert [s[i, got[i][n][0]] for n in range(1, 6)] == pytest.approx([s[i, j] for j in want], abs=1e-11)
    lone = q.where("qid % 3 <> 0").withColumn("threshold", F.lit(0.95))
    visited = pruned._visits(lone, cells, 1, 2, None)
    assert visited.count() < 0.5 * lone.count() * cells.parts.sum()
    asked = q.where("qid % 30 = 11").withColumn("truth", F.col("qid") + 1)
    for r in retrieval.truth_rank(asked, bank, block_rows=40).collect():
        i, t = r.qid, r.qid + 1
        assert r.truth_rank == 1 + sum(1 for j in range(900) if j not in (i, t) and (s[i, j], -j) > (s[i, t], -t))


def test_large_inputs_get_more_tasks_with_the_same_rows(spark):
    """Before, the session's number of shuffle partitions held whatever the size, so the memory of a task grew with the tables."""
    rng = np.random.default_rng(8)
    px = spark.createDataFrame([(0, f, c, int(u), int(v), int(k)) for f in range(6) for c in ("left", "right") for u, v, k in {(u, v): (u, v, k) for u, v, k in rng.integers(0, 16, (40, 3))}.values()],
                               "sequence int, frame_idx int, camera string, u int, v int, label int")
    pts = spark.createDataFrame([(0, i % 6, i, *map(float, rng.normal(size=2)), 3.0, int(rng.integers(1, 12))) for i in range(300)],
                                "sequence int, frame_idx int, point_idx long, x double, y double, z double, label int")
    cams = spark.createDataFrame([(0, c, 8.0, 8.0, 8.0, 8.0, 16, 16, 0.0, 0.0, 0.0, 0.0, 0.0) for c in ("left", "right")],
                                 "sequence int, camera string, fx double, fy double, cx double, cy double, width int, height int, k1 double, k2 double, p1 double, p2 double, k3 double")
    cams = cams.withColumn("cam_pose", P.pose_from_planar(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    cand = spark.createDataFrame([(0, f, c, 0.4 * c, 0.1, 0.2 * c) for f in range(6) for c in range(2)], "sequence int, frame_idx int, cand int, x double, y double, yaw double")
    share = spark.createDataFrame([(x, y, k, 0.1 * k) for x in (-1, 0) for y in (-1, 0, 1) for k in (1, 2, 5)], "ix long, iy long, label int, p double")
    stable = spark.createDataFrame([(x, 0, 0.5) for x in (-1, 0)], "ix long, iy long, stability double")

    def found():
        hits = masks.mask_hits(pts.drop("label"), masks.dilated(px, {"dynamic": (12, 13), "semi": (5, 7)}, 1, 16, 16), ["dynamic", "semi"], cams)
        scores = compare.semantic_candidate_scores(pts, cand, share, stable, 1.0).select("sequence", "frame_idx", "cand", F.round("semantic_score", 9), F.round("semantic_coverage", 9), "semantic_points")
        return hits, rows(hits, "point_idx"), scores, rows(scores, "frame_idx", "cand")

    few = found()
    with mock.patch.object(session, "ROWS_A_TASK", 20):
        many = found()
    assert few[1] == many[1] and few[3] == many[3] and any(r[-1] for r in few[1]) and any(r[-1] for r in few[3])
    plans = [few[i]._jdf.queryExecution().optimizedPlan().toString() + many[i]._jdf.queryExecution().optimizedPlan().toString() for i in (0, 2)]
    assert all("RepartitionByExpression" in p and ", 15" in p for p in plans)


def test_totals_of_time_windows_equal_pairs(spark):
    """Without totals the work grows with the square of the density; times repeat, meet the bounds, and some are missing."""
    rng = np.random.default_rng(4)
    at = [float(t) for t in rng.integers(-300, 300, 240)] + [None, 3.5, 3.5]
    left = spark.createDataFrame([(i % 3 if i % 50 else None, i, t) for i, t in enumerate(at)], "k int, id int, t double")
    right = left.select("k", F.col("t").alias("u"), F.when(F.col("id") % 5 > 0, F.col("id") * 0.25).alias("g"), F.col("id").alias("sample"))
    for before, after in ((20.0, 20.0), (0.0, 7.0), (90.0, 10.0)):
        pairs = spatial.in_time_window(left, right, ["k"], "t", "u", before, after)
        want = pairs.groupBy("k", "id").agg(F.count("*").alias("n"), F.count("g").alias("m"), F.sum("g").alias("s"), F.min("sample").alias("lo"), F.max("sample").alias("hi"))
        got = spatial.in_time_window(left, right, ["k"], "t", "u", before, after, {
            "n": ("count", "u"), "m": ("count", "g"), "s": ("sum", "g"), "lo": ("min", "sample"), "hi": ("max", "sample")})
        got = got.groupBy("k", "id").agg(F.sum("n").alias("n"), F.sum("m"), F.sum("s"), F.min("lo"), F.max("hi")).where("n > 0")
        assert rows(got, "k", "id") == rows(want, "k", "id")


@pytest.mark.parametrize("scale", [1.0, 1e-25, 1e25])
def test_single_precision_only_screens(scale):
    """Scores nearer to each other than single precision tells apart, ties between variants, and copies."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=16)
    v = np.concatenate([base + 1e-9 * rng.normal(size=(300, 16)), rng.normal(size=(300, 16)), np.repeat(base[None], 40, axis=0)]) * scale
    q = np.stack([v[::7], np.roll(v[::7], 3, axis=1)], axis=1)
    ids = np.arange(len(v), dtype=np.int64)
    lists = lambda m: pa.array(list(m), pa.list_(pa.float64()))
    right = pa.table({"item": ids, "bvec": lists(v)})
    s = np.round(np.stack([q[:, 0] @ v.T, q[:, 1] @ v.T]), 12)
    best = s.max(axis=0)
    left = pa.table({"qid": ids[::7], "qvec": lists(q.reshape(len(q), -1))})
    got = retrieval._top_tile(2, 5, True)(left, right).to_pandas()
    for n, i in enumerate(ids[::7]):
        own = got[got.qid == i]
        want = np.sort(np.delete(best[n], i))[::-1][:5]
        assert len(own) == 5 and np.allclose(own.score, want, rtol=1e-14, atol=2e-12)
    goal = s[0][np.arange(len(q)), 1]
    asked = left.set_column(1, "qvec", lists(q[:, 0])).append_column("truth", pa.array(np.ones(len(q), np.int64))).append_column("threshold", pa.array(goal))
    ranks = retrieval._rank_tile(True)(asked, right).to_pandas().set_index("qid").better
    for n, i in enumerate(ids[::7]):
        other = (ids != i) & (ids != 1)
        clear = np.abs(s[0][n] - goal[n]) > max(2e-12, 1e-14 * abs(goal[n]))
        sure, open_ = (other & clear & (s[0][n] > goal[n])).sum(), (other & ~clear).sum()
        assert sure <= ranks[i] <= sure + open_


def test_lanes_are_bounded_by_what_vectors_hold():
    """Before, a lane took 65,536 queries however long their vectors were."""
    lanes = pruned.lanes_for(1_000_000, 16384, 387, 61, 12)
    assert 1_000_000 / lanes * 387 <= pruned.LANE_NUMBERS
    assert pruned.lanes_for(100, 16384, 64, 1, 12) == 1


def test_retrieval_of_empty_and_lonely_tables(spark):
    bank = spark.createDataFrame([(1, [1.0, 0.0])], "item long, bvec array<double>")
    q = bank.select(F.col("item").alias("qid"), F.col("bvec").alias("qvec"))
    for b in (bank, bank.limit(0)):
        assert retrieval.top_k(q, b, 3).count() == 0 and retrieval.score_moments(q, b).count() == 0
    assert [tuple(r) for r in retrieval.top_k(q, bank, 3, skip_self=False).collect()] == [(1, 1, 1.0, 0, 1)]
    assert retrieval.top_k(q.limit(0), bank, 3).count() == 0
    more = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 3.0]), (3, [2.0, 1.0])], "item long, bvec array<double>")
    m = {r.qid: r for r in retrieval.score_moments(q, more).collect()}
    assert m[1].n == 2 and m[1]["mean"][0] == pytest.approx(1.0) and m[1]["std"][0] == pytest.approx(1.0)


def test_nearest_site_matches_brute_force(spark):
    rng = np.random.default_rng(6)
    p, s = rng.uniform(-50, 50, (80, 2)), rng.uniform(-10, 10, (12, 2))
    pts = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "k int, x double, y double")
    sites = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(s)], "id int, sx double, sy double")
    got = {r.k: r.id for r in spatial.nearest_site(pts, sites, ["k"], "x", "y", "id", "sx", "sy", 1.0).collect()}
    assert got == {i: int(np.argmin(((s - r) ** 2).sum(1))) for i, r in enumerate(p)}


def test_permutation_test_agrees_with_plain_permutations(spark):
    rng = np.random.default_rng(8)
    g = np.arange(300) % 3 == 0
    same = rng.normal(size=300)
    for x, chunk in ((same, 50), (same, 1000), (same + 2.0 * g, 50)):
        df = spark.createDataFrame([(float(v), bool(b)) for v, b in zip(x, g)], "x double, g boolean")
        got = metrics.permutation_test(df, "x", "g", 400, chunk_rows=chunk).first()
        gap = x[g].mean() - x[~g].mean()
        sims = []
        for _ in range(4000):
            p = rng.permutation(x)
            sims.append(p[:100].mean() - p[100:].mean())
        want = (np.sum(np.abs(sims) >= abs(gap)) + 1) / 4001
        assert abs(got.mean_difference - gap) < 1e-9 and abs(got.p_value - want) < 0.03


def test_nearest_site_has_no_farthest_distance(spark):
    from spoorgrid.operators.spatial import nearest_site

    rng = np.random.default_rng(6)
    sites = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-50, 50, (30, 2)))] + [(99, 4000.0, 0.0)]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-80, 80, (60, 2)))] + [(100, 90_000.0, 1.0), (101, -2e6, 5e5), (102, 2100.0, 0.0)]
    p = spark.createDataFrame(points, "pid int, x double, y double")
    s = spark.createDataFrame(sites, "sid int, sx double, sy double")
    got = {r["pid"]: r["sid"] for r in nearest_site(p, s, ["pid"], "x", "y", "sid", "sx", "sy", 4.0).collect()}
    want = {i: min(sites, key=lambda t: ((t[1] - x) ** 2 + (t[2] - y) ** 2, t[0]))[0] for i, x, y in points}
    assert got == want
    assert nearest_site(p, s.where("sid < 0"), ["pid"], "x", "y", "sid", "sx", "sy", 4.0).count() == 0


def test_votes_take_any_category(spark):
    from spoorgrid.operators.vote import dominant_per_frame

    rows = [(0, 1, 1, c) for c in (2000, 2000, 3, 70000, 70000, 70000)] + [(0, 2, 1, 5), (0, 2, 1, 2_000_000)]
    out = dominant_per_frame(spark.createDataFrame(rows, "frame_idx int, ix int, iy int, label int"), ["frame_idx"], "label", 0)
    assert {(r["ix"], r["label"]) for r in out.collect()} == {(1, 70000), (2, 5)}


def test_greedy_matching_of_a_long_chain(spark):
    from spoorgrid.operators.matching import greedy_matches

    n = 12
    pairs = [(0, i, i, 2.0 * i) for i in range(n)] + [(0, i + 1, i, 2.0 * i + 1) for i in range(n - 1)]
    out = greedy_matches(spark.createDataFrame(pairs, "frame_idx int, l int, r int, w double"), ["frame_idx"], "l", "r", "w").collect()
    free_l, free_r, want = set(range(n)), set(range(n)), set()
    for _, left, right, w in sorted(pairs, key=lambda p: (-p[3], p[1], p[2])):
        if left in free_l and right in free_r:
            free_l.discard(left), free_r.discard(right)
            want.add((left, right))
    assert {(r["l"], r["r"]) for r in out} == want


def test_permutation_test_by_a_split_tree_within_its_binomial_error(spark):
    import itertools

    x, m = [3.0, 1.0, 4.0, 1.5, 9.0, 2.6, 5.3, 5.8, 9.7, 9.3, 2.3, 8.4], 5
    df = spark.createDataFrame([(v, i < m) for i, v in enumerate(x)], "x double, g boolean").repartition(3)
    gap = lambda some: sum(some) / m - (sum(x) - sum(some)) / (len(x) - m)
    every = [abs(gap(c)) for c in itertools.combinations(x, m)]
    exact = np.mean(np.array(every) >= abs(gap(x[:m])) - 1e-12)
    for chunk in (2, 5):
        got = metrics.permutation_test(df, "x", "g", 3000, seed=4, chunk_rows=chunk).first()
        assert abs(got.p_value - exact) < 4.5 * np.sqrt(exact * (1 - exact) / 3000) and got.mean_difference == pytest.approx(gap(x[:m]))


def test_lanes_of_queries_read_blocks_and_are_not_copied_to_them(spark):
    """Before, every query was shuffled to every block that it needed, and ensembles held the scores of 4,096 by 4,096 pairs."""
    rng = np.random.default_rng(21)
    n, d, models, variants = 90, 4, 2, 3
    v = np.round(rng.normal(size=(n, models * d)), 1)
    v[50:60] = v[3]  # ties
    e = v.reshape(n, models, d)
    q = np.stack([np.roll(e, s, axis=2) for s in range(variants)], axis=2)  # n, models, variants, d
    bank = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(n, None)], "item long, bvec array<double>")
    asked = spark.createDataFrame([(i, [float(x) for x in q[i].ravel()]) for i in range(0, n, 4)] + [(777, None)], "qid long, qvec array<double>")
    s = np.round(np.einsum("qmvd,bmd->qmvb", q, e), 12)
    out = retrieval.ensemble_top_k(asked, bank, 5, [3.0, 2.0], variants=variants, block_rows=16)
    moments = {r.qid: r for r in retrieval.score_moments(asked, bank, models, variants, block_rows=16).collect()}
    got = {(r.qid, r["rank"]): r for r in out.collect()}
    assert len(got) == 5 * 23 and set(moments) == set(range(0, n, 4))
    for i in range(0, n, 4):
        rest = [j for j in range(n) if j != i]
        best = s[i].max(axis=1)
        mean, dev = best[:, rest].mean(axis=1), best[:, rest].std(axis=1)
        assert moments[i].n == n - 1 and np.allclose(moments[i]["mean"], mean) and np.allclose(moments[i]["std"], dev)
        z = (best - mean[:, None]) / dev[:, None] * np.array([[0.6], [0.4]])
        total = np.round(z.sum(axis=0), 9)
        for rank, j in enumerate(sorted(rest, key=lambda j: (-total[j], j))[:5], 1):
            assert got[i, rank].item == j and abs(got[i, rank].score - total[j]) < 1e-8
            assert got[i, rank].variant == s[i, z[:, j].argmax(), :, j].argmax()
    top = retrieval.top_k(asked.select("qid", F.slice("qvec", 1, d).alias("qvec")), bank.select("item", F.slice("bvec", 1, d).alias("bvec")), 4, block_rows=16)
    for i, own in {r.qid: [x for x in top.collect() if x.qid == r.qid] for r in asked.where("qid < 40").collect()}.items():
        want = sorted((j for j in range(n) if j != i), key=lambda j: (-s[i, 0, 0, j], j))[:4]
        assert [x.item for x in sorted(own, key=lambda x: x["rank"])] == want
    for made in (out, top):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "CoGroup" not in plan and "Join" not in plan


def test_effective_points_are_looked_up_once_and_without_positions(spark):
    """Before, the lookups of all points ran for the frames' decisions and again for the points, and y and z travelled along."""
    with mock.patch.object(catalog_maps, "kept", wraps=session.kept, create=True) as once:
        out = REGISTRY["P31_effective_points"].build(spark, "/root/testdata/sf0.001")
    assert once.call_count == 1 and "pixels" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert "Project" in out._jdf.queryExecution().optimizedPlan().toString() and out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    cams = spark.createDataFrame([(0, c, 8.0, 8.0, 8.0, 8.0, 16, 16, 0.0, 0.0, 0.0, 0.0, 0.0) for c in ("left", "right")],
                                 "sequence int, camera string, fx double, fy double, cx double, cy double, width int, height int, k1 double, k2 double, p1 double, p2 double, k3 double")
    cams = cams.withColumn("cam_pose", P.pose_from_planar(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    pts = spark.range(300).selectExpr("0 as sequence", "int(id % 6) as frame_idx", "id as point_idx", "id / 9e2 as x", "id / 7e2 as y", "3e0 as z")
    mask = spark.range(1).selectExpr("0 as sequence", "1 as frame_idx", "'left' as camera", "9 as u", "9 as v", "true as semi")
    with mock.patch.object(session, "ROWS_A_TASK", 20):
        hits = masks.mask_hits(pts, mask, ["semi"], cams).select("point_idx", "semi")
    dealt = hits._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")
    assert len(dealt) == 3 and all(" y#" not in line and " z#" not in line for line in (p.split("\n")[1] for p in dealt[1:]))
