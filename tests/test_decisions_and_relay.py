import itertools
import re
from types import SimpleNamespace
from unittest import mock

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from spoorgrid.operators import compare, decisions as D, matching, paths, relay, review
from spoorgrid.plans import catalog_decisions, catalog_streams
from spoorgrid.plans.catalog import REGISTRY
from spoorgrid.session import cut
from spoorgrid.sources import reports

CAND = ("patch_id int, final_score double, bev_score double, icp_inlier_ratio double, icp_rmse double, icp_valid boolean, "
        "deep_match_probability double, init_source string, x double, y double, yaw double")


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(7)
    out = []
    for s, n in ((0, 260), (1, 40)):
        for f in range(n):
            ids = rng.permutation(4)[:3]
            scores = np.sort(rng.random(3))[::-1]
            out.append((s, f, 0, [(int(p), float(v), float(rng.random() * 0.2), float(rng.random()), 0.2, bool(rng.random() > 0.2), float(rng.random()),
                                   str(rng.choice(["bev_init", "tracker_init"])), float(f * 0.1 + rng.normal()), float(rng.normal()), float(rng.normal() * 0.2))
                                  for p, v in zip(ids, scores)]))
    return spark.createDataFrame(out, f"sequence int, frame_idx int, best_patch_id int, candidate_results array<struct<{CAND.replace(' ', ':').replace(',:', ',')}>>").cache()


CFG = relay.HysteresisConfig(margin=0.2, strong_prob=0.3, streak=2, release_streak=1, scale_min=0.5, scale_max=1.5, tracker_factor=1.3)


def _sequential(frames):
    out = []
    for s, g in itertools.groupby(sorted(frames.collect(), key=lambda r: (r.sequence, r.frame_idx)), key=lambda r: r.sequence):
        m = relay.Hysteresis(CFG)
        for r in g:
            c = [x.asDict() for x in r.candidate_results]
            out.append((s, r.frame_idx, *m.push(c, c[0]["patch_id"]), m.run))
    return out


@pytest.mark.parametrize("chunk", [7, 64, 1000])
def test_hysteresis_by_chunks_equals_one_pass(frames, chunk):
    got = [(r.sequence, r.frame_idx, r.selected_idx, r.selection_mode, r.patch_id, r.challenger_run)
           for r in relay.patch_hysteresis(frames, CFG, chunk).orderBy("sequence", "frame_idx").collect()]
    assert got == _sequential(frames)
    assert len({g[3] for g in got}) >= 3  # several modes occur


def test_smoothing_does_not_depend_on_chunks_nor_gaps(frames):
    some = frames.where("frame_idx < 90 or frame_idx > 170").withColumn("frame_idx", F.when(F.col("frame_idx") > 200, F.col("frame_idx") + 1000).otherwise(F.col("frame_idx")))
    got = [[(r[0], r[1], r[2], r[3], round(r[4], 8)) for r in paths.smooth_sequence(some, chunk=c).orderBy("sequence", "frame_idx").collect()] for c in (3, 40, 10_000)]
    assert got[0] == got[1] == got[2] and len(got[0]) == some.count()


def test_smoothing_equals_exhaustive_search(spark, frames):
    short = frames.where("sequence = 1 and frame_idx < 7")
    got = paths.smooth_sequence(short, chunk=3).orderBy("frame_idx").collect()
    table = [[c.asDict() for c in r.candidate_results] for r in short.orderBy("frame_idx").collect()]
    best = None
    for path in itertools.product(*[range(len(t)) for t in table]):
        s = sum(t[i]["final_score"] for t, i in zip(table, path))
        s += sum(paths.steps_between([a[i]], [b[j]], 2.0, 30.0, 0.3)[0, 0] for (a, i), (b, j) in zip(zip(table, path), zip(table[1:], path[1:])))
        if best is None or s > best[0]:
            best = (s, path)
    assert tuple(r.selected_idx for r in got) == best[1]
    assert abs(got[-1].path_score - best[0]) < 1e-9


def test_beam_does_not_depend_on_chunks(frames):
    cfg = relay.BeamConfig(max_jump=3.0)
    a = rows(relay.track_beam(frames, cfg, 1000), "sequence", "frame_idx")
    b = rows(relay.track_beam(frames, cfg, 50), "sequence", "frame_idx")
    assert a == b and len(a) == 300


def test_a_round_reads_its_own_chunks_alone(frames):
    """Before, nothing told Spark which chunks a round needs, and the whole input was read and shuffled in each."""
    plans = []
    with mock.patch.object(relay, "cut", side_effect=lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df)):
        assert relay.track_beam(frames, relay.BeamConfig(max_jump=3.0), 50).count() == 300
    rounds = [p for p in plans if "FlatMapGroupsInPandas" in p]
    assert len(rounds) == 6
    assert all(re.search(r"PartitionFilters: \[[^\]]*_chunk#\d+L? (= -?\d|IN |INSET )", p) for p in rounds)


def test_frames_nest_only_what_a_rule_reads(spark):
    """Before, every rule's frames carried all thirteen fields of a candidate through the shuffle."""
    c = spark.createDataFrame([(0, 0, k, k, 1.0 - k, 0.5) for k in (1, 0)], "sequence int, frame_idx int, cand int, patch_id int, final_score double, icp_rmse double")
    got = catalog_decisions._nested(SimpleNamespace(candidates=c), "patch_id", "final_score")
    assert [[tuple(x) for x in r.candidate_results] for r in got.collect()] == [[(0, 0, 1.0), (1, 1, 0.0)]]


def test_gain_gate_computes_its_examples_once(spark):
    """Before, each pass of the fit and the report joined the tables anew."""
    names = catalog_streams.GAIN_FEATURES
    made = spark.createDataFrame([(("train", "validation")[i % 2], 0.1 - 0.2 * (i % 3), *[float((i * (j + 3)) % 7) for j in range(len(names))]) for i in range(60)],
                                 "split string, delta double, " + ", ".join(f"{n} double" for n in names))
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    with mock.patch.object(catalog_streams, "_gain_examples", return_value=made.mapInPandas(counted, made.schema)):
        assert REGISTRY["F1_gain_gate"].build(spark, "/nowhere").count() == 1
    assert seen.value == 60


def test_diverse_beam():
    states = [{"score": s, "poses": p} for s, p in ((3.0, [[0, 0, 0]]), (2.9, [[0.2, 0, 0]]), (2.8, [[2, 0, 0]]), (9.0, []))]
    assert [s["score"] for s in relay.diverse_beam(states, 2, 0.5)] == [3.0, 2.8]


@pytest.mark.parametrize("chunk", [5, 1000])
def test_tracks_expire_and_continue(spark, chunk):
    obs = [(0, "p", 0, 1, 0.0), (0, "p", 1, 2, 0.5), (0, "p", 4, 3, 0.9), (0, "p", 12, 4, 0.9), (0, "p", 12, 5, 5.0)]
    df = spark.createDataFrame([(*o, 0.0, 0.0) for o in obs], "sequence int, target string, frame_idx int, obs_id long, x double, y double, z double")
    got = {r.obs_id: r.track_id for r in relay.associate_tracks(df, 1.0, 3, chunk).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 1, 5: 2}


@pytest.mark.parametrize("still", [False, True])
def test_tracks_of_many_chunks_take_few_rounds(spark, still):
    """Without a gap no stretch of frames is cut off; `still` adds an object that never ends its track."""
    rng, chunks = np.random.default_rng(5), 40
    seen = [(f, [(9.0, 9.0, 0.0)] * still + [(float(rng.integers(0, 40)) / 10, float(rng.integers(0, 40)) / 10, 0.0) for _ in range(4)]) for f in range(chunks * 30)]
    tracks, opened, want = [], 0, {}
    for f, at in seen:
        ids, tracks, opened = relay.associate(tracks, at, f, 1.0, 3, opened)
        want |= {10 * f + j: i for j, i in enumerate(ids)}
    rows_ = [(0, "p", f, 10 * f + j, *xyz) for f, at in seen for j, xyz in enumerate(at)]
    df = spark.createDataFrame(rows_, "sequence int, target string, frame_idx int, obs_id long, x double, y double, z double")
    with mock.patch.object(relay, "cut", wraps=relay.cut) as written:
        got = {r.obs_id: r.track_id for r in relay.associate_tracks(df, 1.0, 3, 30).collect()}
    assert got == want
    assert written.call_count < chunks


def test_suppression_rules(spark):
    base = {"sequence": 0, "patch_id": 1, "selection_mode": "online_patch_hysteresis", "previous_source": "tracker_init", "proposed_patch": 2,
            "previous_patch": 1, "proposed_prob": 0.9, "overridden": False}
    df = spark.createDataFrame(pd.DataFrame([{**base, "frame_idx": i} for i in range(5)]))
    out = relay.relay(df, "sequence", "frame_idx", relay.suppression_step(2, 0.5, None, None, None), "sequence int, frame_idx int, use_prediction boolean", 2)
    assert [r.use_prediction for r in out.orderBy("frame_idx").collect()] == [False, True, False, False, False]


def test_margins_and_leakage(spark):
    df = spark.createDataFrame([([1.0, 0.5], [0.2, 0.4], [1.0])], "a array<double>, b array<double>, c array<double>")
    r = df.select(D.margin(F.col("a"), True).alias("a"), D.margin(F.col("b"), False).alias("b"), D.margin(F.col("c"), True).alias("c")).first()
    assert (r.a, round(r.b, 9), r.c) == (0.5, -0.2, None)
    from spoorgrid.operators.learning import RISK_FEATURES, fit_risk_monitor

    assert not any("error" in f for f in RISK_FEATURES)
    with pytest.raises(ValueError, match="ground-truth"):
        fit_risk_monitor(df, ["position_error_m"], "y")


def test_geometry_merge(spark):
    schema = "patch int, inlier double, rmse double, valid boolean"
    f = spark.createDataFrame([(1, 0.8, 0.2, True), (2, 0.6, 0.4, True)], schema)
    r = spark.createDataFrame([(1, 0.7, 0.3, True), (2, 0.7, 0.3, True)], schema)
    assert rows(D.merge_filtered(f, r, ["patch"]), "patch") == [(1, True, 0.8, 0.2), (2, False, 0.7, 0.3)]


def test_failure_categories(spark):
    df = spark.createDataFrame([(0.1, 0.1), (0.2, 0.19), (0.6, 0.3), (0.9, 0.5)], "s double, o double")
    got = [r[0] for r in df.select(D.failure_category("s", "o")).collect()]
    assert got == ["normal", "topk_selection_failure", "topk_partial_recovery_only", "topk_candidate_absence"]


def test_greedy_matching_equals_a_scan(spark):
    rng = np.random.default_rng(2)
    pairs = [(f, i, j, float(np.round(rng.random(), 2))) for f in range(4) for i in range(8) for j in range(8) if rng.random() < 0.6]
    got = {(r.f, r.i, r.j) for r in matching.greedy_matches(spark.createDataFrame(pairs, "f int, i int, j int, w double"), ["f"], "i", "j", "w").collect()}
    want = set()
    for f in range(4):
        a, b = set(), set()
        for _, i, j, w in sorted((p for p in pairs if p[0] == f), key=lambda p: (-p[3], p[1], p[2])):
            if i not in a and j not in b:
                a.add(i)
                b.add(j)
                want.add((f, i, j))
    assert got == want


def test_overlaps_appear_once_whatever_the_buckets(spark):
    rng = np.random.default_rng(4)
    def boxes(n):
        xy = rng.uniform(0, 300, (n, 2))
        return [(0, i, float(x), float(y), float(x + w), float(y + h)) for i, ((x, y), (w, h)) in enumerate(zip(xy, rng.uniform(10, 120, (n, 2))))]
    a, b = boxes(30), boxes(30)
    df = [spark.createDataFrame(v, f"f int, {n} int, x1 double, y1 double, x2 double, y2 double") for v, n in ((a, "p"), (b, "q"))]
    got = sorted((r.p, r.q) for r in matching.overlapping(df[0], df[1], ["f"], "p", "q", 50.0).collect())
    want = sorted((p[1], q[1]) for p in a for q in b if min(p[4], q[4]) > max(p[2], q[2]) and min(p[5], q[5]) > max(p[3], q[3]))
    assert got == want


def test_pre_limited_queue_equals_the_full_walk(spark):
    rng = np.random.default_rng(9)
    n = 4000
    pdf = pd.DataFrame({"tier": rng.choice(["A", "B", "C"], n, p=[0.6, 0.3, 0.1]), "priority": np.round(rng.random(n), 3),
                        "sequence": np.where(rng.random(n) < 0.8, 0, rng.integers(1, 60, n)), "anchor_frame": rng.integers(0, 99, n),
                        "split": rng.choice(["train", "validation"], n), "doc_id": np.arange(n)})
    for limit in (8, 30):
        full = review.walk_quotas(pdf.sort_values(["tier", "priority", "sequence", "anchor_frame", "doc_id"], ascending=[True, False, True, True, True]), limit)
        got = review.balanced_queue(spark.createDataFrame(pdf), "doc_id", limit).orderBy("position").toPandas()
        assert got.doc_id.tolist() == full.doc_id.tolist() and len(got) == limit


def test_strict_pairs_raise(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 5)], "k int, v int")
    with pytest.raises(Exception, match="missing partner"):
        compare.strict_pairs(a, b, ["k"]).collect()


def test_selected_candidate_resolution(spark):
    df = spark.createDataFrame([(0, 1, [(1, 5), (2, 7)]), (1, 9, [(1, 5), (2, 7)]), (2, None, []), (3, -1, [(1, 5), (2, 7)])],
                               "k int, i int, candidate_results array<struct<cand:int,patch_id:int>>")
    got = [r.p for r in df.orderBy("k").select(reports.selected_candidate("i", F.lit(7))["patch_id"].alias("p")).collect()]
    assert got == [7, 7, None, 7]


def test_map_rerank_compares_all_layers_on_the_same_candidates(spark):
    names = "sequence int, frame_idx int, cand int, patch_id int, final_score double, position_error double, semantic_score double"
    a = spark.createDataFrame([(0, 0, 0, 5, 1.0, 0.9, 0.0), (0, 0, 1, 6, 0.9, 0.5, 0.1), (0, 0, 2, 7, 0.8, 0.1, 0.0)], names)
    b = spark.createDataFrame([(0, 0, 0, 5, 1.0, 0.9, 0.0), (0, 0, 1, 6, 0.9, 0.5, 0.0), (0, 0, 2, 7, 0.8, 0.1, 0.05)], names)
    got = {r.method: r.patch_id for r in compare.map_rerank({"heuristic": a, "learned": b}, 2.0).collect()}
    assert got == {"candidate_final_score": 5, "heuristic": 6, "learned": 5, "oracle_topk": 7}


def test_review_packets_without_centres_have_boxes_but_no_path(spark):
    linked = spark.createDataFrame([(1, 0, f, f - 5, 1.0, 2.0, 3.0, 4.0) for f in (4, 5, 6)] + [(2, 0, 9, 0, 1.0, 2.0, 3.0, 4.0)],
                                   "anchor_id int, sequence int, frame_idx int, offset int, x1 double, y1 double, x2 double, y2 double")
    centres = spark.createDataFrame([(0, f, float(f), 0.0, 0.0, "depth_box_interior") for f in (4, 5, 6)],
                                    "sequence int, frame_idx int, center_x double, center_y double, center_z double, center_source string")
    got = {r.anchor_id: r for r in review.review_packets(linked, centres).collect()}
    assert (got[1].observed, got[1].path_length, got[1].motion_hint) == (3, 2.0, "potentially_moving")
    assert got[1].track_boxes == "[-1,1,2,3,4;0,1,2,3,4;1,1,2,3,4]"
    assert (got[2].observed, got[2].path_length, got[2].center_sources) == (0, None, "none")
