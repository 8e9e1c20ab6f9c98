import os
import uuid
from unittest import mock

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoorgrid.operators import relay, vote
from spoorgrid.plans.bindings import bound, table
from spoorgrid.plans import catalog_streams
from spoorgrid.plans.catalog_streams import HYSTERESIS, as_frames, as_points, nested_frames
from spoorgrid.plans.registry import REGISTRY
from spoorgrid.sources.reports import nest_candidates
from spoorgrid.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def split_source(spark, tmp_path):
    """The first table rows as several files that arrive one after the other."""
    def make(name, order, parts=3):
        path = f"{tmp_path}/{name}"
        df = table(spark, SF, name)
        edges = df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.0)
        for i, (lo, hi) in enumerate(zip([-1e18, *edges], [*edges, 1e18])):
            df.where((F.col(order) > lo) & (F.col(order) <= hi)).coalesce(1).write.mode("append").parquet(path)
        return path, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return make


def test_online_hysteresis_equals_batch_and_survives_a_restart(spark, tmp_path, split_source):
    path, _ = split_source("events", "event_id")
    fields = ["patch_id", "final_score", "bev_score", "icp_inlier_ratio", "icp_valid", "deep_match_probability", "init_source"]
    batch = relay.patch_hysteresis(nest_candidates(bound(spark, SF, "candidates"), fields), HYSTERESIS)
    want = sorted((r.sequence, r.frame_idx, r.selected_idx, r.patch_id, r.selection_mode) for r in batch.collect())
    out = f"{tmp_path}/out-{uuid.uuid4().hex}"
    schema = table(spark, SF, "events").schema
    with jobs.rocksdb(spark):
        import glob
        import os
        import shutil

        files = sorted(glob.glob(f"{path}/*.parquet"), key=os.path.getmtime)
        live = f"{tmp_path}/live"
        os.makedirs(live)
        for f in files:  # every file is a separate run of the query: state must come back from the checkpoint
            shutil.copy(f, live)
            got = jobs.run_available(jobs.online_hysteresis(nested_frames(spark.readStream.schema(schema).parquet(live)), HYSTERESIS), out)
    assert sorted((r.sequence, r.frame_idx, r.selected_idx, r.patch_id, r.selection_mode) for r in got.collect()) == want


def test_incremental_store_equals_batch_and_ignores_replays(spark, tmp_path, split_source):
    _, flow = split_source("lineitem", "l_partkey")
    sink = jobs.CellStoreSink(f"{tmp_path}/store")
    jobs.run_batches(as_points(flow), sink, f"{tmp_path}/store")
    got = sorted(map(tuple, sink.store(spark).select("ix", "iy", "observed", "n_static", "n_semi", "n_dynamic").collect()))
    batch = as_points(table(spark, SF, "lineitem"))
    want = sorted(map(tuple, vote.group_store(batch, [], ["sequence", "frame_idx"]).select("ix", "iy", "observed", "n_static", "n_semi", "n_dynamic").collect()))
    assert got == want  # frames split between files as well
    whole = jobs.CellStoreSink(f"{tmp_path}/whole")
    for batch_id in (0, 0):  # a replay
        whole(batch, batch_id)
    again = sorted(map(tuple, whole.store(spark).select("ix", "iy", "observed", "n_static", "n_semi", "n_dynamic").collect()))
    assert again == want


def test_online_tracks_equal_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(0, "p", f, f * 10 + j, float(rng.integers(0, 30)) / 10, 0.0, 0.0) for f in range(40) for j in range(3)]
    df = spark.createDataFrame(rows, "sequence int, target string, frame_idx int, obs_id long, x double, y double, z double")
    want = sorted((r.obs_id, r.track_id) for r in relay.associate_tracks(df, 1.0, 3).collect())
    timed = df.withColumn("ts", F.timestamp_millis((F.col("frame_idx") * 100 + 100000).cast("bigint")))
    timed.coalesce(1).write.parquet(f"{tmp_path}/in")
    with jobs.rocksdb(spark):
        got = jobs.run_available(jobs.online_tracks(spark.readStream.schema(timed.schema).parquet(f"{tmp_path}/in"), 1.0, 3, 60000), f"{tmp_path}/out")
    assert sorted((r.obs_id, r.track_id) for r in got.collect()) == want


def test_windowed_errors_equal_batch_on_all_windows(spark, tmp_path, split_source):
    _, flow = split_source("events", "event_id")
    got = {(r.window_start, r.sequence): (r.frames, round(r.mean_error, 9)) for r in
           jobs.run_updates(jobs.windowed_errors(as_frames(flow), "1 day"), f"{tmp_path}/w", ["window_start", "window_end", "sequence"]).collect()}
    batch = jobs.windowed_errors(as_frames(table(spark, SF, "events")), "1 day").collect()
    want = {(r.window_start, r.sequence): (r.frames, round(r.mean_error, 9)) for r in batch}
    assert len(got) > 100 and got == want


def test_windows_of_a_table_of_many_unordered_partitions(spark, tmp_path):
    table(spark, SF, "events").repartition(6).write.parquet(f"{tmp_path}/in/events.parquet")
    got = sorted(map(tuple, REGISTRY["R5_windowed_errors"].build(spark, f"{tmp_path}/in").select("window_start", "sequence", "frames").collect()))
    batch = jobs.windowed_errors(as_frames(table(spark, SF, "events")), "1 day")
    assert got == sorted(map(tuple, batch.select(F.unix_timestamp("window_start"), "sequence", "frames").collect()))


def test_interval_join_meets_by_slot_of_time(spark):
    """Both borders of the interval count, before 1970 too, and rows of a sequence that are far apart share no join key."""
    times = [-7200, -3601, -3600, -1, 0, 1, 3599, 3600, 3601, 7200, 10800, 500000]
    rows = [(s, i, t) for s in range(2) for i, t in enumerate(times)]
    a = spark.createDataFrame(rows, "sequence int, frame_idx int, t long").select("sequence", "frame_idx", F.timestamp_seconds("t").alias("ts"))
    b = a.select("sequence", F.col("ts").alias("imu_ts"), F.col("frame_idx").alias("sample"))
    joined = jobs.frames_with_imu(a, b, "1 hour")
    want = sorted((s, i, j) for s in range(2) for i, x in enumerate(times) for j, y in enumerate(times) if abs(x - y) <= 3600)
    assert sorted(map(tuple, joined.select("sequence", "frame_idx", "sample").collect())) == want
    keys = joined._jdf.queryExecution().optimizedPlan().toString().split("Join Inner", 1)[1].split("\n", 1)[0]
    assert keys.count("_slot") == 2


def test_stateful_streams_hold_bounded_micro_batches(spark, tmp_path):
    """The whole table was one micro-batch, and a task held a sequence of it."""
    for name, size in (("R1_online_hysteresis", 300), ("R3_online_tracks", 400)):
        taken, ran = [], jobs.run_available
        want = sorted(map(tuple, REGISTRY[name].build(spark, SF).collect()))
        with mock.patch.object(catalog_streams, "MICRO_BATCH", size), mock.patch.object(jobs, "run_available", lambda s, path: taken.append(path) or ran(s, path)):
            got = sorted(map(tuple, REGISTRY[name].build(spark, SF).collect()))
        n = table(spark, SF, "events" if name[1] == "1" else "orders").count()
        commits = [f for f in os.listdir(f"{taken[0].removeprefix('file:')}/checkpoint/commits") if f.isdigit()]
        assert got == want and len(commits) >= n // size > 1, name


def test_samples_of_frames_are_counted_without_pairs(spark, tmp_path):
    """Equals the pairs of the join, also where frames and samples come in several micro-batches in turn, twice or without a key."""
    rng = np.random.default_rng(8)
    rows = [(s, i, int(t)) for s in (0, 1) for i, t in enumerate([-7200, -3601, -3600, 0, 0, 3600, 3601, *rng.integers(-20000, 20000, 60)])]
    rows += [(0, 3, 0), (None, 1, 0), (1, None, 5), (1, 2, None)]
    frames = spark.createDataFrame(rows, "sequence int, frame_idx int, t long").select("sequence", "frame_idx", F.timestamp_seconds(F.col("t") + 10 ** 9).alias("ts")).coalesce(1)
    parts = frames.orderBy("ts").withColumn("n", F.monotonically_increasing_id() % 3)
    for n in range(3):
        parts.where(F.col("n") == n).drop("n").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    imu = lambda f: f.select("sequence", F.col("ts").alias("imu_ts"), F.lit(0).alias("sample"))
    counted = jobs.frames_with_imu(stream, imu(stream), "12 hours", counted=True)  # nothing is late
    got = jobs.run_available(counted, f"{tmp_path}/out").groupBy("sequence", "frame_idx").agg(F.sum("samples").alias("samples"))
    pairs = jobs.frames_with_imu(frames, imu(frames), "12 hours").groupBy("sequence", "frame_idx").agg(F.count("*").alias("samples"))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, got.collect())) == sorted(map(key, pairs.collect()))
    hour = jobs.run_available(jobs.frames_with_imu(stream.where("false"), imu(stream), "1 hour", counted=True), f"{tmp_path}/none")
    assert hour.count() == 0
    plan = jobs.frames_with_imu(stream, imu(stream), "1 hour", counted=True)._jdf.queryExecution().analyzed().toString()
    assert "Join" not in plan
    taken = []
    with mock.patch.object(jobs, "run_available", lambda s, path, run=jobs.run_available: taken.append(s) or run(s, path)):
        n = REGISTRY["R6_frames_with_imu"].build(spark, SF).agg(F.sum("samples")).first()[0]
    assert "samples" in taken[0].columns and n > 0
