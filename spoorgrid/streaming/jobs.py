"""Structured Streaming versions of the ordered and incremental operators.

Sources, triggers and sinks are the caller's. State lives in the state store (RocksDB for the stateful
processors) under the query's checkpoint location, which is what makes a restart exact.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from spoorgrid.operators import vote
from spoorgrid.operators.relay import Hysteresis, HysteresisConfig, associate

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_JSON = StructType([StructField("json", StringType())])


@contextmanager
def rocksdb(spark: SparkSession):
    """Stateful processors need the RocksDB state store; other queries keep the session's own choice."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


class _JsonState(StatefulProcessor):
    """One JSON value per key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("state", _JSON)

    def load(self) -> dict:
        return json.loads(self.value.get()[0]) if self.value.exists() else {}

    def save(self, state: dict) -> None:
        self.value.update((json.dumps(state),))

    def close(self) -> None:
        pass


class OnlineHysteresis(_JsonState):
    """Patch hysteresis per sequence; frames not newer than the last one are dropped and counted."""

    def __init__(self, cfg: HysteresisConfig):
        self.cfg = cfg

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = self.load()
        machine = Hysteresis(self.cfg, state)
        last, late = state.get("last", -1), state.get("late", 0)
        out = []
        for r in pd.concat(list(rows)).sort_values("frame_idx").itertuples(index=False):
            if r.frame_idx <= last:
                late += 1
                continue
            last = int(r.frame_idx)
            cands = list(r.candidate_results)
            i, mode, patch = machine.push(cands, int(cands[0]["patch_id"]) if cands else int(r.best_patch_id))
            out.append((key[0], last, i, patch, mode, machine.run, late))
        self.save({**machine.state(), "last": last, "late": late})
        yield pd.DataFrame(out, columns=["sequence", "frame_idx", "selected_idx", "patch_id", "selection_mode", "challenger_run", "late_frames"])


def online_hysteresis(frames: DataFrame, cfg: HysteresisConfig) -> DataFrame:
    """Stream of frames (sequence, frame_idx, candidate_results) to decisions."""
    return frames.groupBy("sequence").transformWithStateInPandas(
        OnlineHysteresis(cfg), "sequence int, frame_idx int, selected_idx int, patch_id int, selection_mode string, challenger_run int, "
        "late_frames bigint", "Append", "None")


class OnlineTracks(_JsonState):
    """Track association per (sequence, target). An event-time timer drops all tracks once the gap has passed."""

    def __init__(self, max_distance: float, max_gap: int, gap_ms: int):
        self.max_distance, self.max_gap, self.gap_ms = max_distance, max_gap, gap_ms

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = self.load()
        tracks, next_id, last = state.get("tracks", []), state.get("next", 0), state.get("last", -1)
        batch = pd.concat(list(rows))
        out = []
        seen = batch[batch["frame_idx"] > last].sort_values(["frame_idx", "obs_id"], kind="stable")
        rows_of = zip(*(seen[c].tolist() for c in ("frame_idx", "obs_id", "x", "y", "z")))
        for frame, group in itertools.groupby(rows_of, key=lambda r: r[0]):
            group = list(group)
            ids, tracks, next_id = associate(tracks, [r[2:] for r in group], int(frame), self.max_distance, self.max_gap, next_id)
            last = int(frame)
            out += [(key[0], key[1], last, int(r[1]), int(t)) for r, t in zip(group, ids)]
        self.save({"tracks": tracks, "next": next_id, "last": last})
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int(batch["ts"].max().timestamp() * 1000) + self.gap_ms)
        yield pd.DataFrame(out, columns=["sequence", "target", "frame_idx", "obs_id", "track_id"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        state = self.load()
        self.save({**state, "tracks": []})
        yield pd.DataFrame(columns=["sequence", "target", "frame_idx", "obs_id", "track_id"])


def online_tracks(observations: DataFrame, max_distance: float = 1.0, max_gap: int = 3, gap_ms: int = 1000) -> DataFrame:
    """Stream of observations (sequence, target, frame_idx, obs_id, x, y, z, ts) with a watermark of one gap."""
    return observations.withWatermark("ts", f"{gap_ms} milliseconds").groupBy("sequence", "target").transformWithStateInPandas(
        OnlineTracks(max_distance, max_gap, gap_ms), "sequence int, target string, frame_idx int, obs_id bigint, track_id bigint",
        "Append", "EventTime")


class CellStoreSink:
    """foreachBatch sink for an incremental cell store.

    Each batch writes how often it saw each group in each cell of each frame, under its batch id, so a replay
    overwrites the same folder. A frame may arrive in several batches: its counts are summed before it votes, on read.
    """

    def __init__(self, path: str):
        self.path = path

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        counts = batch.where("grp >= 0").groupBy("sequence", "frame_idx", "ix", "iy", "grp").agg(F.count("*").alias("_n"))
        counts.write.mode("overwrite").parquet(f"{self.path}/counts/batch_id={batch_id}")

    def store(self, spark: SparkSession, min_observations: float = 6.0) -> DataFrame:
        """Counts and stability of every cell seen so far."""
        c = spark.read.parquet(f"{self.path}/counts")
        c = c.groupBy("sequence", "frame_idx", "ix", "iy", "grp").agg(F.sum("_n").alias("_n"))
        v = vote.dominant(c, ["sequence", "frame_idx", "ix", "iy"], "grp")
        g = v.groupBy("ix", "iy").agg(F.count("*").alias("observed"), F.count_if(F.col("grp") == 0).alias("n_static"),
                                      F.count_if(F.col("grp") == 1).alias("n_semi"), F.count_if(F.col("grp") == 2).alias("n_dynamic"))
        return g.withColumn("stability", vote.stability(min_observations))


def risk_alarms(frames: DataFrame, model, features: list[str], threshold: float) -> DataFrame:
    """Stateless scoring of deployment features; rows at or above the threshold."""
    from spoorgrid.operators.learning import positive_probability

    return positive_probability(model, frames, features, "risk").where(F.col("risk") >= F.lit(float(threshold)))


def windowed_errors(frames: DataFrame, window: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Error dashboard over tumbling or sliding event-time windows per sequence."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    e = F.col("position_error")
    g = frames.withWatermark("ts", late).groupBy(w.alias("w"), "sequence").agg(
        F.count("*").alias("frames"), F.avg(e).alias("mean_error"), F.max(e).alias("max_error"), F.avg((e < 0.5).cast("double")).alias("below_0p5"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "sequence", "frames", "mean_error", "max_error", "below_0p5")


def session_errors(frames: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Error dashboard per uninterrupted session of a sequence."""
    g = frames.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "sequence").agg(
        F.count("*").alias("frames"), F.avg("position_error").alias("mean_error"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "sequence", "frames", "mean_error")


def frames_with_imu(frames: DataFrame, imu: DataFrame, half: str, counted: bool = False) -> DataFrame:
    """Stream-stream interval join: inertial samples within +-half of each frame of the sequence.

    With `counted` no pairs are made: sequence, frame_idx and how many `samples` the frame met, in a few rows to be added up by frame, so that
    the work is linear in both streams however dense they are.

    A sample lies in one slot of length `half` and a frame in the (up to three) slots that its interval touches, so that rows of a
    sequence meet, and are spread over tasks, by slot; every pair meets in the slot of its sample only.
    """
    if counted:
        return _imu_counts(frames, imu, half)

    def slot(t: str) -> str:
        return f"unix_micros({t}) div unix_micros(timestamp'1970-01-01 00:00:00Z' + interval {half})"

    touched = F.explode(F.expr(f"sequence({slot(f'ts - interval {half}')}, {slot(f'ts + interval {half}')})"))
    a = frames.withWatermark("ts", half).withColumn("_slot", touched).alias("a")
    b = imu.withWatermark("imu_ts", half).withColumn("_slot", F.expr(slot("imu_ts"))).alias("b")
    near = F.expr(f"a.sequence = b.sequence and a._slot = b._slot and b.imu_ts between a.ts - interval {half} and a.ts + interval {half}")
    return a.join(b, near).select("a.sequence", "a.frame_idx", "a.ts", "b.imu_ts", "b.sample")


_NO_FRAME = -2 ** 63  # stands for a null frame_idx


def _imu_counts(frames: DataFrame, imu: DataFrame, half: str) -> DataFrame:
    """Frames and samples meet by (sequence, slot of twice the half). A slot keeps sorted times of samples and the frames that it met; a batch counts
    new frames against all samples and earlier frames against new samples, as the join makes each pair once, and the watermark ends a slot."""
    span = frames.sparkSession.sql(f"select unix_micros(timestamp'1970-01-01 00:00:00Z' + interval {half})").first()[0]
    slot = f"cast(floor({{}} / {2 * span}) as bigint)"
    at = "unix_micros(_at)"
    a = frames.select("sequence", F.coalesce(F.col("frame_idx").cast("bigint"), F.lit(_NO_FRAME)).alias("frame_idx"), F.col("ts").alias("_at"), F.lit(True).alias("_frame"))
    b = imu.select("sequence", F.lit(_NO_FRAME).alias("frame_idx"), F.col("imu_ts").alias("_at"), F.lit(False).alias("_frame"))
    a, b = (x.where("sequence is not null and _at is not null").withWatermark("_at", half) for x in (a, b))
    a = a.withColumn("_slot", F.explode(F.expr(f"sequence({slot.format(f'({at} - {span})')}, {slot.format(f'({at} + {span})')})")))
    both = a.unionByName(b.withColumn("_slot", F.expr(slot.format(at)))).withColumn("_us", F.expr(at))
    blob = "frames binary, at binary, samples binary"

    def count(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        idx, at, old = (np.frombuffer(x, np.int64) for x in state.get) if state.exists else (np.empty(0, np.int64),) * 3
        new_idx, new_at, new = [], [], []
        for p in parts:
            is_frame, us = p["_frame"].to_numpy(bool), p["_us"].to_numpy(np.int64)
            new_idx.append(p["frame_idx"].to_numpy(np.int64)[is_frame])
            new_at.append(us[is_frame])
            new.append(us[~is_frame])
        new_idx, new_at, new = np.concatenate(new_idx), np.concatenate(new_at), np.sort(np.concatenate(new))
        every = np.sort(np.concatenate([old, new]))
        n = [np.searchsorted(s, t + span, "right") - np.searchsorted(s, t - span, "left") for s, t in ((new, at), (every, new_at))]
        idx, at, n = np.concatenate([idx, new_idx]), np.concatenate([at, new_at]), np.concatenate(n)
        state.update((idx.tobytes(), at.tobytes(), every.tobytes()))
        state.setTimeoutTimestamp(max((int(key[1]) + 2) * 2 * span // 1000, state.getCurrentWatermarkMs() + 1))
        met = n > 0
        if met.any():
            yield pd.DataFrame({"sequence": key[0], "frame_idx": idx[met], "samples": n[met]})

    kinds = dict(frames.dtypes)
    out = both.select("sequence", "_slot", "frame_idx", "_frame", "_us", "_at").groupBy("sequence", "_slot").applyInPandasWithState(
        count, f"sequence {kinds['sequence']}, frame_idx bigint, samples bigint", blob, "append", "EventTimeTimeout")
    return out.select("sequence", F.nullif("frame_idx", F.lit(_NO_FRAME)).cast(kinds["frame_idx"]).alias("frame_idx"), "samples")


def run_available(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Process what is there now into Parquet under `path` and return the table. Resumes from its checkpoint."""
    q = (stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/table")
         .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/table")


class LatestSink:
    """foreachBatch sink for aggregates in update mode: each batch writes the groups it changed, the last one counts."""

    def __init__(self, path: str, keys: list[str]):
        self.path, self.keys = path, keys

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/updates/batch_id={batch_id}")

    def table(self, spark: SparkSession) -> DataFrame:
        rows = spark.read.parquet(f"{self.path}/updates")
        newest = rows.groupBy(*self.keys).agg(F.max("batch_id").alias("batch_id"))
        return rows.join(newest, [*self.keys, "batch_id"]).drop("batch_id")


def run_updates(stream: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Process what is there now in update mode and return the newest row of every group, open windows included."""
    sink = LatestSink(path, keys)
    run_batches(stream, sink, path, "update")
    return sink.table(stream.sparkSession)


def run_complete(stream: DataFrame, path: str) -> DataFrame:
    """Process what is there now in complete mode (session windows have no update mode) and return the last result."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/results/batch_id={batch_id}")

    run_batches(stream, sink, path, "complete")
    rows = stream.sparkSession.read.parquet(f"{path}/results")
    last = rows.agg(F.max("batch_id")).first()[0]
    return rows.where(F.col("batch_id") == last).drop("batch_id")


def run_batches(stream: DataFrame, sink, path: str, mode: str = "append") -> None:
    """Process what is there now through a foreachBatch sink."""
    q = (stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
