"""Sequence analytics: streaks, segments, speeds, predictions, selections and layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def patch_layout(tiles: DataFrame) -> DataFrame:
    """Grid position of every patch: dense rank of rounded centres, y downwards.

    Ranks are taken over the distinct coordinates, a table as long as one side of the grid.
    """
    out = tiles.select("patch_id", F.round("center_x", 6).alias("_x"), F.round("center_y", 6).alias("_y"))
    one = Window.partitionBy(F.lit(0))
    cols = out.select("_x").distinct().withColumn("layout_col", F.row_number().over(one.orderBy("_x")) - 1)
    rows = out.select("_y").distinct().withColumn("layout_row", F.row_number().over(one.orderBy(F.desc("_y"))) - 1)
    return out.join(cols, "_x").join(rows, "_y").select("patch_id", "layout_row", "layout_col")


def normalise_channel(cells: DataFrame, value: str, name: str) -> DataFrame:
    """Global min-max scaling to 0..255, truncated; constant channels become 0, non-finite values count as 0."""
    from spoorgrid.functions.cells import finite

    clean = cells.withColumn("_v", F.when(finite(value), F.col(value).cast("double")).otherwise(0.0))
    ends = clean.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi")).select(F.struct("*")).scalar()
    out = clean.withColumn("_e", ends)
    span = F.col("_e.hi") - F.col("_e.lo")
    scaled = (F.col("_v") - F.col("_e.lo")) / span * 255.0
    grey = F.when(span > 0, F.greatest(F.least(scaled, F.lit(255.0)), F.lit(0.0)).cast("int")).otherwise(0)
    return out.withColumn(name, grey).drop("_v", "_e")


def islands(rows: DataFrame, keys, idx: str, aggs: list[Column], max_gap: int = 0, minimum: int = 1,
            chunk: int | None = None) -> DataFrame:
    """Segments of near-consecutive rows with start, end and length; shorter ones than `minimum` rows go."""
    from spoorgrid.operators.chunks import CHUNK_ROWS, _keys, run_starts

    keys = _keys(keys)
    runs = run_starts(rows, keys, idx, max_gap=max_gap, chunk=chunk or CHUNK_ROWS, name="start_frame")
    out = runs.groupBy(*keys, "start_frame").agg(F.max(idx).alias("end_frame"), F.count("*").alias("frames"), *aggs)
    return out.where(F.col("frames") >= minimum)


def streaks(frames: DataFrame, keys, idx: str, value: str, name: str, chunk: int | None = None) -> DataFrame:
    """Length of the run of equal values ending at each row."""
    from spoorgrid.operators.chunks import CHUNK_ROWS, run_starts

    out = run_starts(frames, keys, idx, value, chunk=chunk or CHUNK_ROWS, name="_start")
    return out.withColumn(name, F.col(idx) - F.col("_start") + 1).drop("_start")


def switch_counts(frames: DataFrame, keys, idx: str, value: str, chunk: int | None = None) -> DataFrame:
    """Rows, and how often the value differs from the previous row, per key."""
    from spoorgrid.operators.chunks import CHUNK_ROWS, _keys, lagged

    out = lagged(frames, keys, idx, {"_prev": (value, 1)}, chunk or CHUNK_ROWS)
    return out.groupBy(*_keys(keys)).agg(F.count("*").alias("rows"),
                                         F.count_if(F.col("_prev") != F.col(value)).alias("switches"))


def _norm3(a: list, b: list) -> Column:
    return F.sqrt(sum((F.pow(F.col(x) - F.col(y), 2) for x, y in zip(a[1:], b[1:])), F.pow(F.col(a[0]) - F.col(b[0]), 2)))


def past_speed(rows: DataFrame, keys: list[str], t: str, chunk: int | None = None, ordinal: str = "ordinal") -> DataFrame:
    """Speed from the earliest of the previous three rows of the track; 0.0 for its first row."""
    from spoorgrid.operators.chunks import CHUNK_ROWS, halo_window, with_halo

    w = halo_window(keys, ordinal).rowsBetween(-3, -1)
    out = with_halo(rows, keys, ordinal, 3, 0, chunk or CHUNK_ROWS)
    out = out.withColumns({f"_{c}": F.first(c).over(w) for c in (t, "x", "y", "z")}).where("_core")
    speed = _norm3(["x", "y", "z"], ["_x", "_y", "_z"]) / F.greatest(F.col(t) - F.col(f"_{t}"), F.lit(1.0e-6))
    return out.withColumn("past_speed", F.coalesce(speed, F.lit(0.0))).drop("_core", "_chunk", "_x", "_y", "_z", f"_{t}")


def motion_labels(rows: DataFrame, keys: list[str], t: str, horizon: float, tolerance: float, threshold: float,
                  minimum: int, chunk: int | None = None) -> DataFrame:
    """Past and future speed with a weak dynamic label; needs `ordinal`, long enough tracks and a future row."""
    from spoorgrid.operators.spatial import nearest_future

    sizes = rows.groupBy(*keys).agg(F.count("*").alias("track_observations")).where(F.col("track_observations") >= minimum)
    past = past_speed(rows, keys, t, chunk).join(sizes, keys)
    out = nearest_future(past, keys, t, horizon, tolerance, ["x", "y", "z"])
    gap = F.greatest(F.col(f"future_{t}") - F.col(t), F.lit(1.0e-6))
    speed = _norm3(["future_x", "future_y", "future_z"], ["x", "y", "z"]) / gap
    return out.withColumn("future_speed", speed).withColumn("pseudo_dynamic", F.col("future_speed") >= F.lit(float(threshold)))


def motion_prediction(frames: DataFrame, keys, idx: str, chunk: int | None = None) -> DataFrame:
    """Constant-velocity prediction of x, y and yaw from the two previous rows (one row: its pose; none: NULL)."""
    from spoorgrid.functions.pose import wrap_to_pi
    from spoorgrid.operators.chunks import CHUNK_ROWS, lagged

    lags = {f"_{c}{n}": (c, n) for c in ("x", "y", "yaw") for n in (1, 2)}
    out = lagged(frames, keys, idx, lags, chunk or CHUNK_ROWS)
    two = F.col("_x2").isNotNull()
    return out.withColumns({
        "pred_x": F.when(two, F.col("_x1") + (F.col("_x1") - F.col("_x2"))).otherwise(F.col("_x1")),
        "pred_y": F.when(two, F.col("_y1") + (F.col("_y1") - F.col("_y2"))).otherwise(F.col("_y1")),
        "pred_yaw": F.when(two, F.col("_yaw1") + wrap_to_pi(F.col("_yaw1") - F.col("_yaw2"))).otherwise(F.col("_yaw1")),
    }).drop(*lags)


def motion_hint(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Path length, net displacement and a hint over the observed centres of a short window (NULL centres skipped)."""
    seen = rows.where(F.col("x").isNotNull())
    w = Window.partitionBy(*keys).orderBy(order)
    steps = seen.withColumns({f"_{c}": F.lag(c).over(w) for c in ("x", "y", "z")})
    steps = steps.withColumn("_step", _norm3(["x", "y", "z"], ["_x", "_y", "_z"]))
    ends = F.struct("x", "y", "z")
    g = steps.groupBy(*keys).agg(F.count("*").alias("observed"), F.sum("_step").alias("path"),
                                 F.min_by(ends, order).alias("a"), F.max_by(ends, order).alias("b"))
    net = F.sqrt(F.pow(F.col("b.x") - F.col("a.x"), 2) + F.pow(F.col("b.y") - F.col("a.y"), 2) + F.pow(F.col("b.z") - F.col("a.z"), 2))
    enough = F.col("observed") >= 3
    out = g.select(*keys, "observed", F.when(enough, F.coalesce("path", F.lit(0.0))).alias("path_length"),
                   F.when(enough, net).alias("net_displacement"))
    out = rows.select(*keys).distinct().join(out, keys, "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    p, n = F.col("path_length"), F.col("net_displacement")
    hint = (F.when(F.col("observed") < 3, "insufficient_3d_evidence")
            .when((n < 0.20) & (p < 0.35), "likely_static_relative_to_map")
            .when((n >= 0.50) | (p >= 0.80), "potentially_moving").otherwise("ambiguous_motion"))
    return out.withColumn("motion_hint", hint)


def round_robin(rows: DataFrame, group: str, sequence: str, order: list, n: int) -> DataFrame:
    """Take turns across the sequences of a group, best first, until n rows are chosen.

    Each sequence can contribute at most n rows, so both rankings are trimmed before any shuffle.
    """
    from spoorgrid.operators.chunks import top_n

    turn = top_n(rows, [group, sequence], order, n, "turn")
    return top_n(turn, [group], [F.col("turn"), F.col(sequence)], n, "position")


def diverse(rows: DataFrame, keys: list[str], frame: str, order: list[Column], n: int, gap: int) -> DataFrame:
    """Greedy selection of up to n rows per key in rank order, at least `gap` frames apart.

    A row that outranks every row left in its own and both neighbouring buckets of `gap` frames is a pick of the greedy
    scan, wherever it is, so all such rows are taken at once; what is too close to them leaves, and so does what n taken
    rows of its key outrank. The best row left is always among them, so n rounds are enough.
    Ties of the whole order are broken by the other columns.
    """
    from spoorgrid.operators.chunks import top_n
    from spoorgrid.session import cut

    names = rows.columns
    me = F.struct(F.struct(*order), *[c for c in names if c not in keys], F.monotonically_increasing_id().alias("_id"))
    rest = cut(rows.select(F.struct(*keys).alias("_key"), F.col(frame).alias("_frame"), F.floor(F.col(frame) / gap).alias("_bucket"), me.alias("_me")))
    around = F.explode(F.array(*[F.col("_bucket") + d for d in (-1, 0, 1)])).alias("_bucket")
    chosen = None
    for _ in range(n):
        best = rest.groupBy("_key", "_bucket").agg(F.max("_me").alias("_me"), F.max_by("_frame", "_me").alias("_frame"))
        seen = best.select("_key", "_me", "_frame", F.col("_bucket").alias("_home"), around).groupBy("_key", "_bucket").agg(
            F.max_by("_frame", "_me").alias("_frame"), F.max_by("_home", "_me").alias("_home"), F.max("_me").alias("_me"))
        taken = cut(seen.where(F.col("_home") == F.col("_bucket")).select("_key", "_frame", "_bucket", "_me"))
        chosen = cut(top_n(taken if chosen is None else chosen.drop("_nth").unionByName(taken), "_key", [F.desc("_me")], n, "_nth"))
        near = taken.select(F.col("_key").alias("_k"), F.col("_frame").alias("_f"), around).withColumnRenamed("_bucket", "_b")
        close = (F.col("_key") == F.col("_k")) & (F.col("_bucket") == F.col("_b")) & (F.abs(F.col("_frame") - F.col("_f")) < gap)
        last = chosen.where(F.col("_nth") == n).select("_key", F.col("_me").alias("_last"))
        rest = rest.join(near, close, "left_anti").join(last, "_key", "left")
        rest = cut(rest.where(F.col("_last").isNull() | (F.col("_me") > F.col("_last"))).select("_key", "_frame", "_bucket", "_me"))
        if rest.isEmpty():
            break
    return chosen.select(*[F.col(f"_key.{c}" if c in keys else f"_me.{c}").alias(c) for c in names])


def choose_controls(segments: DataFrame, frames: DataFrame, high: DataFrame, max_error: float = 0.10, away: int = 30,
                    chunk: int | None = None) -> DataFrame:
    """Control frame per error segment: low error, more than `away` frames off, same patch preferred,
    nearest, then lowest frame. Uses as-of joins in both directions, so segments never meet all frames.

    segments: sequence, anchor_frame, patch_id; frames: sequence, frame_idx, patch_id, position_error;
    high: sequence, frame_idx rows that may not serve as control.
    """
    from spoorgrid.operators.chunks import CHUNK_ROWS, events_around
    from spoorgrid.session import cut

    chunk = chunk or CHUNK_ROWS
    high = cut(high.select("sequence", "frame_idx"))  # one row per segment as well
    ok = frames.where(F.col("position_error") <= F.lit(float(max_error))).join(high, ["sequence", "frame_idx"], "left_anti")
    ok = ok.select("sequence", "patch_id", "frame_idx")
    out = cut(segments)  # one row per segment, read several times below
    for name, keys in (("same", ["sequence", "patch_id"]), ("any", ["sequence"])):
        out = events_around(out, ok, keys, "anchor_frame", "frame_idx", away + 1, f"_{name}_p", f"_{name}_n", chunk)

    def nearer(name):
        p, q = F.col(f"_{name}_p"), F.col(f"_{name}_n")
        return F.when(p.isNull(), q).when(q.isNull(), p).when(
            F.col("anchor_frame") - p <= q - F.col("anchor_frame"), p).otherwise(q)

    same, other = nearer("same"), nearer("any")
    return out.withColumn("control_frame", F.coalesce(same, other)).withColumn(
        "same_patch", same.isNotNull()).drop("_same_p", "_same_n", "_any_p", "_any_n")


def history_window(frames: DataFrame, keys: list[str], ordinal: str, window: int, max_jump: float) -> DataFrame:
    """The latest `window` frames (itself included, looking back 3 * window) within a jump of the current pose."""
    from spoorgrid.operators.chunks import top_n

    cur = frames.select(*keys, F.col(ordinal).alias("_o"), F.col("x").alias("_x"), F.col("y").alias("_y"),
                        F.explode(F.sequence(F.lit(0), F.lit(3 * window))).alias("back"))
    cur = cur.withColumn(ordinal, F.col("_o") - F.col("back"))
    j = cur.join(frames.select(*keys, ordinal, "x", "y"), [*keys, ordinal])
    gap = F.sqrt(F.pow(F.col("x") - F.col("_x"), 2) + F.pow(F.col("y") - F.col("_y"), 2))
    j = j.where(gap <= F.lit(float(max_jump))).withColumnRenamed(ordinal, "history").withColumnRenamed("_o", ordinal)
    return top_n(j, [*keys, ordinal], [F.col("back")], window).select(*keys, ordinal, "history", "rank")
