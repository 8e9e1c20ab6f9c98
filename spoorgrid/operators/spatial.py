"""Range, radius, nearest and interval joins as bucketed equi-joins.

Nothing here pairs rows that are not close: both sides get bucket keys, the join is an equi-join that
Spark may broadcast (by its own size check), sort-merge, or split under skew, and an exact predicate
finishes the work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket(c, size) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c / F.lit(float(size))).cast("bigint")


def _spread(lo, hi, size) -> Column:
    return F.explode(F.sequence(_bucket(lo, size), _bucket(hi, size)))


def points_in_boxes(points: DataFrame, boxes: DataFrame, x: str, y: str, box: list[str], bucket: float,
                    keys: list[str] | None = None, how: str = "inner") -> DataFrame:
    """Boxes that cover a point, bounds inclusive. `bucket` near the box size keeps copies to a few per box."""
    keys = keys or []
    x0, x1, y0, y1 = box
    b = boxes.withColumn("_bx", _spread(x0, x1, bucket)).withColumn("_by", _spread(y0, y1, bucket))
    p = points.withColumn("_bx", _bucket(x, bucket)).withColumn("_by", _bucket(y, bucket))
    same = (p["_bx"] == b["_bx"]) & (p["_by"] == b["_by"])
    for k in keys:
        same = same & (p[k] == b[k])
    cover = (p[x] >= b[x0]) & (p[x] <= b[x1]) & (p[y] >= b[y0]) & (p[y] <= b[y1])
    out = p.join(b, same & cover, how)
    return out.select(*[p[c] for c in points.columns], *[b[c] for c in boxes.columns if c not in keys])


def nearest_site(points: DataFrame, sites: DataFrame, point_key: list[str], x: str, y: str, site_id: str,
                 sx: str, sy: str, cell: float) -> DataFrame:
    """Nearest site of every point without a distance limit; ties go to the lowest id.

    A pyramid of grids (cell, 2*cell, ...) finds the finest level at which the 3x3 neighbourhood of the
    point holds a site. That site is at most 2*sqrt(2) cells away, so the neighbourhood two levels up holds
    the nearest one. Points therefore only meet sites at their own scale. The top level follows from the joint
    bounds of both sides: two above the one whose cells span them all. Without sites the result is empty.
    """
    ends = [f(c) for c in (x, y) for f in (F.min, F.max)]
    site_ends = [f(c) for c in (sx, sy) for f in (F.min, F.max)]
    spans = [r for r in (points.agg(*ends).first(), sites.agg(*site_ends).first()) if r[0] is not None]
    extent = max([max(float(r[i + 1]) for r in spans) - min(float(r[i]) for r in spans) for i in (0, 2)], default=0.0)
    levels = max(0, math.ceil(math.log2(max(extent, cell) / cell))) + 3
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    size = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("_l"))
    every = F.explode(F.sequence(F.lit(0), F.lit(levels)))
    s = sites.select(F.col(site_id).alias("_id"), F.col(sx).cast("double").alias("_sx"),
                     F.col(sy).cast("double").alias("_sy")).withColumn("_l", every)
    s = s.withColumn("_n", F.explode(near)).select(
        "_id", "_sx", "_sy", "_l", (F.floor(F.col("_sx") / size) + F.col("_n.i")).alias("_cx"),
        (F.floor(F.col("_sy") / size) + F.col("_n.j")).alias("_cy"))
    p = points.select(*point_key, F.col(x).alias("_px"), F.col(y).alias("_py"))
    at = p.withColumn("_l", every).withColumns({"_cx": F.floor(F.col("_px") / size), "_cy": F.floor(F.col("_py") / size)})
    level = (at.join(s.select("_l", "_cx", "_cy").distinct(), ["_l", "_cx", "_cy"])
               .groupBy(*point_key, "_px", "_py").agg(F.least(F.min("_l") + 2, F.lit(levels)).alias("_l")))
    level = level.withColumns({"_cx": F.floor(F.col("_px") / size), "_cy": F.floor(F.col("_py") / size)})
    dx, dy = F.col("_px") - F.col("_sx"), F.col("_py") - F.col("_sy")
    pairs = level.join(s, ["_l", "_cx", "_cy"]).withColumn("_d2", dx * dx + dy * dy)
    best = F.min(F.struct("_d2", "_id")).alias("_b")
    return pairs.groupBy(*point_key).agg(best).select(
        *point_key, F.col("_b._id").alias(site_id), F.sqrt("_b._d2").alias("distance"))


def assign_patch(points: DataFrame, tiles: DataFrame, point_key: list[str], x: str, y: str, size: float) -> DataFrame:
    """Truth patch: nearest centre among covering patches, else nearest centre overall; lowest id on ties."""
    pick = tiles.select("patch_id", "bx0", "bx1", "by0", "by1", "center_x", "center_y")
    cov = points_in_boxes(points.select(*point_key, x, y), pick, x, y, ["bx0", "bx1", "by0", "by1"], size)
    dx, dy = F.col("center_x") - F.col(x), F.col("center_y") - F.col(y)
    inside = cov.withColumn("_d2", dx * dx + dy * dy).groupBy(*point_key).agg(
        F.min(F.struct("_d2", "patch_id")).alias("_b")).select(
        *point_key, F.col("_b.patch_id").alias("patch_id"), F.lit(True).alias("covered"))
    outside = nearest_site(points.join(inside, point_key, "left_anti"), tiles, point_key, x, y, "patch_id",
                           "center_x", "center_y", size)
    return inside.unionByName(outside.select(*point_key, "patch_id", F.lit(False).alias("covered")))


def within_radius(left: DataFrame, right: DataFrame, lx: str, ly: str, rx: str, ry: str, radius: float) -> DataFrame:
    """Pairs within a planar radius (inclusive), with `d2`. Right rows are copied to nine buckets."""
    r = right.withColumn("_bx", _spread(F.col(rx) - radius, F.col(rx) + radius, radius)).withColumn(
        "_by", _spread(F.col(ry) - radius, F.col(ry) + radius, radius))
    p = left.withColumn("_bx", _bucket(lx, radius)).withColumn("_by", _bucket(ly, radius))
    dx, dy = F.col(lx) - F.col(rx), F.col(ly) - F.col(ry)
    out = p.join(r, ["_bx", "_by"]).withColumn("d2", dx * dx + dy * dy)
    return out.where(F.col("d2") <= F.lit(float(radius) ** 2)).drop("_bx", "_by")


SMALL_TARGETS = 100_000  # a target of fewer rows goes to the tasks that hold the points
BLOCK_ROWS = 500_000     # points, and targets, that a group of a block holds
CANDIDATES = 2_000_000   # pairs compared at once


def small_targets(target: DataFrame, target_cols: list[str], t=("tx", "ty", "tz")) -> pa.Table | None:
    """The columns that `nearest_within` takes from a small target, for use in several calls; None for a larger one."""
    rows = target.select(*dict.fromkeys([*t, *target_cols])).dropna(subset=list(t))
    return rows.toArrow() if rows.count() <= SMALL_TARGETS else None


def nearest_within(query: DataFrame, target: DataFrame, query_key: list[str], target_cols: list[str],
                   cutoff: float, q=("x", "y", "z"), t=("tx", "ty", "tz"), small: pa.Table | None = None) -> DataFrame:
    """Nearest 3-D target of each query point within a cut-off; ties go to the smallest target columns.

    Points meet targets in blocks of four cut-offs, to which targets come from one cut-off around; where a block holds many rows, its points are
    dealt to lanes and its targets to parts, so that a task's group is bounded. A small target (`small`, if the caller has it already) goes to
    the points instead, which then stay where they are. Inside, grids from fine to the cut-off are tried until one holds a near target.
    """
    own, rest = query.columns, [c for c in query.columns if c not in query_key]
    taken = list(dict.fromkeys([*t, *target_cols]))
    points = query.dropna(subset=list(dict.fromkeys([*query_key, *q])))
    kinds, made = dict(target.dtypes), [f"_n_{c}" for c in target_cols]
    ddl = ", ".join([f"`{c}` {k}" for c, k in query.dtypes] + ["_d2 double"] + [f"`{n}` {kinds[c]}" for n, c in zip(made, target_cols)])
    small = small if small is not None else small_targets(target, target_cols, t)

    def found(left: pa.Table, near: _Nearest) -> pa.Table:
        d2, at = near(np.column_stack([left.column(c).to_numpy().astype(np.float64) for c in q]))
        hit = np.flatnonzero(at >= 0)
        out = left.select(own).take(pa.array(hit))
        out = out.append_column("_d2", pa.array(d2[hit]))
        for n, c in zip(made, target_cols):
            out = out.append_column(n, near.rows.column(c).take(pa.array(at[hit])))
        return out

    if small is not None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near = _Nearest(small, t, target_cols, cutoff)
            for b in batches:
                yield from found(pa.Table.from_batches([b]), near).combine_chunks().to_batches()

        return _first_of(points.mapInArrow(run, ddl), query_key, rest, made, target_cols)
    size, reach = 4.0 * cutoff, 1.0001 * cutoff
    block = ["_b0", "_b1", "_b2"]
    points = points.withColumns({b: _bucket(c, size) for b, c in zip(block, q)})
    targets = target.select(*taken).dropna(subset=list(t))
    for b, c in zip(block, t):
        targets = targets.withColumn(b, _spread(F.col(c) - reach, F.col(c) + reach, size))
    lanes, parts = (d.groupBy(*block).agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("bigint").alias(c)).where(F.col(c) > 1)
                    for d, c in ((points, "_lanes"), (targets, "_parts")))
    crowded = lanes.join(parts, block, "full").select(*block, *[F.coalesce(c, F.lit(1).cast("bigint")).alias(c) for c in ("_lanes", "_parts")]).collect()
    points = points.withColumn("_h", F.xxhash64(*own))
    if crowded:  # one row for each crowded block, and of those there are few
        many = F.broadcast(query.sparkSession.createDataFrame(crowded, "_b0 bigint, _b1 bigint, _b2 bigint, _lanes bigint, _parts bigint"))
        points, targets = (d.join(many, block, "left").fillna(1, ["_lanes", "_parts"]) for d in (points, targets))
        points = points.withColumns({"_lane": F.pmod("_h", "_lanes"), "_part": F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1))})
        targets = targets.withColumns({"_part": F.pmod(F.xxhash64(*taken), "_parts"), "_lane": F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_lanes") - 1))})
        block = [*block, "_lane", "_part"]

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        hashes = left.column("_h").to_numpy()
        if len(np.unique(hashes)) < len(hashes):  # a row that comes twice counts once
            left = pa.Table.from_pandas(left.to_pandas(integer_object_nulls=True).drop_duplicates(own), left.schema, preserve_index=False)
        return found(left, _Nearest(right, t, target_cols, cutoff))

    pairs = points.select(*own, "_h", *block).groupBy(*block).cogroup(targets.select(*taken, *block).groupBy(*block)).applyInArrow(tile, ddl)
    if rest or any(r["_parts"] > 1 for r in crowded):
        return _first_of(pairs, query_key, rest, made, target_cols)
    return pairs.select(*query_key, F.col("_d2").alias("d2"), *[F.col(n).alias(c) for n, c in zip(made, target_cols)])


def _first_of(pairs: DataFrame, query_key: list[str], rest: list[str], made: list[str], target_cols: list[str]) -> DataFrame:
    best = pairs.groupBy(*query_key).agg(F.min(F.struct("_d2", *made, *rest)).alias("_b"))
    return best.select(*query_key, F.col("_b._d2").alias("d2"), *[F.col(f"_b.{n}").alias(c) for n, c in zip(made, target_cols)], *[F.col(f"_b.{c}").alias(c) for c in rest])


class _Nearest:
    """Nearest of the rows of a table; a position that comes twice is held once, by its smallest columns."""

    def __init__(self, table: pa.Table, t, columns: list[str], cutoff: float):
        self.rows = table.take(pc.sort_indices(table, [(c, "ascending") for c in columns], null_placement="at_start")) if columns else table
        xyz = np.column_stack([self.rows.column(c).to_numpy().astype(np.float64) for c in t])
        order = np.lexsort(xyz.T)
        kept = np.ones(len(order), dtype=bool)
        kept[1:] = (xyz[order[1:]] != xyz[order[:-1]]).any(axis=1)
        self.at = order[kept]  # the sort is stable, so the first of equal positions is the smallest row
        self.xyz, self.limit, self.grids = xyz[self.at], float(cutoff) ** 2, []
        size, sure = 1.001 * cutoff, self.limit
        while len(self.at):
            self.grids.append(_Grid(self.xyz, size, sure))
            if self.grids[-1].crowding <= 2 or len(self.grids) > 10 or self.grids[-1].cells > 2 ** 58:
                break
            size /= 2
            sure = (0.99 * size) ** 2

    def __call__(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distance and row of the nearest one of each point; a row of -1 where none is near."""
        best, row = np.full(len(points), np.inf), np.full(len(points), -1, dtype=np.int64)
        left = np.flatnonzero(np.isfinite(points).all(axis=1))
        for grid in reversed(self.grids):
            done = np.zeros(len(left), dtype=bool)
            for at in range(0, len(left), 16384):
                some = left[at:at + 16384]
                for part, lo, n in grid.around(points[some]):
                    d2, pick = self._least(points[some[part]], grid, lo, n)
                    near = d2 <= grid.sure
                    best[some[part[near]]], row[some[part[near]]] = d2[near], pick[near]
                    done[at + part[near]] = True
            left = left[~done]
        return best, row

    def _least(self, points: np.ndarray, grid: _Grid, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = n.sum(axis=1)
        ends = np.cumsum(n.ravel())
        i = grid.order[np.repeat(lo.ravel() - (ends - n.ravel()), n.ravel()) + np.arange(ends[-1])]
        of, starts = np.repeat(np.arange(len(points)), total), np.cumsum(total) - total
        dx, dy, dz = (points[of, a] - self.xyz[i, a] for a in range(3))
        d2 = dx * dx + dy * dy + dz * dz
        least = np.minimum.reduceat(d2, starts)
        pick = np.minimum.reduceat(np.where(d2 == least[of], self.at[i], np.iinfo(np.int64).max), starts)
        return least, pick


class _Grid:
    """Targets by cell; `crowding`: how many a cell that has any holds on average."""

    def __init__(self, xyz: np.ndarray, size: float, sure: float):
        self.size, self.sure = size, sure
        cell = np.floor(xyz / size)
        self.low = cell.min(axis=0) - 2
        self.shape = (cell.max(axis=0) - self.low + 3).astype(np.int64)
        code = self._code((cell - self.low).astype(np.int64))
        self.order = np.argsort(code, kind="stable")
        self.code = code[self.order]
        self.crowding = len(code) / (1 + np.count_nonzero(np.diff(self.code)))
        self.cells = math.prod(self.shape.tolist())
        few = self.cells <= 4 * len(code) + 100_000
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.code, minlength=self.cells + 1))]) if few else None

    def _code(self, cell: np.ndarray) -> np.ndarray:
        return (cell[:, 0] * self.shape[1] + cell[:, 1]) * self.shape[2] + cell[:, 2]

    def _start(self, code: np.ndarray) -> np.ndarray:
        return self.first[code] if self.first is not None else np.searchsorted(self.code, code)

    def around(self, points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Points that have targets in the cells around theirs, with the starts and lengths of nine runs of three cells, a bounded number of pairs at a time."""
        cell = np.floor(points / self.size) - self.low
        inside = np.flatnonzero(((cell >= 1) & (cell <= self.shape - 2)).all(axis=1))
        code = self._code(cell[inside].astype(np.int64))
        runs = [code + (i * self.shape[1] + j) * self.shape[2] for i in (-1, 0, 1) for j in (-1, 0, 1)]
        lo = np.stack([self._start(r - 1) for r in runs], axis=1)
        n = np.stack([self._start(r + 2) for r in runs], axis=1) - lo
        total = n.sum(axis=1)
        some = np.flatnonzero(total)
        cuts = np.cumsum(total[some]) // CANDIDATES
        for part in np.split(some, np.flatnonzero(np.diff(cuts)) + 1):
            if len(part):
                yield inside[part], lo[part], n[part]


def in_time_window(left: DataFrame, right: DataFrame, keys: list[str], lt: str, rt: str, before: float,
                   after: float, totals: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Right rows with rt in [lt - before, lt + after], inclusive; bucketed by time within the keys.

    With `totals` (name -> ("count", "sum", "min" or "max", right column)) no pairs are made: left rows come back with totals of parts of
    their window, two or three rows each, to be combined by whatever the caller groups by. The work is linear in both sides however dense.
    """
    if totals is not None:
        return _window_totals(left, right, keys, lt, rt, before, after, totals)
    width = max(before + after, 1.0e-9)
    a = left.withColumn("_tb", _spread(F.col(lt) - before, F.col(lt) + after, width))
    b = right.withColumn("_tb", _bucket(rt, width))
    out = a.join(b, [*keys, "_tb"])
    return out.where((F.col(rt) >= F.col(lt) - before) & (F.col(rt) <= F.col(lt) + after)).drop("_tb")


def _window_totals(left, right, keys, lt, rt, before, after, totals) -> DataFrame:
    """A window is longer than a bucket, so it is the end of one, the start of a later one and whole buckets in between."""
    if before + after <= 0:
        raise ValueError("totals need a window of some length")
    width = 0.9 * (before + after)
    add = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    known = [F.col(k).isNotNull() for k in keys]
    value = {n: F.count(c) if how == "count" else add[how](c) for n, (how, c) in totals.items()}
    b = right.withColumn("_tb", _bucket(rt, width)).withColumn("_at", F.col(rt).cast("double"))
    b = b.groupBy(*keys, "_tb", "_at").agg(*[v.alias(n) for n, v in value.items()]).where(F.col("_at").isNotNull() & ~F.isnan("_at"))
    lo, hi = F.col(lt) - before, F.col(lt) + after
    a = left.withColumns({"_lo": _bucket(lo, width), "_hi": _bucket(hi, width)}).where(F.col(lt).isNotNull() & ~F.isnan(F.col(lt).cast("double")))
    for k in known:
        a, b = a.where(k), b.where(k)
    row = F.struct(*left.columns).alias("_row")
    ends = a.select(*keys, row, F.inline(F.array(F.struct(F.col("_lo").alias("_tb"), lo.alias("_at"), F.lit(1).alias("_kind")),
                                                 F.struct(F.col("_hi").alias("_tb"), hi.alias("_at"), F.lit(2).alias("_kind")))))
    line = ends.unionByName(b.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    bucket = Window.partitionBy(*keys, "_tb")
    first = Window.unboundedPreceding
    rest, past = (bucket.orderBy(t, "_kind").rowsBetween(first, 0) for t in (F.desc("_at"), F.asc("_at")))
    part = {n: F.when(F.col("_kind") == 1, add[how](n).over(rest)).otherwise(add[how](n).over(past)) for n, (how, _) in totals.items()}
    ends = line.select("_kind", "_row", *[v.alias(n) for n, v in part.items()]).where("_kind > 0").select("_row.*", *totals)
    whole = b.groupBy(*keys, "_tb").agg(*[add[how](n).alias(n) for n, (how, _) in totals.items()])
    inner = a.where("_hi - _lo > 1").withColumn("_tb", F.explode(F.sequence(F.col("_lo") + 1, F.col("_hi") - 1)))
    return ends.unionByName(inner.join(whole, [*keys, "_tb"]).select(*left.columns, *totals))


def nearest_future(rows: DataFrame, keys: list[str], t: str, horizon: float, tolerance: float,
                   take: list[str], prefix: str = "future_") -> DataFrame:
    """For each row the later row of the same key nearest to t + horizon within a tolerance.

    Keys are joined together with a time bucket, so one long key spreads over many tasks. Rows without
    such a partner are absent.
    """
    other = rows.select(*keys, F.col(t).alias("_ft"), *[F.col(c).alias(prefix + c) for c in take])
    goal = rows.withColumn("_goal", F.col(t) + F.lit(float(horizon)))
    pairs = in_time_window(goal, other, keys, "_goal", "_ft", tolerance, tolerance).where(F.col("_ft") > F.col(t))
    gap = F.abs(F.col("_ft") - F.col("_goal"))
    names = [prefix + c for c in take]
    best = pairs.groupBy(*keys, *[c for c in rows.columns if c not in keys]).agg(
        F.min_by(F.struct(F.col("_ft").alias("t"), *names), F.struct(gap, F.col("_ft"))).alias("_b"))
    return best.select(*rows.columns, F.col("_b.t").alias(prefix + t), *[F.col(f"_b.{n}").alias(n) for n in names])


def band_neighbours(sites: DataFrame, site_id: str, x: str, y: str, lo: float, hi: float, n: int) -> DataFrame:
    """For each site its n nearest others at a distance in [lo, hi], ranked; lowest id on ties."""
    from spoorgrid.operators.chunks import top_n

    a = sites.select(F.col(site_id).alias("site"), F.col(x).alias("_ax"), F.col(y).alias("_ay"))
    b = sites.select(F.col(site_id).alias("other"), F.col(x).alias("_bx0"), F.col(y).alias("_by0"))
    pairs = within_radius(a, b, "_ax", "_ay", "_bx0", "_by0", hi).where(F.col("site") != F.col("other"))
    pairs = pairs.where(F.sqrt("d2") >= F.lit(float(lo)))
    return top_n(pairs, ["site"], [F.col("d2"), F.col("other")], n).select("site", "other", "rank")


def negative_patches(frames: DataFrame, sites: DataFrame, frame_key: list[str], truth: str, seed: Column,
                     lo: float, hi: float, n_hard: int, n_random: int, n_total: int) -> DataFrame:
    """Hard negatives (nearest in a distance band), then pseudo-random others, up to n_total per frame.

    The random part walks the id range from a seeded start by a stride coprime to its length, so it is a
    permutation prefix: no frame is ever paired with all patches. Site ids must be 0..P-1.
    """
    p = sites.agg(F.count("*").alias("n")).scalar()
    hard = band_neighbours(sites, "patch_id", "center_x", "center_y", lo, hi, n_hard)
    per_site = hard.groupBy("site").agg(F.sort_array(F.collect_list(F.struct("rank", "other"))).alias("_h"))
    out = frames.withColumn("_p", p).join(per_site, frames[truth] == F.col("site"), "left")
    hard_ids = F.transform(F.coalesce(F.col("_h"), F.array()), lambda h: h["other"].cast("bigint"))
    stride = F.lit(2147483647)
    steps = F.sequence(F.lit(0), F.least(F.lit(n_hard + n_random), F.col("_p") - 1).cast("int"))
    start = F.pmod(seed * F.lit(1103515245) + F.lit(12345), F.col("_p"))
    walk = F.transform(steps, lambda j: F.pmod(start + j.cast("bigint") * stride, F.col("_p")))
    out = out.withColumns({"_hard": hard_ids, "_walk": walk})
    fresh = F.filter("_walk", lambda w: (w != F.col(truth)) & ~F.array_contains("_hard", w))
    out = out.withColumn("_ids", F.concat("_hard", F.slice(fresh, 1, n_random)))
    start2 = F.pmod((seed + 17) * F.lit(1103515245) + F.lit(12345), F.col("_p") - 1)
    fill = F.transform(F.sequence(F.lit(0), F.lit(n_total)), lambda j: F.pmod(
        F.col(truth) + 1 + F.pmod(start2 + j.cast("bigint") * stride, F.col("_p") - 1), F.col("_p")))
    out = out.withColumn("_ids", F.slice(F.concat("_ids", F.when(F.col("_p") > 1, fill).otherwise(F.array())), 1, n_total))
    return out.select(*frame_key, truth, F.posexplode("_ids").alias("slot", "negative_id"))
