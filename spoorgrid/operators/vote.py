"""Repeated-observation maps: two-stage dominant vote, stability scores, cross-store comparison."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorgrid.functions.cells import label_group

CELL = ["ix", "iy"]


def dominant_per_frame(points: DataFrame, frame_keys: list[str], category: str, minimum: int,
                       cell=("ix", "iy")) -> DataFrame:
    """Stage one: the most frequent category of every (frame, cell), lowest id on ties.

    Categories below `minimum` do not vote (0 keeps every group, 1 drops the void label).
    """
    counts = points.where(F.col(category) >= minimum).groupBy(*frame_keys, *cell, category).agg(F.count("*").alias("_n"))
    return dominant(counts, [*frame_keys, *cell], category)


def dominant(counts: DataFrame, keys: list[str], category: str) -> DataFrame:
    """The category with the largest `_n` of each key, lowest id on ties."""
    order = F.struct(F.col("_n"), -F.col(category).cast("bigint"))
    return counts.groupBy(*keys).agg(F.max_by(category, order).cast("int").alias(category))


def group_store(points: DataFrame, store_keys: list[str], frame_keys: list[str], group: str = "grp") -> DataFrame:
    """Cell store: frames that observed the cell and how many voted for each group."""
    votes = dominant_per_frame(points, [*store_keys, *frame_keys], group, 0)
    return votes.groupBy(*store_keys, *CELL).agg(
        F.count("*").alias("observed"), F.count_if(F.col(group) == 0).alias("n_static"),
        F.count_if(F.col(group) == 1).alias("n_semi"), F.count_if(F.col(group) == 2).alias("n_dynamic"))


def label_store(points: DataFrame, store_keys: list[str], frame_keys: list[str], label: str = "label") -> DataFrame:
    """Long label histogram: frames per (cell, dominant label); label 0 does not vote."""
    votes = dominant_per_frame(points, [*store_keys, *frame_keys], label, 1)
    return votes.groupBy(*store_keys, *CELL, label).agg(F.count("*").alias("n"))


def merge_stores(*stores: DataFrame) -> DataFrame:
    """Sum several cell stores by cell."""
    out = stores[0]
    for s in stores[1:]:
        out = out.unionByName(s)
    names = ["observed", "n_static", "n_semi", "n_dynamic"]
    return out.groupBy(*CELL).agg(*[F.sum(n).alias(n) for n in names])


def stability(min_observations: float, prefix: str = "") -> Column:
    """(static + semi / 2) / total, discounted while a cell has few observations."""
    obs, st, se, dy = (F.col(prefix + n).cast("double") for n in ("observed", "n_static", "n_semi", "n_dynamic"))
    total = F.greatest(st + se + dy, F.lit(1.0))
    return (st + 0.5 * se) / total * (1.0 - F.exp(-obs / F.lit(max(float(min_observations), 1.0))))


def heuristic_stability(min_observations: float = 6.0, prefix: str = "") -> Column:
    """The learning table's variant: normalised by observations (at least one)."""
    obs = F.greatest(F.col(prefix + "observed").cast("double"), F.lit(1.0))
    st, se = F.col(prefix + "n_static"), F.col(prefix + "n_semi")
    return (st + 0.5 * se) / obs * (1.0 - F.exp(-obs / F.lit(float(min_observations))))


def dominant_group(prefix: str = "") -> Column:
    """Group with most votes, lowest on ties."""
    st, se, dy = (F.col(prefix + n) for n in ("n_static", "n_semi", "n_dynamic"))
    return F.when((st >= se) & (st >= dy), 0).when(se >= dy, 1).otherwise(2)


def store_consistency(first: DataFrame, second: DataFrame, min_observations: int) -> DataFrame:
    """Shared cells, cells with enough observations on both sides, dominant agreement, mean score change."""
    a = first.select(*CELL, *[F.col(c).alias("a_" + c) for c in ("observed", "n_static", "n_semi", "n_dynamic")])
    b = second.select(*CELL, *[F.col(c).alias("b_" + c) for c in ("observed", "n_static", "n_semi", "n_dynamic")])
    both = a.join(b, CELL)
    ok = (F.col("a_observed") >= min_observations) & (F.col("b_observed") >= min_observations)
    same = (dominant_group("a_") == dominant_group("b_")).cast("double")
    change = F.abs(stability(min_observations, "a_") - stability(min_observations, "b_"))
    return both.agg(F.count("*").alias("shared_cells"), F.count_if(ok).alias("eligible_cells"),
                    F.avg(F.when(ok, same)).alias("dominant_agreement"), F.avg(F.when(ok, change)).alias("mean_change"))


def map_lookup(groups: DataFrame, labels: DataFrame, min_observations: float, label: str = "label") -> DataFrame:
    """Per cell: evidence, dominant group, stability and dominant label (0 when no label voted)."""
    dom = labels.groupBy(*CELL).agg(F.max_by(label, F.struct(F.col("n"), -F.col(label))).alias("dominant_label"))
    out = groups.select(*CELL, F.col("observed").alias("evidence"), dominant_group().alias("dominant_group"),
                        stability(min_observations).alias("stability"))
    return out.join(dom, CELL, "left").withColumn("dominant_label", F.coalesce("dominant_label", F.lit(0)))


def label_probabilities(labels: DataFrame, label: str = "label") -> DataFrame:
    """Share of each label in its cell (at most 16 labels per cell)."""
    total = labels.groupBy(*CELL).agg(F.sum("n").alias("_t"))
    return labels.join(total, CELL).withColumn("p", F.col("n") / F.col("_t")).drop("_t")


def cell_features(store: DataFrame) -> DataFrame:
    """Seven channels per observed cell: flag, log count, group shares, stability, entropy."""
    top = store.agg(F.greatest(F.log1p(F.max("observed").cast("double")), F.lit(1.0)).alias("m")).scalar()
    obs = F.col("observed").cast("double")
    shares = [F.col(n) / obs for n in ("n_static", "n_semi", "n_dynamic")]
    entropy = -sum((p * F.log(F.greatest(p, F.lit(1.0e-8))) for p in shares[1:]),
                   shares[0] * F.log(F.greatest(shares[0], F.lit(1.0e-8)))) / F.lit(math.log(3.0))
    out = store.withColumn("_top", top)
    values = [F.lit(1.0), F.log1p(obs) / F.col("_top"), *shares, heuristic_stability(6.0), entropy]
    seen = obs > 0
    return out.select(*store.columns, *[F.when(seen, v).otherwise(0.0).alias(f"f{i}") for i, v in enumerate(values)])


def future_target(before: str = "a_", after: str = "b_", min_observations: float = 6.0) -> Column:
    """Later reliability x support x agreement with the earlier distribution."""
    ob = F.greatest(F.col(before + "observed").cast("double"), F.lit(1.0))
    oa = F.greatest(F.col(after + "observed").cast("double"), F.lit(1.0))
    names = ("n_static", "n_semi", "n_dynamic")
    pb, pa = [F.col(before + n) / ob for n in names], [F.col(after + n) / oa for n in names]
    agree = pb[0] * pa[0] + pb[1] * pa[1] + pb[2] * pa[2]
    return (pa[0] + 0.5 * pa[1]) * (1.0 - F.exp(-oa / F.lit(float(min_observations)))) * agree


def neighbourhood(cells: DataFrame, lookup: DataFrame, radius: int, values: list[str]) -> DataFrame:
    """(2r+1)^2 neighbour rows per cell with looked-up values; missing neighbours carry zeros."""
    if radius < 0:
        raise ValueError("radius must be non-negative")
    side = range(-radius, radius + 1)
    steps = F.array(*[F.struct(F.lit(i).alias("ox"), F.lit(j).alias("oy")) for i in side for j in side])
    out = cells.select(*CELL, F.inline(steps))
    n = lookup.select(F.col("ix").alias("_nx"), F.col("iy").alias("_ny"), *values)
    out = out.withColumns({"_nx": F.col("ix") + F.col("ox"), "_ny": F.col("iy") + F.col("oy")})
    out = out.join(n, ["_nx", "_ny"], "left")
    return out.select(*CELL, "ox", "oy", *[F.coalesce(v, F.lit(0.0)).alias(v) for v in values])


def feature_patches(cells: DataFrame, features: DataFrame, radius: int, channels: int = 7) -> DataFrame:
    """One ARRAY<DOUBLE> per cell: channel-major (2r+1)^2 grid of neighbour features. Bounded by the radius."""
    names = [f"f{i}" for i in range(channels)]
    n = neighbourhood(cells, features, radius, names)
    packed = n.groupBy(*CELL).agg(F.sort_array(F.collect_list(F.struct("ox", "oy", *names))).alias("_p"))
    def channel(name):
        return F.transform("_p", lambda s: s[name])

    return packed.select(*CELL, F.concat(*map(channel, names)).alias("features"))


def learning_table(initial: DataFrame, updated: DataFrame, min_before: int, min_gain: int, block: int = 8,
                   group: int = 1) -> DataFrame:
    """Cells with enough observations before and gained later, with target, heuristic and block split."""
    from spoorgrid.functions.cells import spatial_block_is_validation

    names = ("observed", "n_static", "n_semi", "n_dynamic")
    a = initial.select(*CELL, *[F.col(c).alias("a_" + c) for c in names])
    u = updated.select(*CELL, *[F.col(c).alias("u_" + c) for c in names])
    j = a.join(u, CELL)
    for n in names:
        j = j.withColumn("b_" + n, F.greatest(F.col("u_" + n) - F.col("a_" + n), F.lit(0)))
    j = j.where((F.col("a_observed") >= min_before) & (F.col("b_observed") >= min_gain))
    return j.select(*CELL, *[F.col("a_" + n).alias(n) for n in names], future_target().alias("target"),
                    heuristic_stability(6.0, "a_").alias("heuristic"), F.col("b_observed").alias("gained"),
                    spatial_block_is_validation("ix", "iy", block, group).alias("validation"))


def with_groups(points: DataFrame, label: str = "label") -> DataFrame:
    return points.withColumn("grp", label_group(label))
