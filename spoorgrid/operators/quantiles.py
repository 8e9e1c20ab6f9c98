"""Exact linear-interpolated quantiles that never hold a whole group in one buffer, nor sort one.

The built-in exact `percentile` keeps every distinct value of a group in one aggregation buffer. Here values are counted per distinct
value, and each wanted rank has a range of values that holds it. While a range has more values than one task may sort, it is cut at
approximate quantiles, the values of its parts are counted, and only the parts with a wanted rank remain. The approximation balances
work and never touches a result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoorgrid.operators.chunks import CHUNK_ROWS, _keys
from spoorgrid.session import cut

#: Parts of a range in one round; larger tables take more rounds.
MOST_CUTS = 512


def _positions(probs: dict[str, float]) -> list:
    """The ranks that the quantiles lie between."""
    at = [(F.col("_n") - 1) * F.lit(float(p)) for p in probs.values()]
    return [rank for pos in at for rank in (F.floor(pos), F.ceil(pos))]


def _narrowed(counts: DataFrame, ranges: DataFrame, keys: list[str], value: str, probs: dict[str, float], parts: int) -> DataFrame:
    """The parts of the ranges that hold a wanted rank."""
    grid = [i / parts for i in range(1, parts)]
    inside = counts.join(ranges, keys).where(F.col(value).between(F.col("_low"), F.col("_high")))
    cuts = inside.groupBy(*keys, "_low").agg(F.percentile_approx(value, grid, 20 * parts).alias("_cuts"))
    inside = inside.join(cuts, [*keys, "_low"]).withColumn("_part", F.size(F.filter("_cuts", lambda c: c <= F.col(value))))
    sizes = inside.groupBy(*keys, "_low", "_part").agg(
        F.min(value).alias("_a"), F.max(value).alias("_b"), F.sum("_c").alias("_rows"), F.count("*").alias("_d"), F.max("_n").alias("_n"), F.max("_before").alias("_before"))
    up_to = F.sum("_rows").over(Window.partitionBy(*keys, "_low").orderBy("_part"))
    sizes = sizes.withColumn("_end", F.col("_before") + up_to).withColumn("_before", F.col("_end") - F.col("_rows"))
    held = F.exists(F.array(*_positions(probs)), lambda r: (r >= F.col("_before")) & (r < F.col("_end")))
    return sizes.where(held).select(*keys, F.col("_a").alias("_low"), F.col("_b").alias("_high"), "_d", "_n", "_before")


def exact_quantiles(df: DataFrame, keys, value: str, probs: dict[str, float], sort_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per key with a column per wanted quantile; keys without values are absent.

    No task sorts more than sort_rows values of a range.
    """
    named = _keys(keys)
    keys = named or ["_all"]
    given = df.where(F.col(value).isNotNull())
    given = given if named else given.withColumn("_all", F.lit(0))
    counts = cut(given.groupBy(*keys, value).agg(F.count("*").alias("_c")))
    ranges = counts.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.count("*").alias("_d"), F.sum("_c").alias("_n"))
    ranges = ranges.withColumn("_before", F.lit(0).cast("bigint"))
    while True:
        most = ranges.agg(F.max("_d")).first()[0] or 0
        if most <= sort_rows:
            break
        ranges = cut(_narrowed(counts, ranges, keys, value, probs, min(MOST_CUTS, 2 * -(-most // sort_rows))))
    kept = counts.join(ranges, keys).where(F.col(value).between(F.col("_low"), F.col("_high")))
    inside = Window.partitionBy(*keys, "_low").orderBy(value)
    kept = kept.withColumn("_hi", F.col("_before") + F.sum("_c").over(inside)).withColumn("_lo", F.col("_hi") - F.col("_c"))
    aggs = []
    for name, p in probs.items():
        pos = (F.col("_n") - 1) * F.lit(float(p))
        for side, rank in (("a", F.floor(pos)), ("b", F.ceil(pos))):
            hit = (rank >= F.col("_lo")) & (rank < F.col("_hi"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"_{side}_{name}"))
        aggs.append(F.max(pos - F.floor(pos)).alias(f"_f_{name}"))
    picked = kept.groupBy(*keys).agg(*aggs)
    return picked.select(*named, *[
        (F.col(f"_a_{n}") + (F.col(f"_b_{n}") - F.col(f"_a_{n}")) * F.col(f"_f_{n}")).alias(n) for n in probs])


def with_quantiles(summary: DataFrame, df: DataFrame, keys, value: str, probs: dict[str, float]) -> DataFrame:
    """Attach exact quantiles to an aggregate over the same keys."""
    keys = _keys(keys)
    q = exact_quantiles(df, keys, value, probs)
    if keys:
        return summary.join(q, keys, "left")
    return summary.withColumns({n: q.select(n).scalar() for n in probs})


def exact_quantiles_of(df: DataFrame, keys, wanted: dict[str, dict[str, float]]) -> DataFrame:
    """Quantiles of several columns in one pass: `wanted` maps a column to its {name: probability}."""
    keys = _keys(keys)
    rows = F.array(*[F.struct(F.lit(c).alias("_var"), F.col(c).cast("double").alias("_val")) for c in wanted])
    probs = sorted({p for w in wanted.values() for p in w.values()})
    q = exact_quantiles(df.select(*keys, F.inline(rows)), [*keys, "_var"], "_val", {f"_q{i}": p for i, p in enumerate(probs)})
    return q.groupBy(*keys).agg(*[F.max(F.when(F.col("_var") == c, F.col(f"_q{probs.index(p)}"))).alias(n)
                                  for c, w in wanted.items() for n, p in w.items()])
