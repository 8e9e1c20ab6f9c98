"""Connected components of label pixels and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorgrid.operators.quantiles import exact_quantiles, exact_quantiles_of
from spoorgrid.session import cut

IMAGE = ["sequence", "frame_idx", "camera"]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One alternating-star step. Minima come from an aggregate and a join, so no neighbourhood is collected."""
    both = edges if not large else edges.unionByName(edges.select(*IMAGE, F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy(*IMAGE, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    out = both.join(low, [*IMAGE, "a"])
    if large:
        out = out.where(F.col("b") > F.col("a")).select(*IMAGE, F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        linked = out.select(*IMAGE, F.col("b").alias("a"), F.col("m").alias("b"))
        own = low.select(*IMAGE, "a", F.col("m").alias("b"))
        out = linked.unionByName(own)
    return out.where(F.col("a") != F.col("b")).distinct()


def connected_components(pixels: DataFrame) -> DataFrame:
    """Add `component` (smallest pixel code of the 8-connected component of equal label within the image).

    All images run together; rounds are logarithmic in the component diameter and each one is written to
    reliable storage, so a lost executor costs one round at most.
    """
    node = F.col("v").cast("bigint") * 1000000 + F.col("u")
    nodes = pixels.withColumn("a", node)
    steps = F.array(*[F.struct(F.lit(i).alias("du"), F.lit(j).alias("dv")) for i, j in ((1, 0), (-1, 1), (0, 1), (1, 1))])
    ahead = nodes.select(*IMAGE, "label", "a", "u", "v", F.inline(steps))
    ahead = ahead.select(*IMAGE, "label", F.col("a").alias("b"), (F.col("u") + F.col("du")).alias("u"),
                         (F.col("v") + F.col("dv")).alias("v"))
    edges = cut(ahead.join(nodes.select(*IMAGE, "label", "u", "v", "a"), [*IMAGE, "label", "u", "v"])
                     .select(*IMAGE, "a", "b"))
    print_key = [F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("bigint")).alias("h")]
    before = None
    while True:
        edges = cut(_star(_star(edges, True), False))
        now = edges.agg(*print_key).first()
        if now == before:
            break
        before = now
    root = edges.select(*IMAGE, "a", F.col("b").alias("_root"))
    return nodes.join(root, [*IMAGE, "a"], "left").withColumn("component", F.coalesce("_root", "a")).drop("a", "_root")


def component_stats(pixels: DataFrame, minimum: int, depth: tuple = (0.2, 12.0)) -> DataFrame:
    """Area, bounding box, valid-depth share and median depth per component of at least `minimum` pixels."""
    keys = [*IMAGE, "label", "component"]
    valid = F.col("depth").between(*depth)
    out = pixels.groupBy(*keys).agg(
        F.count("*").alias("pixel_area"), F.min("u").alias("bbox_x"), F.min("v").alias("bbox_y"),
        (F.max("u") - F.min("u") + 1).alias("bbox_width"), (F.max("v") - F.min("v") + 1).alias("bbox_height"),
        F.avg(valid.cast("double")).alias("valid_depth_ratio"), F.count_if(valid).alias("valid_depth_pixels"))
    out = out.where(F.col("pixel_area") >= minimum)
    med = exact_quantiles(pixels.where(valid), keys, "depth", {"median_depth": 0.5})
    return out.join(med, keys, "left")


def evenly_spaced(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """At most n rows per key at truncated evenly spaced positions of the order (all rows of small keys).

    A component is bounded by its image, so its own window is bounded as well.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys)
    out = rows.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    # position i is the j-th sample where j is the only integer with floor(j * (n_rows - 1) / (n - 1)) = i
    step = (F.col("_n") - 1) / F.lit(float(max(n - 1, 1)))
    j = F.ceil(F.col("_i") / step - 1.0e-9)
    keep = (F.col("_n") <= n) | ((j <= n - 1) & (F.floor(j * step + 1.0e-9) == F.col("_i")))
    return out.where(keep).drop("_i", "_n")


def extent_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Median position and the length of the P10-P90 diagonal of sampled component points."""
    out = exact_quantiles_of(rows, keys, {c: {f"{c}10": 0.1, f"{c}50": 0.5, f"{c}90": 0.9} for c in ("x", "y", "z")})
    gap = [F.pow(F.col(f"{c}90") - F.col(f"{c}10"), 2) for c in ("x", "y", "z")]
    return out.select(*keys, *[F.col(f"{c}50").alias(f"center_{c}") for c in ("x", "y", "z")],
                      F.sqrt(gap[0] + gap[1] + gap[2]).alias("radial_extent"))
