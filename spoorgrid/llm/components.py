"""Connected components of a link table, by alternating large and small stars.

Minima come from aggregates and joins, so no neighbourhood is collected; rounds are logarithmic in the longest path and
each one is written to reliable storage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorgrid.session import cut

SALTS = 64
#: Links that one task contracts at once.
BATCH = 500_000


def _with_smallest(links: DataFrame) -> DataFrame:
    """Add m, the smallest of a and its neighbours. Salted, so that a node with very many links is in no single task."""
    links = links.withColumn("_s", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    part = links.groupBy("a", "_s").agg(F.min("b").alias("_m"))
    low = part.groupBy("a").agg(F.least(F.min("_m"), F.col("a")).alias("m"))
    return links.join(part.select("a", "_s").join(low, "a"), ["a", "_s"]).select("a", "b", "m")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    out = _with_smallest(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a != b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    out = _with_smallest(links).select("a", "b", "m")
    down = out.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.unionByName(out.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node reachable, for every node that has a link to another one.

    links has long columns a and b in any order, loops and repeats included; without links the result is empty.
    """
    links = cut(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        links = cut(_small_star(_large_star(links)))
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root")).distinct()


def _trees(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of some links but the smallest of its tree, and that smallest one."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[:len(a)], place[len(a):]
    root = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = low != high
        x, y = x[apart], y[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def contracted(links: DataFrame) -> DataFrame:
    """(a, b): fewer links that connect the same nodes, each task's links as stars around their smallest nodes.

    A task works on BATCH links at a time, and there are as many tasks as the links need.
    """
    links = _apart(links)
    return _stars(links, links.count())


def contracted_components(links: DataFrame) -> DataFrame:
    """What components() gives. Links that fit into one batch are solved by its task, so that a small table needs no star round with
    its shuffles and plans; more of them are contracted batch by batch before the rounds."""
    links = _apart(links)
    n = links.count()
    if n > BATCH:
        return components(_stars(links, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
        if held:
            node, root = _trees(*map(np.concatenate, zip(*held, strict=True)))
            top = np.unique(root)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in ((node, top), (root, top))], names=["node", "root"])

    return cut(links.coalesce(1).mapInArrow(run, "node long, root long"))


def _apart(links: DataFrame) -> DataFrame:
    return cut(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a != b"))


def _stars(links: DataFrame, n: int) -> DataFrame:
    """contracted() of so many links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(a) for a, _ in held) >= BATCH:
                held = [_trees(*map(np.concatenate, zip(*held, strict=True)))]
                if len(held[0][0]) >= BATCH // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in held[0]], names=["a", "b"])
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in _trees(*map(np.concatenate, zip(*held, strict=True)))], names=["a", "b"])

    return links.coalesce(max(1, -(-n // BATCH))).mapInArrow(run, "a long, b long")
