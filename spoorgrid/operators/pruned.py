"""Cells of a vector bank with exact bounds on the inner products inside, for retrieval that reads only blocks that can matter.

Every bank vector belongs to the nearest of a bounded number of centres; a cell knows its size and radius, so q·c + |q| r bounds the scores
of its vectors. Large cells are dealt by a hash into parts: a block is (cell, part), holds about `block_rows` vectors whatever repeats, and
stays where it is. Queries travel, to the blocks whose bound reaches what they already have. Bounds decide what is read, never a result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorgrid.session import cut, file_system, shared_folder

MAX_CELLS = 256  # what a task holds of the bank's shape: at most this many centres
SAMPLE = 16      # sampled vectors a centre is learned from
LANE = 4         # queries that meet a block in one task, in blocks of the bank
LEAST = 1024     # queries worth a lane of their own where slots would stay empty
SHARE = 4        # groups of a block and a lane for each task slot
LANE_NUMBERS = 8_000_000  # and the numbers their vectors hold (64 MB)


class Cells(NamedTuple):
    centres: np.ndarray
    radius: np.ndarray
    rows: np.ndarray
    parts: np.ndarray

    def upper(self, q: np.ndarray) -> np.ndarray:
        """Bound on the best score of each query (n, variants, d) in each cell, with room for rounding; -inf for empty cells."""
        norm = np.linalg.norm(q, axis=2)[:, :, None]
        dot, reach = q @ self.centres.T, norm * self.radius
        room = 1.0e-9 * (1.0 + norm * (np.linalg.norm(self.centres, axis=1) + self.radius))
        return np.where(self.rows > 0, (dot + reach + room).max(axis=1), -np.inf)


def _centres(sample: np.ndarray, wanted: int, rounds: int = 8) -> np.ndarray:
    """A few rounds of k-means over a bounded sample; repeated vectors count once, so copies do not take all centres."""
    rows = np.unique(sample, axis=0)
    c = rows[np.random.default_rng(7).permutation(len(rows))[:wanted]].copy()
    for _ in range(rounds):
        near = _distance2(rows, c).argmin(axis=1)
        for i in range(len(c)):
            if (near == i).any():
                c[i] = rows[near == i].mean(axis=0)
    return c


def _distance2(b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (b ** 2).sum(axis=1)[:, None] - 2.0 * (b @ c.T) + (c ** 2).sum(axis=1)


def cells_of(bank: DataFrame, block_rows: int) -> tuple[DataFrame, Cells | None]:
    """The bank (item, bvec) with its cell and part, written once, and the cells; None for an empty bank.

    The driver sees a sample of at most MAX_CELLS * SAMPLE vectors and one row per cell.
    """
    rows = bank.where("bvec is not null").select(F.col("item").cast("bigint").alias("item"), "bvec")
    wanted = min(MAX_CELLS, max(1, -(-rows.count() // block_rows)))
    sample = rows.orderBy(F.xxhash64("item"), "item").limit(wanted * SAMPLE).select("bvec").collect()
    if not sample:
        return rows, None
    centres = _centres(np.array([r[0] for r in sample], dtype=np.float64), wanted)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                b = np.stack(batch["bvec"].to_numpy()).astype(np.float64)
                cell = _distance2(b, centres).argmin(axis=1)
                yield batch.assign(cell=cell.astype(np.int32), far=np.linalg.norm(b - centres[cell], axis=1))

    placed = cut(rows.mapInPandas(place, "item bigint, bvec array<double>, cell int, far double"))
    size, radius = np.zeros(len(centres), dtype=np.int64), np.zeros(len(centres))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():
        size[r["cell"]], radius[r["cell"]] = r["n"], r["far"]
    cells = Cells(centres, radius, size, np.maximum(1, -(-size // block_rows)))
    parts = F.element_at(F.array(*[F.lit(int(p)) for p in cells.parts]), F.col("cell") + 1)
    return placed.select("item", "bvec", "cell", F.pmod(F.xxhash64("item"), parts).cast("int").alias("part")), cells


def _visits(queries: DataFrame, cells: Cells, variants: int, lanes: int, first: int | None) -> DataFrame:
    """Queries with each block they go to. With `first`, one block of the most promising cell that holds more than that many vectors;
    otherwise every block whose bound reaches `threshold` (null: every block)."""
    q = queries.withColumn("lane", F.pmod(F.xxhash64("qid"), F.lit(lanes)).cast("int"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch["qvec"].notna()]  # here, so that no filter repeats the expressions that made the vector
            if not len(batch):
                continue
            vec = np.stack(batch["qvec"].to_numpy()).astype(np.float64).reshape(len(batch), variants, -1)
            up = cells.upper(vec)
            if first is not None:
                full = cells.rows // cells.parts > first
                cell = (np.where(full, up, -np.inf) if full.any() else up).argmax(axis=1)
                yield batch.assign(cell=cell.astype(np.int32), part=(batch["qid"].to_numpy() % cells.parts[cell]).astype(np.int32))
                continue
            least = batch["threshold"].to_numpy(dtype=np.float64, na_value=np.nan)
            need = ~(up < np.where(np.isnan(least), -np.inf, least)[:, None]) & (cells.rows > 0)
            for c in np.flatnonzero(need.any(axis=0)):
                some = batch[need[:, c]]
                for part in range(int(cells.parts[c])):
                    yield some.assign(cell=np.int32(c), part=np.int32(part))

    fields = ", ".join(f"{c} {t}" for c, t in q.dtypes)
    return q.mapInPandas(run, f"{fields}, cell int, part int")


def visit(queries: DataFrame, placed: DataFrame, cells: Cells, variants: int, lanes: int, first: int | None,
          tile: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """`tile(queries, block)` for each block and the queries that visit it. A lane takes about LANE blocks' worth of queries at most and
    LANE_NUMBERS of their vectors, so a task's group is bounded even where all queries want the same block."""
    keys = ["cell", "part", "lane"]
    blocks = placed.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    return _visits(queries, cells, variants, lanes, first).groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInArrow(tile, schema)


def read_by_lanes(queries: DataFrame, placed: DataFrame, cells: Cells, lanes: int, run: Callable[[pa.Table, Callable[[int, int], pa.Table]], pa.Table],
                  schema: str) -> DataFrame:
    """`run(lane, block)` for lanes of the queries; `block(cell, part)` reads that block from the shared folder. Queries are dealt once and stay, so disk
    and shuffles hold the bank and the queries, not queries times blocks."""
    folder = f"{shared_folder(placed.sparkSession)}/bank-{uuid.uuid4().hex}"
    blocks = int(cells.parts.sum())
    placed.repartition(blocks, "cell", "part").write.partitionBy("cell", "part").parquet(folder)
    system, local = file_system(folder)
    files: dict[tuple[int, int], list[str]] = {}
    for path in (f.path for f in system.get_file_info(FileSelector(local, recursive=True)) if f.path.endswith(".parquet")):
        cell, part = (int(x.split("=")[1]) for x in path.rsplit("/", 3)[1:3])
        files.setdefault((cell, part), []).append(path)

    def block(cell: int, part: int) -> pa.Table:
        there = file_system(folder)[0]
        return pa.concat_tables([pq.read_table(p, filesystem=there, columns=["item", "bvec"], partitioning=None) for p in files.get((int(cell), int(part)), [])] or [EMPTY])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane = [b for b in batches if b.num_rows]
        if lane:
            table = pa.Table.from_batches(lane)
            table = table.filter(pc.is_valid(table.column("qvec")))
            if table.num_rows:
                yield from run(table, block).combine_chunks().to_batches()

    return queries.repartition(lanes, "qid").mapInArrow(each, schema)


EMPTY = pa.table({"item": pa.array([], pa.int64()), "bvec": pa.array([], pa.list_(pa.float64()))})


def lanes_for(n_queries: int, block_rows: int, width: int, blocks: int, tasks: int) -> int:
    """Lanes for queries whose vectors hold `width` numbers: as few as memory allows, but some groups of blocks and lanes for every task slot."""
    bounded = max(1, -(-n_queries // (LANE * block_rows)), -(-n_queries * width // LANE_NUMBERS))
    return max(bounded, min(-(-n_queries // LEAST), -(-SHARE * tasks // max(1, blocks))))


def matrix(table: pa.Table, name: str) -> np.ndarray:
    """An array column as a matrix, without an object for every row."""
    lists = table.column(name).combine_chunks()
    if pc.count_distinct(pc.list_value_length(lists)).as_py() > 1:
        raise ValueError(f"vectors of {name} differ in length")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(lists), -1)
