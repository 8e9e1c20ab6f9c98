"""Links between 64-bit codes that share a cell of some table, in tasks of bounded size.

Cells with few codes are compared in bulk, many cells at once. A crowded cell is cut into parts; each pair of parts is a
group of its own and returns a spanning forest of its links, not all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL = 32
#: (a, b) -> the rows of a and b that are near each other, in slabs; the flag asks for i < j only.
Near = Callable[[np.ndarray, np.ndarray, bool], Iterator[tuple[np.ndarray, np.ndarray]]]


def within(bits: int) -> Near:
    """Hamming distance of at most `bits`."""

    def near(a: np.ndarray, b: np.ndarray, upper: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = max(1, 2_000_000 // max(1, len(b)))
        for at in range(0, len(a), step):
            i, j = np.nonzero(np.bitwise_count(a[at:at + step, None] ^ b[None, :]) <= bits)
            i += at
            yield (i[i < j], j[i < j]) if upper else (i, j)

    return near


def _forest(codes: np.ndarray, part: np.ndarray, lo: int, hi: int, near: Near) -> list[tuple[int, int]]:
    """Links between two parts of a crowded cell (or within one) that connect all that is linked there."""
    rows_a, rows_b = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
    root, out = list(range(len(codes))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in near(codes[rows_a], codes[rows_b], lo == hi):
        for x, y in zip(rows_a[i].tolist(), rows_b[j].tolist(), strict=True):
            p, q = find(x), find(y)
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((x, y))
    return out


def linked(cells: DataFrame, bits: int, near: Near, first: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
           part_rows: int = 2048) -> DataFrame:
    """(a, b): links that connect what codes at `bits` or fewer differing bits connect if they share a cell.

    cells: (table int, cell long, code long), a code at most once in a cell. `first` names, for pairs of codes, the
    first table in which they share a cell; small cells then return a pair from that table only.
    """
    crowded = cells.groupBy("cell").agg(F.count("*").alias("_n")).where(F.col("_n") > part_rows)
    crowded = crowded.select("cell", F.ceil(F.col("_n") / part_rows).cast("int").alias("_k"))
    held = cells.join(crowded, "cell", "left").withColumn("_k", F.coalesce("_k", F.lit(1)))
    held = held.withColumn("_i", F.pmod(F.xxhash64("code"), F.col("_k")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda x: F.struct(
        F.least(x, F.col("_i")).alias("lo"), F.greatest(x, F.col("_i")).alias("hi")))
    held = held.select("cell", "table", "code", "_i", F.inline(pairs))
    key = ["cell", "lo", "hi"]

    def compare(table: np.ndarray, codes: np.ndarray, part: np.ndarray, lo: np.ndarray, hi: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        sizes = np.diff(np.append(starts, len(codes)))
        run, small = np.repeat(np.arange(len(starts)), sizes), np.repeat(sizes <= SMALL, sizes)
        a, b = [codes[:0]], [codes[:0]]
        for d in range(1, min(SMALL, int(sizes.max(initial=1)))):
            i = np.flatnonzero((run[:-d] == run[d:]) & small[:-d])
            i = i[np.bitwise_count(codes[i] ^ codes[i + d]) <= bits]
            if first is not None and len(i):
                i = i[first(codes[i], codes[i + d]) == table[i]]
            a.append(codes[i])
            b.append(codes[i + d])
        for r in np.flatnonzero(sizes > SMALL):
            own = slice(starts[r], starts[r] + sizes[r])
            found = np.array(_forest(codes[own], part[own], lo[starts[r]], hi[starts[r]], near), np.int64).reshape(-1, 2)
            a.append(codes[own][found[:, 0]])
            b.append(codes[own][found[:, 1]])
        column = lambda x: pa.array(np.concatenate(x).view(np.int64))
        return pa.RecordBatch.from_arrays([column(a), column(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for batch in batches:
            rows = [c.to_numpy() for c in batch.columns]
            if kept is not None:
                rows = [np.concatenate(x) for x in zip(kept, rows, strict=True)]
            cell, lo, hi = rows[0], rows[4], rows[5]
            edge = np.flatnonzero((np.diff(cell) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)) + 1
            last = edge[-1] if len(edge) else 0  # the last group may go on in the next batch
            if last:
                yield compare(rows[1][:last], rows[2][:last].view(np.uint64), rows[3][:last], lo[:last], hi[:last], np.append(0, edge[:-1]))
            kept = [x[last:].copy() for x in rows]
        if kept is not None and len(kept[0]):
            yield compare(kept[1], kept[2].view(np.uint64), *kept[3:], np.zeros(1, np.int64))

    return held.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long")
