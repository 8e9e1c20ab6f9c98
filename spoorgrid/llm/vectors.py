"""Embedding rows as matrices: which vectors take part, their bytes, and bounded samples of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slim(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def usable(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows take part, their ids and their vectors. Null ids, null or zero vectors, vectors with a null or
    non-finite component and those of another length than `dim` do not."""
    ids, column = batch.column(0), batch.column(1)
    ok = pc.fill_null(pc.and_kleene(pc.equal(pc.list_value_length(column), dim), pc.is_valid(ids)), False)
    x = column.filter(ok).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    mask = ok.to_numpy(zero_copy_only=False).copy()
    mask[mask] = good
    return mask, ids.filter(ok).to_numpy(zero_copy_only=False).astype(np.int64)[good], x[good]


def raw(x: np.ndarray) -> pa.Array:
    """The bytes of each row."""
    return pa.array([r.tobytes() for r in x], pa.binary())


def matrix(column: list[bytes], dim: int, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(-1, dim).astype(np.float64)


def sample(embeddings: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of at most `rows` usable vectors of the most common length, the first by a hash of their id."""
    taken = slim(embeddings).dropna().orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).collect()
    sizes = [len(r[1]) for r in taken if len(r[1])]
    if not sizes:
        return np.empty(0, np.int64), np.empty((0, 0))
    dim = max(set(sizes), key=lambda n: (sizes.count(n), n))
    ids = np.array([r[0] for r in taken if len(r[1]) == dim], np.int64)
    x = np.array([r[1] for r in taken if len(r[1]) == dim], np.float64)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return ids[good], x[good]


def mapped(embeddings: DataFrame, dim: int, out: Callable[[np.ndarray, np.ndarray], list], schema: str) -> DataFrame:
    """Rows that `out` makes of the ids and vectors that take part, a few thousand at a time."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                _, ids, x = usable(batch.slice(at, 4096), dim)
                if len(ids):
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in out(ids, x)], names=names)

    return slim(embeddings).mapInArrow(run, schema)
