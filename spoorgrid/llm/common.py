"""Helpers shared by the operators: column safety, shared storage, learnable rows and word arrays."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoorgrid.session import shared_folder

#: One bit for each byte that belongs to a word: ASCII letters, digits and every byte of a non-ASCII character.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: One bit for each byte that isn't ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False
_BASE = np.uint64(0x100000001B3)
_POWERS = np.empty(256, np.uint64)
_POWERS[0] = 1
with np.errstate(over="ignore"):
    for _i in range(1, 256):
        _POWERS[_i] = _POWERS[_i - 1] * _BASE


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to a fresh Parquet folder in the shared storage and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of the decimal text of the id, modulo n; null ids fall into no bucket."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def slices(batches: Iterator[pa.RecordBatch], column: int, chars: int) -> Iterator[pa.RecordBatch]:
    """The rows in pieces of about `chars` bytes of a text column, one row at least, so that memory stays bounded."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + chars, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def scored(docs: DataFrame, columns: list[str], score: Callable, name: str) -> DataFrame:
    """docs with a double column: what `score` gives for lists of the columns, the first of them texts (null: empty).
    A column of that name is replaced."""
    docs = docs.drop(name)
    inputs = [F.col(columns[0]).cast("string").alias("_t"), *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns[1:])]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0, 1_000_000):
            texts = [t or "" for t in part.column(0).to_pylist()]
            found = score(texts, *[part.column(i + 1).to_pylist() for i in range(len(columns) - 1)])
            yield pa.RecordBatch.from_arrays([*part.columns[len(columns):], pa.array(found, pa.float64())], names=[*part.schema.names[len(columns):], name])

    return docs.select(*inputs, F.col("*")).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def word_hashes(texts: list[str], mask: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all lower-cased words of the texts, and the index of the text of each word.

    Words are maximal runs of bytes of the mask, by default of letters, digits and non-ASCII characters. All texts of a batch are hashed together
    with a polynomial over their bytes, so no Python code runs for a word.
    """
    sizes = np.cumsum([len(t) for t in texts])
    if len(texts) > 1 and sizes[-1] > 2_000_000:  # halves of it, so that the arrays below stay small
        half = min(max(1, int(np.searchsorted(sizes, sizes[-1] / 2))), len(texts) - 1)
        (a, i), (b, j) = word_hashes(texts[:half], mask), word_hashes(texts[half:], mask)
        return np.concatenate([a, b]), np.concatenate([i, j + half])
    joined = "\n".join(t.lower() for t in texts).encode("utf-8", "replace")
    data = np.frombuffer(joined, np.uint8)
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = mask[data]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    sizes = ends - starts
    at = np.flatnonzero(inside)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(len(at)) - first
    values = (data[at].astype(np.uint64) + np.uint64(1)) * _POWERS[place & 255]
    sums = np.add.reduceat(values, np.cumsum(sizes) - sizes)
    sums ^= sizes.astype(np.uint64) << np.uint64(56)
    sums ^= sums >> np.uint64(32)
    sums *= np.uint64(0x9E3779B97F4A7C15)
    sums ^= sums >> np.uint64(29)
    # a text of the batch may hold line ends itself, so texts are found by byte offsets
    lengths = np.fromiter((len(t.lower().encode("utf-8", "replace")) + 1 for t in texts), np.int64, len(texts))
    return sums, np.searchsorted(np.cumsum(lengths), starts, side="right")


def sums_by(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sum of the values of each of n indices."""
    return np.bincount(index, weights=values, minlength=n)
