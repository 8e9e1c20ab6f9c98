"""What the text classifiers share: bounded labelled samples, hashed bags of words and structure statistics."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorgrid.llm.common import bucket_of, word_hashes

STATS = ("log_words", "upper", "digits", "symbols", "bars", "line_ends", "word_length", "distinct", "repeated", "most_common",
         "shouted", "symbol_ends", "non_ascii", "declared")
_UPPER, _DIGIT, _SYMBOL = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _DIGIT[48:58] = True, True
_SYMBOL[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def learnable(labels: DataFrame, column: str, modulus: int, held: int, rows: int) -> DataFrame:
    """(doc_id, y): at most `rows` labelled documents outside the held-out bucket, the first by a hash of their id.

    Null ids and null labels teach nothing; of contradicting labels of an id the majority holds, ties are 1.
    """
    ok = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("double").alias("y")).dropna()
    ok = ok.where(bucket_of(F.col("doc_id"), modulus) != held).groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    return ok.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def sample_texts(docs: DataFrame, chosen: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of the chosen ids, one for each id. `chosen` is bounded by its parameter, so it may be broadcast."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *columns).join(F.broadcast(chosen), "doc_id")
    return rows.dropDuplicates(["doc_id"])


def fitted(sample: DataFrame, fit: Callable[[dict[str, list]], object]):
    """The model that `fit` makes of the columns of a sample, its rows ordered by doc_id.

    One task fits it, so that the driver holds neither the texts nor the arrays of a fit. The sample is bounded by its parameter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        columns = pa.Table.from_batches(rows).sort_by("doc_id").to_pydict() if rows else dict.fromkeys(names, [])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(columns))], pa.binary())], names=["model"])

    names = sample.columns
    found = sample.coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found["model"]) if found else fit(dict.fromkeys(names, []))  # an empty plan may have no task


@dataclass
class Bag:
    """Distinct hashed words of each text: row, bucket and count, ordered by row; words: hashes and rows of all words."""

    row: np.ndarray
    bucket: np.ndarray
    count: np.ndarray
    words: np.ndarray
    owner: np.ndarray


def bag_of(texts: list[str], buckets: int) -> Bag:
    words, owner = word_hashes(texts)
    keys, counts = np.unique(owner * buckets + (words % np.uint64(buckets)).astype(np.int64), return_counts=True)
    return Bag(keys // buckets, keys % buckets, counts, words, owner)


def all_structure(texts: list[str], declared: list, buckets: int) -> tuple[Bag, np.ndarray]:
    """Bag and statistics of many texts, some at a time."""
    parts = []
    for at in range(0, len(texts), 128):
        some = texts[at:at + 128]
        bag = bag_of(some, buckets)
        stats = structure(some, declared[at:at + 128], bag)
        parts.append((bag.row + at, bag.bucket, bag.count, stats))
    row, bucket, count, stats = (np.concatenate(x) for x in zip(*parts, strict=True))
    none = np.empty(0, np.int64)
    return Bag(row, bucket, count, none.view(np.uint64), none), stats


def structure(texts: list[str], declared: list | None, bag: Bag) -> np.ndarray:
    """Statistics of each text, one column per name of STATS. `declared` is a length kept with the text, if any."""
    n = len(texts)
    data = [t.encode("utf-8", "replace") for t in texts]
    sizes = np.fromiter(map(len, data), np.int64, n)
    flat = np.frombuffer(b"".join(data), np.uint8)
    first = np.cumsum(sizes) - sizes

    def share(mask: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(mask))
        return (total[first + sizes] - total[first]) / np.maximum(of, 1)

    count = np.bincount(bag.owner, minlength=n).astype(float)
    distinct = np.bincount(bag.row, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, bag.row, bag.count)
    again = (bag.words[1:] == bag.words[:-1]) & (bag.owner[1:] == bag.owner[:-1]) if len(bag.words) else np.empty(0, bool)
    repeated = np.bincount(bag.owner[1:][again], minlength=n) if len(again) else np.zeros(n)
    upper, symbol = _UPPER[flat], _SYMBOL[flat]
    after = np.append(flat[1:], 32)
    letters = (flat > 64) & ~symbol
    out = np.stack([
        np.log1p(count), share(upper, sizes), share(_DIGIT[flat], sizes), share(symbol, sizes), share(flat == 124, sizes), share(flat == 10, sizes),
        share(letters, count), distinct / np.maximum(count, 1), repeated / np.maximum(count, 1), most / np.maximum(count, 1),
        share(upper & _UPPER[after], sizes), share(symbol & (after <= 32), count), share(flat > 127, sizes), np.zeros(n)], axis=1)
    if declared is not None:
        given = np.array([-1 if d is None else d for d in declared], float)
        out[:, -1] = np.log1p(np.maximum(given, 0)) - (given < 0)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Adam:
    """Steps for a list of arrays, in place."""

    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)
