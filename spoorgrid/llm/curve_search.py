"""Approximate nearest neighbours by shifted space-filling curves.

Each ordering projects the vectors to a few dimensions, shifts them at random and sorts them along a Hilbert curve.
Keys are range-partitioned into blocks of equal size; a query meets the blocks around its own in every ordering, each
block returns its best rows and the lists of all windows are merged. Scores are exact inner products.

How many orderings, blocks and neighbouring blocks are read is chosen from the data: a bounded sample of queries is
answered exactly over all rows, and the cheapest setting that finds `target` of those answers is taken. Data without
structure therefore get wide windows, clustered data narrow ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoorgrid.llm.common import written
from spoorgrid.llm.vectors import mapped, matrix, raw, sample

DIMS, BITS = 8, 7
FINE = 1024
RESULT = "query_id long, rank int, vec_id long, score double"


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of integer points (row, dimension) with coordinates below 2 ** bits."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        q, p = 1 << b, (1 << b) - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[n - 1] & (1 << b), (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


@dataclass
class Curves:
    """Projections, scales, shifts and block borders of all orderings."""

    project: np.ndarray  # ordering, input dimension, curve dimension
    centre: np.ndarray
    spread: np.ndarray
    shift: np.ndarray
    borders: np.ndarray  # ordering, FINE - 1

    def keys(self, x: np.ndarray, k: int) -> np.ndarray:
        """Keys of one ordering. Ties of a common point are broken by the vector's bytes, so that they fill several blocks."""
        z = np.tanh((x @ self.project[k] - self.centre[k]) / self.spread[k])
        cells = ((z * 0.5 + 0.5 + self.shift[k]) * (1 << (BITS - 1))).astype(np.int64)
        mix = (x.view(np.uint64) * (2 * np.arange(x.shape[1], dtype=np.uint64) + 3)).sum(1, dtype=np.uint64) >> np.uint64(58)
        return hilbert(np.clip(cells, 0, (1 << BITS) - 1), BITS) << 6 | mix.astype(np.int64)

    def blocks(self, x: np.ndarray, count: int, blocks: int) -> np.ndarray:
        """(row, ordering): block numbers."""
        step = FINE // blocks
        return np.stack([np.searchsorted(self.borders[k][step - 1::step][:blocks - 1], self.keys(x, k), side="right") for k in range(count)], 1)


def build(x: np.ndarray, orderings: int) -> Curves:
    """Learned from a bounded sample: random directions, their spread in the sample, and block borders by its ranks."""
    rng = np.random.default_rng(17)
    dim = x.shape[1]
    project = rng.normal(size=(orderings, dim, DIMS)) / np.sqrt(dim)
    z = np.einsum("nd,kdc->knc", x, project)
    curves = Curves(project, z.mean(1), z.std(1) + 1e-12, rng.random((orderings, DIMS)), np.zeros((orderings, FINE - 1), np.int64))
    for k in range(orderings):
        ordered = np.sort(curves.keys(x, k))
        curves.borders[k] = ordered[(np.arange(1, FINE) * len(ordered)) // FINE]
    return curves


def _best(queries: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row indices and scores (query, k) of the largest inner products, own row excluded (score -inf), smaller ids first."""
    scores = queries @ x.T
    scores[q_ids[:, None] == ids[None, :]] = -np.inf
    if len(ids) > k:
        index = np.sort(np.argpartition(-scores, k - 1, axis=1)[:, :k], axis=1)
        top = np.take_along_axis(scores, index, 1)
        for r in np.flatnonzero((scores >= top.min(1, keepdims=True)).sum(1) > k):  # ties at the edge
            index[r] = np.sort(np.argsort(-scores[r], kind="stable")[:k])
    else:
        index = np.broadcast_to(np.arange(len(ids)), scores.shape)
    order = np.argsort(-np.take_along_axis(scores, index, 1), axis=1, kind="stable")  # ids are sorted
    index = np.take_along_axis(index, order, 1)
    return index, np.take_along_axis(scores, index, 1)


def _lists(x: np.ndarray) -> pa.Array:
    n, width = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(x.ravel().astype(np.int32)))


def answers(embeddings: DataFrame, ids: np.ndarray, x: np.ndarray, k: int) -> DataFrame:
    """Exact answers of a bounded set of queries over all rows: (query, vec_id, score, vec)."""

    def out(own: np.ndarray, y: np.ndarray) -> list:
        order = np.argsort(own, kind="stable")
        own, y = own[order], y[order]
        index, score = _best(x, ids, y, own, k)
        flat = index.ravel()
        ok = np.isfinite(score.ravel())
        return [np.repeat(ids, index.shape[1])[ok], own[flat][ok], score.ravel()[ok], raw(y[flat][ok])]

    found = mapped(embeddings, x.shape[1], out, "query long, vec_id long, score double, vec binary")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.dropDuplicates(["query", "vec_id"]).withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def tune(curves: Curves, queries: dict[int, np.ndarray], truth: list, target: float, total: int, k: int) -> tuple[int, int, int, float]:
    """(orderings, blocks, reach, measured recall) of least rows read for each query, among those that reach the target."""
    q = np.stack([queries[r["query"]] for r in truth])
    y = matrix([r["vec"] for r in truth], q.shape[1])
    most = len(curves.project)
    for share in (8, 4, 2, 1):  # windows of at most an eighth of the rows, wider ones only if these don't reach the target
        tried = []
        for blocks in (1 << e for e in range(5, FINE.bit_length())):
            if blocks > 32 and total / blocks < 8 * k:
                break
            apart = np.abs(curves.blocks(q, most, blocks) - curves.blocks(y, most, blocks))
            for reach in (1, 2, 4, 8, 16, 32):
                if share > 1 and (2 * reach + 1) * share > blocks:
                    break
                recall = np.cumsum(apart <= reach, axis=1).clip(0, 1).mean(0)
                enough = np.flatnonzero(recall >= target)
                if len(enough):
                    n = int(enough[0]) + 1
                    # an ordering costs a copy of every row, besides what its windows read
                    tried.append((n * min(blocks, 2 * reach + 1) / blocks + 0.03 * n, n, blocks, reach, float(recall[n - 1])))
        if tried:
            return min(tried)[1:]
    raise AssertionError("windows of all blocks hold every row")


def search(embeddings: DataFrame, is_query: Column, k: int = 20, target: float = 0.95, orderings: int = 48, sample_rows: int = 4000,
           sample_queries: int = 128, part_rows: int = 8192) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows found for each query, ties to the smaller id.

    embeddings needs vec_id and embedding; is_query is a condition on vec_id. Vectors that are null, zero, of another
    length than the most common one of the sample, or hold null or non-finite components take no part, nor do null ids.
    Rows of one vec_id are one candidate (with its best score) and never answer their own query. Fewer than k
    candidates are all returned. An empty table gives no rows.
    """
    spark = embeddings.sparkSession
    ids, x = sample(embeddings, sample_rows)
    if not len(ids):
        return spark.createDataFrame([], RESULT)
    dim = x.shape[1]
    curves = build(x, orderings)
    test = dict(list(zip(ids.tolist(), x, strict=True))[:sample_queries])
    truth = answers(embeddings, np.array(list(test)), np.stack(list(test.values())), k).collect()
    total = embeddings.count()
    count, blocks, reach, _ = tune(curves, test, truth, target, total, k) if truth else (1, 32, 32, 1.0)
    exact = np.float32 if dict(embeddings.dtypes)["embedding"] == "array<float>" else np.float64  # bytes that are shuffled

    def place(own: np.ndarray, y: np.ndarray) -> list:
        return [own, raw(y.astype(exact)), _lists(curves.blocks(y, count, blocks))]

    rows = written(mapped(embeddings, dim, place, "vec_id long, vec binary, blocks array<int>"), "curve-rows")
    # both sides of a block are cut into parts of bounded size
    parts = max(1, -(-total // (blocks * part_rows)))
    each = F.posexplode("blocks").alias("ordering", "block")
    held = rows.select("vec_id", "vec", each).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int"))
    asked = rows.where(is_query).select("vec_id", "vec", each)
    near = F.sequence(F.greatest(F.col("block") - reach, F.lit(0)), F.least(F.col("block") + reach, F.lit(blocks - 1)))
    asked = asked.select("vec_id", "vec", "ordering", F.explode(near).alias("block")).select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    turns = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(parts)).cast("int")
    asked = asked.withColumn("turn", turns)
    held = held.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    key = ["ordering", "block", "part", "turn"]

    def meet(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": int, "vec_id": int, "score": float})
        rows = rows.drop_duplicates(["vec_id", "vec"]).sort_values("vec_id")
        own, y = rows["vec_id"].to_numpy(), matrix(rows["vec"].tolist(), dim, exact)
        out = []
        for at in range(0, len(queries), 512):
            some = queries.iloc[at:at + 512]
            q_ids = some["vec_id"].to_numpy()
            index, score = _best(matrix(some["vec"].tolist(), dim, exact), q_ids, y, own, k)
            out.append(pd.DataFrame({"query_id": np.repeat(q_ids, index.shape[1]), "vec_id": own[index.ravel()], "score": score.ravel()}))
        found = pd.concat(out)
        return found[np.isfinite(found["score"])]

    found = held.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(meet, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return found.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k)

