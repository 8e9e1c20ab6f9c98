"""Quality scores by a factorisation machine over hashed words, structure statistics and metadata.

Pairwise interactions are low-rank: sum over pairs of <v_i, v_j> x_i x_j is half of |sum v_i x_i|^2 - sum |v_i x_i|^2,
so a text is scored in time linear in its words. The model is fitted on a bounded sample of labelled rows; scoring is
a projection over whole texts, with the model (a few hundred kB) shipped along.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorgrid.llm.common import bucket_of, scored
from spoorgrid.llm.learn import STATS, Adam, Bag, all_structure, bag_of, fitted, learnable, sample_texts, sigmoid, structure

BINS = 16
#: The score from which a document is called good.
GOOD = 0.7


@dataclass
class Machine:
    """bias, weights and factors; features are word buckets first, then BINS + 1 indicators for each statistic."""

    buckets: int
    edges: np.ndarray
    bias: np.ndarray
    weight: np.ndarray
    factor: np.ndarray


def features(texts: list[str], declared: list, buckets: int, edges: np.ndarray) -> tuple:
    """(row, feature, value) ordered by row. Word values of a text have length one."""
    bag = bag_of(texts, buckets)
    return encoded(bag, structure(texts, declared, bag), buckets, edges)


def encoded(bag: Bag, stats: np.ndarray, buckets: int, edges: np.ndarray) -> tuple:
    n = len(stats)
    value = np.log1p(bag.count)
    norm = np.sqrt(np.bincount(bag.row, value * value, n))
    bins = np.stack([np.searchsorted(edges[s], stats[:, s], side="right") for s in range(len(STATS))], 1)
    fixed = buckets + np.arange(len(STATS)) * (BINS + 1) + bins
    row = np.concatenate([bag.row, np.repeat(np.arange(n), len(STATS))])
    order = np.argsort(row, kind="stable")
    feature = np.concatenate([bag.bucket, fixed.ravel()])[order]
    value = np.concatenate([value / np.maximum(norm, 1e-9)[bag.row], np.full(fixed.size, 1 / np.sqrt(len(STATS)))])[order]
    return row[order], feature, value.astype(np.float32)


def raw_scores(model: Machine, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores before the logistic function, and the sums of v_i x_i. Every row has at least one feature."""
    starts = np.searchsorted(row, np.arange(n))
    vx = model.factor[feature] * value[:, None]
    sums = np.add.reduceat(vx, starts, axis=0)
    squares = np.add.reduceat((vx * vx).sum(1), starts)
    linear = np.add.reduceat(model.weight[feature] * value, starts)
    return model.bias[0] + linear + 0.5 * ((sums * sums).sum(1) - squares), sums


def fit(texts: list[str], declared: list, y: np.ndarray, buckets: int, rank: int, rounds: int, rate: float = 0.05, l2: float = 2e-4) -> Machine:
    """Full-batch logistic loss; an even prior if there is nothing to learn from."""
    rng = np.random.default_rng(11)
    size = buckets + len(STATS) * (BINS + 1)
    if not len(texts):
        return Machine(buckets, np.zeros((len(STATS), BINS)), np.zeros(1, np.float32), np.zeros(size, np.float32), np.zeros((size, rank), np.float32))
    bag, stats = all_structure(texts, declared, buckets)
    edges = np.quantile(stats, (np.arange(BINS) + 0.5) / BINS, axis=0).T
    model = Machine(buckets, edges, np.zeros(1, np.float32), np.zeros(size, np.float32), rng.normal(0, 0.02, (size, rank)).astype(np.float32))
    row, feature, value = encoded(bag, stats, buckets, edges)
    by = np.argsort(feature, kind="stable")
    seen, at = np.unique(feature[by], return_index=True)
    adam = Adam([model.bias, model.weight, model.factor], rate)
    for _ in range(rounds):
        z, sums = raw_scores(model, row, feature, value, len(texts))
        g = ((sigmoid(z) - y) / len(texts)).astype(np.float32)
        gx = g[row] * value
        dv = gx[:, None] * (sums[row] - model.factor[feature] * value[:, None])
        gw, gv = l2 * model.weight / 10, l2 * model.factor
        gw[seen] += np.add.reduceat(gx[by], at)
        gv[seen] += np.add.reduceat(dv[by], at, axis=0)
        adam.step([g.sum(keepdims=True), gw, gv])
    return model


def train(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, rows: int = 3000, buckets: int = 1 << 13, rank: int = 8,
          rounds: int = 60) -> Machine:
    """Fit on at most `rows` labelled documents outside the held-out bucket (bound of the one task that fits)."""
    chosen = learnable(labels, "quality", modulus, held, rows)
    sample = sample_texts(docs, chosen, [F.col("text").cast("string").alias("text"), F.col("n_chars").cast("double").alias("n_chars")])
    return fitted(sample, lambda c: fit([t or "" for t in c["text"]], c["n_chars"], np.array(c["y"], np.float32), buckets, rank, rounds))


def score(docs: DataFrame, model: Machine, name: str = "score") -> DataFrame:
    """docs with the score of every row as one more column; texts are taken whole, null and empty ones as texts without
    words. docs needs text and n_chars; a null n_chars is a value of its own.
    """

    def of(texts: list[str], declared: list) -> np.ndarray:
        z, _ = raw_scores(model, *features(texts, declared, model.buckets, model.edges), len(texts))
        return sigmoid(z.astype(np.float64))

    return scored(docs, ["text", "n_chars"], of, name)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = GOOD, **settings) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    docs needs doc_id, text and n_chars; other columns are ignored. Null ids and repeated rows stay as they are. Empty
    docs give no rows; without labels all scores are about even.
    """
    out = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "n_chars"), train(docs, labels, **settings))
    held = F.coalesce(bucket_of(F.col("doc_id"), settings.get("modulus", 4)) == settings.get("held", 2), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
