"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posterior labels.

Voters are short word lists and patterns; each says toxic, clean or nothing. Word lists start from a few seed words
and grow by words that are far more frequent in labelled toxic texts of the sample. The label model knows only votes, on
labelled and unlabelled texts alike: it estimates, by expectation maximisation, how common the classes are, how often
each voter says what under either class, and how voters agree beyond that; voters that repeat each other share one
voice. Given labels only tell which of its two classes is the toxic one. Its posterior labels, not the given ones, train
a logistic classifier over hashed words and vote statistics, which then scores whole texts in one projection.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorgrid.llm.common import bucket_of, scored, word_hashes
from spoorgrid.llm.learn import Adam, Bag, bag_of, fitted, learnable, sample_texts, sigmoid
from spoorgrid.session import cut

#: Seed words of the first voter.
SEEDS = "clown disgusting idiot loser moron pathetic scum stupid trash worthless".split()
LISTS = 10
ABSTAIN, CLEAN, TOXIC = 0, 1, 2


@dataclass
class Model:
    buckets: int
    words: np.ndarray  # sorted hashes of all listed words
    lists: np.ndarray  # the voter of each of them, 0 for the seeds
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    dense: np.ndarray = field(default_factory=lambda: np.zeros(0))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0


def _distinct_words(texts: list[str], block: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different words of each text and the index of the text, some texts at a time."""
    parts = []
    for at in range(0, len(texts), block):
        words, owner = word_hashes(texts[at:at + block])
        _, once = np.unique(words * np.uint64(0x9E3779B97F4A7C15) + owner.astype(np.uint64), return_index=True)
        parts.append((words[once], owner[once] + at))
    words, owner = (np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64))
    return words, owner


def grown_lists(texts: list[str], y: np.ndarray, per_list: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds and the words whose share of toxic texts exceeds that of clean ones most surely, dealt over the lists."""
    seeds = word_hashes([" ".join(SEEDS)])[0]
    words, owner = _distinct_words(texts)
    if not len(words) or not y.any() or y.all():
        return np.sort(seeds), np.zeros(len(seeds), np.int64)
    seen, index = np.unique(words, return_inverse=True)
    toxic = np.bincount(index, y[owner] > 0.5, len(seen))
    clean = np.bincount(index, minlength=len(seen)) - toxic
    n1, n0 = (y > 0.5).sum(), (y <= 0.5).sum()
    p1, p0 = (toxic + 0.1) / (n1 + 1), (clean + 0.1 + n0 * 1e-4) / (n0 + 1)
    sure = (p1 - p0) / np.sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0 + 1e-9)
    good = np.flatnonzero((toxic >= 3) & (p1 > 3 * p0) & (sure > 2.5))
    good = good[np.argsort(-sure[good], kind="stable")][:(LISTS - 1) * per_list]
    found = seen[good]
    new = ~np.isin(found, seeds)
    all_words = np.concatenate([seeds, found[new]])
    lists = np.concatenate([np.zeros(len(seeds), np.int64), 1 + np.arange(new.sum()) % (LISTS - 1)])
    order = np.argsort(all_words)
    return all_words[order], lists[order]


def hits(model: Model, bag: Bag, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each list in each text, different listed words of a text, and all its words."""
    at = np.minimum(np.searchsorted(model.words, bag.words), len(model.words) - 1)
    ok = model.words[at] == bag.words
    counts = np.zeros((n, LISTS))
    np.add.at(counts, (bag.owner[ok], model.lists[at[ok]]), 1)
    different = np.unique(bag.owner[ok] * len(model.words) + at[ok]) // len(model.words)
    return counts, np.bincount(different, minlength=n).astype(float), np.bincount(bag.owner, minlength=n).astype(float)


def votes(counts: np.ndarray, different: np.ndarray, total: np.ndarray) -> np.ndarray:
    """One column a voter. Lists: a word of theirs says toxic. Patterns: several different words, a high rate, repeats of
    a listed word, and the two that say clean: no listed word at all, hardly any in a long text."""
    every = counts.sum(1)
    rate = every / np.maximum(total, 1)
    toxic = [counts[:, k] > 0 for k in range(LISTS)] + [counts[:, 1:].sum(1) > 1, different >= 2, different >= 4, rate > 0.01, rate > 0.03, every > different]
    clean = [every == 0, (every <= 1) & (total > 150), rate < 0.002]
    return np.stack([np.where(v, TOXIC, ABSTAIN) for v in toxic] + [np.where(v, CLEAN, ABSTAIN) for v in clean], 1)


@dataclass
class Voices:
    """What the label model found: posterior of toxic per row, share of toxic rows, what each voter says in either class
    (class, voter, value; clean first) and the share of a voice that each voter has."""

    posterior: np.ndarray
    balance: float
    says: np.ndarray
    share: np.ndarray


def _shares(rest: np.ndarray) -> np.ndarray:
    """Share of a voice of each column: one, divided by its positive correlations with all columns."""
    deviation = np.sqrt((rest * rest).mean(0)) + 1e-9
    together = np.clip((rest.T @ rest) / len(rest) / np.outer(deviation, deviation), 0, 1)
    return 1 / np.maximum(together.sum(1), 1)


def label_model(vote: np.ndarray, rounds: int = 25) -> Voices:
    """Two classes fitted to votes alone, rows of votes by voters. Rows start at the balance of their voices."""
    shown = np.stack([vote == v for v in (ABSTAIN, CLEAN, TOXIC)], 2).astype(float)  # row, voter, value
    sides = shown[:, :, TOXIC] - shown[:, :, CLEAN]
    voices = _shares(sides - sides.mean(0))
    q = sigmoid((sides @ voices - 1) / voices.max())
    for _ in range(rounds):
        balance = (q.sum() + 1) / (len(q) + 2)
        told = np.stack([np.einsum("r,rvk->vk", p, shown) + 0.5 for p in (1 - q, q)])
        ways = told / told.sum(2, keepdims=True)
        # what is left of a vote beyond its class mean; positive correlations make voters share a voice
        rest = (vote == TOXIC) - ((1 - q)[:, None] * ways[0][:, TOXIC] + q[:, None] * ways[1][:, TOXIC])
        share = _shares(rest)
        odds = np.einsum("rvk,vk->r", shown, (np.log(ways[1]) - np.log(ways[0])) * share[:, None])
        q = np.clip(sigmoid(odds + np.log(balance / (1 - balance))), 1e-4, 1 - 1e-4)
    return Voices(q, balance, ways, share)


def oriented(posterior: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The posterior, turned round if rows labelled toxic have less of it than rows labelled clean (NaN: no label)."""
    toxic, clean = posterior[y > 0.5], posterior[y <= 0.5]
    return 1 - posterior if len(toxic) and len(clean) and toxic.mean() < clean.mean() else posterior


def _bags(model: Model, texts: list[str], block: int = 128) -> tuple[Bag, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bags and hits of many texts, some at a time; the words themselves are not kept."""
    bags, found = [], []
    for at in range(0, len(texts), block):
        some = texts[at:at + block]
        bag = bag_of(some, model.buckets)
        found.append(hits(model, bag, len(some)))
        bags.append((bag.row + at, bag.bucket, bag.count))
    row, bucket, count = (np.concatenate(x) for x in zip(*bags, strict=True))
    none = np.empty(0, np.int64)
    return Bag(row, bucket, count, none.view(np.uint64), none), tuple(np.concatenate(x) for x in zip(*found, strict=True))


def statistics(counts: np.ndarray, different: np.ndarray, total: np.ndarray) -> np.ndarray:
    every = counts.sum(1)
    return np.column_stack([np.log1p(every), np.log1p(different), every / np.sqrt(total + 1), np.log1p(counts[:, 0]), every > 0, different > 1,
                            np.log1p(total), np.minimum(every / np.maximum(total, 1), 0.2)])


def fit(texts: list[str], y: np.ndarray, buckets: int = 1 << 16, per_list: int = 40, rounds: int = 200, l2: float = 1e-3) -> Model:
    """Lists, label model and classifier from texts with labels 0 and 1, or NaN where there is none; without any label, the
    seeds alone decide."""
    y = np.asarray(y, float)
    known = np.flatnonzero(~np.isnan(y))
    model = Model(buckets, *grown_lists([texts[i] for i in known], y[known], per_list))
    model.weight = np.zeros(buckets)
    if not len(known):
        model.dense, model.mean, model.scale, model.bias = np.array([0.0, 0, 0, 6.0, 0, 0, 0, 0]), np.zeros(8), np.ones(8), -3.0
        return model
    bag, found = _bags(model, texts)
    target = oriented(label_model(votes(*found)).posterior, y)
    dense = statistics(*found)
    model.mean, model.scale = dense.mean(0), dense.std(0) + 1e-6
    x = (dense - model.mean) / model.scale
    by = np.argsort(bag.bucket, kind="stable")  # all that follows goes by bucket, so nothing is gathered in a round
    row, bucket = bag.row[by], bag.bucket[by].astype(np.int32)
    value = bag.count[by] / np.sqrt(found[2][row])
    del bag, by
    seen, at = np.unique(bucket, return_index=True)
    model.dense, bias = np.zeros(x.shape[1]), np.zeros(1)
    adam = Adam([bias, model.dense, model.weight], 0.05)
    for _ in range(rounds):
        z = bias[0] + x @ model.dense + np.bincount(row, value * model.weight[bucket], len(texts))
        g = (sigmoid(z) - target) / len(texts)
        gw = l2 * model.weight
        if len(seen):
            gw[seen] += np.add.reduceat(g[row] * value, at)
        adam.step([g.sum(keepdims=True), x.T @ g + 1e-4 * model.dense, gw])
    model.bias = float(bias[0])
    return model


def score_texts(model: Model, texts: list[str]) -> np.ndarray:
    bag = bag_of(texts, model.buckets)
    found = hits(model, bag, len(texts))
    value = bag.count / np.sqrt(found[2][bag.row])
    words = np.bincount(bag.row, value * model.weight[bag.bucket], len(texts))
    return sigmoid(model.bias + ((statistics(*found) - model.mean) / model.scale) @ model.dense + words)


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, rows: int = 6000, unlabelled: int = 2000) -> Model:
    """Fit on at most `rows` labelled and `unlabelled` other documents, all outside the held-out bucket (bounds of the
    one task that fits). The others are the first by a hash of their id; their labels, if any, are not read."""
    chosen = cut(learnable(labels, "toxic", modulus, held, rows))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(bucket_of(F.col("doc_id"), modulus) != held)
    more = ids.join(F.broadcast(chosen), "doc_id", "left_anti").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(unlabelled)
    both = cut(chosen.unionByName(more.withColumn("y", F.lit(None).cast("int"))))
    sample = sample_texts(docs, both, [F.col("text").cast("string").alias("text")])
    return fitted(sample, lambda c: fit([t or "" for t in c["text"]], np.array([np.nan if y is None else y for y in c["y"]], float)))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with the score of every row as one more column; texts are taken whole, null and empty ones as texts without
    words."""
    return scored(docs, ["text"], functools.partial(score_texts, model), name)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **settings) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    docs needs doc_id and text; other columns are ignored. Null ids and repeated rows stay as they are. Empty docs give
    no rows; without labels the seed words decide.
    """
    out = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels, **settings))
    held = F.coalesce(bucket_of(F.col("doc_id"), settings.get("modulus", 5)) == settings.get("held", 0), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
