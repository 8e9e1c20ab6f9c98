"""Near-duplicate embeddings by iterative quantisation.

A rotation of the principal components is learned so that the signs of the rotated vectors are balanced codes that lose
little. Codes are looked up in multi-index Hamming tables: each substring of the code, with any one of its bits left
out, is a key, so codes whose substrings differ in at most one bit meet. Codes at most `code_bits` apart form candidate
groups, and there the original vectors decide: cosines in double precision, counted for every vector.

Identical vectors are one row with a weight. Candidate groups are compared in pairs of parts of bounded size; a task
returns counts and a spanning forest of its links rather than all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorgrid.llm.cells import linked, within
from spoorgrid.llm.common import written
from spoorgrid.llm.components import components
from spoorgrid.llm.vectors import mapped, matrix, raw, sample, slim

RESULT = "vec_id long, n_links long, component_id long, kept boolean"


def learn_rotation(x: np.ndarray, bits: int, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): principal directions times the rotation that brings their values closest to signs."""
    rng = np.random.default_rng(29)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    mean = unit.mean(0)
    _, _, directions = np.linalg.svd(unit - mean, full_matrices=False)
    basis = directions[:bits].T
    if basis.shape[1] < bits:  # fewer dimensions or sample rows than bits: more random directions
        basis = np.concatenate([basis, rng.normal(size=(x.shape[1], bits - basis.shape[1])) / np.sqrt(x.shape[1])], 1)
    v = (unit - mean) @ basis
    rotation = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.where(v @ rotation >= 0, 1.0, -1.0).T @ v)
        rotation = (left @ right).T
    return mean, basis @ rotation


def code(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.packbits((unit - mean) @ projection >= 0, axis=1, bitorder="little").view("<i8").ravel()


def probes(nodes: DataFrame, width: int) -> DataFrame:
    """(table, cell, code): one key for each substring of `width` bits and each bit of it left out."""
    keys = []
    for s in range(64 // width):
        piece = F.shiftrightunsigned("code", s * width).bitwiseAND(F.lit((1 << width) - 1))
        for b in range(width):
            keys.append(F.struct(F.lit(s * width + b).alias("table"), F.xxhash64(F.lit(s * width + b), piece.bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << b)))).alias("cell")))
    return nodes.select("code", F.inline(F.array(*keys)))


def near_duplicates(embeddings: DataFrame, cosine: float = 0.95, code_bits: int = 14, width: int = 16, sample_rows: int = 4000,
                    part_rows: int = 512) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id and kept for every row of embeddings.

    embeddings needs vec_id and embedding; other columns are ignored. Vectors that are null, zero, of another length
    than the most common one of the sample, or hold null or non-finite components link with nothing; nor do rows with
    a null vec_id, whose component_id and kept are null. Repeated rows link with each other and are both returned. An
    empty table gives no rows. `sample_rows` bounds what the rotation is learned from; every row is indexed.
    """
    _, x = sample(embeddings, sample_rows)
    every = slim(embeddings).select("vec_id")
    alone = every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    alone = alone.withColumn("kept", F.when(F.col("kept"), True))
    if not len(x):
        return alone
    dim = x.shape[1]
    mean, projection = learn_rotation(x, 64)
    coded = written(mapped(embeddings, dim, lambda ids, y: [ids, raw(y), code(y, mean, projection)], "vec_id long, vec binary, code long"), "itq-codes")
    # identical vectors are one node; the digest names them
    digest = F.sha2("vec", 256).alias("node")
    nodes = coded.groupBy(digest, "code").agg(F.first("vec").alias("vec"), F.count("*").alias("weight"), F.min("vec_id").alias("first"))
    nodes = written(nodes.withColumn("id", F.monotonically_increasing_id()), "itq-nodes")

    codes = nodes.select("code").distinct()
    groups = components(linked(probes(codes, width), code_bits, within(code_bits)))
    nodes = nodes.join(groups.select(F.col("node").alias("code"), "root"), "code", "left").withColumn("root", F.coalesce("root", "code"))
    crowd = nodes.groupBy("root").agg(F.count("*").alias("_n")).where("_n > 1")
    held = nodes.join(crowd, "root").withColumn("_k", F.ceil(F.col("_n") / part_rows).cast("int"))
    held = held.withColumn("_i", F.pmod(F.xxhash64("id"), F.col("_k")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda p: F.struct(F.least(p, F.col("_i")).alias("lo"), F.greatest(p, F.col("_i")).alias("hi")))
    held = held.select("root", "id", "vec", "weight", "_i", F.inline(pairs))

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lo, hi = key[1], key[2]
        side = lambda p: rows[rows["_i"] == p]
        a, b = side(lo), side(hi)
        unit = lambda r: (lambda m: m / np.linalg.norm(m, axis=1, keepdims=True))(matrix(r["vec"].tolist(), dim))
        near = unit(a) @ unit(b).T >= cosine if len(a) and len(b) else np.zeros((len(a), len(b)), bool)
        if lo == hi:
            np.fill_diagonal(near, False)
        ia, ib = a["id"].to_numpy(), b["id"].to_numpy()
        counts = [(ia, near @ b["weight"].to_numpy())] + ([] if lo == hi else [(ib, near.T @ a["weight"].to_numpy())])
        # a spanning forest: follow unseen neighbours from each unseen row
        links, left_a, left_b = [], np.ones(len(a), bool), np.ones(len(b), bool)
        for start in range(len(a)):
            if not left_a[start]:
                continue
            left_a[start] = False
            if lo == hi:
                left_b[start] = False
            todo = [(True, start)]
            while todo:
                on_a, at = todo.pop()
                free, names = (left_b, ib) if on_a else (left_a, ia)
                new = np.flatnonzero((near[at] if on_a else near[:, at]) & free)
                free[new] = False
                if lo == hi:
                    left_a[new] = left_b[new] = False
                own = ia[at] if on_a else ib[at]
                links += [(own, n) for n in names[new].tolist()]
                todo += [((lo == hi) or not on_a, n) for n in new.tolist()]
        found = np.array(links, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": np.concatenate([c[0] for c in counts] + [found[:, 0]]), "b": np.concatenate([c[0] for c in counts] + [found[:, 1]]),
                             "n": np.concatenate([c[1] for c in counts] + [np.zeros(len(found), np.int64)])})

    found = written(held.groupBy("root", "lo", "hi").applyInPandas(compare, "a long, b long, n long"), "itq-links")
    counts = found.where("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    roots = components(found.where("a != b").select("a", "b")).select(F.col("node").alias("id"), F.col("root").alias("top"))
    result = nodes.select("id", "node", "code", "weight", "first").join(counts, "id", "left").join(roots, "id", "left")
    result = result.withColumn("top", F.coalesce("top", "id"))
    names = result.groupBy("top").agg(F.min("first").alias("component_id"))
    result = result.join(names, "top").select("node", "code", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    rows = coded.select("vec_id", digest, "code").join(result, ["node", "code"]).select("vec_id", "n_links", "component_id")
    rows = rows.withColumn("kept", F.col("vec_id") == F.col("component_id"))
    return rows.unionByName(unusable(embeddings, dim))


def unusable(embeddings: DataFrame, dim: int) -> DataFrame:
    """Rows whose vector links with nothing."""
    e = F.col("embedding")
    bad = F.col("vec_id").isNull() | e.isNull() | (F.size(e) != dim)
    bad = bad | F.exists(e, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) | F.forall(e, lambda c: c == 0)
    rows = slim(embeddings).where(F.coalesce(bad, F.lit(True)))
    return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.when(F.col("vec_id").isNotNull(), True).alias("kept"))
