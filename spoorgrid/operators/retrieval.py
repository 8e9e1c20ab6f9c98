"""Exact vector retrieval in blocks: top-k, score moments, truth ranks, blending and ensembles.

The bank lies in cells with a bound on the scores inside (`pruned`). A query first meets one promising block; its k-th best score there,
or the score of its truth, then decides which other blocks can matter. Moments of plain scores need no scores at all: they follow from the
bank's sums and second moments. Only ensembles over several variants, whose moments are those of a maximum, multiply all blocks with
all blocks. Lanes of queries stay in a task and read blocks from the shared folder, so disk holds the queries and the bank once; truth
ranks send queries to blocks. Score matrices never leave a task and no query-item pairs are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoorgrid.operators import pruned
from spoorgrid.operators.chunks import top_n

DIGITS = 12
BLOCK = 16384  # vectors of a bank block
STEP = 256     # queries of a block whose scores are held at once
PAIRS = 8192   # pairs of a block that are scored exactly at once
PART = 4096    # vectors of a block whose scores are added up at once
DENSE = 16     # of so many pairs one or more worth an exact score: all are scored as a matrix


def _exact(q: np.ndarray, b: np.ndarray, r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best score and variant (the earliest on ties) of the pairs (r, c) of queries (n, variants, d) and vectors."""
    best, which = np.empty(len(r)), np.empty(len(r), dtype=np.int32)
    for at in range(0, len(r), PAIRS):
        s = np.round(np.einsum("pvd,pd->pv", q[r[at:at + PAIRS]], b[c[at:at + PAIRS]]), DIGITS)
        which[at:at + PAIRS] = s.argmax(axis=1)
        best[at:at + PAIRS] = s.max(axis=1)
    return best, which


def _dense(q: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for all pairs, as matrices."""
    best, which = np.round(q[:, 0] @ b.T, DIGITS), np.zeros((len(q), len(b)), dtype=np.int32)
    for v in range(1, q.shape[1]):
        s = np.round(q[:, v] @ b.T, DIGITS)
        up = s > best
        best[up], which[up] = s[up], v
    return best, which


def _same(sorted_ids: np.ndarray, order: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (row, column) at which a column's id is the id of the row."""
    lo, hi = np.searchsorted(sorted_ids, ids), np.searchsorted(sorted_ids, ids, "right")
    rows = np.repeat(np.arange(len(ids)), hi - lo)
    return rows, order[np.arange(len(rows)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]


def _screens(left: pa.Table, right: pa.Table, variants: int):
    """Slices of the queries with the scores of a block in single precision, and how far those may be off the rounded ones.

    They only tell which pairs are worth an exact score. A slack that is not finite lets every pair pass.
    """
    b = pruned.matrix(right, "bvec")
    with np.errstate(over="ignore", invalid="ignore"):
        b32, reach = b.astype(np.float32), np.linalg.norm(b, axis=1).max()
        for at in range(0, left.num_rows, STEP):
            some = left.slice(at, STEP)
            q = pruned.matrix(some, "qvec").reshape(some.num_rows, variants, -1)
            q32 = q.astype(np.float32)
            rough = q32[:, 0] @ b32.T
            for v in range(1, variants):
                np.maximum(rough, q32[:, v] @ b32.T, out=rough)
            size = np.linalg.norm(q, axis=2).max(axis=1) * reach
            slack = np.where(size < 1.0e30, 1.0e-11 + size * (q.shape[2] + 8) * 2.0 ** -22, np.inf)
            yield some, q, b, rough, slack


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _top_tile(variants: int, k: int, skip_self: bool):
    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)], [np.empty(0)], [np.empty(0, dtype=np.int32)], [np.empty(0, dtype=np.int64)]
        if left.num_rows and right.num_rows:
            bid = _numbers(right, "item")
            order = np.argsort(bid, kind="stable")
            ids = bid[order]
            for some, q, b, rough, slack in _screens(left, right, variants):
                qid = _numbers(some, "qid")
                row = _numbers(some, "row") if "row" in some.column_names else qid
                least = _numbers(some, "threshold").astype(np.float64) if "threshold" in some.column_names else np.full(len(qid), np.nan)
                own = _same(ids, order, qid) if skip_self else (np.empty(0, dtype=np.int64),) * 2
                rough[own] = -np.inf
                bar = least - slack
                open_ = np.flatnonzero(np.isnan(least))  # nothing known yet: the k-th of this block decides
                if len(open_):
                    bar[open_] = -np.inf if len(bid) <= k else np.partition(rough[open_], len(bid) - k, axis=1)[:, len(bid) - k] - 2.0 * slack[open_]
                near = ~(rough < bar.astype(np.float64)[:, None])
                near[own] = False
                if near.sum() > near.size // DENSE:
                    best, which = _dense(q, b)
                    r, c = np.nonzero(near)
                    best, which = best[r, c], which[r, c]
                else:
                    r, c = np.nonzero(near)
                    best, which = _exact(q, b, r, c)
                first = np.lexsort((bid[c], -best, r))
                r, c, best, which = r[first], c[first], best[first], which[first]
                keep = np.arange(len(r)) - np.searchsorted(r, r) < k
                for into, part in zip(found, (qid[r], bid[c], best, which, row[r])):
                    into.append(part[keep])
        return pa.table(dict(zip(("qid", "item", "score", "variant", "row"), (np.concatenate(f) for f in found))))

    return tile


def _rank_tile(skip_self: bool):
    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, better = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        if left.num_rows and right.num_rows:
            bid = _numbers(right, "item")
            order = np.argsort(bid, kind="stable")
            for some, q, b, rough, slack in _screens(left, right, 1):
                qid, truth, goal = _numbers(some, "qid"), _numbers(some, "truth"), np.round(_numbers(some, "threshold").astype(np.float64), DIGITS)
                apart = [_same(bid[order], order, truth), *([_same(bid[order], order, qid)] if skip_self else [])]
                sure = rough > (goal + slack)[:, None]
                near = ~(sure | (rough < (goal - slack)[:, None]))
                for own in apart:
                    sure[own] = near[own] = False
                r, c = np.nonzero(near)
                score = _dense(q, b)[0][r, c] if len(r) > near.size // DENSE else _exact(q, b, r, c)[0]
                ahead = (score > goal[r]) | ((score == goal[r]) & (bid[c] < truth[r]))
                ids.append(qid)
                better.append(sure.sum(axis=1) + np.bincount(r[ahead], minlength=len(qid)))
        return pa.table({"qid": np.concatenate(ids), "better": np.concatenate(better)})

    return tile


def _sums(bank: DataFrame, models: int) -> tuple[int, np.ndarray, np.ndarray] | None:
    """Vectors, their sum and their second moments per model (n, [m, d], [m, d, d]); the driver sees models * (d + d * d) numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                b = np.stack(batch["bvec"].to_numpy()).astype(np.float64).reshape(len(batch), models, -1)
                part = np.concatenate([[len(b)], b.sum(axis=0).ravel(), np.matmul(b.transpose(1, 2, 0), b.transpose(1, 0, 2)).ravel()])
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"at": np.arange(len(total)), "part": total})

    parts = bank.where("bvec is not null").select("bvec").mapInPandas(run, "at bigint, part double")
    flat = np.array([r[0] for r in parts.groupBy("at").agg(F.sum("part").alias("part")).orderBy("at").select("part").collect()])
    if not len(flat):
        return None
    d = int(round((np.sqrt(1.0 + 4.0 * (len(flat) - 1) / models) - 1.0) / 2.0))
    return int(flat[0]), flat[1:1 + models * d].reshape(models, d), flat[1 + models * d:].reshape(models, d, d)


def _plain_moments(queries: DataFrame, bank: DataFrame, models: int, skip_self: bool) -> DataFrame:
    sums = _sums(bank, models)
    out = "qid bigint, n bigint, mean array<double>, std array<double>"
    if sums is None:
        return queries.sparkSession.createDataFrame([], out)
    n, first, second = sums
    q = queries.select(F.col("qid").cast("bigint").alias("qid"), "qvec")
    own = bank.select(F.col("item").cast("bigint").alias("qid"), F.col("bvec").alias("_own"))
    q = q.join(own, "qid", "left") if skip_self else q.withColumn("_own", F.lit(None).cast("array<double>"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch["qvec"].notna()]
            if not len(batch):
                continue
            v = np.stack(batch["qvec"].to_numpy()).astype(np.float64).reshape(len(batch), models, -1)
            has = batch["_own"].notna().to_numpy()
            self_score = np.zeros((len(batch), models))
            if has.any():
                mine = np.stack(batch["_own"][has].to_numpy()).astype(np.float64).reshape(int(has.sum()), models, -1)
                self_score[has] = np.round((v[has] * mine).sum(axis=2), DIGITS)
            left = n - has.astype(np.int64)
            some = left > 0
            if not some.any():
                continue
            s1 = np.einsum("nmi,mi->nm", v, first) - self_score
            s2 = (np.matmul(v.transpose(1, 0, 2), second).transpose(1, 0, 2) * v).sum(axis=2) - self_score ** 2
            mean = s1[some] / left[some, None]
            std = np.sqrt(np.maximum(s2[some] / left[some, None] - mean ** 2, 0.0))
            yield pd.DataFrame({"qid": batch["qid"][some].to_numpy(), "n": left[some], "mean": list(mean), "std": list(std)})

    return q.mapInPandas(run, out)


def score_moments(queries: DataFrame, bank: DataFrame, models: int = 1, variants: int = 1, skip_self: bool = True,
                  block_rows: int = 4096) -> DataFrame:
    """Per query: item count and, per model, mean and population deviation of its scores. Queries without any item are not returned.

    A mean of inner products is the product with the mean and their squares follow from the second moments, so one pass over either
    table is enough; the maximum over variants has no such form and takes all blocks with all blocks.
    """
    if variants == 1:
        return _plain_moments(queries, bank, models, skip_self)
    q = queries.select(F.col("qid").cast("bigint").alias("qid"), "qvec")
    placed, cells = pruned.cells_of(bank, block_rows)
    out = "qid bigint, n bigint, mean array<double>, std array<double>"
    if cells is None:
        return q.sparkSession.createDataFrame([], out)
    every = _every_block(cells)

    def lane(left: pa.Table, block) -> pa.Table:
        qid, q = _numbers(left, "qid"), pruned.matrix(left, "qvec").reshape(left.num_rows, models, variants, -1)
        n, mean, std = _lane_moments(qid, q, map(lambda at: block(*at), every), skip_self)
        some = n > 0
        return pa.table({"qid": qid[some], "n": n[some], "mean": list(mean[some]), "std": list(std[some])})

    return pruned.read_by_lanes(q, placed, cells, _lanes(q, cells, block_rows, variants, 1), lane, out)


def _every_block(cells: pruned.Cells) -> list[tuple[int, int]]:
    return [(c, p) for c in np.flatnonzero(cells.rows).tolist() for p in range(int(cells.parts[c]))]


def _lane_moments(qid: np.ndarray, q: np.ndarray, blocks: Iterator[pa.Table], skip_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items, means and deviations of the best variants' scores per query and model."""
    models, variants = q.shape[1:3]
    n, s1, s2 = np.zeros(len(qid), dtype=np.int64), np.zeros((len(qid), models)), np.zeros((len(qid), models))
    for table in blocks:
        if not table.num_rows:
            continue
        bid, b = _numbers(table, "item"), pruned.matrix(table, "bvec").reshape(table.num_rows, models, -1)
        for at in range(0, len(bid), PART):
            ids = bid[at:at + PART]
            order = np.argsort(ids, kind="stable")
            items = [np.ascontiguousarray(b[at:at + PART, m].T) for m in range(models)]
            for step in range(0, len(qid), STEP):
                some = slice(step, step + STEP)
                own = _same(ids[order], order, qid[some]) if skip_self else (np.empty(0, dtype=np.int64),) * 2
                n[some] += len(ids) - np.bincount(own[0], minlength=len(qid[some]))
                for m in range(models):
                    best = q[some, m, 0] @ items[m]
                    for v in range(1, variants):
                        np.maximum(best, q[some, m, v] @ items[m], out=best)
                    best[own] = 0.0
                    s1[some, m] += best.sum(axis=1)
                    s2[some, m] += np.einsum("ij,ij->i", best, best)
    least = np.maximum(n, 1)[:, None]
    mean = s1 / least
    return n, mean, np.sqrt(np.maximum(s2 / least - mean ** 2, 0.0))


def _lanes(queries: DataFrame, cells: pruned.Cells, block_rows: int, variants: int, blocks: int | None = None) -> int:
    """`blocks`: how many tasks share a lane, if not one for each block."""
    tasks = queries.sparkSession.sparkContext.defaultParallelism
    return pruned.lanes_for(queries.count(), block_rows, variants * cells.centres.shape[1], blocks or int(cells.parts.sum()), tasks)


def top_k(queries: DataFrame, bank: DataFrame, k: int, variants: int = 1, skip_self: bool = True,
          block_rows: int = BLOCK) -> DataFrame:
    """Top k items per query with score and best variant; ties go to the lowest id. Rows without a vector take no part."""
    q = queries.select(F.col("qid").cast("bigint").alias("qid"), "qvec")
    placed, cells = pruned.cells_of(bank, block_rows)
    out = "qid bigint, item bigint, score double, variant int"
    if cells is None:
        return q.sparkSession.createDataFrame([], out + ", rank int")
    tile = _top_tile(variants, k, skip_self)

    def lane(left: pa.Table, block) -> pa.Table:
        up = np.concatenate([cells.upper(pruned.matrix(p, "qvec").reshape(p.num_rows, variants, -1)) for p in (left.slice(at, STEP) for at in range(0, left.num_rows, STEP))])
        left = left.append_column("row", pa.array(np.arange(left.num_rows)))
        threshold = np.full(left.num_rows, np.nan)

        def visited(rows: np.ndarray, at: tuple[int, int], known: bool) -> pa.Table:
            some = left.take(pa.array(rows))
            return tile(some.append_column("threshold", pa.array(threshold[rows], from_pandas=False)) if known else some, block(*at))

        if cells.parts.sum() > 1:  # what k items of one promising block already reach; a block of fewer sets no threshold
            full = cells.rows // cells.parts > k
            cell = (np.where(full, up, -np.inf) if full.any() else up).argmax(axis=1)
            part = _numbers(left, "qid") % cells.parts[cell]
            for at in sorted(set(zip(cell.tolist(), part.tolist()))):
                _raise(threshold, visited(np.flatnonzero((cell == at[0]) & (part == at[1])), at, False), k)
        best = None
        for at in _every_block(cells):
            rows = np.flatnonzero(~(up[:, at[0]] < np.where(np.isnan(threshold), -np.inf, threshold)))
            if len(rows):
                found = visited(rows, at, True)
                best = found if best is None else _best(pa.concat_tables([best, found]), k)
                _raise(threshold, best, k)
        return (best if best is not None else tile(left.slice(0, 0), pruned.EMPTY)).drop_columns(["row"])

    found = pruned.read_by_lanes(q, placed, cells, _lanes(q, cells, block_rows, variants, 1), lane, out)
    return top_n(found, ["qid"], [F.desc("score"), F.col("item")], k)


def _best(found: pa.Table, k: int) -> pa.Table:
    """The k best of each row, of equal ones the lowest items."""
    row = _numbers(found, "row")
    order = np.lexsort((_numbers(found, "item"), -_numbers(found, "score"), row))
    row = row[order]
    return found.take(pa.array(order[np.arange(len(row)) - np.searchsorted(row, row) < k]))


def _raise(threshold: np.ndarray, best: pa.Table, k: int) -> None:
    """A row that has k items needs none below the least of them."""
    row, score = _numbers(best, "row"), _numbers(best, "score")
    n, least = np.bincount(row, minlength=len(threshold)), np.full(len(threshold), np.inf)
    np.minimum.at(least, row, score)
    threshold[:] = np.where(n >= k, np.fmax(threshold, least), threshold)


def ensemble_top_k(queries: DataFrame, bank: DataFrame, k: int, weights: list[float], variants: int = 1,
                   skip_self: bool = True, block_rows: int = BLOCK) -> DataFrame:
    """Weighted sum of per-query standardised model scores; the variant comes from the largest contributor.

    A lane of queries reads all blocks twice: for the moments, and for the items. There single precision tells which pairs may reach the k-th best.
    """
    total = float(sum(weights))
    if total <= 0:
        raise ValueError("model weights must sum to a positive value")
    m, share = len(weights), np.asarray(weights, dtype=np.float64) / total
    q = queries.select(F.col("qid").cast("bigint").alias("qid"), "qvec")
    placed, cells = pruned.cells_of(bank, block_rows)
    out = "qid bigint, item bigint, score double, variant int"
    if cells is None:
        return q.sparkSession.createDataFrame([], out + ", rank int")
    every = _every_block(cells)

    def lane(left: pa.Table, block) -> pa.Table:
        qid, q = _numbers(left, "qid"), pruned.matrix(left, "qvec").reshape(left.num_rows, m, variants, -1)
        n, mean, std = _lane_moments(qid, q, map(lambda at: block(*at), every), skip_self)
        std = np.where(std < 1.0e-6, 1.0, std)
        q32, threshold, best = q.astype(np.float32), np.full(len(qid), np.nan), None
        for at in every:
            table = block(*at)
            if not table.num_rows:
                continue
            bid, b = _numbers(table, "item"), pruned.matrix(table, "bvec").reshape(table.num_rows, m, -1)
            order = np.argsort(bid, kind="stable")
            b32, reach, hits = [np.ascontiguousarray(b[:, i].T, dtype=np.float32) for i in range(m)], np.linalg.norm(b, axis=2).max(axis=0), []
            for step in range(0, len(qid), STEP):
                some = np.arange(step, min(step + STEP, len(qid)))
                rough, slack = _rough_ensemble(q[some], q32[some], b32, reach, mean[some], share / std[some])
                own = _same(bid[order], order, qid[some]) if skip_self else (np.empty(0, dtype=np.int64),) * 2
                rough[own] = -np.inf
                bar, open_ = threshold[some] - slack, np.flatnonzero(np.isnan(threshold[some]))
                if len(open_):
                    bar[open_] = -np.inf if len(bid) <= k else np.partition(rough[open_], len(bid) - k, axis=1)[:, len(bid) - k] - 2.0 * slack[open_]
                near = ~(rough < bar[:, None])
                near[own] = False
                r, c = np.nonzero(near)
                score, variant = _ensemble_scores(q[some], b, r, c, mean[some], std[some], share)
                hits.append(pa.table({"qid": qid[some][r], "item": bid[c], "score": score, "variant": variant, "row": some[r]}))
            best = _best(pa.concat_tables([*([best] if best is not None else []), *hits]), k)
            _raise(threshold, best, k)
        return best.drop_columns(["row"])

    found = pruned.read_by_lanes(q, placed, cells, _lanes(q, cells, block_rows, variants, 1), lane, out)
    return top_n(found, ["qid"], [F.desc("score"), F.col("item")], k)


def _rough_ensemble(q, q32, b32, reach, mean, scale) -> tuple[np.ndarray, np.ndarray]:
    """Scores of all pairs in single precision, and how far those may be off the rounded ones; a slack that is not finite lets every pair pass."""
    with np.errstate(over="ignore", invalid="ignore"):
        rough, slack = None, 1.0e-11
        for m in range(len(b32)):
            one = q32[:, m, 0] @ b32[m]
            for v in range(1, q.shape[2]):
                np.maximum(one, q32[:, m, v] @ b32[m], out=one)
            one -= mean[:, m, None].astype(np.float32)
            one *= scale[:, m, None].astype(np.float32)
            rough = one if rough is None else rough + one
            size = np.linalg.norm(q[:, m], axis=2).max(axis=1) * reach[m]
            slack = slack + abs(scale[:, m]) * (1.0e-11 + size * (q.shape[3] + 16) * 2.0 ** -22)
        return rough, np.where((slack < 1.0e30) & np.isfinite(scale).all(axis=1), slack, np.inf)


def _ensemble_scores(q, b, r, c, mean, std, share) -> tuple[np.ndarray, np.ndarray]:
    score, variant = np.empty(len(r)), np.empty(len(r), dtype=np.int32)
    for at in range(0, len(r), PAIRS):
        i, j = r[at:at + PAIRS], c[at:at + PAIRS]
        s = np.round(np.einsum("pmvd,pmd->pmv", q[i], b[j]), DIGITS)
        z = (s.max(axis=2) - mean[i]) / std[i] * share
        score[at:at + PAIRS] = np.round(z.sum(axis=1), DIGITS)
        variant[at:at + PAIRS] = np.take_along_axis(s.argmax(axis=2), z.argmax(axis=1)[:, None], axis=1)[:, 0]
    return score, variant


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def truth_rank(queries: DataFrame, bank: DataFrame, skip_self: bool = True, block_rows: int = BLOCK) -> DataFrame:
    """Rank of the item named by `truth` among all items of each query (1 is best)."""
    t = bank.select(F.col("item").alias("truth"), F.col("bvec").alias("_tv"))
    q = queries.join(t, "truth").withColumn("goal", F.round(_dot(F.col("qvec"), F.col("_tv")), DIGITS)).drop("_tv")
    placed, cells = pruned.cells_of(bank, block_rows)
    if cells is None:
        return q.select("qid", "truth", F.col("goal").alias("truth_score"), F.lit(1).cast("bigint").alias("truth_rank"))
    asked = q.select(F.col("qid").cast("bigint").alias("qid"), "qvec", F.col("truth").cast("bigint").alias("truth"),
                     F.col("goal").alias("threshold"))
    tiles = pruned.visit(asked, placed, cells, 1, _lanes(asked, cells, block_rows, 1), None, _rank_tile(skip_self),
                         "qid bigint, better bigint")
    ranks = tiles.groupBy("qid").agg((F.sum("better") + 1).alias("truth_rank"))
    return q.select("qid", "truth", F.col("goal").alias("truth_score")).join(ranks, "qid")


def blended_variants(queries: DataFrame, bank: DataFrame, weight: float, variants: int, dims: int, skip_self: bool = True,
                     block_rows: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(qid, v, vec) and a bank: dot products are (1 - w) * z(model 0) + w * z(model 1), standardised per query and variant.

    A linear blend of standardised scores is itself linear in the item, so it folds into one longer vector
    and every retrieval operator applies to the result unchanged.
    """
    each = queries.select("qid", "qvec", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))).alias("v"))

    def part(m):
        return F.slice("qvec", F.lit(m * variants * dims + 1) + F.col("v") * dims, dims)

    single = each.select("qid", "v", (F.col("qid") * variants + F.col("v")).alias("_sid"), part(0).alias("p0"), part(1).alias("p1"))
    # a variant must not score its own item, so moments subtract the self score when asked to
    flat = single.select(F.col("_sid").alias("qid"), F.concat("p0", "p1").alias("qvec"))
    stats = score_moments(flat, bank, 2, 1, False, block_rows).withColumnRenamed("qid", "_sid")
    s = single.join(stats, "_sid")
    if skip_self:
        own = bank.select(F.col("item").alias("qid"), F.slice("bvec", 1, dims).alias("o0"), F.slice("bvec", dims + 1, dims).alias("o1"))
        s = s.join(own, "qid", "left")
        n = F.col("n") - F.when(F.col("o0").isNotNull(), 1).otherwise(0)
        mean, std = [], []
        for m in (0, 1):
            o = F.coalesce(F.round(_dot(F.col(f"p{m}"), F.col(f"o{m}")), DIGITS), F.lit(0.0))
            s1 = F.col("mean")[m] * F.col("n") - o
            s2 = (F.col("std")[m] * F.col("std")[m] + F.col("mean")[m] * F.col("mean")[m]) * F.col("n") - o * o
            mean.append(s1 / n)
            std.append(F.sqrt(F.greatest(s2 / n - (s1 / n) * (s1 / n), F.lit(0.0))))
        s = s.withColumns({"mean": F.array(*mean), "std": F.array(*std)})
    scale = [F.lit(w) / F.when(F.col("std")[m] < 1.0e-6, 1.0).otherwise(F.col("std")[m])
             for m, w in ((0, 1.0 - weight), (1, weight))]
    shift = -(scale[0] * F.col("mean")[0] + scale[1] * F.col("mean")[1])
    s = s.withColumns({"_a": scale[0], "_b": scale[1], "_c": shift})
    vec = F.concat(F.transform("p0", lambda x: x * F.col("_a")), F.transform("p1", lambda x: x * F.col("_b")), F.array("_c"))
    return s.select("qid", "v", vec.alias("vec")), bank.select("item", F.concat("bvec", F.array(F.lit(1.0))).alias("bvec"))


def blended(queries: DataFrame, bank: DataFrame, weight: float, variants: int, dims: int, skip_self: bool = True,
            block_rows: int = 4096) -> tuple[DataFrame, DataFrame]:
    """The same with the variants of a query one after the other, as retrieval takes them."""
    singles, items = blended_variants(queries, bank, weight, variants, dims, skip_self, block_rows)
    packed = singles.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("v", "vec"))).alias("_v"))
    return packed.select("qid", F.flatten(F.transform("_v", lambda x: x["vec"])).alias("qvec")), items


def rerank_variants(singles: DataFrame, bank: DataFrame, variants: int, local: Column, k: int, weight: float, n: int,
                    skip_self: bool = True, block_rows: int = BLOCK) -> DataFrame:
    """The n best items of each query by the largest of its variants' reranked scores: qid, item, final, variant, final_rank.

    Each variant has a shortlist of its own, its k best items, whose scores gain weight * z(local), z over that shortlist; only then the
    variants of an item are compared (the first one wins ties). `local` is an expression over qid, v and item. singles: qid, v, vec. A variant
    hands on n items beyond its shortlist: behind those, an item has n better ones whatever its other variants say.
    """
    flat = singles.select((F.col("qid") * variants + F.col("v")).alias("qid"), F.col("vec").alias("qvec"))
    top = top_k(flat, bank, k + n + int(skip_self), skip_self=False, block_rows=block_rows).drop("rank", "variant")
    top = top.select(F.floor(F.col("qid") / variants).alias("qid"), (F.col("qid") % variants).cast("int").alias("v"), "item", "score")
    top = top.where(F.col("qid") != F.col("item")) if skip_self else top
    order = Window.partitionBy("qid", "v").orderBy(F.desc("score"), "item")
    top = top.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k + n)
    listed = Window.partitionBy("qid", "v", F.col("_rank") <= k)
    top = top.withColumn("_local", local)
    dev = F.stddev_pop("_local").over(listed)
    z = (F.col("_local") - F.avg("_local").over(listed)) / F.when(dev < 1.0e-6, 1.0).otherwise(dev)
    top = top.withColumn("final", F.round(F.col("score") + F.when(F.col("_rank") <= k, F.lit(weight) * z).otherwise(0.0), DIGITS))
    best = top.groupBy("qid", "item").agg(F.max("final").alias("final"), F.min_by("v", F.struct(-F.col("final"), F.col("v"))).alias("variant"))
    return top_n(best, ["qid"], [F.desc("final"), F.col("item")], n, "final_rank")


def retrieval_report(ranks: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Top-1 accuracy, recall@k and mean reciprocal rank of truth ranks."""
    return ranks.agg(F.count("*").alias("queries"), F.avg((F.col("truth_rank") == 1).cast("double")).alias("top1"),
                     *[F.avg((F.col("truth_rank") <= k).cast("double")).alias(f"recall_{k}") for k in ks],
                     F.avg(1.0 / F.col("truth_rank")).alias("mrr"))


def info_nce(scores: DataFrame, temperature: float) -> DataFrame:
    """Contrastive loss per query over its positive and sampled negatives (a bounded set per query)."""
    s = scores.withColumn("_s", F.col("score") / F.lit(float(temperature)))
    s = s.withColumn("_m", F.max("_s").over(Window.partitionBy("qid")))
    return s.groupBy("qid").agg((F.log(F.sum(F.exp(F.col("_s") - F.col("_m")))) + F.max("_m")
                                 - F.max(F.when(F.col("positive"), F.col("_s")))).alias("loss"))


def forced_truth(candidates: DataFrame, truth: DataFrame, k: int, seed: Column) -> DataFrame:
    """Top-k candidate sets in which a missing truth replaces the last slot, then a seeded shuffle.

    candidates: qid, item, rank; truth: qid, truth. The order key is seeded arithmetic on the item.
    """
    c = candidates.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "item"))).alias("_c"))
    c = c.join(truth, "qid")
    ids = F.transform("_c", lambda s: s["item"])
    fixed = F.when(F.array_contains(ids, F.col("truth")), ids).otherwise(
        F.concat(F.slice(ids, 1, k - 1), F.array("truth")))
    out = c.select("qid", "truth", F.posexplode(fixed).alias("slot", "item"))
    key = F.pmod(F.col("item") * F.lit(7919) + seed * F.lit(104729), F.lit(1000003))
    return out.withColumn("shuffled", F.row_number().over(Window.partitionBy("qid").orderBy(key, "item")) - 1)
