"""Quality reports: position errors, regression, ranking, thresholds, strata, permutation tests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorgrid.operators.chunks import _keys, ordered_running, ranked
from spoorgrid.operators.quantiles import exact_quantiles, with_quantiles
from spoorgrid.session import cut


def error_summary(df: DataFrame, keys, error: str, extra: list[Column] | None = None) -> DataFrame:
    """n, mean, median, P95, max, shares below 0.5 and 1 (strict) and count at or above 0.5 (NULLs when empty)."""
    keys = _keys(keys)
    e = F.col(error)
    base = df.groupBy(*keys).agg(
        F.count(e).alias("n"), F.avg(e).alias("mean_error"), F.max(e).alias("max_error"),
        F.avg((e < 0.5).cast("double")).alias("below_0p5"), F.avg((e < 1.0).cast("double")).alias("below_1"),
        F.count_if(e >= 0.5).alias("at_least_0p5"), *(extra or []))
    return with_quantiles(base, df, keys, error, {"median_error": 0.5, "p95_error": 0.95})


def with_combined(df: DataFrame, key: str, label: str = "combined") -> DataFrame:
    """Each row once under its own key and once under the combined label (two-level report)."""
    return df.withColumn(key, F.explode(F.array(F.col(key).cast("string"), F.lit(label))))


def safe_correlation(x: str, y: str, empty=None) -> Column:
    """Pearson correlation, `empty` when n < 2 or either side is (nearly) constant."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    ok = (F.count(F.col(x)) >= 2) & (sx > 1.0e-12) & (sy > 1.0e-12)
    return F.when(ok, F.covar_pop(x, y) / F.nullif(sx * sy, F.lit(0.0))).otherwise(F.lit(empty).cast("double"))


def regression_report(df: DataFrame, keys, predicted: str, target: str) -> DataFrame:
    """MAE, RMSE and Pearson (0.0 when undefined)."""
    d = F.col(predicted) - F.col(target)
    return df.groupBy(*_keys(keys)).agg(F.count("*").alias("n"), F.avg(F.abs(d)).alias("mae"),
                                        F.sqrt(F.avg(d * d)).alias("rmse"),
                                        safe_correlation(predicted, target, 0.0).alias("pearson"))


def threshold_sweep(df: DataFrame, score: str, positive: str, thresholds: list[float]) -> DataFrame:
    """TP / FP / FN, precision, recall and F1 per threshold (score >= threshold). One pass over the data."""
    hit = [F.col(score) >= F.lit(float(t)) for t in thresholds]
    pos = F.col(positive)
    aggs = []
    for i, h in enumerate(hit):
        aggs += [F.count_if(h & pos).alias(f"tp{i}"), F.count_if(h & ~pos).alias(f"fp{i}"), F.count_if(~h & pos).alias(f"fn{i}")]
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"),
                              F.col(f"fn{i}").alias("fn")) for i, t in enumerate(thresholds)])
    return prf(df.agg(*aggs).select(F.inline(rows)))


def prf(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 from tp, fp and fn."""
    one = F.lit(1)
    out = counts.withColumns({"precision": F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), one),
                              "recall": F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), one)})
    return out.withColumn("f1", 2.0 * F.col("precision") * F.col("recall")
                          / F.greatest(F.col("precision") + F.col("recall"), F.lit(1.0e-8)))


def best_threshold(sweep: DataFrame, by: str = "f1") -> DataFrame:
    """The row with the best score; the lowest threshold wins ties."""
    return sweep.agg(F.max_by(F.struct(*sweep.columns), F.struct(F.col(by), -F.col("threshold"))).alias("b")).select("b.*")


def ranking_quality(df: DataFrame, score: str, positive: str) -> DataFrame:
    """Average precision over distinct thresholds and tie-aware ROC-AUC.

    Rows are first counted per distinct score; the running sums then go over score buckets.
    """
    c = df.groupBy(F.col(score).alias("_s")).agg(F.count_if(positive).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    r = ordered_running(c, [], "_s", {"cp": "p", "cq": "q"}, descending=True, totals={"tp": "p", "tq": "q"})
    return r.agg(
        F.sum("p").alias("positives"), F.sum("q").alias("negatives"),
        F.sum(F.col("p") / F.col("tp") * F.col("cp") / (F.col("cp") + F.col("cq"))).alias("average_precision"),
        F.sum(F.col("p") * (F.col("tq") - F.col("cq") + 0.5 * F.col("q")) / (F.col("tp") * F.col("tq"))).alias("roc_auc"))


def alarm_size(n, fraction: float) -> Column:
    """max(1, n * fraction rounded half to even)."""
    return F.greatest(F.lit(1), F.bround(F.col(n) * F.lit(float(fraction)), 0).cast("bigint"))


def alarms(df: DataFrame, score: str, ties: list, fraction: float) -> DataFrame:
    """The top fraction of rows by score, with their rank."""
    r = ranked(df, [], score, ties, name="alarm_rank", total="_n")
    return r.where(F.col("alarm_rank") <= alarm_size("_n", fraction)).drop("_n")


def alarm_budgets(df: DataFrame, score: str, ties: list, positive: str, fractions: list[float]) -> DataFrame:
    """Recall and precision when only a fraction of rows may raise an alarm."""
    r = ranked(df, [], score, ties, name="_r", total="_n")
    aggs = [F.count_if(positive).alias("_p"), F.max("_n").alias("_n")]
    for i, f in enumerate(fractions):
        aggs.append(F.count_if((F.col("_r") <= alarm_size("_n", f)) & F.col(positive)).alias(f"_t{i}"))
    rows = F.array(*[F.struct(F.lit(float(f)).alias("fraction"), alarm_size("_n", f).alias("alarms"),
                              F.col(f"_t{i}").alias("true_positives")) for i, f in enumerate(fractions)])
    out = r.agg(*aggs).select("_p", F.inline(rows))
    return out.select("fraction", "alarms", "true_positives",
                      F.when(F.col("_p") > 0, F.col("true_positives") / F.col("_p")).otherwise(0.0).alias("recall"),
                      (F.col("true_positives") / F.col("alarms")).alias("precision"))


def recall_curve(df: DataFrame, score: str, ties: list, positive: str) -> DataFrame:
    """Budget share and cumulative recall after each row in score order."""
    d = df.withColumns({"_one": F.lit(1).cast("bigint"), "_p": F.col(positive).cast("bigint")})
    r = ordered_running(d, [], score, {"_r": "_one", "_cp": "_p"}, True, ties, totals={"_n": "_one", "_tp": "_p"})
    return r.select(*df.columns, (F.col("_r") / F.col("_n")).alias("budget"),
                    (F.col("_cp") / F.greatest(F.col("_tp"), F.lit(1))).alias("recall"))


def quartile_contrast(df: DataFrame, by: str, error: str) -> DataFrame:
    """Errors of rows at or below the first and at or above the third quartile of `by`."""
    q = exact_quantiles(df, [], by, {"q1": 0.25, "q3": 0.75}).select(F.struct("q1", "q3")).scalar()
    d = df.withColumn("_q", q)
    low, high = F.col(by) <= F.col("_q.q1"), F.col(by) >= F.col("_q.q3")
    return d.agg(F.max("_q.q1").alias("q1"), F.max("_q.q3").alias("q3"), F.count_if(low).alias("low_n"),
                 F.count_if(high).alias("high_n"), F.avg(F.when(low, F.col(error))).alias("low_mean"),
                 F.avg(F.when(high, F.col(error))).alias("high_mean"))


def _split_takes(takes: DataFrame, leaves: DataFrame, levels: int, seed: int) -> DataFrame:
    """(trial, c, take): how many group members each trial puts into each leaf, from (trial, take) of the whole.

    The leaves are the last level of a binary tree. Each level divides the members of a node between its two halves by a hypergeometric draw,
    seeded by trial and node; nodes without members are dropped, so a level has no more rows than trials times members or nodes.
    """

    def divide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            left = [np.random.default_rng([seed, 0, int(lv), int(node), int(t)]).hypergeometric(int(x), int(y), int(n)) if x and y else n if x else 0
                    for lv, node, t, x, y, n in zip(b.level, b.c, b.trial, b.left_size, b.right_size, b["take"])]
            left = np.array(left, np.int64)
            out = pd.DataFrame({"trial": np.tile(b.trial, 2), "c": np.concatenate([2 * b.c, 2 * b.c + 1]), "take": np.concatenate([left, b["take"] - left])})
            yield out[out["take"] > 0]

    takes = takes.select("trial", F.lit(0).cast("long").alias("c"), "take")
    for level in range(levels):
        half = F.expr(f"shiftright(c, {levels - level - 1})")
        size = [F.coalesce(F.sum(F.when(half % 2 == side, F.col("k"))), F.lit(0)).alias(n) for side, n in ((0, "left_size"), (1, "right_size"))]
        nodes = leaves.groupBy(F.expr(f"shiftright(c, {levels - level})").alias("c")).agg(*size).withColumn("level", F.lit(level))
        takes = cut(takes.join(nodes, "c").mapInPandas(divide, "trial long, c long, take long"))
    return takes


def permutation_test(df: DataFrame, value: str, group: str, trials: int = 20000, seed: int = 0,
                     chunk_rows: int = 65536) -> DataFrame:
    """Two-sided permutation test of mean(group) - mean(rest), with the +1 correction.

    A trial draws how many group members fall into each chunk, by halves of halves of the chunks, and then which rows of a chunk they are:
    together a uniform permutation, without any task seeing more than one chunk of values, nor any row a list of all chunks.
    """
    given = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    n_chunks = max(1, -(-given.count() // chunk_rows))
    packed = given.groupBy(F.pmod(F.xxhash64(value, F.monotonically_increasing_id()), F.lit(n_chunks)).alias("c")).agg(
        F.sort_array(F.collect_list(F.col(value).cast("double"))).alias("v"), F.count_if(group).alias("m"))
    packed = cut(packed)  # the row-to-chunk assignment must not change between the uses below
    members = packed.agg(F.sum("m").alias("m")).scalar()
    start = df.sparkSession.range(0, trials, 1, 32).select(F.col("id").alias("trial"), F.coalesce(members, F.lit(0)).alias("take"))
    takes = _split_takes(start, packed.select("c", F.size("v").cast("long").alias("k")), (n_chunks - 1).bit_length(), seed)
    takes = takes.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("trial", "take"))).alias("takes"))  # one entry a trial

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                values, pick = np.asarray(row.v), np.random.default_rng([seed, 1, int(row.c)])
                whole, parts = values.sum(), []
                for t in row.takes:  # the smaller of the group and the rest is drawn
                    n, few = t["take"], min(t["take"], len(values) - t["take"])
                    some = values[pick.choice(len(values), few, replace=False, shuffle=False)].sum()
                    parts.append(some if few == n else whole - some)
                yield pd.DataFrame({"trial": [t["trial"] for t in row.takes], "part": parts})

    totals = given.agg(F.count("*").alias("n"), F.sum(F.col(value).cast("double")).alias("s"), F.count_if(group).alias("m"),
                       F.sum(F.when(F.col(group), F.col(value))).alias("g")).select(F.struct("*")).scalar()
    sums = packed.join(takes, "c").mapInPandas(add, "trial bigint, part double").groupBy("trial").agg(F.sum("part").alias("x"))
    sums = sums.withColumn("t", totals)

    def gap(x):
        return x / F.col("t.m") - (F.col("t.s") - x) / (F.col("t.n") - F.col("t.m"))

    hit = F.abs(gap(F.col("x"))) >= F.abs(gap(F.col("t.g"))) - 1.0e-12
    return sums.agg(F.max(gap(F.col("t.g"))).alias("mean_difference"),
                    ((F.count_if(hit) + 1) / (F.count("*") + 1)).alias("p_value"))
