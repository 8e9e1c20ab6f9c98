import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spoorgrid.operators import chunks as C
from spoorgrid.operators import quantiles as Q
from spoorgrid.operators import sequence


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    n = 3000
    k = np.where(rng.random(n) < 0.7, 0, rng.integers(1, 4, n))  # one hot key
    pdf = pd.DataFrame({"k": k, "v": rng.integers(0, 2, n), "x": np.round(rng.random(n), 3)})
    pdf["i"] = pdf.groupby("k").cumcount()
    return pdf, spark.createDataFrame(pdf).repartition(5)


@pytest.mark.parametrize("gap", [0, 2])
def test_run_starts_across_chunk_borders(spark, data, gap):
    pdf = data[0].sample(frac=0.7, random_state=1).sort_values(["k", "i"])
    got = C.run_starts(spark.createDataFrame(pdf).repartition(3), "k", "i", "v", gap, 16).toPandas().sort_values(["k", "i"])
    want = []
    for _, g in pdf.groupby("k"):
        prev = start = None
        for i, v in zip(g.i, g.v):
            if prev is None or i - prev[0] > gap + 1 or v != prev[1]:
                start = i
            want.append(start)
            prev = (i, v)
    assert (got.run_start.values == np.array(want)).all()


def test_lags_and_ordinals(data):
    pdf, df = data
    out = C.lagged(df, "k", "i", {"a": ("x", 1), "b": ("x", 3), "c": ("x", -2)}, 16).toPandas().sort_values(["k", "i"])
    g = pdf.sort_values(["k", "i"]).groupby("k").x
    for name, n in (("a", 1), ("b", 3), ("c", -2)):
        assert np.allclose(out[name].values, g.shift(n).values, equal_nan=True)
    o = C.dense_ordinal(df.withColumn("t", F.col("i") * 3 + 7), "k", "t", F.floor(F.col("t") / 100)).toPandas()
    assert (o.ordinal == o.i).all()


def test_ranks_and_running_sums(data):
    pdf, df = data
    r = C.ranked(df, [], "x", [F.col("k"), F.col("i")], parts=8, total="n").toPandas().sort_values(["x", "k", "i"], ascending=[False, True, True])
    assert (r["rank"].values == np.arange(1, len(pdf) + 1)).all() and (r.n == len(pdf)).all()


@pytest.mark.parametrize("kinds", [1, 5, 3000])
def test_few_values_are_spread_over_all_tasks(data, kinds):
    pdf, df = data
    few = df.withColumn("y", F.pmod("i", F.lit(kinds)).cast("double"))
    dealt = C.in_order(few, [F.desc("y"), F.col("k")], 8)
    sizes = [r["count"] for r in dealt.groupBy("_chunk").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * len(pdf) / 8
    ranks = C.ranked(few, [], "y", [F.col("k"), F.col("i")], parts=8).toPandas().sort_values(["y", "k", "i"], ascending=[False, True, True])
    assert (ranks["rank"].values == np.arange(1, len(pdf) + 1)).all()
    keyed = C.ranked(few, "k", "y", [F.col("i")], parts=8, total="n").toPandas().sort_values(["k", "y", "i"], ascending=[True, False, True])
    assert (keyed["rank"] == keyed.groupby("k").cumcount() + 1).all() and (keyed.n == keyed.groupby("k").k.transform("size")).all()


def test_no_range_that_is_sorted_is_above_the_bound(spark, monkeypatch):
    seen = []
    real = Q._narrowed
    monkeypatch.setattr(Q, "_narrowed", lambda *a: seen.append(real(*a)) or seen[-1])
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), (F.col("id") * F.col("id")).cast("double").alias("x"))
    got = Q.exact_quantiles(df, "k", "x", {"a": 0.0, "b": 0.33, "c": 0.5, "d": 1.0}, 20).orderBy("k").collect()
    want = df.toPandas().groupby("k").x.quantile([0, 0.33, 0.5, 1]).unstack().values
    assert np.allclose([[r.a, r.b, r.c, r.d] for r in got], want)
    assert seen and seen[-1].agg(F.max("_d")).first()[0] <= 20


@pytest.mark.parametrize("bound", [2, 64, 10_000])
def test_quantiles_match_linear_interpolation(data, bound):
    pdf, df = data
    got = Q.exact_quantiles(df, "k", "x", {"lo": 0.1, "mid": 0.5, "hi": 0.95}, bound).toPandas().sort_values("k")
    want = pdf.groupby("k").x.quantile([0.1, 0.5, 0.95]).unstack()
    assert np.allclose(got[["lo", "mid", "hi"]].values, want.values)
    many = Q.exact_quantiles_of(df, ["k"], {"x": {"a": 0.5}, "i": {"b": 0.25}}).toPandas().sort_values("k")
    assert np.allclose(many.a, want[0.5].values) and np.allclose(many.b, pdf.groupby("k").i.quantile(0.25).values)


def test_results_do_not_depend_on_partitioning(data):
    _, df = data
    a = C.run_starts(df.repartition(1), "k", "i", "v", chunk=32).toPandas().sort_values(["k", "i"]).reset_index(drop=True)
    b = C.run_starts(df.repartition(9, "x"), "k", "i", "v", chunk=128).toPandas().sort_values(["k", "i"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)


def test_two_sided_as_of(spark):
    rng = np.random.default_rng(3)
    ev = sorted(rng.choice(500, 60, replace=False).tolist())
    probes = [(0, int(a)) for a in range(0, 500, 7)]
    got = C.events_around(spark.createDataFrame(probes, "k int, at int"), spark.createDataFrame([(0, int(e)) for e in ev], "k int, e int"),
                          "k", "at", "e", 5, "p", "n", 32).collect()
    for r in got:
        assert r.p == max((e for e in ev if e <= r.at - 5), default=None)
        assert r.n == min((e for e in ev if e >= r.at + 5), default=None)


def test_presence_segments_tolerate_gaps(spark):
    df = spark.createDataFrame([(0, i) for i in (0, 1, 4, 8, 9, 20)], "s int, i int")
    got = sequence.islands(df, "s", "i", [], max_gap=2, minimum=2, chunk=4).select("start_frame", "end_frame", "frames").orderBy("start_frame").collect()
    assert [tuple(r) for r in got] == [(0, 4, 3), (8, 9, 2)]


def test_round_robin_takes_turns(spark):
    df = spark.createDataFrame([("a", "train", 10, 0.8), ("a", "train", 20, 0.7), ("b", "train", 30, 0.6)], "sequence string, split string, f int, e double")
    got = sequence.round_robin(df, "split", "sequence", [F.desc("e")], 2).orderBy("position").collect()
    assert [(r.sequence, r.f) for r in got] == [("a", 10), ("b", 30)]


def test_control_prefers_the_same_patch(spark):
    seg = spark.createDataFrame([("a", 100, 6)], "sequence string, anchor_frame int, patch_id int")
    frames = spark.createDataFrame([("a", 20, 0.05, 3), ("a", 40, 0.06, 6), ("a", 100, 0.05, 6)], "sequence string, frame_idx int, position_error double, patch_id int")
    high = spark.createDataFrame([("a", 100)], "sequence string, frame_idx int")
    assert sequence.choose_controls(seg, frames, high, chunk=16).first().control_frame == 40


def greedy(data, n, gap):
    kept = []
    for _, f, _ in sorted(data, key=lambda d: -d[2]):
        if len(kept) < n and all(abs(f - o) >= gap for o in kept):
            kept.append(f)
    return kept


def test_diverse_selection_matches_a_greedy_scan(spark):
    """Random scores, and scores that rise along the frames, where each pick frees the next one."""
    rng = np.random.default_rng(5)
    data = [(s, int(f), float(q)) for s in range(3) for f, q in zip(rng.choice(400, 80, replace=False), rng.random(80))]
    data += [(3, f - 50, float(f)) for f in range(0, 300, 7)] + [(4, 9, 0.5)] * 3
    rows = spark.createDataFrame(data, "s int, f int, q double")
    for n, gap in ((5, 40), (3, 1), (20, 9)):
        got = sorted((r.s, r.f) for r in sequence.diverse(rows, ["s"], "f", [F.col("q")], n, gap).collect())
        assert got == sorted((s, f) for s in range(5) for f in greedy([d for d in data if d[0] == s], n, gap))
    assert sequence.diverse(rows.limit(0), ["s"], "f", [F.col("q")], 5, 40).count() == 0
