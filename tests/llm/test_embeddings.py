import numpy as np
from pyspark.sql import functions as F

from spoorgrid.llm.curve_search import hilbert, search
from spoorgrid.llm.embedding_dedup import near_duplicates

NAN, INF = float("nan"), float("inf")


def odd_vectors(spark, n=300, dim=16):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, dim))
    x[50:90] = x[10] + 0.05 * rng.normal(size=(40, dim))
    x[100:140] = x[20]
    x[140:150] = 2 * x[20]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(1000, None), (1001, [0.0] * dim), (1002, [NAN] + [1.0] * (dim - 1)), (1003, [INF] + [1.0] * (dim - 1)), (1004, [None] + [1.0] * (dim - 1)),
           (1005, [1.0] * (dim - 1)), (1006, []), (None, rows[3][1])]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows + bad], "vec_id long, embedding array<double>, blocks int, code string").repartition(4)
    return x, df


def test_hilbert_is_a_curve():
    bits = 3
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * 3), -1).reshape(-1, 3)
    keys = hilbert(grid, bits)
    assert sorted(keys.tolist()) == list(range(len(grid)))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_near_duplicates_equal_brute_force(spark):
    x, df = odd_vectors(spark)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    out = {r["vec_id"]: r for r in near_duplicates(df, part_rows=16).collect() if r["vec_id"] is not None}
    assert near_duplicates(df).count() == df.count()
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.array([label[n].min() for n in near])
    for i in range(len(x)):
        assert (out[i]["n_links"], out[i]["component_id"], out[i]["kept"]) == (near[i].sum() - 1, label[i], label[i] == i)
    assert all(out[i]["n_links"] == 0 and out[i]["component_id"] == i and out[i]["kept"] for i in range(1000, 1007))
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert near_duplicates(empty).count() == 0 and search(empty, F.col("vec_id") % 20 == 0).count() == 0


def test_search_finds_the_nearest(spark):
    x, df = odd_vectors(spark)
    rows = search(df, F.col("vec_id") % 20 == 0, k=20, part_rows=64).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 300, 20))
    hits = 0
    for q, got in found.items():
        scores = x @ x[q]
        scores[q] = -np.inf
        want = sorted(range(len(x)), key=lambda i: (-scores[i], i))[:20]
        assert [s for _, s in got] == sorted((s for _, s in got), reverse=True) and len(got) == 20
        assert all(abs(scores[i] - s) < 1e-9 for i, s in got)
        hits += len(set(want) & {i for i, _ in got})
    assert hits >= 0.9 * 20 * len(found)
    few = search(df.where("vec_id < 6"), F.col("vec_id") == 0, k=20)
    assert sorted(r["vec_id"] for r in few.collect()) == [1, 2, 3, 4, 5]
