import dataclasses
import os
import tempfile
from unittest import mock

import numpy as np

import corpus_pipeline
from spoorgrid.llm import near_copies, quality
from spoorgrid.llm.near_copies import without_copies
from spoorgrid.llm.simhash import fingerprint

SF = "/root/testdata/sf0.001"


def shingles(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))}


def groups(texts, least=0.8):
    """Smallest id of each document's group, by all pairs."""
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) >= least * max(len(a), len(b)) and len(a & b) >= least * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_near_copies_equal_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {i for i, g in groups(texts).items() if i == g}
    out = without_copies(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"] for r in out.collect()}
    assert got <= set(texts) and len(got ^ want) <= 2


def test_crowded_cells_and_odd_rows(spark, odd, empty):
    base = " ".join(f"w{i}" for i in range(120)).split()
    rows = [(i, " ".join([*base[:i % 100], f"x{i}", *base[i % 100 + 1:]])) for i in range(150)]
    out = without_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert [r["doc_id"] for r in out] == [0]
    kept = without_copies(odd)
    assert kept.columns == odd.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    assert [i for null, i in ids if not null] == [0, 5, 6, 7, 8, 9, 12, 13, 14] and sum(n for n, _ in ids) == 1
    assert without_copies(empty).count() == 0


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, folder = docs.columns, tempfile.mkdtemp()
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(os.path.join(folder, name))
        docs = spark.read.parquet(os.path.join(folder, name))
        counts.append(docs.count())
        assert name == "packing" or docs.columns == columns
    assert counts[0] > counts[1] > counts[2] > counts[3] == counts[4] > 0
    assert counts[3] > 0.5 * counts[0]
    assert {r[0] for r in docs.select("doc_id").distinct().collect()} == {r[0] for r in spark.read.parquet(os.path.join(folder, "secrets")).select("doc_id").collect()}


def test_stages_on_odd_and_empty_documents(spark, odd, empty):
    odd = odd.selectExpr("doc_id", "text", "lang", "_shard as source", "cast(null as long) as n_chars", "size", "true as _times")
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count()


def edited(kind, n, rng):
    """A text of n words and one whose similarity to it is at least 0.8."""
    words = [f"v{x}" for x in rng.integers(0, 10**6, n)]
    shingle = n - 4
    if kind == "appended":
        more = int(shingle / 0.8 - shingle)
        return words, [*words, *[f"u{x}" for x in rng.integers(0, 10**6, more)]]
    if kind == "passage":  # m words of it touch m + 4 shingles
        m = max(1, int(shingle / 9) - 4)
        at = int(rng.integers(0, n - m))
        return words, [*words[:at], *[f"u{x}" for x in rng.integers(0, 10**6, m)], *words[at + m:]]
    if kind == "scattered":
        other = list(words)
        for at in rng.choice(n, max(1, shingle // 45), replace=False):
            other[at] = f"u{at}"
        return words, other
    return words, [*words[:-1], "other"]


def test_similar_pairs_are_found_whatever_the_edit(spark):
    rng = np.random.default_rng(3)
    kinds = [("appended", 60), ("appended", 400), ("passage", 100), ("passage", 400), ("scattered", 200), ("last word", 13), ("last word", 20)]
    rows, lost = [], dict.fromkeys(kinds, 0)
    for kind, n in kinds:
        for _ in range(40):
            pair = [" ".join(x) for x in edited(kind, n, rng)]
            a, b = map(shingles, pair)
            assert len(a & b) >= 0.8 * len(a | b)
            rows += [(len(rows) + i, f"{kind} {n}", t) for i, t in enumerate(pair)]
    kept = without_copies(spark.createDataFrame(rows, "doc_id long, kind string, text string").repartition(4)).collect()
    for (kind, n) in kinds:
        lost[kind, n] = sum(r["doc_id"] % 2 for r in kept if r["kind"] == f"{kind} {n}")
    assert not any(lost.values()), lost


def test_refuted_forest_links_are_replaced(spark):
    """A and B look alike at 0.79, C holds both at 0.81: whatever the sketches say, one of the three stays."""
    rng, rows = np.random.default_rng(8), []
    for g in range(60):
        base = [f"v{x}" for x in rng.integers(0, 10**6, 404)]
        a, b = ([*base, *[f"{side}{g}x{i}" for i in range(53)]] for side in "ab")
        c = [*base, *a[404:430], *b[404:430]]
        sets = [shingles(" ".join(x)) for x in (a, b, c)]
        like = [len(x & y) / len(x | y) for x, y in ((sets[0], sets[1]), (sets[0], sets[2]), (sets[1], sets[2]))]
        assert like[0] < 0.8 < min(like[1:]), like
        rows += [(3 * g + i, " ".join(x)) for i, x in enumerate((a, b, c))]
    kept = {r["doc_id"] for r in without_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert kept == {3 * g for g in range(60)}


def test_quality_stage_keeps_what_the_operator_calls_good(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model).select("doc_id", "score").collect()}
    low, high = sorted(scores.values())[len(scores) // 10], sorted(scores.values())[-1]
    shift = 0.4 - np.log(low / (1 - low))  # this one now scores 0.6
    assert high > 0.7
    moved = dataclasses.replace(model, bias=model.bias + np.asarray(shift, model.bias.dtype))
    with mock.patch.object(quality, "train", return_value=moved):
        good = {r["doc_id"] for r in quality.classify(docs, labels).where("predicted = 1").collect()}
        between = quality.score(docs, moved).where("score >= 0.5 and score < 0.7").count()
        kept = {r["doc_id"] for r in corpus_pipeline.keep_good(spark, docs, SF).collect()}
    assert between > 0 and kept == good


def test_fingerprints_give_candidates_of_their_own(spark):
    """Without any shared cell of minima, what op9_simhash links and the exact similarity confirms is still one group."""
    rng, rows = np.random.default_rng(2), []
    for g in range(20):
        words = [f"v{x}" for x in rng.integers(0, 10**6, 600)]
        rows += [(3 * g, " ".join(words)), (3 * g + 1, " ".join(words).upper()), (3 * g + 2, " ".join([*words[:300], "other", *words[301:]]))]
    prints = [fingerprint(t, 3) for _, t in rows]
    near = {i for i, p in enumerate(prints) if i % 3 and (p ^ prints[i - i % 3]).bit_count() <= 3}
    far = {i for i in range(len(rows)) if i % 3 == 2} - near
    assert len(near) > 25
    nothing = lambda texts: shared(texts).where("false")
    shared = near_copies.shared_cells
    with mock.patch.object(near_copies, "shared_cells", nothing):
        kept = {r["doc_id"] for r in corpus_pipeline.keep_one_copy(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), SF).collect()}
    assert kept == {3 * g for g in range(20)} | far
