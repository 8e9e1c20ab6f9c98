import zlib

import numpy as np
import pytest

from spoorgrid.llm import quality, toxicity
from spoorgrid.llm.common import word_hashes
from spoorgrid.llm.learn import bag_of

SF = "/root/testdata/sf0.01"


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    n = y.sum()
    return (rank[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize(("module", "column", "modulus", "held", "least"), [(toxicity, "toxic", 5, 0, 0.85), (quality, "quality", 4, 2, 0.9)])
def test_held_out(spark, module, column, modulus, held, least):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = module.classify(docs, labels).toPandas()
    assert len(out) == docs.count() and out.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % modulus == held) for i, h in zip(out.doc_id, out.held_out, strict=True))
    both = out[out.held_out].merge(labels.toPandas(), on="doc_id")
    assert auc(both.score.to_numpy(), both[column].to_numpy()) > least


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows(spark, odd, empty, module):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 14)] + [(None, 1, 1), (3, None, None), (5, 0, 0)], "doc_id long, quality int, toxic int")
    odd = odd.selectExpr("*", "size as n_chars")
    out = module.classify(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert all(not r["held_out"] for r in out if r["doc_id"] is None)
    nothing = spark.createDataFrame([], labels.schema)
    assert module.classify(empty, labels).count() == 0 and module.classify(odd, nothing).count() == len(out)


def test_words_of_a_batch_are_those_of_each_text():
    texts = ["One two-three", "", "ÄRGER\nzwei 3x", " ", "two one"]
    words, owner = word_hashes(texts)
    for i, t in enumerate(texts):
        assert list(words[owner == i]) == list(word_hashes([t])[0])
    assert len(words) == 8 and words[0] == words[7] and words[1] == words[6]


def test_sum_of_squares_identity():
    texts = ["a b c a", "d e", "f"]
    model = quality.fit(texts * 3, [1, None, 3] * 3, np.array([1, 0, 1] * 3, np.float32), 64, 3, 5)
    row, feature, value = quality.features(texts, [1, None, 3], 64, model.edges)
    z, _ = quality.raw_scores(model, row, feature, value, 3)
    for r in range(3):
        f, x = feature[row == r], value[row == r]
        pairs = sum(float(model.factor[f[i]] @ model.factor[f[j]]) * x[i] * x[j] for i in range(len(f)) for j in range(i))
        assert abs(model.bias[0] + model.weight[f] @ x + pairs - z[r]) < 1e-4


def test_label_model_finds_good_voters_and_shares_voices():
    rng = np.random.default_rng(3)
    y = rng.random(2000) < 0.3
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.75])
    vote = np.where(rng.random((2000, 5)) < right, np.where(y, 2, 1)[:, None], np.where(y, 1, 2)[:, None])
    noise = np.repeat(rng.integers(0, 3, (2000, 1)), 6, axis=1)  # one voice said six times
    found = toxicity.label_model(np.hstack([vote, noise]))
    assert ((found.posterior > 0.5) == y).mean() > 0.93 and abs(found.balance - 0.3) < 0.05
    assert np.abs(found.says[1, :5, toxicity.TOXIC] - right).max() < 0.06 and np.abs(found.says[0, :5, toxicity.CLEAN] - right).max() < 0.06
    assert found.share[5:].max() < 0.2 < 0.5 < found.share[:5].min()
    assert len(bag_of(["x x y"], 1 << 10).count) == 2


def plain_em(vote, rounds):
    """The same model row by row: balance, rates with half a vote added, correlations, posterior."""
    n, m = len(vote), len(vote[0])

    def shares(rest):
        dev = [np.sqrt(sum(x[k] ** 2 for x in rest) / n) + 1e-9 for k in range(m)]
        return [1 / max(1, sum(min(1, max(0, sum(x[k] * x[j] for x in rest) / n / dev[k] / dev[j])) for j in range(m))) for k in range(m)]

    side = [[(v == 2) - (v == 1) for v in r] for r in vote]
    mean = [sum(r[k] for r in side) / n for k in range(m)]
    voice = shares([[x - c for x, c in zip(r, mean, strict=True)] for r in side])
    q = [1 / (1 + np.exp(-(sum(x * w for x, w in zip(r, voice, strict=True)) - 1) / max(voice))) for r in side]
    for _ in range(rounds):
        balance = (sum(q) + 1) / (n + 2)
        rate = [[[sum((p if c else 1 - p) for p, r in zip(q, vote, strict=True) if r[k] == v) + 0.5 for v in range(3)] for k in range(m)] for c in (0, 1)]
        rate = [[[x / sum(one) for x in one] for one in side] for side in rate]
        rest = [[(r[k] == 2) - ((1 - p) * rate[0][k][2] + p * rate[1][k][2]) for k in range(m)] for p, r in zip(q, vote, strict=True)]
        share = shares(rest)
        odds = [sum((np.log(rate[1][k][v]) - np.log(rate[0][k][v])) * share[k] for k, v in enumerate(r)) + np.log(balance / (1 - balance)) for r in vote]
        q = [min(1 - 1e-4, max(1e-4, 1 / (1 + np.exp(-z)))) for z in odds]
    return np.array(q)


def test_label_model_equals_plain_expectation_maximisation():
    vote = np.random.default_rng(8).integers(0, 3, (60, 4))
    vote[:30, 0] = 2
    assert np.allclose(toxicity.label_model(vote, 6).posterior, plain_em(vote.tolist(), 6), atol=1e-9)


def test_labels_only_turn_the_classes():
    posterior = np.array([0.9, 0.8, 0.1, 0.3])
    assert toxicity.oriented(posterior, np.array([1, np.nan, 0, np.nan])) is posterior
    assert np.allclose(toxicity.oriented(posterior, np.array([0, np.nan, 1, np.nan])), 1 - posterior)
    assert toxicity.oriented(posterior, np.full(4, np.nan)) is posterior


def test_unlabelled_texts_train_too():
    """A word that only unlabelled toxic texts hold gains weight through their votes."""
    texts = ["you stupid pathetic idiot moron clown"] * 20 + ["a quiet walk along the river bank today"] * 60
    more = ["such a stupid worthless loser idiot grumblefish"] * 20
    y = np.array([1.0] * 20 + [0.0] * 60)
    held = toxicity.score_texts(toxicity.fit(texts, y), ["grumblefish by the river"])[0]
    assert toxicity.score_texts(toxicity.fit(texts + more, np.append(y, np.full(20, np.nan))), ["grumblefish by the river"])[0] > held


@pytest.mark.parametrize(("module", "column"), [(toxicity, "toxic"), (quality, "quality")])
def test_models_are_fitted_in_a_task(spark, empty, monkeypatch, module, column):
    """The driver gets the model alone, equal to that of a fit of the collected sample, and one of no rows too."""
    rows = [(i, f"word{i % 7} {'scum trash' if i % 3 else 'fine day'} w{i}", i % 5 or None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], f"doc_id long, {column} int")
    modulus, held = (5, 0) if module is toxicity else (4, 2)
    sample = [r for r in rows if zlib.crc32(str(r[0]).encode()) % modulus != held]
    texts, y = [r[1] for r in sample], np.array([int(r[0] % 3 > 0) for r in sample], np.float32)
    want = module.fit(texts, y) if module is toxicity else module.fit(texts, [r[2] for r in sample], y, 1 << 13, 8, 60)
    fit, here = module.fit, []
    monkeypatch.setattr(module, "fit", lambda *a: here.append(len(a[0])) or fit(*a))
    got = module.train(docs, labels)
    assert not here
    for name, value in vars(want).items():
        assert np.array_equal(value, getattr(got, name)), name
    module.train(empty, labels)
    assert not any(here)
