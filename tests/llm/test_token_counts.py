import random

import public_tokenizers
import pytest

from spoorgrid.llm import token_counts
from spoorgrid.llm.token_counts import Codec, count_tokens, giant_counts, pieces

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "b", " ", "  ", "\n", "'s", "'re", "'", "!", "1", "23", "é", "日本", "🙂", "<|endoftext|>", "<|endo", "x" * 9, "=-", " the", "ing", "　", "\x85", "\x1c"]


@pytest.fixture(scope="module")
def own():
    return Codec(JSON, RANKS)


def library(own, text):
    return len(own.library.encode(text, add_special_tokens=False).ids)


def texts(seed, n, most):
    rnd = random.Random(seed)
    for _ in range(n):
        some = rnd.sample(PARTS, rnd.choice([1, 2, 3, 5, len(PARTS)]))
        yield "".join(rnd.choice(some) for _ in range(rnd.randint(most // 10, most)))


def test_both_libraries_agree_on_every_character(own):
    for base in range(0, 0x110000, 256):
        if not 0xD800 <= base < 0xE000:
            text = "".join(f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}b" for c in range(base, base + 256))
            assert own.count(text) == library(own, text)


def test_proven_places_splice_to_the_library_count(own):
    rnd, joined = random.Random(1), 0
    for text in texts(2, 1200, 400):
        size = rnd.choice([70, 100, 200])
        overlap, total, left = rnd.choice([16, 69]), 0, None
        for k, part, at, following in pieces(text, size, overlap):
            coded = own.starts(part)
            total += len(coded[0])
            if k:
                right = {(a, b): n for a, b, n in own.places(part, coded, part[:overlap], at, at, False)}
                shared = [(b, rest + right[a, b]) for a, b, rest in left if (a, b) in right]
                if not shared:
                    break
                total -= min(shared)[1]
            if following is not None:
                left = [(a, b, len(coded[0]) - n) for a, b, n in own.places(part, coded, part[size:], following, at, True)]
        else:
            joined += 1
            assert total == library(own, text)
    assert joined > 400


def test_walk_equals_the_library(own):
    for text in texts(4, 600, 500):
        assert own.walk(text, 160) == library(own, text)


@pytest.mark.parametrize("unit", [" ", "\n", "\t", "　", "x", "=-", "日本語"])
def test_very_long_runs(own, unit):
    text = unit * (1_000_000 // len(unit)) + "y"
    assert own.walk(text) == own.count(text) == library(own, text)


def test_giants_in_spark_widen_and_walk(spark, own):
    rows = [f"{i} " + t for i, t in enumerate(texts(5, 60, 3000))] + ["x" * 5000, " " * 4000 + "a", "word " * 900, "ab" * 3000]
    frame = spark.createDataFrame([(str(i), t) for i, t in enumerate(rows)], "key string, text string").repartition(4)
    got = dict(map(tuple, giant_counts(frame, JSON, RANKS, 300, (8, 200)).collect()))
    assert {int(k): n for k, n in got.items()} == {i: library(own, t) for i, t in enumerate(rows)}


def test_counts_of_odd_rows(spark, odd, empty, own):
    frame = odd.withColumnsRenamed({"size": "key", "_shard": "chunk", "lang": "n_tokens"})
    got = count_tokens(frame, chunk_chars=2000)
    want = [(r.doc_id, len((r.text or "").encode()), library(own, r.text or ""), library(own, r.text or "") > 512) for r in odd.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and count_tokens(empty).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_counts.Codec(public_tokenizers.path("word_bpe_49k.json"))
