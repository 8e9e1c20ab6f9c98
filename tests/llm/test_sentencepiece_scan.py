import functools
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from spoorgrid.llm.sentencepiece_scan import SAFE, Lattice, chunks_of, decode, encode, product, round_trip, states_between

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_chunks_give_the_ids_of_the_library(library):
    own, draw = Lattice(PATH), random.Random(2)
    for _ in range(150):
        letters = draw.choice(["ab", "the in ", "aeinrst", "    x", "▁ a\n", "日本é🙂ab ", " -=#*_", "abcdefghijklmnopqrstuvwxyz"])
        text = "".join(draw.choice(letters) for _ in range(draw.randint(1, 500)))
        chunks = [c for _, c in chunks_of(text, draw.choice([64, 70, 128]), 64)]
        matrices = [own.matrix(c) for c in chunks]
        at = states_between(matrices, SAFE, SAFE)
        ids = b"".join(own.trace(c, a, b) for c, a, b in zip(chunks, at, at[1:], strict=False))
        assert np.frombuffer(ids, np.int32).tolist() == library.encode(text)
        assert (SAFE, SAFE) in functools.reduce(product, matrices)
        cut = draw.randint(0, len(matrices))
        if 0 < cut < len(matrices):  # products are associative
            assert product(functools.reduce(product, matrices[:cut]), functools.reduce(product, matrices[cut:])) == functools.reduce(product, matrices)


def test_documents(spark, library, odd, empty):
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    for size in (100, 32_768):
        rows = encode(odd, chunk_chars=size).collect()
        assert len(rows) == odd.count()
        assert all(r["ids"] == library.encode(texts[r["doc_id"]]) for r in rows)
    assert encode(empty).count() == 0
    back = decode(encode(odd))
    assert all(r["text"] == library.decode(r["ids"]) for r in back.collect())
    assert all(r["round_trip"] for r in round_trip(odd).collect())


def test_units_seen_before_are_not_searched_again(monkeypatch):
    own, searched = Lattice(PATH), []
    monkeypatch.setattr(own, "path", lambda text: searched.append(text) or [1])
    for _ in range(2):
        for i in range(290_000):
            own.between(f"▁{i}")
    assert len(searched) == 290_000
