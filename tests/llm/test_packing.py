import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spoorgrid.llm.packing import TIERS, encoder, ids_of, pack, plan_windows, step_groups

TOKENS = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_ids_equal_the_tokenizers_library(text):
    ours = encoder(public_tokenizers.path("byte_bpe_50k.tiktoken")).encode(text, allowed_special="all", disallowed_special=())
    assert ours == TOKENS.encode(text, add_special_tokens=False).ids


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=60))
def test_windows_are_full_and_cover_every_id_once(lengths):
    windows, rest = plan_windows(lengths)
    assert all(sum(n for _, _, n in w) == tier and tier in TIERS for tier, w in windows)
    assert sum(n for _, _, n in rest) < TIERS[0]
    seen = [np.zeros(n, int) for n in lengths]
    for piece in [p for _, w in windows for p in w] + rest:
        doc, start, n = piece
        assert n > 0
        seen[doc][start:start + n] += 1
    assert all((s == 1).all() for s in seen)
    groups, tokens = step_groups(windows, 4096), defaultdict(int)
    for g, (tier, _) in zip(groups, windows, strict=True):
        tokens[g] += tier
    assert all(t <= 4096 for t in tokens.values())


def check(docs, pieces):
    texts = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        texts[r[0]].append(np.array([*TOKENS.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4"))
    cover, windows = defaultdict(int), defaultdict(list)
    for p in pieces:
        assert any(zlib.crc32(ids[p.start:p.start + p.length].tobytes()) == p.ids_crc32 and len(ids) == p.doc_tokens for ids in texts[p.doc_id])
        cover[p.doc_id] += p.length
        windows[p.sequence_id].append((p.offset, p.length))
    assert cover == {k: sum(map(len, v)) for k, v in texts.items()}
    short = 0
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at
            at += n
        assert at <= 1024
        short += at not in TIERS
    return short


def test_pieces_of_odd_rows(odd):
    assert check(odd, pack(odd, chunk_tokens=500).collect()) <= odd.rdd.getNumPartitions()


def test_empty_table(empty):
    assert pack(empty).count() == 0


@pytest.mark.parametrize("space", [" ", "\n", "\t", "　"])
def test_very_long_white_space(spark, space):
    text = space * (2_000_000 // len(space.encode())) + "a"
    ids = TOKENS.encode(text, add_special_tokens=False).ids
    assert ids_of(text, public_tokenizers.path("byte_bpe_50k.tiktoken")) == ids
    rows = pack(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert sum(r.length for r in rows) == len(ids) + 1 == rows[0].doc_tokens
