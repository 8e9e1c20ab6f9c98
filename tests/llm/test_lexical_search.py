import math
import random
import re
from collections import Counter

from spoorgrid.llm.lexical_search import search, words_in

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(items, docs, k):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    n = {i: sum(b.values()) for i, (_, b) in enumerate(bags)}
    total, words = sum(v > 0 for v in n.values()), sum(n.values())
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for i, (doc, bag) in enumerate(bags):
            m = 100 - 25 + (25 * n[i] * total) // words if words else 0
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 12 * m)) for t in terms(text) if bag[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, d[3], -d[0]) for r, d in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return out


def test_equals_all_pairs_over_several_blocks_and_bundles(spark):
    rnd = random.Random(3)
    word = lambda: f"w{int(rnd.paretovariate(0.6)) % 300}"
    docs = [(i, " ".join(word().upper() if rnd.random() < 0.1 else word() for _ in range(rnd.randint(0, 60)))) for i in range(600)]
    docs += [(i + 1000, docs[7][1]) for i in range(40)]  # ties over the last rank
    items = [(i, " ".join(word() for _ in range(rnd.randint(1, 30)))) for i in range(300)]  # two bundles
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = search(spark.createDataFrame(items, "item_id long, text string").repartition(3), frame, k=7)
    assert sorted(map(tuple, got.collect())) == sorted(brute(items, docs, 7))


def test_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "SAME text"), (2, None), (3, ""), (4, "日本語 — x"), (5, "nowhere"), (5, "word")], "item_id long, text string")
    got = sorted(map(tuple, search(items.withColumns({c: items.item_id for c in ("bundle", "block", "term", "doc_id")}), odd.withColumnsRenamed({"size": "block", "_shard": "term"})).collect()))
    want = brute([tuple(r) for r in items.collect()], [(r.doc_id, r.text) for r in odd.collect()], 20)
    assert got == sorted(want) and {r[0] for r in got} == {1, 4, 5}
    assert search(items, empty).count() == 0
    assert search(empty.withColumn("item_id", empty.doc_id), odd).count() == 0


def test_very_long_texts_are_split_in_slabs():
    text = (b"Ab " * 1000 + b"x" * 5000 + b".") * 3
    slabs = list(words_in(text, 700))
    assert [w for s in slabs for w in s] == text.lower().replace(b".", b" ").split()
    assert max(map(len, slabs)) < 400
