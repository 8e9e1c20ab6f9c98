import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from spoorgrid.llm.period_runs import giant_runs, order_of, periodic_runs, pieces_of, rewritten, solve, stitched, tiles


def brute(words):
    """(start, length, period) of all runs, by comparing words at every distance."""
    n, out = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] == words[i + p]:
                j = i
                while j + p < n and words[j] == words[j + p]:
                    j += 1
                if j + p - i >= max(12, 2 * p):
                    out.setdefault((i, j + p - i), p)
                i = j
            i += 1
    return sorted((s, length, p) for (s, length), p in out.items())


def expected(words):
    rows = brute(words)
    keep = [True] * len(words)
    for s, length, p in rows:
        keep[s + p:s + length] = [False] * (length - p)
    best = min(rows, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    values = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(rows), *values, sha("".join(f"{a},{b},{c}\n" for a, b, c in rows)), sha(" ".join(w for w, k in zip(words, keep, strict=True) if k))


def made(rnd, most):
    n, kinds = rnd.randint(0, most), rnd.choice([1, 2, 3, 30, 1000])
    words = [f"w{rnd.randrange(kinds)}" for _ in range(n)]
    for _ in range(rnd.randint(0, 3)):
        p, a = rnd.randint(1, max(1, n // 3)), rnd.randint(0, n)
        for i in range(a, rnd.randint(a, n)):
            words[i] = words[a + (i - a) % p]
    return words


def test_documents_solved_together_equal_brute_force():
    rnd = random.Random(5)
    for _ in range(150):
        some = [made(rnd, 300) for _ in range(rnd.randint(1, 4))]
        assert solve([" ".join(w).encode() for w in some], [None] * len(some)) == [expected(w) for w in some]


def test_tiles_and_stitching_equal_brute_force():
    rnd = random.Random(6)
    for _ in range(60):
        words = made(rnd, 700)
        codes = np.unique(words, return_inverse=True)[1].astype(np.int64) if words else np.zeros(0, np.int64)
        pieces = []
        for octave, first, last, low, high in tiles(len(codes), 64):
            shift = first % octave
            own = np.concatenate([-1 - np.arange(shift), codes[first:last]])
            pieces += [(p, s - shift + first, e - shift + first) for p, s, e in pieces_of(own, octave, (low - first + shift, high - first + shift))]
        runs = sorted((s, e - s, p) for p, s, e in stitched(pieces) if e - s >= max(12, 2 * p))
        assert runs == brute(words)


def test_spark_query_with_tiles_and_rewriting(spark):
    rnd = random.Random(7)
    docs = [(i, " ".join(made(rnd, 500))) for i in range(120)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r[0]: tuple(r)[1:] for r in periodic_runs(frame, tile=100).collect()}
    some = 0
    for i, text in docs:
        words, h = text.split(), zlib.crc32(str(i).encode())
        rule = rewritten(len(words), h)
        some += rule is not None
        assert got[i] == expected([words[k] for k in order_of(len(words), rule)]), i
    assert some > 3 and got == {r[0]: tuple(r)[1:] for r in periodic_runs(frame).collect()}


def test_one_word_over_and_over(spark):
    frame = spark.createDataFrame([("k", "a " * 30_000, None), ("m", "a b " * 9_000, None)], "key string, text string, h long")
    assert sorted(map(tuple, giant_runs(frame, 512).collect())) == [("k", 1, 0, 30_000), ("m", 2, 0, 18_000)]


def test_odd_rows(spark, odd, empty):
    frame = odd.withColumnsRenamed({"size": "key", "_shard": "period", "lang": "h"})
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    for tile in (64, 4096):
        got = periodic_runs(frame, tile=tile)
        want = []
        for r in odd.collect():
            words = (r.text or "").encode().split()
            rule = None if r.doc_id is None else rewritten(len(words), zlib.crc32(str(r.doc_id).encode()))
            want.append((r.doc_id, *expected([words[k].decode() for k in order_of(len(words), rule)])))
        assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert periodic_runs(empty).count() == 0
    plain = periodic_runs(odd.where(F.col("doc_id") == 8), rewrite=False).first()
    assert (plain.start, plain.period, plain.length) == (0, 4, 16_000)
