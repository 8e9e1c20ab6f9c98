import itertools

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from spoorgrid.llm.components import components
from spoorgrid.llm.simhash import fingerprint, links, near_duplicates


def plain(text, k=3):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, bits):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(values, 2):
        if bin(a ^ b).count("1") <= bits:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {v: find(v) for v in values}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbÄ \u0085\t\n\x0b\x0c\r\x1c ", max_size=40))
def test_fingerprint(text):
    assert fingerprint(text, 3) == plain(text)


def test_links_equal_brute_force_also_in_crowded_cells(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 2**64, 40, dtype=np.uint64)]
    values = set(base)
    for b in base:
        for _ in range(12):
            for k in (2, 3, 4, 7):
                values.add(b ^ sum(1 << int(i) for i in rng.choice(64, k, replace=False)))
    hot = base[0]
    values |= {hot ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(20)}
    signed = [(int(np.array(v, np.uint64).view(np.int64)),) for v in values]
    df = spark.createDataFrame(signed, "fp long").repartition(4)
    for size in (16, 2048):
        got = {r[0]: r[1] for r in components(links(df, part_rows=size)).collect()}
        want = roots([s[0] & (2**64 - 1) for s in signed], 3)
        groups = {}
        for v in values:
            s = int(np.array(v, np.uint64).view(np.int64))
            groups.setdefault(want[v], set()).add(got.get(s, s))
        assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_odd_rows(odd, empty):
    out = near_duplicates(odd).collect()
    assert len(out) == odd.count() and near_duplicates(empty).count() == 0
    by = {r[0]: r for r in out}
    assert by[0]["fingerprint"] == "0" * 16 and by[2]["component_id"] == 0
    assert by[9]["component_id"] == by[10]["component_id"] == by[11]["component_id"]


def test_contracted_links_connect_the_same_nodes(spark, monkeypatch):
    from spoorgrid.llm import components as C

    rng = np.random.default_rng(8)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 900, (700, 2))] + [(5, 5), (1, 2), (1, 2)]
    links = spark.createDataFrame(pairs, "a long, b long").repartition(6)
    want = sorted(map(tuple, C.components(links).collect()))
    for batch in (500_000, 40):
        monkeypatch.setattr(C, "BATCH", batch)
        few = C.contracted(links)
        assert sorted(map(tuple, C.components(few).collect())) == want and few.count() <= 700
    assert C.contracted(links.limit(0)).count() == 0


def test_few_links_are_solved_without_star_rounds(spark, monkeypatch):
    from spoorgrid.llm import components as C

    rng = np.random.default_rng(9)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-900, 900, (900, 2))] + [(5, 5), (1, 2), (2, 1), (None, 3), (4, None)]
    links = spark.createDataFrame(pairs, "a long, b long").repartition(6)
    want, rounds, star = sorted(map(tuple, C.components(links).collect())), [], C._large_star
    monkeypatch.setattr(C, "_large_star", lambda x: rounds.append(1) or star(x))
    for batch, some in ((500_000, False), (40, True)):
        monkeypatch.setattr(C, "BATCH", batch)
        rounds.clear()
        assert sorted(map(tuple, C.contracted_components(links).collect())) == want and bool(rounds) == some
    monkeypatch.undo()
    assert C.contracted_components(links.limit(0)).count() == 0
