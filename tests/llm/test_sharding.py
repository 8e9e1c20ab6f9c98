from collections import Counter, defaultdict

from spoorgrid.llm.sharding import shard


def check(rows, n):
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(n)) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_groups_stay_together_and_counts_are_even(spark):
    docs = [(i, f"text {i}") for i in range(400)] + [(1000 + i, f"copy {i % 60}") for i in range(300)]
    docs += [(5000 + i, "hot") for i in range(350)]
    out = shard(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), 8).collect()
    assert len(out) == len(docs) and {r["doc_id"] for r in out} == {d for d, _ in docs}
    check(out, 8)
    text, places = dict(docs), defaultdict(Counter)
    for r in out:
        places[text[r["doc_id"]]][r["shard"]] += 1
    small = [max(c.values()) / sum(c.values()) for t, c in places.items() if t.startswith("copy")]
    assert sum(s == 1 for s in small) >= 0.95 * len(small)
    assert len(places["hot"]) <= 5  # 350 rows, about 131 a shard


def test_odd_rows(odd, empty):
    out = shard(odd, 5).collect()
    check(out, 5)
    assert len(out) == odd.count() and shard(empty, 5).count() == 0
    by_text = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in out}
    assert by_text[0] == by_text[1] == (16, 0)
