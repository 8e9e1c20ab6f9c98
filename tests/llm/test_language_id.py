import zlib

import numpy as np

from spoorgrid.llm.language_id import Parser, codes_of, identify


def slow_phrases(text, sample):
    """Longest matches with the sample, one after the other, within segments of 512 symbols."""
    count = 0
    for at in range(0, len(text), 512):
        part, i = text[at:at + 512], 0
        while i < len(part):
            n = 1
            while i + n < len(part) and part[i:i + n + 1] in sample:
                n += 1
            count += 1
            i += n
    return count


def test_phrases_equal_brute_force():
    rng = np.random.default_rng(4)
    samples = {k: "".join(rng.choice(list(letters), 800)) for k, letters in (("xx", "abcd  "), ("yy", "abéz "))}
    parser = Parser(samples)
    spell = lambda t: "".join(map(chr, codes_of(t, parser.symbols) + 65))
    for _ in range(10):
        text = "".join(rng.choice(list("abcdéz !q"), 700))
        coded = spell(text)
        part = [np.array([ord(c) - 65 for c in coded[s:s + 512]], np.uint8) for s in range(0, len(coded), 512)]
        lengths = np.array([len(p) for p in part])
        rows = np.stack([np.pad(p, (0, 512 - len(p))) for p in part])
        got = parser.phrases(rows, lengths).sum(0)
        unknown = [spell(samples[k]).replace(chr(65), "") for k in parser.languages]
        assert got.tolist() == [slow_phrases(coded, u) for u in unknown]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = identify(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert len(out) == docs.count()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(out.doc_id, out.held_out, strict=True))
    held = out[out.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97


def test_odd_rows(odd, empty):
    out = identify(odd).collect()
    assert len(out) == odd.count() and identify(empty).count() == 0
    by = {r["doc_id"]: r for r in out}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (0, 1, 2, 3, 13)) and by[5]["lang_pred"] == "en"
