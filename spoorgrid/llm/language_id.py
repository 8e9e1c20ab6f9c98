"""Language identification by cross-parsing entropy.

For every language a suffix automaton holds a bounded sample of its labelled text. A text is parsed against each of
them: from where a phrase begins, the longest match with the sample is followed, and the next phrase begins where it
ends. The phrases needed per character, times the logarithm of the sample's length, estimate the bits a character costs
in that language; the cheapest language wins.

Automata are dense tables over a small alphabet, so that a whole batch of texts walks through them in lock step. A text
is parsed in segments of fixed length, at whose ends a phrase ends too; all segments of all texts count.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoorgrid.llm.common import bucket_of, slices

SYMBOLS = 64
SEGMENT = 512
UNKNOWN = "und"


def alphabet_of(samples: dict[str, str]) -> dict[str, int]:
    """The most frequent letters of the samples; every other letter is symbol 0, which no sample contains."""
    counts: dict[str, int] = {}
    for text in samples.values():
        for c in text:
            if c.isalpha():
                counts[c] = counts.get(c, 0) + 1
    common = sorted(counts, key=lambda c: (-counts[c], c))[:SYMBOLS - 2]
    return {c: i + 2 for i, c in enumerate(common)}


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)


def symbol_table(alphabet: dict[str, int]) -> np.ndarray:
    """The symbol of every code point."""
    table = np.where(_letters(), 0, 1).astype(np.uint8)
    table[[ord(c) for c in alphabet]] = list(alphabet.values())
    return table


def codes_of(text: str, table: np.ndarray) -> np.ndarray:
    """Symbols of the lower-cased letters; every run of other characters is one symbol 1, at the ends of the text none."""
    codes = table[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 1) | (codes[:-1] != 1)
    codes = codes[keep]
    if len(codes) and codes[0] == 1:
        codes = codes[1:]
    return codes[:-1] if len(codes) and codes[-1] == 1 else codes


def suffix_automaton(codes: np.ndarray) -> np.ndarray:
    """Transitions (state, symbol) -> state, -1 for none; state 0 is the start. Every path spells a substring."""
    edges: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes.tolist():
        new = len(edges)
        edges.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(edges)
                edges.append(dict(edges[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    table = np.full((len(edges), SYMBOLS), -1, np.int32)
    for s, out in enumerate(edges):
        for c, t in out.items():
            table[s, c] = t
    return table


class Parser:
    """The automata of all languages in one table; languages in alphabetical order."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        self.symbols = symbol_table(alphabet_of(samples))
        tables, self.starts, self.bits, at = [], [], [], 0
        for name in self.languages:
            codes = codes_of(samples[name], self.symbols)
            codes = codes[codes > 0]
            table = suffix_automaton(codes)
            tables.append(np.where(table >= 0, table + at, -1))
            self.starts.append(at)
            self.bits.append(np.log2(len(codes) + 2))
            at += len(table)
        self.table = np.concatenate(tables).astype(np.int32).ravel() if tables else np.empty(0, np.int32)

    def phrases(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases of each segment (row of codes, SEGMENT wide, longest first) in each language."""
        n, columns = len(codes), np.ascontiguousarray(codes.T)
        out = np.zeros((n, len(self.languages)), np.int64)
        for k, start in enumerate(self.starts):
            state = np.full(n, start, np.int64)
            count = np.zeros(n, np.int64)
            for i in range(int(lengths[0]) if n else 0):
                live = np.searchsorted(-lengths, -i, side="left")  # rows that are longer than i
                c = columns[i, :live].astype(np.int64)
                to = self.table[state[:live] * SYMBOLS + c]
                broken = np.flatnonzero(to < 0)
                if len(broken):
                    fresh = self.table[start * SYMBOLS + c[broken]]
                    # a phrase ended before this symbol; a symbol that no sample has is a phrase of its own
                    count[broken] += (state[broken] != start).astype(np.int64) + (fresh < 0)
                    to[broken] = np.where(fresh < 0, start, fresh)
                state[:live] = to
            out[:, k] = count + (state != start)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: the winner's share of the weights 2 ** (-10 * bits a character above it)."""
        coded = [codes_of(t or "", self.symbols) for t in texts]
        owner = np.concatenate([np.full(-(-len(c) // SEGMENT), i) for i, c in enumerate(coded)]) if coded else np.empty(0, int)
        owner = owner.astype(np.int64)
        rows = np.zeros((len(owner), SEGMENT), np.uint8)
        lengths = np.zeros(len(owner), np.int64)
        at = 0
        for c in coded:
            for s in range(0, len(c), SEGMENT):
                part = c[s:s + SEGMENT]
                rows[at, :len(part)] = part
                lengths[at] = len(part)
                at += 1
        order = np.argsort(-lengths, kind="stable")
        needed = np.zeros((len(texts), len(self.languages)))
        np.add.at(needed, owner[order], self.phrases(rows[order], lengths[order]))
        size = np.bincount(owner, lengths, len(texts))
        cost = needed * np.array(self.bits) / np.maximum(size, 1)[:, None]
        letters = size > 0  # codes that aren't empty begin with a letter
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = cost.argmin(1)
        odds = np.exp2(-10 * np.minimum(cost - cost.min(1, keepdims=True), 50) * np.minimum(1, size / 20)[:, None])
        score = np.where(letters, 1 / odds.sum(1), 0.0)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)], score


@functools.lru_cache(2)
def parser_of(samples: tuple[tuple[str, str], ...]) -> Parser:
    """Built once per worker process."""
    return Parser(dict(samples))


def samples(docs: DataFrame, modulus: int, held: int, rows: int, chars: int) -> tuple[tuple[str, str], ...]:
    """Whole learnable texts of each language up to `chars` characters, from the first `rows` by a hash of the text.

    Only texts of 200 to 8000 characters are chosen, so that no single one fills the sample; a language without any
    takes its shortest ones. Equal texts come once.
    """
    text, lang = F.col("text").cast("string"), F.col("lang").cast("string")
    ok = docs.where(text.isNotNull() & lang.isNotNull() & F.coalesce(bucket_of(F.col("doc_id"), modulus) != held, F.lit(False)))
    ok = ok.select(lang.alias("l"), text.alias("t"), (~F.length(text).between(200, 8000)).alias("odd"))
    ok = ok.withColumns({"h": F.xxhash64("t"), "n": F.when(F.col("odd"), F.length("t")).otherwise(0)})
    order = ["odd", "n", "h"]
    # hashes are chosen first, without the texts: at most `rows` of each language, which may be broadcast
    first = ok.select("l", *order).distinct().withColumn("s", F.pmod("h", F.lit(8)))
    first = first.withColumn("k", F.row_number().over(Window.partitionBy("l", "s").orderBy(*order))).where(F.col("k") <= rows)
    first = first.withColumn("k", F.row_number().over(Window.partitionBy("l").orderBy(*order))).where(F.col("k") <= rows)
    chosen = ok.join(F.broadcast(first.select("l", "h").distinct()), ["l", "h"]).groupBy("l", *order).agg(F.first("t").alias("t"))
    taken: dict[str, list[str]] = {}
    for r in sorted(chosen.collect(), key=lambda r: (r["l"], r["odd"], r["n"], r["h"])):
        own = taken.setdefault(r["l"], [])
        if r["t"] not in own and (not own or sum(map(len, own)) + len(r["t"]) <= chars):
            own.append(r["t"])
    return tuple((k, "\n".join(v)) for k, v in sorted(taken.items()))


def identify(docs: DataFrame, modulus: int = 3, held: int = 1, rows: int = 40, chars: int = 12_000) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document.

    docs needs doc_id, text and lang; other columns are ignored. Null texts and texts without a letter are `und` with
    score 0, and so is everything if there is nothing to learn from. Ties go to the alphabetically first language. Null
    ids and repeated rows stay as they are; an empty table gives no rows. The sample is bounded by `rows` and `chars`
    for each language (the first text is taken whatever its length).
    """
    learnt = samples(docs, modulus, held, rows, chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = parser_of(learnt)
        for part in slices(batches, 1, 1_000_000):
            langs, score = parser.predict(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = slim.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(bucket_of(F.col("doc_id"), modulus) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
