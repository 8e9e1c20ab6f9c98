"""Maximal runs of periodic words, scale by scale.

Periods are dealt with by octaves, P <= period < 2 P. A run of period p repeats words at distance p over a stretch of p words at least, so
this stretch holds a multiple of P, an anchor. For an anchor, two Z-functions of the words around it tell for every shift how far the words before
and after it agree with those that many words on: a forward and a backward extension that add up to p or more are a piece of a run. Extensions are
limited to 2 P, so an anchor needs few words around it and a document can be dealt out in overlapping tiles per octave. A tile solves its anchors alone;
pieces of the same period meet by (document, period) and those that touch are one run. Anchors whose neighbouring words differ at all shifts,
nearly all of them, are told by comparing hashes of eight words, so Z-functions are computed where text repeats.

A period of an octave is dropped where a divisor of it explains the same stretch, so what remains has its smallest period.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoorgrid.llm.common import slices, written

LEAST = 12
#: Periods below this are found by comparing all words at each distance; longer ones repeat eight words on one side of an anchor.
SHORT = 16
GRAM = 8
#: Words of documents that one task solves whole; longer ones become tiles of at least so many words.
TILE = 4096


def z_function(words: list) -> list[int]:
    """For each position, how many words from it on agree with the first ones."""
    n = len(words)
    z = [n] + [0] * (n - 1)
    low = high = 0
    for i in range(1, n):
        k = min(z[i - low], high - i) if i < high else 0
        while i + k < n and words[k] == words[i + k]:
            k += 1
        z[i] = k
        if i + k > high:
            low, high = i, i + k
    return z


def anchored(words: np.ndarray, anchor: int, octave: int) -> list[tuple[int, int, int]]:
    """(period, start, end) of the pieces of runs of an octave around an anchor, by a Z-function on each side of it."""
    low, high = max(0, anchor - 2 * octave), min(len(words), anchor + 4 * octave)
    ahead = z_function(words[anchor:high].tolist())
    before = words[low:anchor][::-1].tolist()
    # how far the words before anchor + d agree with those before the anchor: the reversed words matched against the reversed stretch
    stretch = words[low:min(len(words), anchor + 2 * octave)][::-1].tolist()
    back = z_function(before + stretch)[len(before):] if before else [0] * len(stretch)
    shifts = range(1, min(2 * octave, high - anchor, len(stretch) - len(before) + 1))
    found, out = [], []
    for d in shifts:
        f, b = ahead[d] if d < len(ahead) else 0, min(back[len(stretch) - len(before) - d], len(before))
        if f + b < d:
            continue
        if not any(d % q == 0 and b <= qb and d + f <= q + qf for q, qf, qb in found):
            found.append((d, f, b))
            if d >= octave:
                out.append((d, anchor - b, anchor + d + f))
    return out


def grams(words: np.ndarray) -> np.ndarray:
    """A hash of each GRAM words in a row."""
    out = np.zeros(max(0, len(words) - GRAM + 1), np.uint64)
    for k in range(GRAM):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words[k:k + len(out)].astype(np.uint64)
    return out


def pieces_of(words: np.ndarray, octave: int, core: tuple[int, int], gram: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(period, start, end) of pieces of runs whose period is of an octave (1: all below SHORT) and that a core range of words meets.

    Words around the core by 64, or by 4 octaves, must be there unless the text ends. Equal numbers are equal words.
    """
    out = []
    if octave == 1:
        for p in range(1, min(SHORT, len(words))):
            same = np.diff(np.concatenate([[0], (words[:-p] == words[p:]).astype(np.int8), [0]]))
            start, end = np.flatnonzero(same == 1), np.flatnonzero(same == -1) + p
            good = (end - start >= max(LEAST, 2 * p)) & (start < core[1]) & (end > core[0])
            out += zip([p] * int(good.sum()), start[good].tolist(), end[good].tolist(), strict=True)
        least: dict[tuple[int, int], int] = {}
        for p, s, e in out:
            least.setdefault((s, e), p)  # multiples of a period have the same stretch
        return [(p, s, e) for (s, e), p in least.items()]
    gram = grams(words) if gram is None else gram
    anchors = np.arange(-(-core[0] // octave) * octave, core[1], octave)
    wide = np.lib.stride_tricks.sliding_window_view(np.concatenate([gram, np.zeros(2 * octave, np.uint64)]), octave) if len(gram) else None
    hit = set()
    for offset in (0, -GRAM):  # eight words from the anchor on, or before it
        at = anchors + offset
        at = at[(at >= 0) & (at + octave < len(gram))]
        for some in np.split(at, range(0, len(at), max(1, 4_000_000 // octave))[1:]):
            hit |= set((some[(wide[some + octave] == gram[some][:, None]).any(1)] - offset).tolist())
    for anchor in sorted(hit):
        out += anchored(words, anchor, octave)
    return out


def stitched(pieces: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Pieces of the same period that share at least the period are one."""
    out: list[tuple[int, int, int]] = []
    for p, s, e in sorted(pieces):
        if out and out[-1][0] == p and s <= out[-1][2] - p:
            out[-1] = p, out[-1][1], max(e, out[-1][2])
        else:
            out.append((p, s, e))
    return out


def octaves(n: int) -> list[int]:
    """The octaves of periods that a text of n words can have: 1 stands for all below SHORT."""
    out, octave = [1], SHORT
    while 2 * octave <= n:
        out.append(octave)
        octave *= 2
    return out


def rewritten(n: int, h: int) -> tuple[int, int] | None:
    """(a, p): from word a on, word i is the original word a + (i - a) % p. The fixed rule of the registered query."""
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def order_of(n: int, rule: tuple[int, int] | None) -> np.ndarray:
    at = np.arange(n)
    if rule:
        a, p = rule
        at[a:] = a + (at[a:] - a) % p
    return at


def report(runs: list[tuple[int, int, int]], words: list[bytes] | Callable, n: int) -> tuple:
    """The row of a document: counts, its greatest run, checksums. runs: (period, start, end)."""
    rows = sorted((s, e - s, p) for p, s, e in runs)
    best = min(rows, key=lambda r: (-r[1], r[0], r[2]), default=None)
    keep = np.ones(n, bool)
    for s, length, p in rows:
        keep[s + p:s + length] = False
    listed = hashlib.sha256("".join(f"{s},{length},{p}\n" for s, length, p in rows).encode()).hexdigest()
    values = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(rows), *values, listed, words(keep)


def _digest(parts: Iterator[list[bytes]]) -> str:
    out, some = hashlib.sha256(), False
    for part in parts:
        if part:
            out.update((b" " if some else b"") + b" ".join(part))
            some = True
    return out.hexdigest()


def word_slabs(text: bytes, slab: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in lists of bounded size (or of one word)."""
    at, white = 0, b" \t\n\r\x0b\x0c"
    while at < len(text):
        end = at + slab
        while end < len(text) and text[end] not in white:
            end += 1
        yield text[at:end].split()
        at = end


FOUND = [("n_runs", "long"), ("start", "long"), ("length", "long"), ("period", "long"), ("exponent_milli", "long"), ("runs_sha256", "string"), ("collapsed_sha256", "string")]
SCHEMA = "doc_id long, " + ", ".join(f"{c} {t}" for c, t in FOUND)
TYPES = {"long": pa.int64(), "string": pa.string()}


def _table(ids: list, rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(ids, pa.int64()), *[pa.array([r[i] for r in rows], TYPES[t]) for i, (_, t) in enumerate(FOUND)]]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", *[c for c, _ in FOUND]])


def solve(texts: list[bytes], rules: list[int | None]) -> list[tuple]:
    """Rows of whole documents, solved together: their words stand one after the other with a mark of its own between two of them."""
    split = [t.split() for t in texts]
    codes = pd.factorize(np.array([w for words in split for w in words] or [b""], object))[0].astype(np.int64)
    sizes = [len(w) for w in split]
    orders = [order_of(n, None if h is None else rewritten(n, h)) for n, h in zip(sizes, rules, strict=True)]
    joined, ends, at = [], [], 0
    for i, (n, order) in enumerate(zip(sizes, orders, strict=True)):
        joined += [codes[at:at + n][order], [-1 - i]]
        at += n
        ends.append(at + i + 1)
    line = np.concatenate(joined).astype(np.int64)
    gram = grams(line)
    found: list[list] = [[] for _ in texts]
    starts = np.array(ends) - np.array(sizes) - 1
    for octave in octaves(max(sizes)):
        for p, s, e in stitched(pieces_of(line, octave, (0, len(line)), gram)):
            doc = int(np.searchsorted(ends, s, side="right"))
            if e - s >= max(LEAST, 2 * p):
                found[doc].append((p, s - int(starts[doc]), e - int(starts[doc])))

    def collapsed(words: list[bytes], order: np.ndarray) -> Callable:
        return lambda keep: _digest([[words[i] for i in order[keep].tolist()]])

    return [report(runs, collapsed(w, o), n) for runs, w, o, n in zip(found, split, orders, sizes, strict=True)]


def numbered(text: bytes, h: int | None) -> np.ndarray:
    """The words of a giant document as 64-bit hashes, rewritten."""
    import xxhash

    hashes = [np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) for words in word_slabs(text)]
    codes = np.concatenate([np.zeros(0, np.uint64), *hashes]).view(np.int64)
    rule = None if h is None else rewritten(len(codes), h)
    return codes[order_of(len(codes), rule)] if rule else codes


def tiles(n: int, tile: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(octave, first and last word of a tile, its core within the document): each octave covers the text with its own tiles."""
    for octave in octaves(n):
        size, margin = (tile, 64) if octave == 1 else (max(tile, 16 * octave), 4 * octave)
        for low in range(0, n, size):
            high = min(n, low + size)
            yield octave, max(0, low - margin), min(n, high + margin), low, high


def giant_runs(giant: DataFrame, tile: int = TILE) -> DataFrame:
    """(key, period, start, end) of all runs of giant documents; giant: key, text and h (null: no rewriting).

    Tiles of all octaves are dealt out, their pieces meet by document and period. Long gaps between pieces are no problem: pieces are
    ordered by position and a running maximum of ends tells where a run begins, so a group is the runs of one period of one document.
    """
    schema = "key string, octave int, base long, low int, high int, wide boolean, words binary"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        types = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
        for part in slices(batches, 1, 1):
            for key, text, h in zip(*[c.to_pylist() for c in part.columns], strict=True):
                codes = numbered(text, h)
                for octave, first, last, low, high in tiles(len(codes), tile):
                    kinds, own = np.unique(codes[first:last], return_inverse=True)  # equal words are all that counts
                    wide = len(kinds) > 1 << 16
                    row = key, octave, first, low - first, high - first, wide, own.astype(np.int32 if wide else np.uint16).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

    def solve_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for r in batch.to_pylist():
                # the anchors of an octave are multiples of it in the document
                shift = r["base"] % r["octave"]
                words = np.frombuffer(r["words"], np.int32 if r["wide"] else np.uint16).astype(np.int64)
                if shift:
                    words = np.concatenate([-1 - np.arange(shift), words])
                for p, s, e in stitched(pieces_of(words, r["octave"], (r["low"] + shift, r["high"] + shift))):
                    for column, value in zip(out, (r["key"], p, s - shift + r["base"], e - shift + r["base"]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i else pa.string()) for i, c in enumerate(out)], names=["key", "period", "start", "end"])

    text = F.col("text").cast("binary").alias("text")
    dealt = giant.select("key", text, "h").mapInArrow(deal, schema).withColumn("_n", F.col("base") + F.col("octave"))
    pieces = dealt.repartition("key", "octave", "_n").drop("_n").mapInArrow(solve_tiles, "key string, period long, start long, end long")
    order = Window.partitionBy("key", "period").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.withColumn("_new", F.when(F.col("start") <= reach - F.col("period"), 0).otherwise(1))
    pieces = pieces.withColumn("_run", F.sum("_new").over(order))
    runs = pieces.groupBy("key", "period", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.where(F.col("end") - F.col("start") >= F.greatest(F.lit(LEAST), 2 * F.col("period"))).select("key", "period", "start", "end")


def periodic_runs(docs: DataFrame, rewrite: bool = True, tile: int = TILE) -> DataFrame:
    """The report of every row: doc_id, n_runs, its greatest run, exponent_milli and checksums of its runs and of the text that is kept.

    docs needs doc_id and text; other columns are ignored. A null text has no words. Rows without doc_id are never rewritten; repeated rows are
    reported as often as they come; an empty table gives no rows. Equally long greatest runs: the first one, then the smaller period.
    `rewrite` applies the rule that makes part of the texts periodic. Documents of more than `tile` words become tiles; their words are
    compared by 64-bit hashes, those of others themselves. Texts equal in what counts are solved once.
    """
    doc_id = F.col("doc_id").cast("long")
    h = F.crc32(doc_id.cast("string").cast("binary")) if rewrite else F.lit(None).cast("long")
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # no text of so many bytes has more words
    words = F.when(F.octet_length(body) < 2 * tile, 0).otherwise(F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]+")))
    rows = docs.select(doc_id.alias("doc_id"), body.alias("text"), h.alias("h"), words.alias("_n"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, 1_000_000):
            texts = pc.cast(part.column(1), pa.binary()).to_pylist()
            yield _table(part.column(0).to_pylist(), solve(texts, part.column(2).to_pylist()))

    done = rows.where(F.col("_n") <= tile).select("doc_id", "text", "h").mapInArrow(short, SCHEMA)
    h = F.when(F.col("h") % 10 == 0, F.col("h"))
    giant = rows.where(F.col("_n") > tile).select("doc_id", "text", h.alias("h"), F.concat_ws(" ", F.sha2("text", 256), h).alias("key"))
    texts = written(giant.groupBy("key").agg(F.first("text").alias("text"), F.first("h").alias("h")), "period-texts")
    runs = giant_runs(texts, tile).groupBy("key").agg(F.collect_list(F.struct("period", "start", "end")).alias("runs"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, 1):
            keys, rows = part.column(0).to_pylist(), []
            for text, h, own in zip(*[c.to_pylist() for c in part.columns[1:]], strict=True):
                n = sum(map(len, word_slabs(text)))
                rule = None if h is None else rewritten(n, h)
                rows.append(report([(r["period"], r["start"], r["end"]) for r in own or []], lambda keep, t=text, r=rule: _digest(_kept(t, keep, r)), n))
            table = _table([None] * len(rows), rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *table.columns[1:]], names=["key", *table.schema.names[1:]])

    whole = texts.join(runs, "key", "left").select("key", F.col("text").cast("binary").alias("text"), "h", "runs")
    whole = whole.mapInArrow(finish, "key string, " + ", ".join(f"{c} {t}" for c, t in FOUND))
    names = ["doc_id", *[c for c, _ in FOUND]]
    return done.unionByName(giant.select("doc_id", "key").join(whole, "key").select(*names))


def _kept(text: bytes, keep: np.ndarray, rule: tuple[int, int] | None) -> Iterator[list[bytes]]:
    """The kept words in order, in lists. Words of a rewritten tail are taken from its first period, which is held."""
    at, held, (a, p) = 0, [], rule or (len(keep), 1)
    for words in word_slabs(text):
        held += words[max(0, a - at):max(0, a + p - at)] if at < a + p else []
        yield [w for i, w in enumerate(words[:max(0, a - at)]) if keep[at + i]]
        at += len(words)
    for low in range(a, len(keep), 65536):
        yield [held[(i - a) % p] for i in range(low, min(low + 65536, len(keep))) if keep[i]]
