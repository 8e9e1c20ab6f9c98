"""Near copies at a given Jaccard similarity of word shingles, found by SimHash fingerprints and by bands of shingle minima.

Texts whose fingerprints are within `BITS` bits are candidates by the operator of `simhash`: segment bit counts, the grid join
under their Manhattan bound, exact distances. A fingerprint misses many pairs near 0.8, so there are candidates of a second kind.

Two texts agree in the smallest of their shingle hashes with a probability that is their Jaccard similarity, whatever
the edit and the length. A cell is one choice of ROWS minima; there are BANDS of them, so that a pair at 0.8 shares no cell
once in two million cases. Texts of a cell are compared by a sketch of their shingles, with a margin of its error. A cell,
cut into parts if crowded, gives a spanning forest of its most similar links, whose similarity is then computed exactly
from the texts. Groups with a refuted link, and more pairs than they handed on, hand on more of those that are still apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorgrid.llm.cells import SMALL
from spoorgrid.llm.common import NOT_SPACE, slices, word_hashes, written
from spoorgrid.llm.components import contracted_components
from spoorgrid.llm.simhash import fingerprint, links as fingerprint_links

SLOTS = 256
BANDS, ROWS = 28, 4
#: Words of a shingle and differing bits of the fingerprints, those of op9_simhash.
FINGERPRINT_WORDS, BITS = 3, 3
#: Nearly five deviations of a sketch's estimate at 0.8.
MARGIN = 0.12
_FACTORS = np.random.default_rng(11).integers(1 << 62, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(4) + np.uint64(1)
KEY = ["_copies_h1", "_copies_h2"]
GROUP = ["cell", "lo", "hi"]
#: Texts in a part of a cell, and how many links of each text its groups hand on in a round; at last all of two parts.
PART_ROWS = 2048
BEST = 0, 16, 256, 2 * PART_ROWS


def keyed(docs: DataFrame) -> DataFrame:
    """Two hashes that name a text; null and texts without words are the empty text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    text = F.when(text.rlike(r"^[\x20\x09-\x0D]*$"), "").otherwise(text)
    return docs.withColumns({"_copies_h1": F.xxhash64(text), "_copies_h2": F.xxhash64(F.lit(7), text)})


def shingle_hashes(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of so many words (of all words, if a text has fewer) and the text of each."""
    hashes, owner = word_hashes(texts, NOT_SPACE)
    n = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(n) - n
    place = np.arange(len(owner)) - first[owner]
    size = np.minimum(words, n)[owner]
    starts = np.flatnonzero(place + size <= n[owner])
    out = np.zeros(len(starts), np.uint64)
    for k in range(words):
        has = k < size[starts]
        step = hashes[np.minimum(starts + k, len(hashes) - 1)]
        out = np.where(has, (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + step, out)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out, owner[starts]


def band_keys(hashes: np.ndarray, owner: np.ndarray, n: int) -> list[np.ndarray]:
    """The cells of each of n texts: BANDS of them, none for a text without words."""
    own, first = np.unique(owner, return_index=True)
    keys = np.empty((len(own), BANDS), np.uint64)
    for band in range(BANDS if len(own) else 0):
        key = np.full(len(own), band + 1, np.uint64)
        for factor in _FACTORS[band * ROWS:(band + 1) * ROWS]:
            key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(hashes * factor, first)
        keys[:, band] = key ^ (key >> np.uint64(29))
    out = [keys[:0, 0]] * n
    for i, row in zip(own.tolist(), keys, strict=True):
        out[i] = row
    return out


def sketches(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """One byte for each of SLOTS groups of shingle hashes: of the smallest one in it, 0 if there is none."""
    slot, value = hashes >> np.uint64(56), (hashes >> np.uint64(8)) & np.uint64(0xFFFFFFFF)
    ranked = np.sort(((owner.astype(np.uint64) * np.uint64(SLOTS) + slot) << np.uint64(32)) | value)
    place, first = np.unique(ranked >> np.uint64(32), return_index=True)
    out = np.zeros(n * SLOTS, np.uint8)
    out[place.astype(np.int64)] = 1 + (ranked[first] & np.uint64(0xFFFFFFFF)) % np.uint64(255)
    return out.reshape(-1, SLOTS)


def _similar(sketch: np.ndarray, x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """(cost, x, y) of the pairs of rows whose estimated similarity, the share of filled slots that agree, is at least that."""
    out = [np.zeros((0, 3))]
    for s in range(0, len(x), 20_000):
        a, b = x[s:s + 20_000], y[s:s + 20_000]
        filled = (sketch[a] > 0) | (sketch[b] > 0)
        like = ((sketch[a] == sketch[b]) & filled).sum(1) / np.maximum(filled.sum(1), 1)
        good = like >= least
        out.append(np.stack([-like[good], a[good], b[good]], 1))
    return np.concatenate(out)


def _forest(pairs: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which pairs (ordered by cost) make a spanning forest of least cost; rows of equal label are connected already.

    Each round takes the first pair of every tree, so costs are told apart by order and no circle can close.
    """
    keep, at = np.zeros(len(pairs), bool), np.arange(len(pairs))
    x, y = pairs[:, 1].astype(np.int64), pairs[:, 2].astype(np.int64)
    root = np.arange(int(label.max(initial=-1)) + 1)
    while len(at):
        p, q = root[label[x[at]]], root[label[y[at]]]
        other = p != q
        at, p, q = at[other], p[other], q[other]
        first = np.full(len(root), len(at))
        first[p[::-1]] = np.arange(len(at))[::-1]
        also = np.full(len(root), len(at))
        also[q[::-1]] = np.arange(len(at))[::-1]
        first = np.unique(np.minimum(first, also))
        for k in first[first < len(at)].tolist():
            a, b = int(p[k]), int(q[k])
            while root[a] != a:
                a = int(root[a])
            while root[b] != b:
                b = int(root[b])
            root[max(a, b)] = min(a, b)
            keep[at[k]] = True
        while (root[root] != root).any():
            root = root[root]
    return keep


def _among_best(pairs: np.ndarray, n: int, best: int) -> np.ndarray:
    """Which pairs (ordered by cost) are among the first `best` of one of their rows."""
    keep = np.zeros(len(pairs), bool)
    if best:
        row, at = np.concatenate([pairs[:, 1], pairs[:, 2]]).astype(np.int64), np.tile(np.arange(len(pairs)), 2)
        order = np.lexsort((at, row))
        count = np.bincount(row, minlength=n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        keep[at[order[place < best]]] = True
    return keep


def text_table(docs: DataFrame, words: int) -> DataFrame:
    """One row a text: its name, smallest doc_id and the rows that have it, cells, sketch, fingerprint and a number."""
    schema = "_copies_h1 long, _copies_h2 long, doc_id long, cells array<long>, sketch binary, fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 3, 1_000_000):
            texts = part.column(3).to_pylist()
            hashes, owner = shingle_hashes(texts, words)
            cells = band_keys(hashes, owner, part.num_rows)
            ends = np.cumsum([0, *map(len, cells)])
            cells = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *cells]).view(np.int64)))
            found = [cells, pa.array([r.tobytes() for r in sketches(hashes, owner, part.num_rows)], pa.binary())]
            prints = np.fromiter((fingerprint(t, FINGERPRINT_WORDS) for t in texts), np.uint64, part.num_rows)
            found.append(pa.array(prints.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *found], names=["_copies_h1", "_copies_h2", "doc_id", "cells", "sketch", "fp"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*KEY, F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, schema)
    rows = rows.groupBy(*KEY, "doc_id").agg(F.count("*").alias("n"), F.first("cells").alias("cells"), F.first("sketch").alias("sketch"), F.first("fp").alias("fp"))
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "n")).alias("m")
    rows = rows.groupBy(*KEY).agg(least, F.first("cells").alias("cells"), F.first("sketch").alias("sketch"), F.first("fp").alias("fp"))
    rows = rows.select(*KEY, F.col("m.doc_id").alias("first"), F.col("m.n").alias("times"), "cells", "sketch", "fp")
    return written(rows.withColumn("id", F.monotonically_increasing_id()), "copies-texts")


def alike_prints(texts: DataFrame) -> DataFrame:
    """(a, b) with text numbers a < b: links that connect the texts of equal fingerprints, and fingerprints within BITS bits."""
    nodes = written(texts.groupBy("fp").agg(F.min("id").alias("node")), "copies-prints")
    equal = texts.select("id", "fp").join(nodes, "fp").where("id != node").select(F.col("node").alias("a"), F.col("id").alias("b"))
    near = fingerprint_links(nodes.select("fp"), BITS)
    for c in "ab":
        near = near.join(nodes.select(F.col("fp").alias(c), F.col("node").alias(f"_{c}")), c)
    return equal.unionByName(near.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")))


def shared_cells(texts: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(cell, lo, hi, id, sketch, _i): the texts of every cell that has several, in groups of two parts or one.

    Of cells with the same texts only one is kept: what they would give is the same.
    """
    places = texts.select("id", F.explode("cells").alias("cell"))
    cells = places.groupBy("cell").agg(F.count("*").alias("_n"), F.bit_xor(F.xxhash64("id")).alias("_s"), F.bit_xor(F.xxhash64(F.lit(7), "id")).alias("_t"))
    cells = cells.where("_n > 1").groupBy("_n", "_s", "_t").agg(F.min("cell").alias("cell"))
    cells = cells.select("cell", F.ceil(F.col("_n") / part_rows).cast("int").alias("_k"))
    held = places.join(cells, "cell").join(texts.select("id", "sketch"), "id")
    held = held.withColumn("_i", F.pmod(F.xxhash64("id"), F.col("_k")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda p: F.struct(F.least(p, F.col("_i")).alias("lo"), F.greatest(p, F.col("_i")).alias("hi")))
    return held.select("cell", "id", "sketch", "_i", F.inline(pairs)).select(*GROUP, "id", "sketch", "_i")


def similar_texts(held: DataFrame, least: float, best: int) -> DataFrame:
    """(cell, lo, hi, a, b, more) with text numbers a < b: links of at least the estimated similarity.

    They are those that connect what is linked within a group and the `best` most similar of each text. Texts of the same
    root are connected already. `more` tells of a group that it has links that it doesn't hand on.
    """

    def compare(cell: np.ndarray, lo: np.ndarray, hi: np.ndarray, ids: np.ndarray, sketch: np.ndarray, part: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.append(True, (np.diff(cell) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)))
        sizes = np.diff(np.append(starts, len(cell)))
        run, small = np.repeat(np.arange(len(starts)), sizes), np.repeat(sizes <= SMALL, sizes)
        order = np.lexsort((root, run))
        new = np.append(True, (np.diff(run[order]) != 0) | (np.diff(root[order]) != 0))
        label, pairs, more = np.empty(len(ids), np.int64), [np.zeros((0, 3))], np.zeros(len(starts), bool)
        label[order] = np.cumsum(new) - 1

        def add(x: np.ndarray, y: np.ndarray) -> None:
            ok = (label[x] != label[y]) & ((lo[x] == hi[x]) | (part[x] != part[y]))
            pairs.append(_similar(sketch, x[ok], y[ok], least))
            if sum(map(len, pairs)) > 1_000_000:  # keep only what is handed on
                pairs[:] = [chosen()]

        def chosen() -> np.ndarray:
            found = np.concatenate(pairs)
            found = found[np.argsort(found[:, 0], kind="stable")]
            keep = _forest(found, label) | _among_best(found, len(ids), best)
            more[run[found[~keep, 1].astype(np.int64)]] = True
            return found[keep]

        for d in range(1, min(SMALL, int(sizes.max(initial=1)))):
            x = np.flatnonzero((run[:-d] == run[d:]) & small[:-d])
            add(x, x + d)
        for r in np.flatnonzero(sizes > SMALL):
            rows = np.arange(starts[r], starts[r] + sizes[r])
            step = max(1, 200_000 // len(rows))
            for at in range(0, len(rows), step):
                x, y = np.repeat(rows[at:at + step], len(rows)), np.tile(rows, len(rows[at:at + step]))
                add(x[x < y], y[x < y])
        found = chosen()
        x, y = found[:, 1].astype(np.int64), found[:, 2].astype(np.int64)
        out = {"cell": cell[x], "lo": lo[x], "hi": hi[x], "a": np.minimum(ids[x], ids[y]), "b": np.maximum(ids[x], ids[y]), "more": more[run[x]]}
        return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in out.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, SLOTS) if pa.types.is_binary(c.type) else c.to_numpy() for c in batch.columns]
            if kept is not None:
                rows = [np.concatenate(x) for x in zip(kept, rows, strict=True)]
            edge = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0) | (np.diff(rows[2]) != 0)) + 1
            last = edge[-1] if len(edge) else 0  # the last group may go on in the next batch
            if last:
                yield compare(*[x[:last] for x in rows])
            kept = [x[last:].copy() for x in rows]
        if kept is not None:
            yield compare(*kept)

    held = held.select(*GROUP, "id", "sketch", "_i", "root").repartition(*GROUP).sortWithinPartitions(*GROUP)
    return held.mapInArrow(run, "cell long, lo int, hi int, a long, b long, more boolean")


def bodies_of(links: DataFrame, texts: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, text): one row for each text that has a link."""
    ids = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    names = texts.join(ids, "id").select("id", *KEY)
    # one row a text before its links are joined to it
    bodies = docs.select(*KEY, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(names, KEY).groupBy("id").agg(F.first("text").alias("text"))
    return written(bodies, "copies-bodies")


def verified(links: DataFrame, bodies: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b, ok): whether the texts of a link have the similarity exactly."""
    both = links.join(bodies.select(F.col("id").alias("a"), F.col("text").alias("left")), "a").join(bodies.select(F.col("id").alias("b"), F.col("text").alias("right")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2, 1_000_000):
            texts = part.column(2).to_pylist() + part.column(3).to_pylist()
            hashes, owner = shingle_hashes(texts, words)
            own = np.split(hashes, np.searchsorted(owner, np.arange(1, len(texts))))
            ok = []
            for x, y in zip(own[:part.num_rows], own[part.num_rows:], strict=True):
                x, y = np.unique(x), np.unique(y)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(bool(shared >= similarity * max(1, len(x) + len(y) - shared) or len(x) == len(y) == 0))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    return both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long, ok boolean")


def classes_of(links: DataFrame) -> DataFrame:
    """(id, root) of texts with links."""
    return contracted_components(links).select(F.col("node").alias("id"), "root")


def linked_texts(texts: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(id, root) by verified links: those of alike fingerprints, and what connects all verified links of texts in a shared cell.

    A group whose forest holds is connected as far as its links go. One with a refuted link may have lost a text that a
    link outside the forest holds, so it is asked again, with what is connected by now, until it has no more to hand on.
    """
    held = written(shared_cells(texts), "copies-groups")
    live, known, roots = held.withColumn("root", F.col("id")), None, None
    for best in BEST:
        found = written(similar_texts(live, similarity - MARGIN, best), "copies-links")
        pairs = found.select("a", "b").distinct()
        if known is None:  # a text with any link has one in a forest: no later round needs other texts
            pairs = written(pairs.unionByName(alike_prints(texts)).distinct(), "copies-pairs")
            bodies = bodies_of(pairs, texts, docs)
            tested = known = written(verified(pairs, bodies, words, similarity), "copies-verified")
        else:
            tested = written(verified(pairs.join(known, ["a", "b"], "left_anti"), bodies, words, similarity), "copies-verified")
            known = known.unionByName(tested)
        links = tested.where("ok").select("a", "b")
        # what is connected by now is one link a text, so each round adds its own links to stars
        roots = classes_of(links if roots is None else links.unionByName(roots.select(F.col("id").alias("a"), F.col("root").alias("b"))))
        again = found.where("more").join(known.where("not ok"), ["a", "b"], "left_semi").select(*GROUP).distinct()
        if best == BEST[-1] or again.isEmpty():
            break
        live = held.join(again, GROUP, "left_semi").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    return roots


def without_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without the rows that have a near copy of smaller doc_id in their group; columns as they are.

    A group is connected by links of two texts with the given Jaccard similarity of their shingles (lower-cased, words
    between white space). Equal texts are always linked, null, empty and blank ones too. One row of each group stays: that of
    its smallest doc_id, null ids last, one of repeated rows. The planned loss of a pair at 0.8 is (1 - 0.8 ** ROWS) ** BANDS,
    4e-7, by its cells and 1e-6 by its sketches, for every kind of edit and every length.
    """
    docs = keyed(docs)
    texts = text_table(docs, words)
    roots = linked_texts(texts, docs, words, similarity)
    classes = texts.select("id", *KEY, "first", "times").join(roots, "id", "left")
    classes = classes.withColumn("root", F.coalesce("root", "id"))
    best = classes.groupBy("root").agg(F.min(F.struct(F.col("first").isNull(), "first", "id")).alias("m")).select(F.col("m.id").alias("id"))
    stay = written(classes.join(best, "id", "left_semi").select(*KEY, F.col("first").alias("_copies_first"), F.col("times").alias("_copies_times")), "copies-stay")
    kept = docs.join(stay, KEY).where(F.col("doc_id").cast("long").eqNullSafe(F.col("_copies_first")))
    once = kept.where("_copies_times = 1").unionByName(kept.where("_copies_times > 1").dropDuplicates(KEY))
    return once.drop(*KEY, "_copies_first", "_copies_times")
