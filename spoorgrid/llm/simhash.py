"""SimHash near-duplicates by segment popcounts.

A fingerprint is cut into small segments; the vector of their bit counts changes by at most one per differing bit, so
the Manhattan distance of two vectors is a lower bound of the Hamming distance of their fingerprints. The range join
under that bound runs on a grid: segments are dealt into `blocks` blocks, and of vectors within distance `bits` at
least blocks - bits blocks agree exactly, so a cell is the bit counts of one choice of so many blocks. Vectors that
share a cell are compared by the whole Manhattan bound and then exactly. No link is lost and no bucket is cut off.

Equal fingerprints are one node, so copies of any number are one row here.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorgrid.llm.cells import Near, linked
from spoorgrid.llm.common import written
from spoorgrid.llm.components import components

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SEED = 42


def fingerprint(text: str | None, words: int) -> int:
    """64 bits: each is set if over half of the text's shingles (repeats included) have it set in their XXH64.

    bytes.split() without an argument splits at exactly the ASCII white space \\x20 and \\x09-\\x0D.
    """
    tokens = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = (np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1).tolist()
    size = min(words, len(tokens))
    starts = [0, *[e + 1 for e in ends[:len(tokens) - size]]]
    digest, n = xxhash.xxh64_intdigest, len(starts)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):  # a very long text needs no more memory than this
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in
                              zip(starts[at:at + 65536], ends[at + size - 1:at + size - 1 + 65536], strict=False)), np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def block_segments(blocks: int, segment_bits: int) -> list[list[int]]:
    """The segments (by number) of each block."""
    return [[int(s) for s in part] for part in np.array_split(np.arange(64 // segment_bits), blocks)]


def segment_counts(fp: Column, segment_bits: int) -> list[Column]:
    mask = (1 << segment_bits) - 1
    return [F.bit_count(F.shiftrightunsigned(fp, s * segment_bits).bitwiseAND(F.lit(mask))) for s in range(64 // segment_bits)]


def grid_cells(nodes: DataFrame, bits: int, blocks: int, segment_bits: int, agree: int | None = None) -> DataFrame:
    """A row (table, cell, fp) for each choice of `agree` blocks, blocks - bits of them unless given."""
    counts, parts = segment_counts(F.col("fp"), segment_bits), block_segments(blocks, segment_bits)
    packed = []
    for part in parts:  # the counts of a block, one digit per segment
        code = F.lit(0).cast("long")
        for s in part:
            code = code * (segment_bits + 1) + counts[s]
        packed.append(code)
    choices = list(itertools.combinations(range(blocks), agree or blocks - bits))
    cells = F.array(*[F.struct(F.lit(i).alias("table"), F.xxhash64(F.lit(i), *[F.col("_p")[b] for b in c]).alias("cell"))
                      for i, c in enumerate(choices)])
    return nodes.withColumn("_p", F.array(*packed)).select("fp", F.inline(cells))


def _embed(fps: np.ndarray, segment_bits: int) -> np.ndarray:
    shift = np.arange(0, 64, segment_bits, dtype=np.uint64)
    return np.bitwise_count((fps[:, None] >> shift) & np.uint64((1 << segment_bits) - 1)).astype(np.int8)


def within_bound(bits: int, segment_bits: int) -> Near:
    """Pairs within the Manhattan bound of their segment counts, then verified exactly."""

    def near(a: np.ndarray, b: np.ndarray, upper: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ea, eb = _embed(a, segment_bits), _embed(b, segment_bits)
        step = max(1, 2_000_000 // max(1, len(b)))
        for at in range(0, len(a), step):
            bound = np.zeros((len(ea[at:at + step]), len(b)), np.int8)
            for s in range(ea.shape[1]):
                bound += np.abs(ea[at:at + step, s, None] - eb[None, :, s])
            i, j = np.nonzero(bound <= bits)
            i += at
            if upper:
                i, j = i[i < j], j[i < j]
            ok = np.bitwise_count(a[i] ^ b[j]) <= bits
            yield i[ok], j[ok]

    return near


def _first_table(a: np.ndarray, b: np.ndarray, bits: int, blocks: int, segment_bits: int) -> np.ndarray:
    """The first choice of blocks that both fingerprints agree on: a pair is returned from that cell only."""
    equal = _embed(a, segment_bits) == _embed(b, segment_bits)
    agree = np.stack([equal[:, p].all(1) for p in block_segments(blocks, segment_bits)], 1)
    first = agree & (np.cumsum(agree, 1) <= blocks - bits)
    number = np.full(1 << blocks, -1)
    for k, c in enumerate(itertools.combinations(range(blocks), blocks - bits)):
        number[sum(1 << x for x in c)] = k
    return number[first @ (1 << np.arange(blocks))]


def links(nodes: DataFrame, bits: int = 3, blocks: int = 6, segment_bits: int = 2, part_rows: int = 2048) -> DataFrame:
    """(a, b): links that connect what fingerprints at `bits` or fewer differing bits connect. nodes: distinct fp."""
    cells = grid_cells(nodes, bits, blocks, segment_bits).withColumnRenamed("fp", "code")
    first = functools.partial(_first_table, bits=bits, blocks=blocks, segment_bits=segment_bits)
    return linked(cells, bits, within_bound(bits, segment_bits), first, part_rows)


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 3, blocks: int = 6, segment_bits: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable by links.

    docs needs doc_id and text; other columns are ignored. Null and empty texts have fingerprint zero and are linked
    like any other. Repeated rows stay, with equal results. Rows with a null doc_id get a result too, but never name a
    component unless no other row is in it. An empty table gives no rows.
    """
    prints = written(fingerprints(docs, words), "simhash-prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), bits, blocks, segment_bits)).select(F.col("node").alias("fp"), "root")
    classes = nodes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = classes.join(named, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(classes, "fp").select("doc_id", hexed, "component_id")
