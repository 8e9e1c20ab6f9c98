"""Hierarchical multi-length packing of tokenised documents.

Documents are routed to the smallest context window (tier) that holds them, longer ones give whole top-tier windows
first. Each tier is packed from its own pieces, gaps of a window are filled with whole pieces of shorter tiers, and
what is left of a gap takes the head of one more piece, so that windows are full. Windows are then dealt into step
groups of equal token counts and similar attention cost.

Each partition packs on its own: no token ids are shuffled, a task holds one chunk of `chunk_tokens` ids (or one
document, if that is longer) and at most one window per partition is padded.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIERS = (128, 256, 512, 1024)
END_OF_DOCUMENT = 0
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "tier int, step_group long")


@functools.lru_cache(1)
def encoder(ranks_path: str):
    """The byte-level BPE of the vocabulary file. Its ids equal those of the same vocabulary in `tokenizers`, the
    special token's string included."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={"<|endoftext|>": len(ranks)})


@functools.lru_cache(1)
def reference(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def ids_of(text: str, ranks_path: str) -> list[int]:
    """Ids of a text. The fast library refuses white space of about a million characters on end; the other one, of the
    same ids, takes it."""
    import public_tokenizers

    try:
        return encoder(ranks_path).encode(text, allowed_special="all", disallowed_special=())
    except ValueError:
        return reference(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids


class Pool:
    """Pieces by length; the longest (or shortest) one within a range is found on a bit mask."""

    def __init__(self, top: int):
        self.stacks: list[list] = [[] for _ in range(top + 1)]
        self.mask = 0

    def push(self, doc: int, start: int, length: int) -> None:
        self.stacks[length].append((doc, start, length))
        self.mask |= 1 << length

    def _pop(self, length: int) -> tuple[int, int, int]:
        stack = self.stacks[length]
        piece = stack.pop()
        if not stack:
            self.mask ^= 1 << length
        return piece

    def longest(self, most: int, over: int = 0) -> tuple[int, int, int] | None:
        at = (self.mask & ((1 << (most + 1)) - 1)).bit_length() - 1
        return self._pop(at) if at > over else None

    def shortest_over(self, least: int) -> tuple[int, int, int] | None:
        above = self.mask >> (least + 1)
        return self._pop(least + (above & -above).bit_length()) if above else None


def plan_windows(lengths: list[int], tiers: tuple = TIERS) -> tuple[list, list]:
    """Full windows [(tier, [(doc, start, length), ...])] and the pieces left over, fewer tokens than the lowest tier."""
    top = tiers[-1]
    pool, windows = Pool(top), []
    for doc, n in enumerate(lengths):
        whole = n // top * top
        windows += [(top, [(doc, start, top)]) for start in range(0, whole, top)]
        if n > whole:
            pool.push(doc, whole, n - whole)
    rest: list = []
    for tier, below in zip(reversed(tiers), [*reversed(tiers[:-1]), 0], strict=True):
        while (piece := pool.longest(tier, below)) is not None:
            window, gap = [piece], tier - piece[2]
            while gap:
                if (piece := pool.longest(gap)) is not None:
                    window.append(piece)
                    gap -= piece[2]
                elif (piece := pool.shortest_over(gap)) is not None:
                    doc, start, length = piece
                    window.append((doc, start, gap))
                    pool.push(doc, start + gap, length - gap)
                    gap = 0
                else:
                    break
            if not gap:
                windows.append((tier, window))
                continue
            # the last pieces: they go on as a full window of the next lower tier and a rest
            rest, room = [], below
            for doc, start, length in window:
                head = min(room, length)
                if head:
                    rest.append((doc, start, head))
                    room -= head
                if length > head:
                    pool.push(doc, start + head, length - head)
            if below:
                windows.append((below, rest))
                rest = []
            else:
                rest = [*rest, *window]
                pool = Pool(top)
    return windows, rest


def step_groups(windows: list, step_tokens: int) -> list[int]:
    """A group for each window: equal tokens a group within a tier, attention cost dealt out back and forth."""
    groups, base = [0] * len(windows), 0
    for tier in sorted({t for t, _ in windows}):
        own = [i for i, (t, _) in enumerate(windows) if t == tier]
        cost = [sum(length * length for _, _, length in windows[i][1]) for i in own]
        own = [i for _, i in sorted(zip(cost, own, strict=True), reverse=True)]
        n = -(-len(own) * tier // step_tokens)
        for k, i in enumerate(own):
            turn, at = divmod(k, n)
            groups[i] = base + (at if turn % 2 == 0 else n - 1 - at)
        base += n
    return groups


def pack(docs: DataFrame, ranks_path: str | None = None, tiers: tuple = TIERS, chunk_tokens: int = 2_000_000,
         step_tokens: int = 16_384) -> DataFrame:
    """One row per piece of a document: where it starts, its ids' checksum and its place in a window.

    docs needs doc_id and text; other columns are ignored. A null text is empty: its only id is the end mark. Null ids
    of documents stay null; repeated rows are packed as often as they come. Empty input gives no rows. Pieces of a
    document cover its ids exactly once, in any order of windows. `sequence_id` is unique over the whole result:
    partition number in the upper bits, window of the partition in the lower 40. A partition's last window may be
    shorter than its tier (then padded to the top tier); every other one is full.
    """
    import public_tokenizers

    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        sequences, groups = 0, 0
        held: list[tuple] = []  # (doc_id, ids, first position of these ids, tokens of the document)
        size = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, sequences, groups
            windows, rest = plan_windows([len(ids) for _, ids, _, _ in held], tiers)
            step = step_groups(windows, step_tokens)
            if last and rest:
                windows, step = [*windows, (tiers[-1], rest)], [*step, max(step, default=-1) + 1]
            out: list[list] = [[] for _ in range(9)]
            for k, (tier, window) in enumerate(windows):
                offset = 0
                for doc, start, length in window:
                    doc_id, ids, first, total = held[doc]
                    row = (doc_id, first + start, length, zlib.crc32(ids[start:start + length].tobytes()), total,
                           base + sequences + k, offset, tier, base + groups + step[k])
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    offset += length
            sequences += len(windows)
            groups += max(step, default=-1) + 1
            held = [(held[d][0], held[d][1][s:s + n].copy(), held[d][2] + s, held[d][3]) for d, s, n in rest]
            size = sum(len(ids) for _, ids, _, _ in held)
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int32() if i == 7 else pa.int64()) for i, c in enumerate(out)],
                    names=[c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = ids_of(text.as_py() or "", path)
                ids.append(END_OF_DOCUMENT)
                held.append((doc_id, np.array(ids, "<u4"), 0, len(ids)))
                size += len(ids)
                if size >= chunk_tokens:
                    yield from flush(False)
        yield from flush(True)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
