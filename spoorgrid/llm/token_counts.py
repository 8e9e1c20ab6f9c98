"""Token counts of a byte-level BPE, giant documents by overlap resynchronisation.

A giant document is cut into chunks that overlap; each chunk is encoded on its own and the counts are spliced at a position
where both encodings are proven to be that of the whole document:

* after a character that isn't white space and before a white space one. No match of the pre-tokenizer's pattern covers both,
  whatever surrounds them, and matches never look back.
* where both chunks start a word of the pattern, far enough from the end of the left chunk for its matches to be final: the pattern
  has no memory but its position.
* inside one long word of both chunks, where both have the same next token. A sequence of tokens is the encoding of a word if and only if
  each two neighbours are the encoding of their own two tokens' bytes; the left chunk's neighbours at this place are such a pair, so
  left tokens up to it and right tokens from it on satisfy this everywhere.

The left chunk is taken as right there because its own left end was proven in the same way, back to the start of the text. Documents with an
overlap that has no such place are cut again with wider overlaps, and what still fails is walked window by window.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorgrid.llm.common import slices, written

#: A character that isn't white space before one that is: \S here excludes all that the pattern's \s includes.
STATIC = re.compile(r"(?<=\S)[ \n\t\r]")
#: Bytes before the end of a chunk whose matches may not be final: contractions look ahead two characters, and a special string may begin there.
MARGIN = 64
CHUNK, OVERLAPS = 32_768, (256, 8_192)
COUNTED = "key string, chunk int, n long, last boolean"


class Codec:
    """The tokenizers library's encoding of a vocabulary file, as arrays of ids and of the bytes of each id."""

    def __init__(self, path: str, ranks_path: str | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        if self.library.normalizer is not None or "ByteLevel" not in repr(self.library.pre_tokenizer) or len(max(self.special, default="")) >= MARGIN:
            raise ValueError("the proofs hold for byte-level pre-tokenizers without a normalizer")
        self.sizes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.sizes[i] = len(token.encode()) if token in self.special else len(token)
        self.fast = None
        if ranks_path:  # the same vocabulary in a library that encodes it four times as fast
            from spoorgrid.llm.packing import encoder

            self.fast = encoder(ranks_path)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return np.array(self.fast.encode(text, allowed_special="all", disallowed_special=()), np.int64)
            except ValueError:  # it can't match a very long run of white space
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int64)

    def count(self, text: str) -> int:
        return len(self.ids(text))

    def starts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text, and the byte where each begins; at last its size."""
        ids = self.ids(text)
        return ids, np.concatenate([[0], np.cumsum(self.sizes[ids])])

    def word_starts(self, text: str) -> np.ndarray:
        """Bytes where a word of the pattern (or a special string) begins, for a text that begins with one."""
        out, at = [], 0
        for part in re.split("(" + "|".join(map(re.escape, self.special)) + ")", text) if self.special else [text]:
            if part in self.special:
                out.append([at])
            elif part:
                words = [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(part)]
                out.append(at + np.cumsum([0, *map(len, words[:-1])]))  # a letter of the byte alphabet is one byte
            at += len(part.encode())
        return np.concatenate([np.zeros(0, np.int64), *out])

    def places(self, text: str, coded: tuple, zone: str, at: int, begin: int, left: bool) -> list[tuple[str, int, int]]:
        """(kind, byte in the document, tokens before it) of what can be spliced within a zone: characters that this chunk shares with another.

        `coded` is what starts() gives for the chunk's text, `at` the byte of the zone in the document, `begin` that of the text. The two chunks
        see the same zone, so they agree on its kind.
        """
        found = STATIC.search(zone, 1)
        ids, starts = coded
        if found:
            pos = at + len(zone[:found.start()].encode())
            return [("static", pos, int(np.searchsorted(starts, pos - begin)))]
        low, high = at - begin, at - begin + len(zone.encode())
        words = self.word_starts(text)
        final = high - MARGIN if left else high
        out = [("word", int(w) + begin, int(np.searchsorted(starts, w))) for w in words if low < w <= final]
        # inside the word that reaches over the start of the zone, which is the first word of the right chunk
        over = words[words > low].min(initial=high)
        if not left or low not in words:
            for i in range(int(np.searchsorted(starts, low, side="right")), int(np.searchsorted(starts, min(over, high)))):
                if low < starts[i] < min(over, high):
                    out.append((f"next {ids[i]}", int(starts[i]) + begin, i))
        return out

    def walk(self, text: str, window: int = CHUNK) -> int:
        """Tokens of a text by windows one after the other, each begun at a proven place of the one before."""
        at = total = 0
        size = window
        while True:
            part = text[at:at + size]
            if at + size >= len(text):
                return total + self.count(part)
            ids, starts = self.starts(part)
            sizes = np.cumsum([0, *(len(c.encode()) for c in part)]) if not part.isascii() else None
            byte = lambda c: c if sizes is None else int(sizes[c])
            found = [m.start() for m in STATIC.finditer(part, size // 2)]
            cut = next(((c, int(np.searchsorted(starts, byte(c)))) for c in found[-1:]), None)
            if cut is None:
                cut = self._inside(text, at, part, ids, starts, byte)
            if cut is None:
                size *= 2  # widen and try again
                continue
            at, total, size = at + cut[0], total + cut[1], window

    def _inside(self, text: str, at: int, part: str, ids: np.ndarray, starts: np.ndarray, byte) -> tuple[int, int] | None:
        """A proven place of a window without a word border in sight: character and tokens before it."""
        words = self.word_starts(part)
        ends = np.arange(1, len(part)) if part.isascii() else np.cumsum([len(c.encode()) for c in part])[:-1]
        char = {int(b): c for c, b in enumerate(ends, 1)}
        limit = byte(len(part)) - MARGIN
        some = words[(words > byte(len(part) // 2)) & (words <= limit)]
        if len(some):
            return char[int(some[-1])], int(np.searchsorted(starts, some[-1]))
        begin = int(words[-1])
        for i in range(int(np.searchsorted(starts, (begin + limit) // 2 if begin else limit // 2)), len(ids) - 1, max(1, len(ids) // 16)):
            here = char.get(int(starts[i]))
            if here is not None and begin < starts[i] <= limit and ids[i] not in self.special.values():
                after = self.ids(text[at + here:at + here + len(part)])
                if after[0] == ids[i]:
                    return here, i
        return None


@functools.lru_cache(2)
def codec(path: str, ranks_path: str | None) -> Codec:
    return Codec(path, ranks_path)


def pieces(text: str, size: int, overlap: int) -> Iterator[tuple[int, str, int, int | None]]:
    """(number, text, first byte, byte of the next chunk) of the chunks of a text; each reaches `overlap` characters into the next."""
    k = at = byte = 0
    while True:
        last = len(text) - at <= size + overlap
        own = text[at:at + size]
        following = byte + len(own.encode())
        yield k, text[at:] if last else text[at:at + size + overlap], byte, None if last else following
        if last:
            return
        k, at, byte = k + 1, at + size, following


def spliced(texts: DataFrame, path: str, ranks: str | None, size: int, overlap: int) -> DataFrame:
    """(key, n_tokens): null where an overlap has no proven place. texts: key and text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, 1):
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                for k, own, at, following in pieces(text, size, overlap):
                    yield pa.RecordBatch.from_pylist([{"key": key, "chunk": k, "text": own, "at": at, "following": following}], schema=pa.schema(
                        [("key", pa.string()), ("chunk", pa.int32()), ("text", pa.string()), ("at", pa.int64()), ("following", pa.int64())]))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, ranks)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                text, found = r["text"], []
                coded = own.starts(text)
                if r["chunk"]:
                    found += [(r["chunk"], "right", *p) for p in own.places(text, coded, text[:overlap], r["at"], r["at"], False)]
                if r["following"] is not None:
                    found += [(r["chunk"] + 1, "left", *p) for p in own.places(text, coded, text[size:], r["following"], r["at"], True)]
                out.append({"key": r["key"], "chunk": r["chunk"], "n": len(coded[0]), "last": r["following"] is None,
                            "places": [dict(zip(("junction", "side", "kind", "pos", "before"), p, strict=True)) for p in found]})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    place = pa.struct([("junction", pa.int32()), ("side", pa.string()), ("kind", pa.string()), ("pos", pa.int64()), ("before", pa.int64())])
    schema = pa.schema([("key", pa.string()), ("chunk", pa.int32()), ("n", pa.int64()), ("last", pa.bool_()), ("places", pa.list_(place))])
    kinds = "places array<struct<junction int, side string, kind string, pos long, before long>>"
    chunks = texts.mapInArrow(cut, "key string, chunk int, text string, at long, following long").repartition("key", "chunk")
    found = written(chunks.mapInArrow(encode, f"{COUNTED}, {kinds}"), "token-chunks")
    places = found.select("key", "chunk", "n", F.inline("places"))
    left = places.where("side = 'left'").select("key", "junction", "kind", "pos", (F.col("n") - F.col("before")).alias("rest"))
    right = places.where("side = 'right'").select("key", "junction", "kind", "pos", "before")
    # what both chunks count beyond the first place that they share; chunk by chunk, so that a giant's junctions are many small groups
    joints = left.join(right, ["key", "junction", "kind", "pos"]).groupBy("key", "junction").agg(F.min_by(F.col("rest") + F.col("before"), "pos").alias("twice"))
    joints = joints.groupBy("key").agg(F.count("*").alias("joined"), F.sum("twice").alias("twice"))
    whole = found.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("chunks")).join(joints, "key", "left")
    done = F.coalesce("joined", F.lit(0)) == F.col("chunks") - 1
    return whole.select("key", F.when(done, F.col("n") - F.coalesce("twice", F.lit(0))).alias("n_tokens"))


def giant_counts(giant: DataFrame, path: str, ranks: str | None, size: int = CHUNK, overlaps: tuple = OVERLAPS) -> DataFrame:
    """(key, n_tokens) of giant documents, equal texts once; giant: key and text."""
    texts, out = giant.groupBy("key").agg(F.first("text").alias("text")), None
    for overlap in overlaps:
        counts = written(spliced(texts, path, ranks, size, overlap), "token-counts")
        done = counts.where("n_tokens is not null")
        out = done if out is None else out.unionByName(done)
        texts = texts.join(counts.where("n_tokens is null"), "key", "left_semi")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, ranks)
        for part in slices(batches, 1, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([own.walk(t, size) for t in part.column(1).to_pylist()], pa.int64())], names=["key", "n_tokens"])

    return out.unionByName(texts.mapInArrow(walk, "key string, n_tokens long"))


def count_tokens(docs: DataFrame, path: str | None = None, ranks_path: str | None = None, limit: int = 512, chunk_chars: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row.

    docs needs doc_id and text; other columns are ignored. A null text is empty: no bytes, no tokens. Null ids and repeated rows stay as
    they are; an empty table gives no rows. `path` is a vocabulary of the tokenizers library; `ranks_path` may name the same vocabulary for
    the faster library (by default both are the 50k one). Texts of over chunk_chars characters are counted in chunks by several tasks.
    """
    import public_tokenizers

    if path is None:
        path, ranks_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, ranks_path)
        for part in slices(batches, 0, 1_000_000):
            counts = pa.array([own.count(t) for t in part.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns[1:], counts], names=["doc_id", "n_bytes", "n_tokens"])

    done = rows.where(F.length("text") <= chunk_chars).select("text", "doc_id", "n_bytes").mapInArrow(short, "doc_id long, n_bytes long, n_tokens long")
    giant = rows.where(F.length("text") > chunk_chars).withColumn("key", F.sha2("text", 256))
    counts = giant_counts(giant.select("key", "text"), path, ranks_path, chunk_chars)
    done = done.unionByName(giant.select("doc_id", "n_bytes", "key").join(counts, "key").drop("key"))
    return done.withColumn("over_limit", F.col("n_tokens") > limit)
