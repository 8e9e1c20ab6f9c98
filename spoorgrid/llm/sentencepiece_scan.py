"""SentencePiece BPE encoding as a parallel max-plus scan, and decoding.

Ids are those of the `sentencepiece` library, giant documents included, although no task holds a whole one. What makes
chunks independent is a local law of BPE: a sequence of pieces is the encoding of its text if and only if every two
neighbours are the encoding of their own two-piece text. (The first merge that crosses a border of pieces would be made
in that two-piece text as well.) So encoding is a path through a lattice with edges between compatible neighbours, and
each prefix of a text has one last piece.

The state at a chunk border is the piece that reaches or crosses it and by how much. A chunk yields the matrix from its
entry states to its exit states; all finite entries of these max-plus matrices are 0, so a matrix is kept as the set of
its finite entries. Products are associative and run in two levels; the one state of each border that is reachable from
both ends starts the backtrace of its chunk, independently of all others. No piece crosses from another character to a
following word mark, nor a line end: there a border has a single state, and what lies between two of them is encoded
once per worker and kept.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorgrid.llm.common import slices, written

MARK = "▁"
SAFE = "S"
KEPT = 300_000
#: Numbers of characters that are no pieces begin at UNKNOWN; NOTHING is above them all.
UNKNOWN, NOTHING = 1 << 20, 1 << 22


#: SAFE, or (piece, how far it reaches over the border)
State = str | tuple[str, int]
UNITS = re.compile(rf"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")


@dataclass
class Chunk:
    """text[begin:end] is the chunk; what is around it is as much as a piece can reach."""

    text: str
    begin: int
    end: int
    first: bool
    last: bool


class Lattice:
    """Pieces of a model, their merges, and walks through the lattice of compatible neighbours."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special(i)}
        self.rank = {p: model.get_score(i) for p, i in self.ids.items()}
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(len(self.pieces)) if model.is_byte(i)}
        of_byte = {i: bytes([b]) for b, i in self.byte.items()}
        self.raw = [of_byte.get(i) or p.encode() for i, p in enumerate(self.pieces)]
        self.unknown = model.unk_id()
        self.longest = max(map(len, self.ids))
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids):
            raise ValueError("pieces of this model cross word marks or line ends")
        #: starts of pieces by their next character: the id of the piece, or -1 if it is only a start, and what follows
        self.starts: dict[str, tuple[int, dict]] = {}
        for p, i in self.ids.items():
            after = self.starts
            for c in p[:-1]:
                after = after.setdefault(c, (-1, {}))[1]
            after[p[-1]] = (i, after[p[-1]][1] if p[-1] in after else {})
        self.pairs: dict[int, bool] = {}
        #: ids of units as the bytes of 32-bit integers, in two generations: what is used again moves to the young one
        self.units: dict[str, bytes] = {}
        self.old_units: dict[str, bytes] = {}

    def merge(self, text: str) -> list[str]:
        """The encoding of a short text by merges: best score first, then leftmost."""
        parts, score, none = list(text), self.rank.get, -np.inf
        scores = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while scores:
            best = max(scores)
            if best == none:
                break
            at = scores.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = score(parts[at - 1] + parts[at], none)
            if at < len(scores):
                scores[at] = score(parts[at] + parts[at + 1], none)
        return parts

    def number(self, piece: str | None) -> int:
        """The id of a piece, a number above all ids for a character that is none, one more than all for None."""
        if piece is None:
            return NOTHING
        i = self.ids.get(piece)
        return i if i is not None else UNKNOWN + ord(piece)

    def fits(self, a: int, b: int) -> bool:
        """Whether piece b may follow piece a (NOTHING: a border that nothing crosses)."""
        known = self.pairs.get(a * NOTHING + b)
        if known is None:
            name = lambda i: self.pieces[i] if i < UNKNOWN else chr(i - UNKNOWN)
            if a == NOTHING:
                known = self.merge(name(b)) == [name(b)]
            else:  # two pieces that are one piece together would merge
                both = name(a) + name(b)
                known = both not in self.ids and self.merge(both) == [name(a), name(b)]
            if len(self.pairs) >= 2 * KEPT:
                self.pairs.clear()
            self.pairs[a * NOTHING + b] = known
        return known

    def follow(self, text: str, at: int, stop: int) -> list[tuple[int, int]]:
        """(end, number) of all pieces that start at a position, shortest first."""
        out, after, end = [], self.starts, at
        for c in text[at:min(stop, at + self.longest)]:
            step = after.get(c)
            if step is None:
                break
            i, after = step
            end += 1
            if i >= 0:
                out.append((end, i))
        if not out or out[0][0] > at + 1:
            out.insert(0, (at + 1, UNKNOWN + ord(text[at])))
        return out

    def walk(self, text: str, start: int, piece: str | None, stop: int) -> dict[int, str | None]:
        """The last piece of each reachable position from start (where `piece` ended) to stop."""
        last: dict[int, str | None] = {start: piece}
        for begin in range(start, stop):
            if begin in last:
                before = self.number(last[begin])
                for end, i in self.follow(text, begin, min(stop, begin + self.longest)):
                    if end not in last and self.fits(before, i):
                        last[end] = text[begin:end]
        return last

    def path(self, text: str) -> list[int]:
        """The one path through all of a text, longest pieces first. A position has one last piece, so where a search
        failed once it always fails: no position is searched twice."""
        stop, pairs, fits, follow = len(text), self.pairs, self.fits, self.follow
        stack: list[tuple] = []
        dead: set[int] = set()
        at, before, options = 0, NOTHING, follow(text, 0, stop)
        while at < stop:
            while options:
                end, i = options.pop()
                if end in dead:
                    continue
                ok = pairs.get(before * NOTHING + i)
                if fits(before, i) if ok is None else ok:
                    stack.append((at, before, options))
                    at, before = end, i
                    options = follow(text, at, stop) if at < stop else options
                    break
            else:
                dead.add(at)
                at, before, options = stack.pop()
        return [s[1] for s in stack[1:]] + [before] if stack else []

    def back(self, last: dict[int, str | None], start: int, end: int) -> list[str]:
        out = []
        while end > start:
            piece = last[end]
            out.append(piece)
            end -= len(piece)
        return out[::-1]

    def numbers(self, pieces: list[str]) -> bytes:
        return self.spelled([self.number(p) for p in pieces])

    def spelled(self, numbers: list[int]) -> bytes:
        """Ids as 32-bit integers; characters that are no pieces as byte pieces."""
        if not numbers or max(numbers) < UNKNOWN:
            return array("i", numbers).tobytes()
        out = array("i")
        for i in numbers:
            if i < UNKNOWN:
                out.append(i)
            else:
                out.extend([self.byte.get(b, self.unknown) for b in chr(i - UNKNOWN).encode("utf-8", "replace")] if self.byte else [self.unknown])
        return out.tobytes()

    def unit(self, text: str) -> bytes:
        """Ids of what lies between two borders with a single state."""
        ids = self.old_units.get(text) or self.spelled(self.path(text))
        if len(text) <= 64:
            if len(self.units) >= KEPT:
                self.old_units, self.units = self.units, {}
            self.units[text] = ids
        return ids

    def between(self, text: str) -> bytes:
        """Ids of a text that begins and ends at such borders."""
        unit = self.unit
        return b"".join([self.units.get(u) or unit(u) for u in UNITS.findall(text)])

    def spell(self, ids: np.ndarray) -> str:
        """The text of ids: word marks become spaces, the first one goes, ill-formed bytes are replaced."""
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text

    def entries(self, text: str, at: int) -> list[tuple[str, int]]:
        """Every (piece, how far it reaches over the border) that the text around a border allows."""
        out = []
        for over in range(self.longest):
            for before in range(1, self.longest - over + 1):
                piece = text[at - before:at + over]
                if at >= before and len(piece) == before + over and (piece in self.ids or len(piece) == 1):
                    out.append((piece, over))
        return out

    def tail(self, last: dict[int, str | None], border: int) -> list[tuple[str, int]]:
        """Exit states among the reached positions: pieces that start before the border and end at or after it."""
        return [(p, end - border) for end, p in last.items() if p is not None and end >= border and end - len(p) < border]

    def span(self, chunk: Chunk, entry: State) -> tuple[int, str | None, int | None, int | None]:
        """Where a walk from the entry state starts, after which piece, and the first and last safe border from there."""
        start, piece = (chunk.begin, None) if entry == SAFE else (chunk.begin + entry[1], entry[0])
        text, end = chunk.text, chunk.end
        ends = chunk.last or safe(text, end)
        first = start if entry == SAFE else next((i for i in range(start, end) if safe(text, i)), end if ends and start <= end else None)
        if first is None:
            return start, piece, None, None
        return start, piece, first, end if ends else next((i for i in range(end - 1, first, -1) if safe(text, i)), first)

    def matrix(self, chunk: Chunk) -> list[tuple[State, State]]:
        """The finite entries of the chunk's transfer matrix."""
        starts: list[State] = [SAFE] if chunk.first or safe(chunk.text, chunk.begin) else self.entries(chunk.text, chunk.begin)
        closed = chunk.last or safe(chunk.text, chunk.end)
        reach = min(len(chunk.text), chunk.end + self.longest)
        out: list[tuple[State, State]] = []
        tails: list[State] | None = None
        for entry in starts:
            start, piece, first, final = self.span(chunk, entry)
            if first is None:
                out += [(entry, x) for x in self.tail(self.walk(chunk.text, start, piece, reach), chunk.end)]
            elif first in self.walk(chunk.text, start, piece, first):
                if tails is None:
                    tails = [SAFE] if closed else self.tail(self.walk(chunk.text, final, None, reach), chunk.end)
                out += [(entry, x) for x in tails]
        return out

    def trace(self, chunk: Chunk, entry: State, leave: State) -> bytes:
        """Ids (32-bit integers) of the pieces after the entry state's up to the exit state's."""
        start, piece, first, final = self.span(chunk, entry)
        end = chunk.end if leave == SAFE else chunk.end + leave[1]
        if first is None:
            return self.numbers(self.back(self.walk(chunk.text, start, piece, end), start, end))
        head = self.numbers(self.back(self.walk(chunk.text, start, piece, first), start, first))
        rest = b"" if final == end else self.numbers(self.back(self.walk(chunk.text, final, None, end), final, end))
        return head + self.between(chunk.text[first:final]) + rest


def safe(text: str, at: int) -> bool:
    """Whether no piece can cross this position, whatever surrounds it."""
    a, b = text[at - 1], text[at]
    return (a != MARK and b == MARK) or a == "\n" or b == "\n"


@functools.lru_cache(1)
def lattice(model_path: str) -> Lattice:
    return Lattice(model_path)


def _lists(ids: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(i) // 4 for i in ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))


def product(a: list, b: list) -> list:
    """Max-plus product of two matrices of zeros, as lists of finite entries."""
    after = defaultdict(list)
    for x, y in b:
        after[x].append(y)
    return sorted({(x, z) for x, y in a for z in after.get(y, ())}, key=repr)


def states_between(matrices: list[list], enter: State, leave: State) -> list[State]:
    """The state at each border: reachable from `enter` and able to reach `leave`; one is left at each."""
    ahead = [{enter}]
    for m in matrices:
        ahead.append({y for x, y in m if x in ahead[-1]})
    out, behind = [leave], {leave}
    for m, start in zip(reversed(matrices), reversed(ahead[:-1]), strict=True):
        behind = {x for x, y in m if y in behind and x in start}
        out.append(next(iter(behind)))
    return out[::-1]


def _dump(state: State) -> str:
    return json.dumps(state)


def _load(text: str) -> State:
    state = json.loads(text)
    return state if isinstance(state, str) else (state[0], state[1])


def normal(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def chunks_of(text: str, size: int, around: int) -> Iterator[tuple[int, Chunk]]:
    whole = normal(text)
    for k, at in enumerate(range(0, len(whole), size)):
        low, high, end = max(0, at - around), min(len(whole), at + size + around), min(len(whole), at + size)
        if len(whole) - end < around:  # no chunk is shorter than a piece can be
            end = high = len(whole)
        yield k, Chunk(whole[low:high], at - low, end - low, at == 0, end == len(whole))
        if end == len(whole):
            return


CHUNK = "key string, chunk int, text string, begin int, end int, first boolean, last boolean"
FAN = 64


def encode(docs: DataFrame, model_path: str | None = None, chunk_chars: int = 32_768, verify: bool = False) -> DataFrame:
    """doc_id, ids and text_crc32 of every row; with `verify` also round_trip, whether decoding the ids gives the text
    back (a literal word mark in a text becomes a space).

    docs needs doc_id and text; other columns are ignored. Null and empty texts have no ids (and crc32 0). Null ids and
    repeated rows stay as they are; an empty table gives no rows. Texts of more than chunk_chars characters are encoded
    as chunks by several tasks, equal ones once.
    """
    import public_tokenizers

    path = model_path or public_tokenizers.path("piece_bpe_32k.model")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(path)
        for part in slices(batches, 1, 1_000_000):
            texts = part.column(1).to_pylist()
            ids = [own.trace(Chunk(t, 0, len(t), True, True), SAFE, SAFE) if t else b"" for t in map(normal, texts)]
            crc = [zlib.crc32(t.encode("utf-8", "replace")) for t in texts]
            columns = [part.column(0), _lists(ids), pa.array(crc, pa.int64())]
            if verify:  # here, where the ids are, so that they are not sent to another worker
                columns.append(pa.array([own.spell(np.frombuffer(i, np.int32)) == t for i, t in zip(ids, texts, strict=True)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "text_crc32", "round_trip"][:len(columns)])

    done = rows.where(F.length("text") <= chunk_chars).mapInArrow(short, "doc_id long, ids array<int>, text_crc32 long" + ", round_trip boolean" * verify)
    giant = rows.where(F.length("text") > chunk_chars).withColumn("key", F.sha2("text", 256))
    long = giant_rows(giant, path, chunk_chars)
    if verify:
        crc = F.crc32(F.col("text").cast("binary"))
        long = decode(long, path).select("doc_id", "ids", "text_crc32", (crc == F.col("text_crc32")).alias("round_trip"))
    return done.unionByName(long)


def giant_rows(giant: DataFrame, path: str, chunk_chars: int) -> DataFrame:
    """Chunks, their matrices, the states at their borders, their ids, and the ids of whole documents."""
    around = 64

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in CHUNK.split(", ")]
        for part in slices(batches, 1, 1):
            for key, whole in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                for k, c in chunks_of(whole, chunk_chars, around):
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((key, k, c.text, c.begin, c.end, c.first, c.last), (
                        pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()), strict=True)], names=names)

    texts = giant.groupBy("key").agg(F.first("text").alias("text"))
    chunks = written(texts.mapInArrow(cut_up, CHUNK).repartition("key", "chunk"), "piece-chunks")

    def of(row: dict) -> Chunk:
        return Chunk(row["text"], row["begin"], row["end"], row["first"], row["last"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(path)
        for batch in batches:
            rows = batch.to_pylist()
            found = [json.dumps(own.matrix(of(r))) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=["key", "chunk", "matrix"])

    def read(texts: pd.Series) -> list[list]:
        fix = lambda s: s if isinstance(s, str) else (s[0], s[1])
        return [[(fix(x), fix(y)) for x, y in json.loads(t)] for t in texts]

    matrices = written(chunks.mapInArrow(measure, "key string, chunk int, matrix string").withColumn("run", F.floor(F.col("chunk") / FAN).cast("int")), "piece-matrices")

    def multiply(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "run": [key[1]], "matrix": [json.dumps(functools.reduce(product, read(rows.sort_values("chunk")["matrix"])))]})

    def borders(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("run")
        at = [_dump(s) for s in states_between(read(rows["matrix"]), SAFE, SAFE)]
        return pd.DataFrame({"key": key[0], "run": rows["run"], "enter": at[:-1], "leave": at[1:]})

    def inside(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        at = [_dump(s) for s in states_between(read(rows["matrix"]), _load(rows["enter"].iloc[0]), _load(rows["leave"].iloc[0]))]
        return pd.DataFrame({"key": key[0], "chunk": rows["chunk"], "enter": at[:-1], "leave": at[1:]})

    runs = matrices.groupBy("key", "run").applyInPandas(multiply, "key string, run int, matrix string")
    outer = runs.groupBy("key").applyInPandas(borders, "key string, run int, enter string, leave string")
    states = matrices.join(outer, ["key", "run"]).groupBy("key", "run").applyInPandas(inside, "key string, chunk int, enter string, leave string")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(path)
        for batch in batches:
            ids = [own.trace(of(r), _load(r["enter"]), _load(r["leave"])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(ids)], names=["key", "chunk", "ids"])

    parts = chunks.join(states, ["key", "chunk"]).mapInArrow(follow, "key string, chunk int, ids array<int>")
    whole = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
    whole = whole.select("key", F.flatten(F.col("parts.ids")).alias("ids"))
    return giant.select("doc_id", "key", F.crc32(F.col("text").cast("binary")).alias("text_crc32")).join(whole, "key").select("doc_id", "ids", "text_crc32")


def decode(rows: DataFrame, model_path: str | None = None) -> DataFrame:
    """rows with `text`, what their ids spell. A null list is a null text; ids outside the model are refused.

    Pieces are joined, runs of byte pieces become characters (ill-formed ones the replacement character), word marks
    become spaces and the first one, which encoding adds, goes.
    """
    import public_tokenizers

    path = model_path or public_tokenizers.path("piece_bpe_32k.model")
    names = [c for c in rows.columns if c != "text"]
    schema = rows.select(*names).schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(path)
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            texts = [own.spell(ids.values.to_numpy()) if ids.is_valid else None for ids in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    return rows.select(*names).mapInArrow(run, schema)


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, ids, n_ids, text_crc32 and round_trip of every row."""
    return encode(docs, verify=True).select("doc_id", "ids", F.size("ids").alias("n_ids"), "text_crc32", "round_trip")
