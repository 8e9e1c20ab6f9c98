"""Ranked lexical search by a pipeline of term owners.

Documents are indexed in blocks: the task that reads a block writes its inverted lists, so building the index shuffles
nothing. Terms belong to owners by how rare they are, rarest first. Item bundles visit the owners one after the other:
a stage brings together, by cogroup, the accumulators that a bundle carries for a block and that owner's lists of the block,
adds the integer contributions and sends the accumulators on. Only the last owner has the terms that nearly every document
holds, so what travels is sparse; it selects the best documents of a block, and the best of all blocks are the result.

A frequent term is spread over all blocks and a bundle holds a bounded number of items, so no group grows with the data.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoorgrid.llm.common import slices, written

#: What separates terms becomes a space, A-Z become a-z, every other byte stays.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
INDEX = "block long, term string, slots array<int>, tfs array<int>, ns array<int>, docs array<long>, n_docs long, n_terms long"
ITEMS_IN_BUNDLE = 256
#: An owner has the terms that at most one document in so many holds; the last one has the rest.
OWNERS = (256, 32)
_FILTER_BITS = 24


def terms_of(text) -> F.Column:
    """The terms of a text column, repeats included; null has none."""
    folded = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(folded, F.lit(f"({_TERM})"), F.lit(1))


def words_in(text: bytes, slab: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text in lists of bounded size."""
    at = 0
    while at < len(text):
        end = min(len(text), at + slab)
        part = text[at:end].translate(_FOLD)
        if end < len(text) and not part.endswith(b" "):
            cut = part.rfind(b" ")
            while cut < 0 and end < len(text):  # a term longer than a slab
                end = min(len(text), end + slab)
                part = text[at:end].translate(_FOLD)
                cut = part.rfind(b" ")
            if cut >= 0 and end < len(text):
                part, end = part[:cut + 1], at + cut + 1
        yield part.split()
        at = end


def index(docs: DataFrame, wanted: np.ndarray, block_docs: int = 8192, block_postings: int = 2_000_000) -> DataFrame:
    """Inverted lists of blocks of documents, for terms whose crc32 is set in the bit filter `wanted`.

    A block has one row a term with the slots of its documents, the occurrences and the lengths of these documents, and one
    row without a term that holds doc_ids by slot (ascending, null last) and the block's totals. Rows are documents: repeated
    ones are counted and ranked as often as they come.
    """
    bits, mask = wanted.tobytes(), (1 << _FILTER_BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        held: list[tuple[int | None, int, dict]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, block
            held.sort(key=lambda d: (d[0] is None, d[0] or 0))
            lists: dict[bytes, list] = {}
            for slot, (_, n, found) in enumerate(held):
                for term, tf in found.items():
                    lists.setdefault(term, []).append((slot, tf, n))
            rows = [{"block": block, "term": t.decode("utf-8", "replace"), "slots": s, "tfs": f, "ns": n} for t, p in lists.items() for s, f, n in [zip(*p, strict=True)]]
            totals = {"docs": [d[0] for d in held], "n_docs": sum(d[1] > 0 for d in held), "n_terms": sum(d[1] for d in held)}
            held, size = [], 0
            block += 1
            return pa.RecordBatch.from_pylist([{"block": block - 1, **totals}, *rows], schema=schema)

        schema = pa.schema([("block", pa.int64()), ("term", pa.string()), ("slots", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())), ("ns", pa.list_(pa.int32())),
                            ("docs", pa.list_(pa.int64())), ("n_docs", pa.int64()), ("n_terms", pa.int64())])
        for part in slices(batches, 1, 4_000_000):
            for doc_id, text in zip(part.column(0).to_pylist(), pc.cast(part.column(1), pa.binary()), strict=True):
                n, found = 0, Counter()
                for words in words_in(text.as_py() or b""):
                    n += len(words)
                    for term, tf in Counter(words).items():
                        h = zlib.crc32(term) & mask
                        if bits[h >> 3] >> (h & 7) & 1:
                            found[term] += tf
                held.append((doc_id, n, found))
                size += len(found)
                if len(held) >= block_docs or size >= block_postings:
                    yield flush()
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, INDEX)


def term_filter(terms: DataFrame) -> np.ndarray:
    """A bit for the crc32 of every term: of fixed size, whatever the number of terms. Others that pass meet no item later."""
    places = terms.select(F.crc32(F.col("term").cast("binary")).bitwiseAND((1 << _FILTER_BITS) - 1).alias("p"))
    words = places.groupBy(F.expr("p div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("bits"))
    out = np.zeros(1 << _FILTER_BITS - 6, np.int64)
    for row in words.toLocalIterator():
        out[row.word] = row.bits
    return out


def search(items: DataFrame, docs: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best documents with a score above 0 of every item.

    items needs item_id and text, docs needs doc_id and text; other columns are ignored. A null text has no terms, and an item
    without terms, or without documents that hold one, gives no rows; neither do empty tables. Equal scores rank by ascending doc_id,
    null ids last. Repeated rows of documents rank one by one, those of items are items of their own.
    """
    rows = items.select("item_id", "text", F.monotonically_increasing_id().alias("item"))
    rows = rows.select("item_id", "item", F.explode(terms_of(F.col("text"))).alias("term"))
    n_bundles = F.greatest(F.lit(1), F.ceil(F.lit(items.count()) / ITEMS_IN_BUNDLE))
    bundle = F.pmod(F.xxhash64("item"), n_bundles).alias("bundle")
    wants = written(rows.groupBy("item", "item_id", "term").agg(F.count("*").cast("int").alias("times")).select("*", bundle), "lexical-items")
    lists = written(index(docs, term_filter(wants)), "lexical-index")
    n_docs, n_terms = lists.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = n_docs or 0, n_terms or 1

    df = lists.where("term is not null").groupBy("term").agg(F.sum(F.size("slots")).alias("df"))
    asked = wants.groupBy("term", "bundle").agg(F.sort_array(F.collect_list(F.struct("item", "times"))).alias("by"))
    owner = sum((F.when(F.col("df") * share > n_docs, 1).otherwise(0) for share in OWNERS), F.lit(0))
    weight = F.floor(1000 * F.log((F.lit(2.0 * n_docs + 2)) / (2 * F.col("df") + 1)))
    terms = written(asked.join(df, "term").select("term", "bundle", "by.item", "by.times", weight.cast("long").alias("w"), owner.alias("owner")), "lexical-terms")
    postings = lists.where("term is not null").select("block", "term", "slots", "tfs", "ns").join(terms, "term").drop("term")

    def visit(select: bool):
        def stage(carried: pa.Table, met: pa.Table) -> pa.Table:
            key = carried if carried.num_rows else met
            bundle, block = key.column("bundle")[0].as_py(), key.column("block")[0].as_py()
            flat = lambda c: (c.flatten().to_numpy(), np.cumsum([0, *pc.list_value_length(c).to_pylist()]))
            joined = {c: flat(met.column(c).combine_chunks()) for c in ("slots", "tfs", "ns", "item", "times")}
            kept = {c: flat(carried.column(c).combine_chunks()) for c in ("slots", "scores")}
            names, place = np.unique(np.concatenate([carried.column("item").to_numpy(), joined["item"][0]]), return_inverse=True)
            width = 1 + int(max(joined["slots"][0].max(initial=-1), kept["slots"][0].max(initial=-1)))
            total = np.zeros((len(names), width), np.int64)
            slots, ends = kept["slots"]
            for i in range(carried.num_rows):
                total[place[i], slots[ends[i]:ends[i + 1]]] += kept["scores"][0][ends[i]:ends[i + 1]]
            place = place[carried.num_rows:]
            slots, ends = joined["slots"]
            tf, m = joined["tfs"][0].astype(np.int64), 75 + 25 * joined["ns"][0].astype(np.int64) * n_docs // n_terms
            part = 1_000_000_000 * tf // (1000 * tf + 12 * m)
            times, own = joined["times"][0], joined["item"][1]
            for i, w in enumerate(met.column("w").to_pylist()):
                span = slice(ends[i], ends[i + 1])
                for j in range(own[i], own[i + 1]):
                    total[place[j], slots[span]] += w * int(times[j]) * part[span]
            found = [np.flatnonzero(row) for row in total]
            if select:  # slots ascend with doc_id
                found = [f[np.argsort(-row[f], kind="stable")[:k]] for f, row in zip(found, total, strict=True)]
            some = [i for i, f in enumerate(found) if len(f)]
            return pa.table({
                "bundle": pa.array([bundle] * len(some), pa.int64()), "block": pa.array([block] * len(some), pa.int64()), "item": pa.array(names[some], pa.int64()),
                "slots": pa.array([found[i].astype(np.int32) for i in some], pa.list_(pa.int32())),
                "scores": pa.array([total[i, found[i]] for i in some], pa.list_(pa.int64()))})
        return stage

    schema = "bundle long, block long, item long, slots array<int>, scores array<long>"
    carried = postings.sparkSession.createDataFrame([], schema)
    for number in range(len(OWNERS) + 1):
        met = postings.where(F.col("owner") == number).drop("owner")
        stage = visit(select=number == len(OWNERS))
        carried = written(carried.groupBy("bundle", "block").cogroup(met.groupBy("bundle", "block")).applyInArrow(stage, schema), "lexical-accumulators")
    best = carried.select("block", "item", F.inline(F.arrays_zip("slots", "scores")))
    names = lists.where("term is null").select("block", "docs")
    best = best.join(names, "block").select("item", F.element_at("docs", F.col("slots") + 1).alias("doc_id"), F.col("scores").alias("score"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(wants.select("item", "item_id").distinct(), "item").select("item_id", "rank", "doc_id", "score")


#: The same ranking in one DuckDB statement.
SQL = f"""
WITH item_terms AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS term FROM benchmark)
  GROUP BY ALL),
doc_terms AS (
  SELECT doc_id, term, count(*) AS tf FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS term FROM documents)
  GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM doc_terms GROUP BY doc_id),
totals AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nt FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM doc_terms, totals GROUP BY term, nd),
scores AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * nd) // nt))))::BIGINT AS score
  FROM item_terms JOIN doc_terms USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), totals
  GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20"""
