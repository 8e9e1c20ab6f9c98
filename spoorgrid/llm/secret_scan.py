"""Secret spans by patterns and by sliding-window entropy, in DataFrame functions only.

Patterns give assigned, access-key and hexadecimal spans. Candidate strings are then scored by the Shannon entropy of
every window of `window` characters: the counts of a window come from those of the one before by one addition and one
removal, and so does the sum of c * log2(c). A candidate is judged by the threshold of its character class and dropped
if an allow-list pattern covers it. All work on a text is a projection of its own row: there is no shuffle. Positions,
overlaps and masks come from running sums and extremes over blocks of matches, so the work is linear in a text and in its
matches, but for one sort of its spans.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Maximal runs: what is shorter than the least length can't match from a later start either.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: (name, pattern of the whole candidate, bits a character that its best window needs), the first that fits decides.
CLASSES = (("digits", r"[0-9_=-]+", math.inf), ("hex", r"[0-9a-fA-F]+", 3.0), ("letters", r"[A-Za-z_=/-]+", 4.1), ("mixed", r".*", 3.7))
#: Not secrets: repeats of a short unit, paths of words, UUIDs and example strings. Loops over groups are possessive, so
#: that Java matches them without recursion.
ALLOW = (r"(.{1,4}?)\1{4,}", r"(?:[A-Za-z]{2,15}[/_=-]++)++[A-Za-z]{2,15}", r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", r"(?i).*(?:example|placeholder|changeme|xxxx).*")


SPANS = "array<struct<s:int,e:int,k:int,v:string>>"
#: Matches of a block, and code points of a piece that masking cuts a text into.
BLOCK, PIECE = 64, 1024


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, op: Callable[[Column, Column], Column], zero: int, levels: int = 2) -> Column:
    """Running results of an associative operation over array<int>, the element itself included.

    Each step of an aggregate copies what it has gathered, so elements are gathered in blocks, and the totals of blocks in
    blocks again: a block's own results are then moved on by the total of the blocks before it.
    """
    none = F.array().cast("array<int>")

    def gathered(part: Column) -> Column:
        start = F.struct(F.lit(zero).alias("at"), none.alias("out"))
        step = lambda state, x: F.struct(op(state["at"], x).alias("at"), F.concat(state["out"], F.array(op(state["at"], x))).alias("out"))
        return F.aggregate(part, start, step, lambda state: state["out"])

    if not levels:
        return gathered(values)

    def moved(parts: Column) -> Column:
        totals = running(F.transform(parts, lambda p: F.element_at(p, -1)), op, zero, levels - 1)
        before = F.slice(F.concat(F.array(F.lit(zero)), totals), F.lit(1), F.size(parts))
        return F.flatten(F.zip_with(parts, before, lambda p, o: F.transform(p, lambda x: op(o, x))))

    def blocks(array: Column) -> Column:
        last = ((F.size(array) - 1) / BLOCK).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last), lambda i: gathered(F.slice(array, i * BLOCK + 1, F.lit(BLOCK))))
        return F.when(F.size(array) > 0, _let(parts, moved)).otherwise(none)

    return _let(values, blocks)


def _spans(text: Column, pattern: str, kind: str, hint: Column | None = None) -> Column:
    """array<struct<s, e, k, v>> of the leftmost non-overlapping matches; positions count code points.

    The texts between matches (split) and the matches (regexp_extract_all) have lengths; their running sums are the
    positions, so no text is searched again. Kept in one row: a text needs memory for its own pieces only.
    """

    def placed(found: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        ends = running(F.zip_with(between, found, lambda gap, hit: F.length(gap) + F.length(hit)), lambda x, y: x + y, 0)
        return F.zip_with(ends, found, lambda e, hit: F.struct((e - F.length(hit)).alias("s"), e.alias("e"), F.lit(KINDS.index(kind)).alias("k"), hit.alias("v")))

    spans = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    return F.when(hint if hint is not None else F.rlike(text, F.lit(pattern)), spans).otherwise(F.array().cast(SPANS))


def _clear_of(found: Column, base: Column) -> Column:
    """The found spans that overlap no base span: in order of their starts, no base span up to them reaches beyond their
    start, and none after them starts before their end."""
    marked = lambda spans, own: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(own).alias("own"), x["k"].alias("k"), x["v"].alias("v")))

    def merged(spans: Column) -> Column:
        reach = running(F.transform(spans, lambda x: F.when(x["own"], F.lit(-1)).otherwise(x["e"])), F.greatest, -1)
        ahead = F.reverse(running(F.reverse(F.transform(spans, lambda x: F.when(x["own"], F.lit(2**31 - 1)).otherwise(x["s"]))), F.least, 2**31 - 1))
        free = F.zip_with(spans, F.zip_with(reach, ahead, lambda p, n: F.struct(p.alias("p"), n.alias("n"))), lambda x, y: F.struct(
            x.alias("x"), (x["own"] & (y["p"] <= x["s"]) & (y["n"] >= x["e"])).alias("free")))
        return F.transform(F.filter(free, lambda z: z["free"]), lambda z: F.struct(z["x"]["s"].alias("s"), z["x"]["e"].alias("e"), z["x"]["k"].alias("k"), z["x"]["v"].alias("v")))

    both = _let(F.array_sort(F.concat(marked(base, False), marked(found, True))), merged)
    return F.when((F.size(base) > 0) & (F.size(found) > 0), both).otherwise(found)


def best_window(value: Column, window: int) -> Column:
    """The largest entropy (bits a character) of any window of the string, all of it if it is shorter."""
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    log = lambda c: F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))
    # the codes and the width ride in the state, so that they are computed once
    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"),
                     codes.alias("codes"), F.least(F.lit(window), F.length(value)).alias("width"))

    def put(counts: Column, code: Column, by: int) -> Column:
        return F.transform(counts, lambda c, i: F.when(i == code, c + by).otherwise(c))

    def step(state: Column, i: Column) -> Column:
        counts, width = state["counts"], state["width"]
        new, old, full = F.get(state["codes"], i - 1), F.get(state["codes"], i - width - 1), i > width
        c = F.get(counts, old)
        rest = state["sum"] + F.when(full, log(c - 1) - log(c)).otherwise(F.lit(0.0))
        less = F.when(full, put(counts, old, -1)).otherwise(counts)
        d = F.get(counts, new) - F.when(full & (old == new), 1).otherwise(0)
        total = rest + log(d + 1) - log(d)
        entropy = F.log2(width) - total / width
        return F.struct(put(less, new, 1).alias("counts"), total.alias("sum"),
                        F.when((i >= width) & (entropy > state["best"]), entropy).otherwise(state["best"]).alias("best"),
                        state["codes"].alias("codes"), width.alias("width"))

    return F.aggregate(F.sequence(F.lit(1), F.length(value)), start, step, lambda state: state["best"])


def scan(docs: DataFrame, window: int = 20) -> DataFrame:
    """docs with `secret_spans`, sorted by start and kind: array<struct<s, e, k, v>>.

    docs needs a text column (null: empty). Other columns are kept; one named secret_spans is replaced. Repeated rows
    and any number of matches are kept. Spans of different kinds may overlap; an entropy span that overlaps a pattern
    span of the same text is not added.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    assign = _spans(text, ASSIGN, "assign")
    # what follows the separator has at least 8 characters
    value = lambda v: F.regexp_extract(v, ASSIGN, 1)
    base = F.concat(F.filter(assign, lambda x: F.length(value(x["v"])) >= 8), _spans(text, ACCESS, "access"), _spans(text, HEX, "hex"))
    out = docs.withColumn("_secret_base", base)
    out = out.withColumn("_secret_found", _spans(text, CANDIDATE, "entropy"))
    out = out.withColumn("_secret_found", _clear_of(F.col("_secret_found"), F.col("_secret_base")))

    def keep(x: Column) -> Column:
        allowed = F.lit(False)
        for p in ALLOW:
            allowed = allowed | x["v"].rlike(f"^(?:{p})$" if not p.startswith("(?i)") else f"(?i)^(?:{p[4:]})$")
        need = F.lit(math.inf)
        for _, pattern, bits in reversed(CLASSES):
            need = F.when(x["v"].rlike(f"^{pattern}$"), F.lit(bits)).otherwise(need)
        return F.when(allowed, F.lit(False)).otherwise(best_window(x["v"], window) >= need)

    spans = F.array_sort(F.concat("_secret_base", F.filter("_secret_found", keep)))
    return out.withColumn("secret_spans", spans).drop("_secret_base", "_secret_found")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"], x["e"])), ",")


def report(docs: DataFrame, window: int = 20) -> DataFrame:
    """Counts and digests of the spans of each document; null ids and repeated rows stay as they are."""
    rows = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), window)
    base = F.filter("secret_spans", lambda x: x["k"] < 3)
    count = lambda k: F.size(F.filter("secret_spans", lambda x: x["k"] == k)).cast("long")
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                       F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secret_spans")).alias("spans"),
                       count(3).alias("n_entropy"))


def masked(docs: DataFrame, mask: str = "[SECRET]", window: int = 20) -> DataFrame:
    """docs with every span of its texts replaced by the mask; overlapping spans become one. Null texts stay null."""
    rows = scan(docs, window)
    spans, at = F.col("secret_spans"), F.lit(0)

    def cut(pieces: Column, start: Column, end: Column) -> Column:
        first, last = (start / PIECE).cast("int"), ((end - 1) / PIECE).cast("int")
        whole = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
        return F.when(end > start, F.substr(whole, start - first * PIECE + 1, end - start)).otherwise(F.lit(""))

    def joined(pieces: Column) -> Column:
        def covered(reach: Column) -> Column:
            # spans are sorted by start: one that begins inside the reach of those before it is part of the same stretch
            before = F.slice(F.concat(F.array(at), reach), F.lit(1), F.size(reach))
            firsts = F.filter(F.zip_with(spans, before, lambda x, r: F.struct(r.alias("r"), x["s"].alias("s"))), lambda z: z["s"] >= z["r"])
            kept = F.transform(firsts, lambda z: F.concat(cut(pieces, z["r"], z["s"]), F.lit(mask)))
            return F.concat(F.array_join(kept, ""), cut(pieces, F.element_at(reach, -1), F.length("text")))

        return _let(running(F.transform(spans, lambda x: x["e"]), F.greatest, 0), covered)

    text = _let(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), joined)
    return rows.withColumn("text", F.when(F.size("secret_spans") == 0, F.col("text")).otherwise(text)).drop("secret_spans")
