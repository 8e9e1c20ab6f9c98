"""Ordered operators over long sequences without putting one sequence into one task.

A sequence may hold a third of all rows, so no window here is partitioned by the sequence alone.
Rows are grouped by (sequence, chunk of the order column); what crosses a chunk border travels in a
table with one row per chunk, which is smaller than the data by the chunk length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoorgrid.session import cut

CHUNK_ROWS = 65536


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def chunk_of(idx, chunk: int) -> Column:
    c = F.col(idx) if isinstance(idx, str) else idx
    return F.floor(c / F.lit(int(chunk))).cast("bigint")


def with_halo(df: DataFrame, keys, idx: str, before: int, after: int = 0, chunk: int = CHUNK_ROWS) -> DataFrame:
    """Copy the `before`/`after` index steps next to each border into the neighbouring chunk.

    Adds `_chunk` and `_core` (FALSE for copies). With a dense index, windows reaching at most that many
    rows are then exact inside (keys, _chunk), and a chunk holds at most chunk + before + after rows.
    """
    if max(before, after) >= chunk:
        raise ValueError("halo must be shorter than a chunk")
    home = chunk_of(idx, chunk)
    targets = F.sequence(chunk_of(F.col(idx) - F.lit(after), chunk), chunk_of(F.col(idx) + F.lit(before), chunk))
    return (df.withColumn("_home", home).withColumn("_chunk", F.explode(targets))
              .withColumn("_core", F.col("_home") == F.col("_chunk")).drop("_home"))


def halo_window(keys, idx: str) -> Window:
    return Window.partitionBy(*_keys(keys), "_chunk").orderBy(idx)


def lagged(df: DataFrame, keys, idx: str, lags: dict[str, tuple[str, int]], chunk: int = CHUNK_ROWS) -> DataFrame:
    """Add `name -> (column, n)` lag columns on a dense index (negative n looks ahead)."""
    before = max([n for _, n in lags.values()] + [0])
    after = max([-n for _, n in lags.values()] + [0])
    w = halo_window(keys, idx)
    out = with_halo(df, keys, idx, before, after, chunk)
    out = out.withColumns({name: F.lag(c, n).over(w) if n >= 0 else F.lead(c, -n).over(w)
                           for name, (c, n) in lags.items()})
    return out.where("_core").drop("_core", "_chunk")


def running_sums(df: DataFrame, keys, order, sums: dict[str, str], chunk_col: str = "_chunk",
                 totals: dict[str, str] | None = None) -> DataFrame:
    """Inclusive running sums in `order`; `chunk_col` must be non-decreasing along the order.

    `sums` maps output name to input column; `totals` adds the whole-key total of an input column.
    """
    keys = _keys(keys)
    order = order if isinstance(order, list) else [order]
    per_chunk = df.groupBy(*keys, chunk_col).agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()],
                                                 *[F.sum(c).alias(f"_t_{n}") for n, c in (totals or {}).items()])
    over_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = over_key.orderBy(chunk_col).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_chunk.select(
        *keys, chunk_col,
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(over_key).alias(n) for n in (totals or {})])
    inside = Window.partitionBy(*keys, chunk_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(offsets, [*keys, chunk_col], "left")
    out = out.withColumns({n: F.sum(c).over(inside) + F.col(f"_o_{n}") for n, c in sums.items()})
    return out.drop(*[f"_o_{n}" for n in sums])


def dense_ordinal(df: DataFrame, keys, order, bucket: Column, name: str = "ordinal") -> DataFrame:
    """Exact zero-based row number per key. `bucket` must be non-decreasing along `order` (e.g. the hour)."""
    out = df.withColumn("_chunk", bucket).withColumn("_one", F.lit(1).cast("bigint"))
    out = running_sums(out, keys, order, {name: "_one"})
    return out.withColumn(name, F.col(name) - 1).drop("_chunk", "_one")


def in_order(df: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """Range partitions of the whole table in `order`, numbered by `_chunk` and written to reliable storage.

    Rows are dealt out by their whole sort key, at last by a hash of the row, so equal values are spread as well. The number of
    partitions is Spark's own for a shuffle, or `parts`. The partitions are written because their borders come from a sample: two uses
    of one result must see the same.
    """
    order = [*order, F.xxhash64(*df.columns).asc()]
    dealt = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    return cut(dealt.withColumn("_chunk", F.spark_partition_id().cast("bigint")))


def ordered_running(df: DataFrame, keys, value: str, sums: dict[str, str], descending: bool = False,
                    ties: list | None = None, parts: int | None = None,
                    totals: dict[str, str] | None = None) -> DataFrame:
    """Running sums in the order of a numeric value (then `ties`) per key, whatever the size of a key or of a value."""
    first = F.col(value).desc() if descending else F.col(value).asc()
    order = [first, *(ties or [])]
    out = in_order(df, [*[F.col(k).asc() for k in _keys(keys)], *order], parts)
    return running_sums(out, keys, [*order, F.xxhash64(*df.columns).asc()], sums, totals=totals).drop("_chunk")


def ranked(df: DataFrame, keys, value: str, ties: list, descending: bool = True, parts: int | None = None,
           name: str = "rank", total: str | None = None) -> DataFrame:
    """One-based exact rank of every row by value; `total` adds the row count of the key."""
    out = df.withColumn("_one", F.lit(1).cast("bigint"))
    out = ordered_running(out, keys, value, {name: "_one"}, descending, ties, parts,
                          totals={total: "_one"} if total else None)
    return out.drop("_one")


def top_n(df: DataFrame, keys, order: list, n: int, name: str = "rank") -> DataFrame:
    """First n rows per key. Written as a row-number filter, so Spark trims every map task to n per key."""
    w = Window.partitionBy(*_keys(keys)).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def run_starts(df: DataFrame, keys, idx: str, value: str | None = None, max_gap: int = 0,
               chunk: int = CHUNK_ROWS, name: str = "run_start") -> DataFrame:
    """Add the index at which the run containing each row began.

    A run breaks where the index jumps by more than max_gap + 1 or, with `value`, where it changes
    (null-safe). Grouping by (keys, name) then gives islands with any aggregate, partially combined.
    """
    keys = _keys(keys)
    value_col = F.col(value) if value else F.lit(0)
    out = df.withColumn("_chunk", chunk_of(idx, chunk)).withColumn("_v", value_col)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(idx)
    prev_idx, prev_v = F.lag(idx).over(inside), F.lag("_v").over(inside)
    broken = prev_idx.isNull() | (F.col(idx) - prev_idx > max_gap + 1) | ~prev_v.eqNullSafe(F.col("_v"))
    out = (out.withColumn("_b", F.when(broken, F.col(idx)))
              .withColumn("_local", F.max("_b").over(inside.rowsBetween(Window.unboundedPreceding, 0))))
    borders = out.groupBy(*keys, "_chunk").agg(
        F.min(idx).alias("_first"), F.max(idx).alias("_last"), F.max("_local").alias("_last_start"),
        F.min_by("_v", idx).alias("_first_v"), F.max_by("_v", idx).alias("_last_v"))
    by_chunk = Window.partitionBy(*keys).orderBy("_chunk")
    joined = ((F.col("_first") - F.lag("_last").over(by_chunk) <= max_gap + 1)
              & F.lag("_last_v").over(by_chunk).eqNullSafe(F.col("_first_v")))
    borders = borders.withColumn("_joined", F.coalesce(joined, F.lit(False)))
    own = F.when(~((F.col("_last_start") == F.col("_first")) & F.col("_joined")), F.col("_last_start"))
    borders = borders.withColumn("_global", F.max(own).over(by_chunk.rowsBetween(Window.unboundedPreceding, 0)))
    borders = borders.select(*keys, "_chunk", "_first",
                             F.when(F.col("_joined"), F.lag("_global").over(by_chunk))
                              .otherwise(F.col("_first")).alias("_carry"))
    out = out.join(borders, [*keys, "_chunk"], "left")
    start = F.when(F.col("_local") == F.col("_first"), F.col("_carry")).otherwise(F.col("_local"))
    return out.withColumn(name, start).drop("_chunk", "_v", "_b", "_local", "_first", "_carry")


def events_around(probes: DataFrame, events: DataFrame, keys, probe_at: str, event_at: str, gap: int, before: str,
                  after: str, chunk: int = CHUNK_ROWS) -> DataFrame:
    """Two-sided as-of join on integers: the nearest event at least `gap` before and after each probe.

    Events and probes are merged by position and read once in both directions, chunk by chunk; what lies in
    other chunks comes from one row per chunk. Probe rows must be distinct; columns `before` and `after` are
    NULL where there is no event.
    """
    keys = _keys(keys)
    names = probes.columns
    side = F.explode(F.array(F.lit(1), F.lit(2)))
    p = probes.withColumn("_kind", side).withColumn(
        "_at", F.when(F.col("_kind") == 1, F.col(probe_at) - gap).otherwise(F.col(probe_at) + gap))
    e = events.select(*keys, F.col(event_at).alias("_at"), F.col(event_at).alias("_ev"), F.lit(0).alias("_kind"))
    both = p.unionByName(e, allowMissingColumns=True).withColumn("_chunk", chunk_of("_at", chunk))
    tops = both.groupBy(*keys, "_chunk").agg(F.max("_ev").alias("_mx"), F.min("_ev").alias("_mn"))
    # looking back is running sums in ascending order, looking ahead the same in descending order:
    # frames open to the following side would be evaluated anew for every row
    line = Window.partitionBy(*keys)
    past, so_far = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, 0)
    tops = tops.select(*keys, "_chunk", F.max("_mx").over(line.orderBy("_chunk").rowsBetween(*past)).alias("_cp"),
                       F.min("_mn").over(line.orderBy(F.desc("_chunk")).rowsBetween(*past)).alias("_cn"))
    inside = Window.partitionBy(*keys, "_chunk")
    both = both.join(tops, [*keys, "_chunk"], "left").withColumns({
        "_p": F.greatest(F.max("_ev").over(inside.orderBy("_at").rangeBetween(*so_far)), F.col("_cp")),
        "_n": F.least(F.min("_ev").over(inside.orderBy(F.desc("_at")).rangeBetween(*so_far)), F.col("_cn"))})
    hits = both.where(F.col("_kind") > 0)
    return hits.groupBy(*names).agg(F.max(F.when(F.col("_kind") == 1, F.col("_p"))).alias(before),
                                    F.max(F.when(F.col("_kind") == 2, F.col("_n"))).alias(after))
