"""Balanced label propagation: linked documents move to the shard of most of their neighbours, under quotas.

Documents with equal texts are linked. Labels start random; in each round the documents of a group vote with their
labels, and its members ask to move to the shard that holds most of them. A shard admits requests up to its quota of
rows; who is not admitted votes again among shards that still have room. Unlinked rows fill what is left, so that row
counts end at most one apart.

A group is split into hubs of at most a quarter of a shard before anything is joined on it, so one text with a third
of all rows is spread like any other. Links are never expanded into pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoorgrid.llm.common import written
from spoorgrid.session import cut

GROUP = ["_g", "text_crc32", "size"]
HUB = [*GROUP, "_hub"]


def nodes_of(docs: DataFrame, n_shards: int) -> DataFrame:
    """Slim rows: the texts are read once and leave only sizes and hashes behind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_g"))
    return out.withColumn("_row", F.monotonically_increasing_id()).withColumn(
        "_start", F.pmod(F.xxhash64("_row"), F.lit(n_shards)).cast("int"))


def propagate(cells: DataFrame, quota: int, hub_rows: int, n_shards: int, rounds: int) -> DataFrame:
    """Hubs with the shard they settled in, or null. cells: rows of each hub by starting shard, column `_n`.

    A round: votes by (group, shard), each group's shards in order of votes, hub h of a group asks for shard h div
    (hubs a shard can take); requests are admitted by shares of 1024 random buckets up to the shard's free quota.
    """
    hubs = cut(cells.groupBy(*HUB).agg(F.sum("_n").alias("_n")).withColumn("_shard", F.lit(None).cast("int")))
    per_shard = max(1, quota * 4 // (5 * max(1, hub_rows)))  # hubs differ in size, so a fifth stays free
    for turn in range(rounds):
        settled = {r[0]: r[1] for r in hubs.where("_shard is not null").groupBy("_shard").agg(F.sum("_n")).collect()}
        room = F.array(*[F.lit(quota - settled.get(s, 0)).cast("long") for s in range(n_shards)])
        held = hubs.where("_shard is not null").select(*GROUP, F.col("_shard").alias("_at"), "_n")
        free = cells.join(hubs.where("_shard is null").select(*HUB), HUB).select(*GROUP, F.col("_start").alias("_at"), "_n")
        votes = held.unionByName(free).groupBy(*GROUP, "_at").agg(F.sum("_n").alias("_votes"))
        votes = votes.where(F.get(room, F.col("_at")) > 0)
        wish = votes.groupBy(*GROUP).agg(F.sort_array(F.collect_list(F.struct(
            (-F.col("_votes")).alias("v"), F.xxhash64("_g", "_at").alias("t"), F.col("_at").alias("s")))).alias("_wish"))
        waiting = hubs.where("_shard is null").join(wish, GROUP, "left")
        place = F.floor(F.col("_hub") / per_shard).cast("int")
        other = F.pmod(F.xxhash64(*HUB, F.lit(turn)), F.lit(n_shards)).cast("int")
        asked = F.coalesce(F.get(F.transform("_wish", lambda w: w["s"]), place), other)
        asked = F.when(F.get(room, asked) >= F.col("_n"), asked).otherwise(other)
        lot = F.pmod(F.xxhash64(*HUB, F.lit(-turn - 1)), F.lit(512))  # large hubs are admitted first
        lot = F.when(F.col("_n") * 2 > hub_rows, lot).otherwise(lot + 512)
        waiting = waiting.select(*HUB, "_n", asked.alias("_to"), lot.alias("_bucket"))
        demand = waiting.groupBy("_to", "_bucket").agg(F.sum("_n").alias("_d"))  # at most 1024 rows a shard
        running = F.sum("_d").over(Window.partitionBy("_to").orderBy("_bucket"))
        admitted = demand.withColumn("_sum", running).where(F.col("_sum") <= F.get(room, F.col("_to"))).select("_to", "_bucket", F.lit(True).alias("_in"))
        moved = waiting.join(admitted, ["_to", "_bucket"], "left").select(
            *HUB, "_n", F.when(F.col("_in"), F.col("_to")).alias("_shard"))
        hubs = cut(hubs.where("_shard is not null").unionByName(moved))
        if hubs.where("_shard is null").isEmpty():
            break
    return hubs


def shard(docs: DataFrame, n_shards: int = 40, rounds: int = 6) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and `linked` for every row of docs.

    docs needs doc_id and text; other columns are ignored. The law is `rows`: counts of any two shards differ by one
    at most. A null text counts as empty: 16 bytes, crc32 0, equal to other empty texts. Repeated rows and null ids
    are rows of their own. An empty table gives no rows.
    """
    nodes = written(nodes_of(docs, n_shards), "shard-nodes")
    total = nodes.count()
    quota = total // n_shards
    hub_rows = max(1, quota // 4)
    # counts by group and lot, then by group, then back to lots: rows of a hot group meet its count in 64 lots
    nodes = nodes.withColumn("_lot", F.pmod(F.xxhash64("_row", F.lit(11)), F.lit(64)).cast("int"))
    lots = nodes.groupBy(*GROUP, "_lot").agg(F.count("*").alias("_n"))
    groups = lots.groupBy(*GROUP).agg(F.sum("_n").alias("_n")).where("_n > 1")
    groups = lots.select(*GROUP, "_lot").join(groups.select(*GROUP, F.ceil(F.col("_n") / hub_rows).alias("_hubs")), GROUP)
    split = F.when(F.col("_hubs").isNull(), -1).otherwise(F.pmod(F.xxhash64("_row", F.lit(7)), F.col("_hubs"))).cast("int")
    nodes = written(nodes.join(groups, [*GROUP, "_lot"], "left").withColumn("_hub", split).drop("_hubs", "_lot"), "shard-hubs")
    cells = cut(nodes.where("_hub >= 0").groupBy(*HUB, "_start").agg(F.count("*").alias("_n")))
    hubs = propagate(cells, quota, hub_rows, n_shards, rounds)

    placed = nodes.join(hubs.select(*HUB, "_shard"), HUB, "left")
    buckets = max(16, -(-total // (n_shards * 50_000)))
    cls = F.when(F.col("_shard").isNotNull(), 0).when(F.col("_hub") >= 0, 1).otherwise(2)
    placed = placed.select("doc_id", "size", "text_crc32", (F.col("_hub") >= 0).alias("linked"), "_row", cls.alias("_class"),
                           F.coalesce("_shard", "_start").alias("_at"), F.pmod(F.xxhash64("_row", F.lit(3)), F.lit(buckets)).alias("_b"))
    placed = written(placed, "shard-placed")
    key = ["_at", "_class", "_b"]
    sizes = placed.groupBy(*key).count()
    before = F.sum("count").over(Window.partitionBy("_at").orderBy("_class", "_b").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("_before", F.coalesce(before, F.lit(0)))
    have = {r[0]: r[1] for r in sizes.groupBy("_at").agg(F.sum("count")).collect()}

    # bounded by the number of shards: how many rows each may keep, and where rows above that go
    now = [have.get(s, 0) for s in range(n_shards)]
    large = set(sorted(range(n_shards), key=lambda s: (-now[s], s))[: total % n_shards])
    want = [quota + (s in large) for s in range(n_shards)]
    over, vacant, excess, room = [], [], 0, 0
    for s in range(n_shards):
        over.append(excess)
        excess += max(0, now[s] - want[s])
        if now[s] < want[s]:
            vacant.append((room, room + want[s] - now[s], s, now[s]))
            room += want[s] - now[s]
    vacant = vacant or [(0, 0, 0, 0)]
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("_row")) - 1
    ranked = placed.withColumn("_rank", rank).join(sizes.select(*key, "_before"), key)
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before"))
    table = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    index = F.get(table(over), F.col("_at")) + F.col("_rank") - F.get(table(want), F.col("_at"))
    gaps = F.array(*[F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip("abst", g, strict=True)]) for g in vacant])
    gap = F.get(F.filter(gaps, lambda g: (F.col("_index") >= g["a"]) & (F.col("_index") < g["b"])), F.lit(0))
    moved = F.col("_index") >= F.get(table(over), F.col("_at"))
    out = ranked.withColumn("_index", index).withColumn("_gap", gap)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.when(moved, F.col("_gap.s")).otherwise(F.col("_at")).cast("int").alias("shard"),
        F.when(moved, F.col("_gap.t") + F.col("_index") - F.col("_gap.a")).otherwise(F.col("_rank")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "linked")
