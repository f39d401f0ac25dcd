"""Minimum-cost-flow resharding.

Documents lie in old shards. From the old shards' bytes and the new shards' capacities a
transportation problem is solved: a byte that stays costs nothing, a byte that moves to another
shard costs one, so the flow moves the fewest bytes. In each old shard groups of equal texts are
ordered (long texts first); the flow cuts this order into blocks, one for each new shard. A block
begins at a group's key, so a row finds its shard from its own columns and the few cuts; then the
files of shards that change are rewritten.

Null texts count no bytes of text; every document has one byte more than its text. Equal texts lie
together (null with empty), whatever their doc_ids (null and repeated ones too), so a shard may miss its size by one
group. A group that no shard has room for is cut by the hash of the doc_id; rows of one doc_id and text then
still lie together. A very long document is never cut. Only doc_id and text are read, whatever
other columns are named. Empty input gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ranked, scratch_path

KEY = ("old_shard", "_order", "_hash", "_sub")
#: Parts of a group that is larger than the smallest shard, in shares of that shard.
PARTS = 16


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> list[list[int]]:
    """The cheapest shipment from sources to sinks (equal totals), by successive shortest paths."""
    if sum(supply) != sum(demand):
        raise ValueError("supply and demand differ")
    n, m = len(supply), len(demand)
    flow = [[0] * m for _ in range(n)]
    left, need = list(supply), list(demand)
    while any(left):
        # Bellman-Ford over sources 0..n-1 and sinks n..n+m-1, from all sources with supply left
        best = [0 if k < n and left[k] else None for k in range(n + m)]
        via: list[int | None] = [None] * (n + m)
        for _ in range(n + m):
            changed = False
            for i in range(n):
                for j in range(m):
                    if best[i] is not None and (best[n + j] is None or best[i] + cost[i][j] < best[n + j]):
                        best[n + j], via[n + j], changed = best[i] + cost[i][j], i, True
                    if flow[i][j] and best[n + j] is not None and (best[i] is None or best[n + j] - cost[i][j] < best[i]):
                        best[i], via[i], changed = best[n + j] - cost[i][j], n + j, True
            if not changed:
                break
        end = min((j for j in range(m) if need[j] and best[n + j] is not None), key=lambda j: best[n + j])
        path = [n + end]
        while via[path[-1]] is not None:
            path.append(via[path[-1]])
        path.reverse()
        amount = min(left[path[0]], need[end])
        for a, b in zip(path, path[1:], strict=False):
            if a >= n:  # back along a shipment
                amount = min(amount, flow[b][a - n])
        for a, b in zip(path, path[1:], strict=False):
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[path[0]] -= amount
        need[end] -= amount
    return flow


@dataclass
class Transfers:
    """``flow[i][j]`` bytes go from old shard i to new shard j; ``cuts[i]``: (first key, new shard).

    ``huge``: (order, hash) of groups of equal texts that no shard can hold, and into how many parts each is cut.
    """

    flow: list[list[int]]
    cuts: dict[int, list[tuple[tuple, int]]]
    new_shards: int
    huge: dict[tuple[int, int], int]

    def moved(self) -> int:
        return sum(x for i, row in enumerate(self.flow) for j, x in enumerate(row) if i != j)

    def affected(self) -> set[int]:
        """Shards whose files change: all that send or receive a block."""
        return {k for i, row in enumerate(self.flow) for j, x in enumerate(row) if x and i != j for k in (i, j)}


def sized(docs: DataFrame, old_shards: int) -> DataFrame:
    """Adds size, old_shard and the order's helper columns to ``doc_id, text``."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    hashed = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.withColumns({"size": size, "old_shard": F.pmod(hashed, F.lit(old_shards)).cast("int"), "_order": -size, "_hash": hashed})


def plan_transfers(docs: DataFrame, old_shards: int, capacities: list[float]) -> Transfers:
    """``docs`` holds doc_id, size, old_shard and order columns; ``capacities`` are relative sizes.

    Equal texts are one group, which goes where its middle byte falls. Only a group of more bytes than
    the smallest shard has room for is cut, by the hash of the doc_id.
    """
    groups = docs.groupBy("old_shard", "_order", "_hash").agg(F.sum("size").alias("size"))
    total, whole = docs.agg(F.sum("size")).first()[0] or 0, sum(capacities)
    room = max(1, int(total * min(capacities) / whole))
    # at most total / room rows
    found = groups.where(F.col("size") > room).select("_order", "_hash", "size").collect()
    huge = {(r["_order"], r["_hash"]): -(-r["size"] * PARTS // room) for r in found}
    cut = docs.select("size", "old_shard", "_order", "_hash", sub_of(huge).alias("_sub")).groupBy(*KEY).agg(F.sum("size").alias("size"))
    at = ranked(cut, KEY, {"_before": F.col("size")}, "reshard")
    # a row for each old shard
    found = {r["old_shard"]: (r["bytes"], r["first"]) for r in at.groupBy("old_shard").agg(F.sum("size").alias("bytes"), F.min("_before").alias("first")).collect()}
    sizes = [found.get(i, (0, 0))[0] for i in range(old_shards)]
    ends = [round(total * sum(capacities[: j + 1]) / whole) for j in range(len(capacities))]
    demand = [e - s for s, e in zip([0, *ends[:-1]], ends, strict=True)]
    cost = [[int(i != j) for j in range(len(demand))] for i in range(old_shards)]
    flow = min_cost_flow(sizes, demand, cost)
    # blocks in the old shard's order: what stays first; a group belongs where its middle byte falls
    blocks = []
    for i, row in enumerate(flow):
        start = found.get(i, (0, 0))[1]
        for j in sorted(range(len(row)), key=lambda j: (j != i, j)):
            if row[j]:
                blocks.append((i, j, start))
                start += row[j]
    middle = F.col("_before") + F.floor(F.col("size") / 2)
    block = F.lit(None).cast("int")
    for k, (i, _, start) in enumerate(blocks):
        block = F.when((F.col("old_shard") == i) & (middle >= start), k).otherwise(block)
    # a row for each block: at most old + new shards
    heads = at.withColumn("_block", block).groupBy("_block").agg(F.min(F.struct(*KEY)).alias("key")).collect()
    cuts: dict[int, list[tuple[tuple, int]]] = {}
    for r in sorted(heads, key=lambda r: r["_block"]):
        i, j, _ = blocks[r["_block"]]
        cuts.setdefault(i, []).append((tuple(r["key"])[1:], j))
    return Transfers(flow, cuts, len(capacities), huge)


def sub_of(huge: dict[tuple[int, int], int]) -> Column:
    """The part of its group that a row belongs to: 0 but for groups that no shard can hold."""
    sub = F.lit(0).cast("long")
    for (order, hashed), n in huge.items():
        sub = F.when((F.col("_order") == order) & F.col("_hash").eqNullSafe(F.lit(hashed)), F.pmod(F.xxhash64("doc_id"), F.lit(n))).otherwise(sub)
    return sub


def new_shard(transfers: Transfers) -> Column:
    """The shard of a row of ``sized``: the last cut of its old shard that is not above its key."""
    shard = F.lit(None).cast("int")
    key = F.struct(F.col("_order"), F.col("_hash"), sub_of(transfers.huge).alias("_sub"))
    for i, cuts in transfers.cuts.items():
        own = F.lit(cuts[0][1])
        for (order, hashed, sub), j in cuts[1:]:
            head = F.struct(F.lit(order).cast("long").alias("_order"), F.lit(hashed).cast("long").alias("_hash"), F.lit(sub).cast("long").alias("_sub"))
            own = F.when(key >= head, j).otherwise(own)
        shard = F.when(F.col("old_shard") == i, own).otherwise(shard)
    return shard.cast("int")


def rewrite(docs: DataFrame, transfers: Transfers, folder: str) -> DataFrame:
    """Write the rows of affected shards to ``folder`` by shard, other rows where they are; read all back.

    Each shard is written by several tasks, so a large shard needs no large task.
    """
    placed = docs.withColumn("shard", new_shard(transfers))
    same = [k for k in range(transfers.new_shards) if k not in transfers.affected()]
    changed = placed.where(~F.col("shard").isin(same)) if same else placed
    # rows of a shard together, large shards split at run time into tasks of the advised size
    changed.hint("rebalance", "shard").write.partitionBy("shard").parquet(folder)
    back = docs.sparkSession.read.schema(changed.schema).parquet(folder)
    return back.unionByName(placed.where(F.col("shard").isin(same))) if same else back


def reshard(docs: DataFrame, old_shards: int = 12, new_shards: int = 16) -> DataFrame:
    """``doc_id, text`` moved from ``old_shards`` to ``new_shards`` of equal bytes.

    Adds size, old_shard and shard, and _hash, the hash that orders equal texts side by side.
    """
    rows = sized(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), old_shards)
    transfers = plan_transfers(rows, old_shards, [1] * new_shards)
    if not transfers.cuts:
        return rows.withColumn("shard", F.lit(None).cast("int")).drop("_order")
    return rewrite(rows, transfers, scratch_path(docs.sparkSession, "shards")).drop("_order")


def with_slots(rows: DataFrame) -> DataFrame:
    """Adds ``slot`` to narrow rows with shard, doc_id and _hash."""
    at = ranked(rows, ("shard", "doc_id", "_hash"), {}, "slots")
    first = at.groupBy("shard").agg(F.min("_pos").alias("_first"))
    # a row for each shard
    return at.join(F.broadcast(first), "shard").withColumn("slot", F.col("_pos") - F.col("_first")).drop("_part", "_pos", "_first")
