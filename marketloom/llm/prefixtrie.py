"""Prefix trie of conversations in node tables addressed by minimal perfect hashes.

A node is a distinct sequence of first turns; its digest is 128 bits, the XOR of a hash of each turn's
content and depth, so that prefixes of one very long conversation can be summed in parts. The root
has no turns.

1. Turns become content digests (SHA-256) and byte lengths; from here on no text moves. They get their
   places by a range partition and prefix counts.
2. Rows (conversation, depth) are range partitioned; each task cuts its rows into shards of whole
   conversations, or of bands of ``BAND`` turns of longer ones. In a shard the distinct digests get
   slots of a minimal perfect hash. Each slot keeps its digest, which verifies every look-up, and
   counts are scattered into flat arrays by slot. What leaves the task is a row for each node of the
   shard, however many conversations share it.
3. Nodes of all shards are summed by digest; two contents or parents under one digest raise an error.
   By induction over depth equal digests then mean equal sequences.
4. What a node adds to its ancestors is put into the one shard that holds its smallest member, whose
   path has all of them. There it goes up through the array of parent slots in order of depth, and
   the shards' sums are added by digest. What deeper bands of a conversation hold goes into the last
   turn of each earlier band.

Null roles and texts are empty. Rows without a conv_id are no conversation and left out. Turns are
ordered by turn (null first), ties by content digest; repeated rows are turns of their own. A very long text is hashed
by one task; a very long conversation is split over tasks. Other columns, whatever their names, are
not read. Empty input gives no rows, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .oddsketch import _mix
from .shared import Scratch, ranked

#: Turns of a conversation that stay in one shard, and rows of a shard.
BAND, SHARD_ROWS = 4096, 1 << 17
#: Conversation ids joined in one string.
CHUNK = 1024


class SlotTable:
    """Slots 0 .. n - 1 of n distinct 128-bit digests (rows of two u64): a minimal perfect hash.

    Level by level each key left is hashed to one of twice as many spots; keys that have a spot for
    themselves take the next slots in order of spots, the others go on to the next level.
    """

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        slots, left, base = np.empty(n, np.int64), np.arange(n), 0
        while len(left):
            spots = self._spots(keys[left], len(self.levels), max(8, 2 * len(left)))
            taken = np.bincount(spots, minlength=max(8, 2 * len(left))) == 1
            rank = np.cumsum(taken) - taken + base
            self.levels.append((taken, rank))
            alone = taken[spots]
            slots[left[alone]] = rank[spots[alone]]
            base, left = base + int(alone.sum()), left[~alone]
        self.digests = np.zeros((n, 2), np.uint64)
        self.digests[slots] = keys

    @staticmethod
    def _spots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        h = _mix(_mix(keys[:, 0] + np.uint64(2 * level + 1)) + keys[:, 1])
        return (h % np.uint64(size)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for a key that is none of the table's."""
        out, left = np.full(len(keys), -1), np.arange(len(keys))
        for level, (taken, rank) in enumerate(self.levels):
            spots = self._spots(keys[left], level, len(taken))
            hit = taken[spots]
            out[left[hit]] = rank[spots[hit]]
            left = left[~hit]
        if len(self.digests):
            out[(self.digests[out] != keys).any(axis=1)] = -1
        return out


def rise(parent: np.ndarray, depth: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (a column for each) over subtrees; ``parent`` slots, -1 for none."""
    total, order = values.copy(), np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, cuts):
        level = level[parent[level] >= 0]
        np.add.at(total, parent[level], total[level])
    return total


def _lanes(batch: pa.Table | pa.RecordBatch, *names: str) -> np.ndarray:
    return np.stack([batch.column(n).to_numpy().view(np.uint64) for n in names], axis=1)


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` to conv_id, pos (from 0), c1, c2 (content digest), n_bytes and n_own (turns of the conversation)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    content = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", content.alias("_h"), F.octet_length(text).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("_row")
    )
    lane = lambda k: F.conv(F.substring("_h", k, 16), 16, -10).cast("long")
    rows = rows.select("conv_id", "turn", lane(1).alias("c1"), lane(17).alias("c2"), "n_bytes", "_row")
    # the row number splits repeated rows between tasks
    placed = ranked(rows, ["conv_id", "turn", "c1", "c2", "_row"], {}, "turns")
    starts = placed.groupBy(F.col("conv_id").alias("_c")).agg(F.min("_pos").alias("_start"), F.count("*").alias("n_own"))
    placed = placed.join(starts, F.col("conv_id") == F.col("_c"))
    return placed.select("conv_id", (F.col("_pos") - F.col("_start")).alias("pos"), "c1", "c2", "n_bytes", "n_own")


def with_heads(turns: DataFrame, base: Column, head: Column, longest: int) -> DataFrame:
    """Conversations whose first ``head`` turns are those of conversation ``base``, as rows of ``trie_nodes``.

    ``base`` and ``head`` are expressions of conv_id, ``head`` at most ``longest``. All of the base's
    turns are taken if there are fewer, none if it does not exist; the conversation's own turns
    follow from ``head`` on, if any.
    """
    convs = turns.where("pos = 0").select("conv_id", "n_own", base.cast("long").alias("_base"), head.cast("long").alias("_head"))
    bases = turns.where("pos = 0").select(F.col("conv_id").alias("_b"), F.col("n_own").alias("_n"))
    convs = convs.join(bases, F.col("_base") == F.col("_b"), "left")
    shared = F.least(F.col("_head"), F.coalesce("_n", F.lit(0)))
    length = (shared + F.greatest(F.lit(0), F.col("n_own") - F.col("_head"))).cast("long")
    convs = convs.select(F.col("conv_id").alias("_c"), "_base", "_head", shared.alias("_shared"), length.alias("n_turns"))
    own = turns.join(convs, (F.col("conv_id") == F.col("_c")) & (F.col("pos") >= F.col("_head")))
    own = own.select("conv_id", (F.col("pos") - F.col("_head") + F.col("_shared") + 1).alias("depth"), "c1", "c2", "n_bytes", "n_turns")
    heads = turns.where(F.col("pos") < longest).select(F.col("conv_id").alias("_b"), "pos", "c1", "c2", "n_bytes")
    heads = heads.join(convs, (F.col("_b") == F.col("_base")) & (F.col("pos") < F.col("_head")))
    heads = heads.select(F.col("_c").alias("conv_id"), (F.col("pos") + 1).alias("depth"), "c1", "c2", "n_bytes", "n_turns")
    zero = F.lit(0).cast("long")
    roots = convs.select(F.col("_c").alias("conv_id"), zero.alias("depth"), zero.alias("c1"), zero.alias("c2"), zero.alias("n_bytes"), "n_turns")
    return own.unionByName(heads).unionByName(roots)


#: kind: a node of a shard ("node"), the end of a conversation ("end"), the last row of a band that goes on ("band").
PARTS = "kind string, shard long, conv_id long, depth long, d1 long, d2 long, p1 long, p2 long, c1 long, c2 long, n_bytes long, n long"


def _own_nodes(rows: pa.Table, digests: np.ndarray, parents: np.ndarray, shard: int, size: int) -> pa.Table:
    """The rows of ``PARTS`` of one shard; ``rows`` in order of conversation and depth."""
    table = SlotTable(np.unique(digests.copy().view("V16")).view(np.uint64).reshape(-1, 2))
    slot, n = table.find(digests), len(table.digests)
    first = np.empty(n, np.int64)
    first[slot[::-1]] = np.arange(len(slot))[::-1]
    facts = np.concatenate([parents, np.stack([rows[c].to_numpy().view(np.uint64) for c in ("c1", "c2", "depth", "n_bytes")], axis=1)], axis=1)
    if (slot < 0).any() or (facts != facts[first[slot]]).any():
        raise ValueError("two prefixes have one digest")
    counts = np.bincount(slot, minlength=n)
    depth, turns = rows["depth"].to_numpy(), rows["n_turns"].to_numpy()

    def part(kind: str, at: np.ndarray, count: np.ndarray) -> pa.Table:
        some = rows.take(pa.array(at))
        both = [*digests[at].T, *parents[at].T]
        d1, d2, p1, p2 = (pa.array(np.ascontiguousarray(x).view(np.int64)) for x in both)
        columns = [pa.array([kind] * len(at), pa.string()), pa.array(np.full(len(at), shard)), some["conv_id"], some["depth"], d1, d2, p1, p2, some["c1"], some["c2"], some["n_bytes"], pa.array(count)]
        return pa.table(columns, names=[x.split()[0] for x in PARTS.split(", ")])

    ends = np.flatnonzero(depth == turns)
    bands = np.flatnonzero((depth % size == size - 1) & (depth < turns))
    one = lambda at: np.ones(len(at), np.int64)
    return pa.concat_tables([part("node", first, counts), part("end", ends, one(ends)), part("band", bands, one(bands))])


def shard_parts(rows: DataFrame, size: int = BAND, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``PARTS`` of rows of conv_id, depth (0: the root's row of a conversation), c1, c2, n_bytes, n_turns."""
    lane = lambda k: F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64("depth", "c1", "c2", F.lit(k)))
    rows = rows.withColumns({"k1": lane(1), "k2": lane(2), "band": F.floor(F.col("depth") / size), "carry": F.lit(False)})
    # a later band of a long conversation begins with what its earlier bands come to
    sums = rows.where(F.col("n_turns") >= size).groupBy("conv_id", "band").agg(F.expr("bit_xor(k1)").alias("_x1"), F.expr("bit_xor(k2)").alias("_x2"))
    before = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"k1": F.expr("bit_xor(_x1)").over(before), "k2": F.expr("bit_xor(_x2)").over(before)}).where("band > 0")
    zero = F.lit(0).cast("long")
    carries = sums.select("conv_id", (F.col("band") * size).alias("depth"), *[zero.alias(c) for c in ("c1", "c2", "n_bytes", "n_turns")], "k1", "k2", "band", F.lit(True).alias("carry"))
    rows = rows.unionByName(carries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, shards = 0, 0

        def settle(t: pa.Table) -> pa.Table:
            nonlocal shards
            starts = np.flatnonzero(np.concatenate([[True], _new_group(t)]))
            keys = _lanes(t, "k1", "k2")
            upto = np.concatenate([np.zeros((1, 2), np.uint64), np.bitwise_xor.accumulate(keys, axis=0)])
            sizes = np.diff([*starts, len(keys)])
            digests = upto[1:] ^ np.repeat(upto[starts], sizes, axis=0)
            parents = digests ^ keys
            real = ~t["carry"].to_numpy()
            part = int(t["part"][0].as_py())
            shards += 1
            return _own_nodes(t.filter(pa.array(real)), digests[real], parents[real], part << 32 | shards, size)

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < shard_rows:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            new = np.flatnonzero(_new_group(t))
            cut = int(new[-1]) + 1 if len(new) else 0
            if cut:
                yield from settle(t.slice(0, cut)).to_batches(max_chunksize=10_000)
            held, count = t.slice(cut).to_batches(), t.num_rows - cut
        if count:
            yield from settle(pa.Table.from_batches(held).combine_chunks()).to_batches(max_chunksize=10_000)

    rows = rows.repartitionByRange("conv_id", "band").withColumn("part", F.spark_partition_id().cast("long"))
    return rows.sortWithinPartitions("conv_id", "depth", F.desc("carry")).mapInArrow(run, PARTS)


def _new_group(t: pa.Table) -> np.ndarray:
    """Where a row, from the second, begins another conversation or band."""
    conv, band = t["conv_id"].to_numpy(), t["band"].to_numpy()
    return (conv[1:] != conv[:-1]) | (band[1:] != band[:-1])


def summed_nodes(parts: DataFrame) -> DataFrame:
    """One row for each digest: n_convs, conv_id (smallest member), depth, parent, bytes; raises where a digest has two contents."""
    same = ["depth", "p1", "p2", "c1", "c2", "n_bytes"]
    sums = parts.where("kind = 'node'").groupBy("d1", "d2").agg(
        F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), *[F.min(c).alias(c) for c in same], *[F.max(c).alias(f"_{c}") for c in same]
    )
    odd = F.lit(False)
    for c in same:
        odd = odd | (F.col(c) != F.col(f"_{c}"))
    fail = F.when(odd, F.raise_error(F.lit("two prefixes have one digest")).cast("long")).otherwise(F.col("n_convs"))
    return sums.select("d1", "d2", fail.alias("n_convs"), "conv_id", *same)


def subtree_sums(values: DataFrame, size: int = BAND) -> DataFrame:
    """``d1, d2, n_leaves, saved_tokens`` from shard, d1, d2, p1, p2, depth, leaf, saved of all shards' nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            held.clear()
            digests, depth = _lanes(t, "d1", "d2"), t["depth"].to_numpy()
            table = SlotTable(digests)
            slot = table.find(digests)
            parent = np.full(len(slot), -1)
            up = table.find(_lanes(t, "p1", "p2"))
            parent[slot] = np.where(depth % size == 0, -1, up)
            flat, by_slot = np.zeros((len(slot), 2), np.int64), np.empty(len(slot), np.int64)
            flat[slot] = np.stack([t["leaf"].to_numpy(), t["saved"].to_numpy()], axis=1)
            by_slot[slot] = depth
            total = rise(parent, by_slot, flat)[slot]
            keep = total.any(axis=1)
            columns = [t["d1"].to_numpy()[keep], t["d2"].to_numpy()[keep], *total[keep].T]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["d1", "d2", "leaves", "tokens"])

        at = None
        for batch in batches:
            shard = batch.column(0).to_numpy()
            starts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for begin, end in zip(starts, starts[1:], strict=False):
                if held and shard[begin] != at:
                    yield settle()
                at = shard[begin]
                held.append(batch.slice(begin, end - begin))
        if held:
            yield settle()

    rows = values.select("shard", "d1", "d2", "p1", "p2", "depth", "leaf", "saved").repartition("shard").sortWithinPartitions("shard")
    sums = rows.mapInArrow(run, "d1 long, d2 long, leaves long, tokens long")
    return sums.groupBy("d1", "d2").agg(F.sum("leaves").alias("n_leaves"), F.sum("tokens").alias("saved_tokens"))


def ends_digest(parts: DataFrame) -> DataFrame:
    """``d1, d2, ends_sha256`` of nodes at which conversations end.

    Ids are joined to strings in many tasks; what one task reads of a node are its strings in order, one at a time.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d1, d2, conv = (batch.column(k).to_numpy() for k in range(3))
            new = np.flatnonzero((d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])) + 1
            starts = np.unique(np.concatenate([new, np.arange(0, len(d1), CHUNK)])).astype(np.int64)
            text = list(map(str, conv.tolist()))
            ids = [",".join(text[a:b]) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(text)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x[starts]) for x in (d1, d2, conv)] + [pa.array(ids, pa.string())], ["d1", "d2", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            done: list[tuple[int, int, str]] = []
            for d1, d2, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                if (d1, d2) != at:
                    if state:
                        done.append((*at, state.hexdigest()))
                    at, state = (d1, d2), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_buffer())
            yield _hex(done)
        if state:
            yield _hex([(*at, state.hexdigest())])

    ends = parts.where("kind = 'end'").select("d1", "d2", "conv_id")
    ends = ends.repartitionByRange("d1", "d2", "conv_id").sortWithinPartitions("d1", "d2", "conv_id").mapInArrow(join, "d1 long, d2 long, first long, ids string")
    ends = ends.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "first")
    return ends.mapInArrow(digest, "d1 long, d2 long, ends_sha256 string")


def _hex(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["d1", "d2", "ends_sha256"])


def trie_nodes(rows: DataFrame, size: int = BAND, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each node of ``with_heads`` rows: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``size``: turns of a band; ``shard_rows``: rows of a shard, which a conversation's band may exceed.
    """
    run = Scratch(rows.sparkSession, "trie")
    parts = run.saved(shard_parts(rows, size, shard_rows), "parts")
    nodes = run.saved(summed_nodes(parts), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("_d1"), F.col("p2").alias("_d2")).agg(F.count("*").alias("n_children"))
    same = lambda a, b: (F.col("d1") == F.col(a)) & (F.col("d2") == F.col(b))
    nodes = nodes.join(children, same("_d1", "_d2"), "left").drop("_d1", "_d2")
    nodes = nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = nodes.withColumns({"leaf": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("n_bytes")})
    nodes = run.saved(nodes.drop("c1", "c2", "n_bytes"), "valued")

    # a node's values go to the shard of its smallest member
    worth = nodes.select(F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), F.col("conv_id").alias("_c"), "leaf", "saved")
    values = parts.where("kind = 'node'").select("shard", "conv_id", "d1", "d2", "p1", "p2", "depth").join(worth, same("_d1", "_d2"))
    values = values.select("shard", "d1", "d2", "p1", "p2", "depth", *[F.when(F.col("conv_id") == F.col("_c"), F.col(c)).otherwise(F.lit(0).cast("long")).alias(c) for c in ("leaf", "saved")])
    # and those of a conversation's deeper bands to the last turn of each earlier one
    band = F.floor(F.col("depth") / size)
    deep = nodes.where(F.col("depth") >= size).groupBy("conv_id", band.alias("band")).agg(F.sum("leaf").alias("_l"), F.sum("saved").alias("_s"))
    last = parts.where("kind = 'band'").select("shard", "conv_id", "d1", "d2", band.alias("band"))
    both = last.select("conv_id", "band", F.lit(0).cast("long").alias("_l"), F.lit(0).cast("long").alias("_s"), "shard", "d1", "d2")
    none = F.lit(None).cast("long")
    both = both.unionByName(deep.select("conv_id", "band", "_l", "_s", none.alias("shard"), none.alias("d1"), none.alias("d2")))
    below = Window.partitionBy("conv_id").orderBy(F.desc("band")).rangeBetween(Window.unboundedPreceding, -1)
    more = both.withColumns({c: F.sum(c).over(below) for c in ("_l", "_s")}).where("shard is not null and (_l > 0 or _s > 0)")
    more = more.groupBy(F.col("shard").alias("_sh"), F.col("d1").alias("_d1"), F.col("d2").alias("_d2")).agg(F.sum("_l").alias("_l"), F.sum("_s").alias("_s"))
    more = run.saved(more, "bands")
    if not more.isEmpty():
        values = values.join(more, same("_d1", "_d2") & (F.col("shard") == F.col("_sh")), "left")
        values = values.withColumns({"leaf": F.col("leaf") + F.coalesce("_l", F.lit(0)), "saved": F.col("saved") + F.coalesce("_s", F.lit(0))})
    sums = subtree_sums(values, size).withColumnsRenamed({"d1": "_d1", "d2": "_d2"})
    ends = ends_digest(parts).withColumnsRenamed({"d1": "_e1", "d2": "_e2"})
    parents = nodes.select(F.col("d1").alias("_p1"), F.col("d2").alias("_p2"), F.col("conv_id").alias("_parent"))
    out = nodes.select("d1", "d2", "p1", "p2", "conv_id", "depth", "n_convs", "n_children")
    out = out.join(sums, same("_d1", "_d2"), "left").join(ends, same("_e1", "_e2"), "left")
    up = (F.col("p1") == F.col("_p1")) & (F.col("p2") == F.col("_p2")) & (F.col("depth") > 0)
    out = out.join(parents, up, "left")
    return out.select(
        "conv_id", "depth", F.col("_parent").alias("parent_conv_id"), "n_convs", "n_children", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_leaves", "saved_tokens")],
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
