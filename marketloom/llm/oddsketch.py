"""Near-duplicates by MinHash bands, odd sketches and exact checks.

1. Each text becomes its set of hashed word shingles (64 bits), MinHash samples of it, band keys
   over the samples, and an odd sketch: a bitmap in which every sample flips one bit. Half the
   population count of two sketches' XOR estimates how many samples differ, precisely where the
   similarity is high.
2. Texts of equal sets are one class; only its smallest doc_id goes on.
3. In each bucket (equal band key) all members are paired with one hub, not with each other: the
   member that shares the most buckets with others, as a rule the text that copies were made from.
   Pairs whose sketches are far apart go; the others are confirmed on full shingle sets.
4. Confirmed links make components. The hub leaves its bucket. Buckets that still hold several
   components are compared block by block inside tasks: sketches first, then full sets. Links join
   components as they are found, so a task returns fewer links than it has members.

Similarity 100 * intersection >= percent * union counts as a link. With 32 bands of 4 samples a pair
at 0.8 shares no band with probability 5e-8. The sketch limit lies more than five standard errors
below the threshold.

Null texts and texts without words have empty sets, link with nothing and stand alone. Equal rows are
copies of each other. Rows that share a doc_id are one document that has the links of all its texts.
Rows with a null doc_id are never linked and are kept. Only doc_id and text are read; other columns,
whatever their names, are not. Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, saved

BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 256
#: Pairs whose estimated similarity is lower than the threshold by more are not checked exactly.
SKETCH_MARGIN = 0.2
#: Members of one block in the comparison across components; long texts count as several.
BLOCK, BLOCK_SHINGLES = 2048, 512

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


@cache
def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    random = _mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return random[:n] | np.uint64(1), random[n:]


class Words(dict):
    """word -> 64-bit hash, bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def shingle_set(text: str | None, size: int, words: Words) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``size`` words; all words are one if they are fewer."""
    tokens = (text or "").encode().translate(_LOWER).split()
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, tokens), np.uint64, n)
    k = min(size, n)
    h = w[: n - k + 1].copy()
    for i in range(1, k):
        h = _mix(h) + w[i : n - k + 1 + i]
    return np.unique(_mix(h + np.uint64(k)))


def samples_of(shingles: np.ndarray, n: int = SAMPLES, step: int = 512) -> np.ndarray:
    """MinHash samples: the least of each of ``n`` permutations of the hashes."""
    a, b = _multipliers(n)
    least = np.full(n, ~np.uint64(0))
    for i in range(0, len(shingles), step):
        np.minimum(least, ((shingles[i : i + step, None] ^ b) * a).min(axis=0), out=least)
    return least


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples.reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        h = _mix(h + rows[:, k])
    return h.view(np.int64)


def odd_sketch(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    spots = _mix(samples + np.arange(1, len(samples) + 1, dtype=np.uint64) * _M2) % np.uint64(bits)
    parity = (np.bincount(spots.astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.int64)


SIGNATURES = "doc_id long, n_shingles long, set_key binary, sketch array<long>, bands array<long>"


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, text`` to ``SIGNATURES``; texts without words have no key, sketch or bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            sizes, keys, sketches, bands = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingle_set(text, shingle, words)
                sizes.append(len(found))
                if len(found):
                    least = samples_of(found)
                    keys.append(xxhash.xxh3_128_digest(found.tobytes()))
                    sketches.append(odd_sketch(least))
                    bands.append(band_keys(least))
                else:
                    keys.append(None)
                    sketches.append(None)
                    bands.append(None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, longs), pa.array(bands, longs)],
                [x.split()[0] for x in SIGNATURES.split(", ")],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(sign, SIGNATURES)


def sketch_similarity(a: Column, b: Column) -> Column:
    """The odd-sketch estimate 1 + n / 4k * ln(1 - 2 d / n) of d differing bits among n, from k samples."""
    differing = sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))
    inside = F.greatest(1 - 2 * differing / F.lit(float(SKETCH_BITS)), F.lit(1e-9))
    return 1 + F.lit(SKETCH_BITS / (4 * SAMPLES)) * F.log(inside)


#: Ids up to which a list of documents is sent to the tasks (8 bytes each); longer lists meet the texts in a shuffle.
BROADCAST_IDS = 2_000_000


def sets_of(docs: DataFrame, classes: DataFrame, shingle: int, run: Scratch) -> DataFrame:
    """``set_key, shingles`` (sorted 64-bit hashes) of the classes in ``classes`` (set_key, rep), one row for each."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            found = [shingle_set(t, shingle, words).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(xxhash.xxh3_128_digest, found), pa.binary()), pa.array(found, pa.binary())], ["set_key", "shingles"])

    ids = run.saved(classes.select(F.col("rep").alias("_id")).distinct(), "set-ids")
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.join(few, docs["doc_id"] == ids["_id"], "left_semi").select("text")
    # a doc_id may have several texts, of which only those of the classes asked for meet a pair later
    return run.saved(texts.mapInArrow(sign, "set_key binary, shingles binary").groupBy("set_key").agg(F.first("shingles").alias("shingles")), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``a, b`` of ``pairs`` (a, a_key, b, b_key) whose shingle sets reach ``percent``."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept: list[int] = []
            for k, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    one, two = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    if 100 * both >= percent * (len(one) + len(two) - both):
                        kept.append(k)
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    one, two = sets.toDF("a_key", "_sa"), sets.toDF("b_key", "_sb")
    return pairs.join(two, "b_key").join(one, "a_key").select("a", "b", "_sa", "_sb").mapInArrow(check, "a long, b long")


def links_between(rep: np.ndarray, component: np.ndarray, sketch: np.ndarray, bands: np.ndarray, sets: list[np.ndarray], one: np.ndarray, two: np.ndarray, key: int, percent: int) -> list[tuple[int, int]]:
    """Links between members ``one`` and ``two`` of a bucket that join different components.

    Every pair of different components is settled, here or in the first bucket that both share: by
    sketches, then on full sets; a pair whose components are joined by now needs no look.
    """
    least = SKETCH_BITS / 2 * (1 - np.exp((percent / 100 - SKETCH_MARGIN - 1) * 4 * SAMPLES / SKETCH_BITS))
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    label = np.unique(component, return_inverse=True)[1]
    same = one is two
    inverse: list[np.ndarray] | None = None
    found: list[tuple[int, int]] = []
    for x in one.tolist():
        y = two[two > x] if same else two
        y = y[(label[y] != label[x]) & (100 * np.minimum(size[y], size[x]) >= percent * np.maximum(size[y], size[x]))]
        y = y[np.bitwise_count(sketch[y] ^ sketch[x]).sum(axis=1) <= least]
        y = y[bands[y, (bands[y] == bands[x]).argmax(axis=1)] == key]
        if not len(y):
            continue
        if inverse is None:
            distinct, at = np.unique(np.concatenate(sets), return_inverse=True)
            inverse, mark = np.split(at, np.cumsum(size)[:-1]), np.zeros(len(distinct), np.int32)
        mark[inverse[x]] = 1
        both = np.add.reduceat(mark[np.concatenate([inverse[k] for k in y.tolist()])], np.cumsum(size[y]) - size[y])
        mark[inverse[x]] = 0
        for k in y[100 * both >= percent * (size[x] + size[y] - both)].tolist():
            if label[k] != label[x]:
                found.append((int(rep[x]), int(rep[k])))
                label[label == label[k]] = label[x]
    return found


def links_across(members: DataFrame, percent: int) -> DataFrame:
    """Confirmed links ``a, b`` between members of one bucket and different components.

    ``members``: key, rep, component, sketch, bands, shingles. A bucket is dealt into blocks of about
    ``BLOCK`` members by weight; a task meets two blocks at a time.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at: tuple | None = None

        def settle() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            key, i, j = at
            own = t["own"].to_numpy()
            arrays = (np.array(t[c].to_pylist(), np.int64) for c in ("sketch", "bands"))
            sketch, bands = arrays
            one = np.flatnonzero(own == i)
            two = one if i == j else np.flatnonzero(own == j)
            sets = [np.frombuffer(x, "<u8") for x in t["shingles"].to_pylist()]
            found = links_between(t["rep"].to_numpy(), t["component"].to_numpy(), sketch.view(np.uint64), bands, sets, one, two, key, percent)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in range(2)], ["a", "b"])

        for batch in batches:
            groups = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            starts = [0, *(np.flatnonzero((groups[1:] != groups[:-1]).any(axis=1)) + 1).tolist(), len(groups)]
            for begin, end in zip(starts, starts[1:], strict=False):
                now = tuple(groups[begin].tolist())
                if held and now != at:
                    yield settle()
                at = now
                held.append(batch.slice(begin, end - begin))
        if held:
            yield settle()

    weight = F.greatest(F.lit(1.0), F.octet_length("shingles") / (8 * BLOCK_SHINGLES))
    blocks = members.groupBy("key").agg(F.ceil(F.sum(weight) / BLOCK).cast("int").alias("_n"))
    own = F.pmod(F.xxhash64("rep"), F.col("_n")).cast("int")
    rows = members.join(blocks, "key").withColumn("own", own).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    rows = rows.select("key", F.least("own", "_o").alias("i"), F.greatest("own", "_o").alias("j"), "own", "rep", "component", "sketch", "bands", "shingles")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(compare, "a long, b long")


def components(edges: DataFrame, run: Scratch) -> DataFrame:
    """``node, component`` (the least node reachable) of undirected ``a, b``; large-star and small-star.

    Every step is a minimum by node and a join, stored; a hub's many edges are summed before the
    shuffle and split by the join.
    """
    now = run.saved(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    state = None
    while True:
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
        # large star: larger neighbours move to the least of the neighbourhood
        large = both.where(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours move to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), "m")
        moved = large.join(low, F.col("u") == F.col("_u"))
        small = moved.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("_u", "m")).distinct()
        now = run.saved(small.toDF("u", "v"), "stars")
        r = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (r["n"], r["h"]) == state or not r["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = (r["n"], r["h"])


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, text`` to doc_id, n_shingles, component_id (least doc_id reachable) and kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    run = Scratch(docs.sparkSession, "near-duplicates")
    signed = run.saved(signatures(docs, shingle), "signatures")
    some = signed.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    classes = some.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    classes = run.saved(classes, "classes")
    rep_of = classes.select(F.col("set_key").alias("_key"), "rep")
    rows = signed.select("doc_id", "n_shingles", "set_key").join(rep_of, F.col("set_key") == F.col("_key"), "left")
    rows = run.saved(rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")), "rows")
    # the classes of a doc_id with several texts belong together
    several = rows.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("_high")).where(F.col("a") != F.col("_high"))
    edges = run.saved(rows.join(several.select(F.col("doc_id").alias("_id"), "a"), F.col("doc_id") == F.col("_id")).select("a", F.col("rep").alias("b")).where("b is not null"), "links")

    members = classes.select("set_key", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("_key"), "n")
    members = run.saved(members.join(shared, F.col("key") == F.col("_key")).select("key", "set_key", "n"), "shared-bands")
    popular = members.groupBy("set_key").agg(F.sum("n").alias("popular")).withColumnRenamed("set_key", "_set")
    popular = popular.join(classes.select("set_key", "rep", "sketch"), F.col("_set") == F.col("set_key")).drop("_set")
    members = run.saved(members.select("key", "set_key").join(popular, "set_key"), "members")
    hubs = members.groupBy("key").agg(F.max(F.struct("popular", (-F.col("rep")).alias("_r"), "set_key", "sketch", "rep")).alias("hub"))
    hubs = run.saved(hubs.select(F.col("key").alias("_key"), F.col("hub.rep").alias("a"), F.col("hub.set_key").alias("a_key"), F.col("hub.sketch").alias("_sa")), "hubs")
    members = members.join(hubs, F.col("key") == F.col("_key")).where(F.col("set_key") != F.col("a_key")).drop("_key", "popular")
    near = members.where((F.col("rep") != F.col("a")) & (sketch_similarity(F.col("sketch"), F.col("_sa")) >= percent / 100 - SKETCH_MARGIN))
    near = run.saved(near.select("a", "a_key", F.col("rep").alias("b"), F.col("set_key").alias("b_key")).distinct(), "near-pairs")
    wanted = near.select(F.col("a_key").alias("set_key"), F.col("a").alias("rep")).union(near.select("b_key", "b"))
    edges = edges.unionByName(run.saved(confirmed(near, sets_of(docs, wanted, shingle, run), percent), "links"))
    owner = components(edges, run)

    named = members.select("key", "set_key", "rep", "sketch").join(owner, F.col("rep") == F.col("node"), "left")
    named = run.saved(named.select("key", "set_key", "rep", "sketch", F.coalesce("component", "rep").alias("component")), "named")
    mixed = named.groupBy("key").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where(F.col("_low") != F.col("_high"))
    rest = run.saved(named.join(mixed.select(F.col("key").alias("_key")), F.col("key") == F.col("_key"), "left_semi"), "mixed")
    if not rest.isEmpty():
        sets = sets_of(docs, rest.select("set_key", "rep"), shingle, run)
        full = rest.select("set_key").distinct().join(classes.select("set_key", "bands"), "set_key").join(sets, "set_key")
        links = run.saved(links_across(rest.join(full, "set_key"), percent), "links")
        if not links.isEmpty():
            owner = components(edges.unionByName(links), run)
    out = rows.join(owner, F.col("rep") == F.col("node"), "left")
    # documents without a set, or without an id, stand alone
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    out = out.select("doc_id", "n_shingles", own.alias("component_id"))
    out = saved(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near-duplicates")
    run.clear()
    return out
