"""Near-duplicates by SimHash fingerprints and pigeonring filtering.

1. A text's shingles of three words, repeats included, are hashed by XXH64; a fingerprint bit is 1 if
   it is set in over half of the hashes. Texts of fewer words are one shingle; texts without words
   have the fingerprint zero.
2. Equal fingerprints are one class, represented by its least doc_id.
3. The 64 bits are a ring of ``SEGMENTS`` segments. If two fingerprints differ in at most ``DISTANCE``
   bits, there is a segment from which every chain of l segments differs in at most
   ``l * DISTANCE / SEGMENTS`` bits (rounded down: 0, 0, 1, 1, 1, 2, 2, 3). So the first two segments
   are equal, and among the three that follow one at most differs. Each choice of a start and of the
   segment that may differ is a key of the four others' 32 bits.
4. Classes that share a key are compared inside tasks: a pair is dropped as soon as one of its chains
   is over its budget, and only what is left gets the full Hamming check. Pairs of one component by
   now need no look, so a task returns fewer links than it has members. A key of very many members is
   dealt into blocks, and a task meets two blocks at a time.
5. Links make components (large-star, small-star).

Null texts and texts without words link with each other like any others of equal fingerprints. Equal
rows are copies. Rows that share a doc_id are one document that has the links of all its texts; ties
for a representative cannot be, as it is the least doc_id. Rows with a null doc_id have a fingerprint, no links and a null
component. A very long text is hashed whole by one task. Only doc_id and text are read; other columns,
whatever their names, are not. Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .oddsketch import _LOWER, components
from .shared import Scratch, saved

SHINGLE, SEED = 3, 42
BITS, DISTANCE, SEGMENTS = 64, 3, 8
#: Members of one block of a key.
BLOCK = 4096
#: Shingles whose bits are counted at once.
STEP = 1 << 16


def shingle_hashes(text: str | None, size: int = SHINGLE) -> bytes:
    """XXH64 of each shingle in order, big-endian; empty without words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return b""
    line, size, digest = b" ".join(words), min(size, len(words)), xxhash.xxh64_digest
    lengths = list(map(len, words))
    starts = [0, *accumulate(n + 1 for n in lengths[: len(words) - size])]
    ends = [e - 1 for e in accumulate(n + 1 for n in lengths)][size - 1 :]
    return b"".join([digest(line[a:b], SEED) for a, b in zip(starts, ends, strict=True)])


def fingerprint(text: str | None, size: int = SHINGLE) -> bytes:
    """The fingerprint as 8 bytes, highest bit first."""
    hashes = np.frombuffer(shingle_hashes(text, size), np.uint8).reshape(-1, BITS // 8)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), STEP):
        ones += np.unpackbits(hashes[i : i + STEP], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, text`` to doc_id and fingerprint (the 64 bits as a signed long)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = b"".join(fingerprint(t.as_py(), size) for t in batch.column(1))
            signed = pa.array(np.frombuffer(found, ">i8").astype("<i8"))
            yield pa.RecordBatch.from_arrays([batch.column(0), signed], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(sign, "doc_id long, fingerprint long")


def mask_of(segments: list[int]) -> int:
    """The bits of segments (numbered round the ring), as an unsigned number."""
    width = BITS // SEGMENTS
    return sum(((1 << width) - 1) << (width * (s % SEGMENTS)) for s in segments)


def budget(length: int) -> int:
    """The most bits in which a chain of so many segments may differ."""
    return length * DISTANCE // SEGMENTS


#: (start, mask of a key): equal segments of a chain of five of which one may differ.
KEYS = [(i, mask_of([i, i + 1, *(i + k for k in (2, 3, 4) if k != free)])) for i in range(SEGMENTS) for free in (2, 3, 4)]
#: For each start: (mask of a chain, its budget), the longest of each budget.
CHAINS = [[(mask_of([i + k for k in range(n)]), budget(n)) for n in range(1, SEGMENTS + 1) if n == SEGMENTS or budget(n + 1) > budget(n)] for i in range(SEGMENTS)]


def within_budgets(x: np.ndarray, start: int) -> np.ndarray:
    """Positions of differences ``x`` whose chains from ``start`` stay within their budgets; the last chain is the whole ring."""
    at = np.arange(len(x))
    for mask, most in CHAINS[start]:
        at = at[np.bitwise_count(x[at] & np.uint64(mask)) <= most]
    return at


def links_between(nodes: np.ndarray, bits: np.ndarray, one: np.ndarray, two: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Links between members ``one`` and ``two`` of a key that join what was apart."""
    label, same = np.arange(len(nodes)), one is two
    found: list[tuple[int, int]] = []
    for x in one.tolist():
        y = two[two > x] if same else two
        y = y[label[y] != label[x]]
        for k in y[within_budgets(bits[y] ^ bits[x], start)].tolist():
            if label[k] != label[x]:
                found.append((int(nodes[x]), int(nodes[k])))
                label[label == label[k]] = label[x]
    return found


def key_members(classes: DataFrame) -> DataFrame:
    """``chain, bits, rep, fingerprint`` of the keys that several classes share, and their number ``n``."""
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for _, m in KEYS]
    keys = F.array(*[F.struct(F.lit(k).alias("chain"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(signed)])
    members = classes.select("rep", "fingerprint", F.explode(keys).alias("_k")).select("_k.*", "rep", "fingerprint")
    shared = members.groupBy("chain", "bits").agg(F.count("*").alias("n")).where("n > 1")
    return members.join(shared, ["chain", "bits"])


def links_of(members: DataFrame) -> DataFrame:
    """``a, b``: enough of the pairs within ``DISTANCE`` bits to join all that they join."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at: tuple | None = None

        def settle() -> list[tuple[int, int]]:
            t = pa.Table.from_batches(held)
            held.clear()
            own, i, j = t["own"].to_numpy(), at[2], at[3]
            one = np.flatnonzero(own == i)
            two = one if i == j else np.flatnonzero(own == j)
            return links_between(t["rep"].to_numpy(), t["fingerprint"].to_numpy().view(np.uint64), one, two, KEYS[at[0]][0])

        for batch in batches:
            groups = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(4)], axis=1)
            starts = [0, *(np.flatnonzero((groups[1:] != groups[:-1]).any(axis=1)) + 1).tolist(), len(groups)]
            found: list[tuple[int, int]] = []
            for begin, end in zip(starts, starts[1:], strict=False):
                now = tuple(groups[begin].tolist())
                if held and now != at:
                    found += settle()
                at = now
                held.append(batch.slice(begin, end - begin))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in range(2)], ["a", "b"])
        if held:
            found = settle()
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in range(2)], ["a", "b"])

    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = members.withColumn("own", F.pmod(F.xxhash64("fingerprint"), blocks).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("chain", "bits", F.least("own", "_o").alias("i"), F.greatest("own", "_o").alias("j"), "own", "rep", "fingerprint")
    order = ["chain", "bits", "i", "j"]
    return rows.repartition(*order).sortWithinPartitions(*order).mapInArrow(compare, "a long, b long")


def simhash_groups(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, text`` to doc_id, fingerprint (16 hex digits) and component_id (least doc_id reachable)."""
    run = Scratch(docs.sparkSession, "simhash")
    signed = run.saved(fingerprints(docs, size), "fingerprints")
    some = signed.where(F.col("doc_id").isNotNull())
    classes = run.saved(some.groupBy("fingerprint").agg(F.min("doc_id").alias("rep")), "classes")
    links = run.saved(links_of(key_members(classes)), "links")
    rows = signed.join(classes.select(F.col("fingerprint").alias("_f"), "rep"), F.col("fingerprint") == F.col("_f"), "left").drop("_f")
    rows = run.saved(rows.withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.col("rep"))), "rows")
    # the classes of a doc_id with several texts belong together
    several = rows.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("_high")).where(F.col("a") != F.col("_high"))
    edges = rows.join(several.select(F.col("doc_id").alias("_id"), "a"), F.col("doc_id") == F.col("_id")).select("a", F.col("rep").alias("b"))
    owner = components(links.unionByName(edges), run)
    out = rows.join(owner, F.col("rep") == F.col("node"), "left")
    text = F.lower(F.lpad(F.hex("fingerprint"), BITS // 4, "0"))
    out = saved(out.select("doc_id", text.alias("fingerprint"), F.coalesce("component", "rep").alias("component_id")), "simhash")
    run.clear()
    return out
