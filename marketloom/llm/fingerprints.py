"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Every shingle of ``SHINGLE`` words is hashed once. The top bits of a hash choose its bin and each bin
keeps its least hash. Empty bins are filled by optimal densification: bin i tries the bins that
``hash(i, attempt)`` names until one is not empty. A fingerprint holds ``LOW_BITS`` low-order bits of
each bin's value, rehashed with the bin. Two documents agree in a bin by chance with probability
2**-LOW_BITS, for which ``likeness`` corrects.

Words are what lies between white space; a text of fewer words than a shingle is one shingle. Null
texts count as empty. A text without words has the empty fingerprint: alike (1) to another empty
one, and to nothing else (0). Equal texts have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions

SHINGLE = 5
BIN_BITS = 8
LOW_BITS = 4
BINS = 1 << BIN_BITS
#: Attempts before a bin walks through all bins in an order of its own.
ATTEMPTS = 16


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BIN_BITS)


def with_codes(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the low bits of each bin as ARRAY<TINYINT>, null for a text without words.

    Helper columns begin with ``_fp_`` and are dropped again.
    """
    rest = (1 << (64 - BIN_BITS)) - 1
    # the largest hash of each bin marks the bin as empty unless a smaller one is there
    marks = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.shiftleft(b.cast("long"), 64 - BIN_BITS).bitwiseOR(F.lit(rest)))
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    df = df.withColumn("_fp_w", F.transform(words, lambda w: F.xxhash64(w)))
    n = F.size("_fp_w")
    shingles = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get("_fp_w", i + k) for k in range(SHINGLE)]))
    hashes = F.when(n >= SHINGLE, shingles).when(n > 0, F.array(F.xxhash64("_fp_w")))
    df = df.withColumn("_fp_s", F.sort_array(F.concat(hashes, marks)))
    first = F.filter("_fp_s", lambda h, i: (i == 0) | (_bin(h) != _bin(F.get("_fp_s", i - 1))))
    df = df.withColumn("_fp_b", F.transform(first, lambda h: F.when(h.bitwiseAND(F.lit(rest)) != F.lit(rest), h)))

    def filled(value: Column, i: Column) -> Column:
        tried = [F.get("_fp_b", F.pmod(F.xxhash64(i, F.lit(a)), F.lit(BINS)).cast("int")) for a in range(ATTEMPTS)]
        start, stride = F.pmod(F.xxhash64(i, F.lit(-1)), F.lit(BINS)), F.pmod(F.xxhash64(i, F.lit(-2)), F.lit(BINS // 2)) * 2 + 1
        spots = F.sequence(F.lit(0), F.lit(BINS - 1))
        walk = F.get(F.filter(F.transform(spots, lambda a: F.get("_fp_b", ((start + a * stride) % BINS).cast("int"))), lambda v: v.isNotNull()), F.lit(0))
        # hashed with the bin, so that bins that share a value by filling do not agree by chance together
        return F.xxhash64(F.coalesce(value, *tried, walk), i).bitwiseAND(F.lit((1 << LOW_BITS) - 1)).cast("tinyint")

    df = df.withColumn(out, F.transform("_fp_b", filled))
    return df.drop("_fp_w", "_fp_s", "_fp_b")


def packed(codes: Column) -> Column:
    """The fingerprint as a string of one hexadecimal digit for each bin; empty without words."""
    return F.coalesce(F.lower(F.array_join(F.transform(codes, lambda c: F.hex(c.cast("long"))), "")), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity (0 to 1) of two code arrays, corrected for chance agreement."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-LOW_BITS
    estimate = F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(estimate)


def with_next(df: DataFrame, key: str, columns: list[str], per_partition: int = 4) -> DataFrame:
    """Add ``next_<c>`` for each column: its value in the row that follows in order of ``key``.

    The last row is followed by the first. Rows of one key are ordered by ``columns``; null keys come
    first. The key range is cut at quantiles into slices; the first row of a slice is copied to the
    slice before it, so each window sees one slice. Only the cuts (as many as ``per_partition`` for
    each shuffle partition) pass through the driver.
    """
    spark = df.sparkSession
    n = per_partition * partitions(spark)
    order_key = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    keys = df.select(order_key.alias("_k"))
    cuts = keys.agg(F.percentile_approx("_k", [i / n for i in range(1, n)], 10_000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    slice_of = lambda k: F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= k)) if cuts else F.lit(0)
    heads = sorted((r["_slice"], r["_head"]) for r in keys.groupBy(slice_of(F.col("_k")).alias("_slice")).agg(F.min("_k").alias("_head")).collect())
    before = [(head, heads[i - 1][0]) for i, (_, head) in enumerate(heads)]
    # one row for each slice
    copies = spark.createDataFrame(before, "_head long, _to int")
    df = df.withColumn("_k", order_key).withColumn("_slice", slice_of(F.col("_k")))
    df = df.join(F.broadcast(copies), F.col("_k") == F.col("_head"), "left")
    there = F.array(F.struct(F.col("_slice").alias("s"), F.lit(False).alias("copy")))
    also = F.array(F.struct(F.col("_slice").alias("s"), F.lit(False).alias("copy")), F.struct(F.col("_to").alias("s"), F.lit(True).alias("copy")))
    df = df.withColumn("_at", F.explode(F.when(F.col("_to").isNull(), there).otherwise(also)))
    w = Window.partitionBy("_at.s").orderBy("_at.copy", "_k", *columns)
    df = df.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns})
    return df.where(~F.col("_at.copy")).drop("_k", "_slice", "_head", "_to", "_at")
