"""Exact quantiles without bringing a column or a group to one task.

Of a whole column: an approximate percentile narrows the range in which a rank lies, an exact count says how many rows lie
below and in it, and so on until the rows in range are few; only those come to the driver. Each pass
is one aggregation with partial sums; a pass divides the range by some thousands.

Of groups: rows become counts of distinct values by group, stored once. A group with few distinct values
takes its quantiles from these counts. The counts of larger groups are range partitioned by group and
value; prefix sums in each partition and a carry for each partition's first group give every value
its span of ranks, and the values whose spans hold the ranks asked for are picked.
"""

from __future__ import annotations

import math

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import checkpointed

#: Values that the driver takes in for all ranks together.
HELD = 200_000
_ACCURACY = 10_000


def values_at(df: DataFrame, column: str, ranks: dict[str, list[int]] | list[int], group: str | None = None) -> dict[str, dict[int, float]]:
    """The values of ``column`` at ascending 0-based ranks among its known ones, for a few groups or in all.

    ``ranks`` holds for each value of ``group`` (as text; "" without groups) the ranks asked for.
    Ranks outside the rows are left out. Nulls and NaN do not count.
    """
    asked = ranks if isinstance(ranks, dict) else {"": ranks}
    rows = df.select(F.col(column).cast("double").alias("v"), (F.col(group).cast("string") if group else F.lit("")).alias("g")).where("v is not null and not isnan(v)").persist()
    try:
        return _narrowed(rows, asked)
    finally:
        rows.unpersist()


def _narrowed(rows: DataFrame, asked: dict[str, list[int]]) -> dict[str, dict[int, float]]:
    v, found = F.col("v"), {g: {} for g in asked}
    # [group, rank, low, high, rows below low, rows in range]
    open_ = [[g, r, -math.inf, math.inf, 0, None] for g, own in asked.items() for r in own]
    while open_:
        within = [(F.col("g") == g) & v.between(a, b) for g, _, a, b, _, _ in open_]
        below = [(F.col("g") == g) & (v < a) for g, _, a, _, _, _ in open_]
        counts = rows.agg(*[F.count_if(c).alias(f"w{k}") for k, c in enumerate(within)], *[F.count_if(c).alias(f"b{k}") for k, c in enumerate(below)]).first()
        for k, x in enumerate(open_):
            x[4], x[5] = counts[f"b{k}"], counts[f"w{k}"]
        open_ = [x for x in open_ if x[1] < x[4] + x[5]]
        for x in [x for x in open_ if x[2] == x[3]]:
            found[x[0]][x[1]] = x[2]
        open_ = [x for x in open_ if x[2] != x[3]]
        few: list[list] = []
        for x in sorted(open_, key=lambda x: x[5]):
            if sum(y[5] for y in few) + x[5] <= HELD:
                few.append(x)
        if few:
            near = [F.when((F.col("g") == g) & v.between(a, b), k) for k, (g, _, a, b, _, _) in enumerate(few)]
            held: dict[int, list[float]] = {}
            for r in rows.select("v", F.explode(F.array_compact(F.array(*near))).alias("k")).collect():
                held.setdefault(r["k"], []).append(r["v"])
            for k, (g, rank, _, _, lower, _) in enumerate(few):
                found[g][rank] = sorted(held[k])[rank - lower]
            open_ = [x for x in open_ if x not in few]
        if open_:
            shares = [[min(1.0, max(0.0, (rank - lower) / n + d / _ACCURACY)) for d in (-2, 2)] for _, rank, _, _, lower, n in open_]
            approx = [F.percentile_approx(F.when((F.col("g") == g) & v.between(a, b), v), p, _ACCURACY).alias(f"p{k}") for k, ((g, _, a, b, _, _), p) in enumerate(zip(open_, shares, strict=True))]
            ends = rows.agg(*approx).first()
            tried = [[x[0], x[1], *ends[f"p{k}"], 0, 0] for k, x in enumerate(open_)]
            sure = rows.agg(*[F.count_if((F.col("g") == g) & (v < a)).alias(f"b{k}") for k, (g, _, a, _, _, _) in enumerate(tried)], *[F.count_if((F.col("g") == g) & v.between(a, b)).alias(f"w{k}") for k, (g, _, a, b, _, _) in enumerate(tried)]).first()
            # a range that missed its rank leaves the one side that holds it
            for k, (old, new) in enumerate(zip(open_, tried, strict=True)):
                lower, n = sure[f"b{k}"], sure[f"w{k}"]
                if new[1] < lower:
                    old[3] = math.nextafter(new[2], -math.inf)
                elif new[1] >= lower + n:
                    old[2] = math.nextafter(new[3], math.inf)
                else:
                    old[2], old[3] = new[2], new[3]
    return found


def quantiles(df: DataFrame, column: str, levels: list[float]) -> list[float | None]:
    """Quantiles with linear interpolation between neighbouring values; nulls where no value is known."""
    c = F.col(column).cast("double")
    n = df.where(c.isNotNull() & ~F.isnan(c)).count()
    if not n:
        return [None] * len(levels)
    spots = [p * (n - 1) for p in levels]
    at = values_at(df, column, sorted({r for s in spots for r in (math.floor(s), math.ceil(s))}))[""]
    return [_between(at, s) for s in spots]


def _between(at: dict[int, float], spot: float) -> float:
    low, high = math.floor(spot), math.ceil(spot)
    return at[low] if low == high else (high - spot) * at[low] + (spot - low) * at[high]


#: Distinct values of one group that a task may hold.
GROUP_VALUES = 1_000_000


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def value_counts(df: DataFrame, keys: list[str], columns: dict[str, Column | str], weight: str | None = None) -> DataFrame:
    """``k`` (the keys as a struct), ``m`` (the name of a column), ``v`` (a known value as double) and ``c``, how often; stored.

    With ``weight`` a row stands for that many.
    """
    return checkpointed(_values(df, keys, columns, weight).groupBy("k", "m", "v").agg(F.sum("_w").alias("c")), "value-counts")


def _values(df: DataFrame, keys: list[str], columns: dict[str, Column | str], weight: str | None = None, together: bool = False) -> DataFrame:
    """``k, m, v`` and the weight ``_w`` of every known value; with ``together`` the rows of a group move to one partition, before they become values."""
    kind = lambda c: F.col(c) if isinstance(c, str) else c
    own = F.col(weight) if weight else F.lit(1).cast("long")
    rows = df.select(F.struct(*keys).alias("k"), own.alias("_w"), *[kind(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns.values())])
    if together:
        rows = rows.where(F.coalesce(*[f"_v{i}" for i in range(len(columns))]).isNotNull()).repartition("k")
    values = F.array(*[F.struct(F.lit(name).alias("m"), F.col(f"_v{i}").alias("v")) for i, name in enumerate(columns)])
    return rows.select("k", "_w", F.explode(values).alias("_x")).select("k", "_w", "_x.*").where("v is not null")


def _spans(counts: DataFrame) -> DataFrame:
    """Adds ``s`` (rows of the group below the value) and ``n`` (rows of the group) to k, m, v, c; no window holds more than a partition's part of a group."""
    stored = checkpointed(counts.repartitionByRange("k", "m", "v").withColumn("_part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_part", "k", "m")
    rows = stored.withColumns({"_in": F.coalesce(F.sum("c").over(inside.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_own": F.sum("c").over(inside)})
    # a group that several partitions share ends one of them and begins the next: at most two short rows for each partition
    ends = stored.groupBy("_part").agg(F.min_by(F.struct("k", "m"), F.struct("k", "m", "v")).alias("a"), F.max_by(F.struct("k", "m"), F.struct("k", "m", "v")).alias("b"))
    ends = ends.select("_part", F.explode(F.array_distinct(F.array("a", "b"))).alias("g"))
    both = ends.groupBy("g").agg(F.count("*").alias("_n")).where("_n > 1").select("g")
    met = stored.groupBy("_part", F.struct("k", "m").alias("g")).agg(F.sum("c").alias("_c")).join(F.broadcast(both), "g", "left_semi")
    by_group = Window.partitionBy("g")
    carry = met.select(F.col("_part").alias("_p"), "g", F.coalesce(F.sum("_c").over(by_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_c").over(by_group).alias("_all"))
    on = (F.col("_part") == F.col("_p")) & (F.struct("k", "m") == F.col("g"))
    out = rows.join(F.broadcast(carry), on, "left")
    return out.select("k", "m", "v", "c", (F.col("_in") + F.coalesce("_before", F.lit(0))).alias("s"), F.coalesce("_all", "_own").alias("n"))


def grouped_positions(df: DataFrame, keys: list[str], columns: dict[str, Column | str], position: Callable[[Column], list[Column]], most: int = GROUP_VALUES, weight: str | None = None, stored: bool = False) -> DataFrame:
    """``keys, m, n, quantiles``: for each group and named column its number of known values and the values at the positions
    that ``position(n)`` gives (0-based, fractions between neighbours), whatever the size of a group.

    Null keys are keys. Groups without a known value have no row. A ``stored`` table is read twice: its rows are
    counted, and if no group has more than ``most``, rows move once, to their group, and no counts are stored.
    """
    if stored and df.groupBy(*keys).agg(F.count("*").alias("_d")).where(F.col("_d") > most).isEmpty():
        return _at_positions(_small_spans(_values(df, keys, columns, weight, together=True).groupBy("k", "m", "v").agg(F.sum("_w").alias("c"))), position)
    counts = value_counts(df, keys, columns, weight)
    sizes = counts.groupBy("k", "m").agg(F.count("*").alias("_d")).where(F.col("_d") > most).select(F.col("k").alias("_k"), F.col("m").alias("_m"))
    hot = checkpointed(sizes, "hot-groups")
    if hot.isEmpty():
        rows = _small_spans(counts)
    else:
        on = _same("k", "_k") & _same("m", "_m")
        rows = _small_spans(counts.join(hot, on, "left_anti")).unionByName(_spans(counts.join(hot, on, "left_semi")))
    return _at_positions(rows, position)


def _small_spans(counts: DataFrame) -> DataFrame:
    """``s`` and ``n`` as ``_spans`` has them, by a window over the counts of a group."""
    few = Window.partitionBy("k", "m")
    return counts.withColumns({"s": F.coalesce(F.sum("c").over(few.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("c").over(few)})


def _at_positions(rows: DataFrame, position: Callable[[Column], list[Column]]) -> DataFrame:
    asked = position(F.col("n"))
    holds = lambda r: (F.col("s") <= r) & (r < F.col("s") + F.col("c"))
    wanted = [(F.floor(p).cast("long"), F.ceil(p).cast("long"), p) for p in asked]
    met = F.lit(False)
    for low, high, _ in wanted:
        met = met | holds(low) | holds(high)
    ends = {}
    for i, (low, high, _) in enumerate(wanted):
        ends |= {f"_l{i}": F.max(F.when(holds(low), F.col("v"))), f"_h{i}": F.max(F.when(holds(high), F.col("v")))}
    out = rows.where(met).groupBy("k", "m", "n").agg(*[c.alias(x) for x, c in ends.items()])
    between = lambda i, low, high, p: F.when(low == high, F.col(f"_l{i}")).otherwise((high - p) * F.col(f"_l{i}") + (p - low) * F.col(f"_h{i}"))
    return out.select("k.*", "m", "n", F.array(*[between(i, *w) for i, w in enumerate(wanted)]).alias("quantiles"))


def grouped_quantiles(df: DataFrame, column: str, keys: list[str], levels: list[float], most: int = GROUP_VALUES) -> DataFrame:
    """``keys, n, quantiles`` of one column, with linear interpolation; null keys are keys."""
    return grouped_positions(df, keys, {column: column}, lambda n: [F.lit(p) * (n - 1) for p in levels], most).drop("m")


def with_medians(groups: DataFrame, df: DataFrame, keys: list[str], columns: dict[str, Column | str], most: int = GROUP_VALUES, weight: str | None = None, stored: bool = False) -> DataFrame:
    """``groups`` (one row for each group of ``df`` by ``keys``) with exact medians of named expressions; null where none is known."""
    found = grouped_positions(df, keys, columns, lambda n: [F.lit(0.5) * (n - 1)], most, weight, stored)
    wide = found.groupBy(*[F.col(k).alias(f"_q_{k}") for k in keys]).agg(*[F.max(F.when(F.col("m") == name, F.col("quantiles")[0])).alias(name) for name in columns])
    on = F.lit(True)
    for k in keys:
        on = on & _same(k, f"_q_{k}")
    return groups.join(wide, on, "left").drop(*[f"_q_{k}" for k in keys])


def places(df: DataFrame, bucket: str, order: list[Column]) -> DataFrame:
    """Adds ``place``, the 0-based position of a row in its bucket, however large a bucket is.

    Rows are range partitioned by bucket and order and stored; a window sees a partition's part of a
    bucket, and a bucket that goes on in the next partition carries its count over. ``order`` should be a key.
    """
    stored = checkpointed(df.repartitionByRange(F.col(bucket), *order).withColumn("_part", F.spark_partition_id()), "places")
    rows = stored.withColumn("_in", F.row_number().over(Window.partitionBy("_part", bucket).orderBy(*order)) - 1)
    sizes = stored.groupBy("_part", F.col(bucket).alias("_b")).agg(F.count("*").alias("_n"))
    by = Window.partitionBy("_b").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # only buckets that began in an earlier partition: at most one for each partition
    carry = sizes.select(F.col("_part").alias("_p"), "_b", F.sum("_n").over(by).alias("_before")).where(F.col("_before").isNotNull())
    out = rows.join(F.broadcast(carry), (F.col("_part") == F.col("_p")) & _same(bucket, "_b"), "left")
    return out.withColumn("place", (F.col("_in") + F.coalesce("_before", F.lit(0))).cast("long")).drop("_part", "_in", "_p", "_b", "_before")
