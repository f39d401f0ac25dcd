"""Whole-table maintenance: every function takes tables and returns the new state as a DataFrame.

Nothing is updated in place. Callers write the result to a new folder and swap it in.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..functions.scalars import at, ratio
from ..functions.text import fixed_mileage
from .storage import checkpointed


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str], as_of: str, posted: str = "posted_at") -> DataFrame:
    """Incoming values win unless they are null; seen rows are active again.

    ``posted`` later than a day after ``as_of`` is ignored; last_seen_at is it or ``as_of``. New rows
    get first_seen_at = last_seen_at. ``new`` must hold one row for each key (see ``latest_by``).
    """
    seen = F.coalesce(F.when(F.col(f"_n_{posted}") <= at(as_of) + F.make_dt_interval(F.lit(1)), F.col(f"_n_{posted}")), at(as_of))
    n = new.select(*[F.col(c).alias(f"_n_{c}") for c in (key, *columns, posted)])
    o = old.select(*[F.col(c).alias(f"_o_{c}") for c in (key, *columns, "first_seen_at", "last_seen_at", "is_active", "deactivated_at")])
    j = o.join(n, F.col(f"_o_{key}") == F.col(f"_n_{key}"), "full_outer")
    came = F.col(f"_n_{key}").isNotNull()
    return j.select(
        F.coalesce(f"_n_{key}", f"_o_{key}").alias(key),
        *[F.coalesce(f"_n_{c}", f"_o_{c}").alias(c) for c in columns],
        F.when(F.col(f"_o_{key}").isNull(), seen).otherwise(F.col("_o_first_seen_at")).alias("first_seen_at"),
        F.when(came, seen).otherwise(F.col("_o_last_seen_at")).alias("last_seen_at"),
        F.when(came, True).otherwise(F.col("_o_is_active")).alias("is_active"),
        F.when(~came, F.col("_o_deactivated_at")).alias("deactivated_at"),
    )


def latest_by(df: DataFrame, key: str | list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the last in ``order``."""
    w = Window.partitionBy(key).orderBy(*[c.desc() for c in order])
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def freshness(incoming: DataFrame, latest: DataFrame, key: str, least_change: float = 0.5) -> DataFrame:
    """``key, old_price, new_price, price_changed, write_snapshot`` for refreshed prices.

    A snapshot is due without a last price or when it moved by more than ``least_change``; a null
    price only refreshes; an unknown id does nothing.
    """
    j = incoming.join(latest.select(F.col(key).alias("_k"), F.col("latest_price")), F.col(key) == F.col("_k"), "left")
    known = F.col("_k").isNotNull()
    moved = known & F.col("new_price").isNotNull() & (F.col("latest_price").isNull() | (F.abs(F.col("new_price") - F.col("latest_price")) > least_change))
    changed = F.coalesce(moved & F.col("latest_price").isNotNull(), F.lit(False))
    return j.select(key, F.col("latest_price").alias("old_price"), F.when(known, F.col("new_price")).alias("new_price"), changed.alias("price_changed"), F.coalesce(moved, F.lit(False)).alias("write_snapshot"))


def route(df: DataFrame, known: Column, hash_before: Column, text: str = "description", least_chars: int = 20) -> DataFrame:
    """``text_hash`` and where a row goes: skip, unmatched, store or enrich."""
    hashed = F.md5(F.trim(F.coalesce(F.col(text), F.lit(""))))
    where = (
        F.when(F.col("brand").isNull() & F.col("title").isNull(), "skip")
        .when(F.col("year").isNull(), "unmatched: no_year")
        .when(~known, "unmatched: no_generation_match")
        .when((F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) >= least_chars) & ~hash_before.eqNullSafe(hashed), "enrich")
        .otherwise("store")
    )
    return df.withColumns({"text_hash": hashed, "route": where})


def mark_inactive(df: DataFrame, seen: DataFrame, source: str, as_of: str, key: str = "olx_id", default_source: str = "olx") -> DataFrame:
    """Active rows of a source that were not seen become inactive and sold; nothing seen changes nothing."""
    ids = seen.select(F.col(key).alias("_seen")).distinct()
    any_seen = ids.limit(1).select(F.lit(True).alias("_any"))
    # one row or none
    out = df.join(ids, F.col(key) == F.col("_seen"), "left").join(F.broadcast(any_seen), F.lit(True), "left")
    gone = F.col("is_active") & (F.coalesce("source", F.lit(default_source)) == source) & F.col("_seen").isNull() & F.coalesce("_any", F.lit(False))
    return _deactivate(out, gone, at(as_of)).drop("_seen", "_any")


def _deactivate(df: DataFrame, gone: Column, when: Column) -> DataFrame:
    return df.withColumn("_gone", gone).withColumns(
        {
            "is_active": F.when(F.col("_gone"), False).otherwise(F.col("is_active")),
            "deactivated_at": F.when(F.col("_gone"), when).otherwise(F.col("deactivated_at")),
            "deactivation_reason": F.when(F.col("_gone"), "sold").otherwise(F.col("deactivation_reason")),
        }
    ).drop("_gone")


def _restore(df: DataFrame, back: Column) -> DataFrame:
    return df.withColumn("_back", back).withColumns(
        {
            "is_active": F.when(F.col("_back"), True).otherwise(F.col("is_active")),
            "deactivated_at": F.when(~F.col("_back"), F.col("deactivated_at")),
            "deactivation_reason": F.when(~F.col("_back"), F.col("deactivation_reason")),
        }
    ).drop("_back")


def probe_decision(df: DataFrame, probes: DataFrame, key: str = "olx_id") -> DataFrame:
    """``key, action``: sold if the page is dead, keep if alive, defer if unknown or not probed."""
    p = probes.select(F.col(key).alias("_p"), "status")
    action = F.when(F.col("status") == "dead", "sold").when(F.col("status") == "alive", "keep").otherwise("defer")
    return df.join(p, F.col(key) == F.col("_p"), "left").select(key, action.alias("action"))


def sweep_gate(df: DataFrame, seen: DataFrame, least_active: int = 100, least_share: float = 0.10, key: str = "olx_id") -> DataFrame:
    """``source, active, seen, skip``: a sweep that saw too little of a large source is not trusted."""
    active = df.where("is_active").groupBy(F.coalesce("source", F.lit("olx")).alias("source")).agg(F.count("*").alias("active"))
    found = seen.groupBy(F.coalesce("source", F.lit("olx")).alias("source")).agg(F.countDistinct(key).alias("seen"))
    out = active.join(found, "source", "left").withColumn("seen", F.coalesce("seen", F.lit(0)).cast("long"))
    return out.withColumn("skip", (F.col("active") > least_active) & (F.col("seen") < least_share * F.col("active")))


def revalidate_candidates(df: DataFrame, as_of: str, days: int = 14, most: int = 300, key: str = "olx_id") -> DataFrame:
    """The newest ``most`` sold rows of the last ``days``."""
    rows = df.where(~F.col("is_active") & (F.col("deactivation_reason") == "sold") & (F.col("deactivated_at") >= at(as_of) - F.make_dt_interval(F.lit(days))))
    return rows.orderBy(F.desc("deactivated_at"), key).limit(most)


def revalidate(df: DataFrame, probes: DataFrame, source: str, as_of: str, days: int = 14, most: int = 300, key: str = "olx_id") -> tuple[DataFrame, DataFrame]:
    """(table, one row of checked, restored, still_dead and deferred) after probing the newest sold rows of a source.

    ``probes``: key and alive (true, false or null, which defers). Rows without a source belong to 'olx'.
    """
    own = df.where(F.coalesce("source", F.lit("olx")) == source)
    asked = revalidate_candidates(own, as_of, days, most, key).select(F.col(key).alias("_id"))
    found = asked.join(probes.select(F.col(key).alias("_p"), "alive"), F.col("_id") == F.col("_p"), "left").select("_id", "alive")
    counts = found.agg(F.count("*").alias("checked"), F.count_if("alive").alias("restored"), F.count_if(~F.col("alive")).alias("still_dead"), F.count_if(F.col("alive").isNull()).alias("deferred"))
    # at most ``most`` rows
    out = df.join(F.broadcast(found.where("alive").select("_id", F.lit(True).alias("_back"))), F.col(key) == F.col("_id"), "left")
    return _restore(out, F.coalesce("_back", F.lit(False))).drop("_id", "_back"), counts


def heal_mass_sweeps(df: DataFrame, cutoff: str, threshold: int = 500) -> DataFrame:
    """Restores sold rows of (source, deactivated_at) groups that are too large to be true."""
    swept = df.where(~F.col("is_active") & (F.col("deactivation_reason") == "sold") & (F.col("deactivated_at") < at(cutoff)))
    bad = swept.groupBy("source", "deactivated_at").agg(F.count("*").alias("_n")).where(F.col("_n") > threshold)
    bad = bad.select(F.col("source").alias("_s"), F.col("deactivated_at").alias("_d"), F.lit(True).alias("_bad"))
    out = df.join(bad, F.col("source").eqNullSafe(F.col("_s")) & (F.col("deactivated_at") == F.col("_d")), "left")
    back = F.coalesce(F.col("_bad"), F.lit(False)) & ~F.col("is_active") & (F.coalesce("deactivation_reason", F.lit("")) == "sold")
    return _restore(out, back).drop("_s", "_d", "_bad")


def backfill_deactivated(df: DataFrame) -> DataFrame:
    """Inactive rows without a time get their last sighting, and a reason if they have none."""
    empty = ~F.col("is_active") & F.col("deactivated_at").isNull()
    return df.withColumns({"deactivation_reason": F.when(empty, F.coalesce("deactivation_reason", F.lit("sold"))).otherwise(F.col("deactivation_reason")), "deactivated_at": F.when(empty, F.col("last_seen_at")).otherwise(F.col("deactivated_at"))})


def repair_future_first_seen(df: DataFrame, first_snapshot: DataFrame, as_of: str, key: str = "olx_id") -> DataFrame:
    """A first sighting after ``as_of`` becomes the least usable of first snapshot and last sighting."""
    s = first_snapshot.select(F.col(key).alias("_k"), F.col("first_at").alias("_first"))
    usable = lambda c: F.when(F.col(c) <= at(as_of), F.col(c))
    fixed = F.least(usable("_first"), usable("last_seen_at"))
    out = df.join(s, F.col(key) == F.col("_k"), "left")
    return out.withColumn("first_seen_at", F.when(F.col("first_seen_at") > at(as_of), F.coalesce(fixed, F.col("first_seen_at"))).otherwise(F.col("first_seen_at"))).drop("_k", "_first")


def transitions(old: Column, new: Column, df: DataFrame) -> DataFrame:
    """How often a value became another."""
    return df.select(old.alias("old"), new.alias("new")).where(~F.col("old").eqNullSafe(F.col("new"))).groupBy("old", "new").agg(F.count("*").alias("n"))


BLOCK = ("brand", "model", "year", "district")


def _candidates(df: DataFrame) -> DataFrame:
    rows = df.where(F.col("is_active") & F.col("duplicate_of").isNull() & (F.coalesce("brand", F.lit("")) != "") & (F.coalesce("model", F.lit("")) != "") & F.col("year").isNotNull() & (F.coalesce("mileage_km", F.lit(0)) != 0))
    return rows.withColumns({"brand": F.lower("brand"), "model": F.lower("model"), "district": F.lower(F.coalesce("district", F.lit(""))), "source": F.coalesce("source", F.lit("olx"))})


def cross_source_pairs(df: DataFrame, a: str = "olx", b: str = "sv", tolerance: float = 0.1, key: str = "olx_id") -> DataFrame:
    """Pairs of one block whose mileages, and prices where both are known, are within the tolerance.

    The side seen last is canonical (``a`` on a tie). A mileage band of the tolerance's width is part
    of the join key, so a large block is not compared with itself as a whole.
    """
    rows = _candidates(df)
    width = F.lit(1 + tolerance).try_cast("double")
    band = F.floor(F.log(F.col("mileage_km").cast("double")) / F.log(width)).cast("long")
    keep = [key, *BLOCK, "mileage_km", "price_eur", "last_seen_at"]
    left = rows.where(F.col("source") == b).select(*[F.col(c).alias(f"_b_{c}") for c in keep], F.explode(F.array(band - 2, band - 1, band, band + 1, band + 2)).alias("_band"))
    right = rows.where(F.col("source") == a).select(*[F.col(c).alias(f"_a_{c}") for c in keep], band.alias("_band_a"))
    on = F.col("_band") == F.col("_band_a")
    for c in BLOCK:
        on = on & (F.col(f"_a_{c}") == F.col(f"_b_{c}"))
    km = F.col("_b_mileage_km") / F.col("_a_mileage_km")
    price = ratio(F.nullif(F.col("_b_price_eur"), F.lit(0.0)), F.col("_a_price_eur"))
    near = km.between(1 - tolerance, 1 + tolerance) & F.coalesce(price.between(1 - tolerance, 1 + tolerance), F.lit(True))
    pairs = left.join(right, on).where(near)
    first = F.coalesce(F.col("_a_last_seen_at") >= F.col("_b_last_seen_at"), F.col("_b_last_seen_at").isNull())
    # cells of the b side: its mileage and price bands within the block
    block, step = F.xxhash64(*[f"_a_{c}" for c in BLOCK]), lambda c: F.floor(F.log(F.nullif(F.col(c).cast("double"), F.lit(0.0))) / F.log(width))
    return pairs.select(block.alias("block"), F.xxhash64(block, step("_b_mileage_km"), step("_b_price_eur")).alias("cell"), F.col(f"_a_{key}").alias("a_id"), F.col(f"_b_{key}").alias("b_id"), F.when(first, F.col(f"_a_{key}")).otherwise(F.col(f"_b_{key}")).alias("canonical"))


def first_free(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walks batches of ``block, b_id, a_id`` in that order; a block may go on in the next batch."""
    at, taken, done = None, set(), None
    for batch in batches:
        out = []
        for block, b, a in zip(batch["block"], batch["b_id"], batch["a_id"], strict=True):
            if block != at:
                at, taken, done = block, set(), None
            if b != done and a not in taken:
                taken.add(a)
                done = b
                out.append((a, b))
        yield pd.DataFrame(out, columns=["a_id", "b_id"])


def match_in_blocks(pairs: DataFrame, block: str = "block") -> DataFrame:
    """The exact first-come matching: in each block, every ``b_id`` in order takes its first free ``a_id``.

    A block's pairs are sorted by Spark, which spills, and pass through a task batch by batch; in Python
    only the taken ids of one block are held. One task still walks the pairs of a block, as each match
    depends on those before it.
    """
    rows = pairs.select(F.col(block).alias("block"), "b_id", "a_id").repartition("block").sortWithinPartitions("block", "b_id", "a_id")
    return rows.mapInPandas(first_free, "a_id string, b_id string")


def _first_open(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walks batches of ``slice, b, a, takes, bar`` in order of the first three; a slice may go on in the next batch."""
    at, taken, done = None, set(), None
    for batch in batches:
        out = []
        for part, b, a, takes, bar in zip(batch["slice"], batch["b"], batch["a"], batch["takes"], batch["bar"], strict=True):
            if part != at:
                at, taken, done = part, set(), None
            if b != done and a not in taken and (bar is None or bar >= b):
                if takes:
                    taken.add(a)
                done = b
                out.append((part, b, a, takes))
        yield pd.DataFrame(out, columns=["slice", "b", "a", "takes"])


def first_come_matches(pairs: DataFrame, takes: Column | None = None, cell: str = "cell", slice_pairs: int = 500_000) -> DataFrame:
    """First come, first served over all ``pairs`` (a_id, b_id, cell): in order of b_id, every b takes its least a that is still there.

    A match uses up its a where ``takes`` holds (everywhere by default). What a b gets depends on smaller
    b only. So the b of a cell, or of a slice of a large cell, are served inside one task, which holds
    just the a used up there, while what other slices use up is the state of the round before, joined
    by a. Rounds end when none changes the state; then it is what one walk over all pairs would give.
    Cells may be any grouping of the b (each b has one); those that share few a with others need few rounds.
    """
    rows = pairs.select(cell, F.col("b_id").alias("b"), F.col("a_id").alias("a"), (F.lit(True) if takes is None else takes).alias("takes")).distinct()
    sizes = rows.groupBy(F.col(cell).alias("_cell")).agg(F.ceil(F.count("*") / slice_pairs).alias("_n"))
    rows = rows.join(sizes, F.col(cell) == F.col("_cell")).select(F.xxhash64(cell, F.pmod(F.xxhash64("b"), F.col("_n"))).alias("slice"), "b", "a", "takes")
    rows = checkpointed(rows, "pairs")
    state, seen = None, None
    while True:
        if state is None:
            open_ = rows.withColumn("bar", F.lit(None).cast(rows.schema["b"].dataType))
        else:
            used = state.where("takes").groupBy("a", "slice").agg(F.min("b").alias("b")).groupBy(F.col("a").alias("_a")).agg(F.collect_list(F.struct("slice", "b")).alias("_used"))
            others = F.filter("_used", lambda x: x["slice"] != F.col("slice"))
            bar = F.array_min(F.transform(others, lambda x: x["b"]))
            open_ = rows.join(used, F.col("a") == F.col("_a"), "left").select(*rows.columns, bar.alias("bar"))
        order = ["slice", "b", "a"]
        schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in rows.columns)
        state = checkpointed(open_.repartition("slice").sortWithinPartitions(*order).mapInPandas(_first_open, schema), "matches")
        now = state.agg(F.count("*"), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return state.select(F.col("a").alias("a_id"), F.col("b").alias("b_id"))
        seen = now


#: Rows of a block that one task may hold, and comparisons that it makes together.
BLOCK_ROWS, TOGETHER = 100_000, 1 << 20


def _served(ids: list, side: np.ndarray, km: np.ndarray, price: np.ndarray, known: np.ndarray, seen: np.ndarray, tolerance: float, once: bool) -> Iterator[tuple]:
    """(a, b) of one block whose rows are in order of ``side`` (False: a) and id; rows of one id count as one."""
    n = int(np.searchsorted(side, True))
    if n in (0, len(ids)):
        return
    low, high = 1 - tolerance, 1 + tolerance
    number = np.cumsum([0, *(x != y for x, y in zip(ids[1:n], ids, strict=False))])
    free, step, best = np.ones(n, bool), max(1, TOGETHER // n), None
    for begin in range(n, len(ids), step):
        own = slice(begin, begin + step)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            by_km, by_price = km[own, None] / km[:n], price[own, None] / price[:n]
        near = (by_km >= low) & (by_km <= high) & ((by_price >= low) & (by_price <= high) | ~(known[own, None] & known[:n]))
        for i, row in enumerate(near, begin):
            if best and ids[i] != ids[i - 1]:
                yield ids[best[0]], ids[i - 1]
                if best[1]:
                    free[number == number[best[0]]] = False
                best = None
            k = int((row & free).argmax())
            if row[k] and free[k] and (best is None or k < best[0]):
                best = k, once or seen[i] > seen[k]
    if best:
        yield ids[best[0]], ids[-1]


def _walked_blocks(batches: Iterable[pa.RecordBatch], schema: pa.Schema, tolerance: float, once: bool, most: int) -> Iterator[pa.RecordBatch]:
    """Matches of rows in order of block, side and id; of a block of more than ``most`` rows its name alone. A block may go on in the next batch."""
    block, parts, n = None, [], 0

    def finished() -> Iterator[tuple]:
        if n > most:
            yield None, None, *block
        elif n:
            ids, *rest = zip(*parts, strict=True)
            yield from ((*m, *[None] * len(BLOCK)) for m in _served([x for own in ids for x in own], *map(np.concatenate, rest), tolerance, once))

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(batch.schema.get_field_index(c)) for c in BLOCK]
        name = lambda k: tuple(x[k].as_py() for x in keys)  # noqa: E731, B023
        new = np.zeros(batch.num_rows, bool)
        new[0] = name(0) != block
        for x in keys:
            new[1:] |= pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
        ids, side, km, price, seen = (batch.column(k) for k in range(len(BLOCK), len(BLOCK) + 5))
        known, plain = pc.is_valid(price), lambda x: x.to_numpy(zero_copy_only=False)
        values = [ids.to_pylist(), *map(plain, (side, km, price, known, seen))]
        edges, out = sorted({0, *np.flatnonzero(new).tolist(), batch.num_rows}), []
        for begin, end in zip(edges, edges[1:], strict=False):
            if new[begin]:
                out += finished()
                block, parts, n = name(begin), [], 0
            n += end - begin
            parts = [*parts, [x[begin:end] for x in values]] if n <= most else []
        if out:
            yield packed(out)
    if out := list(finished()):
        yield packed(out)


def block_matches(df: DataFrame, a: str = "olx", b: str = "sv", tolerance: float = 0.1, key: str = "olx_id", once: bool = False, most: int = BLOCK_ROWS) -> DataFrame:
    """``a_id, b_id``: the first-come matches of ``cross_source_pairs``, without its pairs: rows move once, to their block.

    In order of ``b`` ids, every row takes the least ``a`` that is near and still there. It is used up if it was
    seen before (becomes the duplicate), with ``once`` always. A task holds one block of at most ``most`` rows;
    larger blocks are only named by it, and go through pairs and rounds of slices (``first_come_matches``).
    """
    rows = _candidates(df).where(F.col("source").isin(a, b))
    known = F.nullif(F.col("price_eur").cast("double"), F.lit(0.0))
    # an unknown time is before all others
    seen = F.coalesce(F.unix_micros("last_seen_at"), F.lit(-(1 << 62)))
    rows = rows.select(*BLOCK, F.col(key).alias("id"), (F.col("source") == b).alias("side"), F.col("mileage_km").cast("double").alias("km"), known.alias("price"), seen.alias("seen"))
    kind = {"a_id": "id", "b_id": "id"} | {c: c for c in BLOCK}
    schema = ", ".join(f"{c} {rows.schema[own].dataType.simpleString()}" for c, own in kind.items())
    empty = to_arrow_schema(StructType([StructField(c, rows.schema[own].dataType) for c, own in kind.items()]))
    rows = rows.repartition(*BLOCK).sortWithinPartitions(*BLOCK, "side", "id")
    found = checkpointed(rows.mapInArrow(lambda batches: _walked_blocks(batches, empty, tolerance, once, most), schema), "matches")
    matches = found.where(F.col("a_id").isNotNull()).select("a_id", "b_id")
    large = found.where(F.col("a_id").isNull()).select(*BLOCK)
    if large.isEmpty():
        return matches
    # at most one name for ``most`` rows
    pairs = cross_source_pairs(_candidates(df).join(F.broadcast(large), list(BLOCK), "left_semi"), a, b, tolerance, key)
    return matches.unionByName(first_come_matches(pairs, None if once else F.col("canonical") == F.col("b_id")))


def same_source_duplicates(df: DataFrame, tolerance: float = 0.01, key: str = "olx_id") -> DataFrame:
    """``key, duplicate_of``: later rows of a block with the same source and mileage, priced alike.

    The first seen is canonical; both prices must be missing, or within the tolerance.
    """
    w = Window.partitionBy("source", *BLOCK, "mileage_km").orderBy(F.col("first_seen_at").asc_nulls_last(), key)
    rows = _candidates(df).withColumns({"_head": F.first(key).over(w), "_price": F.first("price_eur").over(w), "_k": F.row_number().over(w)})
    alike = (F.col("price_eur").isNull() & F.col("_price").isNull()) | F.coalesce(ratio(F.abs(F.col("price_eur") - F.col("_price")), F.col("_price")) <= tolerance, F.lit(False))
    return rows.where((F.col("_k") > 1) & alike).select(key, F.col("_head").alias("duplicate_of"))


def merge_into_canonical(df: DataFrame, pairs: DataFrame, columns: list[str], key: str = "olx_id") -> DataFrame:
    """Empty fields of canonical rows are filled from their duplicates, the least id first.

    ``pairs``: canonical, duplicate. Null and empty text are empty, on either side.
    """
    text = {f.name for f in df.schema if f.dataType.typeName() == "string"}
    full = lambda c: F.nullif(F.col(c), F.lit("")) if c in text else F.col(c)
    d = df.select(F.col(key).alias("_d"), *[full(c).alias(f"_f_{c}") for c in columns]).join(pairs, F.col("_d") == F.col("duplicate"))
    fill = d.groupBy("canonical").agg(*[F.min_by(f"_f_{c}", F.when(F.col(f"_f_{c}").isNotNull(), F.col("duplicate"))).alias(f"_f_{c}") for c in columns])
    out = df.join(fill, F.col(key) == F.col("canonical"), "left")
    return out.withColumns({c: F.coalesce(full(c), F.col(f"_f_{c}"), F.col(c)) for c in columns}).drop("canonical", *[f"_f_{c}" for c in columns])


def page_saturation(log: DataFrame, share: float = 0.95, run: int = 3) -> DataFrame:
    """Known share of each crawled page, and whether a crawl should have stopped there."""
    w = Window.partitionBy("crawl").orderBy("page")
    pages = log.groupBy("crawl", "page").agg(F.round(F.avg(F.col("known").cast("int")), 6).alias("known_share"))
    full = (F.col("known_share") >= share).cast("int")
    return pages.withColumn("_run", F.sum(full).over(w.rowsBetween(-(run - 1), 0))).withColumn("stop", F.col("_run") >= run).drop("_run")


def photo_backlog(df: DataFrame, extras: str, mode: str = "missing", most: int | None = 500, severity: str = "damage_severity", accident: str = "accident", newest: str = "first_seen_at", key: str = "olx_id") -> DataFrame:
    """Listings whose photos are to be looked at, the most telling first.

    ``mode``: ``missing`` (no photo verdict in the JSON extras), ``undecided`` (a verdict without a
    probability) or ``all``. Severity of 2 and more comes first, then told accidents, then the newest.
    """
    flag, p = (F.get_json_object(extras, f"$.{k}") for k in ("photo_damage", "photo_damage_p"))
    due = {"missing": flag.isNull(), "undecided": flag.isNotNull() & p.isNull(), "all": F.lit(True)}[mode]
    no = lambda c: F.coalesce(c, F.lit(False))
    rows = df.where(due).orderBy(no(F.col(severity) >= 2).desc(), no(F.col(accident)).desc(), F.col(newest).desc_nulls_last(), key)
    return rows if most is None else rows.limit(most)


def photo_count_targets(df: DataFrame) -> DataFrame:
    """Active listings whose photos were never counted."""
    return df.where(F.col("is_active") & F.col("photo_count").isNull())


def mark_expired(df: DataFrame, gone: DataFrame, as_of: str, key: str = "olx_id") -> DataFrame:
    """Listings of ``gone`` that are still active become inactive as expired."""
    out = df.join(gone.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left")
    hit = F.col("_k").isNotNull() & F.col("is_active")
    return out.withColumns(
        {"is_active": F.col("is_active") & ~hit, "deactivated_at": F.when(hit, at(as_of)).otherwise(F.col("deactivated_at")), "deactivation_reason": F.when(hit, "expired").otherwise(F.col("deactivation_reason"))}
    ).drop("_k")


def merge_details(card: DataFrame, detail: DataFrame, key: str, authoritative: list[str], fill: list[str], this_year: int | None = None) -> DataFrame:
    """Detail values overwrite where they are authoritative, fill blanks elsewhere; the title is
    replaced only if the card's holds a price or five digits. Blank is null, empty text and zero. With
    ``this_year`` a mileage_km that lacks its thousands is mended afterwards by the year."""
    d = detail.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_d_{c}") for c in (*authoritative, *fill, "title")])
    out = card.join(d, F.col(key) == F.col("_k"), "left")
    bad_title = F.col("title").contains("€") | F.regexp_like("title", F.lit(r"\d{5}"))
    out = out.withColumns(
        {c: F.coalesce(f"_d_{c}", c) for c in authoritative}
        | {c: F.coalesce(F.when(~F.col(c).cast("string").isin("", "0", "0.0"), F.col(c)), F.col(f"_d_{c}"), F.col(c)) for c in fill}
        | {"title": F.when(F.coalesce(bad_title, F.lit(True)), F.coalesce("_d_title", "title")).otherwise(F.col("title"))}
    ).drop("_k", *[f"_d_{c}" for c in (*authoritative, *fill, "title")])
    return out if this_year is None else out.withColumn("mileage_km", fixed_mileage(F.col("mileage_km"), F.col("year"), this_year))


def keep_last(history: DataFrame, order: str, most: int = 100, key: str | None = None) -> DataFrame:
    """A history cut to its newest rows: at most ``most`` for each key, or ``most`` in all."""
    if key is None:
        return history.orderBy(F.desc(order)).limit(most)
    return history.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_k") <= most).drop("_k")
