"""Structured Streaming jobs over listing and snapshot streams.

Event times must be TIMESTAMP (a TIMESTAMP_NTZ cannot carry a watermark). Every function takes a
streaming DataFrame and returns one, or starts a query; checkpoints belong in a shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.scalars import ratio


def not_from_future(stream: DataFrame, ts: str, slack: str = "1 day", as_of: str | None = None) -> DataFrame:
    """Rows dated over ``slack`` after ``as_of`` (the time of the batch if None) are dropped before any watermark sees them."""
    now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    return stream.where(F.col(ts) <= now + F.expr(f"INTERVAL {slack}"))


def weekly_medians(stream: DataFrame, keys: list[str], price: str, ts: str, late: str = "14 days") -> DataFrame:
    """Exact median and count of each Monday-based week and segment."""
    week = F.window(ts, "7 days", startTime="4 days")
    out = stream.withWatermark(ts, late).groupBy(*keys, week.alias("week")).agg(F.percentile(price, F.lit(0.5)).alias("median"), F.count("*").alias("n"))
    return out.select(*keys, F.col("week.start").alias("week"), "median", "n")


def first_alerts(stream: DataFrame, key: str, ts: str, memory: str = "30 days") -> DataFrame:
    """Each key once within ``memory``."""
    return stream.withWatermark(ts, memory).dropDuplicatesWithinWatermark([key])


def upsert_stream(stream: DataFrame, merge: Callable[[DataFrame, int], None], key: str, order: list[str], checkpoint: str) -> StreamingQuery:
    """Calls ``merge(latest row of each key, batch id)`` for every batch; ``merge`` must tolerate a repeat."""
    from ..operators.maintain import latest_by

    def batch(df: DataFrame, number: int) -> None:
        merge(latest_by(df, key, [F.col(c) for c in order]), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_table(stream: DataFrame, path: str, key: str, columns: list[str], order: list[str], posted: str, checkpoint: str, as_of: str, buckets: int = 64) -> StreamingQuery:
    """Keep a table of listings up to date; each batch rewrites the buckets of the keys that it holds.

    The latest row of a key in a batch is merged by the rules of ``upsert``. A batch is a version of the
    table (see ``sources.bucketed``): one that runs again after it was finished changes nothing, one that
    was broken off is written again.
    """
    from ..operators.maintain import upsert
    from ..sources.bucketed import rewrite_touched

    schema = table_schema(stream, key, columns)

    def merge(latest: DataFrame, number: int) -> None:
        rewrite_touched(latest, path, key, schema, lambda old, new: upsert(old, new, key, columns, as_of, posted), number, buckets)

    return upsert_stream(stream, merge, key, order, checkpoint)


def table_schema(stream: DataFrame, key: str, columns: list[str]) -> str:
    """Columns of the table that ``upsert_table`` keeps."""
    fields = ", ".join(f"{c} {stream.schema[c].dataType.simpleString()}" for c in (key, *columns))
    return f"{fields}, first_seen_at timestamp, last_seen_at timestamp, is_active boolean, deactivated_at timestamp"


#: Fixed value: the state store that keeps large state outside the heap and has timers and lists.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State of this session's streams from now on lies in RocksDB; the operators below need it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


SETTLED = "first_at long, first_price double, last_at long, last_price double, n_drops long, max_drop double, last_drop long"
OPEN = "at long, tie long, price double"
EMPTY = (None, None, None, None, 0, None, None)


def folded(state: tuple, at: np.ndarray, price: np.ndarray) -> tuple:
    """``SETTLED`` after rows in order of time, all later than the state's; a null price is NaN and no drop."""
    if not len(at):
        return state
    first_at, first, last_at, last, drops, most, last_drop = state
    before = np.concatenate([[np.nan if last is None else last], price[:-1]])
    with np.errstate(invalid="ignore"):
        fell = (before > 0) & (price < before)
    known = lambda v: None if np.isnan(v) else float(v)
    if fell.any():
        largest = float(((before[fell] - price[fell]) / before[fell] * 100).max())
        most, drops, last_drop = max(largest, -1.0 if most is None else most), drops + int(fell.sum()), int(at[fell][-1])
    if first_at is None:
        first_at, first = int(at[0]), known(price[0])
    return first_at, first, int(at[-1]), known(price[-1]), drops, most, last_drop


class PriceDynamics(StatefulProcessor):
    """Prices of one key: what the watermark has passed is folded into one short row, newer rows wait in a list.

    A row that comes late, but before the watermark, takes its place among the waiting ones, so the
    result is that of all rows in order. Rows from before the last folded one are left out. A timer
    at the newest waiting row folds the rest.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", SETTLED)
        self.open = handle.getListState("open", OPEN)

    def _fold(self, rows: list[tuple], watermark: int) -> tuple[tuple, tuple]:
        """The settled state and the one with waiting rows, after both are stored."""
        state = tuple(self.settled.get()) if self.settled.exists() else EMPTY
        rows = sorted(r for r in rows if state[2] is None or r[0] >= state[2])
        at, price = np.array([r[0] for r in rows], np.int64), np.array([np.nan if r[2] is None else r[2] for r in rows], float)
        ripe = int(np.searchsorted(at, watermark * 1000, "right"))
        state = folded(state, at[:ripe], price[:ripe])
        if state[0] is not None:
            self.settled.update(state)
        if ripe < len(rows):
            self.open.put(rows[ripe:])
        else:
            self.open.clear()
        return state, folded(state, at[ripe:], price[ripe:])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(r) for r in self.open.get()] if self.open.exists() else []
        for frame in rows:
            new += [(int(a), int(t), None if pd.isna(p) else float(p)) for a, t, p in zip(frame["micros"], frame["tie"], frame["value"], strict=True)]
        _, now = self._fold(new, timerValues.getCurrentWatermarkInMs())
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if self.open.exists():
            self.handle.registerTimer(max(r[0] for r in new) // 1000 + 1)
        if now[0] is not None:
            yield pd.DataFrame({"key": [key[0]], **{c.split()[0]: pd.Series([v], dtype="float64" if c.endswith("double") else "Int64") for c, v in zip(SETTLED.split(", "), now, strict=True)}})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            self._fold([tuple(r) for r in self.open.get()], timerValues.getCurrentWatermarkInMs())
        return iter([])

    def close(self) -> None:
        pass


def running_dynamics(stream: DataFrame, key: str = "listing_id", price: str = "price_eur", ts: str = "scraped_at", tie: str = "event_id", late: str = "1 day") -> DataFrame:
    """Price dynamics of each listing, updated with every batch: the columns of ``market.price_dynamics``.

    Rows may come in any order within ``late``; ties in time are ordered by ``tie`` (a number).
    """
    use_rocksdb(stream.sparkSession)
    rows = stream.withWatermark(ts, late).select(F.col(key).alias("key"), F.col(ts).alias("event_time"), F.unix_micros(ts).alias("micros"), F.col(tie).cast("long").alias("tie"), F.col(price).cast("double").alias("value"))
    kind = stream.schema[key].dataType.simpleString()
    out = rows.groupBy("key").transformWithStateInPandas(PriceDynamics(), f"key {kind}, {SETTLED}", "update", "eventTime")
    span = F.greatest((F.col("last_at") - F.col("first_at")) / 86400e6, F.lit(1.0))
    total = F.greatest(F.lit(0.0), ratio(F.col("first_price") - F.col("last_price"), F.col("first_price")) * 100)
    return out.select(
        F.col("key").alias(key),
        "first_price",
        F.col("last_price").alias("latest_price"),
        "n_drops",
        F.round("max_drop", 1).alias("max_drop_pct"),
        F.round(F.when(F.col("n_drops") > 0, total / span), 3).alias("drop_velocity"),
        F.round((F.col("last_at") - F.col("last_drop")) / 86400e6, 1).alias("days_since_drop"),
    )


class Sightings(StatefulProcessor):
    """The stretches of sightings of one key that silence has not yet ended; a timer tells when it has.

    A stretch ends where ``quiet`` follows without a sighting. Late sightings, while the watermark has
    not passed them, lengthen or join stretches; they put the silence off.
    """

    def __init__(self, quiet_ms: int):
        self.quiet = quiet_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stretches = handle.getListState("stretches", "first long, last long, n long")

    def _keep(self, stretches: list[tuple[int, int, int]]) -> None:
        """Store what is open and set the timer of the first silence."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if stretches:
            self.stretches.put(stretches)
            self.handle.registerTimer(-(-(stretches[0][1] + self.quiet) // 1000))
        else:
            self.stretches.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        found = [tuple(r) for r in self.stretches.get()] if self.stretches.exists() else []
        for frame in rows:
            found += [(t, t, 1) for t in frame["micros"].tolist() if t >= watermark]
        joined: list[tuple[int, int, int]] = []
        for first, last, n in sorted(found):
            if joined and first < joined[-1][1] + self.quiet:
                joined[-1] = (joined[-1][0], max(joined[-1][1], last), joined[-1][2] + n)
            else:
                joined.append((first, last, n))
        self._keep(joined)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(r) for r in self.stretches.get()] if self.stretches.exists() else []
        over = [s for s in held if s[1] + self.quiet <= watermark]
        self._keep(held[len(over) :])
        if over:
            yield pd.DataFrame({"key": [key[0]] * len(over), "sightings": [s[2] for s in over], "last": [s[1] for s in over], "gone": [s[1] + self.quiet for s in over]})

    def close(self) -> None:
        pass


def inactivity(stream: DataFrame, key: str, ts: str, quiet: str = "10 days", late: str = "1 day") -> DataFrame:
    """One row for each stretch of sightings when the watermark has passed ``quiet`` after its last: sightings, last_seen_at, inactive_from.

    Results do not depend on how rows fall into batches, nor on their order within ``late``.
    """
    use_rocksdb(stream.sparkSession)
    n, unit = quiet.split(maxsplit=1)
    ms = int(n) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]
    rows = stream.withWatermark(ts, late).select(F.col(key).alias("key"), F.col(ts).alias("event_time"), F.unix_micros(ts).alias("micros"))
    kind = stream.schema[key].dataType.simpleString()
    out = rows.groupBy("key").transformWithStateInPandas(Sightings(ms), f"key {kind}, sightings long, last long, gone long", "append", "eventTime")
    return out.select(F.col("key").alias(key), "sightings", F.timestamp_micros("last").alias("last_seen_at"), F.timestamp_micros("gone").alias("inactive_from"))


def missed_cycles(stream: DataFrame, key: str, ts: str, cycles: int = 3, cycle: str = "1 day", late: str = "1 day") -> DataFrame:
    """``inactivity`` after ``cycles`` visits of length ``cycle`` in a row without a sighting."""
    n, unit = cycle.split(maxsplit=1)
    return inactivity(stream, key, ts, f"{int(n) * cycles} {unit}", late)
