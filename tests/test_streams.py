"""Stateful streams over several batches against batch queries, and tables that a stream keeps."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from marketloom.operators.maintain import latest_by, upsert
from marketloom.operators.market import price_dynamics
from marketloom.sources import bucketed
from marketloom.streaming import jobs

START = dt.datetime(2024, 1, 1)
PRICES = "event_id long, listing_id long, price_eur double, scraped_at timestamp"


def put(spark, folder, batches, schema):
    """Each batch becomes one file, read in order of time."""
    os.makedirs(folder, exist_ok=True)
    for k, rows in enumerate(batches):
        part = f"{folder}-part{k}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(part)
        (name,) = [n for n in os.listdir(part) if n.endswith(".parquet")]
        os.rename(f"{part}/{name}", f"{folder}/{k:03d}.parquet")
        os.utime(f"{folder}/{k:03d}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))


def run(df, path, mode):
    seen = []
    query = df.writeStream.outputMode(mode).foreachBatch(lambda x, n: seen.append((n, x.collect()))).option("checkpointLocation", path).trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(seen, key=lambda x: x[0])


def test_dynamics_of_batches_and_late_rows_are_those_of_all_rows(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, k % 5, None if k == 33 else float(rng.randint(80, 120)), START + dt.timedelta(hours=5 * (k // 2))) for k in range(150)]
    # rows swap places within a day, also between batches
    order = sorted(rows, key=lambda r: (r[3] + dt.timedelta(hours=rng.randint(0, 20)), r[0]))
    put(spark, str(tmp_path / "in"), [order[:60], order[60:62], order[62:110], order[110:]], PRICES)
    stream = spark.readStream.schema(PRICES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = {}
    batches = run(jobs.running_dynamics(stream, late="2 days"), str(tmp_path / "state"), "update")
    assert len(batches) >= 4
    for _, out in batches:
        found |= {r.listing_id: r for r in out}
    want = price_dynamics(spark.createDataFrame(rows, PRICES)).collect()
    columns = ["first_price", "latest_price", "n_drops", "max_drop_pct", "drop_velocity", "days_since_drop"]
    assert {k: tuple(r[c] for c in columns) for k, r in found.items()} == {r.listing_id: tuple(r[c] for c in columns) for r in want}
    assert max(r.n_drops for r in want) > 3


def test_silence_is_told_by_timers(spark, tmp_path):
    day = lambda d, h=0: START + dt.timedelta(days=d, hours=h)
    one = [(1, day(d)) for d in (0, 1, 8)]
    two = [(2, day(d)) for d in range(20)]
    # key 3 seems silent after day 1, but a late sighting of day 3 keeps its stretch together
    three = [(3, day(1)), (3, day(5))]
    batches = [one[:2] + two[:3] + three[:1], two[3:5], [(3, day(3)), three[1]], [one[2], *two[5:10]], two[10:14], two[14:], [(2, day(3)), (4, day(19))]]
    put(spark, str(tmp_path / "in"), batches, "id long, at timestamp")
    stream = spark.readStream.schema("id long, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = run(jobs.missed_cycles(stream, "id", "at", 3, "1 day", late="2 days"), str(tmp_path / "state"), "append")
    got = sorted((r.id, r.sightings, r.last_seen_at, r.inactive_from) for _, rows in out for r in rows)
    assert got == [(1, 1, day(8), day(11)), (1, 2, day(1), day(4)), (3, 3, day(5), day(8))]
    # nobody is told twice, and not before the watermark is there
    first = next(n for n, rows in out if any(r.id == 1 for r in rows))
    assert first >= 3
    # the same rows in one batch
    put(spark, str(tmp_path / "all"), [[r for b in batches for r in b]], "id long, at timestamp")
    stream = spark.readStream.schema("id long, at timestamp").parquet(str(tmp_path / "all"))
    again = run(jobs.missed_cycles(stream, "id", "at", 3, "1 day", late="2 days"), str(tmp_path / "again"), "append")
    assert sorted((r.id, r.sightings, r.last_seen_at, r.inactive_from) for _, rows in again for r in rows) == got


TABLE = "k long, price double, posted timestamp"
AS_OF = "2024-06-01 00:00:00"


def size_of(path):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


@pytest.fixture
def stream_batches():
    rng = random.Random(9)
    whole = [(k, float(k), START) for k in range(3000)]
    few = [[(rng.randrange(40) * 50 + b, float(1000 * b + i), START + dt.timedelta(days=b)) for i in range(4)] for b in (1, 2, 3)]
    return [whole, *few, [(5000, None, START + dt.timedelta(days=9)), (7, None, START + dt.timedelta(days=9))]]


def test_tables_of_buckets_are_rewritten_in_part(spark, tmp_path, stream_batches):
    put(spark, str(tmp_path / "in"), stream_batches, TABLE)
    stream = spark.readStream.schema(TABLE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    path = str(tmp_path / "table")
    start = lambda: jobs.upsert_table(stream, path, "k", ["price"], ["posted"], "posted", str(tmp_path / "state"), AS_OF, buckets=32).awaitTermination()
    start()
    schema = jobs.table_schema(stream, "k", ["price"])
    want = spark.createDataFrame([], schema)
    for rows in stream_batches:
        want = spark.createDataFrame(upsert(want, latest_by(spark.createDataFrame(rows, TABLE), "k", [F.col("posted")]), "k", ["price"], AS_OF, "posted").collect(), schema)
    read = lambda **at: sorted(map(tuple, bucketed.read_bucketed(spark, path, schema, **at).collect()))
    assert read() == sorted(map(tuple, want.collect())) and len(read()) == 3001
    assert bucketed.versions(spark, path) == [0, 1, 2, 3, 4]
    # a batch of four keys writes at most four buckets of 32
    sizes = [size_of(f"{path}/data/v={v}") for v in range(5)]
    assert all(s < sizes[0] / 6 for s in sizes[1:])
    assert len(read(version=0)) == 3000 and {len(bucketed.manifest_of(spark, path, v)) for v in range(5)} == {32}

    # broken off between data and manifest: readers see the version before, and the batch is written again
    import shutil

    shutil.rmtree(f"{path}/manifest/v=4")
    assert len(read()) == 3000
    for name in ("commits/4", "commits/.4.crc"):
        if os.path.exists(tmp_path / "state" / name):
            os.remove(tmp_path / "state" / name)
    start()
    assert read() == sorted(map(tuple, want.collect()))
    # a batch that runs again after it was finished changes nothing
    assert not bucketed.rewrite_touched(spark.createDataFrame(stream_batches[1], TABLE), path, "k", schema, lambda old, new: old, 4)

    gone = bucketed.vacuum(spark, path, keep=1)
    assert read() == sorted(map(tuple, want.collect())) and bucketed.versions(spark, path) == [4] and 0 not in gone


def test_a_table_that_is_not_there_is_empty(spark, tmp_path):
    assert bucketed.read_bucketed(spark, str(tmp_path / "none"), "k long").collect() == [] and bucketed.vacuum(spark, str(tmp_path / "none")) == []
