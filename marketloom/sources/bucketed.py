"""Tables in buckets by key, of which a change rewrites only what it touches.

``path/data/v=<n>/bucket=<k>`` holds the buckets that version n wrote; ``path/manifest/v=<n>`` holds a
row for every bucket of the table: its number and the version that has it. The manifest is written
last, so a version without a finished manifest does not exist: a reader sees the one before,
and the writer that runs again overwrites its data. Versions are numbered by the caller (a stream's
batches); one that is already there is not written again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.storage import names_in, removed


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions, ascending."""
    found = [n for n in names_in(spark, f"{path}/manifest") if n.startswith("v=")]
    return sorted(int(n[2:]) for n in found if "_SUCCESS" in names_in(spark, f"{path}/manifest/{n}"))


def manifest_of(spark: SparkSession, path: str, version: int | None = None) -> dict[int, int]:
    """bucket -> version of its data; empty without a table. As many entries as there are buckets."""
    done = versions(spark, path)
    at = (done[-1] if done else None) if version is None else version
    if at is None:
        return {}
    rows = spark.read.schema("bucket int, version long").parquet(f"{path}/manifest/v={at}").collect()
    return {r["bucket"]: r["version"] for r in rows}


def read_bucketed(spark: SparkSession, path: str, schema: T.StructType | str, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
    """The table, or some of its buckets; without a table, no rows."""
    held = manifest_of(spark, path, version)
    some = [f"{path}/data/v={v}/bucket={k}" for k, v in sorted(held.items()) if buckets is None or k in buckets]
    return spark.read.schema(schema).parquet(*some) if some else spark.createDataFrame([], schema)


def rewrite_touched(changes: DataFrame, path: str, key: str, schema: T.StructType | str, merge: Callable[[DataFrame, DataFrame], DataFrame], version: int, buckets: int = 64) -> bool:
    """Version ``version`` of the table: ``merge(old rows, changes)`` of the buckets that ``changes`` touch, the others as they are.

    The number of buckets is that of the table's first version. False if the version is there already.
    """
    spark = changes.sparkSession
    done = versions(spark, path)
    if done and done[-1] >= version:
        return False
    held = manifest_of(spark, path)
    n = buckets
    if done:
        n = int(spark.read.text(f"{path}/buckets").first()[0])
    else:
        spark.createDataFrame([(str(buckets),)], "n string").coalesce(1).write.mode("overwrite").text(f"{path}/buckets")
    own = bucket_of(key, n)
    # at most one row for each bucket
    touched = sorted(r[0] for r in changes.select(own.alias("b")).distinct().collect())
    out = merge(read_bucketed(spark, path, schema, touched), changes)
    out.withColumn("bucket", own).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/v={version}")
    written = {int(name[7:]) for name in names_in(spark, f"{path}/data/v={version}") if name.startswith("bucket=")}
    rows = [(k, v) for k, v in held.items() if k not in touched] + [(k, version) for k in sorted(written)]
    spark.createDataFrame(rows, "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v={version}")
    return True


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Remove manifests before the ``keep`` newest and data that no manifest left refers to; the versions whose data went."""
    done = versions(spark, path)
    kept = done[-keep:]
    used = {v for at in kept for v in manifest_of(spark, path, at).values()}
    gone = []
    for at in done[:-keep] if keep else done:
        removed(spark, f"{path}/manifest/v={at}")
        if at not in used:
            removed(spark, f"{path}/data/v={at}")
            gone.append(at)
    return gone
