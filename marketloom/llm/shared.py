"""Places and orderings that all executors agree on."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is missing, as in tests on one machine, a temporary folder is made and set; a
    cluster without the setting is an error, as its machines would each write to a disk of their own.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-marketloom-")
        sc.setCheckpointDir(found)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder; nobody else writes there."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str = "step") -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of one run in a folder of their own, which ``clear`` removes."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.folder, self.n = spark, scratch_path(spark, label), 0

    def saved(self, df: DataFrame, label: str) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n:03d}-{label}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Call when no table of the run will be read again."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, order: Iterable[str], totals: dict[str, Column], label: str = "ranked") -> DataFrame:
    """Gapless global positions and running totals without one global window.

    Rows are range partitioned by ``order`` and stored; each partition is summed (one short row per
    partition), the sums are accumulated and added to per-partition windows. Adds ``_part``,
    ``_pos`` (0-based row number over all rows) and, for each ``name: column`` of ``totals``,
    ``name``: the sum over all earlier rows. ``order`` should be a key; rows equal in it land in one
    partition. Empty input gives no rows.
    """
    order = list(order)
    values = {f"_v_{k}": c.cast("long") for k, c in totals.items()}
    stored = saved(df.withColumns(values).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), label)
    w = Window.partitionBy("_part").orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    sums = stored.groupBy("_part").agg(F.count("*").alias("_t_pos"), *[F.sum(v).alias(f"_t{v}") for v in values])
    parts = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("_part"),
        F.coalesce(F.sum("_t_pos").over(parts), F.lit(0)).alias("_s_pos"),
        *[F.coalesce(F.sum(f"_t{v}").over(parts), F.lit(0)).alias(f"_s{v}") for v in values],
    )
    out = stored.withColumn("_n", F.row_number().over(w) - 1)
    out = out.withColumns({f"_b{v}": F.coalesce(F.sum(v).over(before), F.lit(0)) for v in values})
    # one row for each shuffle partition: bounded by the setting, whatever the data
    out = out.join(F.broadcast(starts), "_part")
    out = out.withColumn("_pos", (F.col("_n") + F.col("_s_pos")).cast("long"))
    out = out.withColumns({k: (F.col(f"_b_v_{k}") + F.col(f"_s_v_{k}")).cast("long") for k in totals})
    return out.drop("_n", "_s_pos", *values, *[f"_b{v}" for v in values], *[f"_s{v}" for v in values])
