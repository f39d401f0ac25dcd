"""Reading and writing of tables, dimensions and feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException


def read_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A parquet table; a path that does not exist is an empty table of the schema."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_json_lines(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """JSON lines; blank lines and lines that are no JSON object are left out, one row for each key."""
    lines = spark.read.text(path).where(F.regexp_like("value", F.lit(r"^\s*\{")))
    # a broken line has no key at all, while a good one without known fields has some
    rows = lines.select(F.from_json("value", schema).alias("_r"), F.expr("json_object_keys(value)").alias("_keys")).where("_keys is not null").select("_r.*")
    return rows.dropDuplicates([key]) if key else rows


def read_snapshots(spark: SparkSession, path: str, schema: T.StructType | str, as_of: str, since_days: int | None = None, ts: str = "scraped_at") -> DataFrame:
    """Snapshots of the last ``since_days`` before ``as_of``; all of them for None, 0 and less."""
    rows = read_table(spark, path, schema)
    if not since_days or since_days <= 0:
        return rows
    return rows.where(F.col(ts) >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(since_days)))


def read_generations(spark: SparkSession, path: str) -> DataFrame:
    """A nested JSON document brand -> model -> [{name, year_from, year_to}] as rows."""
    kind = "map<string, map<string, array<struct<name: string, year_from: int, year_to: int>>>>"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("d"))
    models = doc.select(F.explode("d").alias("brand", "m")).select("brand", F.explode("m").alias("model", "g"))
    return models.select("brand", "model", F.explode("g").alias("x")).select("brand", "model", "x.*")


def write_witness(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_zone_feed(df: DataFrame, path: str, zone: str = "zone") -> None:
    """JSON lines by zone; NaN becomes null, which JSON leaves out."""
    from ..functions.scalars import nan_to_null

    nan_to_null(df).write.mode("overwrite").partitionBy(zone).json(path)


def evolve(df: DataFrame, schema: T.StructType, drop: list[str], json_column: str | None = None, dead_keys: list[str] | None = None) -> DataFrame:
    """Missing columns added as typed nulls, dead columns dropped, dead keys taken out of a JSON column."""
    from ..functions.scalars import ensure_columns

    out = ensure_columns(df.drop(*drop), schema)
    if json_column and dead_keys:
        kept = F.map_filter(F.from_json(json_column, "map<string,string>"), lambda k, _: ~k.isin(*dead_keys))
        out = out.withColumn(json_column, F.when(F.col(json_column).isNotNull(), F.to_json(kept)))
    return out


def evolved(df: DataFrame, version: int, steps: dict[int, dict]) -> tuple[DataFrame, int]:
    """(table, version) after the steps above ``version`` in ascending order; each holds arguments of ``evolve``.

    A table that is up to date comes back as it is.
    """
    for target in sorted(k for k in steps if k > version):
        df, version = evolve(df, **steps[target]), target
    return df, version


def manifest(tables: dict[str, DataFrame], built_at: str) -> DataFrame:
    """A row for each table: name, built_at, rows and bytes of its files, from one scan of the rows for each.

    Bytes are 0 for tables without files. ``signature`` (the same in all rows) is the build time and all bytes.
    """
    spark = next(iter(tables.values())).sparkSession
    out = None
    for name, df in tables.items():
        files = df.inputFiles()
        size = spark.read.format("binaryFile").load(files).select("path", "length").agg(F.sum("length").alias("bytes")) if files else spark.range(1).select(F.lit(0).cast("long").alias("bytes"))
        part = df.agg(F.count("*").alias("n")).join(F.broadcast(size), F.lit(True)).select(F.lit(name).alias("name"), F.lit(built_at).cast("timestamp").alias("built_at"), "n", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))
        out = part if out is None else out.unionByName(part)
    # a row for each table
    total = out.agg(F.concat_ws(":", F.lit(built_at), F.sum("bytes").cast("string")).alias("signature"))
    return out.join(F.broadcast(total), F.lit(True))


def with_deals(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``df`` with rows added or replaced by ``new`` (columns as ``df``; the last of repeated keys is not defined)."""
    return df.join(new.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti").unionByName(new.dropDuplicates([key]))


def with_changes(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``df`` with the known values of ``changes`` (key and some columns) in place of the old ones; unknown keys add nothing."""
    fields = [c for c in changes.columns if c != key]
    new = changes.dropDuplicates([key]).select(F.col(key).alias("_k"), *[F.col(c).alias(f"_new_{c}") for c in fields])
    out = df.join(new, F.col(key) == F.col("_k"), "left")
    return out.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in df.columns])


def without_deals(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``df`` without the keys of ``gone``."""
    return df.join(gone.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")


def stats_history(stats: DataFrame) -> DataFrame:
    """Market statistics of all days, oldest first."""
    return stats.select("brand", "model", "date", "median_price_eur", "avg_price_eur", "min_price_eur", "max_price_eur", "listing_count").orderBy("date", "brand", "model")


def unmatched_listings(df: DataFrame, source: str = "olx") -> DataFrame:
    """Active listings that matched no known model; those without a source come from the first one."""
    return df.where("is_active").withColumn("source", F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit(source)))


def relist_history(events: DataFrame, key: str = "original_olx_id") -> DataFrame:
    """Relist events, newest first."""
    return events.orderBy(F.desc("detected_at"), key)
