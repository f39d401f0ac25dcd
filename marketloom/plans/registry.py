"""Names of queries, with their DataFrames and DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.storage import checkpointed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The listing-like view over the driver's tables, as SQL for the oracle; ``Tables.listings`` builds the same.
LISTINGS_SQL = """listings AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT), strftime(l_shipdate, '%Y%m%d')) AS olx_id,
    p_brand AS brand, p_type AS model, CASE WHEN p_size % 11 <> 0 THEN 'G' || (p_size // 10) END AS generation,
    CAST(year(o_orderdate) AS INT) AS year, l_extendedprice AS price_eur, round(l_extendedprice * (1 + l_discount), 4) AS first_price_eur,
    CAST(l_quantity * 1000 AS INT) AS mileage_km, p_size * 50 AS engine_cc, CAST(round(l_tax * 1000) AS INT) AS horsepower,
    CASE p_partkey % 4 WHEN 0 THEN 'Diesel' WHEN 1 THEN 'Gasolina' WHEN 2 THEN 'Eletrico' END AS fuel_type,
    CASE l_partkey % 2 WHEN 0 THEN 'Manual' ELSE 'Automatic' END AS transmission,
    l_linestatus = 'O' AS is_active,
    CASE WHEN l_linestatus <> 'O' THEN CASE l_returnflag WHEN 'A' THEN 'expired' ELSE 'sold' END END AS deactivation_reason,
    CAST(o_orderdate AS TIMESTAMP) AS first_seen_at,
    CASE WHEN l_linestatus <> 'O' THEN CAST(o_orderdate AS TIMESTAMP) + to_days(CAST((l_partkey * 7 + l_linenumber * 13) % 120 AS INT)) END AS deactivated_at,
    CAST(l_shipdate AS TIMESTAMP) AS last_seen_at, l_suppkey AS seller_uuid, n_name AS district,
    CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 1 THEN 'olx' ELSE 'sv' END AS source,
    p_name AS title, CASE WHEN l_orderkey % 50 = 0 THEN 'dup-' || l_orderkey END AS duplicate_of, l_partkey AS part_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""

#: Price snapshots: events as listings' observed prices.
SNAPSHOTS_SQL = """snapshots AS (
  SELECT event_id, user_id AS listing_id, value AS price_eur, CAST(ts AS TIMESTAMP) AS scraped_at,
    'B' || (user_id % 7) AS brand, 'M' || (user_id % 3) AS model, CASE WHEN user_id % 5 <> 0 THEN 'G' || (user_id % 4) END AS generation,
    event_type, props FROM events)"""

#: The moments that stand for "now".
AS_OF = "2001-12-01 00:00:00"
SNAPSHOT_AS_OF = "2024-01-31 00:00:00"


class Tables:
    """The driver's tables, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def listings(self) -> DataFrame:
        df = self.lineitem.join(self.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(self.part, F.col("l_partkey") == F.col("p_partkey"))
        return self._listings(df.join(self.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(self.nation, F.col("s_nationkey") == F.col("n_nationkey")))

    @cached_property
    def priced_listings(self) -> DataFrame:
        """The same rows with ``order_id`` and ``retail_price``, the least of the part's key.

        Orders are joined last, so rows of an order lie together; an olx_id begins with its order.
        """
        least = F.min(F.struct("p_retailprice")).over(Window.partitionBy("p_partkey"))["p_retailprice"]
        df = self.lineitem.join(self.part.withColumn("_least", least), F.col("l_partkey") == F.col("p_partkey"))
        df = df.join(self.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(self.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        return self._listings(df.join(self.orders, F.col("l_orderkey") == F.col("o_orderkey")), F.col("l_orderkey").alias("order_id"), F.col("_least").alias("retail_price"))

    @staticmethod
    def _listings(df: DataFrame, *more: Column) -> DataFrame:
        active = F.col("l_linestatus") == "O"
        first_seen = F.col("o_orderdate").cast("timestamp")
        days = ((F.col("l_partkey") * 7 + F.col("l_linenumber") * 13) % 120).cast("int")
        key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long"), F.date_format("l_shipdate", "yyyyMMdd"))
        part_kind, source = F.col("p_partkey") % 4, F.col("l_linenumber") % 3
        return df.select(
            key.alias("olx_id"),
            F.col("p_brand").alias("brand"),
            F.col("p_type").alias("model"),
            F.when(F.col("p_size") % 11 != 0, F.concat(F.lit("G"), F.expr("p_size div 10").cast("string"))).alias("generation"),
            F.year("o_orderdate").alias("year"),
            F.col("l_extendedprice").alias("price_eur"),
            F.round(F.col("l_extendedprice") * (1 + F.col("l_discount")), 4).alias("first_price_eur"),
            (F.col("l_quantity") * 1000).cast("int").alias("mileage_km"),
            (F.col("p_size") * 50).alias("engine_cc"),
            F.round(F.col("l_tax") * 1000).cast("int").alias("horsepower"),
            F.when(part_kind == 0, "Diesel").when(part_kind == 1, "Gasolina").when(part_kind == 2, "Eletrico").alias("fuel_type"),
            F.when(F.col("l_partkey") % 2 == 0, "Manual").otherwise("Automatic").alias("transmission"),
            active.alias("is_active"),
            F.when(~active, F.when(F.col("l_returnflag") == "A", "expired").otherwise("sold")).alias("deactivation_reason"),
            first_seen.alias("first_seen_at"),
            F.when(~active, first_seen + F.make_dt_interval(days)).alias("deactivated_at"),
            F.col("l_shipdate").cast("timestamp").alias("last_seen_at"),
            F.col("l_suppkey").alias("seller_uuid"),
            F.col("n_name").alias("district"),
            F.when(source == 1, "olx").when(source == 2, "sv").alias("source"),
            F.col("p_name").alias("title"),
            F.when(F.col("l_orderkey") % 50 == 0, F.concat(F.lit("dup-"), F.col("l_orderkey").cast("string"))).alias("duplicate_of"),
            F.col("l_partkey").alias("part_id"),
            *more,
        )

    @cached_property
    def kept(self) -> Tables:
        """The same tables with the listings stored once: queries that read them several times take only their columns."""
        out = Tables(self.spark, self.sf_dir)
        out.__dict__["listings"] = checkpointed(self.listings, "listings")
        return out

    @cached_property
    def snapshots(self) -> DataFrame:
        user = F.col("user_id")
        named = lambda letter, n: F.concat(F.lit(letter), (user % n).cast("string"))
        return self.events.select(
            "event_id",
            user.alias("listing_id"),
            F.col("value").alias("price_eur"),
            F.col("ts").cast("timestamp").alias("scraped_at"),
            named("B", 7).alias("brand"),
            named("M", 3).alias("model"),
            F.when(user % 5 != 0, named("G", 4)).alias("generation"),
            "event_type",
            "props",
        )


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables``; ``sql`` may use the views listings and snapshots."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            text = sql.strip().replace(":as_of", f"TIMESTAMP '{AS_OF}'").replace(":snap_as_of", f"TIMESTAMP '{SNAPSHOT_AS_OF}'")
            views = [v for k, v in (("listings", LISTINGS_SQL), ("snapshots", SNAPSHOTS_SQL)) if k in text]
            if views:
                recursive = text.lower().startswith("with recursive")
                body = text[len("with recursive") if recursive else 4 :] if text.lower().startswith("with") else None
                text = f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(views) + (f", {body}" if body else f" {text}")
            ORACLE_SQL[name] = text
        return fn

    return register


def load_all() -> None:
    """Import the modules that register queries."""
    from . import decisions, enriching, evaluation, ingest, market, more, pages, pricing, texts  # noqa: F401


load_all()
