"""Queries of table maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import at
from ..operators import enrich as n
from ..operators import maintain as b
from .enriching import LATEST_SQL
from .registry import AS_OF, Tables, query


def stock(t: Tables) -> DataFrame:
    """Orders as a table of listings with a unique key."""
    k = F.col("o_orderkey")
    return t.orders.select(
        k.alias("olx_id"),
        F.when(k % 7 != 0, F.col("o_orderstatus")).alias("brand"),
        F.col("o_totalprice").alias("price_eur"),
        F.col("o_orderdate").cast("timestamp").alias("first_seen_at"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval((k % 90).cast("int"))).alias("last_seen_at"),
        (k % 3 == 0).alias("is_active"),
        F.when(k % 3 != 0, F.to_timestamp(F.lit("1998-01-01")) + F.make_dt_interval((k % 40).cast("int"))).alias("deactivated_at"),
        F.when(k % 3 != 0, F.when(k % 5 == 0, "expired").otherwise("sold")).alias("deactivation_reason"),
        F.when(k % 4 == 1, "olx").when(k % 4 == 2, "sv").alias("source"),
    )


STOCK_SQL = """stock AS (SELECT o_orderkey AS olx_id, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS brand, o_totalprice AS price_eur, o_orderdate::TIMESTAMP AS first_seen_at,
   o_orderdate::TIMESTAMP + to_days(CAST(o_orderkey % 90 AS INT)) AS last_seen_at, o_orderkey % 3 = 0 AS is_active,
   CASE WHEN o_orderkey % 3 <> 0 THEN TIMESTAMP '1998-01-01' + to_days(CAST(o_orderkey % 40 AS INT)) END AS deactivated_at,
   CASE WHEN o_orderkey % 3 <> 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'expired' ELSE 'sold' END END AS deactivation_reason,
   CASE o_orderkey % 4 WHEN 1 THEN 'olx' WHEN 2 THEN 'sv' END AS source FROM orders)"""


def arrivals(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    moved = F.when(k % 10 == 0, k + 10_000_000).otherwise(k)
    return t.orders.where("o_orderkey % 5 = 0").select(
        moved.alias("olx_id"), F.when(k % 2 == 0, "N").alias("brand"), F.when(k % 3 != 0, F.round(F.col("o_totalprice") * 2, 2)).alias("price_eur"), (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(F.lit(400))).alias("posted_at")
    )


ARRIVALS_SQL = """arrivals AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey + 10000000 ELSE o_orderkey END AS olx_id, CASE WHEN o_orderkey % 2 = 0 THEN 'N' END AS brand,
   CASE WHEN o_orderkey % 3 <> 0 THEN round(o_totalprice * 2, 2) END AS price_eur, o_orderdate::TIMESTAMP + INTERVAL 400 DAY AS posted_at FROM orders WHERE o_orderkey % 5 = 0)"""


@query(
    "b01_upsert",
    f"""WITH {STOCK_SQL}, {ARRIVALS_SQL}, n AS (SELECT *, coalesce(CASE WHEN posted_at <= :as_of + INTERVAL 1 DAY THEN posted_at END, :as_of) AS seen FROM arrivals)
    SELECT coalesce(n.olx_id, o.olx_id) AS olx_id, coalesce(n.brand, o.brand) AS brand, coalesce(n.price_eur, o.price_eur) AS price_eur,
    CASE WHEN o.olx_id IS NULL THEN seen ELSE o.first_seen_at END AS first_seen_at, CASE WHEN n.olx_id IS NOT NULL THEN seen ELSE o.last_seen_at END AS last_seen_at,
    CASE WHEN n.olx_id IS NOT NULL THEN true ELSE o.is_active END AS is_active, CASE WHEN n.olx_id IS NULL THEN o.deactivated_at END AS deactivated_at
    FROM stock o FULL OUTER JOIN n ON o.olx_id = n.olx_id""",
)
def _(t: Tables) -> DataFrame:
    return b.upsert(stock(t), arrivals(t), "olx_id", ["brand", "price_eur"], AS_OF)


@query(
    "b02_unmatched_upsert",
    f"""WITH {STOCK_SQL}, {ARRIVALS_SQL}, old AS (SELECT * FROM stock WHERE brand IS NULL), n AS (SELECT * FROM arrivals WHERE brand IS NULL)
    SELECT coalesce(n.olx_id, o.olx_id) AS olx_id, coalesce(n.price_eur, o.price_eur) AS price_eur, CASE WHEN n.olx_id IS NOT NULL THEN true ELSE o.is_active END AS is_active
    FROM old o FULL OUTER JOIN n ON o.olx_id = n.olx_id""",
)
def _(t: Tables) -> DataFrame:
    return b.upsert(stock(t).where("brand IS NULL"), arrivals(t).where("brand IS NULL"), "olx_id", ["price_eur"], AS_OF).select("olx_id", "price_eur", "is_active")


@query("b03_snapshot_append", "SELECT event_type, count(*) AS n FROM (SELECT * FROM snapshots UNION ALL SELECT * FROM snapshots WHERE price_eur > 50) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.snapshots.unionByName(t.snapshots.where("price_eur > 50")).groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "b04_freshness",
    f"""WITH {LATEST_SQL}, inc AS (SELECT c_custkey AS listing_id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE abs(c_acctbal) END AS p FROM customer)
    SELECT i.listing_id, latest_price AS old_price, CASE WHEN l.listing_id IS NOT NULL THEN p END AS new_price,
    coalesce(l.listing_id IS NOT NULL AND p IS NOT NULL AND latest_price IS NOT NULL AND abs(p - latest_price) > 0.5, false) AS price_changed,
    coalesce(l.listing_id IS NOT NULL AND p IS NOT NULL AND (latest_price IS NULL OR abs(p - latest_price) > 0.5), false) AS write_snapshot
    FROM inc i LEFT JOIN latest l USING (listing_id)""",
)
def _(t: Tables) -> DataFrame:
    incoming = t.customer.select(F.col("c_custkey").alias("listing_id"), F.when(F.col("c_custkey") % 3 != 0, F.abs("c_acctbal")).alias("new_price"))
    return b.freshness(incoming, n.latest_price(t.snapshots), "listing_id")


@query(
    "b05_ingest_routing",
    """SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'skip' WHEN doc_id % 7 = 0 THEN 'unmatched: no_year' WHEN lang NOT IN ('en', 'fr') THEN 'unmatched: no_generation_match'
      WHEN length(trim(text)) >= 20 AND doc_id % 4 <> 0 THEN 'enrich' ELSE 'store' END AS route FROM documents""",
)
def _(t: Tables) -> DataFrame:
    return routed(t).select("doc_id", "route")


def routed(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    rows = t.documents.select("doc_id", "lang", F.col("text").alias("description"), F.when(k % 9 != 0, F.col("source")).alias("brand"), F.when(k % 9 != 0, F.col("lang")).alias("title"), F.when(k % 7 != 0, 2000).alias("year"))
    return b.route(rows, F.col("lang").isin("en", "fr"), F.when(k % 4 == 0, F.md5(F.trim("description"))))


@query("b06_drop_no_photos", "SELECT p_partkey, p_size FROM part WHERE CASE WHEN p_size % 5 <> 0 THEN p_size % 4 END IS DISTINCT FROM 0")
def _(t: Tables) -> DataFrame:
    photos = F.when(F.col("p_size") % 5 != 0, F.col("p_size") % 4)
    return t.part.where(~photos.eqNullSafe(F.lit(0))).select("p_partkey", "p_size")


@query("b07_change_detection", "SELECT doc_id, md5(trim(text)) AS text_hash, md5(trim(text)) IS DISTINCT FROM CASE WHEN doc_id % 4 = 0 THEN md5(trim(text)) END AS changed FROM documents")
def _(t: Tables) -> DataFrame:
    before = F.when(F.col("doc_id") % 4 == 0, F.col("text_hash"))
    return routed(t).select("doc_id", "text_hash", (~F.col("text_hash").eqNullSafe(before)).alias("changed"))


@query(
    "b08_enrichment_backlog",
    """SELECT event_id, json_extract_string(props, '$.k') IS NULL AS fresh, m.low FROM events JOIN (SELECT user_id, min(value) AS low FROM events GROUP BY 1) m USING (user_id)
    WHERE json_extract_string(props, '$.k') IS NULL OR json_extract_string(props, '$.missing') IS NULL AND CAST(json_extract_string(props, '$.k') AS INT) % 3 = 0""",
)
def _(t: Tables) -> DataFrame:
    low = t.events.groupBy("user_id").agg(F.min("value").alias("low"))
    k = F.get_json_object("props", "$.k")
    due = k.isNull() | (F.get_json_object("props", "$.missing").isNull() & (k.try_cast("int") % 3 == 0))
    return t.events.where(due).join(low, "user_id").select("event_id", k.isNull().alias("fresh"), "low").orderBy(F.col("low").asc_nulls_last(), "event_id")


BACKLOG_SQL = """flagged AS (SELECT olx_id, first_seen_at, CASE WHEN part_id % 3 > 0 THEN CASE WHEN part_id % 5 = 0 THEN '{"photo_damage":true}' ELSE '{"photo_damage":true,"photo_damage_p":0.5}' END END AS extras, part_id % 4 AS severity, CASE WHEN part_id % 7 > 0 THEN part_id % 2 = 0 END AS accident FROM listings)"""


def backlog_query(mode: str, condition: str):
    @query(
        f"b09_photo_backlog_{mode}",
        f"WITH {BACKLOG_SQL} SELECT olx_id, severity, first_seen_at FROM flagged WHERE {condition} ORDER BY severity >= 2 DESC, coalesce(accident, false) DESC, first_seen_at DESC, olx_id LIMIT 500",
    )
    def _(t: Tables) -> DataFrame:
        k = F.col("part_id")
        extras = F.when(k % 3 > 0, F.when(k % 5 == 0, '{"photo_damage":true}').otherwise('{"photo_damage":true,"photo_damage_p":0.5}'))
        rows = t.listings.select("olx_id", "first_seen_at", extras.alias("extras"), (k % 4).alias("severity"), F.when(k % 7 > 0, k % 2 == 0).alias("accident"))
        return b.photo_backlog(rows, "extras", mode, severity="severity").select("olx_id", "severity", "first_seen_at")


for _mode, _condition in (("missing", "extras IS NULL"), ("undecided", "extras = '{\"photo_damage\":true}'"), ("all", "true")):
    backlog_query(_mode, _condition)


INACTIVE = "o.is_active AND coalesce(o.source, 'olx') = 'olx' AND s.olx_id IS NULL"


@query(
    "b10_mark_inactive",
    f"""WITH {STOCK_SQL}, seen AS (SELECT olx_id FROM stock WHERE olx_id % 5 < 3) SELECT o.olx_id, CASE WHEN {INACTIVE} THEN false ELSE o.is_active END AS is_active,
    CASE WHEN {INACTIVE} THEN :as_of ELSE deactivated_at END AS deactivated_at, CASE WHEN {INACTIVE} THEN 'sold' ELSE deactivation_reason END AS deactivation_reason
    FROM stock o LEFT JOIN seen s ON o.olx_id = s.olx_id""",
)
def _(t: Tables) -> DataFrame:
    out = b.mark_inactive(stock(t), stock(t).where("olx_id % 5 < 3"), "olx", AS_OF)
    return out.select("olx_id", "is_active", "deactivated_at", "deactivation_reason")


@query("b11_probe_decision", f"WITH {STOCK_SQL} SELECT olx_id, CASE olx_id % 4 WHEN 0 THEN 'sold' WHEN 1 THEN 'keep' ELSE 'defer' END AS action FROM stock WHERE is_active")
def _(t: Tables) -> DataFrame:
    probes = stock(t).where("olx_id % 4 < 3").select("olx_id", F.when(F.col("olx_id") % 4 == 0, "dead").when(F.col("olx_id") % 4 == 1, "alive").otherwise("unknown").alias("status"))
    return b.probe_decision(stock(t).where("is_active"), probes)


@query(
    "b12_sweep_gate",
    f"""WITH {STOCK_SQL}, a AS (SELECT coalesce(source, 'olx') AS source, count(*) AS active FROM stock WHERE is_active GROUP BY 1),
    s AS (SELECT coalesce(source, 'olx') AS source, count(DISTINCT olx_id) AS seen FROM stock WHERE olx_id % 50 = 1 GROUP BY 1)
    SELECT source, active, coalesce(seen, 0) AS seen, active > 100 AND coalesce(seen, 0) < 0.1 * active AS skip FROM a LEFT JOIN s USING (source)""",
)
def _(t: Tables) -> DataFrame:
    return b.sweep_gate(stock(t), stock(t).where("olx_id % 50 = 1"))


@query(
    "b13_revalidate",
    f"""WITH {STOCK_SQL} SELECT olx_id, deactivated_at FROM stock WHERE NOT is_active AND deactivation_reason = 'sold' AND deactivated_at >= TIMESTAMP '1998-02-05' - INTERVAL 14 DAY
    ORDER BY deactivated_at DESC, olx_id LIMIT 300""",
)
def _(t: Tables) -> DataFrame:
    return b.revalidate_candidates(stock(t), "1998-02-05 00:00:00").select("olx_id", "deactivated_at")


@query(
    "b14_heal_mass_sweeps",
    f"""WITH {STOCK_SQL}, bad AS (SELECT source, deactivated_at FROM stock WHERE NOT is_active AND deactivation_reason = 'sold' AND deactivated_at < TIMESTAMP '1998-01-30' GROUP BY 1, 2 HAVING count(*) > 60),
    m AS (SELECT o.*, bad.deactivated_at IS NOT NULL AND NOT is_active AND deactivation_reason = 'sold' AS back FROM stock o LEFT JOIN bad ON o.source IS NOT DISTINCT FROM bad.source AND o.deactivated_at = bad.deactivated_at)
    SELECT olx_id, is_active OR back AS is_active, CASE WHEN NOT back THEN deactivated_at END AS deactivated_at, CASE WHEN NOT back THEN deactivation_reason END AS deactivation_reason FROM m""",
)
def _(t: Tables) -> DataFrame:
    return b.heal_mass_sweeps(stock(t), "1998-01-30 00:00:00", 60).select("olx_id", "is_active", "deactivated_at", "deactivation_reason")


@query(
    "b15_backfill_deactivated",
    f"""WITH {STOCK_SQL}, g AS (SELECT * EXCLUDE (deactivated_at), CASE WHEN olx_id % 2 = 0 THEN deactivated_at END AS deactivated_at FROM stock)
    SELECT olx_id, CASE WHEN NOT is_active AND deactivated_at IS NULL THEN last_seen_at ELSE deactivated_at END AS deactivated_at FROM g""",
)
def _(t: Tables) -> DataFrame:
    gaps = stock(t).withColumn("deactivated_at", F.when(F.col("olx_id") % 2 == 0, F.col("deactivated_at")))
    return b.backfill_deactivated(gaps).select("olx_id", "deactivated_at")


@query(
    "b16_future_first_seen",
    f"""WITH {STOCK_SQL}, s AS (SELECT user_id AS olx_id, TIMESTAMP '1999-01-01' + to_days(CAST(min(event_id) AS INT)) AS first_at FROM events GROUP BY 1)
    SELECT o.olx_id, CASE WHEN first_seen_at > TIMESTAMP '1999-06-01' THEN coalesce(least(CASE WHEN first_at <= TIMESTAMP '1999-06-01' THEN first_at END,
      CASE WHEN last_seen_at <= TIMESTAMP '1999-06-01' THEN last_seen_at END), first_seen_at) ELSE first_seen_at END AS first_seen_at FROM stock o LEFT JOIN s USING (olx_id)""",
)
def _(t: Tables) -> DataFrame:
    first = t.events.groupBy(F.col("user_id").alias("olx_id")).agg((at("1999-01-01 00:00:00") + F.make_dt_interval(F.min("event_id").cast("int"))).alias("first_at"))
    return b.repair_future_first_seen(stock(t), first, "1999-06-01 00:00:00").select("olx_id", "first_seen_at")


@query(
    "b17_brand_transitions",
    """WITH s AS (SELECT CASE l_partkey % 5 WHEN 0 THEN 'VW' WHEN 1 THEN ' skoda' WHEN 2 THEN 'Renault' WHEN 3 THEN 'alfa-romeo' END AS old FROM lineitem),
    r AS (SELECT old, CASE old WHEN 'VW' THEN 'Volkswagen' WHEN ' skoda' THEN 'Skoda' WHEN 'alfa-romeo' THEN 'Alfa Romeo' ELSE coalesce(old, '') END AS new FROM s) SELECT old, new, count(*) AS n FROM r WHERE old IS DISTINCT FROM new GROUP BY 1, 2""",
)
def _(t: Tables) -> DataFrame:
    from ..functions.text import canonical_brand

    k = F.col("l_partkey") % 5
    old = F.when(k == 0, "VW").when(k == 1, " skoda").when(k == 2, "Renault").when(k == 3, "alfa-romeo")
    return b.transitions(old, canonical_brand(old), t.lineitem)


BLOCKED_SQL = """blocked AS (SELECT olx_id, lower(brand) AS brand, lower(model) AS model, year, lower(coalesce(district, '')) AS district, mileage_km, price_eur, last_seen_at, first_seen_at, coalesce(source, 'olx') AS source
   FROM listings WHERE is_active AND duplicate_of IS NULL AND mileage_km <> 0)"""
PAIRS_SQL = f"""{BLOCKED_SQL}, pairs AS (SELECT a.olx_id AS a_id, b.olx_id AS b_id, CASE WHEN a.last_seen_at >= b.last_seen_at THEN a.olx_id ELSE b.olx_id END AS canonical FROM blocked a JOIN blocked b
   ON a.brand = b.brand AND a.model = b.model AND a.year = b.year AND a.district = b.district AND a.source = 'olx' AND b.source = 'sv'
   AND b.mileage_km / a.mileage_km BETWEEN 0.9 AND 1.1::DOUBLE AND coalesce(b.price_eur / nullif(a.price_eur, 0) BETWEEN 0.9 AND 1.1::DOUBLE, true))"""


@query("b19_cross_source_pairs", f"WITH {PAIRS_SQL} SELECT * FROM pairs")
def _(t: Tables) -> DataFrame:
    return b.cross_source_pairs(t.listings).select("a_id", "b_id", "canonical")


@query("d11_band_pairs", f"WITH {PAIRS_SQL} SELECT b_id, count(*) AS n FROM pairs GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return b.cross_source_pairs(t.listings).groupBy("b_id").agg(F.count("*").alias("n"))


@query(
    "b19_greedy_matches",
    f"""WITH RECURSIVE {PAIRS_SQL}, o AS (SELECT s.brand, s.model, s.year, s.district, b_id, list({{'a': a_id, 't': canonical = b_id}} ORDER BY a_id) AS c,
      row_number() OVER (PARTITION BY s.brand, s.model, s.year, s.district ORDER BY b_id) AS k FROM pairs JOIN blocked s ON s.olx_id = b_id GROUP BY 1, 2, 3, 4, 5),
    walk AS (SELECT DISTINCT brand, model, year, district, 0::BIGINT AS k, NULL::VARCHAR AS b_id, NULL::STRUCT(a VARCHAR, t BOOLEAN) AS pick, []::VARCHAR[] AS used FROM o
      UNION ALL SELECT o.brand, o.model, o.year, o.district, o.k, o.b_id, list_filter(c, lambda x: NOT list_contains(used, x.a))[1],
        CASE WHEN (list_filter(c, lambda x: NOT list_contains(used, x.a))[1]).t THEN list_append(used, (list_filter(c, lambda x: NOT list_contains(used, x.a))[1]).a) ELSE used END
      FROM walk w JOIN o ON o.brand = w.brand AND o.model = w.model AND o.year = w.year AND o.district = w.district AND o.k = w.k + 1)
    SELECT pick.a AS a_id, b_id FROM walk WHERE pick IS NOT NULL""",
)
def _(t: Tables) -> DataFrame:
    """A later match may have the same OLX row again, unless that row became the duplicate."""
    return b.block_matches(t.listings)


@query(
    "b19_matches_of_one_use",
    f"""WITH RECURSIVE {PAIRS_SQL}, o AS (SELECT s.brand, s.model, s.year, s.district, b_id, list(a_id ORDER BY a_id) AS c,
      row_number() OVER (PARTITION BY s.brand, s.model, s.year, s.district ORDER BY b_id) AS k FROM pairs JOIN blocked s ON s.olx_id = b_id GROUP BY 1, 2, 3, 4, 5),
    walk AS (SELECT DISTINCT brand, model, year, district, 0::BIGINT AS k, NULL::VARCHAR AS b_id, NULL::VARCHAR AS a, []::VARCHAR[] AS used FROM o
      UNION ALL SELECT o.brand, o.model, o.year, o.district, o.k, o.b_id, list_filter(c, lambda x: NOT list_contains(used, x))[1], list_append(used, list_filter(c, lambda x: NOT list_contains(used, x))[1])
      FROM walk w JOIN o ON o.brand = w.brand AND o.model = w.model AND o.year = w.year AND o.district = w.district AND o.k = w.k + 1)
    SELECT a AS a_id, b_id FROM walk WHERE a IS NOT NULL""",
)
def _(t: Tables) -> DataFrame:
    """The matching in which every row is used once, by one walk through each block."""
    return b.block_matches(t.listings, once=True)


@query(
    "b20_same_source_duplicates",
    f"""WITH {BLOCKED_SQL}, w AS (SELECT *, first_value(olx_id) OVER x AS head, first_value(price_eur) OVER x AS p, row_number() OVER x AS k FROM blocked
      WINDOW x AS (PARTITION BY source, brand, model, year, district, mileage_km ORDER BY first_seen_at NULLS LAST, olx_id))
    SELECT olx_id, head AS duplicate_of FROM w WHERE k > 1 AND abs(price_eur - p) / p <= 0.6""",
)
def _(t: Tables) -> DataFrame:
    return b.same_source_duplicates(t.listings, 0.6)


@query(
    "b21_merge_canonical",
    f"""WITH {STOCK_SQL}, s AS (SELECT olx_id, CASE WHEN olx_id % 9 = 3 THEN '' WHEN olx_id % 9 = 4 THEN NULL ELSE coalesce(brand, '') END AS brand, CASE WHEN olx_id % 4 > 0 THEN price_eur END AS price_eur FROM stock),
    p AS (SELECT olx_id - olx_id % 3 AS canonical, olx_id AS duplicate FROM s WHERE olx_id % 3 <> 0),
    f AS (SELECT canonical, arg_min(brand, duplicate) FILTER (brand <> '') AS b, arg_min(price_eur, duplicate) FILTER (price_eur IS NOT NULL) AS p FROM p JOIN s ON s.olx_id = p.duplicate GROUP BY 1)
    SELECT olx_id, CASE WHEN brand IS NULL OR brand = '' THEN coalesce(b, brand) ELSE brand END AS brand, coalesce(price_eur, p) AS price_eur FROM s LEFT JOIN f ON olx_id = canonical""",
)
def _(t: Tables) -> DataFrame:
    k = F.col("olx_id")
    brand = F.when(k % 9 == 3, "").when(k % 9 == 4, None).otherwise(F.coalesce("brand", F.lit("")))
    rows = stock(t).select("olx_id", brand.alias("brand"), F.when(k % 4 > 0, F.col("price_eur")).alias("price_eur"))
    pairs = rows.where(k % 3 != 0).select((k - k % 3).alias("canonical"), k.alias("duplicate"))
    return b.merge_into_canonical(rows, pairs, ["brand", "price_eur"])


@query("b22_duplicate_ids", "SELECT DISTINCT olx_id FROM listings WHERE duplicate_of IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return t.listings.where("duplicate_of IS NOT NULL").select("olx_id").distinct()


@query(
    "b24_seller_targets",
    f"""SELECT DISTINCT s_suppkey AS uuid FROM supplier WHERE s_suppkey % 6 = 0 OR s_suppkey % 30 > 14 ORDER BY 1 LIMIT 500""",
)
def _(t: Tables) -> DataFrame:
    fetched = F.when(F.col("s_suppkey") % 6 != 0, at(AS_OF) - F.make_dt_interval((F.col("s_suppkey") % 30).cast("int")))
    stale = t.supplier.withColumn("fetched_at", fetched).where(F.col("fetched_at").isNull() | (F.col("fetched_at") < at(AS_OF) - F.make_dt_interval(F.lit(14))))
    return stale.select(F.col("s_suppkey").alias("uuid")).distinct().orderBy("uuid").limit(500)


@query("b25_seller_upsert", "SELECT user_id AS uuid, arg_max(event_type, event_id) AS last_type, max(event_id) AS version FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    last = b.latest_by(t.events, "user_id", [F.col("event_id")])
    return last.select(F.col("user_id").alias("uuid"), F.col("event_type").alias("last_type"), F.col("event_id").alias("version"))


@query(
    "b26_link_sellers",
    f"WITH {STOCK_SQL} SELECT olx_id, coalesce(CASE WHEN olx_id % 2 = 0 THEN olx_id % 100 END, s_suppkey) AS seller FROM stock LEFT JOIN supplier ON s_suppkey = olx_id % 150",
)
def _(t: Tables) -> DataFrame:
    rows = stock(t).withColumn("_own", F.when(F.col("olx_id") % 2 == 0, F.col("olx_id") % 100))
    return rows.join(t.supplier, F.col("s_suppkey") == F.col("olx_id") % 150, "left").select("olx_id", F.coalesce("_own", "s_suppkey").alias("seller"))


@query(
    "b27_mark_expired",
    f"""WITH {STOCK_SQL} SELECT olx_id, is_active AND olx_id % 9 > 0 AS is_active, CASE WHEN is_active AND olx_id % 9 = 0 THEN TIMESTAMP '2001-12-01' ELSE deactivated_at END AS deactivated_at, CASE WHEN is_active AND olx_id % 9 = 0 THEN 'expired' ELSE deactivation_reason END AS deactivation_reason FROM stock""",
)
def _(t: Tables) -> DataFrame:
    gone = t.orders.where("o_orderkey % 9 = 0").select(F.col("o_orderkey").alias("olx_id"))
    return b.mark_expired(stock(t), gone, "2001-12-01 00:00:00").select("olx_id", "is_active", "deactivated_at", "deactivation_reason")


@query("b27_photo_count_targets", f"WITH {STOCK_SQL} SELECT olx_id FROM stock WHERE is_active AND olx_id % 4 <> 0")
def _(t: Tables) -> DataFrame:
    rows = stock(t).withColumn("photo_count", F.when(F.col("olx_id") % 4 == 0, 3))
    return b.photo_count_targets(rows).select("olx_id")


@query(
    "b28_stats_incremental",
    """SELECT brand, model, CAST(scraped_at AS DATE) AS date, median(price_eur) AS median_price_eur, count(*) AS listing_count FROM snapshots s
    WHERE (brand, model) IN (SELECT brand, model FROM snapshots WHERE event_type = 'purchase' AND price_eur > 300) GROUP BY 1, 2, 3""",
)
def _(t: Tables) -> DataFrame:
    from ..operators.market import daily_market_stats

    changed = t.snapshots.where("event_type = 'purchase' AND price_eur > 300").select("brand", "model").distinct()
    stats = daily_market_stats(t.snapshots.join(changed, ["brand", "model"], "left_semi"))
    return stats.select("brand", "model", "date", "median_price_eur", "listing_count")


@query(
    "b29_page_saturation",
    """WITH p AS (SELECT user_id AS crawl, event_id // 500 AS page, round(avg((event_id % 5 > 0)::INT), 6) AS known_share FROM events GROUP BY 1, 2)
    SELECT *, sum((known_share >= 0.8)::INT) OVER (PARTITION BY crawl ORDER BY page ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 3 AS stop FROM p""",
)
def _(t: Tables) -> DataFrame:
    log = t.events.select(F.col("user_id").alias("crawl"), F.expr("event_id div 500").alias("page"), (F.col("event_id") % 5 > 0).alias("known"))
    return b.page_saturation(log, 0.8)


@query(
    "b30_merge_details",
    """WITH c AS (SELECT p_partkey AS olx_id, p_retailprice AS price_eur, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE p_brand END AS brand, p_size % 5 AS doors, CASE WHEN p_partkey % 3 = 0 THEN 'BMW 5.500 €' WHEN p_partkey % 3 = 1 THEN 'BMW 20129.000' ELSE 'BMW 320' END AS title, p_size * 40 AS mileage_km, 2000 + p_partkey % 20 AS year FROM part),
    d AS (SELECT olx_id, CASE WHEN olx_id % 2 = 0 THEN price_eur * 2 END AS price_eur, 'D' AS brand, 4 AS doors, 'detail ' || olx_id AS title, CASE WHEN olx_id % 6 = 0 THEN 150 END AS mileage_km, year FROM c WHERE olx_id % 5 > 0),
    m AS (SELECT c.olx_id, coalesce(d.price_eur, c.price_eur) AS price_eur, CASE WHEN coalesce(c.brand, '') <> '' THEN c.brand ELSE coalesce(d.brand, c.brand) END AS brand, CASE WHEN c.doors > 0 THEN c.doors ELSE coalesce(d.doors, c.doors) END AS doors,
      CASE WHEN c.olx_id % 3 < 2 THEN coalesce(d.title, c.title) ELSE c.title END AS title, coalesce(d.mileage_km, c.mileage_km) AS km, greatest(1, 2024 - c.year) AS age FROM c LEFT JOIN d USING (olx_id))
    SELECT olx_id, price_eur, brand, doors, title, CASE WHEN km > 0 AND km < 1000 AND (km < 500 * age OR 1000 * km BETWEEN 3000 * age AND 40000 * age) THEN km * 1000 ELSE km END AS mileage_km FROM m""",
)
def _(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    title = F.when(k % 3 == 0, "BMW 5.500 €").when(k % 3 == 1, "BMW 20129.000").otherwise("BMW 320")
    card = t.part.select(k.alias("olx_id"), F.col("p_retailprice").alias("price_eur"), F.when(k % 4 == 1, "").when(k % 4 > 1, F.col("p_brand")).alias("brand"), (F.col("p_size") % 5).alias("doors"), title.alias("title"), (F.col("p_size") * 40).alias("mileage_km"), (2000 + k % 20).alias("year"))
    i = F.col("olx_id")
    detail = card.where("olx_id % 5 > 0").select("olx_id", F.when(i % 2 == 0, F.col("price_eur") * 2).alias("price_eur"), F.lit("D").alias("brand"), F.lit(4).alias("doors"), F.concat(F.lit("detail "), i.cast("string")).alias("title"), F.when(i % 6 == 0, 150).alias("mileage_km"))
    return b.merge_details(card, detail, "olx_id", ["price_eur", "mileage_km"], ["brand", "doors"], 2024).select("olx_id", "price_eur", "brand", "doors", "title", "mileage_km")


@query("a16_metrics_history", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 20")
def _(t: Tables) -> DataFrame:
    return b.keep_last(t.events, "event_id", 20, "user_id").select("user_id", "event_id", "value")
