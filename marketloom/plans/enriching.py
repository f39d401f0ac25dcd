"""Queries of row enrichment and dimension joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import enrich as n
from ..operators import market as m
from ..operators.storage import checkpointed
from .market import COMPARABLES_SQL, DOM_SQL, GRAINS, TURNOVER_SQL
from .registry import AS_OF, SNAPSHOT_AS_OF, Tables, query

AGE = "CAST(floor(epoch(:as_of - first_seen_at) / 86400) AS BIGINT)"
CHANGE = "nullif(round(price_eur - first_price_eur, 4), 0)"


@query("c01_days_listed", f"SELECT olx_id, {AGE} AS days_listed FROM listings")
def _(t: Tables) -> DataFrame:
    return n.days_listed(t.listings, AS_OF).select("olx_id", "days_listed")


@query("c02_price_change", f"SELECT olx_id, {CHANGE} AS price_change_eur, round({CHANGE} / nullif(first_price_eur, 0) * 100, 1) AS price_change_pct FROM listings")
def _(t: Tables) -> DataFrame:
    return n.price_change(t.listings).select("olx_id", "price_change_eur", "price_change_pct")


@query("c03_price_per_km", "SELECT olx_id, round(price_eur / nullif(mileage_km, 0), 3) AS eur_per_km FROM listings")
def _(t: Tables) -> DataFrame:
    return n.price_per_km(t.listings).select("olx_id", "eur_per_km")


@query(
    "c04_json_list_length",
    """SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 4 END AS INT) AS n FROM events""",
)
def _(t: Tables) -> DataFrame:
    listed = F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise(F.to_json(F.slice(F.array(*[F.lit(x) for x in range(4)]), 1, (F.col("event_id") % 4).cast("int"))))
    return t.events.select("event_id", n.json_length(listed).alias("n"))


PLATE_JSON = """CASE WHEN event_id % 4 = 0 THEN props ELSE '{"plate_readable":' || (CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END)
   || ',"plate_n_readable":' || (event_id % 3) || ',"photo_damage_n_exterior":' || (event_id % 9) || ',"plate_text_primary":"AA-' || (event_id % 100) || '"}' END"""


@query(
    "c05_plate_fields",
    f"""WITH j AS (SELECT event_id, {PLATE_JSON} AS x FROM events), k AS (SELECT *, json_extract_string(x, '$.plate_readable') AS r FROM j)
    SELECT event_id, CASE WHEN r IS NOT NULL THEN r = 'true' END AS plate_readable,
    CASE WHEN r IS NOT NULL THEN CAST(json_extract_string(x, '$.plate_n_readable') AS INT) END AS plate_n_readable,
    CASE WHEN r IS NOT NULL THEN json_extract_string(x, '$.plate_text_primary') END AS plate_text_primary,
    CASE WHEN r IS NOT NULL AND CAST(json_extract_string(x, '$.photo_damage_n_exterior') AS INT) >= 5 THEN r <> 'true' END AS plate_obscured FROM k""",
)
def _(t: Tables) -> DataFrame:
    i = F.col("event_id")
    made = F.format_string('{"plate_readable":%s,"plate_n_readable":%d,"photo_damage_n_exterior":%d,"plate_text_primary":"AA-%d"}', F.when(i % 2 == 0, "true").otherwise("false"), i % 3, i % 9, i % 100)
    rows = t.events.select("event_id", F.when(i % 4 == 0, F.col("props")).otherwise(made).alias("extras"))
    return n.plate_fields(rows, "extras").drop("extras")


@query(
    "c07_enrich",
    f"SELECT olx_id, {AGE} AS days_listed, {CHANGE} AS price_change_eur, round({CHANGE} / nullif(first_price_eur, 0) * 100, 1) AS price_change_pct, round(price_eur / nullif(mileage_km, 0), 3) AS eur_per_km FROM listings",
)
def _(t: Tables) -> DataFrame:
    return n.enrich(t.listings, AS_OF).select("olx_id", "days_listed", "price_change_eur", "price_change_pct", "eur_per_km")


GENERATIONS = [(f"Brand#{b}", k, f"Mk{g}", 1995 + 2 * g, 1997 + 2 * g) for b in range(1, 26) for k in ("SMALL", "LARGE", "PROMO") for g in range(3)]
GENERATIONS_SQL = """generations AS (SELECT 'Brand#' || b AS brand, k AS model, 'Mk' || g AS name, 1995 + 2 * g AS year_from, 1997 + 2 * g AS year_to
  FROM range(1, 26) AS x(b), (VALUES ('SMALL'), ('LARGE'), ('PROMO')) AS y(k), range(3) AS z(g))"""


def generations(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(GENERATIONS, "brand string, model string, name string, year_from int, year_to int")


@query(
    "c08_prepare_active",
    f"""WITH turn AS ({TURNOVER_SQL}), {GENERATIONS_SQL}, g AS (SELECT olx_id, arg_max(name, year_from) AS generation_name FROM listings l
      JOIN generations n ON l.brand = n.brand AND l.model = n.model AND l.year BETWEEN n.year_from AND n.year_to GROUP BY 1)
    SELECT l.olx_id, l.price_eur, generation_name, avg_days_to_sell,
      CASE fuel_type WHEN 'Diesel' THEN 'diesel' WHEN 'Gasolina' THEN 'petrol' WHEN 'Eletrico' THEN 'petrol' ELSE 'unk' END || CASE WHEN engine_cc <= 0 THEN '' WHEN engine_cc < 1400 THEN '_small' WHEN engine_cc <= 2000 THEN '_mid' ELSE '_large' END AS sub_segment
    FROM listings l LEFT JOIN g USING (olx_id)
    LEFT JOIN turn ON l.brand = turn.brand AND l.model = turn.model AND l.generation = turn.generation WHERE is_active AND duplicate_of IS NULL""",
)
def _(t: Tables) -> DataFrame:
    rows = t.listings.where(F.col("is_active") & F.col("duplicate_of").isNull())
    named = n.assign_generation(rows, generations(t))
    turn = m.turnover(t.listings, "2001-06-01 00:00:00").select("brand", "model", "generation", "avg_days_to_sell")
    out = rows.join(named, "olx_id", "left").join(turn, ["brand", "model", "generation"], "left")
    return out.select("olx_id", "price_eur", "generation_name", "avg_days_to_sell", s.sub_segment(F.col("fuel_type"), F.col("engine_cc")).alias("sub_segment"))


STATED = "CASE WHEN part_id % 4 = 0 THEN NULL ELSE CAST(mileage_km * (part_id % 15) AS BIGINT) END"


@query(
    "c09_real_mileage",
    f"""WITH j AS (SELECT olx_id, mileage_km, {STATED} AS stated FROM listings) SELECT olx_id,
    CASE WHEN stated > 0 AND stated <= 1000000 AND (mileage_km IS NULL OR mileage_km <= 0 OR (stated <= 10 * mileage_km AND mileage_km <= 10 * stated)) THEN stated ELSE mileage_km END AS real_mileage_km FROM j""",
)
def _(t: Tables) -> DataFrame:
    stated = F.when(F.col("part_id") % 4 != 0, F.col("mileage_km").cast("long") * (F.col("part_id") % 15))
    return n.real_mileage(t.listings.withColumn("stated", stated), "stated").select("olx_id", F.col("real_mileage_km").cast("long").alias("real_mileage_km"))


@query(
    "c10_corrections",
    """WITH j AS (SELECT event_id, CAST(event_id % 1000 * 100 AS INT) AS km, event_id % 7 AS a, event_id % 6 AS sev FROM events)
    SELECT event_id, CASE WHEN a * 30000 > 0 AND (km <= 0 OR (a * 30000 <= 10 * km AND km <= 300000 * a)) THEN a * 30000 ELSE km END AS real_mileage_km,
    CASE WHEN a = 0 THEN NULL ELSE 'S' || a END AS sub_model, CAST(NULL AS VARCHAR) AS trim_level, CAST(CASE WHEN sev <= 3 THEN sev END AS INT) AS damage_severity FROM j""",
)
def _(t: Tables) -> DataFrame:
    i = F.col("event_id")
    made = F.format_string('{"mileage_in_description_km":%d,"sub_model":"%s","damage_severity":%d}', i % 7 * 30000, F.when(i % 7 == 0, " ").otherwise(F.concat(F.lit("S"), (i % 7).cast("string"))), i % 6)
    rows = t.events.select("event_id", (i % 1000 * 100).cast("int").alias("mileage_km"), made.alias("extras"))
    return n.corrections(rows, "extras").select("event_id", F.col("real_mileage_km").cast("long").alias("real_mileage_km"), "sub_model", "trim_level", "damage_severity")


def sellers(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.supplier.where(k % 6 != 0).select(
        k.alias("uuid"),
        F.when(k % 5 != 0, k % 2 == 0).alias("is_business"),
        F.when(k % 3 == 0, "Particular").when(k % 3 == 1, "Stand").alias("business_type"),
        F.lit("2000-01-01 00:00:00").cast("timestamp").alias("created_at"),
        (k % 20).cast("int").alias("cars_count"),
        F.when(k % 4 != 0, (k % 5).cast("int")).alias("distinct_car_brands"),
    )


SELLERS_SQL = """sellers AS (SELECT s_suppkey AS uuid, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 2 = 0 END AS is_business,
   CASE s_suppkey % 3 WHEN 0 THEN 'Particular' WHEN 1 THEN 'Stand' END AS business_type, TIMESTAMP '2000-01-01' AS created_at,
   CAST(s_suppkey % 20 AS INT) AS cars_count, CAST(CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 5 END AS INT) AS distinct_car_brands FROM supplier WHERE s_suppkey % 6 <> 0),
  rot AS (SELECT seller_uuid, count(*) AS seller_listings_count_90d FROM listings WHERE first_seen_at >= TIMESTAMP '2001-08-01' - INTERVAL 12 DAY GROUP BY 1),
  sold_by AS (SELECT l.olx_id, is_business AS seller_is_business, business_type AS seller_business_type, cars_count AS seller_cars_count, distinct_car_brands AS seller_distinct_car_brands,
    CASE WHEN uuid IS NOT NULL THEN CAST(date_diff('day', created_at, :as_of) AS BIGINT) END AS seller_account_age_days,
    CASE WHEN is_business IS NOT NULL THEN is_business AND coalesce(business_type IN ('Utilizador', 'Particular'), false) END AS seller_pseudoprivate, seller_listings_count_90d,
    CASE WHEN l.part_id % 3 = 0 THEN NULL ELSE l.part_id % 2 = 0 END AS plate_obscured
    FROM listings l LEFT JOIN sellers ON seller_uuid = uuid LEFT JOIN rot USING (seller_uuid))"""


def sold_by(t: Tables) -> DataFrame:
    rotation = m.seller_rotation(t.listings, "2001-08-01 00:00:00", 12).withColumnRenamed("listings_count_90d", "seller_listings_count_90d")
    out = n.seller_columns(t.listings, sellers(t), AS_OF).join(rotation, "seller_uuid", "left")
    return out.withColumn("plate_obscured", F.when(F.col("part_id") % 3 != 0, F.col("part_id") % 2 == 0))


@query("c11_seller_columns", f"WITH {SELLERS_SQL} SELECT * EXCLUDE (plate_obscured, seller_listings_count_90d) FROM sold_by")
def _(t: Tables) -> DataFrame:
    return sold_by(t).select("olx_id", "seller_is_business", "seller_business_type", "seller_cars_count", "seller_distinct_car_brands", "seller_account_age_days", "seller_pseudoprivate")


@query(
    "c12_seller_segment",
    f"""WITH {SELLERS_SQL} SELECT olx_id, CASE WHEN seller_is_business IS NULL THEN 'unknown' WHEN seller_pseudoprivate THEN 'pseudo_private'
      WHEN NOT seller_is_business AND (coalesce(seller_cars_count, 1) >= 3 OR coalesce(seller_listings_count_90d, 0) >= 3) THEN 'pseudo_private' WHEN NOT seller_is_business THEN 'genuine_private'
      WHEN coalesce(seller_distinct_car_brands, 1) >= 3 OR coalesce(seller_cars_count, 0) >= 15 THEN 'volume_dealer' ELSE 'specialist_dealer' END AS seller_segment FROM sold_by""",
)
def _(t: Tables) -> DataFrame:
    return sold_by(t).select("olx_id", n.seller_segment().alias("seller_segment"))


@query(
    "c13_flipper_score",
    f"""WITH {SELLERS_SQL}, v AS (SELECT olx_id, CASE WHEN seller_listings_count_90d <= 1 THEN 0.0 WHEN seller_listings_count_90d = 2 THEN 0.5 WHEN seller_listings_count_90d > 2 THEN 1.0 END AS a,
      CASE WHEN seller_cars_count <= 1 THEN 0.0 WHEN seller_cars_count <= 3 THEN 0.5 WHEN seller_cars_count > 3 THEN 1.0 END AS b, seller_pseudoprivate::INT AS c, plate_obscured::INT AS d FROM sold_by),
    w AS (SELECT olx_id, CAST((CASE WHEN a IS NULL THEN 0 ELSE 0.15 END) + (CASE WHEN b IS NULL THEN 0 ELSE 0.3 END) + (CASE WHEN c IS NULL THEN 0 ELSE 0.35 END) + (CASE WHEN d IS NULL THEN 0 ELSE 0.2 END) AS DOUBLE) AS known,
      CAST(coalesce(a * 0.15, 0) + coalesce(b * 0.3, 0) + coalesce(c * 0.35, 0) + coalesce(d * 0.2, 0) AS DOUBLE) AS total FROM v)
    SELECT olx_id, round(total / nullif(known, 0), 6) AS flipper_score, round(known, 6) AS flipper_confidence FROM w""",
)
def _(t: Tables) -> DataFrame:
    return n.flipper_score(sold_by(t)).select("olx_id", "flipper_score", "flipper_confidence")


@query(
    "c14_completeness",
    """WITH f AS (SELECT olx_id, round(((generation IS NOT NULL)::INT + (fuel_type IS NOT NULL)::INT + (source IS NOT NULL)::INT + (deactivated_at IS NOT NULL)::INT) / 4, 4) AS feature_completeness, part_id % 40 AS n FROM listings)
    SELECT olx_id, feature_completeness, round(0.6 * feature_completeness + 0.4 * least(n / 20.0, 1.0)::DOUBLE, 4) AS data_completeness FROM f""",
)
def _(t: Tables) -> DataFrame:
    rows = t.listings.withColumn("feature_completeness", n.completeness(["generation", "fuel_type", "source", "deactivated_at"]))
    return rows.select("olx_id", "feature_completeness", n.data_completeness(F.col("feature_completeness"), F.col("part_id") % 40).alias("data_completeness"))


LATEST_SQL = "latest AS (SELECT listing_id, arg_max(price_eur, {'t': scraped_at, 'i': event_id}) AS latest_price, max(scraped_at) AS latest_at FROM snapshots GROUP BY 1)"


@query("d01_latest_price", f"WITH {LATEST_SQL} SELECT * FROM latest")
def _(t: Tables) -> DataFrame:
    return n.latest_price(t.snapshots)


@query("d02_listings_sellers", f"WITH {SELLERS_SQL} SELECT olx_id, seller_is_business, seller_cars_count FROM sold_by")
def _(t: Tables) -> DataFrame:
    return n.seller_columns(t.listings, sellers(t), AS_OF).select("olx_id", "seller_is_business", "seller_cars_count")


@query("d03_snapshots_users", "SELECT event_id, price_eur, c_name, c_mktsegment FROM snapshots JOIN customer ON listing_id = c_custkey")
def _(t: Tables) -> DataFrame:
    return t.snapshots.join(t.customer, F.col("listing_id") == F.col("c_custkey")).select("event_id", "price_eur", "c_name", "c_mktsegment")


@query(
    "d04_brand_aliases",
    """SELECT p_partkey, CASE lower(trim(p_brand)) WHEN 'brand#1' THEN 'First' WHEN 'brand#12' THEN 'Twelfth' WHEN 'brand#7' THEN 'Seventh' ELSE trim(p_brand) END AS brand_canonical FROM part""",
)
def _(t: Tables) -> DataFrame:
    aliases = t.spark.createDataFrame([("BRAND#1 ", "First"), ("brand#12", "Twelfth"), ("Brand#7", "Seventh")], "alias string, canonical string")
    return n.alias_names(t.part, aliases, "p_brand").select("p_partkey", "brand_canonical")


@query(
    "d05_generation_range",
    f"""WITH {GENERATIONS_SQL} SELECT olx_id, arg_max(name, year_from) AS generation_name FROM listings l
    LEFT JOIN generations g ON l.brand = g.brand AND l.model = g.model AND l.year BETWEEN g.year_from AND g.year_to GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    return n.assign_generation(t.listings, generations(t))


@query(
    "d06_model_from_title",
    """WITH lex AS (SELECT brand, model FROM (SELECT DISTINCT p_brand AS brand FROM part), (VALUES ('ring'), ('small ring'), ('large'), ('bolt'), ('small')) AS v(model)),
    titles AS (SELECT olx_id, min(brand) AS brand, min(title) AS title FROM listings GROUP BY 1),
    hits AS (SELECT olx_id, model, length(model) AS n FROM titles JOIN lex USING (brand) WHERE regexp_matches(lower(title), '\\b' || model || '\\b'))
    SELECT t.olx_id, (SELECT arg_max(model, n * 1000 + ascii(model)) FROM hits h WHERE h.olx_id = t.olx_id) AS model_found FROM titles t""",
)
def _(t: Tables) -> DataFrame:
    words = F.array(*[F.lit(x) for x in ("ring", "small ring", "large", "bolt", "small")])
    lexicon = t.part.select(F.col("p_brand").alias("brand")).distinct().withColumn("model", F.explode(words))
    rows = t.listings.groupBy("olx_id").agg(F.min("brand").alias("brand"), F.min("title").alias("title"))
    return n.model_from_title(rows, lexicon)


@query(
    "d07_segment_fallback",
    f"""WITH {DOM_SQL} SELECT l.olx_id, coalesce(o.dom_median, w.dom_median) AS dom_median FROM listings l
    LEFT JOIN dom o ON l.brand = o.brand AND l.model = o.model AND l.generation = o.generation
    LEFT JOIN dom w ON l.brand = w.brand AND l.model = w.model AND w.generation IS NULL""",
)
def _(t: Tables) -> DataFrame:
    return n.with_segment(t.listings, m.dom_medians(t.listings), ["dom_median"]).select("olx_id", "dom_median")


@query(
    "d08_comparable_layers",
    f"""WITH c AS ({COMPARABLES_SQL}) SELECT l.olx_id, coalesce(s.grain, g.grain, m.grain) AS comparable_grain, coalesce(s.n, g.n, m.n) AS comparable_n,
      coalesce(s.median_price, g.median_price, m.median_price) AS comparable_median FROM listings l
    LEFT JOIN c s ON s.grain = 'sub' AND s.n >= 5 AND l.brand = s.brand AND l.model = s.model AND l.generation = s.generation AND l.fuel_type = s.fuel_type
    LEFT JOIN c g ON g.grain = 'generation' AND g.n >= 5 AND l.brand = g.brand AND l.model = g.model AND l.generation = g.generation
    LEFT JOIN c m ON m.grain = 'model' AND m.n >= 5 AND l.brand = m.brand AND l.model = m.model""",
)
def _(t: Tables) -> DataFrame:
    rows = checkpointed(t.listings.select("olx_id", "brand", "model", "generation", "fuel_type", "price_eur", "year", "mileage_km"), "listings")
    out = n.with_comparables(rows, m.comparables(rows, GRAINS, only_price=True), GRAINS)
    return out.select("olx_id", "comparable_grain", "comparable_n", "comparable_median")


LAYERS = [("brand", "model", "generation"), ("brand", "model"), ("brand",), ()]
LAYERED_SQL = """hp AS (SELECT *, CASE WHEN part_id % 3 <> 0 THEN horsepower END AS power FROM listings),
    layers AS (SELECT 0 AS layer, brand, model, generation, median(power) AS value, count(*) AS n FROM hp WHERE power IS NOT NULL AND generation IS NOT NULL GROUP BY brand, model, generation HAVING count(*) >= 5
      UNION ALL SELECT 1, brand, model, NULL, median(power), count(*) FROM hp WHERE power IS NOT NULL GROUP BY brand, model HAVING count(*) >= 5
      UNION ALL SELECT 2, brand, NULL, NULL, median(power), count(*) FROM hp WHERE power IS NOT NULL GROUP BY brand HAVING count(*) >= 5
      UNION ALL SELECT 3, NULL, NULL, NULL, median(power), count(*) FROM hp WHERE power IS NOT NULL HAVING count(*) >= 5)"""


def powered(t: Tables) -> DataFrame:
    return t.listings.withColumn("power", F.when(F.col("part_id") % 3 != 0, F.col("horsepower")))


@query("e24_layered_medians", f"WITH {LAYERED_SQL} SELECT * FROM layers")
def _(t: Tables) -> DataFrame:
    return n.layered_medians(powered(t), "power", LAYERS)


@query(
    "d09_layered_imputation",
    f"""WITH {LAYERED_SQL} SELECT olx_id, coalesce(power, a.value, b.value, c.value, d.value) AS power_imputed FROM hp
    LEFT JOIN layers a ON a.layer = 0 AND hp.brand = a.brand AND hp.model = a.model AND hp.generation = a.generation
    LEFT JOIN layers b ON b.layer = 1 AND hp.brand = b.brand AND hp.model = b.model LEFT JOIN layers c ON c.layer = 2 AND hp.brand = c.brand LEFT JOIN layers d ON d.layer = 3""",
)
def _(t: Tables) -> DataFrame:
    rows = powered(t)
    return n.impute(rows, "power", n.layered_medians(rows, "power", LAYERS), LAYERS).select("olx_id", "power_imputed")


@query(
    "d12_not_seen",
    "SELECT olx_id FROM listings l WHERE is_active AND NOT EXISTS (SELECT 1 FROM listings s WHERE s.part_id % 3 = 0 AND s.olx_id = l.olx_id)",
)
def _(t: Tables) -> DataFrame:
    return t.listings.where("is_active").join(t.listings.where("part_id % 3 = 0").select("olx_id"), "olx_id", "left_anti").select("olx_id")


@query("d13_unseen_alerts", "SELECT event_id, listing_id FROM snapshots WHERE event_type = 'purchase' AND listing_id NOT IN (SELECT listing_id FROM snapshots WHERE price_eur > 300)")
def _(t: Tables) -> DataFrame:
    seen = t.snapshots.where("price_eur > 300").select("listing_id")
    return t.snapshots.where("event_type = 'purchase'").join(seen, "listing_id", "left_anti").select("event_id", "listing_id")


@query(
    "d16_signal_flags",
    "SELECT event_id, price_eur, f.flag FROM snapshots LEFT JOIN (SELECT c_custkey, c_acctbal < 0 AS flag FROM customer) f ON listing_id = c_custkey",
)
def _(t: Tables) -> DataFrame:
    flags = t.customer.select(F.col("c_custkey").alias("listing_id"), (F.col("c_acctbal") < 0).alias("flag")).dropDuplicates(["listing_id"])
    return t.snapshots.join(flags, "listing_id", "left").select("event_id", "price_eur", "flag")


@query(
    "a01_wide_listings",
    f"""WITH {LATEST_SQL}, {SELLERS_SQL} SELECT l.olx_id, l.price_eur, s.seller_is_business, s.seller_cars_count, p.latest_price, p.latest_at
    FROM listings l JOIN sold_by s USING (olx_id) LEFT JOIN latest p ON l.seller_uuid = p.listing_id""",
)
def _(t: Tables) -> DataFrame:
    wide = n.seller_columns(t.listings, sellers(t), AS_OF).join(n.latest_price(t.snapshots), F.col("seller_uuid") == F.col("listing_id"), "left")
    return wide.select("olx_id", "price_eur", "seller_is_business", "seller_cars_count", "latest_price", "latest_at")


@query("a02_snapshot_view", "SELECT event_id, listing_id, price_eur, c_name FROM snapshots JOIN customer ON listing_id = c_custkey WHERE scraped_at >= :snap_as_of - INTERVAL 14 DAY")
def _(t: Tables) -> DataFrame:
    recent = t.snapshots.where(F.col("scraped_at") >= s.at(SNAPSHOT_AS_OF) - F.make_dt_interval(F.lit(14)))
    return recent.join(t.customer, F.col("listing_id") == F.col("c_custkey")).select("event_id", "listing_id", "price_eur", "c_name")
