"""Smaller queries: windows, filters, keyed tables and scalar rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..functions import text as x
from ..operators import deals as g
from ..sources.tables import with_changes, with_deals, without_deals
from .decisions import DEALS_SQL, deals
from .ingest import STOCK_SQL, stock
from .registry import Tables, query


@query(
    "w07_terciles",
    """WITH w AS (SELECT user_id, date_trunc('week', ts) AS week, median(value) AS p FROM events GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY week) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM w)
    SELECT user_id, week::TIMESTAMP AS week, CASE WHEN k <= greatest(1, n // 3) THEN 'early' WHEN k > n - greatest(1, n // 3) THEN 'late' ELSE 'middle' END AS part FROM n""",
)
def _(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id")
    rows = t.events.groupBy("user_id", F.date_trunc("week", F.col("ts").cast("timestamp")).alias("week")).agg(F.count("*").alias("_c"))
    rows = rows.withColumns({"k": F.row_number().over(w.orderBy("week")), "n": F.count("*").over(w)})
    third = F.greatest(F.lit(1), F.floor(F.col("n") / 3))
    return rows.select("user_id", "week", F.when(F.col("k") <= third, "early").when(F.col("k") > F.col("n") - third, "late").otherwise("middle").alias("part"))


@query("w08_streaks", "SELECT event_id, sum((value > 20)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 3 AS streak FROM events")
def _(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-2, 0)
    return t.events.select("event_id", (F.sum((F.col("value") > 20).cast("int")).over(w) >= 3).alias("streak"))


@query("f07_alert_filter", f"WITH {DEALS_SQL} SELECT olx_id, round((1 - price_eur / med) * 100, 1) AS discount_pct FROM multiplied WHERE round((1 - price_eur / med) * 100, 1) >= 15 AND part_id % 6 <> 0")
def _(t: Tables) -> DataFrame:
    seen = t.listings.where("part_id % 6 = 0").select("olx_id")
    return g.new_alerts(deals(t), seen).select("olx_id", "discount_pct")


@query(
    "f08_stale_recheck",
    f"""WITH {DEALS_SQL}, looked AS (SELECT olx_id, med, CASE WHEN part_id % 4 = 0 THEN price_eur ELSE coalesce(CASE WHEN part_id % 3 > 0 THEN price_eur * 1.1::DOUBLE END, price_eur) END AS price_eur FROM multiplied WHERE part_id % 4 = 0 OR part_id % 5 > 0)
    SELECT olx_id, round(price_eur, 4) AS price_eur, round((1 - price_eur / med) * 100, 1) AS discount_pct FROM looked WHERE round((1 - price_eur / med) * 100, 1) >= 15""",
)
def _(t: Tables) -> DataFrame:
    k, now = F.col("part_id"), "2001-12-01 00:00:00"
    signals = deals(t).withColumns({"median_price_eur": F.col("comparable_median"), "last_seen_at": F.when(k % 4 == 0, s.at(now)).otherwise(F.col("last_seen_at"))})
    fresh = t.listings.select("olx_id", F.when(k % 3 > 0, F.col("price_eur") * 1.1).alias("price_eur"), (k % 5 > 0).alias("is_active"))
    return g.rechecked(signals, fresh, now).select("olx_id", F.round("price_eur", 4).alias("price_eur"), "discount_pct")


@query(
    "a06_portfolio_changes",
    f"""WITH {STOCK_SQL}, added AS (SELECT olx_id, price_eur, brand FROM stock WHERE olx_id % 50 <> 0 UNION ALL SELECT CASE WHEN olx_id % 100 = 0 THEN olx_id ELSE olx_id + 20000000 END, price_eur * 2, brand FROM stock WHERE olx_id % 50 = 0 UNION ALL SELECT olx_id, price_eur, brand FROM stock WHERE olx_id % 100 = 50),
    changed AS (SELECT olx_id, CASE WHEN olx_id % 3 = 0 THEN 1.0 ELSE price_eur END AS price_eur, brand FROM added) SELECT olx_id, round(price_eur, 4)::DOUBLE AS price_eur, brand FROM changed WHERE olx_id % 7 <> 0""",
)
def _(t: Tables) -> DataFrame:
    base, k = stock(t).select("olx_id", "price_eur", "brand"), F.col("olx_id")
    added = with_deals(base, base.where("olx_id % 50 = 0").select(F.when(k % 100 == 0, k).otherwise(k + 20_000_000).alias("olx_id"), (F.col("price_eur") * 2).alias("price_eur"), "brand"), "olx_id")
    changed = with_changes(added, added.where("olx_id % 3 = 0").select("olx_id", F.lit(1.0).alias("price_eur")), "olx_id")
    return without_deals(changed, changed.where("olx_id % 7 = 0"), "olx_id").select("olx_id", F.round("price_eur", 4).alias("price_eur"), "brand")


@query(
    "b23_relist_events",
    """WITH o AS (SELECT event_id AS id, ts::TIMESTAMP AS detected_at, value FROM events WHERE event_id % 3 = 0), n AS (SELECT event_id AS id, TIMESTAMP '2024-02-01' AS detected_at, value * 2 AS value FROM events WHERE event_id % 2 = 0)
    SELECT coalesce(n.id, o.id) AS id, coalesce(o.detected_at, n.detected_at) AS detected_at, coalesce(n.value, o.value) AS value FROM o FULL OUTER JOIN n ON o.id = n.id""",
)
def _(t: Tables) -> DataFrame:
    o = t.events.where("event_id % 3 = 0").select(F.col("event_id").alias("_o"), F.col("ts").cast("timestamp").alias("_at"), F.col("value").alias("_v"))
    n = t.events.where("event_id % 2 = 0").select(F.col("event_id").alias("_n"), (F.col("value") * 2).alias("_w"))
    return o.join(n, F.col("_o") == F.col("_n"), "full_outer").select(F.coalesce("_n", "_o").alias("id"), F.coalesce("_at", s.at("2024-02-01 00:00:00")).alias("detected_at"), F.coalesce("_w", "_v").alias("value"))


@query("x05_brand_in_title", "SELECT p_partkey, nullif(regexp_extract(lower(p_name), '(?:^|[^\\w])(small ring|small|ring|bolt)(?:$|[^\\w])', 1), '') AS found FROM part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", x.brand_in_title(F.col("p_name"), ["ring", "bolt", "small", "small ring"]).alias("found"))


@query(
    "x25_deal_message",
    """WITH d AS (SELECT l.*, 15 + part_id % 13 AS discount, part_id % 5 = 0 AS accident, part_id % 7 = 0 AS repair, CASE WHEN part_id % 3 = 0 THEN false WHEN part_id % 3 = 1 THEN true END AS customs, part_id % 6 AS owners,
      part_id % 4 = 0 AS pseudo, part_id % 8 AS parts, part_id % 5 AS brands, part_id % 2 = 0 AS business, part_id % 10 / 8 AS score, CASE WHEN part_id % 11 > 0 THEN part_id % 11 / 10 END AS sure,
      CASE WHEN part_id % 3 = 0 THEN 'facebook' ELSE '' END AS social, part_id % 9 = 0 AS photo, part_id * 37 % 4000 AS age, CASE WHEN part_id % 4 > 1 THEN '{"photo_damage_p": 0.' || part_id % 5 || '}' WHEN part_id % 4 = 1 THEN 'none' END AS extras,
      CASE WHEN part_id % 5 > 1 THEN 'City' || part_id % 5 END AS city FROM listings l),
    m AS (SELECT *, array_to_string(list_filter([CASE WHEN accident THEN 'упоминание ДТП' END, CASE WHEN repair THEN 'упоминание ремонта' END, CASE WHEN NOT customs THEN 'нет упоминания о растаможке' END, CASE WHEN owners >= 3 THEN 'упоминание: ' || owners || ' владельцев' END], lambda v: v IS NOT NULL), ', ') AS told,
      array_to_string(list_filter([CASE WHEN pseudo THEN 'псевдочастник (Utilizador, но JSON=Empresa)' END, CASE WHEN parts > 0 AND NOT business THEN 'продаёт запчасти (' || parts || ')' END, CASE WHEN brands >= 3 AND NOT business THEN brands || ' разных марок под Particular' END,
        CASE WHEN score >= 0.5 AND sure >= 0.4 THEN CASE WHEN score >= 0.75 THEN '🚨' ELSE '⚠️' END || ' flipper-score ' || printf('%.2f', round_even(score, 2)) || ' (conf ' || printf('%.0f', sure * 100) || '%)' END], lambda v: v IS NOT NULL), ', ') AS against,
      array_to_string(list_filter([CASE WHEN social <> '' THEN social || ' link' END, CASE WHEN photo THEN 'фото профиля' END, CASE WHEN age >= 2555 THEN 'акк ' || age // 365 || '+ лет' END], lambda v: v IS NOT NULL), ', ') AS fitting,
      CASE WHEN part_id % 4 > 1 THEN part_id % 5 / 10 END AS p FROM d)
    SELECT olx_id, concat_ws(chr(10), CASE WHEN discount > 25 THEN '🔥🔥🔥' WHEN discount > 20 THEN '🔥🔥' ELSE '🔥' END || ' <b>' || brand || ' ' || model || ' ' || year || '</b>' || coalesce(' (' || generation || ')', ''),
      '💰 <b>' || format('{:,}', trunc(price_eur)::BIGINT) || ' EUR</b> (median ' || format('{:,}', trunc(first_price_eur)::BIGINT) || ' EUR)', '📉 <b>-' || discount || '%</b> below market', CASE WHEN mileage_km <> 0 THEN '🛣 ' || format('{:,}', mileage_km::BIGINT) || ' km' END,
      '📍 ' || coalesce(city || ', ', '') || district, CASE WHEN told <> '' THEN '📝 Из описания: ' || told END, CASE WHEN against <> '' THEN '👤 Продавец: ' || against END, CASE WHEN fitting <> '' THEN '✓ Доверие: ' || fitting END,
      CASE WHEN p >= 0.1 THEN '📷 Photo classifier: p_damaged=' || printf('%.2f', p) END, chr(10) || '<a href="https://example.com/' || part_id || '">Open on OLX</a>') AS message FROM m""",
)
def _(t: Tables) -> DataFrame:
    k = F.col("part_id")
    rows = t.listings.withColumns(
        {
            "median_price_eur": F.col("first_price_eur"),
            "discount_pct": 15 + k % 13,
            "desc_mentions_accident": k % 5 == 0,
            "desc_mentions_repair": k % 7 == 0,
            "desc_mentions_customs_cleared": F.when(k % 3 == 0, False).when(k % 3 == 1, True),
            "desc_mentions_num_owners": k % 6,
            "seller_pseudoprivate": k % 4 == 0,
            "seller_parts_count": k % 8,
            "seller_distinct_car_brands": k % 5,
            "seller_is_business": k % 2 == 0,
            "flipper_score": k % 10 / 8,
            "flipper_confidence": F.when(k % 11 > 0, k % 11 / 10),
            "seller_social_account_type": F.when(k % 3 == 0, "facebook").otherwise(""),
            "seller_has_user_photo": k % 9 == 0,
            "seller_account_age_days": k * 37 % 4000,
            "llm_extras": F.when(k % 4 > 1, F.format_string('{"photo_damage_p": 0.%d}', k % 5)).when(k % 4 == 1, "none"),
            "city": F.when(k % 5 > 1, F.format_string("City%d", k % 5)),
            "url": F.format_string("https://example.com/%d", k),
        }
    )
    return rows.select("olx_id", x.deal_message(rows.columns).alias("message"))


@query(
    "x32_sold_tiers",
    """WITH d AS (SELECT olx_id, coalesce(NOT is_active AND deactivation_reason = 'sold', false) AS gone, CASE WHEN part_id % 9 > 0 THEN part_id * 7 % 400 - 5 END AS days FROM listings)
    SELECT olx_id, (CASE WHEN NOT gone OR days IS NULL OR days < 0 OR days > 365 THEN 1.0 WHEN days <= 14 THEN 0.96 WHEN days <= 60 THEN 0.94 WHEN days <= 180 THEN 0.91 ELSE 0.88 END)::DOUBLE AS times,
    (CASE WHEN NOT gone THEN 1.0 WHEN days IS NULL OR days < 0 OR days > 365 THEN 0.0 WHEN days <= 14 THEN 0.9 WHEN days <= 60 THEN 0.7 WHEN days <= 180 THEN 0.5 ELSE 0.3 END)::DOUBLE AS weight FROM d""",
)
def _(t: Tables) -> DataFrame:
    times, weight = s.sold_tier(F.col("is_active"), F.col("deactivation_reason"), F.when(F.col("part_id") % 9 > 0, F.col("part_id") * 7 % 400 - 5))
    return t.listings.select("olx_id", times.alias("times"), weight.alias("weight"))


@query(
    "x36_damage_label",
    """WITH a AS (SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN p_size % 2 = 0 END AS visible, CASE WHEN p_partkey % 7 > 0 THEN p_size % 3 END AS severity FROM part)
    SELECT p_partkey, CASE WHEN visible IS NULL OR severity IS NULL THEN NULL WHEN severity = 0 OR NOT visible THEN false ELSE true END AS damaged FROM a""",
)
def _(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    return t.part.select("p_partkey", s.damage_label(F.when(k % 5 > 0, F.col("p_size") % 2 == 0), F.when(k % 7 > 0, F.col("p_size") % 3)).alias("damaged"))


@query(
    "x37_photo_decision",
    """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'no_photos' WHEN p_partkey % 10 >= 2 THEN 'photo_confirms' ELSE 'downgrade' END AS decision,
    CAST(CASE WHEN p_size % 4 = 0 OR p_partkey % 10 >= 2 THEN 2 + p_size % 2 ELSE 0 END AS INT) AS severity FROM part""",
)
def _(t: Tables) -> DataFrame:
    decision = s.photo_decision(2 + F.col("p_size") % 2, F.col("p_partkey") % 10 / 10, F.col("p_size") % 4)
    return t.part.select("p_partkey", decision.alias("_d")).select("p_partkey", "_d.*")
