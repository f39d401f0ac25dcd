"""Queries of seller pages, photo lists, facets and the session's SQL functions.

The driver's pages hold no such scripts, so each row of ``supplier`` or ``pages`` gets one made of its
own columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..functions import sql, text
from ..operators import maintain as b
from ..operators import pages as p
from ..sources import tables
from .ingest import STOCK_SQL, stock
from .market import DAILY_SQL
from .registry import Tables, query

HOST = "shops.example.com"


def seller_pages(t: Tables) -> DataFrame:
    """Profiles of persons (even keys) and shops (odd keys); every seventh page is cut off, every eleventh has no script."""
    k = F.col("s_suppkey")
    pair = lambda i, n: F.struct(F.lit(i).cast("long").alias("id"), n.cast("long").alias("count"))
    facets = F.array(pair(362, k % 60), pair(378, k % 9), pair(741, k % 3 + 1), pair(742, k % 2), pair(377, k % 4), pair(5240, F.lit(1)), pair(16, k % 5), pair(99, F.lit(2)), pair(14, k % 7))
    facets = F.filter(facets, lambda f: f["count"] > 0)
    offers = F.struct(F.struct((k % 100).alias("total_elements"), F.struct(facets.alias("category")).alias("facets")).alias("metadata"))
    created = F.concat(F.lit("2019-03-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("T10:00:00Z"))
    link = F.concat(F.lit("https://example.com/ads/user/u"), k.cast("string"), F.lit("/"))
    said = F.concat(F.col("s_name"), F.lit(' "a\\b"'))
    person = F.struct(k.cast("string").alias("uuid"), said.alias("name"), (k % 3 == 0).alias("is_business"), created.alias("created"), link.alias("user_ads_url"), F.struct((k % 90 + 0.5).alias("map_lat")).alias("position"))
    shop = F.struct(k.cast("string").alias("owner_uuid"), said.alias("name"), F.concat(F.lit("Shop"), k.cast("string")).alias("domain"), F.struct(link.alias("user_ads_url"), F.lit("dealer").alias("business_type"), created.alias("created")).alias("details"))
    node = lambda i, parent: F.struct(F.lit(i).alias("k"), F.struct(F.lit(parent).cast("long").alias("parentId")).alias("v"))
    categories = F.struct(F.map_from_entries(F.array(node("741", 378), node("742", 378), node("378", 362), node("362", 0))).alias("list"))
    one = F.to_json(F.struct(F.struct(F.struct(person.alias("data")).alias("seller"), offers.alias("adsOffers")).alias("userListing"), categories.alias("categories")))
    two = F.to_json(F.struct(F.struct(F.struct(shop.alias("data")).alias("shop"), offers.alias("adsOffers")).alias("shop"), categories.alias("categories")))
    state = F.when(k % 2 == 0, one).otherwise(two)
    literal = F.replace(F.replace(state, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    page = F.concat(F.lit('<html><script>window.__PRERENDERED_STATE__= "'), literal, F.when(k % 7 == 0, "").otherwise('";var x = "y";'), F.lit("</script></html>"))
    url = F.when(k % 2 == 1, F.concat(F.lit("https://Shop-"), k.cast("string"), F.lit(f".{HOST}/home/"))).otherwise("")
    return t.supplier.select("s_suppkey", F.when(k % 11 > 0, page).otherwise("<html></html>").alias("html"), url.alias("url"))


@query(
    "p03_seller_profiles",
    """SELECT s_suppkey, s_suppkey::VARCHAR AS uuid, s_name || ' "a\\b"' AS name, s_suppkey % 2 = 1 OR s_suppkey % 3 = 0 AS is_business, (s_suppkey % 100)::BIGINT AS total_ads, 'u' || s_suppkey AS short_id,
    CASE WHEN s_suppkey % 2 = 1 THEN 'shop-' || s_suppkey END AS shop_slug, TIMESTAMP '2019-03-01 10:00:00' + to_days(CAST(s_suppkey % 28 AS INT)) AS created_at, CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey % 90 + 0.5)::DOUBLE END AS position_lat
    FROM supplier WHERE s_suppkey % 7 > 0 AND s_suppkey % 11 > 0""",
)
def _(t: Tables) -> DataFrame:
    found = p.seller_profile(seller_pages(t), "html", "url", HOST).where("uuid is not null")
    return found.select("s_suppkey", "uuid", "name", "is_business", "total_ads", "short_id", "shop_slug", "created_at", "position_lat")


@query(
    "e19_facet_rollup",
    """SELECT s_suppkey, s_suppkey % 9 AS cars, s_suppkey % 4 + 1 AS parts, s_suppkey % 5 AS realestate, 2 + s_suppkey % 7 AS family_lifestyle, s_suppkey % 5 + 2 + s_suppkey % 7 AS non_auto, 1 + s_suppkey % 2 AS distinct_car_brands, 0 AS boats
    FROM supplier WHERE s_suppkey % 7 > 0 AND s_suppkey % 11 > 0""",
)
def _(t: Tables) -> DataFrame:
    found = p.seller_profile(seller_pages(t), "html", "url", HOST).where("uuid is not null")
    return p.facet_buckets(found, "s_suppkey").select("s_suppkey", "cars", "parts", "realestate", "family_lifestyle", "non_auto", "distinct_car_brands", "boats")


def with_photos(t: Tables) -> DataFrame:
    """Pages with photo links of three ids, the last as a thumbnail only, and with an advert's JSON."""
    k = F.col("page_id").cast("string")
    photo = lambda i, size: F.concat(F.lit("<img src='https://cdn.example.com:443/v1/files/"), F.lit(i), k, F.lit(f"-PT/image{size}'>"))
    links = F.concat(photo("b-", ";s=200x100"), photo("a_", ";s=1000x700"), photo("b-", ";s=4080x3072"), photo("t", ";s=516x361"), photo("n", ""))
    urls = F.concat(F.lit('{"url":"u'), k, F.lit('"},{"url":"v'), k, F.lit('"}'))
    urls = F.when(F.col("page_id") % 5 == 0, F.concat(urls, F.lit(',{"id":1}'))).otherwise(urls)
    script = F.concat(F.lit('<script id="__NEXT_DATA__" type="x">{"props":{"pageProps":{"advert":{"images":{"photos":['), urls, F.lit("]}}}}}</script>"))
    return t.pages.select("page_id", F.concat(F.coalesce("html", F.lit("")), links, F.when(F.col("page_id") % 3 > 0, script).otherwise("")).alias("html"))


@query("p04_photo_urls", "SELECT page_id, 'https://cdn.example.com/v1/files/b-' || page_id || '-PT/image;s=1000x700,https://cdn.example.com/v1/files/a_' || page_id || '-PT/image;s=1000x700' AS photos FROM pages")
def _(t: Tables) -> DataFrame:
    return with_photos(t).select("page_id", F.concat_ws(",", p.photo_urls(F.col("html"), "cdn.example.com")).alias("photos"))


@query("p05_advert_photos", "SELECT page_id, CASE WHEN page_id % 3 > 0 AND page_id % 5 > 0 THEN 'u' || page_id || ',v' || page_id ELSE '' END AS photos FROM pages")
def _(t: Tables) -> DataFrame:
    return with_photos(t).select("page_id", F.concat_ws(",", p.advert_photos(F.col("html"))).alias("photos"))


@query(
    "x12_seller_names",
    "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'u' || c_custkey END AS short_id, CASE c_custkey % 3 WHEN 1 THEN 'auto-' || c_custkey END AS shop_slug FROM customer",
)
def _(t: Tables) -> DataFrame:
    k, name = F.col("c_custkey") % 3, F.col("c_custkey").cast("string")
    url = F.when(k == 0, F.concat(F.lit(f"https://www.{HOST}/ads/user/u"), name, F.lit("/?page=2"))).when(k == 1, F.concat(F.lit("HTTP://Auto-"), name, F.lit(f".{HOST}/home"))).otherwise(f"https://www.{HOST}/home/")
    url = F.when(k == 0, F.regexp_replace(url, r"/\?", "?")).otherwise(url)
    return t.customer.select("c_custkey", p.short_id(F.regexp_replace(url, r"\?.*", "/")).alias("short_id"), p.shop_slug(url, HOST).alias("shop_slug"))


BRAND_OF = ["Volkswagen", "Peugeot", "Mercedes-Benz", "Renault", "Opel", "Mazda", "Fiat"]
SUB_MODELS = ["2.0 TDI", "1.6 e-HDi", "220 CDI", "1.5 Blue dCi", "1.3 CDTI", "SkyActive-D 2.2", "1.3 M-Jet", "GTI", None]


def _pick(values: list, k: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), k.cast("int"))


@query(
    "x22_sub_models",
    """WITH b AS (SELECT p_partkey, ['VAG', 'PSA', 'MB', 'RNO', NULL, 'MAZDA', 'FCA'][p_partkey % 7 + 1] AS maker, ['2.0 TDI', '1.6 e-HDi', '220 CDI', '1.5 Blue dCi', '1.3 CDTI', 'SkyActive-D 2.2', '1.3 M-Jet', 'GTI', NULL][p_size % 9 + 1] AS sub,
      ['VAG', 'PSA', 'MB', 'RNO', 'GM', 'MAZDA', 'FCA', NULL, NULL][p_size % 9 + 1] AS engine FROM part) SELECT p_partkey, CASE WHEN maker IS NULL OR engine IS NULL OR maker = engine THEN sub END AS sub_model FROM b""",
)
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.fitting_sub_model(_pick(BRAND_OF, F.col("p_partkey") % 7), _pick(SUB_MODELS, F.col("p_size") % 9)).alias("sub_model"))


@query(
    "x24_contribution_labels",
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'mileage=' || round_even(p_size * 1500 / 1000, 0)::BIGINT || 'k' WHEN 1 THEN 'year=' || (2000 + p_size) WHEN 2 THEN 'plate_obscured=' || CASE WHEN p_size % 2 = 1 THEN 'yes' ELSE 'no' END
    WHEN 3 THEN 'generation=' || p_brand WHEN 4 THEN 'share=' || printf('%.2f', p_size / 8 + 0.001) ELSE 'color=—' END AS label FROM part""",
)
def _(t: Tables) -> DataFrame:
    k, size = F.col("p_partkey") % 6, F.col("p_size")
    value = F.when(k == 0, (size * 1500).cast("string")).when(k == 1, (2000 + size).cast("double").cast("string")).when(k == 2, (size % 2).cast("string")).when(k == 3, F.col("p_brand")).when(k == 4, (size / 8 + 0.001).cast("string"))
    return t.part.select("p_partkey", text.contribution_label(_pick(["mileage_km", "year", "plate_obscured", "generation", "share", "color"], k), value).alias("label"))


@query("x40_in_eur", "SELECT o_orderkey, o_totalprice AS eur FROM orders")
def _(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", s.in_eur(F.col("o_totalprice")).alias("eur"))


@query("a03_stats_history", DAILY_SQL)
def _(t: Tables) -> DataFrame:
    from ..operators.market import daily_market_stats

    return tables.stats_history(daily_market_stats(t.snapshots))


@query("a04_unmatched", "SELECT olx_id, coalesce(source, 'olx') AS source, price_eur FROM listings WHERE is_active AND generation IS NULL")
def _(t: Tables) -> DataFrame:
    return tables.unmatched_listings(t.listings.where("generation is null")).select("olx_id", "source", "price_eur")


@query("a07_relist_history", "SELECT event_id AS original_olx_id, ts::TIMESTAMP AS detected_at, value AS price_delta_eur FROM events WHERE event_type = 'purchase'")
def _(t: Tables) -> DataFrame:
    events = t.events.where("event_type = 'purchase'").select(F.col("event_id").alias("original_olx_id"), F.col("ts").cast("timestamp").alias("detected_at"), F.col("value").alias("price_delta_eur"))
    return tables.relist_history(events)


PROBED_SQL = f"""{STOCK_SQL}, asked AS (SELECT olx_id FROM stock WHERE NOT is_active AND deactivation_reason = 'sold' AND coalesce(source, 'olx') = 'olx' AND deactivated_at >= TIMESTAMP '1998-02-05' - INTERVAL 14 DAY ORDER BY deactivated_at DESC, olx_id LIMIT 300)"""


def probed(t: Tables) -> tuple[DataFrame, DataFrame]:
    turn = F.floor(F.col("olx_id") / 7) % 5
    probes = stock(t).select("olx_id", F.when(turn == 0, True).when(turn <= 2, False).alias("alive"))
    return b.revalidate(stock(t), probes, "olx", "1998-02-05 00:00:00")


@query(
    "b13_revalidated",
    f"""WITH {PROBED_SQL} SELECT olx_id, is_active OR back AS is_active, CASE WHEN NOT back THEN deactivated_at END AS deactivated_at, CASE WHEN NOT back THEN deactivation_reason END AS deactivation_reason
    FROM (SELECT *, olx_id // 7 % 5 = 0 AND olx_id IN (SELECT olx_id FROM asked) AS back FROM stock)""",
)
def _(t: Tables) -> DataFrame:
    return probed(t)[0].select("olx_id", "is_active", "deactivated_at", "deactivation_reason")


@query("b13_counts", f"WITH {PROBED_SQL} SELECT count(*) AS checked, count(*) FILTER (olx_id // 7 % 5 = 0) AS restored, count(*) FILTER (olx_id // 7 % 5 IN (1, 2)) AS still_dead, count(*) FILTER (olx_id // 7 % 5 > 2) AS deferred FROM asked")
def _(t: Tables) -> DataFrame:
    return probed(t)[1]


@query(
    "v04_sql_functions",
    """SELECT p_partkey, round(p_retailprice / nullif(p_size % 5, 0), 6) AS ratio, greatest(5, least(20, p_size))::DOUBLE AS clamped, CASE p_partkey % 3 WHEN 0 THEN 'Volkswagen' WHEN 1 THEN 'Škoda' ELSE p_brand END AS brand, 'acao' AS plain,
    CAST(least(greatest(8 * p_size, 60), 365) AS BIGINT) AS days, CASE WHEN p_size * 60 < 1400 THEN 'small' WHEN p_size * 60 <= 2000 THEN 'mid' ELSE 'large' END AS size, (CASE WHEN p_size * 9 <= 14 THEN 0.9 WHEN p_size * 9 <= 60 THEN 0.7 WHEN p_size * 9 <= 180 THEN 0.5 WHEN p_size * 9 <= 365 THEN 0.3 ELSE 0 END)::DOUBLE AS weight FROM part""".replace("'Škoda'", "'Skoda'"),
)
def _(t: Tables) -> DataFrame:
    sql.register(t.spark)
    return t.spark.sql(
        """SELECT p_partkey, round(ml_ratio(p_retailprice, p_size % 5), 6) AS ratio, ml_clamp(p_size, 5, 20) AS clamped, ml_brand(CASE p_partkey % 3 WHEN 0 THEN ' VW' WHEN 1 THEN 'škoda' ELSE p_brand END) AS brand, ml_unaccented('Ação') AS plain,
        ml_window_days(2 * p_size) AS days, ml_engine_size(p_size * 60) AS size, ml_sold_weight(p_size * 9) AS weight FROM {part}""",
        part=t.part,
    )


BRANDS = ["Volkswagen", "Alfa Romeo", "BMW", "Mercedes-Benz"]


def spread(df: DataFrame, key: str) -> DataFrame:
    """The keys dealt to several tasks for each core: a small file is one task, but a page made of a key is long work."""
    return df.select(key).repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def search_pages(t: Tables) -> DataFrame:
    """A search page for each part: a card of the site, one of another site, one without an id."""
    k = F.col("p_partkey")
    i = k.cast("string")
    title = F.when(k % 4 == 0, F.concat(F.lit("Golf "), i)).when(k % 4 == 1, "VW &amp; mais").when(k % 4 == 2, "bmw  320").otherwise("Carro")
    path = F.when(k % 4 == 0, "carros/alfa-romeo/").otherwise("")
    price = F.concat(F.translate(F.format_number(k * 37, 0), ",", "."), F.lit(" €"), F.when(k % 3 == 0, "<span>Negociável</span>").otherwise(""))
    one = F.concat(
        F.lit('<div class="x" data-testid="l-card"><a href="/d/anuncio/'), path, F.lit("x-IDa"), i, F.lit('.html"><img></a><div data-cy="ad-card-title"><a href="#"><h4>'), title, F.lit('</h4></a><p data-testid="ad-price">'), price,
        F.lit('</p></div><p data-testid="location-date">Porto - Hoje</p><span data-nx-name="P5">2015 - '), F.translate(F.format_number(k * 11, 0), ",", "."), F.lit(" km</span></div>"),
    )
    two = F.concat(F.lit('<div data-testid="l-card"><a href="https://other.example.org/x-IDb'), i, F.lit('.html"></a><h6>Mercedes-Benz A</h6><p data-testid="location-date">Lisboa</p></div>'))
    three = F.lit('<div data-testid="l-card"><a href="/d/anuncio/none.html"></a></div><div data-testid="l-card"><a href="/jobs/IDz.html"></a></div>')
    return spread(t.part, "p_partkey").select("p_partkey", F.concat(F.lit("<html><body>"), one, two, three, F.lit("</body></html>")).alias("html"))


@query(
    "p01_listing_cards",
    """SELECT p_partkey, 'a' || p_partkey AS olx_id, CASE p_partkey % 4 WHEN 0 THEN 'Golf ' || p_partkey WHEN 1 THEN 'VW & mais' WHEN 2 THEN 'bmw 320' ELSE 'Carro' END AS title, (p_partkey * 37)::DOUBLE AS price_eur, p_partkey % 3 = 0 AS negotiable,
    CASE p_partkey % 4 WHEN 0 THEN 'Alfa Romeo' WHEN 1 THEN 'Volkswagen' WHEN 2 THEN 'BMW' ELSE '' END AS brand, 2015 AS year, CAST(p_partkey * 11 AS INT) AS mileage_km, 'Porto' AS city FROM part
    UNION ALL SELECT p_partkey, 'b' || p_partkey, 'Mercedes-Benz A', NULL, false, 'Mercedes-Benz', NULL, NULL, 'Lisboa' FROM part""",
)
def _(t: Tables) -> DataFrame:
    cards = p.listing_cards(search_pages(t), "html", "p_partkey", "https://example.com", ["/d/anuncio/", "other.example.org"], BRANDS, {"vw": "Volkswagen", "merc": "Mercedes-Benz", "mb": "Mercedes-Benz"})
    return cards.select("p_partkey", "olx_id", "title", "price_eur", "negotiable", "brand", "year", "mileage_km", "city")


def advert_pages(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    i = k.cast("string")
    vehicle = F.concat(F.lit('<script type="application/ld+json">{"@type":"Thing"}</script><script type="application/ld+json">{"@type":"Vehicle","brand":"B'), i, F.lit('","model":"M","productionDate":"2011","name":" Car '), i, F.lit('","sku":"'), i, F.lit('","offers":{"price":"'), (k * 10).cast("string"), F.lit('","areaServed":{"name":"Faro"}}}</script>'))
    parameters = F.concat(F.lit('<div data-testid="ad-parameters-container"><p><span>Particular</span></p><p>Quilómetros: '), F.translate(F.format_number(k * 1000, 0), ",", "."), F.lit(" km</p><p>Cor: Azul</p><p>Outro: x</p>"), F.when(k % 3 == 0, "<p>Ano: 2018</p>").otherwise(""), F.lit("</div>"))
    crumbs = F.concat(F.lit('<ol data-testid="breadcrumbs"><li data-testid="breadcrumb-item"><a>Carros</a></li><li data-testid="breadcrumb-item"><a>Carros - Lisboa</a></li>'), F.when(k % 2 == 0, '<li data-testid="breadcrumb-item"><a>Carros - Sintra</a></li>').otherwise(""), F.lit("</ol>"))
    rest = F.concat(F.lit('<div data-testid="prices-wrapper"><h3 data-testid="ad-price-container">'), (k * 7).cast("string"), F.lit(" €</h3>"), F.when(k % 5 == 0, "<p>Negociável</p>").otherwise(""), F.lit('</div><div data-testid="ad-photo"></div><div data-testid="ad-photo"></div><span data-testid="ad-posted-at">12 de março de 2024</span><a class="s" href="https://example.com/ads/user/u'), i, F.lit('/">Ana</a>'))
    return spread(t.part, "p_partkey").select("p_partkey", F.concat(F.lit("<html>"), F.when(k % 4 > 0, vehicle).otherwise(""), parameters, crumbs, rest, F.lit("</html>")).alias("html"))


@query(
    "p02_listing_details",
    """SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN 'B' || p_partkey END AS brand, CASE WHEN p_partkey % 3 = 0 THEN 2018 WHEN p_partkey % 4 > 0 THEN 2011 END AS year, CAST(p_partkey * 1000 AS INT) AS mileage_km, 'Azul' AS color, CASE WHEN p_partkey % 4 > 0 THEN 'Car ' || p_partkey END AS title,
    (CASE WHEN p_partkey % 4 > 0 THEN p_partkey * 10 ELSE p_partkey * 7 END)::DOUBLE AS price_eur, p_partkey % 5 = 0 AS negotiable, 'Lisboa' AS district, CASE WHEN p_partkey % 2 = 0 THEN 'Sintra' WHEN p_partkey % 4 > 0 THEN 'Faro' END AS city,
    2 AS photo_count, TIMESTAMP '2024-03-12' AS posted_at, 'Particular' AS seller_type, 'u' || p_partkey AS seller_short_id FROM part""",
)
def _(t: Tables) -> DataFrame:
    found = p.listing_details(advert_pages(t), "html")
    return found.select("p_partkey", "brand", "year", "mileage_km", "color", "title", "price_eur", "negotiable", "district", "city", "photo_count", "posted_at", "seller_type", "seller_short_id")
