"""Seller profiles and photo lists from fetched pages, with built-in functions only.

A page keeps its data as JSON in a script: for profiles as a JSON text within a JSON string. Hosts are
parameters. What is missing or broken gives null or an empty list, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

_SELLER = "uuid: string, name: string, is_business: boolean, created: string, last_seen: string, last_login: string, user_ads_url: string, social_network_account_type: string, user_photo: string, position: struct<map_lat: double, map_lon: double>"
_OFFERS = "adsOffers: struct<metadata: struct<total_elements: bigint, facets: struct<category: array<struct<id: bigint, count: bigint>>>>>"
_SHOP = "owner_uuid: string, name: string, domain: string, logo: string, details: struct<user_ads_url: string, business_type: string, created: string, last_seen: string>, address: struct<map_lat: double, map_lon: double>"
STATE = f"userListing struct<seller: struct<data: struct<{_SELLER}>>, {_OFFERS}>, shop struct<shop: struct<data: struct<{_SHOP}>>, {_OFFERS}>, categories struct<list: map<string, struct<parentId: bigint>>>"


def embedded_string(html: Column, name: str) -> Column:
    """The decoded string literal assigned to ``window.<name>`` in a script; null if there is none.

    The literal ends at its first quote without a backslash. Escaped backslashes and quotes are set
    aside as control characters, which a JSON literal cannot hold, so the end is a plain search.
    """
    start = F.regexp_extract(html, rf"window\.{name}\s*=\s*\"", 0)
    rest = F.when(start != "", F.substr(html, F.instr(html, start) + F.length(start)))
    put = lambda c, a, b: F.replace(c, F.lit(a), F.lit(b))
    marked = put(put(rest, "\\\\", "\x01"), '\\"', "\x02")
    body = F.when(marked.contains('"'), F.substring_index(marked, '"', 1))
    literal = put(put(body, "\x02", '\\"'), "\x01", "\\\\")
    return F.get(F.from_json(F.concat(F.lit('["'), literal, F.lit('"]')), "array<string>"), F.lit(0))


def short_id(url: Column) -> Column:
    """A seller's short id in a url of the kind .../ads/user/<id>/."""
    return F.nullif(F.regexp_extract(url, r"/ads/user/([^/]+)/?", 1), F.lit(""))


def shop_slug(url: Column, host: str) -> Column:
    """The name before ``host`` in a shop's url; null for www and other hosts."""
    slug = F.lower(F.regexp_extract(url, rf"(?i)^https?://([a-z0-9-]+)\.{host.replace('.', chr(92) + '.')}/", 1))
    return F.when(~slug.isin("", "www"), slug)


def seller_profile(df: DataFrame, html: str, url: str, host: str, state_name: str = "__PRERENDERED_STATE__") -> DataFrame:
    """Adds the columns of a seller's page: of a person's listings or of a shop; all null for other pages.

    uuid, profile_url, short_id, shop_slug, name, is_business, business_type, created_at, last_seen_at,
    last_login_at, total_ads, facets (id, count), categories, social_account_type, has_user_photo,
    position_lat, position_lon. Helper columns begin with ``_sp``.
    """
    c, given = F.col, F.nullif(F.col(url), F.lit(""))
    df = df.withColumn("_sp", F.from_json(embedded_string(c(html), state_name), STATE))
    own, shop = c("_sp.userListing.seller.data"), c("_sp.shop.shop.data")
    person = c("_sp.userListing").isNotNull() & (F.coalesce(own["uuid"], F.lit("")) != "")
    business = c("_sp.userListing").isNull() & (F.coalesce(shop["owner_uuid"], F.lit("")) != "")
    either = lambda a, b: F.when(person, a).when(business, b)
    meta = either(c("_sp.userListing.adsOffers.metadata"), c("_sp.shop.adsOffers.metadata"))
    time = lambda x: x.try_cast("timestamp")
    there = person | business
    link = either(F.coalesce(given, own["user_ads_url"]), F.coalesce(F.nullif(shop["details"]["user_ads_url"], F.lit("")), given))
    none = F.lit(None)
    return df.withColumns(
        {
            "uuid": either(own["uuid"], shop["owner_uuid"]),
            "profile_url": either(F.coalesce(given, own["user_ads_url"]), F.coalesce(given, shop["details"]["user_ads_url"])),
            "short_id": short_id(link),
            "shop_slug": either(none.cast("string"), F.coalesce(shop_slug(given, host), F.nullif(F.lower(shop["domain"]), F.lit("")))),
            "name": either(own["name"], shop["name"]),
            "is_business": either(F.coalesce(own["is_business"], F.lit(False)), F.lit(True)),
            "business_type": either(none.cast("string"), shop["details"]["business_type"]),
            "created_at": either(time(own["created"]), time(shop["details"]["created"])),
            "last_seen_at": either(time(own["last_seen"]), time(shop["details"]["last_seen"])),
            "last_login_at": either(time(own["last_login"]), none.cast("timestamp")),
            "total_ads": F.when(there, F.coalesce(meta["total_elements"], F.lit(0))),
            "facets": F.when(there, F.filter(F.coalesce(meta["facets"]["category"], F.array()), lambda f: f["id"].isNotNull() & f["count"].isNotNull())),
            "categories": F.when(there, c("_sp.categories.list")),
            "social_account_type": either(own["social_network_account_type"], none.cast("string")),
            "has_user_photo": either(F.coalesce(own["user_photo"], F.lit("")) != "", F.coalesce(shop["logo"], F.lit("")) != ""),
            "position_lat": either(own["position"]["map_lat"], shop["address"]["map_lat"]),
            "position_lon": either(own["position"]["map_lon"], shop["address"]["map_lon"]),
        }
    ).drop("_sp")


# Facet ids of cars and other vehicles, of other goods, and the parent of car brands.
VEHICLES = {378: "cars", 377: "parts", 5240: "parts", 418: "parts", 416: "commercial", 379: "motos", 376: "boats", 380: "other_auto", 417: "other_auto"}
GOODS = {
    99: "family_lifestyle",
    13: "family_lifestyle",
    14: "family_lifestyle",
    11: "electronics",
    25: "electronics",
    16: "realestate",
    4918: "tools_industrial",
    4800: "tools_industrial",
    10: "pets_hobby",
    12: "pets_hobby",
    26: "pets_hobby",
    190: "services_jobs",
    191: "services_jobs",
    185: "services_jobs",
}
CARS = 378


def facet_buckets(df: DataFrame, key: str, facets: str = "facets", categories: str = "categories") -> DataFrame:
    """``key`` and the ads of each bucket, non_auto (all goods) and distinct_car_brands of its facets.

    A row for each key. Parents count as given, as they hold their leaves already; a facet that is no
    bucket counts as a brand if its parent in the row's own category map is the cars node.
    """
    names = VEHICLES | GOODS
    buckets = df.sparkSession.createDataFrame(list(names.items()), "_id long, bucket string")
    long = df.select(key, F.explode_outer(facets).alias("_f"), F.col(categories).alias("_c"))
    long = long.select(key, F.col("_f.id").alias("id"), F.col("_f.count").alias("n"), (F.try_element_at("_c", F.col("_f.id").cast("string"))["parentId"] == CARS).alias("_brand"))
    # a fixed table of names
    long = long.join(F.broadcast(buckets), F.col("id") == F.col("_id"), "left")
    total = lambda on: F.coalesce(F.sum(F.when(on, F.col("n"))), F.lit(0))
    sums = {b: total(F.col("bucket") == b) for b in dict.fromkeys(names.values())}
    sums["non_auto"] = total(F.col("bucket").isin(*set(GOODS.values())))
    sums["distinct_car_brands"] = F.countDistinct(F.when(F.col("bucket").isNull() & F.col("_brand"), F.col("id")))
    return long.groupBy(key).agg(*[x.alias(k) for k, x in sums.items()])


def photo_urls(html: Column, host: str, least: int = 1000, size: str = "1000x700") -> Column:
    """Photo urls in page order, one for each id, of ids with a variant at least ``least`` wide; others are thumbnails."""
    pattern = F.lit(rf"{host.replace('.', chr(92) + '.')}[:\d]*/v1/files/([\w-]+)-PT/image(?:;s=(\d+)x(\d+))?")
    ids, widths = F.regexp_extract_all(html, pattern, 1), F.regexp_extract_all(html, pattern, 2)
    wide = F.filter(F.arrays_zip(ids.alias("id"), widths.alias("w")), lambda z: z["w"].try_cast("int") >= least)
    kept = F.transform(wide, lambda z: z["id"])
    chosen = F.filter(F.array_distinct(ids), lambda i: F.array_contains(kept, i))
    return F.transform(chosen, lambda i: F.concat(F.lit(f"https://{host}/v1/files/"), i, F.lit(f"-PT/image;s={size}")))


_ADVERT = "props struct<pageProps: struct<advert: struct<images: struct<photos: array<struct<url: string>>>>>>"


def advert_photos(html: Column, script: str = "__NEXT_DATA__") -> Column:
    """Photo urls of the advert in a page's JSON script; empty where any part is missing."""
    raw = F.regexp_extract(html, rf'(?s)<script id="{script}"[^>]*>(.+?)</script>', 1)
    photos = F.from_json(raw, _ADVERT)["props"]["pageProps"]["advert"]["images"]["photos"]
    urls = F.transform(photos, lambda p: p["url"])
    return F.when(urls.isNull() | F.exists(urls, lambda u: u.isNull()), F.array().cast("array<string>")).otherwise(urls)


def _within(html: Column, mark: str) -> Column:
    """What the first element with ``data-testid`` or ``data-cy`` of ``mark`` holds, up to the first end tag of its own name."""
    return F.regexp_extract(html, rf"""(?s)<(\w+)[^>]*\bdata-(?:testid|cy)=["']{mark}["'][^>]*>(.*?)</\1>""", 2)


def text_of(html: Column) -> Column:
    """Text without tags, with common character references decoded and white space tidied."""
    out = F.regexp_replace(html, "<[^>]*>", "")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&euro;", "€"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def listing_cards(df: DataFrame, html: str, key: str, base: str, wanted: list[str], brands: list[str], abbreviations: dict[str, str]) -> DataFrame:
    """A row for each card of a search page: key, card (0-based), olx_id, url, title, price_eur, negotiable, brand, year, mileage_km and city.

    Cards without a link to one of ``wanted`` (parts of urls) or without an id are left out. The brand is that
    of the url's path, else of the title, else of an abbreviation in the title, else empty.
    """
    c = F.col
    parts = F.split(c(html), r"""(?=<[^>]*\bdata-testid=["']l-card["'])""")
    cards = df.select(key, F.posexplode(F.filter(parts, lambda _, i: i > 0)).alias("card", "_c"))
    # texts with several readers are columns of their own, so that each is cut out once
    href = c("_href")
    cards = cards.withColumn("_href", F.regexp_extract("_c", r"""(?s)<a\b[^>]*\bhref=["']([^"']+)""", 1)).withColumn("url", F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(base), href))).withColumn("olx_id", text.advert_id(c("url")))
    fits = F.lit(False)
    for part in wanted:
        fits = fits | c("url").contains(part)
    cards = cards.where(fits & c("olx_id").isNotNull() & (href != ""))
    wrapped = c("_wrapped")
    cards = cards.withColumn("_wrapped", F.regexp_extract("_c", r"""(?s)\bdata-cy=["']ad-card-title["'][^>]*>(.*)$""", 1))
    inner = F.regexp_extract(F.when(wrapped != "", wrapped).otherwise(c("_c")), r"(?s)<(a|h[456])\b[^>]*>(.*?)</\1>", 2)
    heading = F.regexp_extract("_c", r"(?s)<(h[456])\b[^>]*>(.*?)</\1>", 2)
    cards = cards.withColumn("_heading", F.when(wrapped != "", inner).otherwise(heading))
    cards = cards.withColumns({"title": text_of(c("_heading")), "_used": text_of(F.regexp_extract("_c", r"""(?s)<span[^>]*\bdata-nx-name=["']P5["'][^>]*>(.*?)</span>""", 1)), "_price": text_of(_within(c("_c"), "ad-price")), "_place": text_of(_within(c("_c"), "location-date"))})
    age = lambda k: F.regexp_extract("_used", r"^(\d{4})\s*-\s*([\d.]+)\s*km", k)
    names = F.create_map(*[F.lit(x) for b in brands for x in (b.lower().replace(" ", "-"), b)])
    by_url = F.try_element_at(names, F.lower(F.regexp_extract("url", r"/carros/([^/]+)/", 1)))
    spelled = F.try_element_at(F.create_map(*[F.lit(x) for b in brands for x in (b.lower(), b)]), text.brand_in_title(c("title"), brands))
    short = F.coalesce(*[F.when(F.regexp_like(F.lower("title"), F.lit(rf"\b{a}\b")), b) for a, b in abbreviations.items()], F.lit(""))
    return cards.select(
        key,
        "card",
        "olx_id",
        "url",
        "title",
        text.price_eur(F.nullif(c("_price"), F.lit(""))).alias("price_eur"),
        F.lower("_price").contains("negociável").alias("negotiable"),
        F.coalesce(by_url, spelled, short).alias("brand"),
        age(1).try_cast("int").alias("year"),
        F.regexp_replace(age(2), r"\.", "").try_cast("int").alias("mileage_km"),
        F.trim(F.substring_index("_place", " - ", 1)).alias("city"),
    )


# Labels of an advert's parameters.
PARAMETERS = {
    "Segmento": "segment",
    "Ano": "year",
    "Modelo": "model",
    "Mês de Registo": "registration_month",
    "Cilindrada": "engine_cc",
    "Combustível": "fuel_type",
    "Potência": "horsepower",
    "Quilómetros": "mileage_km",
    "Tipo de Caixa": "transmission",
    "Condição": "condition",
    "Portas": "doors",
    "Lugares": "seats",
    "Cor": "color",
    "Tração": "drive_type",
    "Marca": "brand",
}
WHOLE_PARAMETERS = ("year", "mileage_km", "engine_cc", "horsepower", "seats")


def listing_details(df: DataFrame, html: str) -> DataFrame:
    """Adds the fields of an advert's own page; null where the page does not tell.

    A vehicle's JSON block comes first; labelled parameters overwrite it. Then price, negotiable,
    district and city from the breadcrumbs, photo_count, posted_at, seller_type and the seller's link
    (seller_profile_url, seller_short_id). Helper columns begin with ``_ld``.
    """
    page, c = F.col(html), F.col
    scripts = F.regexp_extract_all(page, F.lit(r"""(?s)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"""), 1)
    vehicle = F.get(F.filter(F.slice(scripts, 1, 5), lambda s: F.get_json_object(s, "$.@type") == "Vehicle"), F.lit(0))
    df = df.withColumns(
        {
            "_ld": vehicle,
            "_ld_p": F.transform(F.regexp_extract_all(F.regexp_extract(page, r"""(?s)\bdata-testid=["']ad-parameters-container["'][^>]*>(.*?)</div>""", 1), F.lit(r"(?s)<p\b[^>]*>(.*?)</p>"), 1), text_of),
            "_ld_b": F.filter(F.transform(F.regexp_extract_all(page, F.lit(r"""(?s)\bdata-testid=["']breadcrumb-item["'][^>]*>(.*?)</li>"""), 1), text_of), lambda x: x.contains(" - ")),
        }
    )
    said = lambda path: F.nullif(F.trim(F.get_json_object("_ld", path)), F.lit(""))

    # each text is cut out of the page once; its readers are many
    df = df.withColumns(
        {
            "_ld_v": F.transform("_ld_p", lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("name"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value"))),
            "_ld_price": text_of(_within(page, "ad-price-container")),
            "_ld_posted": text_of(_within(page, "ad-posted-at")),
            "_ld_seller": F.regexp_extract(page, r"""(?s)<a\b[^>]*\bhref=["']([^"']*/ads/user/[^"']+)""", 1),
        }
    )

    def labelled(label: str) -> Column:
        return F.try_element_at(F.filter("_ld_v", lambda x: x["name"] == label), F.lit(-1))["value"]

    own: dict[str, Column] = {}
    for label, name in PARAMETERS.items():
        value = labelled(label)
        own[name] = text.digits(value).cast("int") if name in WHOLE_PARAMETERS else value
    own["brand"], own["model"] = F.coalesce(own["brand"], said("$.brand")), F.coalesce(own["model"], said("$.model"))
    own["year"] = F.coalesce(own["year"], text.digits(said("$.productionDate")).cast("int"))
    crumb = lambda k: F.nullif(F.trim(F.regexp_replace(F.get(F.reverse("_ld_b"), F.lit(k)), "^.*? - ", "")), F.lit(""))
    two = F.size("_ld_b") >= 2
    seller = c("_ld_seller")
    photos = F.size(F.regexp_extract_all(page, F.lit(r"""\bdata-testid=["']ad-photo["']"""), 0))
    wrapper = F.nullif(_within(page, "prices-wrapper"), F.lit(""))
    return df.withColumns(
        own
        | {
            "title": said("$.name"),
            "sku": F.coalesce(said("$.sku"), F.nullif(F.regexp_extract(_within(page, "ad-footer-bar-section"), r"ID:\s*(\d+)", 1), F.lit(""))),
            "price_eur": F.coalesce(F.get_json_object("_ld", "$.offers.price").try_cast("double"), text.price_eur(F.nullif(c("_ld_price"), F.lit("")))),
            "negotiable": F.lower(text_of(wrapper)).contains("negociável"),
            "district": F.when(two, crumb(1)).otherwise(crumb(0)),
            "city": F.coalesce(F.when(two, crumb(0)), said("$.offers.areaServed.name")),
            "photo_count": F.when(photos > 0, photos),
            "posted_at": text.portuguese_date(c("_ld_posted")),
            "seller_type": F.try_element_at(F.filter("_ld_p", lambda x: x.isin("Particular", "Profissional")), F.lit(-1)),
            "seller_profile_url": F.nullif(seller, F.lit("")),
            "seller_short_id": short_id(seller),
        }
    ).drop("_ld", "_ld_p", "_ld_b", "_ld_v", "_ld_price", "_ld_posted", "_ld_seller")
