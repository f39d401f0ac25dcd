"""Row enrichment: columns computed from a row, from joins to small dimensions and to segment tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import at, ratio, whole_days
from ..functions.text import folded
from .ranks import with_medians
from .market import SEGMENT


def days_listed(df: DataFrame, as_of: str, first: str = "first_seen_at") -> DataFrame:
    return df.withColumn("days_listed", whole_days(at(as_of), F.col(first)))


def price_change(df: DataFrame, price: str = "price_eur", first: str = "first_price_eur") -> DataFrame:
    """Difference to the first price and its percentage; no difference is null."""
    change = F.nullif(F.round(F.col(price) - F.col(first), 4), F.lit(0.0))
    return df.withColumns({"price_change_eur": change, "price_change_pct": F.round(ratio(change, F.col(first)) * 100, 1)})


def price_per_km(df: DataFrame, price: str = "price_eur", km: str = "mileage_km") -> DataFrame:
    return df.withColumn("eur_per_km", F.round(ratio(F.col(price), F.col(km).cast("double")), 3))


def json_length(c: Column) -> Column:
    """Length of a JSON list; 0 for anything else."""
    return F.coalesce(F.json_array_length(c), F.lit(0))


def plate_fields(df: DataFrame, extras: str, min_photos: int = 5) -> DataFrame:
    """``plate_readable``, ``plate_n_readable``, ``plate_text_primary`` and ``plate_obscured`` from JSON.

    All are null where the JSON lacks the key; obscured needs at least ``min_photos`` exterior photos.
    """
    get = lambda k: F.get_json_object(extras, f"$.{k}")
    done = get("plate_readable").isNotNull()
    n = get("plate_n_readable").try_cast("int")
    readable = F.when(done, get("plate_readable") == "true")
    enough = F.coalesce(get("photo_damage_n_exterior").try_cast("int"), F.lit(0)) >= min_photos
    return df.withColumns({"plate_readable": readable, "plate_n_readable": F.when(done, F.coalesce(n, F.lit(0))), "plate_text_primary": F.when(done, get("plate_text_primary")), "plate_obscured": F.when(done & enough, ~readable)})


def enrich(df: DataFrame, as_of: str) -> DataFrame:
    """Age, price change and price per km of listings."""
    return price_per_km(price_change(days_listed(df, as_of)))


def real_mileage(df: DataFrame, stated: str, km: str = "mileage_km") -> DataFrame:
    """The stated mileage wins if it is over 0, at most a million and within ten times of the attribute."""
    s, k = F.col(stated), F.col(km)
    fits = (s > 0) & (s <= 1_000_000) & (k.isNull() | (k <= 0) | ((s <= 10 * k) & (k <= 10 * s)))
    return df.withColumn("real_mileage_km", F.when(fits, s).otherwise(k))


def corrections(df: DataFrame, extras: str, km: str = "mileage_km") -> DataFrame:
    """Mileage, sub-model, trim and severity from JSON extras, where they are usable."""
    get = lambda k: F.get_json_object(extras, f"$.{k}")
    stated = get("mileage_in_description_km").try_cast("long")
    text = lambda k: F.nullif(F.trim(get(k)), F.lit(""))
    severity = get("damage_severity").try_cast("int")
    out = real_mileage(df.withColumn("_stated", stated), "_stated", km).drop("_stated")
    return out.withColumns({"sub_model": text("sub_model"), "trim_level": text("trim_level"), "damage_severity": F.when(severity.between(0, 3), severity)})


def seller_columns(df: DataFrame, sellers: DataFrame, as_of: str, key: str = "seller_uuid", private_titles: tuple[str, ...] = ("Utilizador", "Particular")) -> DataFrame:
    """Flat seller columns, account age, and whether a business account is shown as private.

    ``sellers``: uuid, is_business, business_type, created_at, cars_count, distinct_car_brands. Rows
    without a seller have nulls.
    """
    s = sellers.select(
        F.col("uuid").alias("_uuid"),
        F.col("is_business").alias("seller_is_business"),
        F.col("business_type").alias("seller_business_type"),
        F.col("cars_count").alias("seller_cars_count"),
        F.col("distinct_car_brands").alias("seller_distinct_car_brands"),
        whole_days(at(as_of), F.col("created_at")).alias("seller_account_age_days"),
    )
    out = df.join(s, F.col(key) == F.col("_uuid"), "left")
    pseudo = F.when(F.col("seller_is_business").isNotNull(), F.col("seller_is_business") & F.coalesce(F.col("seller_business_type").isin(*private_titles), F.lit(False)))
    return out.withColumn("seller_pseudoprivate", pseudo).drop("_uuid")


def seller_segment() -> Column:
    """unknown, pseudo_private, genuine_private, volume_dealer or specialist_dealer, by ordered rules."""
    business = F.col("seller_is_business")
    cars, rotation = F.col("seller_cars_count"), F.coalesce("seller_listings_count_90d", F.lit(0))
    return (
        F.when(business.isNull(), "unknown")
        .when(F.coalesce("seller_pseudoprivate", F.lit(False)), "pseudo_private")
        .when(~business & ((F.coalesce(cars, F.lit(1)) >= 3) | (rotation >= 3)), "pseudo_private")
        .when(~business, "genuine_private")
        .when((F.coalesce("seller_distinct_car_brands", F.lit(1)) >= 3) | (F.coalesce(cars, F.lit(0)) >= 15), "volume_dealer")
        .otherwise("specialist_dealer")
    )


def flipper_score(df: DataFrame) -> DataFrame:
    """Weighted mean over the signals that are known, and how much weight is known."""
    rotation, cars = F.col("seller_listings_count_90d"), F.col("seller_cars_count")
    flag = lambda c: F.when(F.col(c), 1.0).when(~F.col(c), 0.0)
    signals = [
        ("seller_listings_count_90d", F.when(rotation <= 1, 0.0).when(rotation == 2, 0.5).when(rotation > 2, 1.0), 0.15),
        ("seller_cars_count", F.when(cars <= 1, 0.0).when(cars <= 3, 0.5).when(cars > 3, 1.0), 0.30),
        ("seller_pseudoprivate", flag("seller_pseudoprivate"), 0.35),
        ("plate_obscured", flag("plate_obscured"), 0.20),
    ]
    known = sum((F.when(s.isNotNull(), w).otherwise(0.0) for _, s, w in signals), F.lit(0.0))
    total = sum((F.coalesce(s * w, F.lit(0.0)) for _, s, w in signals), F.lit(0.0))
    parts = F.map_filter(F.create_map(*[x for n, s, w in signals for x in (F.lit(n), s * w)]), lambda _, v: v.isNotNull())
    return df.withColumns({"flipper_score": F.round(F.try_divide(total, F.nullif(known, F.lit(0.0))), 6), "flipper_confidence": F.round(known, 6), "flipper_parts": F.to_json(parts)})


def completeness(columns: list[str]) -> Column:
    """Share of the columns that are not null."""
    return F.round(sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0)) / len(columns), 4)


def data_completeness(features: Column, sample: Column) -> Column:
    return F.round(0.6 * features + 0.4 * F.least(sample / 20.0, F.lit(1.0)), 4)


# Joins to dimensions and segment tables


def latest_price(snapshots: DataFrame, key: str = "listing_id", tie: str = "event_id") -> DataFrame:
    return snapshots.groupBy(key).agg(F.max_by("price_eur", F.struct("scraped_at", tie)).alias("latest_price"), F.max("scraped_at").alias("latest_at"))


def alias_names(df: DataFrame, aliases: DataFrame, brand: str = "brand") -> DataFrame:
    """``brand`` replaced through ``aliases`` (alias, canonical), compared trimmed and in lower case."""
    a = aliases.select(F.lower(F.trim("alias")).alias("_alias"), F.col("canonical").alias("_canonical"))
    out = df.join(a, F.lower(F.trim(brand)) == F.col("_alias"), "left")
    return out.withColumn("brand_canonical", F.coalesce("_canonical", F.trim(brand), F.lit(""))).drop("_alias", "_canonical")


def assign_generation(df: DataFrame, generations: DataFrame, brand: str = "brand", model: str = "model", year: str = "year", key: str = "olx_id") -> DataFrame:
    """``key, generation_name``: the generation whose years hold the listing's; the later one wins.

    The equality part of the range join keeps it a hash join; the optimiser broadcasts a small dimension.
    """
    g = generations.select(F.col("brand").alias("_b"), F.col("model").alias("_m"), F.col("name").alias("_name"), "year_from", "year_to")
    hit = (F.col(brand) == F.col("_b")) & (F.col(model) == F.col("_m")) & F.col(year).between(F.col("year_from"), F.col("year_to"))
    return df.join(g, hit, "left").groupBy(key).agg(F.max_by("_name", F.struct("year_from", "_name")).alias("generation_name"))


def title_grams(title: str, words: int) -> Column:
    """Distinct runs of up to ``words`` words of a title in lower case, with what stands between the words."""
    parts = F.regexp_extract_all(title, F.lit(r"(?U)\w+|\W+"), F.lit(0))
    run = lambda i, n: F.when(i + 2 * n < F.size(parts), F.lower(F.array_join(F.slice(parts, i + 1, 2 * n + 1), "")))
    starts = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.regexp_like(F.get(parts, i), F.lit(r"(?U)^\w")))
    grams = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda n: run(i, n))))
    return F.when(F.size(parts) > 0, F.array_distinct(F.array_compact(grams)))


def model_from_title(df: DataFrame, lexicon: DataFrame, title: str = "title", brand: str = "brand", key: str = "olx_id", words: int = 5) -> DataFrame:
    """``key, model_found``: the longest model of the brand that stands in the title as whole words.

    Runs of the title's words meet the lexicon by equality of brand and text. Only models of more than
    ``words`` words, or that do not begin and end with a letter or digit, are looked for by a pattern.
    """
    lex = lexicon.select(F.col("brand").alias("_b"), F.col("model").alias("_m")).distinct()
    plain = F.regexp_like("_m", F.lit(r"(?U)^\w(.*\w)?$")) & (F.size(F.regexp_extract_all("_m", F.lit(r"(?U)\w+"), F.lit(0))) <= words)
    rows = df.select(key, F.col(brand).alias("_brand"), F.col(title).alias("_title"))
    grams = rows.select(key, "_brand", F.explode(title_grams("_title", words)).alias("_gram"))
    found = grams.join(lex.where(plain), (F.col("_brand") == F.col("_b")) & (F.col("_gram") == F.lower("_m"))).select(key, "_m")
    word = F.concat(F.lit(r"(?iU)\b"), F.regexp_replace("_m", r"([\\.\[\]{}()*+?^$|\-])", r"\\$1"), F.lit(r"\b"))
    odd = rows.join(lex.where(~plain), F.col("_brand") == F.col("_b")).where(F.regexp_like("_title", word)).select(key, "_m")
    best = found.unionByName(odd).groupBy(F.col(key).alias("_k")).agg(F.max_by("_m", F.struct(F.length("_m"), "_m")).alias("model_found"))
    return df.select(key).distinct().join(best, F.col(key) == F.col("_k"), "left").drop("_k")


def with_segment(df: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of a segment table by (brand, model, generation), else by its row without generation."""
    own = table.select(*[F.col(k).alias(f"_o_{k}") for k in SEGMENT], *[F.col(c).alias(f"_o_{c}") for c in columns])
    wide = table.where(F.col("generation").isNull()).select(F.col("brand").alias("_w_brand"), F.col("model").alias("_w_model"), *[F.col(c).alias(f"_w_{c}") for c in columns])
    out = df.join(own.where(F.col("_o_generation").isNotNull()), (F.col("brand") == F.col("_o_brand")) & (F.col("model") == F.col("_o_model")) & (F.col("generation") == F.col("_o_generation")), "left")
    out = out.join(wide, (F.col("brand") == F.col("_w_brand")) & (F.col("model") == F.col("_w_model")), "left")
    out = out.withColumns({c: F.coalesce(f"_o_{c}", f"_w_{c}") for c in columns})
    return out.drop(*[f"_o_{k}" for k in (*SEGMENT, *columns)], "_w_brand", "_w_model", *[f"_w_{c}" for c in columns])


def with_comparables(df: DataFrame, table: DataFrame, grains: dict[str, tuple[str, ...]], least: int = 5) -> DataFrame:
    """The finest comparables with at least ``least`` rows: comparable_grain, comparable_n, comparable_median."""
    picks = []
    for grain, keys in grains.items():
        side = table.where((F.col("grain") == grain) & (F.col("n") >= least)).select(
            *[F.col(k).alias(f"_{grain}_{k}") for k in keys], F.struct(F.lit(grain).alias("g"), F.col("n"), F.col("median_price").alias("m")).alias(f"_pick_{grain}")
        )
        on = F.lit(True)
        for k in keys:
            on = on & (F.col(k) == F.col(f"_{grain}_{k}"))
        df = df.join(side, on, "left").drop(*[f"_{grain}_{k}" for k in keys])
        picks.append(f"_pick_{grain}")
    pick = F.coalesce(*picks)
    return df.withColumns({"comparable_grain": pick["g"], "comparable_n": pick["n"], "comparable_median": pick["m"]}).drop(*picks)


def layered_medians(df: DataFrame, value: str, layers: list[tuple[str, ...]], least: int = 5) -> DataFrame:
    """Medians at every layer, where at least ``least`` values are known.

    Columns: layer (0 is the finest), the keys, value and n. A null key belongs to no finer layer.
    """
    keys = list(layers[0])
    known = lambda own: F.coalesce(*[F.when(F.col(k).isNull(), F.lit(False)) for k in own], F.lit(True)) if own else F.lit(True)
    sets = [F.when(known(own), F.struct(F.lit(i).alias("layer"), *[(F.col(k) if k in own else F.lit(None).cast(df.schema[k].dataType)).alias(k) for k in keys])) for i, own in enumerate(layers)]
    rows = df.where(F.col(value).isNotNull()).select(F.explode(F.array_compact(F.array(*sets))).alias("_g"), F.col(value).alias("_v")).select("_g.*", "_v")
    out = rows.groupBy("layer", *keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return with_medians(out, rows, ["layer", *keys], {"value": "_v"}).select("layer", *keys, "value", "n")


def impute(df: DataFrame, value: str, medians: DataFrame, layers: list[tuple[str, ...]]) -> DataFrame:
    """Adds ``<value>_imputed``: the value, else the median of the finest layer that has one."""
    picks = [F.col(value).cast("double")]
    for i, own in enumerate(layers):
        side = medians.where(F.col("layer") == i).select(*[F.col(k).alias(f"_l{i}_{k}") for k in own], F.col("value").alias(f"_l{i}"))
        if own:
            on = F.lit(True)
            for k in own:
                on = on & (F.col(k) == F.col(f"_l{i}_{k}"))
            df = df.join(side, on, "left").drop(*[f"_l{i}_{k}" for k in own])
        else:
            # the global layer has one row
            df = df.join(F.broadcast(side), F.lit(True), "left")
        picks.append(F.col(f"_l{i}"))
    return df.withColumn(f"{value}_imputed", F.coalesce(*picks)).drop(*[f"_l{i}" for i in range(len(layers))])


def with_zone(df: DataFrame, zones: DataFrame, district: str = "district") -> DataFrame:
    """Adds ``zone`` of a row's district from ``zones`` (place, zone), compared without case, accents and outer blanks; null where there is none."""
    plain = lambda c: F.trim(folded(F.col(c)))
    side = zones.groupBy(plain("place").alias("_place")).agg(F.min("zone").alias("zone"))
    return df.join(side, plain(district) == F.col("_place"), "left").drop("_place")
