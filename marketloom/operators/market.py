"""Segment statistics, days on market, turnover, competition, price dynamics.

Every function takes its column names and, where time matters, ``as_of``; nulls in keys form a group
unless a function says otherwise. Medians are exact; those of segments, whose size nothing bounds, come
from ``ranks.with_medians``, which never holds a group in one task. The rest are aggregates and windows over their keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import at, days_between, mean, median_of, ratio, sold, whole_days
from .ranks import with_medians
from .storage import checkpointed

SEGMENT = ("brand", "model", "generation")


def present(*keys: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def market_overview(df: DataFrame, keys: tuple[str, ...] = ("brand", "model"), price: str = "price_eur", top: int = 30) -> DataFrame:
    """The ``top`` groups by size, with median, least and largest price; ties by key."""
    rows = df.where(present(*keys))
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(price).alias("min_price"), F.max(price).alias("max_price")).orderBy(F.desc("n"), *keys).limit(top)
    some = rows.select(*[F.col(k).alias(f"_t_{k}") for k in keys], F.col(price).alias("_price"))
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"_t_{k}") == F.col(k))
    # ``top`` rows
    some = some.join(F.broadcast(out.select(*keys)), on, "left_semi").withColumnsRenamed({f"_t_{k}": k for k in keys})
    return with_medians(out, some, list(keys), {"median_price": "_price"}).orderBy(F.desc("n"), *keys)


def largest_groups(df: DataFrame, key: str, top: int = 15) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(top)


def comparables(df: DataFrame, grains: dict[str, tuple[str, ...]], price: str = "price_eur", year: str = "year", mileage: str = "mileage_km", only_price: bool = False) -> DataFrame:
    """Price, year and mileage medians at several grains in one pass (grouping sets).

    Columns: grain, all keys (null where the grain has none), n and the medians; rows without a
    positive price or with a null key of the grain are left out. With ``only_price`` the price's median
    alone. Rows of equal keys and values are counted before they are copied to the grains.
    """
    keys = list(dict.fromkeys(k for g in grains.values() for k in g))
    values = {"_p": price} if only_price else {"_p": price, "_y": year, "_m": mileage}
    met = df.where(F.col(price) > 0).groupBy(*keys, *[F.col(c).alias(v) for v, c in values.items()]).agg(F.count("*").alias("_n"))
    layers = [F.when(present(*own), F.struct(F.lit(grain).alias("grain"), *[(F.col(k) if k in own else F.lit(None).cast(df.schema[k].dataType)).alias(k) for k in keys])) for grain, own in grains.items()]
    rows = met.select(F.explode(F.array_compact(F.array(*layers))).alias("_g"), *values, "_n").select("_g.*", *values, "_n")
    if only_price:
        rows = checkpointed(rows.groupBy("grain", *keys, "_p").agg(F.sum("_n").alias("_n")), "comparables")
    out = rows.groupBy("grain", *keys).agg(F.sum("_n").alias("n"))
    names = {"_p": "median_price", "_y": "median_year", "_m": "median_mileage"}
    return with_medians(out, rows, ["grain", *keys], {names[v]: v for v in values}, weight="_n")


def daily_market_stats(snapshots: DataFrame, keys: tuple[str, ...] = ("brand", "model"), price: str = "price_eur", ts: str = "scraped_at") -> DataFrame:
    """All snapshots of a day count, not only the latest."""
    rows = snapshots.where(present(*keys) & F.col(price).isNotNull()).withColumn("date", F.to_date(ts))
    out = rows.groupBy(*keys, "date").agg(F.round(mean(F.col(price)), 8).alias("avg_price_eur"), F.min(price).alias("min_price_eur"), F.max(price).alias("max_price_eur"), F.count("*").alias("listing_count"))
    return with_medians(out, rows, [*keys, "date"], {"median_price_eur": price})


def seller_rotation(df: DataFrame, as_of: str, days: int = 90, seller: str = "seller_uuid", first_seen: str = "first_seen_at") -> DataFrame:
    recent = df.where(F.col(seller).isNotNull() & (F.col(first_seen) >= at(as_of) - F.make_dt_interval(F.lit(days))))
    return recent.groupBy(seller).agg(F.count("*").alias("listings_count_90d"))


def turnover(df: DataFrame, as_of: str, keys: tuple[str, ...] = SEGMENT, active: str = "is_active", first: str = "first_seen_at", last: str = "last_seen_at") -> DataFrame:
    """Mean days to sell and the share that left in the last week, for segments with inactive rows.

    Where no row at all is inactive, every segment is listed with null days and a turnover of 0.
    """
    gone = ~F.col(active)
    days = F.when(gone, whole_days(F.col(last), F.col(first)))
    recent = gone & (F.col(last) >= at(as_of) - F.make_dt_interval(F.lit(7)))
    out = df.groupBy(*keys).agg(
        F.count("*").alias("total_listings"),
        F.count_if(gone).alias("_gone"),
        F.round(F.avg(days), 1).alias("avg_days_to_sell"),
        F.round(F.count_if(recent) / F.count("*") * 100, 1).alias("weekly_turnover"),
    )
    any_gone = df.select(F.coalesce(F.max(gone.cast("int")), F.lit(0)).alias("_any"))
    # one row
    return out.join(F.broadcast(any_gone), (F.col("_gone") > 0) | (F.col("_any") == 0)).select(*keys, "avg_days_to_sell", "weekly_turnover", "total_listings")


def competition(df: DataFrame, turn: DataFrame | None = None, local: str = "district", keys: tuple[str, ...] = ("brand", "model"), price: str = "price_eur", fanout: bool = True) -> DataFrame:
    """Local count and median of active listings, and how crowded the place is for the model.

    ``turn`` joins on ``keys`` only: with ``fanout`` rows repeat for each of its generations, else
    its days are averaged first.
    """
    rows = df.where(F.col("is_active") & present(*keys, local, price))
    here = rows.groupBy(*keys, local).agg(F.count("*").alias("local_count"), median_of(price).alias("local_median"))
    total = rows.groupBy(*keys).agg(F.count("*").alias("national_count"), F.countDistinct(local).alias("districts_present"))
    out = here.join(total, list(keys))
    out = out.withColumn("national_avg_per_district", F.round(F.col("national_count") / F.col("districts_present"), 1))
    out = out.withColumn("saturation", F.round(F.col("local_count") / F.col("national_avg_per_district"), 2))
    if turn is not None:
        side = turn.select(*keys, "avg_days_to_sell")
        if not fanout:
            side = side.groupBy(*keys).agg(F.round(F.avg("avg_days_to_sell"), 1).alias("avg_days_to_sell"))
        out = out.join(side, list(keys), "left")
    return out.withColumn("label", F.concat_ws(" ", *keys))


def days_on_market(first: str = "first_seen_at", gone: str = "deactivated_at") -> Column:
    return days_between(F.col(gone), F.col(first))


def segment_metrics(df: DataFrame, signals: DataFrame | None, as_of: str, sold_days: int = 60, trend_days: int = 90, trend_rows: int = 5) -> DataFrame:
    """One row for each (brand, model, generation) of non-duplicates; a null generation counts as empty.

    ``signals``: olx_id, undervaluation_pct, predicted_price; without them those columns of ``df`` count, if it has them.
    What the figures need of a row is stored once.
    """
    rows = df.where(F.col("duplicate_of").isNull()).withColumns({k: F.coalesce(k, F.lit("")) for k in SEGMENT})
    if signals is not None:
        rows = rows.join(signals.select("olx_id", "undervaluation_pct", "predicted_price"), "olx_id", "left")
    elif "predicted_price" not in rows.columns:
        rows = rows.withColumns({"undervaluation_pct": F.lit(None).cast("double"), "predicted_price": F.lit(None).cast("double")})
    live, gone = F.col("is_active"), sold()
    recent = gone & (F.col("deactivated_at") >= at(as_of) - F.make_dt_interval(F.lit(sold_days)))
    price, first = F.col("price_eur"), F.col("first_price_eur")
    moved = live & (first > 0) & price.isNotNull() & (whole_days(at(as_of), F.col("first_seen_at")) <= trend_days)
    change = F.when(moved, (price - first) / first * 100)
    resid = F.when(gone & (F.col("predicted_price") > 0), price - F.col("predicted_price"))
    medians = {"median_dom": F.when(recent, days_on_market()), "median_active_ask_eur": F.when(live, price), "median_sold_ask_eur": F.when(gone, price), "trend_30d_pct": change, "calibration_residual_eur": resid}
    flags = {"_live": live, "_recent": recent, "_gone": gone, "_moved": moved, "_under": F.when(live, F.col("undervaluation_pct"))}
    rows = checkpointed(rows.select(*SEGMENT, *[c.alias(k) for k, c in (flags | medians).items()]), "segments")
    out = rows.groupBy(*SEGMENT).agg(
        F.count_if("_live").alias("n_active"),
        F.count_if("_recent").alias("n_sold_60d"),
        F.count_if("_gone").alias("n_sold_total"),
        F.round(mean(F.col("_under")), 4).alias("avg_undervaluation_pct"),
        F.count_if("_moved").alias("_moved"),
    )
    out = with_medians(out, rows, list(SEGMENT), {k: k for k in medians}, stored=True)
    out = out.withColumns({"trend_30d_pct": F.round(F.when(F.col("_moved") >= trend_rows, F.col("trend_30d_pct")), 4), "calibration_residual_eur": F.round("calibration_residual_eur", 4)}).drop("_moved")
    return out.withColumn("clearing_ratio", F.round(ratio(F.col("median_sold_ask_eur"), F.col("median_active_ask_eur")), 6))


def segment_series(snapshots: DataFrame, sold_rows: DataFrame, keys: tuple[str, ...] = SEGMENT) -> DataFrame:
    """Long weekly series: median ask with its count, and median last ask of what sold that week."""
    ask = snapshots.where(F.col("price_eur") > 0).groupBy(*keys, F.date_trunc("week", "scraped_at").alias("week")).agg(median_of("price_eur").alias("value"), F.count("*").alias("n"))
    gone = sold_rows.where(F.col("deactivated_at").isNotNull()).groupBy(*keys, F.date_trunc("week", "deactivated_at").alias("week")).agg(median_of("price_eur").alias("value"), F.count("*").alias("n"))
    return ask.withColumn("metric", F.lit("median_ask")).unionByName(gone.withColumn("metric", F.lit("median_sold_ask")))


def dom_medians(df: DataFrame, most: float = 365, fast: float = 21) -> DataFrame:
    """Median days on market of sold rows and the share within ``fast`` days, by segment.

    Rows with a null generation are the fallback of their (brand, model): over all its generations,
    unless the segment without generation has sold rows of its own.
    """
    dom = days_on_market()
    rows = df.where(sold() & dom.between(0, most)).withColumn("_dom", dom)

    def agg(*keys: str) -> DataFrame:
        out = rows.groupBy(*keys).agg(F.avg((F.col("_dom") <= fast).cast("int")).alias("dom_fast_share"), F.count("*").alias("n"))
        return with_medians(out, rows, list(keys), {"dom_median": "_dom"})

    return with_fallback(agg(*SEGMENT), agg("brand", "model"))


def with_fallback(own: DataFrame, wide: DataFrame) -> DataFrame:
    """``own`` by segment, and ``wide`` by (brand, model) as rows without generation where ``own`` has none."""
    taken = own.where(F.col("generation").isNull()).select(F.col("brand").alias("_b"), F.col("model").alias("_m"))
    more = wide.join(taken, F.col("brand").eqNullSafe(F.col("_b")) & F.col("model").eqNullSafe(F.col("_m")), "left_anti")
    return own.unionByName(more.withColumn("generation", F.lit(None).cast("string")))


def calibration_residuals(df: DataFrame, own_rows: int = 3, wide_rows: int = 5) -> DataFrame:
    """Median residual % of sold rows with a positive prediction, by segment with fallback rows."""
    rows = df.where(sold() & (F.col("predicted_price") > 0) & (F.col("price_eur") > 0))
    rows = rows.withColumn("_r", (F.col("price_eur") - F.col("predicted_price")) / F.col("predicted_price") * 100)

    def agg(least: int, *keys: str) -> DataFrame:
        out = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)
        return with_medians(out, rows, list(keys), {"calibration_resid_pct": "_r"})

    return with_fallback(agg(own_rows, *SEGMENT), agg(wide_rows, "brand", "model"))


def segment_trend(snapshots: DataFrame, days: int = 90, listing: str = "listing_id") -> DataFrame:
    """Change in % from the first to the last third of weekly medians; at least two weeks.

    The window ends at the newest snapshot. Rows without generation take no part, not in the
    fallback (generation null) either.
    """
    rows = snapshots.where(F.col("price_eur") > 0)
    newest = rows.agg(F.max("scraped_at").alias("_newest"))
    # one row
    rows = rows.join(F.broadcast(newest), F.col("scraped_at") >= F.col("_newest") - F.make_dt_interval(F.lit(days))).where(present(*SEGMENT))
    weekly = rows.groupBy(*SEGMENT, listing, F.date_trunc("week", "scraped_at").alias("week")).agg(median_of("price_eur").alias("price"))

    def trend(keys: tuple[str, ...]) -> DataFrame:
        by_week = weekly.groupBy(*keys, "week").agg(median_of("price").alias("price"))
        w = Window.partitionBy(*keys)
        by_week = by_week.withColumns({"_k": F.row_number().over(w.orderBy("week")), "_n": F.count("*").over(w)})
        third = F.greatest(F.lit(1), F.floor(F.col("_n") / 3))
        ends = by_week.where("_n >= 2").groupBy(*keys).agg(
            median_of(F.when(F.col("_k") <= third, F.col("price"))).alias("_early"), median_of(F.when(F.col("_k") > F.col("_n") - third, F.col("price"))).alias("_late")
        )
        change = F.round((F.col("_late") - F.col("_early")) / F.col("_early") * 100, 2)
        return ends.where("_early > 0").select(*keys, change.alias("trend_90d_pct"))

    return trend(SEGMENT).unionByName(trend(("brand", "model")).withColumn("generation", F.lit(None).cast("string")))


def stats_trend(stats: DataFrame, as_of: str, days: int = 60, keys: tuple[str, ...] = ("brand", "model")) -> DataFrame:
    """Change in % from the first to the last daily median within ``days``, to one decimal; at least two points, the first over 0."""
    rows = stats.where((F.col("date") >= F.date_sub(at(as_of).cast("date"), days)) & F.col("median_price_eur").isNotNull())
    out = rows.groupBy(*keys).agg(F.min_by("median_price_eur", "date").alias("first"), F.max_by("median_price_eur", "date").alias("last"), F.countDistinct("date").alias("points"))
    return out.where((F.col("points") >= 2) & (F.col("first") > 0)).withColumn("trend", F.round((F.col("last") - F.col("first")) / F.col("first") * 100, 1))


def sale_velocity(df: DataFrame, fast: int = 21, rows: int = 3, keys: tuple[str, ...] = SEGMENT) -> DataFrame:
    """Share of inactive rows (whatever the reason) gone within ``fast`` days, by segment; lifespans over 0 count.

    A null key is a key of its own.
    """
    span = whole_days(F.col("deactivated_at"), F.col("first_seen_at"))
    gone = df.where(~F.col("is_active") & (span > 0))
    return gone.groupBy(*keys).agg(F.round(F.avg((span <= fast).cast("int")), 6).alias("velocity"), F.count("*").alias("n")).where(F.col("n") >= rows)


def price_dynamics(snapshots: DataFrame, key: str = "listing_id", ts: str = "scraped_at", price: str = "price_eur", tie: str = "event_id") -> DataFrame:
    """First and latest price, number and size of drops, their velocity and the days since the last.

    Only a drop from a price over 0 counts. Ties in time are ordered by ``tie``.
    """
    w = Window.partitionBy(key).orderBy(ts, tie)
    before = F.lag(price).over(w)
    drop = F.when((before > 0) & (F.col(price) < before), (before - F.col(price)) / before * 100)
    rows = snapshots.withColumn("_drop", drop)
    order = F.struct(ts, tie)
    out = rows.groupBy(key).agg(
        F.min_by(price, order).alias("first_price"),
        F.max_by(price, order).alias("latest_price"),
        F.count("_drop").alias("n_drops"),
        F.round(F.max("_drop"), 1).alias("max_drop_pct"),
        F.max(F.when(F.col("_drop").isNotNull(), F.col(ts))).alias("_last_drop"),
        F.min(ts).alias("_first"),
        F.max(ts).alias("_last"),
    )
    total = F.greatest(F.lit(0.0), ratio(F.col("first_price") - F.col("latest_price"), F.col("first_price")) * 100)
    span = F.greatest(days_between(F.col("_last"), F.col("_first")), F.lit(1.0))
    return out.select(
        key,
        "first_price",
        "latest_price",
        "n_drops",
        "max_drop_pct",
        F.round(F.when(F.col("n_drops") > 0, total / span), 3).alias("drop_velocity"),
        F.round(F.greatest(F.lit(0.0), days_between(F.col("_last"), F.col("_last_drop"))), 1).alias("days_since_drop"),
    )
