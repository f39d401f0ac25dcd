"""Relist matching, deal signals and verdicts: composed plans of joins and CASE columns."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import adaptive_window, at, clamp, days_between, ratio, repair_cost, rounded, sold
from ..functions.text import canonical_colour, numbers_out, salvage_phrase
from . import relists
from .enrich import with_comparables, with_segment
from .storage import checkpointed

# Match score and verdict constants.
NOISE_KM, KM_PER_DAY = 2000, 100
BONUS = {"generation": 0.05, "sub_model": 0.05, "trim_level": 0.05, "doors": 0.05, "seats": 0.03, "drive_type": 0.03}
MIN_SAMPLE, WIDE_BAND, TIGHT_BAND = 5, 0.40, 0.25
MIN_MARGIN, MIN_MARGIN_SLOW, SOFTENING, DOM_LIMIT, DEFAULT_HOLD = 12.0, 18.0, -3.0, 120.0, 45.0
FLAT_FEES, HOLDING_PER_DAY, BUY_SCORE, WATCH_SCORE, ANOMALY_LIMIT = 150.0, 1.30, 18.0, 15.0, 0.90
FAST_SHARE, HAZARD_FAST, HAZARD_SLOW = 0.30, 0.70, 0.25


def _no(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def relist_sides(df: DataFrame, dom: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Sold originals (columns ``o_*`` and window_days) and all candidates (``c_*``).

    The window is four times the segment's days on market (``dom``), else the default.
    """
    rows = df.where(F.col("duplicate_of").isNull())
    first = rows.where(sold() & F.col("deactivated_at").isNotNull())
    first = with_segment(first, dom, ["dom_median"]) if dom is not None else first.withColumn("dom_median", F.lit(None).cast("double"))
    keep = [c for c in rows.columns if c != "duplicate_of"]
    o = first.select(*[F.col(c).alias(f"o_{c}") for c in keep], adaptive_window(F.col("dom_median")).alias("window_days"))
    return o, rows.select(*[F.col(x).alias(f"c_{x}") for x in keep])


MET_BY = ["_slot", "_b", "_m", "_y"]


def in_slots(o: DataFrame, c: DataFrame, slot_days: float) -> tuple[DataFrame, DataFrame]:
    """Both sides with the columns that a pair must share (``MET_BY``).

    The range part of the join is pre-cut: an original is copied to the time slots that its own window
    reaches, so the equi-join has the slot as a key and compares with no more than a slot beyond the
    window at each end.
    """
    slot = lambda t: F.floor(F.unix_micros(t) / F.lit(slot_days * 86400e6)).cast("long")
    last = F.col("o_deactivated_at") + F.make_dt_interval(F.col("window_days").cast("int"))
    o = o.withColumns({"_slot": F.explode(F.sequence(slot(F.col("o_deactivated_at")), slot(last))), "_b": F.col("o_brand"), "_m": F.col("o_model"), "_y": F.col("o_year")})
    return o, c.withColumns({"_slot": slot(F.col("c_first_seen_at")), "_b": F.col("c_brand"), "_m": F.col("c_model"), "_y": F.col("c_year")})


def _met(o: DataFrame, c: DataFrame, keys: list[str] = MET_BY) -> DataFrame:
    pairs = o.join(c, keys).withColumn("gap_days", days_between(F.col("c_first_seen_at"), F.col("o_deactivated_at")))
    return pairs.where((F.col("gap_days") > 0) & (F.col("gap_days") <= F.col("window_days"))).drop(*keys)


def within_window(o: DataFrame, c: DataFrame, slot_days: float = 30) -> DataFrame:
    """Rows of ``o`` with those of ``c`` of the same brand, model and year whose gap_days lie in the window."""
    return _met(*in_slots(o, c, slot_days))


def relist_pairs(df: DataFrame, dom: DataFrame | None = None, key: str = "olx_id", slot_days: float = 30) -> DataFrame:
    """Sold originals with later candidates of the same brand, model and year within the window: ``o_*``, ``c_*`` and gap_days."""
    return within_window(*relist_sides(df, dom), slot_days).where(F.col(f"o_{key}") != F.col(f"c_{key}"))


#: What the gates and the score look at, besides brand, model, year and times.
LOOKED_AT = ["mileage_km", "fuel_type", "transmission", "engine_cc", "horsepower", "district", "color", *BONUS]


def _rules(fields: list[str], least: float = 0.0, scored: bool = True) -> relists.Rules:
    """``gates`` and ``match_score`` for the matching inside tasks, in hundredths."""
    told = tuple((f"_{k}", 10) for k in SPELLED if k in fields) + tuple((k, round(100 * w)) for k, w in BONUS.items() if k in fields)
    near = tuple(x for x in (("engine_cc", 50, 10, -20), ("horsepower", 10, 5, -15)) if x[0] in fields)
    gated = relists.Rules(equal=("fuel_type", "transmission"), grown="mileage_km", noise=NOISE_KM, rate=KM_PER_DAY)
    return replace(gated, near=near, agree=told, least=least) if scored else gated


def relist_counts(df: DataFrame, dom: DataFrame | None = None, gated: bool = False, key: str = "olx_id", most: int = relists.BLOCK, told_gap: bool = True) -> DataFrame:
    """``o_<key>, n, gap``: the number of an original's pairs (with ``gated`` those that pass the gates) and their least gap.

    Pairs are counted inside tasks, those of the gates without looking at each if no gap is to be told; ``df`` is read several times, so it should be stored.
    """
    rules = _rules([], scored=False) if gated else relists.Rules()
    rows, _ = relists.blocks(df, dom, key, rules.fields, most)
    schema = T.StructType([T.StructField(f"o_{key}", df.schema[key].dataType), T.StructField("n", T.LongType()), T.StructField("gap", T.DoubleType())])
    found = relists.in_groups(rows, lambda table: relists.count_in(table, key, rules, told_gap), schema)
    return found.groupBy(f"o_{key}").agg(F.sum("n").alias("n"), F.min("gap").alias("gap"))


def gates(pairs: DataFrame) -> DataFrame:
    """Fuel and transmission must agree if both are known; mileage must be plausible for the gap."""
    same = lambda k: F.coalesce(F.col(f"o_{k}") == F.col(f"c_{k}"), F.lit(True))
    gain = F.col("c_mileage_km") - F.col("o_mileage_km")
    fits = F.coalesce((gain >= -NOISE_KM) & (gain <= KM_PER_DAY * F.greatest(F.col("gap_days"), F.lit(1.0)) + NOISE_KM), F.lit(True))
    return pairs.where(same("fuel_type") & same("transmission") & fits)


#: Texts that are compared in one spelling, by field: the name of what agrees and the spelling.
SPELLED = {"district": ("district", lambda c: F.lower(F.trim(c))), "color": ("colour", canonical_colour)}


def spelled(rows: DataFrame, side: str) -> DataFrame:
    """Texts of one side in the spelling that ``match_score`` compares, so that it is worked out for rows and not for pairs."""
    have = [k for k in SPELLED if f"{side}_{k}" in rows.columns]
    return rows.withColumns({f"{side}__{k}": SPELLED[k][1](F.col(f"{side}_{k}")) for k in have}).drop(*[f"{side}_{k}" for k in have])


def match_score(pairs: DataFrame) -> DataFrame:
    """Adds ``score`` (0.5 and what agrees, at most 1) and ``reasons``; fields that are missing are left out."""
    terms: list[tuple[str, Column, float, float]] = []
    have = lambda k: f"o_{k}" in pairs.columns
    both = lambda k: F.col(f"o_{k}").isNotNull() & F.col(f"c_{k}").isNotNull()
    if have("engine_cc"):
        terms.append(("engine", F.when(both("engine_cc"), F.abs(F.col("o_engine_cc") - F.col("c_engine_cc")) <= 50), 0.10, -0.20))
    if have("horsepower"):
        terms.append(("power", F.when(both("horsepower"), F.abs(F.col("o_horsepower") - F.col("c_horsepower")) <= 10), 0.05, -0.15))
    for field, (name, spell) in SPELLED.items():
        if have(f"_{field}") or have(field):
            own = [F.col(f"{side}__{field}") if have(f"_{field}") else spell(F.col(f"{side}_{field}")) for side in "oc"]
            terms.append((name, own[0] == own[1], 0.10, 0.0))
    terms += [(k, F.col(f"o_{k}").cast("string") == F.col(f"c_{k}").cast("string"), w, 0.0) for k, w in BONUS.items() if have(k)]
    score = F.lit(0.5)
    for _, hit, plus, minus in terms:
        score = score + F.when(hit, plus).when(~hit, minus).otherwise(0.0)
    reasons = F.array_compact(F.array(F.lit("skeleton"), *[F.when(hit, name) for name, hit, _, _ in terms]))
    return pairs.withColumns({"score": F.round(F.least(score, F.lit(1.0)), 4), "reasons": F.concat_ws(", ", reasons)})


def scored_pairs(df: DataFrame, dom: DataFrame | None = None, key: str = "olx_id", slot_days: float = 90, keys_a_task: int = 8000, pairs_a_task: int = 1_000_000_000) -> DataFrame:
    """``o_<key>, c_<key>, score``: every pair of rows that passes the gates; ``df`` is read several times, so it should be stored.

    Rows move once to their segment and slot. There, those that gates and score can't tell apart are one row with a list
    of keys (at most 1000; more are several rows), and a pair of such rows becomes pairs of keys on its way out, so
    nothing that grows with the pairs is shuffled or stored before the result. A task holds about ``keys_a_task``
    candidates: a dictionary of Parquet holds their keys, so a written pair takes few bits. The originals of a segment of
    more than ``pairs_a_task`` pairs are dealt to several tasks, which all get its candidates.
    """
    fields = [k for k in LOOKED_AT if k in df.columns]
    segment, keys = MET_BY[1:], [*MET_BY, "_deal"]
    sold_rows = F.count_if(sold() & F.col("deactivated_at").isNotNull())
    sizes = df.where(F.col("duplicate_of").isNull()).groupBy(*[F.col(k).alias(x) for k, x in zip(["brand", "model", "year"], segment)]).agg((F.count("*") * sold_rows).alias("_n"))
    large = F.broadcast(checkpointed(sizes.where(F.col("_n") > pairs_a_task).select(*segment, F.ceil(F.col("_n") / pairs_a_task).cast("int").alias("_deals")), "large-segments"))
    deals = F.coalesce("_deals", F.lit(1))
    parts = max(df.sparkSession.sparkContext.defaultParallelism, df.count() // keys_a_task)

    o, c = in_slots(*relist_sides(df, dom), slot_days)
    o = spelled(o.select(*MET_BY, f"o_{key}", "o_deactivated_at", "window_days", *[f"o_{k}" for k in fields]), "o")
    c = spelled(c.select(*MET_BY, f"c_{key}", "c_first_seen_at", *[f"c_{k}" for k in fields]), "c")
    o = o.join(large, segment, "left").withColumn("_deal", F.pmod(F.xxhash64(f"o_{key}"), deals).cast("int")).drop("_deals")
    c = c.join(large, segment, "left").withColumn("_deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("_deals")

    def listed(rows: DataFrame, own: str, name: str) -> DataFrame:
        kind = [x for x in rows.columns if x != own]
        at = F.row_number().over(Window.partitionBy(*kind).orderBy(own)) - 1
        rows = rows.repartition(parts, *keys).withColumn("_part", F.floor(at / 1000))
        return rows.groupBy(*kind, "_part").agg(F.collect_list(own).alias(name)).drop("_part")

    pairs = match_score(gates(_met(listed(o, f"o_{key}", "_o"), listed(c, f"c_{key}", "_c"), keys)))
    rows = pairs.select(F.explode("_o").alias(f"o_{key}"), "_c", "score").select(f"o_{key}", F.explode("_c").alias(f"c_{key}"), "score")
    return rows.where(F.col(f"o_{key}") != F.col(f"c_{key}"))


def best_candidates(pairs: DataFrame, least_score: float = 0.0, key: str = "olx_id") -> DataFrame:
    """The best candidate of each original: highest score, then shortest gap, then id."""
    w = Window.partitionBy(f"o_{key}").orderBy(F.desc("score"), "gap_days", f"c_{key}")
    return pairs.where(F.col("score") >= least_score).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def best_relists(df: DataFrame, dom: DataFrame | None, least_score: float = 0.0, key: str = "olx_id", keep: list[str] | None = None, most: int = relists.BLOCK) -> DataFrame:
    """What ``best_candidates`` finds among all scored pairs, without building them: ``o_*`` and ``c_*``, gap_days and score.

    With ``keep`` only the key and these columns of both sides are told, else all and the reasons. ``df`` is read several times,
    so it should be stored.
    """
    fields = [k for k in LOOKED_AT if k in df.columns]
    rules = _rules(fields, least_score)
    told = list(dict.fromkeys([key, *keep] if keep is not None else [k for k in df.columns if k != "duplicate_of"]))
    rows = df.withColumns({f"_{k}": spell(F.col(k)) for k, (_, spell) in SPELLED.items() if k in fields})
    rows, _ = relists.blocks(rows, dom, key, [*told, *rules.fields], most)
    sides = [T.StructField(f"{side}_{k}", df.schema[k].dataType) for side in "oc" for k in told]
    schema = T.StructType([*sides, T.StructField("gap_days", T.DoubleType()), T.StructField("score", T.DoubleType())])
    found = best_candidates(relists.in_groups(rows, lambda table: relists.best_in(table, key, rules, told), schema), least_score, key)
    return found if keep is not None else match_score(found)


def find_relists(df: DataFrame, dom: DataFrame | None, least_score: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    best = best_relists(df, dom, least_score, keep=keep if keep is None else ["price_eur", "mileage_km", *keep])
    return best.withColumns({"price_delta_eur": F.round(F.col("c_price_eur") - F.col("o_price_eur"), 2), "mileage_delta_km": F.col("c_mileage_km") - F.col("o_mileage_km")})


def outcomes(relists: DataFrame, df: DataFrame, key: str = "olx_id", least_gap: float = 7, low: float = 5, high: float = 100, fee_share: float = 0.03, fee_flat: float = 200.0) -> DataFrame:
    """Buy and sell price, days held and fees of relists that sold again, with a usable gap and change."""
    again = df.where(sold()).select(F.col(key).alias("_sold"))
    r = relists.join(again, F.col(f"c_{key}") == F.col("_sold"), "left_semi")
    change = F.abs(ratio(F.col("c_price_eur") - F.col("o_price_eur"), F.col("o_price_eur")) * 100)
    r = r.where((F.col("o_price_eur") > 0) & F.col("c_price_eur").isNotNull() & (F.col("gap_days") >= least_gap) & change.between(low, high))
    held = days_between(F.col("c_deactivated_at"), F.col("o_deactivated_at"))
    return r.select(
        F.col(f"o_{key}").alias(key), F.col("o_price_eur").alias("buy_price"), F.col("c_price_eur").alias("sell_price"), F.round(held, 4).alias("days_held"), F.round(F.col("c_price_eur") * fee_share + fee_flat, 4).alias("fees_eur")
    )


def photo_flagged(flag: Column, p: Column, limit: float = 0.20) -> Column:
    return F.coalesce(flag, p >= limit, F.lit(False))


def blocking_reason(accident: Column, severity: Column, right_hand: Column, text: Column, condition: Column, flagged: Column) -> Column:
    """The first reason not to trade, or null."""
    phrase = salvage_phrase(text)
    return F.coalesce(
        F.when(accident, "accident"),
        F.when(severity >= 3, F.concat(F.lit("severity "), severity.cast("string"))),
        F.when(right_hand, "right-hand drive"),
        F.when(phrase.isNotNull(), F.concat(F.lit("salvage: "), phrase)),
        F.when(F.lower(F.trim(condition)) == "poor", "poor condition"),
        F.when(flagged, "photo damage"),
    )


def multipliers(liquidity_days: Column, trend_pct: Column, velocity: Column, sample: Column, band: Column, price: Column) -> dict[str, Column]:
    """Opportunity multipliers from segment figures and the row's own columns."""
    listed, change, urgent = F.col("days_listed"), F.col("price_change_eur"), F.col("urgency")
    dropped = _no((listed > 30) & (change < 0))
    return {
        "liquidity_mult": F.when(liquidity_days > 0, clamp(30 / liquidity_days, 0.5, 2.0)).otherwise(1.0),
        "trend_mult": clamp(1 + F.coalesce(trend_pct, F.lit(0.0)) / 100, 0.8, 1.2),
        "motivated_mult": F.when(dropped, F.least(1 + F.abs(change) / price * 0.5, F.lit(1.3))).when(_no(listed > 60), 1.1).otherwise(1.0),
        "urgency_mult": F.when(urgent == "high", 1.3).when(urgent == "medium", 1.1).otherwise(1.0),
        "warranty_mult": F.when(F.col("warranty"), 1.15).otherwise(1.0),
        "velocity_mult": F.when(velocity.isNotNull(), clamp(0.7 + velocity * 0.8, 0.7, 1.5)).otherwise(1.0),
        "sample_mult": F.when(sample >= 10, 1.2).when(sample >= 7, 1.1).when(sample >= 5, 1.0).otherwise(0.7),
        "band_mult": F.when(band <= 0.15, 1.15).when(band <= 0.25, 1.0).when(band <= 0.40, 0.7).when(band > 0.40, 0.4).otherwise(1.0),
    }


def deal_signals(active: DataFrame, comparables: DataFrame, grains: dict[str, tuple[str, ...]], predictions: DataFrame, turnover: DataFrame, trend: DataFrame, velocity: DataFrame) -> DataFrame:
    """One row for each deal: cheap against comparables and prediction, not blocked, worth it after repairs.

    ``active`` carries days_listed, price_change_eur, urgency, warranty, damage_severity, poor and
    blocked; ``predictions``: olx_id, predicted_price, fair_price_low, fair_price_high. ``turnover``
    (avg_days_to_sell) and ``velocity`` are by segment, ``trend`` (in %) by (brand, model); a segment
    without days to sell takes those of its (brand, model) without generation.
    """
    rows = with_comparables(active.where(F.col("price_eur") > 0), comparables, grains, MIN_SAMPLE)
    price, median, predicted = F.col("price_eur"), F.col("comparable_median"), F.col("predicted_price")
    rows = rows.where((price < median * 0.85) & F.col("blocked").isNull())
    rows = rows.join(predictions, "olx_id").where(predicted > 0)
    rows = rows.withColumns({"undervaluation_pct": rounded((1 - price / predicted) * 100, 1), "repair_cost_eur": repair_cost(F.col("damage_severity"), predicted, _no(F.col("poor")))})
    rows = rows.withColumn("adjusted_pct", rounded((predicted - price - F.col("repair_cost_eur")) / predicted * 100, 1))
    rows = rows.where((F.col("undervaluation_pct") > 0) & (F.col("adjusted_pct") > 0)).withColumn("discount_pct", rounded((1 - price / median) * 100, 1))
    rows = with_segment(rows, turnover.where(F.col("avg_days_to_sell").isNotNull()), ["avg_days_to_sell"]).join(trend.select("brand", "model", "trend"), ["brand", "model"], "left")
    own = velocity.select(F.col("brand").alias("_b"), F.col("model").alias("_m"), F.col("generation").alias("_g"), "velocity")
    rows = rows.join(own, (F.col("brand") == F.col("_b")) & (F.col("model") == F.col("_m")) & F.col("generation").eqNullSafe(F.col("_g")), "left").drop("_b", "_m", "_g")
    rows = rows.withColumn("band_frac", (F.col("fair_price_high") - F.col("fair_price_low")) / predicted)
    rows = rows.withColumns(multipliers(F.col("avg_days_to_sell"), F.col("trend"), F.col("velocity"), F.col("comparable_n"), F.col("band_frac"), price))
    product = F.col("adjusted_pct")
    for k in ("liquidity_mult", "trend_mult", "motivated_mult", "urgency_mult", "warranty_mult", "velocity_mult", "sample_mult", "band_mult"):
        product = product * F.col(k)
    return rows.withColumn("flip_score", rounded(rounded(product, 6), 1))


def figure(c: Column, digits: int = 0, signed: bool = False) -> Column:
    """A number as text, halves rounded to even."""
    return F.format_string(f"%{'+' if signed else ''}.{digits}f", F.bround(c.cast("double"), digits))


def decide(rows: DataFrame) -> DataFrame:
    """Verdict, score, reasons and components of the ordered decision steps for a whole table.

    Needs price_eur, predicted_price, fair_price_low, sample_size, band_pct, repair_cost_eur,
    damage_severity, accident, right_hand_drive, anomaly_score, prob_sold, days_listed,
    price_change_eur, urgency, warranty, first_owner, fleet, owners and the segment columns
    dom_median, dom_fast_share, trend_90d_pct, calibration_resid_pct. A row leaves at the first exit
    whose condition holds. ``reasons`` lists in order what was noted up to there, the exit last;
    ``components`` holds the figures computed up to there.
    """
    c = F.col
    price, predicted, low = F.coalesce(c("price_eur"), F.lit(0.0)), c("predicted_price"), c("fair_price_low")
    band, resid = c("band_pct") / 100, c("calibration_resid_pct")
    sample, repair = F.coalesce(c("sample_size"), F.lit(0)), F.coalesce(c("repair_cost_eur"), F.lit(0.0))
    hold = F.least(F.coalesce(c("dom_median"), F.lit(DEFAULT_HOLD)), F.lit(DOM_LIMIT))
    df = rows.withColumn("_corrected", F.when(resid.isNotNull(), predicted * (1 + resid / 100)).otherwise(predicted))
    df = df.withColumn("_fees", FLAT_FEES + HOLDING_PER_DAY * hold).withColumn("_net", c("_corrected") - price - repair - c("_fees"))
    df = df.withColumn("_net_pct", F.coalesce(ratio(c("_net"), c("_corrected")) * 100, F.lit(0.0)))
    trend, dom, fast, prob, net_pct = c("trend_90d_pct"), c("dom_median"), c("dom_fast_share"), c("prob_sold"), c("_net_pct")
    falling = F.when(trend < 0, -trend).otherwise(0.0)
    bargain, wide = _no(price <= low), F.concat(F.lit("band ±"), figure(band * 50), F.lit("%"))
    tell = F.concat
    dropped = (c("days_listed") > 30) & (c("price_change_eur") < 0)
    nothing = F.lit(0.0)
    # (condition, text, (verdict, score) of an exit or None of a note), in order
    steps: list[tuple[Column, Column, tuple[str, Column] | None]] = [
        (c("accident"), F.lit("accident mentioned"), ("REJECT", nothing)),
        (c("damage_severity") >= 3, tell(F.lit("damage severity "), c("damage_severity").cast("string")), ("REJECT", nothing)),
        (c("right_hand_drive"), F.lit("right-hand drive"), ("REJECT", nothing)),
        (c("anomaly_score") >= ANOMALY_LIMIT, tell(F.lit("outlier: anomaly score "), figure(c("anomaly_score"), 2)), ("REJECT", nothing)),
        (predicted.isNull() | (predicted <= 0), F.lit("no prediction"), ("NO_OPINION", nothing)),
        (sample < MIN_SAMPLE, tell(F.lit("only "), sample.cast("string"), F.lit(" comparables")), ("NO_OPINION", nothing)),
        (band > WIDE_BAND, tell(wide, F.lit(" is too wide")), ("NO_OPINION", nothing)),
        (band > TIGHT_BAND, tell(wide, F.lit(" lowers confidence")), None),
        (band <= TIGHT_BAND, tell(wide, F.lit(" is tight")), None),
        (F.abs(resid) > 5, tell(F.lit("prediction corrected by "), figure(resid, 1, True), F.lit("%")), None),
        (resid.isNotNull() & (c("_corrected") <= price), F.lit("ask at or above corrected value"), ("REJECT", nothing)),
        (net_pct < MIN_MARGIN, tell(F.lit("net margin "), figure(net_pct, 1), F.lit("% below 12%")), ("SKIP", F.greatest(nothing, net_pct))),
        (bargain, tell(F.lit("ask "), F.format_number(price, 0), F.lit(" at or below the low band "), F.format_number(low, 0)), None),
        (~bargain & (price > predicted), F.lit("ask above the median"), ("REJECT", nothing)),
        (~bargain, F.lit("ask between low and median"), None),
        ((trend < SOFTENING) & (net_pct < 2 * falling), tell(F.lit("trend "), figure(trend, 1, True), F.lit("%, net margin "), figure(net_pct, 1), F.lit("% below twice the drop")), ("SKIP", net_pct)),
        (trend < SOFTENING, tell(F.lit("trend "), figure(trend, 1, True), F.lit("%, margin covers twice the drop")), None),
        ((trend >= SOFTENING) & (trend < 0), tell(F.lit("trend "), figure(trend, 1, True), F.lit("%, discounted")), None),
        (trend >= 0, tell(F.lit("trend "), figure(trend, 1, True), F.lit("%, firming")), None),
        (dom > DOM_LIMIT, tell(figure(dom), F.lit(" days on market: capital trap")), ("SKIP", net_pct)),
        ((dom > 60) & (net_pct < MIN_MARGIN_SLOW), tell(figure(dom), F.lit(" days on market: margin below 18%")), ("SKIP", net_pct)),
        (dom > 60, tell(figure(dom), F.lit(" days on market: slow, margin clears")), None),
        (dom <= 30, tell(figure(dom), F.lit(" days on market: fast")), None),
        (fast < FAST_SHARE, tell(F.lit("only "), figure(fast * 100), F.lit("% sold within 21 days")), None),
        (prob >= HAZARD_FAST, tell(F.lit("likely to sell soon: "), figure(prob, 2)), None),
        (prob <= HAZARD_SLOW, tell(F.lit("unlikely to sell soon: "), figure(prob, 2)), None),
        (dropped, tell(F.lit("motivated: "), c("days_listed").cast("string"), F.lit(" days listed, dropped "), F.format_number(F.abs(c("price_change_eur")), 0)), None),
        (~_no(dropped) & (c("days_listed") > 60), tell(c("days_listed").cast("string"), F.lit(" days listed: room to negotiate")), None),
        (c("urgency").isin("high", "medium"), tell(F.lit("urgency "), c("urgency")), None),
        (c("warranty"), F.lit("warranty"), None),
        (c("first_owner"), F.lit("first owner"), None),
        (c("fleet"), F.lit("taxi or rental"), None),
        (c("owners") >= 3, tell(c("owners").cast("string"), F.lit(" owners")), None),
    ]
    exit_at = F.lit(len(steps))
    for k, (condition, _, leaves) in reversed(list(enumerate(steps))):
        if leaves:
            exit_at = F.when(_no(condition), k).otherwise(exit_at)
    df = df.withColumn("_exit", exit_at)
    band_conf = F.when(band > TIGHT_BAND, 0.7).when(band.isNotNull(), 1.15).otherwise(1.0) * F.when(bargain, 1.15).otherwise(1.0)
    calibration = F.when(F.abs(resid) > 5, 0.85).otherwise(1.0)
    velocity = F.when(dom > 60, 0.85).when(dom <= 30, 1.1).otherwise(1.0) * F.when(fast < FAST_SHARE, 0.9).otherwise(1.0)
    velocity = velocity * F.when(prob >= HAZARD_FAST, 1.10).when(prob <= HAZARD_SLOW, 0.85).otherwise(1.0)
    motivated = F.when(dropped, 1.15).when(c("days_listed") > 60, 1.05).otherwise(1.0)
    motivated = motivated * F.when(c("urgency") == "high", 1.15).when(c("urgency") == "medium", 1.05).otherwise(1.0)
    resale = F.when(c("warranty"), 1.05).otherwise(1.0) * F.when(c("first_owner"), 1.05).otherwise(1.0) * F.when(c("fleet"), 0.92).otherwise(1.0) * F.when(c("owners") >= 3, 0.95).otherwise(1.0)
    df = df.withColumns({"_profit": (c("_net") - price * falling / 100) * resale, "_conf": band_conf * F.least(sample / 10.0, F.lit(1.0)) * calibration * motivated * velocity})
    df = df.withColumn("_profit_pct", F.coalesce(ratio(c("_profit"), c("_corrected")) * 100, F.lit(0.0)))
    df = df.withColumn("_score", c("_profit_pct") * c("_conf"))
    verdict, points = F.when(c("_score") >= BUY_SCORE, "BUY").when(c("_score") >= WATCH_SCORE, "WATCH").otherwise("SKIP"), rounded(rounded(c("_score"), 6), 1)
    for k, (_, _, leaves) in enumerate(steps):
        if leaves:
            verdict, points = F.when(c("_exit") == k, leaves[0]).otherwise(verdict), F.when(c("_exit") == k, leaves[1]).otherwise(points)
    noted = [F.when(_no(condition) & ((c("_exit") == k) if leaves else (c("_exit") > k)), text) for k, (condition, text, leaves) in enumerate(steps)]
    # a figure counts from the step that computes it, unknown ones where the step tells that they are
    last = len(steps)
    figures: list[tuple[str, Column, Column]] = [
        ("anomaly_score", F.bround(c("anomaly_score"), 2), (c("_exit") >= 3) & c("anomaly_score").isNotNull()),
        ("band_pct", c("band_pct"), (c("_exit") >= 6) & band.isNotNull()),
        ("calibration_resid_pct", resid, (c("_exit") >= 10) & resid.isNotNull()),
        *[(name, F.bround(value, digits), c("_exit") >= 11) for name, value, digits in (("predicted_corrected", c("_corrected"), 0), ("net_margin_eur", c("_net"), 0), ("net_margin_pct", net_pct, 1), ("repair_cost_eur", repair, 0), ("fees_eur", c("_fees"), 0))],
        ("trend_90d_pct", F.bround(trend, 2), c("_exit") >= 15),
        ("dom_median", F.bround(dom, 0), c("_exit") >= 19),
        ("dom_fast_share", F.bround(fast, 2), c("_exit") >= 19),
        ("prob_sold", F.bround(prob, 2), (c("_exit") == last) & prob.isNotNull()),
        *[(name, F.bround(value, digits), c("_exit") == last) for name, value, digits in (("expected_profit_eur", c("_profit"), 0), ("expected_profit_pct", c("_profit_pct"), 1), ("confidence", c("_conf"), 2), ("score", c("_score"), 1))],
    ]
    entries = F.array_compact(F.array(*[F.when(_no(there), F.struct(F.lit(name).alias("k"), value.cast("double").alias("v"))) for name, value, there in figures]))
    out = df.withColumns({"verdict": verdict, "score": points, "reasons": F.array_compact(F.array(*noted)), "components": F.map_from_entries(entries)})
    return out.drop("_corrected", "_fees", "_net", "_net_pct", "_exit", "_profit", "_profit_pct", "_conf", "_score")


def new_alerts(signals: DataFrame, seen: DataFrame, least: float = 15.0, key: str = "olx_id") -> DataFrame:
    """Signals at least ``least`` % below their comparables whose key was not alerted before."""
    told = seen.select(F.col(key).alias("_seen"))
    return signals.where(F.col("discount_pct") >= least).join(told, F.col(key) == F.col("_seen"), "left_anti")


def rechecked(signals: DataFrame, fresh: DataFrame, as_of: str, stale_days: float = 1.0, least: float = 15.0, key: str = "olx_id") -> DataFrame:
    """Candidates for alerts after a look at fresh prices.

    Signals seen within ``stale_days`` stand. Of the others only those found in ``fresh`` (key,
    price_eur, is_active) as active stay, with the discount to the median recomputed from the new
    price; a null price keeps the old one. Below ``least`` % they go.
    """
    new = fresh.select(F.col(key).alias("_f"), F.col("price_eur").alias("_price"), F.col("is_active").alias("_alive"))
    rows = signals.join(new, F.col(key) == F.col("_f"), "left")
    stale = F.coalesce(days_between(at(as_of), F.col("last_seen_at")) > stale_days, F.lit(True))
    price = F.when(stale, F.coalesce("_price", "price_eur")).otherwise(F.col("price_eur"))
    rows = rows.where(~stale | _no(F.col("_alive"))).withColumn("price_eur", price)
    rows = rows.withColumn("discount_pct", rounded((1 - F.col("price_eur") / F.col("median_price_eur")) * 100, 1))
    return rows.where(F.col("discount_pct") >= least).drop("_f", "_price", "_alive")


def segment_context(tables: list[DataFrame]) -> DataFrame:
    """Segment tables (brand, model, generation and figures) side by side, for every segment that any of them has.

    Each becomes rows of one union whose figures are gathered by segment: one shuffle for all.
    """
    figures = [k for t in tables for k in t.columns if k not in ("brand", "model", "generation")]
    rows = [t.select("brand", "model", "generation", *[(F.col(k) if k in t.columns else F.lit(None).cast("double")).alias(k) for k in figures]) for t in tables]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy("brand", "model", "generation").agg(*[F.max(k).alias(k) for k in figures])


def top_reasons(decided: DataFrame, top: int = 5) -> DataFrame:
    """The ``top`` commonest reasons of each verdict with numbers taken out; ties by text."""
    said = decided.select("verdict", F.explode("reasons").alias("_r")).groupBy("verdict", numbers_out(F.col("_r")).alias("reason")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("verdict").orderBy(F.desc("n"), "reason")
    return said.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def context_spread(context: DataFrame, columns: list[str]) -> DataFrame:
    """``name, n, p10, p50, p90`` of each column of a segment table; a table of segments, not of listings."""
    long = context.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).cast("double").alias("v")) for k in columns])).alias("_x")).select("_x.*").where("v is not null")
    at = F.percentile("v", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return long.groupBy("name").agg(F.count("*").alias("n"), at.alias("_p")).select("name", "n", *[F.col("_p")[i].alias(k) for i, k in enumerate(("p10", "p50", "p90"))])


def verdict_histogram(decided: DataFrame) -> DataFrame:
    """Count, share and median score of each verdict."""
    total = decided.agg(F.count("*").alias("_all"))
    out = decided.groupBy("verdict").agg(F.count("*").alias("n"), F.round(F.percentile("score", F.lit(0.5)), 4).alias("median_score"))
    # one row
    return out.join(F.broadcast(total), F.lit(True)).withColumn("share", F.round(F.col("n") / F.col("_all"), 6)).drop("_all")
