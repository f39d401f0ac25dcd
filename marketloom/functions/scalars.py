"""Numbers, times and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def at(moment: str | Column) -> Column:
    """A timestamp from text, or the column itself."""
    return F.lit(moment).cast("timestamp") if isinstance(moment, str) else moment


def seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1e6


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 86400e6


def whole_days(later: Column, earlier: Column) -> Column:
    """Days rounded down, also below zero."""
    return F.floor(days_between(later, earlier)).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or null."""
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def rounded(c: Column, digits: int) -> Column:
    """``c`` to ``digits`` places, halves away from zero after scaling: a product that lands on a half counts as one.

    ``round`` of a double looks at its shortest decimals, so 12.349999999999998 goes down there and up here, as in SQL engines that scale.
    """
    return F.round(c * 10.0**digits) / 10.0**digits


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def median_of(c: Column | str) -> Column:
    return F.percentile(c, F.lit(0.5))


def bucket(x: Column, edges: list[float], labels: list[str], right_closed: bool = False) -> Column:
    """The label of the last edge at or below x (below x if right closed); null below the first."""
    out = F.lit(None).cast("string")
    for edge, label in zip(edges, labels, strict=True):
        out = F.when((x > edge) if right_closed else (x >= edge), label).otherwise(out)
    return out


def md5_share(key: Column) -> Column:
    """A number from 0 to 1 that the key alone decides: its first 4 md5 bytes."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def adaptive_window(median_days: Column, least: float = 60, most: float = 365, default: float = 180) -> Column:
    """Days to look ahead: four times the usual days on market, within limits."""
    return F.floor(F.when(median_days.isNotNull(), clamp(4 * median_days, least, most)).otherwise(float(default)))


def ensure_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add the missing columns of ``schema`` as typed nulls."""
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in df.columns})


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating-point columns with NaN replaced by null."""
    kinds = (T.DoubleType, T.FloatType)
    return df.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, kinds)})


def sold(active: str = "is_active", reason: str = "deactivation_reason") -> Column:
    return ~F.col(active) & (F.coalesce(F.col(reason), F.lit("")) == "sold")


def sub_segment(fuel: Column, engine_cc: Column) -> Column:
    """Fuel and size of the engine as one label, such as diesel_mid; electric cars have no size.

    Null and empty fuels are ``unk``, other texts petrol; without a positive size the fuel stands alone.
    """
    t = F.lower(fuel)
    kind = (
        F.when(fuel.isNull() | (fuel == ""), "unk")
        .when(t.contains("diesel"), "diesel")
        .when(t.contains("eléctrico") | t.contains("electr"), "electric")
        .when(t.contains("híbrido") | t.contains("hybrid"), "hybrid")
        .when(t.contains("gpl"), "gpl")
        .otherwise("petrol")
    )
    size = F.when(engine_cc < 1400, "small").when(engine_cc <= 2000, "mid").otherwise("large")
    return F.when((kind == "electric") | ~F.coalesce(engine_cc > 0, F.lit(False)), kind).otherwise(F.concat_ws("_", kind, size))


def repair_cost(severity: Column, predicted: Column, poor: Column) -> Column:
    """Nothing below severity 2, the whole predicted price from 3 on; between, a share with a floor."""
    share = F.when(poor, F.greatest(0.18 * predicted, F.lit(1500.0))).otherwise(F.greatest(0.12 * predicted, F.lit(1000.0)))
    return F.when(F.coalesce(severity, F.lit(0)) < 2, 0.0).when(severity >= 3, predicted).otherwise(share)


def mean(c: Column, digits: int = 4) -> Column:
    """The average by exact decimal sums: the same in whatever order rows arrive."""
    return F.sum(c.cast(f"decimal(28,{digits})")).cast("double") / F.count(c)


# Most days on market, share of the last ask, weight of a sold row in training.
SOLD_TIERS = [(14, 0.96, 0.90), (60, 0.94, 0.70), (180, 0.91, 0.50), (365, 0.88, 0.30)]


def sold_tier(active: Column, reason: Column, days: Column) -> tuple[Column, Column]:
    """(target multiplier, weight) of a training row: the longer a car took to sell, the less its last ask says.

    Other rows pass with 1 and 1. Sold rows whose whole days are unknown, negative or beyond the last
    tier keep their price and weigh nothing.
    """
    gone = F.coalesce(~active & (reason == "sold"), F.lit(False))
    usable = gone & (days >= 0)
    times, weight = F.lit(1.0), F.when(gone, 0.0).otherwise(1.0)
    for most, share, trust in reversed(SOLD_TIERS):
        times, weight = F.when(usable & (days <= most), share).otherwise(times), F.when(usable & (days <= most), trust).otherwise(weight)
    return times, weight


def loss_weight(price: Column) -> Column:
    """Weight before scaling: a miss of some per cent costs about the same at every price."""
    return 1 / F.log1p(F.greatest(price, F.lit(0.0)) + 1)


def damage_label(visible: Column, severity: Column) -> Column:
    """true, false or null (not usable) from a viewer's answers; either answer can say no damage."""
    return F.when(visible.isNull() | (severity.isNull()), None).when((severity == 0) | ~visible, False).when(severity >= 1, True)


def photo_decision(text_severity: Column, likeliest: Column, photos: Column, limit: float = 0.20) -> Column:
    """A struct: decision (no_photos, photo_confirms, downgrade) and the recommended severity."""
    none, sure = photos == 0, likeliest >= limit
    decision = F.when(none, "no_photos").when(sure, "photo_confirms").otherwise("downgrade")
    return F.struct(decision.alias("decision"), F.when(none | sure, text_severity).otherwise(0).cast("int").alias("severity"))


def segment_score(undervaluation_pct: Column, sold: Column, median_dom: Column, trend_pct: Column) -> Column:
    """0 to 1 and more: how worthwhile a segment is; unknown parts count as nothing, an even pace or no trend."""
    cheap = clamp(F.coalesce(undervaluation_pct, F.lit(0.0)), 0, 30) / 30
    liquid = F.log1p(F.coalesce(sold, F.lit(0)).cast("double")) / F.log1p(F.lit(50.0))
    pace = 14 / F.greatest(F.coalesce(median_dom, F.lit(60.0)), F.lit(14.0))
    trend = (clamp(F.coalesce(trend_pct, F.lit(0.0)), -10, 10) + 10) / 20
    return 0.40 * cheap + 0.25 * liquid + 0.20 * pace + 0.15 * trend


def in_eur(amount: Column) -> Column:
    """Every source asks in euros, so an amount is its own value in euros."""
    return amount
