"""The scalar rules as SQL functions of a session: ``register(spark)``, then use them in any query.

Each is an expression that Catalyst inlines, so filters and projections through it stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .scalars import SOLD_TIERS
from .text import BRANDS, COLOURS


def _map(table: dict[str, str]) -> str:
    return "map(" + ", ".join(f"'{k}', '{v}'" for k, v in table.items()) + ")"


_UNACCENTED = "translate(lower({0}), 'áàãâéêíóôõúç', 'aaaaeeiooouc')"
_TIER = "CASE " + " ".join(f"WHEN days <= {most} THEN {{{k}}}" for k, (most, _, _) in enumerate(SOLD_TIERS)) + " ELSE 0D END"

#: name -> (arguments, type, expression)
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "ml_ratio": ("a DOUBLE, b DOUBLE", "DOUBLE", "try_divide(a, nullif(b, 0D))"),
    "ml_clamp": ("x DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE", "greatest(low, least(high, x))"),
    "ml_whole_days": ("later TIMESTAMP, earlier TIMESTAMP", "BIGINT", "CAST(floor((unix_micros(later) - unix_micros(earlier)) / 86400000000D) AS BIGINT)"),
    "ml_digits": ("c STRING", "BIGINT", r"try_cast(regexp_replace(c, '[^0-9]', '') AS BIGINT)"),
    "ml_brand": ("c STRING", "STRING", f"coalesce(try_element_at({_map(BRANDS)}, lower(trim(c))), trim(c), '')"),
    "ml_colour": ("c STRING", "STRING", f"coalesce(try_element_at({_map(COLOURS)}, lower(trim(c))), nullif(lower(trim(c)), ''))"),
    "ml_unaccented": ("c STRING", "STRING", _UNACCENTED.format("c")),
    "ml_md5_share": ("key STRING", "DOUBLE", "CAST(conv(substring(md5(key), 1, 8), 16, 10) AS DOUBLE) / 4294967295D"),
    "ml_window_days": ("median_days DOUBLE", "BIGINT", "CAST(floor(coalesce(greatest(60D, least(365D, 4 * median_days)), 180D)) AS BIGINT)"),
    "ml_repair_cost": ("severity INT, predicted DOUBLE, poor BOOLEAN", "DOUBLE", "CASE WHEN coalesce(severity, 0) < 2 THEN 0D WHEN severity >= 3 THEN predicted WHEN poor THEN greatest(0.18D * predicted, 1500D) ELSE greatest(0.12D * predicted, 1000D) END"),
    "ml_sold_weight": ("days BIGINT", "DOUBLE", "CASE WHEN days IS NULL OR days < 0 THEN 0D ELSE " + _TIER.format(*[f"{w}D" for _, _, w in SOLD_TIERS]) + " END"),
    "ml_engine_size": ("cc DOUBLE", "STRING", "CASE WHEN cc <= 0 THEN NULL WHEN cc < 1400 THEN 'small' WHEN cc <= 2000 THEN 'mid' WHEN cc > 2000 THEN 'large' END"),
}


def register(spark: SparkSession) -> list[str]:
    """Create or replace the functions in the session; their names."""
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    return sorted(FUNCTIONS)
