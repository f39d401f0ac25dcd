"""Queries of models on listings, with SQL where no fit is involved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import calibration as c
from ..operators import evaluation as v
from ..operators import explain, models, persistence
from ..operators.storage import checkpointed, shared_path
from .registry import AS_OF, Tables, query

NUMERIC, CATEGORICAL = ["year", "mileage_km", "engine_cc", "horsepower"], ["brand", "fuel_type"]


def training(t: Tables) -> DataFrame:
    """Features and targets, stored once: every pass of a fit reads them.

    The listings are stored before, as the rare categories are counted first.
    """
    rows = checkpointed(t.listings.select("olx_id", "price_eur", "is_active", "deactivation_reason", "first_seen_at", "deactivated_at", *NUMERIC, *CATEGORICAL), "listings")
    return checkpointed(models.prepared(rows, NUMERIC, CATEGORICAL), "training")


@query("m04_price_model")
def _(t: Tables) -> DataFrame:
    rows = training(t)
    model = models.fit_price(rows, "price_eur", NUMERIC, CATEGORICAL)
    return model.transform(rows).select("olx_id", "price_eur", F.expm1("prediction").alias("predicted_price"))


@query("m05_price_bands")
def _(t: Tables) -> DataFrame:
    rows = training(t)
    return models.quantile_forest(rows, rows, "olx_id", "price_eur", NUMERIC, CATEGORICAL)


@query("m06_out_of_fold")
def _(t: Tables) -> DataFrame:
    return models.out_of_fold(training(t), "olx_id", "price_eur", NUMERIC, CATEGORICAL)


@query("m17_permutation_importance")
def _(t: Tables) -> DataFrame:
    rows = training(t)
    model = models.fit_price(rows, "price_eur", NUMERIC, CATEGORICAL)
    return models.permutation_importance(model, rows, "price_eur", {"year": ["year"], "use": ["mileage_km"], "engine": ["engine_cc", "horsepower"]})


@query("m19_occlusion")
def _(t: Tables) -> DataFrame:
    rows = training(t)
    parts = explain.occlusion(models.fit_price(rows, "price_eur", NUMERIC, CATEGORICAL), rows, "olx_id", NUMERIC, segment=["brand"])
    return parts.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("importance"))


def explained(t: Tables) -> tuple[DataFrame, int]:
    """Rows with their prediction and the steps that add up to it. The listings are stored once, with what the model reads."""
    rows = models.prepared(checkpointed(t.listings.select("olx_id", "price_eur", *NUMERIC, *CATEGORICAL), "listings"), NUMERIC, CATEGORICAL)
    return explain.path_steps(models.fit_price(rows, "price_eur", NUMERIC, CATEGORICAL), rows, "olx_id")


@query("m19_path_contributions")
def _(t: Tables) -> DataFrame:
    """Each prediction with the steps that add up to it (log scale), and the miss of that sum."""
    rows, _ = explained(t)
    total = F.aggregate("steps", F.lit(0.0), lambda a, x: a + x["contribution"])
    main = F.array_max(F.transform("steps", lambda x: F.struct(F.abs(x["contribution"]).alias("size"), x["feature"].alias("feature"))))["feature"]
    return rows.select("olx_id", "base", "prediction", main.alias("main_feature"), F.abs(F.col("base") + total - F.col("prediction")).alias("miss"))


@query("w09_model_waterfall")
def _(t: Tables) -> DataFrame:
    """The waterfall in EUR of the model's own contributions; the steps of a listing add up to its price less the base's."""
    rows, n = explained(t)
    return v.row_waterfall(rows, "olx_id", "steps", "base", n, 3)


GATE_SQL = """meta AS (SELECT 'm' || o_orderkey AS model, o_custkey % 7 AS line, CASE WHEN o_orderkey % 4 = 0 THEN 0 WHEN o_orderkey % 9 > 0 THEN 1 END AS schema_version,
      CASE WHEN o_orderkey % 5 = 0 THEN ['year'] WHEN o_orderkey % 11 > 0 THEN ['year', 'mileage_km'] END AS features, CASE WHEN o_orderkey % 13 > 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS fitted_at FROM orders),
    gated AS (SELECT *, CASE WHEN schema_version IS DISTINCT FROM 1 THEN 'version' WHEN features IS DISTINCT FROM ['year', 'mileage_km'] THEN 'features'
      WHEN coalesce(epoch(TIMESTAMP '2001-08-01' - fitted_at) / 3600 > 4800, true) THEN 'age' END AS refused FROM meta)"""


def model_metadata(t: Tables) -> DataFrame:
    """Orders as saved models of seven product lines."""
    k = F.col("o_orderkey")
    return t.orders.select(
        F.concat(F.lit("m"), k.cast("string")).alias("model"),
        (F.col("o_custkey") % 7).alias("line"),
        F.when(k % 4 == 0, 0).when(k % 9 > 0, 1).alias("schema_version"),
        F.when(k % 5 == 0, F.array(F.lit("year"))).when(k % 11 > 0, F.array(F.lit("year"), F.lit("mileage_km"))).alias("features"),
        F.when(k % 13 > 0, F.col("o_orderdate").cast("timestamp")).alias("fitted_at"),
    )


def gated(t: Tables) -> DataFrame:
    return persistence.gate(model_metadata(t), ["year", "mileage_km"], "2001-08-01 00:00:00", version=1, max_age_hours=4800)


@query("m28_model_gate", f"WITH {GATE_SQL} SELECT line, coalesce(refused, 'usable') AS refused, count(*) AS n FROM gated GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return gated(t).groupBy("line", F.coalesce("refused", F.lit("usable")).alias("refused")).agg(F.count("*").alias("n"))


@query("m28_newest_usable", f"WITH {GATE_SQL} SELECT line, arg_max(model, {{'t': fitted_at, 'm': model}}) AS model, max(fitted_at) AS fitted_at FROM gated WHERE refused IS NULL GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return persistence.newest_usable(gated(t), ["line"])


@query("m28_saved_chain")
def _(t: Tables) -> DataFrame:
    """Predictions of a chain that was saved and loaded again through its gate."""
    rows = chain_rows(t)
    chain = c.fit_chain(rows, "olx_id", "price_eur", "first_seen_at", NUMERIC, CATEGORICAL, EXTRA, trees=4, folds=2)
    folder, features = shared_path(t.spark, "models"), [*NUMERIC, *CATEGORICAL, *EXTRA]
    persistence.save_chain(chain, t.spark, folder, features, AS_OF)
    return c.predict(persistence.load_chain(t.spark, folder, features, AS_OF), rows, "olx_id")


@query("m07_stopped_trees")
def _(t: Tables) -> DataFrame:
    counts, chosen = c.stopped_trees(training(t), "olx_id", "price_eur", NUMERIC, CATEGORICAL)
    return t.spark.createDataFrame([(*counts, chosen)], "a int, b int, c int, chosen int")


SPLIT_SQL = """cut AS (SELECT olx_id, price_eur, part_id, first_seen_at, row_number() OVER (ORDER BY first_seen_at, CAST('0x' || md5(olx_id)[1:8] AS BIGINT)) AS k, count(*) OVER () AS n FROM listings WHERE first_seen_at IS NOT NULL)"""


@query("m09_time_split", f"WITH {SPLIT_SQL} SELECT olx_id, CASE WHEN k <= CAST(floor(n * (1 - 0.2::DOUBLE)) AS BIGINT) THEN 'fit' ELSE 'calibrate' END AS part FROM cut")
def _(t: Tables) -> DataFrame:
    return c.time_split(t.listings, "first_seen_at", "olx_id").select("olx_id", "part")


@query(
    "m11_widths",
    """WITH s AS (SELECT olx_id, price_eur, part_id % 97 / 100 - 0.3 + price_eur / 1000000 AS score FROM listings WHERE first_seen_at >= TIMESTAMP '2000-01-01'),
    e AS (SELECT list_distinct(quantile_cont(price_eur, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS cuts FROM s),
    b AS (SELECT s.*, len(list_filter(cuts, lambda x: x <= price_eur)) AS bucket FROM s, e),
    g AS (SELECT bucket, list_sort(list(score)) AS l, count(*) AS n FROM b GROUP BY 1 HAVING count(*) >= 30), p AS (SELECT *, least(ceil(round(0.8 * (n + 1), 9)) / n, 1) * (n - 1) AS pos FROM g),
    q AS (SELECT bucket, l[floor(pos)::INT + 1] + (l[ceil(pos)::INT + 1] - l[floor(pos)::INT + 1]) * (pos - floor(pos)) AS q FROM p)
    SELECT olx_id, bucket, round(q, 6) AS q FROM b JOIN q USING (bucket)""",
)
def _(t: Tables) -> DataFrame:
    score = F.col("part_id") % 97 / 100 - 0.3 + F.col("price_eur") / 1_000_000
    # edges, widths and result all read them
    rows = checkpointed(t.listings.where("first_seen_at >= '2000-01-01'").select("olx_id", "price_eur", score.alias("score")), "scores")
    edges, overall = c.price_edges(rows, "price_eur"), c.conformal_q(rows, "score")
    rows = rows.withColumn("bucket", c.bucket_at(F.col("price_eur"), edges).cast("long"))
    widths = c.bucket_q(rows, "score", "bucket")
    return rows.select("olx_id", "bucket", F.round(c.width_of(F.col("price_eur"), edges, widths, overall), 6).alias("q"))


@query(
    "m15_assembly",
    """WITH p AS (SELECT olx_id, part_id % 5 = 0 AS seen, price_eur * (7 + part_id % 7) / 10 AS m, exp(ln(1 + price_eur * 0.8) - part_id % 4 / 10) - 1 AS a, exp(ln(1 + price_eur * 1.1) + part_id % 4 / 10) - 1 AS b, price_eur FROM listings),
    f AS (SELECT olx_id, CASE WHEN seen THEN price_eur * 1.2 ELSE m END AS m, CASE WHEN seen THEN price_eur * 0.5 ELSE a END AS a, CASE WHEN seen THEN price_eur ELSE b END AS b FROM p)
    SELECT olx_id, round_even(greatest(m, 0), 0) AS predicted_price, round_even(greatest(least(a, b, m), 0), 0) AS fair_price_low, round_even(greatest(a, b, m, 0), 0) AS fair_price_high FROM f""",
)
def _(t: Tables) -> DataFrame:
    k, p = F.col("part_id"), F.col("price_eur")
    rows = t.listings.select("olx_id", (p * (7 + k % 7) / 10).alias("median"), F.log1p(p * 0.8).alias("log_low"), F.log1p(p * 1.1).alias("log_high"), (k % 4 / 10).alias("q"))
    seen = t.listings.where("part_id % 5 = 0").select("olx_id", (p * 0.5).alias("low"), (p * 1.2).alias("median"), p.alias("high"))
    return c.final_bands(rows, seen, "olx_id")


def chain_rows(t: Tables) -> DataFrame:
    k = F.col("part_id")
    rows = t.listings.select("olx_id", "price_eur", "first_seen_at", *NUMERIC, *CATEGORICAL, "generation", (k % 300).alias("description_length"), F.when(k % 6 > 0, k % 9).alias("photo_count"), F.when(k % 4 > 0, True).alias("warranty"))
    extra = c.uncertainty_features([*NUMERIC, *CATEGORICAL, "generation"], ["warranty"], "description_length", "photo_count")
    return checkpointed(models.prepared(checkpointed(rows.withColumns(extra), "listings"), NUMERIC, CATEGORICAL), "training")


EXTRA = ["data_completeness", "flags_filled", "description_quality"]


@query("m15_predict")
def _(t: Tables) -> DataFrame:
    rows = chain_rows(t)
    chain = c.fit_chain(rows, "olx_id", "price_eur", "first_seen_at", NUMERIC, CATEGORICAL, EXTRA, trees=6)
    return c.predict(chain, rows, "olx_id")


@query(
    "x34_uncertainty_features",
    """SELECT olx_id, round(((year IS NOT NULL)::INT + (mileage_km IS NOT NULL)::INT + (fuel_type IS NOT NULL)::INT + (generation IS NOT NULL)::INT) / 4, 6) AS data_completeness, ((source IS NOT NULL)::INT + (duplicate_of IS NOT NULL)::INT)::DOUBLE AS flags_filled,
    round(ln(1 + length(title)) * ln(1 + CASE WHEN part_id % 6 > 0 THEN part_id % 9 ELSE 0 END), 6) AS description_quality FROM listings""",
)
def _(t: Tables) -> DataFrame:
    p = F.col("part_id")
    rows = t.listings.withColumns({"_len": F.length("title"), "_photos": F.when(p % 6 > 0, p % 9)})
    made = c.uncertainty_features(["year", "mileage_km", "fuel_type", "generation"], ["source", "duplicate_of"], "_len", "_photos")
    return rows.select("olx_id", *[F.round(x, 6).alias(name) for name, x in made.items()])


@query("m21_backtest")
def _(t: Tables) -> DataFrame:
    return c.backtest(training(t), "olx_id", "price_eur", "first_seen_at", NUMERIC, CATEGORICAL)


@query("m27_ablation")
def _(t: Tables) -> DataFrame:
    return c.ablation(training(t), "olx_id", "price_eur", {"all": (NUMERIC, CATEGORICAL), "without engine": (["year", "mileage_km"], CATEGORICAL)}, folds=2)


@query(
    "m23_hazard_features",
    """WITH p AS (SELECT olx_id, price_eur, CASE WHEN part_id % 7 > 0 THEN p_retailprice * 25 ELSE 0 END AS predicted FROM listings JOIN part ON part_id = p_partkey)
    SELECT olx_id, round(ln(1 + greatest(price_eur, 0)), 6) AS log_price, round(CASE WHEN predicted > 0 THEN (price_eur - predicted) / predicted * 100 END, 6) AS residual_pct, round(CASE WHEN predicted > 0 THEN (predicted * 1.2 - predicted * 0.9) / predicted * 100 END, 4) AS band_pct FROM p""",
)
def _(t: Tables) -> DataFrame:
    rows = t.listings.join(t.part.select(F.col("p_partkey").alias("part_id"), "p_retailprice"), "part_id")
    rows = rows.withColumn("predicted_price", F.when(F.col("part_id") % 7 > 0, F.col("p_retailprice") * 25).otherwise(0.0))
    rows = rows.withColumns({"fair_price_low": F.col("predicted_price") * 0.9, "fair_price_high": F.col("predicted_price") * 1.2})
    made = models.hazard_features(rows)
    return made.select("olx_id", F.round("log_price", 6).alias("log_price"), F.round("residual_pct", 6).alias("residual_pct"), F.round("band_pct", 4).alias("band_pct"))


@query(
    "m25_hazard_quality",
    """WITH s AS (SELECT CASE WHEN part_id % 3 > 0 THEN is_active::INT END AS y, (part_id * 37 % 1000) / 1000 AS p FROM listings), r AS (SELECT y, p, greatest(1e-9, least(1 - 1e-9, p)) AS q FROM s WHERE y IS NOT NULL),
    g AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM r GROUP BY 1), c AS (SELECT *, sum(neg) OVER (ORDER BY p) - neg AS lower FROM g)
    SELECT (SELECT count(*) FROM r) AS n, round((SELECT avg(y) FROM r), 6) AS base_rate, round((SELECT -avg(CASE y WHEN 1 THEN ln(q) ELSE ln(1 - q) END) FROM r), 6) AS log_loss, round(sum(pos * (lower + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM c""",
)
def _(t: Tables) -> DataFrame:
    p = F.col("part_id")
    rows = t.listings.select(F.when(p % 3 > 0, F.col("is_active").cast("int")).alias("label"), (p * 37 % 1000 / 1000).alias("prob_sold"))
    return models.hazard_quality(rows).select("n", *[F.round(x, 6).alias(x) for x in ("base_rate", "log_loss", "auc")])


@query("m25_hazard_model")
def _(t: Tables) -> DataFrame:
    rows = v.hazard_target(training(t), AS_OF)
    model = models.fit_hazard(rows.where("labelled"), "label", ["price_eur", *NUMERIC], CATEGORICAL)
    return models.hazard_scores(model, rows, "olx_id", "price_eur")


@query("m25_hazard_by_time")
def _(t: Tables) -> DataFrame:
    """Fitted on the oldest labelled rows, judged on the newest."""
    rows = c.time_split(v.hazard_target(training(t), AS_OF).where("labelled"), "first_seen_at", "olx_id")
    model = models.fit_hazard(rows.where("part = 'fit'"), "label", ["price_eur", *NUMERIC], CATEGORICAL)
    newest = rows.where("part = 'calibrate'")
    scores = models.hazard_scores(model, newest, "olx_id", "price_eur")
    return models.hazard_quality(newest.select(F.col("olx_id").alias("_k"), "label").join(scores, F.col("_k") == F.col("olx_id")))


@query("m26_anomaly")
def _(t: Tables) -> DataFrame:
    """Two axes: the car as described, and its price against a prediction (here a part's retail price)."""
    described, against = ["price_eur", *NUMERIC], ["residual_pct", "band_pct"]
    rows = t.priced_listings.select("olx_id", "part_id", *described, (F.col("retail_price") * 25).alias("predicted_price"))
    rows = models.hazard_features(rows.withColumns({"fair_price_low": F.col("predicted_price") * 0.9, "fair_price_high": F.col("predicted_price") * (1.1 + F.col("part_id") % 3 / 10)}))
    rows = checkpointed(rows.select("olx_id", *described, *against), "axes")
    axes = {name: (models.isolation_forest(rows, columns, key="olx_id"), columns) for name, columns in (("described", described), ("priced", against))}
    return models.axis_scores(rows, axes, "olx_id")
