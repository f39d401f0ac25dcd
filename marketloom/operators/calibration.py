"""Calibrated price predictions: time-honest conformal widths, isotonic medians and the final bands.

Fits live in ``models``; here are the splits, the widths and their order of priority, and the chain
that puts them together. Log predictions are of log1p(price).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import loss_weight, md5_share
from . import models
from .ranks import quantiles, values_at
from .storage import checkpointed

# Price edges where there are too few rows for deciles, and the least rows of each step.
PRICE_EDGES = [0.0, 3000.0, 7000.0, 15000.0, 30000.0]
LEAST_FOR_DECILES, LEAST_IN_BUCKET, LEAST_TO_SPLIT, LEAST_TREES = 200, 30, 200, 50


def time_split(df: DataFrame, time: str, key: str, share: float = 0.2, least: int = LEAST_TO_SPLIT) -> DataFrame | None:
    """Adds ``part``: ``fit`` for the oldest rows, ``calibrate`` for the newest ``share``; None with too few rows.

    Rows without a time are left out. Rows of one instant are ordered by the key's md5.
    """
    rows = df.where(F.col(time).isNotNull()).withColumns({"_t": F.unix_micros(F.col(time).cast("timestamp")).cast("double"), "_h": md5_share(F.col(key))})
    n = rows.count()
    cut = int(n * (1 - share))
    if n < least:
        return None
    instant = values_at(rows, "_t", [cut])[""][cut]
    at = rows.where(F.col("_t") == instant)
    rank = cut - rows.where(F.col("_t") < instant).count()
    limit = values_at(at, "_h", [rank])[""][rank]
    older = (F.col("_t") < instant) | ((F.col("_t") == instant) & (F.col("_h") < limit))
    return rows.withColumn("part", F.when(older, "fit").otherwise("calibrate")).drop("_t", "_h")


def band_score(low: Column, high: Column, actual: Column) -> Column:
    """How far the actual log price lies outside the band; negative inside."""
    return F.greatest(low - actual, actual - high)


def conformal_level(n: int, coverage: float) -> float:
    return min(math.ceil(round(coverage * (n + 1), 9)) / n, 1.0)


def conformal_q(df: DataFrame, score: str, coverage: float = 0.8) -> float:
    """The finite-sample conformal quantile of a whole column; 0 without rows."""
    n = df.where(F.col(score).isNotNull()).count()
    return quantiles(df, score, [conformal_level(n, coverage)])[0] if n else 0.0


def price_edges(df: DataFrame, price: str, bins: int = 10, least: int = LEAST_FOR_DECILES) -> list[float]:
    """Lower edges of price buckets: -inf and the distinct inner deciles, or the fixed ones where these are too few."""
    if df.where(F.col(price).isNotNull()).count() < least:
        return PRICE_EDGES
    inner = sorted(set(quantiles(df, price, [k / bins for k in range(1, bins)])))
    return [-math.inf, *inner] if len(inner) >= bins - 2 else PRICE_EDGES


def bucket_at(price: Column, edges: list[float]) -> Column:
    """The number of the bucket (from 0) whose lower edge is the last at or below the price; null below the first."""
    k = sum((F.when(price >= e, 1).otherwise(0) for e in edges), F.lit(0)) - 1
    return F.when(price.isNotNull() & (k >= 0), k)


def bucket_q(df: DataFrame, score: str, bucket: str, coverage: float = 0.8, least: int = LEAST_IN_BUCKET) -> dict[int, float]:
    """The conformal quantile of each bucket with at least ``least`` scores."""
    # a row for each bucket
    counts = {r[bucket]: r["n"] for r in df.where(F.col(bucket).isNotNull() & F.col(score).isNotNull()).groupBy(bucket).agg(F.count("*").alias("n")).collect() if r["n"] >= least}
    spots = {str(k): conformal_level(n, coverage) * (n - 1) for k, n in counts.items()}
    at = values_at(df, score, {k: sorted({math.floor(s), math.ceil(s)}) for k, s in spots.items()}, bucket) if spots else {}
    return {int(k): at[k][math.floor(s)] + (at[k][math.ceil(s)] - at[k][math.floor(s)]) * (s - math.floor(s)) for k, s in spots.items()}


def width_of(price: Column, edges: list[float], by_bucket: dict[int, float], overall: float) -> Column:
    """The width of a row's bucket, else the one of all."""
    k, out = bucket_at(price, edges), F.lit(float(overall))
    for bucket, q in by_bucket.items():
        out = F.when(k == bucket, float(q)).otherwise(out)
    return out


def uncertainty_features(columns: list[str], flags: list[str], description: str, photos: str) -> dict[str, Column]:
    """How well an advert is documented: share of known columns, known flags, length of text times photos on log scales."""
    known = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0)) / F.lit(float(max(1, len(columns))))
    filled = sum((F.col(c).isNotNull().cast("int") for c in flags), F.lit(0)).cast("double")
    log = lambda c: F.log1p(F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)))
    return {"data_completeness": known, "flags_filled": filled, "description_quality": log(description) * log(photos)}


def widened(q: Column, overall: float) -> Column:
    """A row's own width: never below nothing or the width of all."""
    return F.greatest(q, F.lit(0.0), F.lit(float(overall)))


def final_bands(rows: DataFrame, out_of_fold: DataFrame | None, key: str, calibrated: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, what to ``keep``, predicted_price, fair_price_low and fair_price_high in whole EUR.

    ``rows``: key, median (price), log_low, log_high, q. ``out_of_fold`` (key, low, median, high)
    replaces the prices of rows that the models were fitted on. With a calibrated median the edges
    are put in order and stretched to hold it; else the three are sorted. Nothing is below 0.
    """
    c = F.col
    out = rows.select(key, *keep, c("median").alias("_m"), F.expm1(c("log_low") - c("q")).alias("_l"), F.expm1(c("log_high") + c("q")).alias("_h"))
    if out_of_fold is not None:
        seen = out_of_fold.select(c(key).alias("_k"), c("low").alias("_sl"), c("median").alias("_sm"), c("high").alias("_sh"))
        out = out.join(seen, c(key) == c("_k"), "left").withColumns({"_m": F.coalesce("_sm", "_m"), "_l": F.coalesce("_sl", "_l"), "_h": F.coalesce("_sh", "_h")})
    if calibrated:
        ends = F.least("_l", "_h", "_m"), c("_m"), F.greatest("_l", "_h", "_m")
    else:
        s = F.sort_array(F.array("_l", "_m", "_h"))
        ends = s[0], s[1], s[2]
    price = lambda x: F.bround(F.greatest(x, F.lit(0.0)), 0)
    return out.select(key, *keep, price(ends[1]).alias("predicted_price"), price(ends[0]).alias("fair_price_low"), price(ends[2]).alias("fair_price_high"))


def isotonic(df: DataFrame, raw: str, actual: str) -> PipelineModel:
    """A monotone map from raw to actual prices, flat beyond the seen range; adds ``calibrated``.

    Rows of one raw price count as their mean with their number as weight, to squared loss the same.
    """
    means = df.where(F.col(actual).isNotNull()).groupBy(raw).agg(F.avg(actual).alias("_mean"), F.count("*").cast("double").alias("_n"))
    return Pipeline(stages=[VectorAssembler(inputCols=[raw], outputCol="_iso"), IsotonicRegression(featuresCol="_iso", labelCol="_mean", weightCol="_n", predictionCol="calibrated")]).fit(checkpointed(means, "means"))


def stopped_trees(df: DataFrame, key: str, target: str, numeric: list[str], categorical: list[str], folds: int = 3, most: int = 200, least: int = LEAST_TREES) -> tuple[list[int], int]:
    """(trees of each fold, their median but at least ``least``) when the held-out fold stops the boosting.

    Fits see kinds of rows with their spread, so the held-out errors are those of the rows.
    """
    rows = models.kinds(df.withColumn("_fold", models.fold_of(F.col(key), folds)), target, [*numeric, *categorical, "_fold"], spread=True)

    def count(k: int) -> int:
        model = GBTRegressor(labelCol="_y", weightCol="_n", maxIter=most, maxDepth=5, maxBins=64, validationIndicatorCol="_held", validationTol=0.001, seed=7)
        fitted = Pipeline(stages=[*models.features(numeric, categorical), model]).fit(rows.withColumn("_held", F.col("_fold") == k))
        return fitted.stages[-1].getNumTrees

    counts = models.side_by_side(df.sparkSession, [partial(count, k) for k in range(folds)])
    return counts, max(least, int(sorted(counts)[len(counts) // 2]))


@dataclass
class Calibrated:
    """What a fitted chain needs to predict: models, the isotonic map, widths and, if it could be fitted, the widths' own model."""

    median: PipelineModel
    bands: models.Forest
    iso: PipelineModel
    overall: float
    edges: list[float]
    by_bucket: dict[int, float]
    width: tuple[PipelineModel, float] | None
    seen: DataFrame


def fit_chain(rows: DataFrame, key: str, price: str, time: str, numeric: list[str], categorical: list[str], extra: list[str], trees: int = 20, folds: int = 3) -> Calibrated:
    """Fit everything on ``rows`` (from ``models.prepared``, with the ``extra`` features of the widths).

    Widths come from models fitted on the oldest rows and scored on the newest; the map of the median
    from out-of-fold predictions; the models that predict are fitted on all rows.
    """
    rows = rows.withColumn("_w", loss_weight(F.col(price)))

    def fit(part: DataFrame) -> tuple[PipelineModel, models.Forest]:
        return models.fit_price(part, price, numeric, categorical, "_w", trees=trees), models.fit_forest(part, price, numeric, categorical)

    def scored(fitted: tuple[PipelineModel, models.Forest], part: DataFrame) -> DataFrame:
        mid = fitted[0].transform(part).withColumn("log_median", F.col("prediction")).drop("prediction", "features", *[f"{c}_i" for c in categorical])
        return models.with_bands(fitted[1], mid)

    def widths() -> tuple[float, list[float], dict[int, float], tuple[PipelineModel, float] | None]:
        split = time_split(rows, time, key)
        if split is None:
            return 0.0, PRICE_EDGES, {}, None
        cal = scored(fit(split.where("part = 'fit'")), split.where("part = 'calibrate'"))
        cal = cal.withColumns({"score": band_score(F.col("log_low"), F.col("log_high"), F.log1p(price)), "_price": F.expm1("log_median")})
        cal = checkpointed(cal)
        overall, edges = conformal_q(cal, "score"), price_edges(cal, "_price")
        by_bucket = bucket_q(cal.withColumn("_bucket", bucket_at(F.col("_price"), edges)), "score", "_bucket")
        halves = time_split(cal, time, key, 0.5, least=50)
        if halves is None:
            return overall, edges, by_bucket, None
        model = GBTRegressor(labelCol="score", predictionCol="width", lossType="absolute", maxIter=trees, maxDepth=4, maxBins=64, seed=7)
        fitted = Pipeline(stages=[*models.features([*numeric, *extra], categorical), model]).fit(halves.where("part = 'fit'"))
        rest = fitted.transform(halves.where("part = 'calibrate'")).withColumn("_r", F.col("score") - F.col("width"))
        return overall, edges, by_bucket, (fitted, conformal_q(rest, "_r"))

    numbered = rows.withColumn("_fold", models.fold_of(F.col(key), folds))

    def unseen(k: int) -> DataFrame:
        return scored(fit(numbered.where(F.col("_fold") != k)), numbered.where(F.col("_fold") == k)).select(key, price, "log_median", "log_low", "log_high")

    # none of them needs another; the widths take longest
    (overall, edges, by_bucket, width), final, *parts = models.side_by_side(rows.sparkSession, [widths, partial(fit, rows), *[partial(unseen, k) for k in range(folds)]])
    held = parts[0]
    for part in parts[1:]:
        held = held.unionByName(part)
    held = checkpointed(held.withColumn("raw", F.greatest(F.expm1("log_median"), F.lit(0.0))))
    iso = isotonic(held, "raw", price)
    seen = iso.transform(held).withColumn("q", width_of(F.col("calibrated"), edges, by_bucket, overall))
    seen = final_bands(seen.select(key, F.col("calibrated").alias("median"), "log_low", "log_high", "q"), None, key)
    seen = seen.select(key, F.col("fair_price_low").alias("low"), F.col("predicted_price").alias("median"), F.col("fair_price_high").alias("high"))
    return Calibrated(*final, iso, overall, edges, by_bucket, width, seen)


def backtest(df: DataFrame, key: str, price: str, time: str, numeric: list[str], categorical: list[str], splits: int = 5, q: float = 0.0, trees: int = LEAST_TREES, least: tuple[int, int, int] = (200, 100, 50)) -> DataFrame:
    """A row for each fold: models of all rows before it, tested on the next part by time, with bands widened by ``q``.

    fold, n_train, n_test, mae, mape, bias_pct, coverage. ``least``: rows in all, to train on, to test
    on. Rows of one instant are ordered by the key's md5; what does not fill a fold is left out.
    """
    rows = df.where(F.col(price).isNotNull() & F.col(time).isNotNull()).withColumns({"_t": F.unix_micros(F.col(time).cast("timestamp")).cast("double"), "_h": md5_share(F.col(key)), "_w": loss_weight(F.col(price))})
    n = rows.count()
    size = n // splits
    # where each fold begins: its first row's instant and md5
    ranks = [k * size for k in range(1, splits)]
    instants = values_at(rows, "_t", ranks)[""] if n >= least[0] else {}
    starts = []
    for r in ranks if instants else []:
        at = rows.where(F.col("_t") == instants[r])
        rank = r - rows.where(F.col("_t") < instants[r]).count()
        starts.append((instants[r], values_at(at, "_h", [rank])[""][rank]))

    def tested(k: int) -> tuple | None:
        start = starts[k - 1]
        before = lambda x: (F.col("_t") < x[0]) | ((F.col("_t") == x[0]) & (F.col("_h") < x[1]))
        train = rows.where(before(start))
        test = rows.where(~before(start) & (before(starts[k]) if k < len(starts) else F.lit(True)))
        n_train, n_test = k * size, size if k < len(starts) else n - k * size
        if n_train < least[1] or n_test < least[2]:
            return None
        median, forest = models.fit_price(train, price, numeric, categorical, "_w", trees=trees), models.fit_forest(train, price, numeric, categorical)
        guess = median.transform(test).select(key, price, *numeric, *categorical, F.expm1("prediction").alias("median"))
        bands = models.with_bands(forest, guess).withColumn("q", F.lit(float(q)))
        out = final_bands(bands, None, key, calibrated=False, keep=(price,))
        miss, scale = F.col(price) - F.col("predicted_price"), F.greatest(F.col(price), F.lit(1.0))
        r = out.agg(F.avg(F.abs(miss)), F.avg(F.abs(miss) / scale) * 100, F.avg(miss / scale) * 100, F.avg(F.col(price).between(F.col("fair_price_low"), F.col("fair_price_high")).cast("int"))).first()
        return k, n_train, n_test, *(round(x, d) for x, d in zip(r, (0, 1, 2, 3), strict=True))

    found = [x for x in models.side_by_side(df.sparkSession, [partial(tested, k + 1) for k in range(len(starts))]) if x] if starts else []
    return df.sparkSession.createDataFrame(found, "fold int, n_train long, n_test long, mae double, mape double, bias_pct double, coverage double")


def ablation(df: DataFrame, key: str, price: str, sets: dict[str, tuple[list[str], list[str]]], folds: int = 3) -> DataFrame:
    """``features, n, mae, mape, bias_pct`` out of fold for each named set of (numeric, categorical) features, on the same rows and folds."""
    out = None
    for name, (numeric, categorical) in sets.items():
        guess = models.out_of_fold(df, key, price, numeric, categorical, folds).select(F.col(key).alias("_k"), "predicted")
        miss = F.col(price) - F.col("predicted")
        part = df.select(key, price).join(guess, F.col(key) == F.col("_k"))
        part = part.agg(F.count("*").alias("n"), F.avg(F.abs(miss)).alias("mae"), (F.avg(F.abs(miss) / F.greatest(F.col(price), F.lit(1.0))) * 100).alias("mape"), (F.avg(miss / F.greatest(F.col(price), F.lit(1.0))) * 100).alias("bias_pct"))
        part = part.select(F.lit(name).alias("features"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def predict(chain: Calibrated, rows: DataFrame, key: str) -> DataFrame:
    """Bands of ``rows``: the width is a row's own, else its bucket's, else the one of all; rows seen in fitting take their out-of-fold prices."""
    used = lambda model: [s.getOutputCol() for s in model.stages if s.hasParam("outputCol")] + [c for s in model.stages if s.hasParam("outputCols") and s.isSet("outputCols") for c in s.getOutputCols()]
    raw = F.greatest(F.expm1("prediction"), F.lit(0.0))
    out = chain.median.transform(rows).withColumn("raw", raw).drop("prediction", *used(chain.median))
    out = chain.iso.transform(out).withColumn("median", F.col("calibrated")).drop("raw", "calibrated", *used(chain.iso))
    if chain.width:
        model, offset = chain.width
        out = model.transform(out).withColumn("q", widened(F.col("width") + offset, chain.overall)).drop("width", *used(model))
    else:
        out = out.withColumn("q", width_of(F.col("median"), chain.edges, chain.by_bucket, chain.overall))
    inputs = [c for s in chain.bands.model.stages if s.hasParam("inputCols") for c in s.getInputCols() if c in rows.columns]
    out = models.with_bands(chain.bands, out.select(key, "median", "q", *[c for c in dict.fromkeys(inputs) if c != key]))
    return final_bands(out, chain.seen, key)
