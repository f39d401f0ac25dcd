"""Forest pools, contributions and saved models against brute force."""

import datetime as dt

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from marketloom.operators import calibration, evaluation, explain, models, persistence
from marketloom.operators.storage import names_in

NUMERIC, CATEGORICAL = ["year", "km"], ["brand"]


@pytest.fixture(scope="module")
def cars(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(900):
        year, km = int(rng.integers(2000, 2020)), int(rng.integers(10_000, 200_000))
        price = max(500.0, (year - 2000) * 600 - km * 0.02 + (i % 3) * 900 + float(rng.normal(0, 300 + 60 * (year - 2000))) + 4000)
        rows.append((f"i{i}", price, year, km, "ABC"[i % 3], dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), 0.5))
    df = spark.createDataFrame(rows, "id string, price double, year int, km int, brand string, seen timestamp, extra double")
    return models.prepared(df, NUMERIC, CATEGORICAL).persist()


def test_bands_pool_the_weights_of_all_leaves(cars):
    forest = models.fit_forest(cars, "price", NUMERIC, CATEGORICAL, trees=4, points=1000)
    got = {r.id: (r.log_low, r.log_high) for r in models.forest_bands(forest, cars, "id").collect()}
    seen = forest.model.transform(cars).select("id", F.log1p("price").alias("y"), vector_to_array("leaves").alias("l")).collect()
    leaves, y = np.array([r.l for r in seen]), np.array([r.y for r in seen])
    for k in range(0, 900, 45):
        same = leaves == leaves[k]
        weights = (same / same.sum(axis=0)).mean(axis=1)
        order = np.argsort(y)
        reached = np.searchsorted(np.cumsum(weights[order]), [0.1 - 1e-12, 0.9 - 1e-12])
        assert got[seen[k].id] == pytest.approx(tuple(y[order][reached]), abs=1e-12)


def test_large_leaves_keep_ranks(cars):
    exact = models.fit_forest(cars, "price", NUMERIC, CATEGORICAL, trees=3, points=1000)
    few = models.fit_forest(cars, "price", NUMERIC, CATEGORICAL, trees=3, points=16)
    assert few.pools.agg(F.max(F.size("points"))).first()[0] == 16
    both = models.forest_bands(exact, cars, "id").join(models.forest_bands(few, cars, "id").toDF("id", "l", "h"), "id")
    assert both.agg(F.avg(F.abs(F.col("log_high") - F.col("h")))).first()[0] < 0.05


def test_pooled_quantiles_by_hand():
    pools = [np.array([1.0, 2.0]), np.array([2.0, 5.0, 9.0, 9.0])]
    # weights: 1: 1/4, 2: 1/4 + 1/8, 5: 1/8, 9: 1/4
    assert models.pooled_quantiles(pools, [0.0, 0.25, 0.3, 0.625, 0.63, 0.75, 0.76, 1.0]).tolist() == [1, 1, 2, 2, 5, 5, 9, 9]


def test_pooled_bands_cover_at_least_what_averaged_leaf_quantiles_do(cars):
    train, test = cars.where(F.crc32("id") % 3 > 0), cars.where(F.crc32("id") % 3 == 0)
    forest = models.fit_forest(train, "price", NUMERIC, CATEGORICAL)
    rows = models.forest_bands(forest, test, "id").join(test.select("id", F.log1p("price").alias("y")), "id")
    pooled = rows.agg(F.avg(F.col("y").between(F.col("log_low"), F.col("log_high")).cast("int"))).first()[0]
    pools = {(r.tree, int(r.leaf)): np.quantile(r.points, [0.1, 0.9]) for r in forest.pools.collect()}
    averaged = []
    for r in forest.model.transform(test).select(F.log1p("price").alias("y"), vector_to_array("leaves").alias("l")).collect():
        low, high = np.mean([pools[x] for x in enumerate(map(int, r.l))], axis=0)
        averaged.append(low <= r.y <= high)
    # an average of quantiles is narrower than the quantiles of the mixture
    assert pooled >= np.mean(averaged) and pooled >= 0.78


def test_contributions_add_up_to_the_prediction(cars):
    for model in (models.fit_price(cars, "price", NUMERIC, CATEGORICAL, trees=8), models.fit_forest(cars, "price", NUMERIC, CATEGORICAL, trees=5).model):
        assert explain.inputs_of(model) == ["year", "km", "brand"]
        parts = explain.path_contributions(model, cars, "id")
        sums = parts.groupBy("id").agg((F.max("base") + F.sum("contribution")).alias("total"), F.count("*").alias("n"))
        both = sums.join(model.transform(cars).select("id", "prediction"), "id")
        assert both.count() == 900 and both.agg(F.max(F.abs(F.col("total") - F.col("prediction")))).first()[0] < 1e-9
        assert both.agg(F.min("n"), F.max("n")).first() == (3, 3)
        # the mean of the contributions is nothing that explains the mean prediction: base is the root's mean
        weights = {r.feature: r.w for r in parts.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("w")).collect()}
        assert weights["year"] > weights["brand"] > 0


def test_waterfall_of_contributions_ends_at_the_price(cars):
    model = models.fit_price(cars, "price", NUMERIC, CATEGORICAL, trees=5)
    parts = explain.path_contributions(model, cars, "id")
    steps = evaluation.waterfall(parts, "id", "feature", "contribution", "base", 2).groupBy("id").agg(F.sum("delta_eur").alias("sum"))
    want = model.transform(cars).select("id", F.expm1("prediction").alias("price_")).join(parts.groupBy("id").agg(F.expm1(F.max("base")).alias("from")), "id")
    assert steps.join(want, "id").agg(F.max(F.abs(F.col("sum") + F.col("from") - F.col("price_")))).first()[0] < 1e-4


def test_occlusion_by_segment(spark, cars):
    model = models.fit_price(cars, "price", NUMERIC, CATEGORICAL, trees=5)
    own = {(r.id, r.feature): r.contribution for r in explain.occlusion(model, cars, "id", NUMERIC, ["brand"]).collect()}
    medians = {r.brand: r.m for r in cars.groupBy("brand").agg(F.percentile("year", F.lit(0.5)).alias("m")).collect()}
    at = cars.where("brand = 'B'").limit(20)
    full = {r.id: r.prediction for r in model.transform(at).collect()}
    without = {r.id: r.prediction for r in model.transform(at.withColumn("year", F.lit(float(medians["B"])))).collect()}
    assert len(own) == 1800 and all(own[i, "year"] == pytest.approx(full[i] - without[i]) for i in full)


def test_chain_round_trip_and_gate(spark, cars, tmp_path):
    folder, features, fitted = str(tmp_path / "models"), [*NUMERIC, *CATEGORICAL, "extra"], "2024-03-01 00:00:00"
    assert persistence.load_chain(spark, folder, features, fitted) is None
    chain = calibration.fit_chain(cars, "id", "price", "seen", NUMERIC, CATEGORICAL, ["extra"], trees=3, folds=2)
    name = persistence.save_chain(chain, spark, folder, features, fitted)
    later = "2024-03-01 20:00:00"
    again = persistence.load_chain(spark, folder, features, later)
    new = cars.withColumn("id", F.concat(F.lit("new"), "id"))
    for rows in (cars, new):
        want, got = ({tuple(r) for r in calibration.predict(x, rows, "id").collect()} for x in (chain, again))
        assert got == want and len(want) == 900
    # too old, another feature list or order, another schema
    assert persistence.load_chain(spark, folder, features, "2024-03-02 00:00:01") is None
    assert persistence.load_chain(spark, folder, features[::-1], later) is None
    assert persistence.load_chain(spark, folder, features[:-1], later) is None
    assert persistence.load_chain(spark, folder, features, later, version=2) is None
    refused = [r.refused for r in persistence.gate(persistence.metadata(spark, folder), ["x"], later).collect()]
    assert refused == ["features"]
    # what was not finished does not exist; the newest usable one is taken, not the newest
    half = persistence.save_model(spark, folder, features, "2024-03-01 19:00:00", {"median": chain.median})
    (tmp_path / "models" / half / "meta" / "_SUCCESS").unlink()
    other = persistence.save_model(spark, folder, ["other"], "2024-03-01 18:00:00", {"median": chain.median})
    assert persistence.load_model(spark, folder, features, later).pipelines.keys() == {"median", "bands", "iso", "width"}
    # a finished model that has lost a part is no model
    (tmp_path / "models" / name / "pipelines" / "iso" / "metadata" / "part-00000").unlink(missing_ok=True)
    import shutil

    shutil.rmtree(tmp_path / "models" / name / "pipelines" / "iso")
    assert persistence.load_chain(spark, folder, features, later) is None
    assert persistence.prune_models(spark, folder, keep=1) == [name] and sorted(names_in(spark, folder)) == sorted([half, other])


def test_hazard_round_trip(spark, cars, tmp_path):
    rows = cars.withColumn("label", (F.col("price") > 8000).cast("int"))
    model = models.fit_hazard(rows, "label", ["price", *NUMERIC], CATEGORICAL)
    folder = str(tmp_path / "hazard")
    persistence.save_hazard(model, spark, folder, ["price"], "2024-03-01 00:00:00", 30, {"auc": 0.9})
    again, horizon, metrics = persistence.load_hazard(spark, folder, ["price"], "2024-03-01 10:00:00")
    scores = [models.hazard_scores(x, rows, "id", "price").orderBy("id").collect() for x in (model, again)]
    assert scores[0] == scores[1] and (horizon, metrics) == (30, {"auc": 0.9})
    assert persistence.load_hazard(spark, folder, ["price"], "2024-03-03 10:00:00") is None
    assert persistence.load_chain(spark, folder, ["price"], "2024-03-01 10:00:00") is None
