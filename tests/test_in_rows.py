"""Steps, waterfalls and scores that are worked out in their rows: as from tables by key, and right where keys repeat."""

import pytest
from pyspark.sql import functions as F

from marketloom.operators import evaluation, explain, models


@pytest.fixture(scope="module")
def cars(spark):
    rows = spark.range(400).select(F.concat(F.lit("i"), (F.col("id") % 390).cast("string")).alias("id"), (F.col("id") % 37 * 500 + F.col("id") % 7 * 90 + 800).cast("double").alias("price"), (F.col("id") % 37).cast("int").alias("year"), (F.col("id") % 7).cast("int").alias("km"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("brand"))
    return models.prepared(rows, ["year", "km"], ["brand"]).persist()


def test_steps_and_waterfall_of_rows(spark, cars):
    model = models.fit_price(cars, "price", ["year", "km"], ["brand"], trees=4)
    steps, n = explain.path_steps(model, cars, "id")
    assert n == 3 and steps.count() == 400
    miss = F.abs(F.col("base") + F.aggregate("steps", F.lit(0.0), lambda a, x: a + x["contribution"]) - F.col("prediction"))
    assert steps.agg(F.max(miss)).first()[0] < 1e-9
    once = cars.dropDuplicates(["id"])
    for top in (2, 5):
        got = evaluation.row_waterfall(explain.path_steps(model, once, "id")[0], "id", "steps", "base", n, top)
        want = evaluation.waterfall(explain.path_contributions(model, once, "id"), "id", "feature", "contribution", "base", top)
        told = [{(r.id, r.step, r.feature): r.delta_eur for r in x.collect()} for x in (got, want)]
        assert told[0].keys() == told[1].keys() and all(v == pytest.approx(told[1][k], abs=2e-5) for k, v in told[0].items())


def test_no_row_moves(spark, cars):
    model = models.fit_price(cars, "price", ["year", "km"], ["brand"], trees=2)
    steps, n = explain.path_steps(model, cars, "id")
    for df in (steps, evaluation.row_waterfall(steps, "id", "steps", "base", n, 2)):
        assert "Exchange" not in df.select("id")._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")


def test_axes_in_one_pass(spark, cars):
    once = cars.dropDuplicates(["id"])
    axes = {"one": (models.isolation_forest(once, ["year", "km"], trees=5, key="id"), ["year", "km"]), "two": (models.isolation_forest(once, ["price"], trees=5, key="id"), ["price"])}
    want = models.worst_axis({k: models.anomaly_scores(once, forest, "id", columns) for k, (forest, columns) in axes.items()}, "id")
    got = models.axis_scores(once, axes, "id")
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
