"""Fits on kinds of rows: what stands for the rows, and bands worked out once for rows of the same leaves."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import calibration, models


@pytest.fixture(scope="module")
def cars(spark):
    rng = np.random.default_rng(5)
    rows = [(f"i{i}", float(500 + 300 * (i % 12) + 10 * rng.integers(0, 40)), float(2000 + i % 12), "AB"[i % 2]) for i in range(600)]
    return spark.createDataFrame(rows, "id string, price double, year double, brand string").persist()


def test_kinds_stand_for_rows(spark, cars):
    one = {(r.year, r.brand): (r._n, r._y) for r in models.kinds(cars, "price", ["year", "brand"]).collect()}
    copies = cars.unionByName(cars).unionByName(cars).unionByName(cars.limit(5).withColumn("price", F.lit(None).cast("double")))
    three = {(r.year, r.brand): (r._n, r._y) for r in models.kinds(copies, "price", ["year", "brand"]).collect()}
    assert len(one) == 12 and one.keys() == three.keys()
    for k, (n, y) in one.items():
        assert three[k] == (3 * n, pytest.approx(y))
    weighted = cars.withColumn("w", F.when(F.col("brand") == "A", 2.0).otherwise(0.0))
    assert {(r.brand, r._n) for r in models.kinds(weighted, "price", ["brand"], "w").collect()} == {("A", 600.0)}


def test_spread_keeps_squared_errors(spark, cars):
    rows = models.kinds(cars, "price", ["year"], spread=True).collect()
    for year in (2000.0, 2007.0):
        own = [math.log1p(r.price) for r in cars.where(F.col("year") == year).collect()]
        for guess in (5.0, 8.0):
            assert sum(r._n * (r._y - guess) ** 2 for r in rows if r.year == year) == pytest.approx(sum((y - guess) ** 2 for y in own))


def test_rows_without_a_price_do_not_stop_a_fit(spark, cars):
    gaps = cars.withColumn("price", F.when(F.crc32("id") % 9 > 0, F.col("price")))
    model = models.fit_price(gaps, "price", ["year"], ["brand"], trees=3)
    assert model.transform(cars).where("prediction is null").count() == 0
    forest = models.fit_forest(gaps, "price", ["year"], ["brand"], trees=3)
    # each tree's leaves hold every known price once, as a leaf here is smaller than the points it may keep
    sizes = {r.tree: r.n for r in forest.pools.groupBy("tree").agg(F.sum(F.size("points")).alias("n")).collect()}
    known = gaps.where("price is not null").count()
    assert sizes.keys() == {0, 1, 2} and all(n <= known for n in sizes.values())
    bands = models.with_bands(forest, cars)
    assert bands.columns == [*cars.columns, "log_low", "log_high"] and bands.count() == 600


def test_isotonic_of_equal_raw_prices(spark):
    df = spark.createDataFrame([(1.0, 10.0), (1.0, 20.0), (1.0, 60.0), (2.0, 20.0), (3.0, 50.0)], "raw double, price double")
    got = {r.raw: r.calibrated for r in calibration.isotonic(df, "raw", "price").transform(df).collect()}
    # 1 and 2 are pooled: (10 + 20 + 60 + 20) / 4
    assert got == {1.0: pytest.approx(27.5), 2.0: pytest.approx(27.5), 3.0: 50.0}
