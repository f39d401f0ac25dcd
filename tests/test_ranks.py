"""Exact quantiles of groups, however large one of them is."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import ranks


def rows_of(seed=1, n=1200):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        # half of the rows in one group; null keys; repeated, missing and negative values
        a = "hot" if rng.random() < 0.5 else rng.choice(["x", "y", None])
        b = None if rng.random() < 0.2 else int(rng.integers(3)) if a != "hot" else 1
        v = None if rng.random() < 0.1 else float(rng.integers(-40, 400)) / 4
        rows.append((a if a is None else str(a), b, v, None if v is None else v * v))
    return [*rows, ("none", 1, None, None), ("one", 1, 3.5, 12.25)]


@pytest.mark.parametrize("most", [1_000_000, 20, 1])
def test_grouped_quantiles_whatever_the_size(spark, most):
    rows = rows_of()
    df = spark.createDataFrame(rows, "a string, b int, v double, w double").repartition(5)
    levels = [0.0, 0.1, 0.5, 0.73, 1.0]
    got = {(r.a, r.b): (r.n, r.quantiles) for r in ranks.grouped_quantiles(df, "v", ["a", "b"], levels, most).collect()}
    want = {}
    for a, b, v, _ in rows:
        if v is not None:
            want.setdefault((a, b), []).append(v)
    assert got.keys() == want.keys() and ("none", 1) not in got
    for k, v in want.items():
        assert got[k][0] == len(v) and np.allclose(got[k][1], np.quantile(v, levels), rtol=0, atol=1e-9)


@pytest.mark.parametrize("most", [1_000_000, 20])
def test_medians_beside_other_figures(spark, most):
    rows = rows_of(2)
    df = spark.createDataFrame(rows, "a string, b int, v double, w double")
    groups = df.groupBy("a", "b").agg(F.count("*").alias("n"))
    got = ranks.with_medians(groups, df, ["a", "b"], {"mid": "v", "square": F.col("w") + 1}, most).collect()
    assert len(got) == len({r[:2] for r in rows}) and sum(r.n for r in got) == len(rows)
    for r in got:
        own = [x[2] for x in rows if x[:2] == (r.a, r.b) and x[2] is not None]
        assert (r.mid is None and not own) or (r.mid == pytest.approx(np.median(own)) and r.square == pytest.approx(np.median(np.square(own)) + 1))


def test_no_window_holds_a_hot_group(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("a"), (F.col("id") * 7919 % 20_011).cast("double").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spans = ranks._spans(ranks.value_counts(df, ["a"], {"v": "v"}))
        parts = [r.n for r in spans.groupBy(F.floor(F.col("s") / 5000)).agg(F.count("*").alias("n")).collect()]
        assert sorted(parts) == [5000] * 4
        stored = [p for p in spans.inputFiles() if "ranges" in p]
        assert len(set(stored)) >= 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranks.grouped_quantiles(df, "v", ["a"], [0.5], 100).first().quantiles == [np.median([k * 7919 % 20_011 for k in range(20_000)])]


def test_places_of_a_bucket_over_several_partitions(spark):
    rows = [(k, "hot" if k % 2 else None if k % 6 == 0 else f"b{k % 5}", k * 7 % 101) for k in range(900)]
    df = spark.createDataFrame(rows, "id int, bucket string, v int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.id: r.place for r in ranks.places(df, "bucket", [F.desc("v"), F.col("id")]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for name in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == name), key=lambda r: (-r[2], r[0]))
        assert [got[r[0]] for r in own] == list(range(len(own)))


@pytest.mark.parametrize("most", [1_000_000, 20])
def test_medians_of_a_stored_table_are_the_same(spark, most):
    rows = rows_of(3)
    df = spark.createDataFrame(rows, "a string, b int, v double, w double").repartition(5)
    groups = df.groupBy("a", "b").agg(F.count("*").alias("n"))
    columns = {"mid": "v", "square": F.col("w") + 1}
    own, other = (sorted(map(str, ranks.with_medians(groups, df, ["a", "b"], columns, most, stored=stored).collect())) for stored in (True, False))
    assert own == other and len(own) == len({r[:2] for r in rows})


def test_rows_of_a_stored_table_move_once(spark, monkeypatch):
    df = spark.range(3000).select((F.col("id") % 7).alias("a"), (F.col("id") * 31 % 1009).cast("double").alias("v"))
    monkeypatch.setattr(ranks, "value_counts", None)
    out = ranks.grouped_positions(df, ["a"], {"v": "v"}, lambda n: [F.lit(0.5) * (n - 1)], stored=True)
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # by group, and the picked values of each group
    assert plan.count("Exchange hashpartitioning") <= 2 and out.count() == 7
