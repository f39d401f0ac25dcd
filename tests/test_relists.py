"""Relists found inside tasks, without a table of pairs: against every pair in Python."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import deals, relists

SCHEMA = "olx_id string, brand string, model string, year int, generation string, duplicate_of string, is_active boolean, deactivation_reason string, first_seen_at timestamp, deactivated_at timestamp, price_eur double, mileage_km int, fuel_type string, transmission string, engine_cc int, horsepower int, district string"


def cars(seed, n):
    rng = np.random.default_rng(seed)
    some = lambda *x: x[int(rng.integers(0, len(x)))]
    rows = []
    for k in range(n):
        seen = None if k % 53 == 0 else dt.datetime(2023, 1, 1) + dt.timedelta(days=int(rng.integers(0, 200)), seconds=int(rng.integers(0, 3)))
        gone = (seen or dt.datetime(2023, 3, 1)) + dt.timedelta(days=int(rng.integers(-20, 40)))
        is_sold = k % 3 == 0
        # half of all rows in one segment
        brand = "hot" if k % 2 else some("b", "c", None)
        rows.append((f"k{k if k % 7 else k // 2}", brand, some("m", "m", "x"), 2010, some("g", "h", None), "dup" if k % 41 == 0 else None, not is_sold, "sold" if is_sold else None, seen, gone if is_sold else None, float(k), some(*range(1000, 30_000, 500), None), some("Diesel", "Gas", None), some("Manual", None), some(1000, 1050, 1101, None), some(90, 100, 111, None), some("x", " X", "y", None)))
    return rows


def walked(rows, least):
    """{original: (pairs, least gap, gated pairs, best)} by every pair."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    rows, out = [dict(zip(names, r, strict=True)) for r in rows], {}
    rows = [r for r in rows if r["duplicate_of"] is None and r["brand"]]
    agree = lambda o, c, k: o[k] is None or c[k] is None or o[k] == c[k]
    for o in rows:
        for c in rows if o["deactivated_at"] else []:
            if any(o[k] != c[k] for k in ("brand", "model", "year")) or o["olx_id"] == c["olx_id"] or not c["first_seen_at"]:
                continue
            gap = (c["first_seen_at"] - o["deactivated_at"]).total_seconds() / 86400
            if not 0 < gap <= 180:
                continue
            own = out.setdefault(o["olx_id"], [0, gap, 0, None])
            own[0], own[1] = own[0] + 1, min(own[1], gap)
            km = (o["mileage_km"], c["mileage_km"])
            if not agree(o, c, "fuel_type") or not agree(o, c, "transmission") or (None not in km and not -2000 <= km[1] - km[0] <= 100 * max(gap, 1) + 2000):
                continue
            own[2] += 1
            score = 50
            for k, far, plus, minus in (("engine_cc", 50, 10, -20), ("horsepower", 10, 5, -15)):
                if o[k] is not None and c[k] is not None:
                    score += plus if abs(o[k] - c[k]) <= far else minus
            score += 10 * (o["district"] is not None and c["district"] is not None and o["district"].strip().lower() == c["district"].strip().lower())
            score += 5 * (o["generation"] is not None and o["generation"] == c["generation"])
            if score / 100 >= least:
                found = (-score, gap, c["olx_id"])
                own[3] = found if own[3] is None else min(own[3], found)
    return out


@pytest.mark.parametrize("most", [relists.BLOCK, 60])
def test_relists_without_pairs_are_those_of_every_pair(spark, monkeypatch, most):
    rows = cars(7, 700)
    want = walked(rows, 0.45)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).cache()
    # no table of pairs is built
    monkeypatch.setattr(deals, "within_window", None)
    got = {r[0]: (r[1], r[2]) for r in deals.relist_counts(df, most=most).select("o_olx_id", "n", "gap").collect()}
    assert got == {k: (v[0], pytest.approx(v[1])) for k, v in want.items()} and len(got) > 100
    got = {r[0]: r[1] for r in deals.relist_counts(df, gated=True, most=most).select("o_olx_id", "n").collect()}
    assert got == {k: v[2] for k, v in want.items() if v[2]} and len(got) > 60
    quick = deals.relist_counts(df, gated=True, most=most, told_gap=False)
    assert {r[0]: r[1] for r in quick.select("o_olx_id", "n").collect()} == got and quick.where("gap is not null").isEmpty()
    best = {r[0]: (-round(100 * r[1]), pytest.approx(r[2]), r[3]) for r in deals.best_relists(df, None, 0.45, most=most).select("o_olx_id", "score", "gap_days", "c_olx_id").collect()}
    assert best == {k: v[3] for k, v in want.items() if v[3]} and len(best) > 60


def test_pairs_are_looked_at_in_slices(spark, monkeypatch):
    rows = cars(9, 300)
    want = {k: v[2] for k, v in walked(rows, 0.4).items() if v[2]}
    table = relists.blocks(spark.createDataFrame(rows, SCHEMA), None, "olx_id", ["fuel_type", "transmission", "mileage_km"])[0].toArrow()
    for pairs in (1, 40, 10**6):
        monkeypatch.setattr(relists, "PAIRS", pairs)
        for told_gap in (True, False):
            found = relists.count_in(table, "olx_id", deals._rules([], scored=False), told_gap).to_pandas().groupby("o_olx_id")["n"].sum()
            assert found.to_dict() == want


def test_few_pairs_are_looked_at(spark, monkeypatch):
    day, n = dt.datetime(2023, 1, 1), 1000
    row = lambda k, sold, seen, cc: (f"k{k}", "b", "m", 2010, "g", None, not sold, "sold" if sold else None, day + dt.timedelta(days=seen), day + dt.timedelta(days=seen + 3) if sold else None, 1.0, 1000 + k, "Diesel", "Manual", cc, 100, "x")
    rows = [row(k, k < n, k % 9 if k < n else 20 + k % 40, 1000 + 60 * (k % 50)) for k in range(2 * n)]
    table = relists.blocks(spark.createDataFrame(rows, SCHEMA).withColumn("_district", F.col("district")), None, "olx_id", ["fuel_type", "transmission", "mileage_km", "engine_cc", "horsepower", "_district", "generation"])[0].toArrow()
    looked = []
    pairs = relists._Rows.pairs

    def noted(self, *more):
        for who, at in pairs(self, *more):
            looked.append(len(who))
            yield who, at

    monkeypatch.setattr(relists._Rows, "pairs", noted)
    best = relists.best_in(table, "olx_id", deals._rules(["engine_cc", "horsepower", "district", "generation"], 0.6), ["olx_id"])
    assert best.num_rows == n and 0 < sum(looked) < n * n // 10
    looked.clear()
    counts = [sum(relists.count_in(table, "olx_id", deals._rules([], scored=False), told)["n"].to_pylist()) for told in (False, True)]
    assert counts[0] == counts[1] == sum(looked) > n * n


def test_only_what_is_kept_is_told(spark):
    df = spark.createDataFrame(cars(3, 90), SCHEMA)
    assert deals.best_relists(df, None, 0.4, keep=[]).columns == ["o_olx_id", "c_olx_id", "gap_days", "score"]
    both = deals.best_relists(df, None, 0.4), deals.best_relists(df, None, 0.4, keep=["price_eur"])
    rows = [sorted(map(tuple, x.select("o_olx_id", "c_olx_id", "score", F.round("gap_days", 9), "o_price_eur", "c_price_eur").collect())) for x in both]
    assert rows[0] == rows[1] and rows[0]


def test_no_rows_no_relists(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert deals.relist_counts(df, gated=True).collect() == [] and deals.best_relists(df, None).collect() == []
