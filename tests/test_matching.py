"""First-come matching, merges of duplicates and relist candidates against walks in Python."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import enrich, maintain


def walked(pairs):
    """(a, b) by one walk: b in order takes its least a that is left; a match uses a up where it takes."""
    used, done, out = set(), set(), []
    for b, a, takes in sorted({(b, a, t) for _, b, a, t in pairs}):
        if b not in done and a not in used:
            done.add(b)
            out.append((a, b))
            if takes:
                used.add(a)
    return sorted(out)


def random_pairs(seed, n, n_b, n_a, cells, share):
    rng = np.random.default_rng(seed)
    cell = {b: int(rng.integers(cells)) for b in range(n_b)}
    found = {}
    for _ in range(n):
        b, a = int(rng.integers(n_b)), int(rng.integers(n_a))
        found[b, a] = (cell[b], f"b{b:05}", f"a{a:05}", bool(rng.random() < share))
    return list(found.values())


@pytest.mark.parametrize(
    ("n", "n_b", "n_a", "cells", "share", "slice_pairs"), [(400, 60, 40, 5, 1.0, 1000), (400, 60, 40, 5, 0.5, 30), (900, 50, 45, 1, 0.8, 60), (300, 100, 200, 12, 1.0, 10), (700, 90, 30, 3, 0.0, 50)]
)
def test_rounds_give_what_one_walk_gives(spark, n, n_b, n_a, cells, share, slice_pairs):
    pairs = random_pairs(n, n, n_b, n_a, cells, share)
    df = spark.createDataFrame(pairs, "cell long, b_id string, a_id string, takes boolean").repartition(3)
    got = maintain.first_come_matches(df, F.col("takes"), slice_pairs=slice_pairs).collect()
    assert sorted(map(tuple, got)) == walked(pairs)


def test_a_block_of_half_of_all_rows(spark):
    # every b of the hot cell wants the same a's; it is cut into slices that have to agree
    hot = [(0, f"b{b:04}", f"a{a:04}", True) for b in range(60) for a in range(50)]
    rest = random_pairs(7, 1500, 400, 400, 40, 1.0)
    rest = [(c + 1, b.replace("b", "c"), a.replace("a", "d"), t) for c, b, a, t in rest]
    df = spark.createDataFrame(hot + rest, "cell long, b_id string, a_id string, takes boolean")
    got = sorted(map(tuple, maintain.first_come_matches(df, slice_pairs=1000).collect()))
    assert got == walked(hot + rest) and sum(b.startswith("b") for _, b in got) == 50


def test_no_pairs_no_matches(spark):
    df = spark.createDataFrame([], "cell long, b_id string, a_id string")
    assert maintain.first_come_matches(df).collect() == []


def test_empty_text_is_filled_and_never_fills(spark):
    df = spark.createDataFrame([(1, "", None, 0), (2, "", "x", 5), (3, "red", None, 7), (9, None, "", None), (10, "", "", 1)], "olx_id long, colour string, fuel string, doors int")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (9, 10)], "canonical long, duplicate long")
    rows = {r.olx_id: r for r in maintain.merge_into_canonical(df, pairs, ["colour", "fuel", "doors"]).collect()}
    assert (rows[1].colour, rows[1].fuel, rows[1].doors) == ("red", "x", 0)
    assert (rows[9].colour, rows[9].fuel, rows[9].doors) == (None, "", 1) and rows[2].colour == ""


def test_models_of_titles_as_by_patterns(spark):
    lexicon = {"Renault": ["Mégane", "Mégane Sport Tourer", "4", "5 E-Tech", "up!", "R 5 a b c d e"], "BMW": ["320", "320d", "i3", "M3 (E46)", "X1"]}
    titles = ["Renault mégane SPORT tourer 1.5", "MÉGANE-sport", "Renault 4L 4x4", "renault R 5 a b c d e!", "5 e-tech 5  E-Tech", "BMW 2.0 3000 320", "bmw 320d 320", "M3 (E46) x1", "M3 (E46)x", "up!x up! ", "", "  ", None, "i3/X1;320"]
    rows = [(f"{brand}{k}", brand, t) for brand in (*lexicon, "Lada", None) for k, t in enumerate(titles)]
    df = spark.createDataFrame([(k if b else f"none{k}", b, t) for k, b, t in rows], "olx_id string, brand string, title string")
    lex = spark.createDataFrame([(b, m) for b, ms in lexicon.items() for m in ms], "brand string, model string")
    got = {r.olx_id: r.model_found for r in enrich.model_from_title(df, lex, words=3).collect()}

    def want(brand, title):
        found = [m for m in lexicon.get(brand, []) if title and re.search(rf"\b{re.escape(m)}\b", title, re.IGNORECASE)]
        return max(found, key=lambda m: (len(m), m), default=None)

    assert got == {(k if b else f"none{k}"): want(b, t) for k, b, t in rows} and len({v for v in got.values()}) > 6


def listed(seed, n):
    rng = np.random.default_rng(seed)
    some = lambda *x: None if rng.random() < 0.1 else x[int(rng.integers(len(x)))]
    rows = []
    for k in range(n):
        seen = None if rng.random() < 0.1 else f"2001-01-{int(rng.integers(1, 20)):02} 00:00:00"
        # the first block has half of all rows
        block = ("Vw", "Golf", 2001, "Porto") if rng.random() < 0.5 else (some("vw", "Fiat"), some("golf", "Uno"), int(rng.integers(2000, 2002)), some("porto", "Faro"))
        rows.append((f"k{int(rng.integers(10**6)):07}-{k}", *block, some(*range(1000, 50000, 900)), some(0.0, *map(float, range(500, 9000, 37))), seen, some("olx", "sv", "sv", "other"), bool(rng.random() < 0.95), "d" if rng.random() < 0.05 else None))
    return rows


LISTED = "olx_id string, brand string, model string, year int, district string, mileage_km int, price_eur double, seen string, source string, is_active boolean, duplicate_of string"


@pytest.mark.parametrize("once", [False, True])
@pytest.mark.parametrize("most", [100_000, 60, 0])
def test_matches_by_block_are_those_of_its_pairs(spark, once, most):
    df = spark.createDataFrame(listed(3, 700), LISTED).withColumn("last_seen_at", F.col("seen").cast("timestamp")).repartition(3)
    pairs = maintain.cross_source_pairs(df)
    want = walked([(0, r.b_id, r.a_id, once or r.canonical == r.b_id) for r in pairs.collect()])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = maintain.block_matches(df, once=once, most=most).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == want and len(want) > 40


def test_blocks_are_matched_without_their_pairs(spark, monkeypatch):
    rows = [(f"{s}{k:03}", "vw", "golf", 2001, "porto", 1000, 500.0, "2001-01-01 00:00:00", s, True, None) for s in ("olx", "sv") for k in range(300)]
    df = spark.createDataFrame(rows, LISTED).withColumn("last_seen_at", F.col("seen").cast("timestamp"))
    monkeypatch.setattr(maintain, "cross_source_pairs", None)
    assert sorted(map(tuple, maintain.block_matches(df, once=True).collect())) == [(f"olx{k:03}", f"sv{k:03}") for k in range(300)]
    assert {r.a_id for r in maintain.block_matches(df).collect()} == {"olx000"}
