"""Truth tables of operators that SQL does not check."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from marketloom.functions import scalars, text
from marketloom.operators import calibration, enrich, evaluation, maintain, models, ranks
from marketloom.sources import tables
from marketloom.streaming import jobs


def column(spark, values, make, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    return [r[0] for r in spark.createDataFrame(rows, f"i int, c {kind}").orderBy("i").select(make(F.col("c"))).collect()]


def test_prices(spark):
    assert column(spark, ["12.500 €", "1.234,50 EUR", "900", "grátis", None, "1.5"], text.price_eur) == [12500.0, 1234.5, 900.0, None, None, 1.5]


def test_dates(spark):
    got = column(spark, ["12 de Março de 2024 às 10:30", "1 de maio de 2020", "31 de fevereiro de 2020", "hoje", None], text.portuguese_date)
    assert got == [dt.datetime(2024, 3, 12, 10, 30), dt.datetime(2020, 5, 1), None, None, None]
    assert column(spark, ["desde março de 2019", "x"], text.member_since) == [dt.date(2019, 3, 1), None]


def test_plates(spark):
    assert column(spark, ["AA-12-BB e 12-34-CD", "ABC-12-D", "AA-BB-CC", "99aa11", None], text.plates) == [["AA-12-BB", "12-34-CD"], [], [], ["99-AA-11"], None]


def test_signals(spark):
    assert column(spark, ["URGÊNCIA!", "preço negociável", "bom", None], text.urgency) == ["high", "medium", "low", "low"]
    assert column(spark, ["Sem garantia", "com garantia", "nada"], text.warranty) == [False, True, None]
    assert column(spark, ["Não pega", "motor fundido", "como novo", "usado"], lambda c: text.damage_severity(c, F.lit(None).cast("string"), F.lit(None).cast("boolean"), F.lit(None).cast("boolean"), F.lit(None).cast("boolean"))) == [3, 2, 0, 1]
    assert column(spark, ["VW", " Škoda ", "Lada", None], text.canonical_brand) == ["Volkswagen", "Skoda", "Lada", ""]


def test_upsert_keeps_old_values_and_ignores_the_future(spark):
    at = "TIMESTAMP '2024-01-01'"
    old = spark.sql(f"SELECT 'a' AS id, 1.0D AS p, {at} AS first_seen_at, {at} AS last_seen_at, false AS is_active, {at} AS deactivated_at UNION ALL SELECT 'z', 9.0D, {at}, {at}, false, {at}")
    new = spark.sql("SELECT 'a' AS id, CAST(NULL AS DOUBLE) AS p, TIMESTAMP '2030-01-01' AS posted_at UNION ALL SELECT 'b', 2.0D, TIMESTAMP '2024-01-05'")
    rows = {r.id: r for r in maintain.upsert(old, new, "id", ["p"], "2024-02-01 00:00:00").collect()}
    assert rows["a"].p == 1.0 and rows["a"].is_active and rows["a"].deactivated_at is None and rows["a"].last_seen_at == dt.datetime(2024, 2, 1)
    assert rows["b"].first_seen_at == dt.datetime(2024, 1, 5) and not rows["z"].is_active


def test_nothing_seen_marks_nothing(spark):
    df = spark.sql("SELECT 'a' AS olx_id, true AS is_active, 'olx' AS source, CAST(NULL AS TIMESTAMP) AS deactivated_at, CAST(NULL AS STRING) AS deactivation_reason")
    assert maintain.mark_inactive(df, df.where("false"), "olx", "2024-01-01 00:00:00").first().is_active
    other = df.withColumn("olx_id", F.lit("b"))
    assert not maintain.mark_inactive(df, other, "olx", "2024-01-01 00:00:00").first().is_active


def test_greedy_matches_take_the_first_free(spark):
    pairs = spark.createDataFrame([(1, "a1", "b1"), (1, "a2", "b1"), (1, "a1", "b2"), (1, "a1", "b3"), (1, "a3", "b3")], "block long, a_id string, b_id string")
    assert {tuple(r) for r in maintain.match_in_blocks(pairs).collect()} == {("a1", "b1"), ("a3", "b3")}


def test_greedy_matches_hold_one_batch_of_a_block(spark):
    rng = np.random.default_rng(3)
    pairs = sorted({(int(rng.integers(3)), f"b{rng.integers(40):02}", f"a{rng.integers(30):02}") for _ in range(900)})
    want, taken, done = set(), set(), set()
    for block, b, a in pairs:
        if (block, b) not in done and (block, a) not in taken:
            done.add((block, b))
            taken.add((block, a))
            want.add((block, a, b))
    given = []

    def batches():
        for k in range(0, len(pairs), 7):
            given.append(k)
            yield pd.DataFrame(pairs[k : k + 7], columns=["block", "b_id", "a_id"])

    out = maintain.first_free(batches())
    first = next(out)
    assert given == [0] and len(first)
    assert sorted([*map(tuple, first.values), *(tuple(r) for x in out for r in x.values)]) == sorted((a, b) for _, a, b in want)
    shuffled = [pairs[k] for k in rng.permutation(len(pairs))]
    got = maintain.match_in_blocks(spark.createDataFrame(shuffled, "block long, b_id string, a_id string")).collect()
    assert sorted(map(tuple, got)) == sorted((a, b) for _, a, b in want)


def test_seller_rules(spark):
    rows = spark.createDataFrame(
        [(None, None, 9, 9, 9), (False, False, None, None, None), (False, False, 3, 1, 0), (True, True, 1, 1, 1), (True, False, 20, 1, 0), (True, False, 2, None, None)],
        "seller_is_business boolean, seller_pseudoprivate boolean, seller_cars_count int, seller_distinct_car_brands int, seller_listings_count_90d int",
    )
    assert [r[0] for r in rows.select(enrich.seller_segment()).collect()] == ["unknown", "genuine_private", "pseudo_private", "pseudo_private", "volume_dealer", "specialist_dealer"]


def test_confusion_of_nulls_and_sweep(spark):
    df = spark.createDataFrame([(True, 0.9), (False, 0.8), (True, 0.1), (None, 0.5), (True, None)], "t boolean, s double")
    rows = {r.threshold: r for r in evaluation.threshold_sweep(df, "t", "s", [0.5, 0.05]).collect()}
    assert (rows[0.5].tp, rows[0.5].fp, rows[0.5].fn) == (1, 1, 1) and rows[0.05].recall == 1.0


def priced(spark, n=400):
    rng = np.random.default_rng(42)
    rows = []
    for i in range(n):
        year, km = int(rng.integers(2000, 2020)), int(rng.integers(10_000, 200_000))
        rows.append((f"i{i}", float(max(500, (year - 2000) * 600 - km * 0.02 + rng.normal(0, 300) + 4000)), year, km, "AB"[i % 2]))
    return spark.createDataFrame(rows, "id string, price double, year int, km int, brand string")


def test_price_bands_are_ordered_and_cover(spark):
    df = models.prepared(priced(spark), ["year", "km"], ["brand"])
    bands = df.join(models.quantile_forest(df, df, "id", "price", ["year", "km"], ["brand"], trees=5), "id")
    r = bands.select(F.min(F.col("high") - F.col("low")).alias("gap"), F.avg(F.col("price").between(F.col("low"), F.col("high")).cast("int")).alias("cover")).first()
    assert r.gap >= 0 and r.cover > 0.6


def test_extreme_outlier_is_flagged(spark):
    df = priced(spark).unionByName(spark.createDataFrame([("out", 9e6, 1950, 9_000_000, "A")], "id string, price double, year int, km int, brand string"))
    columns = ["price", "year", "km"]
    scores = models.anomaly_scores(df, models.isolation_forest(df, columns, trees=30), "id", columns)
    assert scores.orderBy(F.desc("anomaly")).first().id == "out" and scores.count() == 401


def test_common_values_are_not_isolated(spark):
    # half of the rows are equal: trees draw them one by one, and no tree is given many more rows than it uses
    same = spark.range(3000).select(F.concat(F.lit("s"), F.col("id")).alias("id"), F.lit(7000.0).alias("price"), F.lit(2012).alias("year"), F.lit(90_000).alias("km"), F.lit("A").alias("brand"))
    df = priced(spark, 3000).unionByName(same)
    columns = ["price", "year", "km"]
    forest = models.isolation_forest(df, columns, trees=20).localCheckpoint()
    assert [r["size"] for r in forest.where("node = 1").collect()] == [256] * 20
    leaves = {r.tree: r.most for r in forest.where("feature = -1").groupBy("tree").agg(F.max("size").alias("most")).collect()}
    assert len(leaves) == 20 and all(80 <= n <= 180 for n in leaves.values())
    scores = models.anomaly_scores(df, forest, "id", columns)
    means = {r["same"]: r["mean"] for r in scores.groupBy(F.col("id").startswith("s").alias("same")).agg(F.avg("anomaly").alias("mean")).collect()}
    assert means[True] < means[False]


def test_missing_table_is_empty_and_json_is_lenient(spark, tmp_path):
    assert tables.read_table(spark, str(tmp_path / "none"), "a int").count() == 0
    (tmp_path / "x.json").write_text('{"k": 1}\n\nbroken\n{"k": 1}\n{"k": 2}\n')
    assert sorted(r.k for r in tables.read_json_lines(spark, str(tmp_path / "x.json"), "k int", "k").collect()) == [1, 2]
    zones = spark.createDataFrame([("n", 1.5), ("s", float("nan"))], "zone string, v double")
    tables.write_zone_feed(zones, str(tmp_path / "feed"))
    assert {(r.zone, r.v) for r in spark.read.schema("zone string, v double").json(str(tmp_path / "feed")).collect()} == {("n", 1.5), ("s", None)}
    tables.write_witness(zones, str(tmp_path / "w"), ["zone"])
    assert spark.read.parquet(str(tmp_path / "w")).count() == 2 and (tmp_path / "w" / "zone=n").is_dir()
    seen = [(k, dt.datetime(2024, 1, k)) for k in range(1, 21)]
    spark.createDataFrame(seen, "k int, scraped_at timestamp").write.parquet(str(tmp_path / "snaps"))
    read = lambda days: tables.read_snapshots(spark, str(tmp_path / "snaps"), "k int, scraped_at timestamp", "2024-01-20 00:00:00", days).count()
    assert [read(d) for d in (14, None, 0, -1)] == [15, 20, 20, 20]
    (tmp_path / "g.json").write_text('{"VW": {"Golf": [{"name": "Mk4", "year_from": 1997, "year_to": 2003}]}}')
    assert tuple(tables.read_generations(spark, str(tmp_path / "g.json")).first()) == ("VW", "Golf", "Mk4", 1997, 2003)


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(k, k % 3, float(100 - (k % 7)), dt.datetime(2024, 1, 1) + dt.timedelta(hours=9 * k)) for k in range(60)]
    spark.createDataFrame(rows, "event_id long, listing_id long, price_eur double, scraped_at timestamp").repartition(1).write.parquet(source)
    stream = spark.readStream.schema("event_id long, listing_id long, price_eur double, scraped_at timestamp").parquet(source)

    def finish(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    weeks = finish(jobs.weekly_medians(jobs.not_from_future(stream, "scraped_at"), ["listing_id"], "price_eur", "scraped_at"), "weeks", "complete")
    assert all(r.week.weekday() == 0 for r in weeks.collect())
    assert finish(jobs.first_alerts(stream, "listing_id", "scraped_at"), "alerts", "append").count() == 3
    merged = []
    jobs.upsert_stream(stream, lambda df, _: merged.append(df.count()), "listing_id", ["scraped_at"], str(tmp_path / "up")).awaitTermination()
    assert merged == [3]
    assert jobs.not_from_future(spark.read.parquet(source), "scraped_at", as_of="2024-01-05 00:00:00").count() == 14


def test_prices_as_written(spark):
    got = column(spark, ["€ 12.500", "12 500 €", "1.234.567", "12.50", "1.500,00", "€", "", "Preço 5", "7,5 euros e 3"], text.price_eur)
    assert got == [12500.0, 12500.0, 1234567.0, 12.5, 1500.0, None, None, None, 7.5]


def test_mileage_without_thousands(spark):
    rows = [(150, 2015), (0, 2015), (None, 2015), (999, None), (1000, None), (30, 2024), (900, 2024), (999, 2023), (45, 2023), (25000, 2010)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, km int, year int").orderBy("i")
    got = [r.km for r in df.select(text.fixed_mileage(F.col("km"), F.col("year"), 2024).alias("km")).collect()]
    assert got == [150000, 0, None, 999000, 1000, 30000, 900, 999, 45000, 25000]


def test_modifications(spark):
    said = ["Reprogramação stage 1, Stage 1 feito", "stage 2 + downpipe, escape desportivo original", "BodyKit e body kit; escape desportivo", "150 kW elétrico", "suspensão KW", "bateria 50 kWh", "molas H&R e Bilstein", None]
    assert column(spark, said, text.tuning) == [
        ["reprogramacao stage 1"],
        ["stage 2 + downpipe", "downpipe"],
        ["escape desportivo", "bodykit"],
        [],
        ["suspensão KW"],
        [],
        ["suspensão H&R", "suspensão BILSTEIN"],
        [],
    ]


def test_maintenance(spark):
    said = ["Correia de distribuição feita aos 120.000 km, revisão completa", "embraiagem nova", "embreagem trocada e travões: trocadas as pastilhas", "Peças trocadas:\n- várias", "nada", None]
    assert column(spark, said, text.maintenance) == [
        ["correia distribuição (120000km)", "revisão (120000km)"],
        ["embreagem nova"],
        ["embreagem nova", "travões"],
        ["múltiplas peças trocadas (ver descrição)"],
        [],
        [],
    ]


def test_tyres_and_owners(spark):
    said = ["4 pneus novos", "pneus recentes", "90% de piso", "60 % piso", "pneus em estado razoável", "pneus gastos", "precisa de pneus", "pneus", None]
    assert column(spark, said, text.tyres) == ["new", "good", "good", "fair", "fair", "poor", "poor", None, None]
    said = ["único dono", "1 dono", "um registo", "única dona", "sempre o mesmo dono", "comprado novo por mim", "21 donos", "dono"]
    assert column(spark, said, text.first_owner) == [True] * 6 + [None, None]


def test_sub_segments(spark):
    rows = [("Diesel", 1600), ("Gasolina", 1399), ("Eléctrico", 0), ("Híbrido Plug-In", 2000), ("GPL", 2001), (None, 1000), ("", None), ("Outro", None), ("Electric", 3000)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, f string, cc int").orderBy("i")
    got = [r.s for r in df.select(scalars.sub_segment(F.col("f"), F.col("cc")).alias("s")).collect()]
    assert got == ["diesel_mid", "petrol_small", "electric", "hybrid_mid", "gpl_large", "unk_small", "unk", "petrol", "electric"]


def test_sold_tiers_and_weights(spark):
    rows = [(False, "sold", d) for d in (0, 14, 15, 60, 180, 365, 366, -1, None)] + [(True, None, 5), (False, "expired", 5)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a boolean, r string, d int").orderBy("i")
    times, weight = scalars.sold_tier(F.col("a"), F.col("r"), F.col("d"))
    got = [tuple(r) for r in df.select(times, weight).collect()]
    assert got == [(0.96, 0.9), (0.96, 0.9), (0.94, 0.7), (0.94, 0.7), (0.91, 0.5), (0.88, 0.3), (1.0, 0.0), (1.0, 0.0), (1.0, 0.0), (1.0, 1.0), (1.0, 1.0)]
    w = np.array([r[0] for r in spark.createDataFrame([(3000.0,), (30000.0,), (0.0,)], "p double").select(scalars.loss_weight(F.col("p"))).collect()])
    assert np.allclose(w, 1 / np.log1p(np.array([3000.0, 30000.0, 0.0]) + 1))


def test_photo_rules(spark):
    rows = [(True, 0), (False, 2), (True, 1), (None, 1), (True, None), (True, -1)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, v boolean, s int").orderBy("i")
    assert [r[0] for r in df.select(scalars.damage_label(F.col("v"), F.col("s"))).collect()] == [False, False, True, None, None, None]
    rows = [(2, 0.9, 0), (2, 0.2, 3), (3, 0.19, 3)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s int, p double, n int").orderBy("i")
    got = [(r.d.decision, r.d.severity) for r in df.select(scalars.photo_decision(F.col("s"), F.col("p"), F.col("n")).alias("d")).collect()]
    assert got == [("no_photos", 2), ("photo_confirms", 2), ("downgrade", 0)]


def test_segment_score(spark):
    rows = [(None, None, None, None), (30.0, 50, 14.0, 10.0), (60.0, 0, 28.0, -20.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, u double, n int, d double, t double").orderBy("i")
    got = [r[0] for r in df.select(scalars.segment_score(F.col("u"), F.col("n"), F.col("d"), F.col("t"))).collect()]
    assert np.allclose(got, [0.2 * 14 / 60 + 0.075, 1.0, 0.4 + 0.1])


def test_ranks_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=3000), np.full(3000, 0.25), rng.exponential(size=500) * 1e6])
    df = spark.createDataFrame(pd.DataFrame({"v": values, "g": np.where(np.arange(len(values)) % 3 > 0, "a", "b")})).unionByName(spark.createDataFrame([(None, "a"), (float("nan"), "b")], "v double, g string"))
    monkeypatch.setattr(ranks, "HELD", 50)
    monkeypatch.setattr(ranks, "_ACCURACY", 100)
    levels = [0.0, 0.1, 0.333, 0.5, 0.9, 0.999, 1.0]
    assert np.allclose(ranks.quantiles(df, "v", levels), np.quantile(values, levels))
    own = np.sort(values[np.arange(len(values)) % 3 > 0])
    got = ranks.values_at(df, "v", {"a": [0, 7, len(own) - 1, len(own)], "c": [0]}, "g")
    assert got == {"a": {0: own[0], 7: own[7], len(own) - 1: own[-1]}, "c": {}}
    assert ranks.quantiles(df.where("false"), "v", [0.5]) == [None]


def test_time_split_and_widths(spark):
    rows = [(f"k{i}", dt.datetime(2024, 1, 1 + i // 40), float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t timestamp, v double").unionByName(spark.createDataFrame([("x", None, 1.0)], "k string, t timestamp, v double"))
    parts = {r.k: r.part for r in calibration.time_split(df, "t", "k", 0.23).collect()}
    assert len(parts) == 400 and sum(p == "fit" for p in parts.values()) == 308
    assert all(parts[f"k{i}"] == "fit" for i in range(280)) and all(parts[f"k{i}"] == "calibrate" for i in range(320, 400))
    assert calibration.time_split(df.limit(100), "t", "k") is None
    assert calibration.price_edges(df.limit(50), "v") == calibration.PRICE_EDGES
    edges = [0.0, 10.0, 20.0]
    got = [tuple(r) for r in df.where("v in (0, 10, 25)").orderBy("v").select(calibration.bucket_at(F.col("v"), edges), calibration.width_of(F.col("v"), edges, {1: 0.5}, 0.1)).collect()]
    assert got == [(0, 0.1), (1, 0.5), (2, 0.1)]


def test_calibrated_chain_covers(spark):
    rng = np.random.default_rng(1)
    n = 1500
    year, km, brand = rng.integers(2000, 2024, n), rng.integers(1, 250, n) * 1000.0, rng.choice(list("abcde"), n)
    price = np.exp(7 + (year - 2000) * 0.1 - km / 4e5 + (brand == "a") * 0.4 + rng.normal(0, 0.15, n))
    pdf = pd.DataFrame({"olx_id": [f"i{k}" for k in range(n)], "year": year.astype(float), "mileage_km": km, "brand": brand, "price_eur": price, "first_seen_at": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), unit="h"), "doc": rng.random(n)})
    rows = models.prepared(spark.createDataFrame(pdf), ["year", "mileage_km"], ["brand"])
    chain = calibration.fit_chain(rows.where("first_seen_at < '2024-02-20'"), "olx_id", "price_eur", "first_seen_at", ["year", "mileage_km"], ["brand"], ["doc"], trees=10)
    out = calibration.predict(chain, rows, "olx_id").toPandas().merge(pdf, on="olx_id")
    assert len(out) == n and (out.fair_price_low <= out.predicted_price).all() and (out.predicted_price <= out.fair_price_high).all()
    newest = out[out.first_seen_at >= "2024-02-20"]
    inside = ((newest.price_eur >= newest.fair_price_low) & (newest.price_eur <= newest.fair_price_high)).mean()
    assert inside > 0.72 and (abs(newest.predicted_price - newest.price_eur) / newest.price_eur).median() < 0.25
    iso = chain.iso.transform(spark.range(1, 400).selectExpr("cast(id * 100 as double) as raw")).orderBy("raw").toPandas().calibrated
    assert (np.diff(iso) >= -1e-9).all() and chain.overall > -1 and len(chain.by_bucket) <= len(chain.edges)


def test_top_ancestors(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 3), (5, 4), (6, 99), (7, None)]
    got = {tuple(r) for r in evaluation.top_ancestors(spark.createDataFrame(rows, "id long, parent long")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (7, 7)}


def test_halves_round_as_in_sql(spark):
    import duckdb

    # shares that are a half of the last place on paper: the double next to it counts as the half
    pairs = [(200.0 * (k % 97 + 50), 200.0 * (k % 97 + 50) * (k % 1801 + 20) / 2000) for k in range(20_000)]
    df = spark.createDataFrame(pairs, "p double, a double")
    share = (F.col("p") - F.col("a") - 0.12 * F.col("p")) / F.col("p") * 100
    got = df.select("p", "a", scalars.rounded(share, 1).alias("r"), F.round(share, 1).alias("plain")).toPandas()
    want = duckdb.sql("SELECT round((p - a - 0.12::DOUBLE * p) / p * 100, 1) AS r FROM got").fetchnumpy()["r"]
    assert (got["r"].to_numpy() == want).all() and (got["plain"].to_numpy() != want).any()


def test_relist_pairs_against_brute_force(spark):
    from marketloom.operators import deals

    rng = np.random.default_rng(2)
    rows = []
    for k in range(300):
        seen = dt.datetime(2023, 1, 1) + dt.timedelta(days=float(rng.integers(0, 700)) / 2)
        gone = seen + dt.timedelta(days=float(rng.integers(1, 200)))
        rows.append((f"k{k}", "b", "m", 2010, None, k % 3 > 0, None if k % 3 > 0 else "sold", seen, None if k % 3 > 0 else gone))
    df = spark.createDataFrame(rows, "olx_id string, brand string, model string, year int, duplicate_of string, is_active boolean, deactivation_reason string, first_seen_at timestamp, deactivated_at timestamp")
    got = sorted((r.o_olx_id, r.c_olx_id) for r in deals.relist_pairs(df).collect())
    want = sorted((a[0], b[0]) for a in rows if a[8] for b in rows if a[0] != b[0] and 0 < (b[7] - a[8]).total_seconds() / 86400 <= 180)
    assert got == want and got


def test_relists_of_kinds_are_those_of_all_pairs(spark):
    """Copies, nulls, keys that repeat and rows first seen after their own sale: the same as from every pair."""
    from marketloom.operators import deals

    rng = np.random.default_rng(5)
    some = lambda *x: x[int(rng.integers(0, len(x)))]
    rows = []
    for k in range(400):
        seen = dt.datetime(2023, 1, 1) + dt.timedelta(days=int(rng.integers(0, 20)) * 10)
        gone = seen + dt.timedelta(days=int(rng.integers(-2, 5)) * 10)
        is_sold = k % 3 == 0
        rows.append((f"k{k if k % 7 else k // 2}", some("b", "c"), "m", 2010, "dup" if k % 41 == 0 else None, not is_sold, "sold" if is_sold else None, seen, gone if is_sold else None, some(1000.0, 2000.0, None), some(10_000, 12_000, 40_000, None), some("Diesel", None), some(1000, 1040, 2000, None), some("x", " X", None)))
    df = spark.createDataFrame(rows, "olx_id string, brand string, model string, year int, duplicate_of string, is_active boolean, deactivation_reason string, first_seen_at timestamp, deactivated_at timestamp, price_eur double, mileage_km int, fuel_type string, engine_cc int, district string").withColumn("transmission", F.lit(None).cast("string")).cache()
    for gated in (False, True):
        pairs = deals.relist_pairs(df)
        pairs = deals.gates(pairs) if gated else pairs
        want = {r[0]: (r[1], r[2]) for r in pairs.groupBy("o_olx_id").agg(F.count("*"), F.min("gap_days")).collect()}
        assert {r[0]: (r[1], r[2]) for r in deals.relist_counts(df, gated=gated).select("o_olx_id", "n", "gap").collect()} == want and want
    what = ["o_olx_id", "c_olx_id", "score", "gap_days", "reasons"]
    want = sorted(map(tuple, deals.best_candidates(deals.match_score(deals.gates(deals.relist_pairs(df))), 0.5).select("o_olx_id", "score", "gap_days", "c_olx_id").collect()))
    got = deals.best_relists(df, None, 0.5)
    assert set(what) <= set(got.columns) and sorted(map(tuple, got.select("o_olx_id", "score", "gap_days", "c_olx_id").collect())) == want and want


def test_scored_pairs_of_kinds_are_those_of_all_pairs(spark, tmp_path):
    """Copies, nulls, keys that repeat, segments that are dealt and lists that are cut: every pair once, and few bytes for a pair."""
    from marketloom.operators import deals

    rng = np.random.default_rng(6)
    some = lambda *x: x[int(rng.integers(0, len(x)))]
    schema = "olx_id string, brand string, model string, year int, duplicate_of string, is_active boolean, deactivation_reason string, first_seen_at timestamp, deactivated_at timestamp, mileage_km int, fuel_type string, engine_cc int, district string, color string"
    rows = []
    for k in range(500):
        seen = dt.datetime(2023, 1, 1) + dt.timedelta(days=int(rng.integers(0, 20)) * 10)
        gone = seen + dt.timedelta(days=int(rng.integers(-2, 5)) * 10)
        is_sold = k % 3 == 0
        rows.append((f"k{k if k % 7 else k // 2}", some("b", "c", None), "m", 2010, "dup" if k % 41 == 0 else None, not is_sold, "sold" if is_sold else None, seen, gone if is_sold else None, some(10_000, 12_000, 40_000, None), some("Diesel", None), some(1000, 1040, 2000, None), some("x", " X", None), some("Preto", " preto", "Azul", None)))
    df = spark.createDataFrame(rows, schema).withColumn("transmission", F.lit(None).cast("string")).cache()
    what = ["o_olx_id", "c_olx_id", "score"]
    want = sorted(map(tuple, deals.match_score(deals.gates(deals.relist_pairs(df))).select(*what).collect()))
    assert want and len({w[2] for w in want}) > 3
    for more in ({}, {"slot_days": 7}, {"pairs_a_task": 300, "keys_a_task": 50}):
        got = deals.scored_pairs(df, **more)
        assert got.columns == what and sorted(map(tuple, got.collect())) == want

    # 300 sold rows of a kind and 1500 later ones of another, whose lists are cut: pairs of rows take 259,448 bytes, these 85,289
    day = dt.datetime(2023, 1, 1)
    copies = [(f"original-{k:06d}", "b", "m", 2010, None, False, "sold", day, day + dt.timedelta(days=9), 10_000, None, 1000, "x", None) for k in range(300)]
    copies += [(f"candidate-{k:06d}", "b", "m", 2010, None, True, None, day + dt.timedelta(days=20), None, 10_000, None, 1000, "x", None) for k in range(1500)]
    pairs = deals.scored_pairs(spark.createDataFrame(copies, schema).withColumn("transmission", F.lit(None).cast("string")))
    pairs.write.parquet(str(tmp_path / "pairs"))
    written = spark.read.parquet(str(tmp_path / "pairs"))
    assert written.count() == written.distinct().count() == 300 * 1500
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 130_000


def test_comparables_count_equal_rows_before_the_grains(spark):
    from marketloom.operators import market

    rows = [(f"b{k % 2}", "m", None if k % 5 == 0 else f"g{k % 3}", None if k % 4 == 0 else "Diesel", float(k % 7), 2000 + k % 3, k % 11) for k in range(300)]
    df = spark.createDataFrame(rows, "brand string, model string, generation string, fuel_type string, price_eur double, year int, mileage_km int")
    grains = {"sub": ("brand", "model", "generation", "fuel_type"), "model": ("brand", "model")}
    full = market.comparables(df, grains)
    got = {(r.grain, r.brand, r.generation, r.fuel_type): (r.n, r.median_price) for r in market.comparables(df, grains, only_price=True).collect()}
    assert got == {(r.grain, r.brand, r.generation, r.fuel_type): (r.n, r.median_price) for r in full.collect()}
    for r in full.where("grain = 'model'").collect():
        own = [x for x in rows if x[0] == r.brand and x[4] > 0]
        assert (r.n, r.median_price, r.median_year, r.median_mileage) == (len(own), *(float(np.median([x[i] for x in own])) for i in (4, 5, 6)))
