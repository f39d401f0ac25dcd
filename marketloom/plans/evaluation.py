"""Queries of evaluation, bands, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation as v
from ..operators import market as m
from ..operators.storage import checkpointed
from .market import SIGNALS_SQL, signals_of
from .registry import AS_OF, Tables, query

D4 = "CAST({0} AS DECIMAL(28, 4))"
SCORED_SQL = f"""{SIGNALS_SQL}, scored AS (SELECT l.*, predicted_price, round(predicted_price * 0.7, 4) AS low, round(predicted_price * 1.3, 4) AS high, price_eur - predicted_price AS residual, abs(price_eur - predicted_price) AS abs_error,
    abs(price_eur - predicted_price) / nullif(abs(price_eur), 0) * 100 AS ape, price_eur BETWEEN round(predicted_price * 0.7, 4) AND round(predicted_price * 1.3, 4) AS covered
    FROM listings l JOIN signals USING (olx_id))"""


def scored(t: Tables) -> DataFrame:
    rows = t.listings.join(signals_of(t), "olx_id")
    rows = rows.withColumns({"low": F.round(F.col("predicted_price") * 0.7, 4), "high": F.round(F.col("predicted_price") * 1.3, 4)})
    return v.residuals(rows, "price_eur", "predicted_price", "low", "high")


def avg_sql(c: str, digits: int = 4) -> str:
    return f"round(sum(CAST({c} AS DECIMAL(28, {digits})))::DOUBLE / count({c}), 4)"


STATS_SQL = f"count(*) AS n, {avg_sql('abs_error')} AS mae, {avg_sql('ape', 8)} AS mape, {avg_sql('residual')} AS bias, round(avg(covered::INT), 6) AS coverage"


@query("d15_join_predictions", f"WITH {SCORED_SQL} SELECT olx_id, round(residual, 4) AS residual, covered FROM scored")
def _(t: Tables) -> DataFrame:
    return scored(t).select("olx_id", F.round("residual", 4).alias("residual"), "covered")


@query("e16_error_buckets", f"WITH {SCORED_SQL} SELECT year, {STATS_SQL} FROM scored GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return v.error_stats(scored(t), ["year"])


@query("e16_error_by_brand", f"WITH {SCORED_SQL}, top AS (SELECT brand AS b FROM scored WHERE brand IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10) SELECT coalesce(b, 'other') AS brand_top, {STATS_SQL} FROM scored LEFT JOIN top ON brand = b GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return v.error_stats(v.by_top(scored(t), "brand"), ["brand_top"])


@query(
    "e16_error_by_price",
    f"""WITH {SCORED_SQL}, b AS (SELECT *, CASE WHEN price_eur < 0 THEN NULL WHEN price_eur < 3000 THEN '<3k' WHEN price_eur < 7000 THEN '3-7k' WHEN price_eur < 15000 THEN '7-15k' WHEN price_eur < 30000 THEN '15-30k' ELSE '30k+' END AS price_bucket FROM scored) SELECT price_bucket, {STATS_SQL} FROM b GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    from ..functions.scalars import bucket

    labels = bucket(F.col("price_eur"), [0, 3000, 7000, 15000, 30000], ["<3k", "3-7k", "7-15k", "15-30k", "30k+"])
    return v.error_stats(scored(t).withColumn("price_bucket", labels), ["price_bucket"])


@query(
    "e17_global_metrics",
    f"""WITH {SCORED_SQL} SELECT {STATS_SQL}, count(*) FILTER (low > high) AS inverted,
    round(1 - sum({D4.format('residual * residual')})::DOUBLE / (sum({D4.format('price_eur * price_eur')})::DOUBLE - sum({D4.format('price_eur')})::DOUBLE * sum({D4.format('price_eur')})::DOUBLE / count(*)), 4) AS r2 FROM scored""",
)
def _(t: Tables) -> DataFrame:
    return v.global_metrics(scored(t), "price_eur", "low", "high")


@query(
    "e18_reliability_curve",
    f"""WITH {SCORED_SQL}, e AS (SELECT list_sort(list_distinct(quantile_cont(predicted_price, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edges FROM scored),
    b AS (SELECT CAST(len(list_filter(edges[2:], lambda x: x < predicted_price)) AS INT) AS bin, covered FROM scored, e) SELECT bin, count(*) AS n, round(avg(covered::INT), 6) AS coverage FROM b GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    return v.by_quantile(scored(t), "predicted_price").groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg(F.col("covered").cast("int")), 6).alias("coverage"))


@query("k02_worst_residuals", f"WITH {SCORED_SQL} SELECT olx_id, round(abs_error, 4) AS abs_error FROM scored ORDER BY scored.abs_error DESC, olx_id LIMIT 20")
def _(t: Tables) -> DataFrame:
    return v.worst_residuals(scored(t), "olx_id").select("olx_id", F.round("abs_error", 4).alias("abs_error"))


@query(
    "k03_both_ends",
    "(SELECT event_id, value, 'high' AS side FROM events WHERE value IS NOT NULL ORDER BY value DESC, event_id LIMIT 10) UNION ALL (SELECT event_id, value, 'low' FROM events WHERE value IS NOT NULL ORDER BY value, event_id LIMIT 10)",
)
def _(t: Tables) -> DataFrame:
    return v.both_ends(t.events, "value", "event_id").select("event_id", "value", "side")


FEED_SQL = "feed AS (SELECT olx_id, round(price_eur / 1000, 5) AS discount_pct, first_seen_at, CASE WHEN part_id % 5 > 0 THEN first_price_eur - price_eur END AS profit_eur FROM listings)"


def feed(t: Tables) -> DataFrame:
    profit = F.when(F.col("part_id") % 5 > 0, F.col("first_price_eur") - F.col("price_eur"))
    return t.listings.select("olx_id", F.round(F.col("price_eur") / 1000, 5).alias("discount_pct"), "first_seen_at", profit.alias("profit_eur"))


def feed_query(by: str, column: str):
    @query(f"k05_feed_by_{by}", f"WITH {FEED_SQL} SELECT olx_id, {column} FROM feed ORDER BY {column} DESC NULLS LAST, olx_id LIMIT 100")
    def _(t: Tables) -> DataFrame:
        return v.feed_order(feed(t), by).limit(100).select("olx_id", column)


for _by, _column in (("discount", "discount_pct"), ("newest", "first_seen_at"), ("profit", "profit_eur")):
    feed_query(_by, _column)


@query(
    "k06_stratified_sample",
    "SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || 's'), doc_id) AS k FROM documents WHERE length(text) >= 40 AND lang <> '' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) WHERE k <= 7",
)
def _(t: Tables) -> DataFrame:
    known = t.labels.where("toxic = 1").select("doc_id")
    return v.stratified_sample(t.documents, "source", "doc_id", 7, "s", known, "text", 40, "lang").select("source", "doc_id")


@query("k07_seeded_sample", "SELECT c_custkey FROM customer ORDER BY c_custkey || 'seed', c_custkey LIMIT 50")
def _(t: Tables) -> DataFrame:
    return v.seeded_sample(t.customer.select("c_custkey"), "c_custkey", 50, "seed")


@query("k08_interleave", "SELECT event_id, user_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM events) WHERE place <= 5")
def _(t: Tables) -> DataFrame:
    return v.interleave(t.events, "user_id", [F.desc("value"), F.col("event_id")], 5).select("event_id", "user_id", "place")


@query(
    "k08_round_robin",
    """WITH b AS (SELECT event_id, user_id, value, CAST(floor(value / 25) AS BIGINT) AS bucket FROM events WHERE value IS NOT NULL), p AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY value DESC, event_id) - 1 AS place, max(value) OVER (PARTITION BY user_id) AS best FROM b),
    k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY place, bucket DESC, event_id) AS k FROM p) SELECT event_id, user_id, bucket, CAST(place AS INT) AS place FROM k WHERE k <= CASE WHEN best >= 100 THEN 4 WHEN best >= 50 THEN 2 ELSE 1 END""",
)
def _(t: Tables) -> DataFrame:
    rows = t.events.where("value is not null").select("event_id", "user_id", "value", F.floor(F.col("value") / 25).alias("bucket"))
    return v.round_robin(rows, "bucket", "event_id", "user_id", "value", [(100, 4), (50, 2)], 1).select("event_id", "user_id", "bucket", "place")


JUDGED_SQL = "judged AS (SELECT d.doc_id, l.quality = 0 AS bad, round(least(1, 10 * (length(text) - length(replace(replace(text, '%', ''), '#', ''))) / greatest(length(text), 1)), 6)::DOUBLE AS score FROM documents d JOIN labels l USING (doc_id))"


def judged(t: Tables) -> DataFrame:
    n = F.length("text")
    symbols = n - F.length(F.translate("text", "%#", ""))
    return t.documents.join(t.labels, "doc_id").select("doc_id", (F.col("quality") == 0).alias("bad"), F.round(F.least(F.lit(1.0), 10 * symbols / F.greatest(n, F.lit(1))), 6).alias("score"))


@query("k09_precision_at", f"WITH {JUDGED_SQL}, top AS (SELECT * FROM judged ORDER BY score DESC, doc_id LIMIT 30) SELECT (SELECT count(*) FROM top WHERE bad) AS hits, count(*) FILTER (bad) AS positives, round((SELECT count(*) FROM top WHERE bad) / least(30, count(*) FILTER (bad)), 6) AS precision FROM judged")
def _(t: Tables) -> DataFrame:
    return v.precision_at(judged(t), "score", F.col("bad"), "doc_id", 30)


RATES = "round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) AS accuracy"


@query("e23_confusion", f"WITH {JUDGED_SQL}, n AS (SELECT count(*) FILTER (bad AND score >= 0.2) AS tp, count(*) FILTER (NOT bad AND score >= 0.2) AS fp, count(*) FILTER (bad AND score < 0.2) AS fn, count(*) FILTER (NOT bad AND score < 0.2) AS tn FROM judged) SELECT *, {RATES} FROM n")
def _(t: Tables) -> DataFrame:
    return v.confusion(judged(t), F.col("bad"), F.col("score") >= 0.2)


@query("e23_threshold_sweep", f"WITH {JUDGED_SQL}, n AS (SELECT threshold::DOUBLE AS threshold, count(*) FILTER (bad AND score >= threshold) AS tp, count(*) FILTER (NOT bad AND score >= threshold) AS fp, count(*) FILTER (bad AND score < threshold) AS fn, count(*) FILTER (NOT bad AND score < threshold) AS tn FROM judged, (VALUES (0.05), (0.1), (0.5)) AS x(threshold) GROUP BY 1) SELECT *, {RATES} FROM n")
def _(t: Tables) -> DataFrame:
    return v.threshold_sweep(judged(t), "bad", "score", [0.05, 0.1, 0.5])


@query(
    "e26_field_accuracy",
    """WITH r AS (SELECT CASE WHEN p_size % 5 > 0 THEN p_type END AS ot, CASE WHEN p_size % 3 > 0 THEN p_type ELSE 'X' END AS ct, p_retailprice AS op, CASE WHEN p_size % 4 > 0 THEN p_retailprice * (1 + p_size / 500) END AS cp, p_size AS os, p_size + p_partkey % 3 AS cs FROM part),
    x AS (SELECT 'type' AS field, coalesce(ot = ct, false) AS ok FROM r WHERE ot IS NOT NULL UNION ALL SELECT 'price', coalesce(abs(cp - op) <= 0.05 * abs(op), false) FROM r UNION ALL SELECT 'size', abs(cs - os) <= 1 FROM r)
    SELECT field, count(*) AS n, count(*) FILTER (ok) AS "right", round(count(*) FILTER (ok) / count(*), 6) AS accuracy FROM x GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    k = F.col("p_size")
    rows = t.part.select(
        "p_partkey",
        F.when(k % 5 > 0, F.col("p_type")).alias("o_type"),
        F.when(k % 3 > 0, F.col("p_type")).otherwise("X").alias("c_type"),
        F.col("p_retailprice").alias("o_price"),
        F.when(k % 4 > 0, F.col("p_retailprice") * (1 + k / 500)).alias("c_price"),
        k.alias("o_size"),
        (k + F.col("p_partkey") % 3).alias("c_size"),
    )
    return v.field_accuracy(rows, {"type": "equal", "price": "near", "size": "step"}, "p_partkey")


@query(
    "e20_top_ancestor",
    """WITH RECURSIVE tree AS (SELECT n_nationkey + 100 AS id, n_regionkey AS parent FROM nation UNION ALL SELECT r_regionkey, NULL FROM region), walk AS (SELECT id, id AS top, parent FROM tree UNION ALL SELECT w.id, t.id, t.parent FROM walk w JOIN tree t ON w.parent = t.id)
    SELECT CAST(id AS BIGINT) AS id, CAST(top AS BIGINT) AS top FROM walk WHERE parent IS NULL""",
)
def _(t: Tables) -> DataFrame:
    tree = t.nation.select((F.col("n_nationkey") + 100).cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("parent")).unionByName(t.region.select(F.col("r_regionkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent")))
    return v.top_ancestors(tree)


@query("e21_photo_rollup", "SELECT user_id, max(value) AS max_p, count(*) FILTER (value >= 50) AS n_high, count(*) FILTER (value >= 50) >= 2 AS flagged, string_agg(event_id, ',' ORDER BY event_id) FILTER (value >= 200) AS high FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    high = F.array_sort(F.collect_list(F.when(F.col("value") >= 200, F.col("event_id"))))
    n = F.count_if(F.col("value") >= 50)
    return t.events.groupBy("user_id").agg(F.max("value").alias("max_p"), n.alias("n_high"), (n >= 2).alias("flagged"), F.nullif(F.array_join(F.transform(high, lambda x: x.cast("string")), ","), F.lit("")).alias("high"))


@query("e22_plate_rollup", "SELECT user_id, count(*) FILTER (value > 20) AS readable, arg_max(event_type, {'v': value, 'e': event_id}) AS best FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.count_if(F.col("value") > 20).alias("readable"), F.max_by("event_type", F.struct("value", "event_id")).alias("best"))


@query("a11_models_by_brand", "SELECT brand, string_agg(model, ',' ORDER BY model) AS models FROM (SELECT DISTINCT brand, model FROM listings) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.listings.groupBy("brand").agg(F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"))


@query("a12_manifest", "SELECT name, TIMESTAMP '2024-02-01' AS built_at, n, bytes > 0 AS sized FROM (SELECT 'orders' AS name, count(*) AS n, 1 AS bytes FROM orders UNION ALL SELECT 'part', count(*), 1 FROM part UNION ALL SELECT 'events', count(*), 1 FROM events)")
def _(t: Tables) -> DataFrame:
    from ..sources.tables import manifest

    return manifest({n: getattr(t, n) for n in ("orders", "part", "events")}, "2024-02-01 00:00:00").select("name", "built_at", "n", (F.col("bytes") > 0).alias("sized"))


@query(
    "a05_portfolio",
    """WITH p AS (SELECT o_orderkey AS id, o_totalprice AS buy, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice * (1 + o_orderkey % 40 / 100) END AS sell, o_orderkey % 500 AS costs FROM orders)
    SELECT id, round(buy + costs, 4) AS total_cost, round(sell - buy - costs, 4) AS profit, round((sell - buy - costs) / nullif(buy + costs, 0) * 100, 1) AS roi_pct FROM p""",
)
def _(t: Tables) -> DataFrame:
    k, buy = F.col("o_orderkey"), F.col("o_totalprice")
    sell, costs = F.when(k % 3 > 0, buy * (1 + k % 40 / 100)), k % 500
    return t.orders.select(k.alias("id"), F.round(buy + costs, 4).alias("total_cost"), F.round(sell - buy - costs, 4).alias("profit"), F.round(F.try_divide(sell - buy - costs, F.nullif(buy + costs, F.lit(0.0))) * 100, 1).alias("roi_pct"))


@query("u01_union_all", "SELECT kind, count(*) AS n FROM (SELECT 'c' AS kind, c_nationkey AS k FROM customer UNION ALL SELECT 's', s_nationkey FROM supplier) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    both = t.customer.select(F.lit("c").alias("kind"), F.col("c_nationkey").alias("k")).unionByName(t.supplier.select(F.lit("s").alias("kind"), F.col("s_nationkey").alias("k")))
    return both.groupBy("kind").agg(F.count("*").alias("n"))


@query("u02_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("u03_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT user_id FROM events")
def _(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("k")).subtract(t.events.select("user_id"))


@query("u04_jaccard", "SELECT page_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM (SELECT page_id, list_distinct(string_split(url, '/')) AS a, list_distinct(string_split(replace(url, 'www.', ''), '/')) AS b FROM pages)")
def _(t: Tables) -> DataFrame:
    a, b = F.split("url", "/"), F.split(F.replace("url", F.lit("www."), F.lit("")), "/")
    return t.pages.select("page_id", F.round(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)), 6).alias("jaccard"))


@query("d14_semi_sold_again", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def _(t: Tables) -> DataFrame:
    return t.customer.join(t.events.where("event_type = 'purchase'").select(F.col("user_id").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query(
    "m08_conformal_by_brand",
    f"""WITH {SCORED_SQL}, s AS (SELECT brand, greatest(low - price_eur, price_eur - high) AS c FROM scored), k AS (SELECT brand, c, row_number() OVER (PARTITION BY brand ORDER BY c) AS k, count(*) OVER (PARTITION BY brand) AS n FROM s),
    a AS (SELECT *, 1 + least(ceil(0.8::DOUBLE * (n + 1)) / n, 1.0) * (n - 1) AS pos FROM k) SELECT brand, n, round(max(c) FILTER (k = floor(pos)) + (max(c) FILTER (k = ceil(pos)) - max(c) FILTER (k = floor(pos))) * max(pos - floor(pos)), 6) AS q FROM a GROUP BY brand, n HAVING n >= 30""",
)
def _(t: Tables) -> DataFrame:
    rows = scored(t).withColumn("c", F.greatest(F.col("low") - F.col("price_eur"), F.col("price_eur") - F.col("high")))
    return v.conformal_quantile(rows, "c", 0.8, ["brand"], 30)


@query("m10_decile_edges", f"WITH {SIGNALS_SQL}, e AS (SELECT unnest(list_distinct(quantile_cont(predicted_price, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edge FROM signals) SELECT round(edge, 6) AS edge FROM e")
def _(t: Tables) -> DataFrame:
    # several passes read them
    signals = checkpointed(signals_of(t).select("predicted_price"), "signals")
    return v.quantile_edges(signals, "predicted_price").select(F.explode("edges").alias("edge")).select(F.round("edge", 6).alias("edge"))


@query(
    "m14_band_assembly",
    """WITH p AS (SELECT p_partkey, ln(p_retailprice) AS m, ln(p_retailprice) - (p_size % 7 - 2) / 10.0::DOUBLE AS l, ln(p_retailprice) + (p_size % 5) / 10.0::DOUBLE AS h FROM part),
    b AS (SELECT p_partkey, m, least(l, h) - 0.05::DOUBLE AS a, greatest(l, h) + 0.05::DOUBLE AS b FROM p) SELECT p_partkey, round(greatest(0, exp(a) - 1), 6) AS fair_price_low, round(greatest(0, exp(greatest(a, least(b, m))) - 1), 6) AS predicted_price, round(greatest(0, exp(b) - 1), 6) AS fair_price_high FROM b""",
)
def _(t: Tables) -> DataFrame:
    mid, k = F.log("p_retailprice"), F.col("p_size")
    made = v.assemble_bands(mid - (k % 7 - 2) / 10, mid, mid + k % 5 / 10, F.lit(0.05))
    return t.part.select("p_partkey", *[c.alias(n) for n, c in made.items()])


@query("m16_pinball", f"WITH {SCORED_SQL} SELECT {avg_sql('greatest(0.1::DOUBLE * (price_eur - low), (0.1::DOUBLE - 1) * (price_eur - low))')} AS p10, {avg_sql('greatest(0.9::DOUBLE * (price_eur - high), (0.9::DOUBLE - 1) * (price_eur - high))')} AS p90 FROM scored")
def _(t: Tables) -> DataFrame:
    from ..functions.scalars import mean

    return scored(t).agg(F.round(mean(v.pinball(F.col("price_eur"), F.col("low"), 0.1)), 4).alias("p10"), F.round(mean(v.pinball(F.col("price_eur"), F.col("high"), 0.9)), 4).alias("p90"))


@query("m01_fold_rare", "SELECT folded AS name, count(*) AS n FROM (SELECT CASE WHEN count(*) OVER (PARTITION BY p_name) >= 60 THEN p_name ELSE '__other__' END AS folded FROM part) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return v.fold_rare(t.part, "p_name", 60).groupBy(F.col("p_name_folded").alias("name")).agg(F.count("*").alias("n"))


@query(
    "f03_training_filter",
    """WITH c AS (SELECT * FROM listings WHERE price_eur IS NOT NULL AND price_eur / first_price_eur < 10 AND price_eur / first_price_eur > 0.1), e AS (SELECT quantile_cont(price_eur, 0.01) AS a, quantile_cont(price_eur, 0.99) AS b FROM c),
    m AS (SELECT price_eur BETWEEN a AND b AS i, coalesce(mileage_km / greatest(2001 - year, 1) BETWEEN 500 AND 100000, true) AS u FROM c, e) SELECT count(*) AS calm, count(*) FILTER (i) AS inside, count(*) FILTER (i AND u) AS kept FROM m""",
)
def _(t: Tables) -> DataFrame:
    return v.training_filter(t.listings, "price_eur", "first_price_eur", "mileage_km", "year", 2001)[1]


@query(
    "w09_waterfall",
    """WITH c AS (SELECT p_partkey AS id, 'size' AS f, (p_size - 25) / 100 AS v FROM part UNION ALL SELECT p_partkey, 'price', (p_retailprice - 1500) / 3000 FROM part UNION ALL SELECT p_partkey, 'key', (p_partkey % 10 - 5) / 50 FROM part),
    k AS (SELECT *, row_number() OVER w AS k, 7.0::DOUBLE + sum(v) OVER (PARTITION BY id ORDER BY abs(v) DESC, f ROWS UNBOUNDED PRECEDING) AS run FROM c WINDOW w AS (PARTITION BY id ORDER BY abs(v) DESC, f)),
    s AS (SELECT id, least(k, 3) AS step, CASE WHEN k <= 2 THEN f ELSE 'rest' END AS feature, exp(run) - exp(run - v) AS eur FROM k) SELECT id, step, feature, round(sum(eur), 6) AS delta_eur FROM s GROUP BY 1, 2, 3""",
)
def _(t: Tables) -> DataFrame:
    parts = [(("size"), (F.col("p_size") - 25) / 100), ("price", (F.col("p_retailprice") - 1500) / 3000), ("key", (F.col("p_partkey") % 10 - 5) / 50)]
    rows = t.part.select(F.col("p_partkey").alias("id"), F.explode(F.array(*[F.struct(F.lit(n).alias("f"), c.alias("v")) for n, c in parts])).alias("x")).select("id", "x.f", "x.v", F.lit(7.0).alias("base"))
    return v.waterfall(rows, "id", "f", "v", "base", 2)


@query("m21_time_folds", "WITH e AS (SELECT quantile_cont(epoch_us(first_seen_at), [0.25, 0.5, 0.75]) AS cuts FROM listings) SELECT CAST(len(list_filter(cuts, lambda x: x <= epoch_us(first_seen_at))) AS INT) AS fold, count(*) AS n FROM listings, e GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return v.time_folds(t.listings, ["first_seen_at"], 3).groupBy("fold").agg(F.count("*").alias("n"))


@query(
    "m22_hazard_target",
    """WITH l AS (SELECT *, epoch(deactivated_at - first_seen_at) / 86400 AS life, epoch(:as_of - first_seen_at) / 86400 AS age, coalesce(NOT is_active AND deactivation_reason = 'sold', false) AS sold FROM listings)
    SELECT CAST(CASE WHEN sold AND life <= 30 THEN 1 WHEN sold THEN 0 WHEN is_active AND age > 30 THEN 0 END AS INT) AS label, count(*) AS n FROM l GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    return v.hazard_target(t.listings, AS_OF).groupBy("label").agg(F.count("*").alias("n"))


@query("m26_score_scaling", "SELECT event_id, round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 6) AS scaled, value > (SELECT quantile_cont(value, 0.95) FROM events) AS flagged FROM events")
def _(t: Tables) -> DataFrame:
    return v.scaled("value", t.events).select("event_id", "scaled", "flagged")


@query("w06_canonical_of_block", "SELECT olx_id, first_value(olx_id) OVER (PARTITION BY brand, model, year, district ORDER BY first_seen_at NULLS LAST, olx_id) AS head FROM listings")
def _(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("brand", "model", "year", "district").orderBy(F.col("first_seen_at").asc_nulls_last(), "olx_id")
    return t.listings.select("olx_id", F.first("olx_id").over(w).alias("head"))


PARTS_SQL = """parts AS (SELECT olx_id AS id, unnest(['mileage', 'price', 'engine', 'power']) AS feature, unnest([(mileage_km - 25000) / 50000, (price_eur - 30000) / 50000, (1200 - engine_cc) / 2000, (horsepower - 40) / 100]::DOUBLE[]) AS v FROM listings),
    long AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(v) DESC, feature) - 1 AS rank FROM parts)"""


def contributions(t: Tables) -> DataFrame:
    c = F.col
    values = F.array((c("mileage_km") - 25000) / 50000, (c("price_eur") - 30000) / 50000, (1200 - c("engine_cc")) / 2000, (c("horsepower") - 40) / 100)
    rows = t.listings.select(c("olx_id").alias("id"), F.array(*[F.lit(x) for x in ("mileage", "price", "engine", "power")]).alias("n"), values.alias("v"))
    return v.contributions_long(rows, "id", "n", "v", 3)


@query("m20_long_contributions", f"WITH {PARTS_SQL} SELECT id, CAST(rank AS INT) AS rank, feature, round(v, 6) AS contribution FROM long WHERE rank < 3")
def _(t: Tables) -> DataFrame:
    return contributions(t).withColumn("contribution", F.round("contribution", 6))


@query("m20_wide_contributions", f"WITH {PARTS_SQL} SELECT id, string_agg(feature, ',' ORDER BY rank) AS features, round(sum(v), 7) AS total FROM long WHERE rank < 3 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    wide = v.contributions_wide(contributions(t), "id")
    return wide.select("id", F.concat_ws(",", "features").alias("features"), F.round(F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x), 7).alias("total"))


@query(
    "m03_sold_weights",
    """WITH d AS (SELECT olx_id, price_eur, CASE WHEN NOT is_active AND deactivation_reason = 'sold' THEN floor(epoch(deactivated_at - first_seen_at) / 86400) ELSE -1 END AS days, NOT is_active AND deactivation_reason = 'sold' AS gone FROM listings),
    w AS (SELECT olx_id, price_eur * CASE WHEN days < 0 OR days > 365 THEN 1 WHEN days <= 14 THEN 0.96 WHEN days <= 60 THEN 0.94 WHEN days <= 180 THEN 0.91 ELSE 0.88 END::DOUBLE AS target,
      CASE WHEN NOT coalesce(gone, false) THEN 1 WHEN days < 0 OR days > 365 THEN 0 WHEN days <= 14 THEN 0.9 WHEN days <= 60 THEN 0.7 WHEN days <= 180 THEN 0.5 ELSE 0.3 END::DOUBLE AS trust FROM d),
    raw AS (SELECT *, 1 / ln(greatest(target, 0) + 2) AS raw FROM w)
    SELECT olx_id, round(target, 4) AS target, round(raw / (SELECT avg(raw) FROM raw) * trust, 6) AS weight FROM raw""",
)
def _(t: Tables) -> DataFrame:
    return v.training_weights(t.listings).select("olx_id", F.round("target", 4).alias("target"), F.round("weight", 6).alias("weight"))


@query("e08_dom_by_fuel", "SELECT fuel_type, median(epoch(deactivated_at - first_seen_at) / 86400) AS median, count(*) AS n FROM listings WHERE NOT is_active GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return v.median_by(t.listings.where(~F.col("is_active")).withColumn("dom", m.days_on_market()), ["fuel_type"], "dom")
