"""Model evaluation, conformal bands, sampling and ranking checks: aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import loss_weight, md5_share, mean, median_of, ratio, sold_tier, whole_days
from .ranks import grouped_positions, places, quantiles
from .storage import checkpointed


def residuals(df: DataFrame, actual: str, predicted: str, low: str | None = None, high: str | None = None) -> DataFrame:
    """Adds residual, abs_error, ape (%, null for a zero actual) and covered."""
    r = F.col(actual) - F.col(predicted)
    out = df.withColumns({"residual": r, "abs_error": F.abs(r), "ape": ratio(F.abs(r), F.abs(F.col(actual))) * 100})
    return out.withColumn("covered", F.col(actual).between(F.col(low), F.col(high))) if low and high else out


def error_stats(df: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """n, MAE, MAPE, signed bias and coverage, in all or by keys, of a frame from ``residuals``."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.round(mean(F.col("abs_error")), 4).alias("mae"),
        F.round(mean(F.col("ape"), 8), 4).alias("mape"),
        F.round(mean(F.col("residual")), 4).alias("bias"),
        F.round(F.avg(F.col("covered").cast("int")), 6).alias("coverage"),
    )


def by_top(df: DataFrame, column: str, top: int = 10, other: str = "other") -> DataFrame:
    """Adds ``<column>_top``: one of the ``top`` commonest known values (ties by value), else ``other``."""
    # at most ``top`` rows
    common = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), column).limit(top).select(F.col(column).alias("_c"))
    return df.join(F.broadcast(common), F.col(column) == F.col("_c"), "left").withColumn(f"{column}_top", F.coalesce("_c", F.lit(other))).drop("_c")


def global_metrics(df: DataFrame, actual: str, low: str, high: str) -> DataFrame:
    """One row: MAE, MAPE, R2 by sums, coverage, bias, inverted bands."""
    d = lambda c: c.cast("decimal(28,4)")
    sums = df.agg(
        F.count("*").alias("n"),
        F.round(mean(F.col("abs_error")), 4).alias("mae"),
        F.round(mean(F.col("ape"), 8), 4).alias("mape"),
        F.round(F.avg(F.col("covered").cast("int")), 6).alias("coverage"),
        F.round(mean(F.col("residual")), 4).alias("bias"),
        F.count_if(F.col(low) > F.col(high)).alias("inverted"),
        F.sum(d(F.col("residual") * F.col("residual"))).cast("double").alias("_sse"),
        F.sum(d(F.col(actual) * F.col(actual))).cast("double").alias("_yy"),
        F.sum(d(F.col(actual))).cast("double").alias("_y"),
    )
    return sums.withColumn("r2", F.round(1 - ratio(F.col("_sse"), F.col("_yy") - F.col("_y") * F.col("_y") / F.col("n")), 4)).drop("_sse", "_yy", "_y")


def quantile_edges(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """One row: the distinct inner and outer quantile edges of a column as an array."""
    edges = [x for x in quantiles(df, column, [i / n for i in range(n + 1)]) if x is not None]
    return df.sparkSession.createDataFrame([(sorted(set(edges)) or None,)], "edges array<double>")


def by_quantile(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """Adds ``bin``: right-closed bins at the distinct quantile edges, the least value in the first."""
    edges = sorted({x for x in quantiles(df, column, [i / n for i in range(n + 1)]) if x is not None})
    below = sum((F.when(F.col(column) > e, 1).otherwise(0) for e in edges[1:]), F.lit(0))
    return df.withColumn("bin", F.when(F.col(column).isNotNull(), below).cast("int"))


def worst_residuals(df: DataFrame, key: str, top: int = 20) -> DataFrame:
    return df.orderBy(F.desc("abs_error"), key).limit(top)


def both_ends(df: DataFrame, score: str, key: str, top: int = 10) -> DataFrame:
    """The ``top`` highest and lowest rows, marked by ``side``."""
    rows = df.where(F.col(score).isNotNull())
    high = rows.orderBy(F.desc(score), key).limit(top).withColumn("side", F.lit("high"))
    return high.unionByName(rows.orderBy(score, key).limit(top).withColumn("side", F.lit("low")))


def confusion(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall, f1, accuracy; rows with a null side are left out."""
    rows = df.select(truth.cast("boolean").alias("t"), guess.cast("boolean").alias("g")).where("t IS NOT NULL AND g IS NOT NULL")
    n = rows.agg(*[F.count_if(c).alias(k) for k, c in (("tp", F.col("t") & F.col("g")), ("fp", ~F.col("t") & F.col("g")), ("fn", F.col("t") & ~F.col("g")), ("tn", ~F.col("t") & ~F.col("g")))])
    return with_rates(n)


def with_rates(n: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    return n.withColumns(
        {
            "precision": F.round(ratio(tp, (tp + fp).cast("double")), 6),
            "recall": F.round(ratio(tp, (tp + fn).cast("double")), 6),
            "f1": F.round(ratio(2 * tp, (2 * tp + fp + fn).cast("double")), 6),
            "accuracy": F.round(ratio(tp + tn, (tp + fp + fn + tn).cast("double")), 6),
        }
    )


def threshold_sweep(df: DataFrame, truth: str, score: str, thresholds: list[float]) -> DataFrame:
    """A row of ``confusion`` for each threshold. Rows are first counted by how many thresholds they reach."""
    reached = sum((F.when(F.col(score) >= x, 1).otherwise(0) for x in thresholds), F.lit(0))
    counts = df.where(F.col(truth).isNotNull() & F.col(score).isNotNull()).groupBy(reached.alias("_r")).agg(F.count_if(F.col(truth)).alias("_pos"), F.count_if(~F.col(truth)).alias("_neg"))
    rows = counts.select("_pos", "_neg", F.posexplode(F.array(*[F.lit(float(x)) for x in sorted(thresholds)])).alias("_i", "threshold"), "_r")
    hit = F.col("_r") > F.col("_i")
    total = lambda c, on: F.sum(F.when(on, F.col(c)).otherwise(0)).alias
    return with_rates(rows.groupBy("threshold").agg(total("_pos", hit)("tp"), total("_neg", hit)("fp"), total("_pos", ~hit)("fn"), total("_neg", ~hit)("tn")))


def field_accuracy(df: DataFrame, fields: dict[str, str], key: str) -> DataFrame:
    """Share of right fields; ``o_<f>`` holds the truth (null: not judged), ``c_<f>`` the candidate.

    Kinds: equal, near (within 5 %), step (within 1), list (Jaccard of at least 0.5). A missing
    candidate is wrong.
    """
    rows = []
    for f, kind in fields.items():
        o, c = F.col(f"o_{f}"), F.col(f"c_{f}")
        if kind == "equal":
            right = o == c
        elif kind == "near":
            right = F.abs(c - o) <= 0.05 * F.abs(o)
        elif kind == "step":
            right = F.abs(c - o) <= 1
        else:
            right = F.size(F.array_intersect(o, c)) >= 0.5 * F.size(F.array_union(o, c))
        rows.append(F.struct(F.lit(f).alias("field"), o.isNotNull().alias("judged"), F.coalesce(right, F.lit(False)).alias("right")))
    long = df.select(key, F.explode(F.array(*rows)).alias("r")).select("r.*").where("judged")
    return long.groupBy("field").agg(F.count("*").alias("n"), F.count_if("right").alias("right")).withColumn("accuracy", F.round(F.col("right") / F.col("n"), 6))


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: str, known: DataFrame | None = None, text: str | None = None, least_chars: int = 0, url: str | None = None) -> DataFrame:
    """``n`` rows of each stratum, the least by md5 of key and seed.

    Left out are keys of ``known``, texts under ``least_chars`` and rows with a null or empty url.
    """
    if known is not None:
        df = df.join(known.select(F.col(key).alias("_known")), F.col(key) == F.col("_known"), "left_anti")
    if text:
        df = df.where(F.length(text) >= least_chars)
    if url:
        df = df.where(F.coalesce(F.col(url), F.lit("")) != "")
    w = Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), key)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def seeded_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    return df.orderBy(F.concat(F.col(key).cast("string"), F.lit(seed)), key).limit(n)


def feed_order(df: DataFrame, by: str, key: str = "olx_id") -> DataFrame:
    """Deals in the order of a feed: ``discount``, ``newest`` or ``profit``, each falling, unknown last; ties by key."""
    order = {"discount": "discount_pct", "newest": "first_seen_at", "profit": "profit_eur"}[by]
    return df.orderBy(F.col(order).desc_nulls_last(), key)


def round_robin(df: DataFrame, bucket: str, key: str, group: str, score: str, caps: list[tuple[float, int]], least: int) -> DataFrame:
    """Rows in turns over buckets, adds ``place`` (0-based rank in the bucket) and keeps each group's share.

    First come the first rows of all buckets, the highest bucket first, then their second rows, and so on;
    rows of a bucket are ordered by falling score and key. Of a group at most as many rows stay, in
    this order, as ``caps`` (score from, most; first that fits its highest score) allow, else ``least``.
    """
    best = Window.partitionBy(group)
    most = F.lit(least)
    for at, n in reversed(sorted(caps, reverse=True)):
        most = F.when(F.max(score).over(best) >= at, n).otherwise(most)
    rows = places(df, bucket, [F.desc(score), F.col(key)]).withColumn("place", F.col("place").cast("int"))
    own = Window.partitionBy(group).orderBy("place", F.desc(bucket), key)
    rows = rows.withColumns({"_most": most, "_k": F.row_number().over(own)})
    return rows.where(F.col("_k") <= F.col("_most")).drop("_most", "_k").orderBy("place", F.desc(bucket), key)


def interleave(df: DataFrame, bucket: str, order: list[Column], most: int) -> DataFrame:
    """Round-robin over buckets, the highest first: adds ``place`` in the bucket; at most ``most`` each."""
    w = Window.partitionBy(bucket).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= most).orderBy("place", F.desc(bucket))


def precision_at(df: DataFrame, score: str, truth: Column, key: str, k: int) -> DataFrame:
    """One row: hits among the first ``k`` by score, over the lesser of k and all positives."""
    top = df.orderBy(F.desc(score), key).limit(k).agg(F.count_if(truth).alias("hits"))
    # one row each
    both = top.join(F.broadcast(df.agg(F.count_if(truth).alias("positives"))), F.lit(True))
    return both.withColumn("precision", F.round(ratio(F.col("hits"), F.least(F.lit(k), F.col("positives")).cast("double")), 6))


def conformal_quantile(df: DataFrame, score: str, coverage: float = 0.8, keys: list[str] = [], least: int = 1) -> DataFrame:  # noqa: B006
    """The finite-sample quantile min(ceil(c (n + 1)) / n, 1) of conformal scores, linearly interpolated.

    The level differs by group, so the two order statistics around it are picked by rank.
    """
    rows = df.where(F.col(score).isNotNull())
    if keys:
        level = lambda n: F.least(F.ceil(F.lit(coverage) * (n + 1)) / n, F.lit(1.0)) * (n - 1)
        out = grouped_positions(rows, keys, {"q": score}, lambda n: [level(n)])
        return out.where(F.col("n") >= least).select(*keys, "n", F.round(F.col("quantiles")[0], 6).alias("q"))
    # in all: the level is one number
    n = rows.count()
    level = min(-(-int(round(coverage * (n + 1) * 1e9)) // 10**9) / n, 1.0) if n else 1.0
    q = quantiles(rows, score, [level])[0]
    return df.sparkSession.createDataFrame([(n, q)], "n long, q double").withColumn("q", F.round("q", 6))


def assemble_bands(low: Column, mid: Column, high: Column, q: Column) -> dict[str, Column]:
    """Price bands from log predictions: crossings repaired, widened by q, floored at 0."""
    a, b = F.least(low, high) - q, F.greatest(low, high) + q
    m = F.greatest(a, F.least(b, mid))
    return {k: F.round(F.greatest(F.lit(0.0), F.expm1(x)), 6) for k, x in (("fair_price_low", a), ("predicted_price", m), ("fair_price_high", b))}


def pinball(actual: Column, predicted: Column, alpha: float) -> Column:
    d = actual - predicted
    return F.greatest(alpha * d, (alpha - 1) * d)


def fold_rare(df: DataFrame, column: str, least: int = 3, other: str = "__other__") -> DataFrame:
    """Adds ``<column>_folded``: values rarer than ``least`` become ``other``."""
    common = df.groupBy(column).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(F.col(column).alias("_c"))
    # its stored size tells whether it goes to the tasks, so that rows need not move
    out = df.join(checkpointed(common, "common"), F.col(column) == F.col("_c"), "left")
    return out.withColumn(f"{column}_folded", F.coalesce("_c", F.lit(other))).drop("_c")


def training_filter(df: DataFrame, price: str, first: str, km: str, year: str, this_year: int, swing: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """(rows kept, one row of counts): price swings, then prices outside P1-P99, then odd km a year.

    The percentiles are those of the rows after the first step.
    """
    r = ratio(F.col(price), F.col(first))
    calm = df.where(F.col(price).isNotNull() & F.coalesce((r < swing) & (r > 1 / swing), F.lit(True)))
    low, high = (F.lit(x).cast("double") for x in quantiles(calm, price, [0.01, 0.99]))
    marked = calm.withColumn("_inside", F.col(price).between(low, high))
    yearly = F.col(km) / F.greatest(F.lit(this_year) - F.col(year), F.lit(1))
    marked = marked.withColumn("_used", F.coalesce(yearly.between(500, 100_000), F.lit(True)))
    counts = marked.agg(F.count("*").alias("calm"), F.count_if("_inside").alias("inside"), F.count_if(F.col("_inside") & F.col("_used")).alias("kept"))
    return marked.where("_inside AND _used").drop("_inside", "_used"), counts


def training_weights(df: DataFrame, price: str = "price_eur") -> DataFrame:
    """Adds ``target`` (what the car was worth) and ``weight``: loss weights of mean 1, times the trust in sold rows."""
    days = whole_days(F.col("deactivated_at"), F.col("first_seen_at"))
    times, trust = sold_tier(F.col("is_active"), F.col("deactivation_reason"), days)
    rows = df.withColumn("target", F.col(price) * times)
    # one row
    mean = rows.agg(F.avg(loss_weight(F.col("target"))).alias("_mean"))
    return rows.join(F.broadcast(mean), F.lit(True)).withColumn("weight", loss_weight(F.col("target")) / F.col("_mean") * trust).drop("_mean")


def top_ancestors(tree: DataFrame) -> DataFrame:
    """``id, top`` of a forest given as id and parent (null for the tops); nodes whose parent is unknown have no top.

    Pointer jumping: every round doubles the steps that a node has taken, so a tree of depth d takes
    log d rounds, each a join, checkpointed.
    """
    now = checkpointed(tree.select("id", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), F.col("id")).alias("top")))
    while not now.where("top is null and up is not null").isEmpty():
        above = now.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("top").alias("_top"))
        out = now.join(above, F.col("up") == F.col("_id"), "left")
        # a node with a top is done; others take their parent's top, or its parent
        out = out.select("id", F.when(F.col("top").isNull() & F.col("_top").isNull(), F.col("_up")).alias("up"), F.coalesce("top", "_top").alias("top"))
        now = checkpointed(out)
    return now.where("top is not null").select("id", "top")


def contributions_long(df: DataFrame, key: str, names: str, values: str, top: int = 5) -> DataFrame:
    """``key, rank, feature, contribution`` from arrays of names and values: the ``top`` largest by size, ties by name."""
    pairs = F.arrays_zip(F.col(names).alias("n"), F.col(values).alias("v"))
    ordered = F.sort_array(F.transform(pairs, lambda x: F.struct((-F.abs(x["v"])).alias("k"), x["n"].alias("feature"), x["v"].alias("contribution"))))
    return df.select(key, F.posexplode(F.slice(ordered, 1, top)).alias("rank", "_x")).select(key, "rank", "_x.feature", "_x.contribution")


def contributions_wide(long: DataFrame, key: str) -> DataFrame:
    """``key, features, contributions``: the long table back as arrays in order of rank."""
    rows = long.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", "feature", "contribution"))).alias("_x"))
    return rows.select(key, F.transform("_x", lambda x: x["feature"]).alias("features"), F.transform("_x", lambda x: x["contribution"]).alias("contributions"))


def waterfall(contributions: DataFrame, key: str, feature: str, value: str, base: str, top: int = 5) -> DataFrame:
    """Steps from the base price by falling contribution; EUR of each step on the log scale, rest as one.

    The steps of a key add up to expm1 of the full sum less expm1 of the base.
    """
    w = Window.partitionBy(key).orderBy(F.desc(F.abs(F.col(value))), feature)
    rows = contributions.withColumns({"_k": F.row_number().over(w), "_run": F.col(base) + F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    rows = rows.withColumn("_eur", F.expm1("_run") - F.expm1(F.col("_run") - F.col(value)))
    name = F.when(F.col("_k") <= top, F.col(feature)).otherwise("rest")
    step = F.least(F.col("_k"), F.lit(top + 1)).cast("long")
    return rows.groupBy(key, step.alias("step"), name.alias("feature")).agg(F.round(F.sum("_eur"), 6).alias("delta_eur"))


def row_waterfall(df: DataFrame, key: str, steps: str, base: str, n: int, top: int = 5) -> DataFrame:
    """``waterfall`` of rows that hold their ``n`` contributions as an array (feature, contribution): no row is moved."""
    given = F.array_sort(F.transform(steps, lambda x: F.struct((-F.abs(x["contribution"])).alias("o"), x["feature"].alias("feature"), x["contribution"].alias("v"))))
    rows = df.select(key, F.col(base).alias("_b"), given.alias("_s"))
    run = lambda i: F.col("_b") + sum((F.col("_s")[k]["v"] for k in range(1, i + 1)), F.col("_s")[0]["v"])
    eur = [F.expm1(run(i)) - F.expm1(run(i) - F.col("_s")[i]["v"]) for i in range(n)]
    out = [(F.lit(i + 1), F.col("_s")[i]["feature"], eur[i]) for i in range(min(top, n))]
    if n > top:
        out.append((F.lit(top + 1), F.lit("rest"), sum(eur[top + 1 :], eur[top])))
    told = F.array(*[F.struct(k.cast("long").alias("step"), name.alias("feature"), F.round(x, 6).alias("delta_eur")) for k, name, x in out])
    return rows.select(key, F.explode(told).alias("_x")).select(key, "_x.*")


def time_folds(df: DataFrame, order: list[str], folds: int) -> DataFrame:
    """Adds ``fold`` 0 to ``folds`` by time: each fold is tested on rows before it.

    Cut by the quantiles of the first order column, so no global sort is needed.
    """
    at = F.unix_micros(order[0])
    cuts = quantiles(df.select(at.alias("_t")), "_t", [i / (folds + 1) for i in range(1, folds + 1)])
    return df.withColumn("fold", sum((F.when(at >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0)).cast("int"))


def hazard_target(df: DataFrame, as_of: str, horizon: int = 30) -> DataFrame:
    """``label`` (1 sold within the horizon, 0 not) and ``labelled``; rows that are too young are censored."""
    from ..functions.scalars import at, days_between, sold

    life = days_between(F.col("deactivated_at"), F.col("first_seen_at"))
    age = days_between(at(as_of), F.col("first_seen_at"))
    label = F.when(sold() & (life <= horizon), 1).when(sold() & (life > horizon), 0).when(F.col("is_active") & (age > horizon), 0)
    return df.withColumn("label", label).withColumn("labelled", F.col("label").isNotNull())


def split_by_key(key: Column, share: float = 0.2) -> Column:
    return md5_share(key) < share


def scaled(column: str, df: DataFrame, flag_share: float = 0.05) -> DataFrame:
    """Adds ``scaled`` (0 to 1 between least and largest) and ``flagged`` (above the quantile)."""
    ends = df.agg(F.min(column).alias("_a"), F.max(column).alias("_b"))
    limit = F.lit(quantiles(df, column, [1 - flag_share])[0]).cast("double")
    # one row
    out = df.join(F.broadcast(ends), F.lit(True))
    value = F.round(F.coalesce(ratio(F.col(column) - F.col("_a"), F.col("_b") - F.col("_a")), F.lit(0.0)), 6)
    return out.withColumns({"scaled": value, "flagged": F.col(column) > limit}).drop("_a", "_b")


def median_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(median_of(value).alias("median"), F.count("*").alias("n"))
