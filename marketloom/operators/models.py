"""Fair-price, sale-hazard and anomaly models on Spark ML and DataFrames.

Spark trees know no quantile loss and no monotone constraints. Price bands come from a forest whose
leaves pool training prices (a quantile regression forest); ``calibration`` widens them, which restores
the coverage. Contributions are in ``explain``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp, md5_share, ratio
from .evaluation import fold_rare
from .ranks import quantiles
from .storage import checkpointed


def features(numeric: list[str], categorical: list[str], max_bins: int = 64) -> list:
    """Indexers and an assembler over columns without nulls; unseen categories are kept."""
    index = StringIndexer(inputCols=categorical, outputCols=[f"{c}_i" for c in categorical], handleInvalid="keep", stringOrderType="alphabetAsc") if categorical else None
    parts = VectorAssembler(inputCols=[*numeric, *[f"{c}_i" for c in categorical]], outputCol="features", handleInvalid="keep")
    return [*([index] if index else []), parts]


def prepared(df: DataFrame, numeric: list[str], categorical: list[str], most: int = 60) -> DataFrame:
    """Nulls filled (numbers by 0 with an indicator, text by ''), rare categories folded."""
    df = df.withColumns({f"{c}_missing": F.col(c).isNull().cast("double") for c in numeric} | {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numeric})
    for c in categorical:
        df = fold_rare(df.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit(""))), c).withColumn(c, F.col(f"{c}_folded")).drop(f"{c}_folded")
    return df


#: Fits that run at once: a boosted tree is a chain of short jobs, which leave most cores idle; each fit keeps its kinds in memory.
AT_ONCE = 4


def side_by_side(spark: SparkSession, jobs: list[Callable]) -> list:
    """What the functions return, in order; at most ``AT_ONCE`` of them run at the same time."""
    with ThreadPool(min(AT_ONCE, len(jobs))) as pool:
        return pool.map(lambda job: job(), [inheritable_thread_target(spark)(job) for job in jobs], 1)


#: Kinds of rows that a task of a fit reads at most.
KINDS = 250_000


def kinds(df: DataFrame, target: str, columns: list[str], weight: str | None = None, spread: bool = False) -> DataFrame:
    """A stored row for each distinct ``columns`` of the rows with a known target: ``_n``, their number or weight, and ``_y``, the mean of log1p of the target.

    To squared loss they are the same as the rows: what a split gains and what a leaf predicts depend on weights
    and means only. With ``spread`` a kind is two rows, a standard deviation below and above its mean, which have the
    squared errors of its rows as well. A fit then grows with the kinds of rows, not with their number.
    """
    rows = df.select(*columns, F.log1p(target).alias("_t"), (F.col(weight) if weight else F.lit(1.0)).alias("_w")).where("_t is not null and _w > 0")
    sums = [F.sum("_w").alias("_n"), (F.sum(F.col("_w") * F.col("_t")) / F.sum("_w")).alias("_y")]
    if spread:
        if weight:
            raise ValueError("the spread is of unweighted rows")
        found = rows.groupBy(*columns).agg(*sums, F.stddev_pop("_t").alias("_s"))
        ends = F.when(F.col("_s") > 0, F.array(F.col("_y") - F.col("_s"), F.col("_y") + F.col("_s"))).otherwise(F.array("_y"))
        found = found.select(*columns, (F.col("_n") / F.size(ends)).alias("_n"), F.explode(ends).alias("_y"))
    else:
        found = rows.groupBy(*columns).agg(*sums)
    stored = checkpointed(found, "kinds")
    parts = -(-stored.count() // KINDS)
    return stored.repartition(parts) if parts > df.sparkSession.sparkContext.defaultParallelism else stored


def fit_price(df: DataFrame, target: str, numeric: list[str], categorical: list[str], weight: str | None = None, seed: int = 7, trees: int = 20) -> PipelineModel:
    """A boosted model of log1p of the target; columns must come from ``prepared``. Rows without a target are left out."""
    model = GBTRegressor(labelCol="_y", weightCol="_n", maxIter=trees, maxDepth=5, maxBins=64, subsamplingRate=0.8, seed=seed)
    return Pipeline(stages=[*features(numeric, categorical), model]).fit(kinds(df, target, [*numeric, *categorical], weight))


def fold_of(key: Column, folds: int) -> Column:
    """A fold from 0 that the key's md5 decides."""
    return F.least(F.floor(md5_share(key) * folds), F.lit(folds - 1)).cast("int")


def out_of_fold(df: DataFrame, key: str, target: str, numeric: list[str], categorical: list[str], folds: int = 3) -> DataFrame:
    """``key, fold, predicted`` by models that did not see the row; folds are the key's md5."""
    rows = df.withColumn("fold", fold_of(F.col(key), folds))
    out = None
    for k in range(folds):
        model = fit_price(rows.where(F.col("fold") != k), target, numeric, categorical)
        part = model.transform(rows.where(F.col("fold") == k)).select(key, "fold", F.expm1("prediction").alias("predicted"))
        out = part if out is None else out.unionByName(part)
    return out


#: Values that a leaf keeps: all of a smaller leaf, ranks at equal distances of a larger one.
POINTS = 256


@dataclass
class Forest:
    """A fitted forest, the training targets of each of its leaves (tree, leaf, points) and the levels of its bands.

    A leaf's points weigh the same; together they stand for the leaf's training rows.
    """

    model: PipelineModel
    pools: DataFrame
    levels: tuple[float, float] = (0.1, 0.9)


#: Steps of the log target that tell the values of a large leaf apart: 0.01 % of a price.
STEP = 1e-4


def fit_forest(train: DataFrame, target: str, numeric: list[str], categorical: list[str], low: float = 0.1, high: float = 0.9, trees: int = 10, seed: int = 7, points: int = POINTS) -> Forest:
    """A forest of log1p of the target whose leaves keep their training targets.

    The forest is grown on ``kinds`` of rows: a tree draws kinds, and a leaf has at least ten rows' weight. A
    leaf of at most ``points`` rows keeps all their targets. A larger one keeps ``points`` values at the middles of
    equal shares, each the mean of the leaf's targets in the same ``STEP``.
    """
    met = kinds(train, target, [*numeric, *categorical])
    n = met.agg(F.sum("_n")).first()[0] or 0.0
    forest = RandomForestRegressor(labelCol="_y", weightCol="_n", leafCol="leaves", numTrees=trees, maxDepth=6, maxBins=64, minWeightFractionPerNode=min(0.49, 10 / max(n, 1.0)), seed=seed)
    model = Pipeline(stages=[*features(numeric, categorical), forest]).fit(met)
    rows = train.withColumn("_y", F.log1p(target)).where("_y is not null")
    met = checkpointed(model.transform(rows).select("_y", _leaves_of()), "leaves").select("_y", F.posexplode("_l").alias("tree", "leaf"))
    steps = checkpointed(met.groupBy("tree", "leaf", F.floor(F.col("_y") / STEP).alias("_s")).agg(F.count("*").alias("_c"), F.avg("_y").alias("_v")), "steps")
    own = Window.partitionBy("tree", "leaf")
    # at most trees * 2 ** depth rows
    small = steps.groupBy("tree", "leaf").agg(F.sum("_c").alias("n")).where(F.col("n") <= points).select("tree", "leaf")
    few = met.join(F.broadcast(small), ["tree", "leaf"], "left_semi").groupBy("tree", "leaf").agg(F.sort_array(F.collect_list("_y")).alias("points"))
    # a leaf has no more steps than the range of its targets
    many = steps.withColumns({"n": F.sum("_c").over(own), "_to": F.sum("_c").over(own.orderBy("_s").rowsBetween(Window.unboundedPreceding, 0))}).where(F.col("n") > points)
    upto = lambda c: F.floor(c * points / F.col("n") - 0.5)
    many = many.withColumn("_k", (upto(F.col("_to")) - upto(F.col("_to") - F.col("_c"))).cast("int")).where("_k > 0")
    many = many.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct("_s", "_v", "_k"))).alias("_x"))
    many = many.select("tree", "leaf", F.flatten(F.transform("_x", lambda x: F.array_repeat(x["_v"], x["_k"]))).alias("points"))
    return Forest(model, checkpointed(few.unionByName(many), "pools"), (low, high))


def _leaves_of() -> Column:
    return F.transform(vector_to_array("leaves"), lambda x: x.cast("int")).alias("_l")


def pooled_quantiles(pools: list[np.ndarray], levels: list[float]) -> np.ndarray:
    """Least values at which the pooled weight reaches each level; a pool's values share its equal part of the weight.

    With the leaves of a row as pools, each training row weighs the mean over trees of 1 / size of the
    leaf that it shares with the row.
    """
    values = np.concatenate(pools)
    weights = np.concatenate([np.full(len(p), 1 / len(p) / len(pools)) for p in pools])
    order = np.argsort(values, kind="stable")
    reached = np.searchsorted(np.cumsum(weights[order]), np.asarray(levels) - 1e-12)
    return values[order][np.minimum(reached, len(values) - 1)]


def with_bands(forest: Forest, rows: DataFrame) -> DataFrame:
    """Adds ``log_low, log_high``: quantiles of the training targets in all leaves of a row, pooled over trees.

    They are worked out once for all rows of the same leaves.
    """
    # at most trees * 2 ** depth rows of a bounded number of values
    pools = {(r["tree"], r["leaf"]): np.array(r["points"]) for r in forest.pools.collect()}
    levels = list(forest.levels)

    def bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                own = [pooled_quantiles([pools[x] for x in enumerate(leaves) if x in pools], levels) for leaves in np.stack(batch["_l"].to_numpy()).tolist()]
                yield pd.DataFrame({"_l": batch["_l"], "_low": [x[0] for x in own], "_high": [x[1] for x in own]})

    met = checkpointed(forest.model.transform(rows).select(*rows.columns, _leaves_of()), "leaves")
    own = met.select("_l").distinct()
    # few rows, each of some work
    own = own.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, "_l").mapInPandas(bands, "_l array<int>, _low double, _high double")
    found = checkpointed(own, "bands").withColumnRenamed("_l", "_own")
    return met.join(found, F.col("_l") == F.col("_own")).select(*rows.columns, F.col("_low").alias("log_low"), F.col("_high").alias("log_high"))


def forest_bands(forest: Forest, rows: DataFrame, key: str) -> DataFrame:
    """``key, log_low, log_high`` of ``with_bands``."""
    inputs = [c for s in forest.model.stages if s.hasParam("inputCols") for c in s.getInputCols() if c in rows.columns]
    return with_bands(forest, rows.select(key, *[c for c in dict.fromkeys(inputs) if c != key])).select(key, "log_low", "log_high")


def quantile_forest(train: DataFrame, test: DataFrame, key: str, target: str, numeric: list[str], categorical: list[str], low: float = 0.1, high: float = 0.9, trees: int = 10, seed: int = 7) -> DataFrame:
    """``key, low, high``: pooled quantiles of the training targets in the leaves that the row falls into, unwidened."""
    bands = forest_bands(fit_forest(train, target, numeric, categorical, low, high, trees, seed), test, key)
    return bands.select(key, F.expm1("log_low").alias("low"), F.expm1("log_high").alias("high"))


def permutation_importance(model: PipelineModel, df: DataFrame, target: str, groups: dict[str, list[str]], seed: int = 7, slice_rows: int = 50_000) -> DataFrame:
    """``name, importance``: growth of the mean absolute log error when a group's columns are shuffled.

    Values are shuffled by pairing two random orders within slices of about ``slice_rows`` rows, whose
    number grows with the table; no task sorts more than a slice.
    """
    error = lambda d: d.select(F.avg(F.abs(F.col("prediction") - F.log1p(target))).alias("e"))
    base = error(model.transform(df)).first()["e"]
    slices = max(1, -(-df.count() // slice_rows))
    rows = df.withColumn("_id", F.xxhash64(*df.columns)).withColumn("_s", F.pmod("_id", F.lit(slices)))
    found = []
    for name, columns in groups.items():
        w = lambda n: Window.partitionBy("_s").orderBy(F.xxhash64("_id", F.lit(n)))
        left = rows.drop(*columns).withColumn("_k", F.row_number().over(w(seed)))
        right = rows.select("_s", *columns, F.row_number().over(w(seed + 1)).alias("_k"))
        found.append((name, float(error(model.transform(left.join(right, ["_s", "_k"]))).first()["e"] - base)))
    return df.sparkSession.createDataFrame(found, "name string, importance double")


def fit_hazard(df: DataFrame, label: str, numeric: list[str], categorical: list[str], seed: int = 7) -> PipelineModel:
    """A boosted classifier of ``label``; the rarer class is weighted up by the classes' ratio."""
    n = df.groupBy(label).agg(F.count("*").alias("n")).collect()
    size = {int(r[label]): r["n"] for r in n}
    ratio = size.get(0, 1) / max(1, size.get(1, 1))
    model = GBTClassifier(labelCol=label, weightCol="_w", maxIter=10, maxDepth=4, maxBins=64, seed=seed)
    return Pipeline(stages=[*features(numeric, categorical), model]).fit(df.withColumn("_w", F.when(F.col(label) == 1, ratio).otherwise(1.0)))


def hazard_features(df: DataFrame, price: str = "price_eur") -> DataFrame:
    """Adds log_price, and residual_pct and band_pct of the row's predictions where these are over 0."""
    safe = F.when(F.col("predicted_price") > 0, F.col("predicted_price"))
    return df.withColumns(
        {
            "log_price": F.log1p(F.greatest(F.col(price), F.lit(0.0))),
            "residual_pct": (F.col(price) - safe) / safe * 100,
            "band_pct": (F.col("fair_price_high") - F.col("fair_price_low")) / safe * 100,
        }
    )


def hazard_quality(scored: DataFrame, label: str = "label", p: str = "prob_sold") -> DataFrame:
    """One row: n, base rate, log-loss and AUC (the share of pairs in order, ties half) of scored rows."""
    rows = scored.where(F.col(label).isNotNull() & F.col(p).isNotNull())
    q = clamp(F.col(p), 1e-9, 1 - 1e-9)
    # scores on a fine grid, so that pairs are counted from sums by score and not by sorting rows in one task
    grid = rows.groupBy(F.round(p, 6).alias("_p")).agg(F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg"))
    part = F.floor(F.col("_p") * 1000)
    w = Window.partitionBy("_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("_s", part).withColumn("_in", F.coalesce(F.sum("_neg").over(w), F.lit(0)))
    slices = grid.groupBy("_s").agg(F.sum("_neg").alias("_n"))
    # at most 1001 rows
    lower = slices.select(F.col("_s").alias("_k"), F.coalesce(F.sum("_n").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_lower"))
    pairs = grid.join(F.broadcast(lower), F.col("_s") == F.col("_k")).agg(F.sum(F.col("_pos") * (F.col("_in") + F.col("_lower") + F.col("_neg") / 2)).alias("_won"), F.sum("_pos").alias("_p"), F.sum("_neg").alias("_q"))
    loss = rows.agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("base_rate"), (-F.avg(F.when(F.col(label) == 1, F.log(q)).otherwise(F.log(1 - q)))).alias("log_loss"))
    # one row each
    return loss.join(F.broadcast(pairs), F.lit(True)).select("n", "base_rate", "log_loss", ratio(F.col("_won"), (F.col("_p") * F.col("_q")).cast("double")).alias("auc"))


def worst_axis(axes: dict[str, DataFrame], key: str) -> DataFrame:
    """``key``, a column for each axis, ``anomaly`` (the highest of them) and ``axis``, its name."""
    out = None
    for name, scores in axes.items():
        own = scores.select(F.col(key).alias(f"_{name}"), F.col("anomaly").alias(name))
        out = own.withColumnRenamed(f"_{name}", key) if out is None else out.join(own, F.col(key) == F.col(f"_{name}"), "left").drop(f"_{name}")
    return with_worst(out, list(axes))


def with_worst(df: DataFrame, axes: list[str]) -> DataFrame:
    """Adds ``anomaly``, the highest of the scores, and ``axis``, its name."""
    top = F.greatest(*axes) if len(axes) > 1 else F.col(axes[0])
    return df.withColumns({"anomaly": top, "axis": F.coalesce(*[F.when(F.col(name) == top, name) for name in axes])})


def hazard_scores(model: PipelineModel, df: DataFrame, key: str, price: str) -> DataFrame:
    """``key, prob_sold``; null where the price is."""
    p = vector_to_array("probability")[1]
    return model.transform(df).select(key, F.when(F.col(price).isNotNull(), p).alias("prob_sold"))


# Isolation forest

TREE = "tree int, node long, feature int, cut double, size long"


def isolation_forest(df: DataFrame, columns: list[str], trees: int = 50, sample: int = 256, seed: int = 7, key: str | None = None) -> DataFrame:
    """Trees grown on subsamples, one group for each tree; a group holds about 2 * ``sample`` rows.

    The k-th tree draws rows by the hash of their ``key`` and k, and uses the ``sample`` least draws, so
    sampling is one pass and rows of equal values are drawn apart. The key must be unique; without one
    the hash is of all columns. Nodes are numbered as in a heap (root 1, children 2n and 2n + 1).
    """
    n = max(1, df.count())
    share = min(1.0, 2.0 * sample / n)
    rows = df.select(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]).alias("x"), F.xxhash64(*([key] if key else df.columns)).alias("_h"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    draw = F.pmod(F.xxhash64("_h", "tree", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.withColumn("_draw", draw).where(F.col("_draw") < share)
    depth = int(np.ceil(np.log2(sample)))

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iat[0])
        rng = np.random.default_rng(seed + tree)
        x = np.stack(group.sort_values(["_draw", "_h"])["x"].to_numpy())[:sample]
        out, open_ = [], [(1, x, 0)]
        while open_:
            node, part, level = open_.pop()
            spread = np.flatnonzero(np.ptp(part, axis=0) > 0) if len(part) > 1 else []
            if level >= depth or not len(spread):
                out.append((tree, node, -1, 0.0, len(part)))
                continue
            f = int(rng.choice(spread))
            cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
            out.append((tree, node, f, cut, len(part)))
            left = part[:, f] < cut
            open_ += [(2 * node, part[left], level + 1), (2 * node + 1, part[~left], level + 1)]
        return pd.DataFrame(out, columns=["tree", "node", "feature", "cut", "size"])

    return rows.groupBy("tree").applyInPandas(grow, TREE)


def _expected(n: np.ndarray | float) -> np.ndarray | float:
    n = np.maximum(np.asarray(n, float), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


def _scorer(forest: DataFrame, sample: int) -> Callable[[np.ndarray], np.ndarray]:
    """Scores of rows of numbers in (0, 1). The forest has at most trees * 2 * sample rows."""
    nodes: dict[int, dict[int, tuple[int, float, int]]] = {}
    for r in forest.collect():
        nodes.setdefault(r["tree"], {})[r["node"]] = (r["feature"], r["cut"], r["size"])
    norm = float(_expected(min(sample, max((t[1][2] for t in nodes.values()), default=1)))) or 1.0

    def score(x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for tree in nodes.values():
            open_ = [(1, np.arange(len(x)), 0)]
            while open_:
                node, at, level = open_.pop()
                f, cut, size = tree[node]
                if f < 0:
                    total[at] += level + _expected(size)
                    continue
                left = x[at, f] < cut
                open_ += [(n, a, level + 1) for n, a in ((2 * node, at[left]), (2 * node + 1, at[~left])) if len(a)]
        return 2 ** (-total / max(1, len(nodes)) / norm)

    return score


def anomaly_scores(df: DataFrame, forest: DataFrame, key: str, columns: list[str], sample: int = 256) -> DataFrame:
    """``key, anomaly`` in (0, 1). The forest goes to the tasks."""
    return axis_scores(df, {"anomaly": (forest, columns)}, key, sample, worst=False)


def axis_scores(df: DataFrame, axes: dict[str, tuple[DataFrame, list[str]]], key: str, sample: int = 256, worst: bool = True) -> DataFrame:
    """``key`` and a score for each axis (its forest and columns) in one pass; with ``worst`` the highest of them and its axis."""
    scorers = {name: (_scorer(forest, sample), columns) for name, (forest, columns) in axes.items()}
    used = list(dict.fromkeys(c for _, columns in axes.values() for c in columns))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], **{name: of(np.nan_to_num(batch[columns].to_numpy(float))) for name, (of, columns) in scorers.items()}})

    kind = dict(df.dtypes)[key]
    out = df.select(key, *[F.col(c).cast("double").alias(c) for c in used]).mapInPandas(score, f"{key} {kind}, " + ", ".join(f"{name} double" for name in axes))
    return with_worst(out, list(axes)) if worst else out
