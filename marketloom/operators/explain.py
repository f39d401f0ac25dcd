"""Contributions of features to predictions of boosted trees and forests.

A row's prediction is the mean of the root and the steps along its path: at each node the step from
the node's mean to its child's is put down to the feature that the node asks about. Steps of all trees
add up to the prediction exactly. ``occlusion`` asks instead what changes without a feature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranks import grouped_quantiles, quantiles
from .storage import checkpointed, shared_path


def inputs_of(model: PipelineModel) -> list[str]:
    """Names of the features in order of the model's vector; indexed categories by their own names."""
    names = next(s for s in model.stages if isinstance(s, VectorAssembler)).getInputCols()
    indexed = {out: name for s in model.stages if s.hasParam("outputCols") and s.isSet("outputCols") for name, out in zip(s.getInputCols(), s.getOutputCols(), strict=True)}
    return [indexed.get(n, n) for n in names]


def node_table(model: PipelineModel) -> DataFrame:
    """The nodes of the model's trees: tree, weight, node, mean, left, right, feature, cut, categories.

    ``feature`` is null in leaves; ``cut`` is the largest value that goes left, ``categories`` (null
    for numbers) marks those that go left, by index.
    """
    spark = SparkSession.active()
    path = shared_path(spark, "trees")
    model.stages[-1].save(path)
    # boosted trees add up by their weights, trees of a forest are averaged
    each = 1 / model.stages[-1].getNumTrees if isinstance(model.stages[-1], RandomForestRegressionModel) else 1.0
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("_t", "_m", "_w").select("_t", (F.col("_w") * each).alias("weight"))
    n, split = F.col("nodeData"), F.col("nodeData.split")
    leaf = n["leftChild"] < 0
    cut = split["leftCategoriesOrThreshold"]
    named = split["numCategories"] > 0
    marks = F.transform(F.sequence(F.lit(0), F.greatest(split["numCategories"], F.lit(1)) - 1), lambda k: F.array_contains(cut, k.cast("double")))
    # one row for each tree
    rows = spark.read.parquet(f"{path}/data").join(F.broadcast(weights), F.col("treeID") == F.col("_t"))
    rows = rows.select(
        F.col("treeID").alias("tree"), "weight", n["id"].alias("node"), n["prediction"].alias("mean"), n["leftChild"].alias("left"), n["rightChild"].alias("right"),
        F.when(~leaf, split["featureIndex"]).alias("feature"), F.when(~leaf & ~named, cut[0]).alias("cut"), F.when(~leaf & named, marks).alias("categories"),
    )
    return checkpointed(rows, "nodes")


class Paths:
    """Trees as flat arrays; ``steps(x)`` adds up the steps of each row of features by feature."""

    def __init__(self, nodes: pd.DataFrame, n_features: int):
        self.n_features, self.trees, self.base = n_features, [], 0.0
        for _, t in nodes.sort_values(["tree", "node"]).groupby("tree"):
            if t["node"].tolist() != list(range(len(t))):
                raise ValueError("nodes of a tree must be numbered from 0")
            widest = max((len(c) for c in t["categories"] if c is not None), default=1)
            marks = np.zeros((len(t), widest), bool)
            for k, c in enumerate(t["categories"]):
                if c is not None:
                    marks[k, : len(c)] = c
            feature = t["feature"].fillna(-1).to_numpy(int)
            named = np.array([c is not None for c in t["categories"]])
            weight, mean = float(t["weight"].iat[0]), t["mean"].to_numpy(float)
            self.trees.append((weight, mean, feature, t["cut"].to_numpy(float), named, marks, t["left"].to_numpy(int), t["right"].to_numpy(int)))
            self.base += weight * float(mean[0])

    def steps(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.n_features))
        for weight, mean, feature, cut, named, marks, left, right in self.trees:
            rows, at = np.arange(len(x)), np.zeros(len(x), int)
            while len(rows):
                inner = feature[at] >= 0
                rows, at = rows[inner], at[inner]
                f = feature[at]
                v = x[rows, f]
                k = np.minimum(np.nan_to_num(v), marks.shape[1] - 1).astype(int)
                goes = np.where(named[at], marks[at, k], v <= cut[at])
                down = np.where(goes, left[at], right[at])
                out[rows, f] += weight * (mean[down] - mean[at])
                at = down
        return out


def path_steps(model: PipelineModel, df: DataFrame, key: str) -> tuple[DataFrame, int]:
    """``key, base, prediction, steps`` of each row, and how many steps: base and steps (feature, contribution) add up to the prediction."""
    names = inputs_of(model)
    # at most trees * 2 ** (depth + 1) rows
    paths = Paths(node_table(model).toPandas(), len(names))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({key: batch[key], "prediction": batch["prediction"], "c": list(paths.steps(np.stack(batch["x"].to_numpy())))})

    rows = model.transform(df).select(key, "prediction", vector_to_array("features").alias("x")).mapInPandas(walk, f"{key} {dict(df.dtypes)[key]}, prediction double, c array<double>")
    named = F.array(*[F.struct(F.lit(n).alias("feature"), F.col("c")[k].alias("contribution")) for k, n in enumerate(names)])
    return rows.select(key, F.lit(paths.base).alias("base"), "prediction", named.alias("steps")), len(names)


def path_contributions(model: PipelineModel, df: DataFrame, key: str) -> DataFrame:
    """``key, base, feature, contribution`` on the scale of the model's target; base and contributions of a key add up to its prediction."""
    return path_steps(model, df, key)[0].select(key, "base", F.explode("steps").alias("_f")).select(key, "base", "_f.*")


def occlusion(model: PipelineModel, df: DataFrame, key: str, numeric: list[str], segment: list[str] | None = None) -> DataFrame:
    """``key, feature, contribution``: prediction less the one at the feature's median, of all rows or of the row's segment."""
    if segment:
        # a null is a segment's own value
        keys = [f"_s_{k}" for k in segment]
        rows = df.withColumns({f"_s_{k}": F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in segment})
        sides = {c: grouped_quantiles(rows, c, keys, [0.5]).select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("quantiles")[0].alias("_median")) for c in numeric}
    else:
        rows, medians = df, {c: quantiles(df, c, [0.5])[0] for c in numeric}
    base = model.transform(df).select(F.col(key).alias("_b"), F.col("prediction").alias("_full"))
    out = None
    for c in numeric:
        if segment:
            on = F.lit(True)
            for k in keys:
                on = on & (F.col(k) == F.col(f"{k}_"))
            changed = rows.join(sides[c], on, "left").withColumn(c, F.coalesce("_median", c))
        else:
            changed = rows.withColumn(c, F.lit(float(medians[c])))
        changed = model.transform(changed).select(key, F.col("prediction").alias("_without"))
        part = changed.join(base, F.col(key) == F.col("_b")).select(key, F.lit(c).alias("feature"), (F.col("_full") - F.col("_without")).alias("contribution"))
        out = part if out is None else out.unionByName(part)
    return out
