"""Additive per-URL attribution of the boosted trees (path-dependent Shapley values).

The model is read back as a node table, which is as large as the model itself. A leaf travels to the tasks as the
bounds and cover shares of the features on its path, so what is sent grows with nodes times depth. The Shapley
share of a feature depends only on which path features send a URL towards the leaf; ``mapInPandas`` computes it once
for each such pattern that occurs in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from lurewatch.fixed.words import FEATURES
from lurewatch.workspace import shared_path


def node_table(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """tree, node, prediction, cover, children, split feature and threshold of a fitted tree ensemble."""
    path = shared_path(spark, "trees")
    learner = model.stages[-1]
    learner.write().overwrite().save(path)
    n = F.col("nodeData")
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("node"), n["prediction"].alias("prediction"),
        n["rawCount"].cast("double").alias("cover"), n["leftChild"].alias("left"), n["rightChild"].alias("right"),
        n["split"]["featureIndex"].alias("feature"),
        F.get(n["split"]["leftCategoriesOrThreshold"], 0).alias("threshold"))


def _shares(z: np.ndarray, value: float, agree: np.ndarray) -> np.ndarray:
    """Shapley shares of one leaf, a row of ``agree`` telling which path features send a URL towards the leaf.

    ``z`` is each feature's share of cover. The other features' product is a polynomial in the number of
    agreeing features, whose coefficients are weighted by the orderings they stand for.
    """
    n, m = agree.shape
    weight = np.array([factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)])
    out = np.empty((n, m))
    for i in range(m):
        poly = np.zeros((n, m))
        poly[:, 0] = 1.0
        for j in range(m):
            if j != i:
                shifted = np.hstack([np.zeros((n, 1)), poly[:, :-1]])
                poly = poly * z[j] + shifted * agree[:, [j]]
        out[:, i] = value * (agree[:, i] - z[i]) * (poly @ weight)
    return out


def _leaves(nodes: pd.DataFrame, weights: list[float]) -> tuple[list, float]:
    """(path features, lower and upper bounds, shares of cover, value) per leaf, and the expected margin."""
    found, base = [], 0.0
    for tree, part in nodes.groupby("tree"):
        node = part.set_index("node").to_dict("index")
        root_cover = node[0]["cover"]
        stack = [(0, {})]  # feature -> [lower, upper, share of cover]
        while stack:
            at, path = stack.pop()
            n = node[at]
            if n["left"] < 0:
                value = n["prediction"] * weights[int(tree)]
                base += value * n["cover"] / root_cover
                if path:
                    feats = sorted(path)
                    lo, hi, z = (np.array([path[f][k] for f in feats]) for k in range(3))
                    found.append((np.array(feats), lo, hi, z, value))
                continue
            f, t = int(n["feature"]), n["threshold"]
            lo, hi, z = path.get(f, (-np.inf, np.inf, 1.0))
            for child, bounds in ((n["left"], (lo, min(hi, t))), (n["right"], (max(lo, t), hi))):
                part_cover = node[child]["cover"] / n["cover"]
                stack.append((child, {**path, f: (*bounds, z * part_cover)}))
    return found, base


def attribution(df: DataFrame, model: PipelineModel, key: str = "url_id") -> DataFrame:
    """Per URL: base value, margin of the model, one contribution per feature and, as ``value_...``, its value.

    base + sum of contributions = margin (the raw score before the logistic link).
    """
    nodes = node_table(model, df.sparkSession).toPandas()  # no larger than the fitted model on the driver
    leaves, base = _leaves(nodes, list(model.stages[-1].treeWeights))
    shipped = df.sparkSession.sparkContext.broadcast(leaves)
    data_type = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[FEATURES].to_numpy(dtype=float)
            phi = np.zeros((len(x), len(FEATURES)))
            for feats, lo, hi, z, value in shipped.value:
                v = x[:, feats]
                agree = (v > lo) & (v <= hi)
                _, first, pattern = np.unique(agree @ (1 << np.arange(len(feats))), return_index=True, return_inverse=True)
                phi[:, feats] += _shares(z, value, agree[first].astype(float))[pattern]
            out = pd.DataFrame(phi, columns=FEATURES)
            out.insert(0, key, pdf[key].to_numpy())
            for n, f in enumerate(FEATURES):
                out[f"value_{f}"] = x[:, n]
            out["base_value"] = base
            out["margin"] = base + phi.sum(axis=1)
            yield out

    schema = f"{key} {data_type}, " + ", ".join(
        f"{c} double" for c in [*FEATURES, *(f"value_{f}" for f in FEATURES)]) + ", base_value double, margin double"
    return df.select(key, *FEATURES).mapInPandas(run, schema)


def attribution_top(df: DataFrame, model: PipelineModel, top: int = 12, key: str = "url_id") -> DataFrame:
    """The ``top`` contributions per URL by absolute size, each with the feature's value. Ranking happens inside each row's array, so no
    window and no shuffle are needed."""
    phi = attribution(df, model, key)
    items = F.array(*[F.struct(F.abs(F.col(f)).alias("size"), F.lit(f).alias("feature"), F.col(f).alias("contribution"),
                               F.col(f"value_{f}").alias("value"))
                      for f in FEATURES])
    ranked = F.slice(F.sort_array(items, asc=False), 1, top)
    return phi.select(key, "base_value", "margin", F.posexplode(ranked).alias("_p", "_i")).select(
        key, "base_value", "margin", (F.col("_p") + 1).alias("rank"), "_i.feature", "_i.value", "_i.contribution")
