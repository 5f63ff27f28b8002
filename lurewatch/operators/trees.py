"""Histogram learners of tree ensembles, whose result is a model of ``spark.ml``.

``spark.ml`` passes over all rows in a job per tree level, 2,400 jobs for 300 boosted trees of depth 8. Here rows are cut into bins once,
and rows of equal bins and label become one row with a count, which a learner of such bins cannot tell apart. What is left goes to the
tasks in a byte per value: a task grows whole trees of the forest, another one the chain of boosted trees. Trees, depths, bins,
bootstrap and feature subsets are those of ``spark.ml``. Rows are sorted by their bins, so that the model depends neither on
the parts of the table nor on the number of cores. ``binned`` says when a table is not one for this module.

``both_scores`` applies two fitted ensembles to a batch of rows at a time: all rows go down all trees level by level.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lurewatch.fixed.words import FEATURES
from lurewatch.workspace import materialize, release, remove, shared_path

#: Distinct rows up to which one task at a time can hold them, in about 150 bytes each, and grow boosted trees sooner than a cluster.
MOST_ROWS = 2_000_000
#: Gains below this share of a node's sum of squares are rounding.
ROUNDING = 1e-12
#: Nodes whose histograms are looked at together.
NODES_AT_ONCE = 4_096
#: Rows that go down the trees together, few enough for the cache, and levels after which rows that have arrived step aside.
ROWS_AT_ONCE, LEVELS_AT_ONCE = 256, 4

NODE_SCHEMA = ("treeID int, nodeData struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,"
               "leftChild:int,rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>")


@dataclass(frozen=True)
class Binned:
    """Distinct rows by their bins: ``codes`` (rows x features), ``labels`` 0 or 1, ``counts``; ``cuts``: the upper borders of the bins."""
    codes: np.ndarray
    labels: np.ndarray
    counts: np.ndarray
    cuts: list[np.ndarray]
    max_bins: int


def bin_cuts(train: DataFrame, max_bins: int) -> list[np.ndarray]:
    """Borders per feature, between values: a bin per value, or bins of about equal size where there are more values than bins."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("v")) for i, c in enumerate(FEATURES)]))
    values = train.select(pairs.alias("_p")).select("_p.*").where("v IS NOT NULL AND NOT isnan(v)").groupBy("f", "v").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy("f")
    middle = F.sum("n").over(every.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n") / 2
    place = F.when(F.count(F.lit(1)).over(every) <= max_bins, F.row_number().over(every.orderBy("v"))).otherwise(
        F.floor(middle * max_bins / F.sum("n").over(every)))
    bins = values.select("f", "v", place.alias("bin")).groupBy("f", "bin").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    found: list[list] = [[] for _ in FEATURES]
    for r in sorted(bins.collect(), key=lambda r: (r.f, r.bin)):  # at most max_bins rows a feature
        found[r.f].append(r)

    def border(a, b) -> float:
        t = a.hi + (b.lo - a.hi) / 2
        return t if a.hi <= t < b.lo else a.hi
    return [np.array([border(a, b) for a, b in zip(rows, rows[1:])]) for rows in found]


def _encoded(train: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """(code, n): a byte per feature and one for the label, with the rows that have them; an empty code counts rows that have none."""
    width = len(FEATURES) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *values, label = (c.to_numpy(zero_copy_only=False) for c in batch.columns)  # a null is not a number
            good = (label == 0) | (label == 1)
            code = np.empty((batch.num_rows, width), np.uint8)
            for i, v in enumerate(values):
                good &= ~np.isnan(v)
                code[:, i] = np.searchsorted(cuts[i], v)
            code[:, -1] = 1 + (label == 1)  # never zero: numpy's strings end before zeros
            found, n = np.unique(code[good].view(f"S{width}").ravel(), return_counts=True)
            out = [*found.tolist(), b""], [*n.tolist(), int((~good).sum())]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64())], names=["code", "n"])

    rows = train.select(*[F.col(c).cast("double") for c in [*FEATURES, "label"]])
    return rows.mapInArrow(run, "code binary, n long").where("n > 0").groupBy("code").agg(F.sum("n").alias("n"))


def binned(train: DataFrame, max_bins: int = 128, most_rows: int | None = None) -> Binned | None:
    """The distinct rows, or None where ``spark.ml`` has to learn: too many of them, missing values or other labels than 0 and 1."""
    if not 2 <= max_bins <= 256:
        return None
    cuts = bin_cuts(train, max_bins)
    stored = materialize(_encoded(train, cuts), "binned")
    try:
        if not 0 < stored.count() <= (MOST_ROWS if most_rows is None else most_rows) or not stored.where("length(code) = 0").isEmpty():
            return None
        table = stored.toArrow()  # at most MOST_ROWS rows of some 40 bytes
    finally:
        release(stored)
    width = len(FEATURES) + 1
    keys = np.frombuffer(b"".join(table.column("code").to_pylist()), f"S{width}")
    order = np.argsort(keys)
    codes = keys[order].view(np.uint8).reshape(-1, width)
    labels = (codes[:, -1] - 1).astype(np.int64)
    if len(set(labels.tolist())) < 2:
        return None
    return Binned(np.ascontiguousarray(codes[:, :-1]), labels, table.column("n").to_numpy()[order].astype(float), cuts, max_bins)


class _Nodes:
    """The nodes of a tree, level by level; of two children the right one follows the left."""

    def __init__(self, stats: np.ndarray, raw: np.ndarray):
        self.stats, self.raw, self.levels = [stats], [raw], [0]
        self.feature, self.cut, self.left = (np.full(1, -1) for _ in range(3))

    def split(self, at: np.ndarray, feature: np.ndarray, cut: np.ndarray, stats: np.ndarray, raw: np.ndarray) -> int:
        """Give the nodes ``at`` two children each; the number of the first child."""
        begin = len(self.feature)
        self.feature[at], self.cut[at], self.left[at] = feature, cut, begin + 2 * np.arange(len(at))
        self.feature, self.cut, self.left = (np.concatenate([x, np.full(2 * len(at), -1)]) for x in (self.feature, self.cut, self.left))
        self.stats.append(stats)
        self.raw.append(raw)
        self.levels.append(begin)
        return begin

    def table(self, tree: int, cuts: list[np.ndarray], gini: bool) -> pa.RecordBatch:
        """As ``spark.ml`` stores a tree; two leaves of one prediction are one, as there."""
        stats, raw, left = np.concatenate(self.stats), np.concatenate(self.raw), self.left
        if gini:
            total = stats.sum(axis=1)
            impurity, says = 1 - (stats ** 2).sum(axis=1) / total ** 2, (stats[:, 1] > stats[:, 0]).astype(float)
        else:
            total = stats[:, 0]
            says = stats[:, 1] / total
            impurity = np.maximum(stats[:, 2] / total - says ** 2, 0)
        ends = [*self.levels[1:], len(left)]
        for begin, end in reversed(list(zip(self.levels, ends))):
            at = begin + np.flatnonzero(left[begin:end] >= 0)
            a = left[at]
            left[at[(left[a] < 0) & (left[a + 1] < 0) & (says[a] == says[a + 1])]] = -1
        there = np.zeros(len(left), bool)
        there[0] = True
        for begin, end in zip(self.levels, ends):
            a = left[begin + np.flatnonzero(there[begin:end] & (left[begin:end] >= 0))]
            there[a] = there[a + 1] = True
        number, inner = np.cumsum(there) - 1, left >= 0
        a = np.where(inner, left, 0)
        after = (total[a] * impurity[a] + total[(a + 1) * inner] * impurity[(a + 1) * inner]) / total
        gain = np.where(inner, np.maximum(impurity - after, 0), -1.0)
        limit = np.array([cuts[f][c] if f >= 0 and i else 0.0 for f, c, i in zip(self.feature, self.cut, inner)])

        def lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values, pa.float64()))

        own = inner[there]
        child = np.where(own, number[np.where(inner, left, 0)][there], -1)
        split = pa.StructArray.from_arrays(
            [pa.array(np.where(own, self.feature[there], -1), pa.int32()), lists(limit[there][own], own.astype(int)),
             pa.array(np.full(len(own), -1), pa.int32())], names=["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
        node = pa.StructArray.from_arrays(
            [pa.array(np.arange(len(own)), pa.int32()), pa.array(says[there]), pa.array(impurity[there]),
             lists(stats[there].ravel(), np.full(len(own), stats.shape[1])), pa.array(raw[there].astype(np.int64)), pa.array(gain[there]),
             pa.array(child, pa.int32()), pa.array(np.where(own, child + 1, -1), pa.int32()), split],
            names=["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(own), tree), pa.int32()), node], names=["treeID", "nodeData"])


def _sums(at: np.ndarray, n: int, *values: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(at, v, n) for v in values], axis=1)


def regression_tree(columns: np.ndarray, sizes: np.ndarray, w: np.ndarray, r: np.ndarray, depth: int) -> tuple[_Nodes, np.ndarray]:
    """A tree of least squares for ``r`` with row counts ``w``, and each row's mean; ``columns`` is features x rows, ``sizes`` their bins.

    Only the smaller of two children is counted, the other is what its parent has besides.
    """
    rows, wr = len(w), w * r
    wrr = wr * r
    begins = np.concatenate([[0], np.cumsum(sizes)])
    feature_of, start_of = np.repeat(np.arange(len(sizes)), sizes), np.repeat(begins[:-1], sizes)
    flat = columns.ravel()

    def histogram(at: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
        out, wa, ra = np.empty((2, n, begins[-1])), w[at], wr[at]
        for f, size in enumerate(sizes):
            key = columns[f][at] + slot * size
            for k, v in enumerate((wa, ra)):
                out[k, :, begins[f]:begins[f + 1]] = np.bincount(key, v, n * size).reshape(n, size)
        return out

    stats = _sums(np.zeros(rows, np.int64), 1, w, wr, wrr)
    nodes, node_of = _Nodes(stats, stats[:, 0]), np.zeros(rows, np.int64)
    at, slot, active = np.arange(rows), np.zeros(rows, np.int64), np.zeros(1, np.int64)
    hist = histogram(at, slot, 1)
    for level in range(depth):
        sums = np.zeros((2, len(active), begins[-1] + 1))
        np.cumsum(hist, axis=2, out=sums[:, :, 1:])
        n, s = sums[:, :, 1:] - sums[:, :, start_of]
        rest_n, rest_s = stats[:, :1] - n, stats[:, 1:2] - s
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where((n > 0.5) & (rest_n > 0.5), s * s / n + rest_s * rest_s / rest_n, -np.inf)
        best = score.argmax(axis=1)
        gain = score[np.arange(len(best)), best] - stats[:, 1] ** 2 / stats[:, 0]
        split = gain > ROUNDING * stats[:, 2]
        if not split.any():
            break
        feature, cut = feature_of[best], best - start_of[best]
        keep = split[slot]
        at, slot = at[keep], slot[keep]
        child = 2 * (np.cumsum(split) - 1)[slot] + (flat[feature[slot] * rows + at] > cut[slot])
        pairs = int(split.sum())
        stats = _sums(child, 2 * pairs, w[at], wr[at], wrr[at])
        begin = nodes.split(active[split], feature[split], cut[split], stats, stats[:, 0])
        node_of[at] = begin + child
        if level + 1 == depth:
            break
        size = np.bincount(child, minlength=2 * pairs).reshape(-1, 2)
        small = 2 * np.arange(pairs) + (size[:, 1] < size[:, 0])
        few = small[child >> 1] == child
        part = histogram(at[few], child[few] >> 1, pairs)
        whole, hist = hist[:, split], np.empty((2, 2 * pairs, begins[-1]))
        hist[:, small], hist[:, small ^ 1] = part, whole - part
        alive = stats[:, 2] - stats[:, 1] ** 2 / stats[:, 0] > ROUNDING * stats[:, 2]
        hist, stats, active = hist[:, alive], stats[alive], begin + np.flatnonzero(alive)
        if not len(active):
            break
        keep = alive[child]
        at, slot = at[keep], (np.cumsum(alive) - 1)[child[keep]]
    every = np.concatenate(nodes.stats)
    return nodes, (every[:, 1] / every[:, 0])[node_of]


def boost(data: Binned, trees: int, depth: int, step: float) -> Iterator[pa.RecordBatch]:
    """The node tables of the boosted trees, for log loss on labels -1 and 1."""
    columns, sizes = np.ascontiguousarray(data.codes.T), np.array([len(c) + 1 for c in data.cuts])
    sign, margin = 2.0 * data.labels - 1, np.zeros(len(data.labels))
    for tree in range(trees):
        r = 4 * sign / (1 + np.exp(np.minimum(2 * sign * margin, 700))) if tree else sign
        nodes, says = regression_tree(columns, sizes, data.counts, r, depth)
        margin += says * (step if tree else 1.0)
        yield nodes.table(tree, data.cuts, False)


def forest_tree(data: Binned, weights: np.ndarray, depth: int, subset: int, rng: np.random.Generator) -> _Nodes:
    """A tree of least Gini impurity on a bootstrap of the rows; each node looks at ``subset`` features of its own."""
    raw = rng.poisson(data.counts)
    here = np.flatnonzero(raw)
    width, bins = data.codes.shape[1], max(len(c) + 1 for c in data.cuts)
    flat, y, raw = data.codes[here].ravel(), data.labels[here], raw[here].astype(float)
    w, least = raw * weights[y], weights.min() / 2
    at, slot, active = np.arange(len(here)), np.zeros(len(here), np.int64), np.zeros(1, np.int64)

    def both(child: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        key = 2 * child + y[at]
        return np.bincount(key, w[at], 2 * n).reshape(n, 2), np.bincount(key, raw[at], 2 * n).reshape(n, 2)

    def best_cuts(at: np.ndarray, slot: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, ...]:
        n = len(stats)
        pick = np.argsort(rng.random((n, width)), axis=1)[:, :subset]
        top, feature, cut = np.full(n, -np.inf), np.full(n, -1), np.full(n, -1)
        place, key0, wa = at * width, (2 * slot + y[at]) * bins, w[at]
        for k in range(subset):
            f = pick[:, k]
            key = key0 + flat[place + f[slot]]
            low = np.bincount(key, wa, 2 * n * bins).reshape(n, 2, bins).cumsum(axis=2)
            high = stats[:, :, None] - low
            ln, hn = low.sum(axis=1), high.sum(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.where((ln > least) & (hn > least), (low ** 2).sum(axis=1) / ln + (high ** 2).sum(axis=1) / hn, -np.inf)
            b = score.argmax(axis=1)
            score = score[np.arange(n), b]
            better = score > top
            top[better], feature[better], cut[better] = score[better], f[better], b[better]
        return top, feature, cut

    stats, counts = both(slot, at, 1)
    nodes = _Nodes(stats, counts.sum(axis=1))
    if not counts.all():
        return nodes
    for _ in range(depth):
        groups = []
        for begin in range(0, len(active), NODES_AT_ONCE):
            own = slice(None) if len(active) <= NODES_AT_ONCE else (slot >= begin) & (slot < begin + NODES_AT_ONCE)
            groups.append(best_cuts(at[own], slot[own] - begin, stats[begin:begin + NODES_AT_ONCE]))
        top, feature, cut = (np.concatenate(x) for x in zip(*groups))
        total = stats.sum(axis=1)
        split = top - (stats ** 2).sum(axis=1) / total > ROUNDING * total
        if not split.any():
            break
        keep = split[slot]
        at, slot = at[keep], slot[keep]
        child = 2 * (np.cumsum(split) - 1)[slot] + (flat[at * width + feature[slot]] > cut[slot])
        stats, counts = both(child, at, 2 * int(split.sum()))
        begin = nodes.split(active[split], feature[split], cut[split], stats, counts.sum(axis=1))
        alive = counts.all(axis=1)
        active, stats = begin + np.flatnonzero(alive), stats[alive]
        if not len(active):
            break
        keep = alive[child]
        at, slot = at[keep], (np.cumsum(alive) - 1)[child[keep]]
    return nodes


def _metadata(spark: SparkSession, learner: Estimator, kind: str, **more) -> str:
    value = lambda p, d: {x.name: d[x] for x in p if x in d}
    return json.dumps({"class": f"org.apache.spark.ml.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": learner.uid,
                       "paramMap": value(learner.params, learner._paramMap), "defaultParamMap": value(learner.params, learner._defaultParamMap), **more})


def _load(spark: SparkSession, nodes: DataFrame, learner: Estimator, tree: Estimator, weights: list[float]):
    """The model of ``spark.ml`` with these nodes, by way of its own stored form in the shared folder."""
    boosted, path = isinstance(learner, GBTClassifier), shared_path(spark, "grown-trees")
    own, inner = (("classification.GBTClassificationModel", "regression.DecisionTreeRegressionModel") if boosted else
                  ("classification.RandomForestClassificationModel", "classification.DecisionTreeClassificationModel"))
    more = {"numFeatures": len(FEATURES), "numTrees": len(weights), **({} if boosted else {"numClasses": 2})}
    nodes.write.parquet(f"{path}/data")
    each = _metadata(spark, tree, inner, **({} if boosted else {"numClasses": 2}), numFeatures=len(FEATURES))
    spark.createDataFrame([(i, each, w) for i, w in enumerate(weights)], "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame([(_metadata(spark, learner, own, **more),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    try:
        return (GBTClassificationModel if boosted else RandomForestClassificationModel).load(path)
    finally:
        remove(spark, path)


def boosted_model(spark: SparkSession, data: Binned, learner: GBTClassifier) -> GBTClassificationModel:
    """The boosted trees that ``learner`` describes, one after the other in one task."""
    trees, depth, step = learner.getMaxIter(), learner.getMaxDepth(), learner.getStepSize()
    shipped = spark.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from boost(shipped.value, trees, depth, step)

    tree = DecisionTreeRegressor(maxBins=data.max_bins, maxDepth=depth, seed=learner.getSeed())
    model = _load(spark, spark.range(0, 1, 1, 1).mapInArrow(run, NODE_SCHEMA), learner, tree, [1.0] + [step] * (trees - 1))
    shipped.destroy()
    return model


def subset_size(strategy: str) -> int | None:
    """Features that a node of the forest looks at, or None for a strategy that is not known here."""
    n = len(FEATURES)
    if strategy in ("sqrt", "log2", "all"):
        return {"sqrt": math.ceil(math.sqrt(n)), "log2": max(1, math.ceil(math.log2(n))), "all": n}[strategy]
    return math.ceil(float(strategy) * n) if strategy.startswith("0.") and strategy[2:].isdigit() and float(strategy) else None


def forest_model(spark: SparkSession, data: Binned, learner: RandomForestClassifier) -> RandomForestClassificationModel:
    """The forest that ``learner`` describes, trees dealt over the tasks; a class weighs n / (2 n_c)."""
    trees, depth, seed = learner.getNumTrees(), learner.getMaxDepth(), learner.getSeed()
    subset = subset_size(learner.getFeatureSubsetStrategy())
    weights = data.counts.sum() / (2 * np.bincount(data.labels, data.counts, 2))
    shipped = spark.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree in batch.column(0).to_pylist():
                nodes = forest_tree(shipped.value, weights, depth, subset, np.random.default_rng([seed, tree]))
                yield nodes.table(tree, shipped.value.cuts, True)

    parts = min(trees, 4 * spark.sparkContext.defaultParallelism)
    tree = DecisionTreeClassifier(maxBins=data.max_bins, maxDepth=depth, seed=seed)
    model = _load(spark, spark.range(0, trees, 1, parts).mapInArrow(run, NODE_SCHEMA), learner, tree, [1.0] * trees)
    shipped.destroy()
    return model


class _Walk:
    """A fitted ensemble as arrays of nodes; a leaf is its own child."""

    def __init__(self, model, spark: SparkSession):
        path = shared_path(spark, "walked-trees")
        model.write().overwrite().save(path)
        n = F.col("nodeData")
        table = spark.read.parquet(f"{path}/data").select(
            F.col("treeID").alias("tree"), n["id"].alias("id"), n["leftChild"].alias("left"), n["rightChild"].alias("right"),
            n["split"]["featureIndex"].alias("feature"), F.get(n["split"]["leftCategoriesOrThreshold"], 0).alias("limit"),
            n["split"]["numCategories"].alias("categories"), n["prediction"].alias("prediction"),
            F.get(n["impurityStats"], 0).alias("s0"), F.get(n["impurityStats"], 1).alias("s1")).toArrow()  # as large as the fitted model
        remove(spark, path)
        c = {name: table.column(name).to_numpy() for name in table.column_names}
        order = np.lexsort((c["id"], c["tree"]))
        c = {name: v[order] for name, v in c.items()}
        self.roots = np.searchsorted(c["tree"], np.arange(model.getNumTrees))
        start, own, inner = self.roots[c["tree"]], np.arange(len(order)), c["left"] >= 0
        self.plain = bool((c["categories"] < 0).all())
        self.feature, self.limit = np.where(inner, c["feature"], 0).astype(np.int64), np.where(inner, c["limit"], np.inf)
        self.child = np.stack([np.where(inner, c[k] + start, own) for k in ("left", "right")], axis=1).ravel().astype(np.int64)
        self.inner = inner
        self.boosted = isinstance(model, GBTClassificationModel)
        self.value = c["prediction"] * np.array(model.treeWeights)[c["tree"]] if self.boosted else c["s1"] / (c["s0"] + c["s1"])

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 per row of ``x``."""
        out, trees = np.empty(len(x)), len(self.roots)
        for begin in range(0, len(x), ROWS_AT_ONCE):
            part = np.ascontiguousarray(x[begin:begin + ROWS_AT_ONCE])
            flat, ends = part.ravel(), np.tile(self.roots, len(part))
            place = np.repeat(np.arange(len(part)) * x.shape[1], trees)
            todo, node = np.arange(len(ends)), ends
            while len(todo):
                for _ in range(LEVELS_AT_ONCE):
                    node = self.child.take(2 * node + (flat.take(place + self.feature.take(node)) > self.limit.take(node)))
                ends[todo] = node
                on = self.inner.take(node)
                todo, node, place = todo[on], node[on], place[on]
            total = self.value.take(ends).reshape(len(part), trees).sum(axis=1)
            out[begin:begin + len(part)] = 1 / (1 + np.exp(np.minimum(-2 * total, 700))) if self.boosted else total / trees
        return out


def both_scores(spark: SparkSession, boosted: PipelineModel, forest: PipelineModel) -> Callable[[Column], Column] | None:
    """What turns an array of the feature values into a struct of ``p_boosted`` and ``p_forest``; None for models of another make."""
    for model, kind in ((boosted, GBTClassificationModel), (forest, RandomForestClassificationModel)):
        if len(model.stages) != 2 or not isinstance(model.stages[0], VectorAssembler) or not isinstance(model.stages[1], kind):
            return None
        if model.stages[0].getInputCols() != FEATURES or model.stages[1].numFeatures != len(FEATURES) or model.stages[1].numClasses != 2:
            return None
    walks = [_Walk(model.stages[1], spark) for model in (boosted, forest)]
    if not all(w.plain for w in walks):
        return None
    shipped, width = spark.sparkContext.broadcast(walks), len(FEATURES)

    @F.arrow_udf("struct<p_boosted:double,p_forest:double>")
    def scores(values: pa.Array) -> pa.Array:
        x = values.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        return pa.StructArray.from_arrays([pa.array(w.scores(x)) for w in shipped.value], names=["p_boosted", "p_forest"])

    return scores
