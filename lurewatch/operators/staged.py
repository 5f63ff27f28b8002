"""Staged scoring: one fit of many trees judged at several tree counts, and many such fits at a time.

The first k trees of an ensemble are an ensemble of k trees: exactly the one that boosting would have fitted, and a forest of the
same distribution. So a search over tree counts needs one fit per remaining setting. A row's leaves come from the
fitted model, the leaves' values from its node table; running sums over the trees give the row's decision at each
count, and only confusion counts leave a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from lurewatch.workspace import remove, shared_path


def leaf_values(model: PipelineModel, spark: SparkSession) -> tuple[np.ndarray, np.ndarray]:
    """(values of all leaves, tree by tree in the model's own leaf order; where each tree begins).

    A forest's leaf holds the share of the phishing class, a boosted tree's its weighted prediction. The table is as
    large as the fitted model, which the driver holds anyway.
    """
    learner, path = model.stages[-1], shared_path(spark, "staged-trees")
    learner.write().overwrite().save(path)
    n = F.col("nodeData")
    leaves = spark.read.parquet(f"{path}/data").where(n["leftChild"] < 0).select(
        F.col("treeID").alias("tree"), n["id"].alias("node"), n["prediction"].alias("prediction"), n["impurityStats"].alias("stats")).collect()
    remove(spark, path)
    leaves.sort(key=lambda r: (r.tree, r.node))  # nodes are numbered in the order in which leaves are
    if isinstance(learner, RandomForestClassificationModel):
        values = [r.stats[1] / sum(r.stats) for r in leaves]
    else:
        values = [r.prediction * learner.treeWeights[r.tree] for r in leaves]
    per_tree = np.bincount([r.tree for r in leaves], minlength=learner.getNumTrees)
    return np.array(values), np.cumsum(per_tree) - per_tree


def staged_counts(df: DataFrame, model: PipelineModel, tree_counts: list[int], side: str) -> DataFrame:
    """(side, trees, tp, fp, fn) of ``df`` with its ``label`` for the first trees of the model; one row each."""
    learner = model.stages[-1]
    forest = isinstance(learner, RandomForestClassificationModel)
    values, begins = leaf_values(model, df.sparkSession)
    ends = np.array(tree_counts) - 1
    learner.setLeafCol("_leaves")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            leaves = batch.column("leaves").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)
            sums = np.cumsum(values[leaves + begins], axis=1)[:, ends]
            says = sums / np.array(tree_counts) > 0.5 if forest else sums > 0
            truth = batch.column("label").to_numpy(zero_copy_only=False)[:, None] == 1
            sides = np.array(batch.column("side").to_pylist(), object)
            for s in sorted(set(sides)):
                own = sides == s
                tp, fp, fn = ((x[own]).sum(axis=0) for x in (says & truth, says & ~truth, ~says & truth))
                yield pa.RecordBatch.from_arrays([pa.array([s] * len(ends), pa.string()), pa.array(tree_counts, pa.int32()), pa.array(tp, pa.int64()),
                                                  pa.array(fp, pa.int64()), pa.array(fn, pa.int64())], names=["side", "trees", "tp", "fp", "fn"])

    rows = model.transform(df).select(F.col(side).alias("side"), F.col("label").cast("int").alias("label"), vector_to_array("_leaves").alias("leaves"))
    parts = rows.mapInArrow(run, "side string, trees int, tp long, fp long, fn long")
    return parts.groupBy("side", "trees").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def f1(tp: int, fp: int, fn: int) -> float:
    return 2 * tp / (2 * tp + fp + fn) if tp else 0.0


def staged_scores(cells: list, fit: Callable, scored: Callable, tree_counts: list[int], parallelism: int) -> list[tuple]:
    """(cell, side, trees, f1) of every cell: ``fit(cell)`` gives a model, ``scored(cell)`` the rows with their ``side``.

    Cells are fitted side by side: a small table keeps one core busy per level of a tree, so the cores are shared by cells.
    """
    def one(cell) -> list[tuple]:
        rows = staged_counts(scored(cell), fit(cell), tree_counts, "side").collect()  # a row per side and tree count
        return [(cell, r.side, r.trees, f1(r.tp, r.fp, r.fn)) for r in rows]

    with ThreadPool(parallelism) as pool:
        return [row for rows in pool.imap_unordered(inheritable_thread_target(one), cells) for row in rows]
