"""Preparation: dedupe, labels, exact stratified splits, sampling, augmentation and data quality."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lurewatch.fixed.rules import SEED
from lurewatch.functions.keyed import keyed_hash
from lurewatch.functions.ordered import hash_ranks

def over_groups():
    """All rows of an already grouped table, which has one row per class, split or model."""
    return W.partitionBy(F.lit(0))


def dedupe_first(df: DataFrame, key: str = "url", order: str = "url_id") -> DataFrame:
    """Keep the row with the smallest ``order``, which numbers the rows of the table, per ``key``.

    A hash aggregation of the two columns combines copies before the shuffle, so a URL that makes up a
    third of the table costs one row per task; the winners' numbers then pick whole rows, so no result mixes two.
    """
    first = df.groupBy(key).agg(F.min(order).alias(order)).select(order)
    return df.join(first, order, "left_semi").select(df.columns)


def flip_label(df: DataFrame, source: str = "source_label", target: str = "label") -> DataFrame:
    """Source data uses 0 = phishing; everything else here uses 1 = phishing."""
    return df.withColumn(target, (F.lit(1) - F.col(source)).cast("int"))


def class_distribution(df: DataFrame) -> DataFrame:
    counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("label", "n", F.round(F.col("n") * 100.0 / F.sum("n").over(over_groups()), 2).alias("pct"))


def _held_out_sizes(sizes: dict, fraction: float) -> dict:
    """Rows to hold out per class: ``ceil(fraction * n)`` in all; the kept rows are shared out among the
    classes in proportion, left-over rows going to the largest remainders."""
    n = sum(sizes.values())
    keep = n - math.ceil(n * fraction)
    share = {c: size * keep / n for c, size in sizes.items()}
    kept = {c: math.floor(x) for c, x in share.items()}
    by_remainder = sorted(sizes, key=lambda c: (kept[c] - share[c], c is None, 0 if c is None else c))
    for c in by_remainder[:keep - sum(kept.values())]:
        kept[c] += 1
    return {c: [sizes[c] - kept[c]] for c in sizes}


def _passed(label: str, key_hash: Column, limits: dict) -> Column:
    """How many of its class's limits a row's hash lies above."""
    if not limits:
        return F.lit(0)
    count = F
    for value, hashes in limits.items():
        above = reduce(lambda a, b: a + b, [(key_hash > h).cast("int") for h in hashes], F.lit(0))
        count = count.when(F.col(label).eqNullSafe(F.lit(value)), above)
    return count.otherwise(0)


def held_out(df: DataFrame, fraction: float = 0.2, salt: str = "split", seed: int = SEED, key: str = "url_id",
             label: str = "label") -> Column:
    """Fit an exact, repeatable, stratified cut by seeded hash order of the unique row ``key``.

    Returns a condition on the row alone, so applying the cut needs neither a join nor a shuffle.
    Fitting reads ``df`` twice: pass a materialised table.
    """
    key_hash = keyed_hash(F.col(key), salt, seed)
    limits = hash_ranks(df, label, key_hash, lambda sizes: _held_out_sizes(sizes, fraction))
    inside = [F.col(label).eqNullSafe(F.lit(c)) & (key_hash <= hashes[0]) for c, hashes in limits.items() if hashes]
    return reduce(lambda a, b: a | b, inside, F.lit(False))


def stratified_split(df: DataFrame, fraction: float = 0.2, seed: int = SEED) -> DataFrame:
    """Append ``split`` with the values train and test."""
    return df.withColumn("split", F.when(held_out(df, fraction, "split", seed), "test").otherwise("train"))


def three_way_split(df: DataFrame, fraction: float = 0.2, seed: int = SEED) -> DataFrame:
    """train / validation / test: a second stratified cut inside the training pool."""
    test = held_out(df, fraction, "split", seed)
    validation = held_out(df.where(~test), fraction, "validation", seed)
    return df.withColumn("split", F.when(test, "test").when(validation, "validation").otherwise("train"))


def stratified_folds(df: DataFrame, k: int = 5, seed: int = SEED, key: str = "url_id", label: str = "label") -> DataFrame:
    """Append ``fold`` (0..k-1): exact folds whose class sizes differ by at most one row."""
    key_hash = keyed_hash(F.col(key), "fold", seed)
    limits = hash_ranks(df, label, key_hash, lambda sizes: {
        c: [j * n // k for j in range(1, k)] for c, n in sizes.items()})
    # a class with fewer rows than folds starts with empty folds
    missing = {c: k - 1 - len(h) for c, h in limits.items()}
    fold = _passed(label, key_hash, limits)
    for c, m in missing.items():
        fold = F.when(F.col(label).eqNullSafe(F.lit(c)), fold + m).otherwise(fold) if m else fold
    return df.withColumn("fold", fold)


def split_sizes(split: DataFrame) -> DataFrame:
    counts = split.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1)
                                        .alias("phishing"))
    return counts.select("split", "n", "phishing",
                         F.round(F.col("n") * 100.0 / F.sum("n").over(over_groups()), 1).alias("pct"))


def sample_per_class(df: DataFrame, n: int, seed: int = SEED, key: str = "url_id") -> DataFrame:
    """``n`` random rows per class. Spark cuts each partition to n rows before the shuffle."""
    hashed = df.withColumn("_hash", keyed_hash(F.col(key), "sample", seed))
    first = W.partitionBy("label").orderBy("_hash")
    return (hashed.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= n)
            .drop("_r", "_hash"))


def augment_train(pool: DataFrame, curated: DataFrame) -> DataFrame:
    """Append curated legitimate rows to a training pool; duplicates are kept.

    Columns the curated table lacks become NULL, its label is 0 and its split 'train'.
    """
    added = curated.withColumn("label", F.lit(0))
    if "split" in pool.columns:
        added = added.withColumn("split", F.lit("train"))
    return (pool.withColumn("augmented", F.lit(False))
            .unionByName(added.withColumn("augmented", F.lit(True)), allowMissingColumns=True))


def augment_profile(augmented: DataFrame) -> DataFrame:
    """What augmentation changes: sizes, classes and three feature means, per origin and in all."""
    return (augmented.rollup("augmented").agg(
        F.grouping("augmented").alias("_g"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("label") == 1).alias("phishing"), F.count_if(F.col("label") == 0).alias("legitimate"),
        F.round(F.avg("qty_slash"), 2).alias("avg_slashes"), F.round(F.avg("url_length"), 2).alias("avg_length"),
        F.round(F.avg("has_https") * 100, 1).alias("https_pct"))
        .select(F.when(F.col("_g") == 1, "all").when(F.col("augmented"), "added").otherwise("original")
                .alias("part"), "n", "phishing", "legitimate", "avg_slashes", "avg_length", "https_pct"))


def quality_profile(df: DataFrame) -> DataFrame:
    """Nulls, empties, duplicate URLs and label values in one row; copies combine before the shuffle."""
    per_url = df.groupBy("url").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("label").isNull()).alias("_null_labels"))
    labels = df.agg(F.count_distinct("label").cast("int")).scalar()
    return per_url.agg(
        F.sum("_n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("url").isNull(), F.col("_n"))), F.lit(0)).alias("null_urls"),
        F.coalesce(F.sum(F.when(F.col("url") == "", F.col("_n"))), F.lit(0)).alias("empty_urls"),
        (F.sum("_n") - F.count(F.lit(1))).alias("duplicate_rows"),
        F.sum("_null_labels").alias("null_labels"),
        F.max(labels).alias("distinct_labels"))
