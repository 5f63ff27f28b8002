"""Comparing the members of buckets pair by pair, whatever the size of a bucket.

A bucket is split into blocks of about ``BLOCK`` members, and every pair of blocks is a group of its own, so a
bucket that holds a third of all rows spreads over many tasks and no task holds more than two blocks of it.
Pairs exist only as index arrays inside a task; what leaves it is decided by the caller.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lurewatch.llm.common import materialize

BLOCK = 512


def block_pairs(rows: DataFrame, key: str, member: str) -> DataFrame:
    """``rows`` of buckets with at least two members, once for each pair of blocks they take part in.

    Adds ``_i`` and ``_j``, the blocks, and ``_side``: 0 or 1 for a member of the first or second block, 2 when
    both are the same block. ``rows`` is read twice and should be stored.
    """
    sizes = materialize(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "bucket-sizes")
    df = rows.join(sizes, key)
    df = df.withColumn("_b", F.ceil(F.col("_n") / BLOCK).cast("int"))
    df = df.withColumn("_own", F.pmod(F.xxhash64(F.col(member), F.lit(7)), F.col("_b")).cast("int"))
    df = df.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    side = F.when(F.col("_own") < F.col("_other"), 0).when(F.col("_own") > F.col("_other"), 1).otherwise(2)
    return df.select(*rows.columns, F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"),
                     side.cast("int").alias("_side"))


def grouped(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows of a block pair side by side, in ``order``."""
    group = [key, "_i", "_j"]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *group).sortWithinPartitions(*group, *order)


def whole_groups(batches: Iterator[pa.RecordBatch], names: list[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that never cut a group; ``names`` are the group columns of the sorted input."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            table = pa.Table.from_batches(held)
            cut = int(starts(table, names)[-1])  # the last group may go on
            if cut:
                yield table.slice(0, cut)
                table = table.slice(cut).combine_chunks()
            held, count = table.to_batches(), 0
    if held:
        table = pa.Table.from_batches(held)
        if table.num_rows:
            yield table


def starts(table: pa.Table, names: list[str]) -> np.ndarray:
    """Row numbers at which a group starts."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for n in names:
        v = table.column(n).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def linked_pairs(group_start: np.ndarray, n: int, side: np.ndarray,
                 near: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray | None]]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of one group that ``near`` accepts, as two index arrays.

    ``near(a, b)`` gives the accepted pairs and, where rows are sorted so that later partners are farther,
    the pairs after which the first row has no more partners.
    """
    bounds = np.append(group_start, n)
    end = np.repeat(bounds[1:], np.diff(bounds))
    active, gap, left, right = np.arange(n), 1, [], []
    while True:
        active = active[active + gap < end[active]]
        if not len(active):
            break
        a, b = active, active + gap
        accepted, go_on = near(a, b)
        accepted &= (side[a] == 2) | (side[a] != side[b])
        left.append(a[accepted])
        right.append(b[accepted])
        if go_on is not None:
            active = active[go_on]
        gap += 1
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As few pairs as connect what the given pairs connect: each row with the first row that it reaches."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(label, before):
            break
    rows = np.flatnonzero(label != np.arange(n))
    return rows, label[rows]
