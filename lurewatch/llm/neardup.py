"""Embedding near-duplicates by cross-polytope hashing.

A hash function rotates a vector by three rounds of random signs and a fast Hadamard transform and takes the axis
with the largest coordinate, with its sign. ``FUNCTIONS`` of them make a table's code; besides the main bucket a vector
also goes to the ``PROBES`` - 1 buckets that the closest runner-up axes suggest. Vectors that share a bucket of any of the
``TABLES`` tables are compared by cosine in double precision, so nothing below the threshold links. A pair that
shares several buckets counts in the first of them only.

Equal vectors are one node that knows its number of copies; links to copies are counted, not listed. Buckets of
any size are split into block pairs (``blocks``); a task returns link counts per vector and a spanning forest of the
links that it found, never the pairs.

Edge cases: a vector that is null, empty, zero or holds null or non-finite components, or whose label or id is null,
links with nothing and is its own component (a null id: null). Vectors of different length never link. Repeated
rows are copies and link. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lurewatch.llm.blocks import block_pairs, forest, grouped, linked_pairs, starts, whole_groups
from lurewatch.llm.common import materialize
from lurewatch.llm.components import components

TABLES = 8
FUNCTIONS = 3
PROBES = 4
SEED = 20
_MATMUL = 32


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    half = 1
    while half < d:
        pairs = x.reshape(n, d // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, d)
        half *= 2
    return x


def codes(vectors: np.ndarray, tables: int = TABLES, functions: int = FUNCTIONS, probes: int = PROBES) -> np.ndarray:
    """Bucket codes, rows x (tables * probes); a code holds its table's number. Probes of a table differ."""
    n, dim = vectors.shape
    width = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :dim] = vectors
    rng = np.random.default_rng([SEED, width])
    rows = np.arange(n)
    out = np.empty((n, tables, probes), np.int64)
    for t in range(tables):
        first, second, gap = (np.empty((n, functions), k) for k in (np.int64, np.int64, float))
        for f in range(functions):
            y = padded
            for signs in rng.choice([-1.0, 1.0], (3, width)):
                y = hadamard(y * signs)
            size = np.abs(y)
            top = np.argpartition(size, -2, axis=1)[:, -2:]
            swap = size[rows, top[:, 0]] > size[rows, top[:, 1]]
            best, next_best = np.where(swap, top[:, 0], top[:, 1]), np.where(swap, top[:, 1], top[:, 0])
            first[:, f] = 2 * best + (y[rows, best] < 0)
            second[:, f] = 2 * next_best + (y[rows, next_best] < 0)
            gap[:, f] = size[rows, best] / np.maximum(size[rows, next_best], 1e-300)
        # Probe p replaces the axes of the subset of functions with the p-th smallest product of gaps.
        masks = np.array([[m >> f & 1 for f in range(functions)] for m in range(2 ** functions)], bool)
        cost = np.log(gap) @ masks.T
        chosen = masks[np.argsort(cost, axis=1, kind="stable")[:, :probes]]
        axes = np.where(chosen, second[:, None, :], first[:, None, :])
        code = np.full((n, probes), t, np.int64)
        for f in range(functions):
            code = code * (2 * width) + axes[:, :, f]
        out[:, t] = code
    return out.reshape(n, tables * probes)


def _codes_of(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for lists in arrays:
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        offsets, flat = np.concatenate([[0], np.cumsum(sizes)]), lists.flatten().to_numpy(zero_copy_only=False).astype(float)
        out = np.zeros((len(lists), TABLES * PROBES), np.int64)
        for dim in np.unique(sizes):
            rows = np.flatnonzero(sizes == dim)
            for part in np.array_split(rows, len(rows) // 4096 + 1):
                if len(part):
                    x = flat[offsets[part][:, None] + np.arange(dim)]
                    out[part] = codes(x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True))
        yield pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _first_common(a: np.ndarray, b: np.ndarray, code: np.ndarray) -> np.ndarray:
    """True where ``code`` is the smallest bucket that the pair shares."""
    left, right = (x.reshape(len(x), TABLES, PROBES) for x in (a, b))
    shared = (left[:, :, :, None] == right[:, :, None, :]).any(axis=3)
    return np.where(shared, left, np.iinfo(np.int64).max).reshape(len(a), -1).min(axis=1) == code


def _compare(threshold: float):
    group_names = ["label", "dim", "code", "_i", "_j"]
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("other", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, group_names, 8_000):
            rows = table.num_rows
            node, copies, side, code, dims = (table.column(c).to_numpy() for c in ("node", "copies", "_side", "code", "dim"))
            table = table.combine_chunks()
            own = table.column("codes").chunk(0).flatten().to_numpy().reshape(rows, TABLES * PROBES)
            offsets = np.concatenate([[0], np.cumsum(dims)])
            flat = table.column("embedding").chunk(0).flatten().to_numpy().astype(float)
            unit = np.zeros((rows, int(dims.max())))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                unit[at, :dim] = _unit(flat[offsets[at][:, None] + np.arange(dim)])
            first = starts(table, group_names)
            bounds = np.append(first, rows)
            left, right = [], []

            def add(a: np.ndarray, b: np.ndarray) -> None:
                for k in range(0, len(a), 50_000):
                    x, y = a[k:k + 50_000], b[k:k + 50_000]
                    keep = _first_common(own[x], own[y], code[x])
                    left.append(x[keep])
                    right.append(y[keep])

            small = np.ones(rows, bool)
            for s, e in zip(bounds[:-1], bounds[1:]):
                if e - s >= _MATMUL:
                    small[s:e] = False
                    near = np.triu(unit[s:e] @ unit[s:e].T >= threshold, 1)
                    near &= (side[s:e, None] == 2) | (side[s:e, None] != side[None, s:e])
                    a, b = np.nonzero(near)
                    add(a + s, b + s)
            index = np.flatnonzero(small)
            if len(index):
                group = np.repeat(first, np.diff(bounds))[index]
                cut = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
                a, b = linked_pairs(cut, len(index), side[index], lambda x, y: (
                    np.einsum("ij,ij->i", unit[index[x]], unit[index[y]]) >= threshold, None))
                add(index[a], index[b])
            a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
            degree = np.zeros(rows, np.int64)
            np.add.at(degree, a, copies[b])
            np.add.at(degree, b, copies[a])
            hit = np.flatnonzero(degree)
            child, root = forest(a, b, rows)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([node[hit], node[child]])),
                pa.array(np.concatenate([degree[hit], np.zeros(len(child), np.int64)])),
                pa.array(np.concatenate([np.zeros(len(hit), np.int64), node[root]]),
                         mask=np.concatenate([np.ones(len(hit), bool), np.zeros(len(child), bool)]))], schema=schema)

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding",
                    label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector, compared within equal labels."""
    v, e = F.col("vec_id"), F.col("embedding")
    usable = (v.isNotNull() & F.col("label").isNotNull() & e.isNotNull() & F.exists(e, lambda x: x != 0)
              & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    base = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("embedding"),
                          F.col(f"`{label}`").alias("label"))
    base = materialize(base.withColumn("_ok", F.coalesce(usable, F.lit(False))).withColumn(
        "_h", F.xxhash64("label", "embedding")), "vectors")
    same = ["_h", "label", "embedding"]
    nodes = base.where("_ok").groupBy(*same).agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    hashed = F.arrow_udf(_codes_of, "array<long>")
    nodes = materialize(nodes.withColumn("codes", hashed("embedding")), "vector-nodes")
    dim = F.size("embedding").alias("dim")
    buckets = nodes.select("node", "label", dim, F.explode("codes").alias("code")).select(
        "node", F.struct("label", "dim", "code").alias("key"))
    blocks = block_pairs(materialize(buckets, "vector-buckets"), "key", "node")
    payload = blocks.join(nodes.select("node", "copies", "codes", "embedding"), "node")
    found = grouped(payload, "key", ["node"]).select(
        F.xxhash64("key.label").alias("label"), F.col("key.dim").alias("dim"), F.col("key.code").alias("code"),
        "_i", "_j", "_side", "node", "copies", "codes", "embedding").mapInArrow(_compare(threshold), "id long, n long, other long")
    found = materialize(found, "vector-links")
    degrees = found.where("other IS NULL").groupBy(F.col("id").alias("node")).agg(F.sum("n").alias("_n"))
    members = components(found.where("other IS NOT NULL"), "id", "other")
    lookup = nodes.select(*same, "node", "copies").join(degrees, "node", "left").join(members, "node", "left").select(
        *[F.col(c).alias(f"_{n}") for n, c in enumerate(same)],
        (F.col("copies") - 1 + F.coalesce("_n", F.lit(0))).alias("_links"), F.coalesce("component", "node").alias("_component"))
    lookup = materialize(lookup, "vector-results")
    match = F.col("_ok") & (F.col("_h") == F.col("_0")) & (F.col("label") == F.col("_1")) & (F.col("embedding") == F.col("_2"))
    out = base.join(lookup, match, "left").select(
        "vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("_component", "vec_id").cast("long").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
