"""SimHash near-duplicates with pivot distance tables.

A fingerprint has 64 bits over hashed word shingles. Fingerprints link when they differ in at most ``max_bits``
bits. Distances to ``PIVOTS`` reference fingerprints are computed once per fingerprint; by the triangle
inequality two fingerprints whose distances to any pivot differ by more than ``max_bits`` cannot link. Within a
bucket the rows are ordered by the first distance, so that a row meets only a window of partners; the other
coordinates discard most of those, and the survivors are verified bit by bit.

Pivot distances alone would still compare all pairs, so buckets come first: of ``max_bits`` + 2 bit bands at
least two are equal in linked fingerprints, and every pair of bands is a bucket key. That is exact, no link is lost.
Equal fingerprints are one node from the start; buckets of any size are split into block pairs (``blocks``).

Edge cases: a null text or one without words has fingerprint zero, which links like any other; a shorter text
than a shingle is hashed whole. Repeated rows share fingerprint and component. A null id is never a component's
id unless all its ids are null. An empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from lurewatch.llm.blocks import block_pairs, forest, grouped, linked_pairs, starts, whole_groups
from lurewatch.llm.common import ids_of, materialize
from lurewatch.llm.components import components

SEED = 42
PIVOTS = 16


def shingle_digests(text: str | None, width: int) -> bytes:
    """The hashes of the shingles of ``width`` words, in order; none for a text without words."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z and the six ASCII separators only
    if not words:
        return b""
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    begins = [0, *ends[:-1]]
    digest = xxhash.xxh64_digest
    if len(words) < width:
        return digest(joined, SEED)
    return b"".join([digest(joined[s:e - 1], SEED) for s, e in zip(begins, ends[width - 1:])])


def fingerprint(text: str | None, width: int = 3) -> int:
    """The fingerprint of one text as a signed 64-bit number."""
    hashes = shingle_digests(text, width)
    if not hashes:
        return 0
    ones = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes) // 8).view(">i8")[0])


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Fixed pseudo-random reference fingerprints."""
    return np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, SEED) for i in range(n)], dtype=np.uint64)


def _forest_of(max_bits: int):
    refs = pivots()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["key", "_i", "_j"]):
            fp = table.column("fp").to_numpy().view(np.uint64)
            distance = np.bitwise_count(fp[:, None] ^ refs).astype(np.int8)  # the pivot distance table
            group = starts(table, ["key", "_i", "_j"])
            number = np.zeros(len(fp), np.int64)
            number[group] = 1
            order = np.lexsort((distance[:, 0], np.cumsum(number)))
            fp, distance = fp[order], distance[order]
            side = table.column("_side").to_numpy()[order]

            def near(a, b):
                window = distance[b, 0] - distance[a, 0] <= max_bits
                open_pairs = np.flatnonzero(window)
                for p in range(1, PIVOTS):
                    if not len(open_pairs):
                        break
                    x, y = a[open_pairs], b[open_pairs]
                    open_pairs = open_pairs[np.abs(distance[x, p] - distance[y, p]) <= max_bits]
                linked = np.zeros(len(a), bool)
                linked[open_pairs] = np.bitwise_count(fp[a[open_pairs]] ^ fp[b[open_pairs]]) <= max_bits
                return linked, window

            a, b = forest(*linked_pairs(group, len(fp), side, near), len(fp))
            signed = fp.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed[a]), pa.array(signed[b])], names=["a", "b"])

    return run


def links(fingerprints: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b): pairs of linked fingerprints that connect everything that is connected; ``fp`` must be distinct."""
    bands = max_bits + 2
    edges = [64 * i // bands for i in range(bands + 1)]

    def part(i: int) -> str:
        return f"(shiftrightunsigned(fp, {edges[i]}) & {(1 << (edges[i + 1] - edges[i])) - 1}L)"

    widths = [edges[i + 1] - edges[i] for i in range(bands)]
    keys = [F.expr(f"shiftleft({n}L, 56) | shiftleft({part(x)}, {widths[y]}) | {part(y)}")
            for n, (x, y) in enumerate(combinations(range(bands), 2))]
    rows = materialize(fingerprints.select("fp", F.explode(F.array(*keys)).alias("key")), "band-keys")
    blocks = grouped(block_pairs(rows, "key", "fp"), "key", ["fp"])
    return blocks.select("key", "_i", "_j", "_side", "fp").mapInArrow(_forest_of(max_bits), "a long, b long")


def _groups(docs: DataFrame, max_bits: int, doc_id: str, text: str, **extra: Column) -> DataFrame:
    """doc_id, fp, the ``extra`` columns, root (one fingerprint per component) and component_id, one row per document."""
    compute = F.pandas_udf(_fingerprints, "long")
    rows = materialize(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), compute(F.col(f"`{text}`")).alias("fp"),
                                   *[c.alias(k) for k, c in extra.items()]), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    members = materialize(components(links(nodes.select("fp"), max_bits), "a", "b").toDF("fp", "root"), "members")
    smallest = materialize(members.join(nodes, "fp").groupBy("root").agg(F.min("least").alias("component")), "roots")
    known = members.join(smallest, "root").select("fp", "root", "component")
    lookup = materialize(nodes.join(known, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component", "least").alias("component_id")),
        "fingerprint-components")
    return rows.join(lookup, "fp")


def near_duplicates(docs: DataFrame, max_bits: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (signed long), component_id: one row per document."""
    return _groups(docs, max_bits, doc_id, text).select("doc_id", "fp", "component_id")


def leaders(docs: DataFrame, groups: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each root of ``groups`` (doc_id, txt, root): the smallest id, nulls last, then the smallest
    text hash ``txt``. Rows are found by id and text hash; of rows that repeat both, one stays."""
    order = F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "txt")
    first = groups.groupBy("root").agg(F.min(order).alias("_first"))
    lead = first.select(ids_of("_first.doc_id").alias("_key"), F.col("_first.txt").alias("_txt"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                        ids_of(f"`{doc_id}`").alias("_key"), F.xxhash64(F.col(f"`{text}`")).alias("_txt"))
    found = whole.join(lead, ["_key", "_txt"], "left_semi")
    return found.groupBy("_key", "_txt").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row")).select("_row.*")


def representatives(docs: DataFrame, max_bits: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that lead their component, see ``leaders``."""
    groups = _groups(docs, max_bits, doc_id, text, txt=F.xxhash64(F.col(f"`{text}`")))
    return leaders(docs, groups, doc_id, text)
