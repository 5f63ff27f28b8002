"""Sharding by longest-processing-time scheduling.

Rows with equal text form a group that stays together. Groups go, by size, to the least loaded shard, which a heap
finds. Ordering billions of groups in one place would not scale and is not needed: only a group of at least
1 / (``shards`` * ``GRAIN``) of all bytes is scheduled by itself, of which there are at most ``shards`` * ``GRAIN``. All
smaller ones first fall into ``shards`` * ``GRAIN`` bundles by their hash, and the bundles are scheduled like groups.
So the schedule has at most 2 * ``shards`` * ``GRAIN`` items at any input size, and a bundle is about a
thousandth of a shard. Slots are numbered by counting per (shard, bucket of ids) and then over the buckets.

Edge cases: a null text counts as empty, both have size 16 and are one group; a null id is an id like any other;
repeated rows are rows of their own with slots of their own. Groups larger than a shard's share make their
shard larger, since they must not be split. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window as W, functions as F

from lurewatch.llm.common import materialize, string_of

OVERHEAD = 16
GRAIN = 1024
BUCKETS = 256


def longest_first(sizes: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Shard of each (item, size): the largest item first, to the least loaded shard; ties by number."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, item in sorted(((size, item) for item, size in sizes), key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        out[item] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def described(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and the group: two independent 64-bit hashes of the text."""
    body = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.encode(string_of(f"`{text}`"), "UTF-8").alias("_b"))
    return body.select(
        "doc_id", (F.octet_length("_b") + OVERHEAD).cast("long").alias("size"), F.crc32("_b").alias("text_crc32"),
        F.xxhash64("_b").alias("g1"), F.conv(F.substring(F.md5("_b"), 1, 15), 16, 10).cast("long").alias("g2"))


def schedule(rows: DataFrame, shards: int) -> DataFrame:
    """(g1, g2, shard) for each group, from ``described`` rows."""
    spark = rows.sparkSession
    items = shards * GRAIN
    groups = materialize(rows.groupBy("g1", "g2").agg(F.sum("size").alias("bytes")), "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    large = F.col("bytes") * items >= total  # at most ``items`` groups
    bundle = F.pmod(F.xxhash64("g2", "g1"), F.lit(items)).cast("int")
    alone = groups.where(large).orderBy(F.col("bytes").desc(), "g1", "g2").collect()
    bundles = groups.where(~large).groupBy(bundle.alias("bundle")).agg(F.sum("bytes").alias("bytes")).collect()
    sizes = [(items + n, r["bytes"]) for n, r in enumerate(alone)] + [(r["bundle"], r["bytes"]) for r in bundles]
    shard_of = longest_first(sizes, shards)
    fixed = spark.createDataFrame([(r["g1"], r["g2"], shard_of[items + n]) for n, r in enumerate(alone)],
                                  "g1 long, g2 long, _alone int")
    spread = spark.createDataFrame([(r["bundle"], shard_of[r["bundle"]]) for r in bundles], "_bundle int, _bundled int")
    # Both tables have at most shards * GRAIN rows, whatever the input.
    df = groups.join(F.broadcast(fixed), ["g1", "g2"], "left").withColumn("_bundle", bundle)
    df = df.join(F.broadcast(spread), "_bundle", "left")
    return df.select("g1", "g2", F.coalesce("_alone", "_bundled").alias("shard"))


def sharded(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: one row per document; slots of a shard count from 0 without gaps."""
    rows = materialize(described(docs, doc_id, text), "shard-rows")
    plan = materialize(schedule(rows, shards), "shard-plan")
    df = rows.join(plan, ["g1", "g2"]).withColumn("_h", F.xxhash64("doc_id", "g1"))
    df = materialize(df.withColumn("_bucket", F.pmod("_h", F.lit(BUCKETS)).cast("int")), "shard-assigned")
    counts = df.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(W.partitionBy("shard", "_bucket").orderBy("_h", "doc_id", "g1", "g2")) - 1
    df = df.withColumn("_inside", inside)
    # One row for each shard and bucket: shards * BUCKETS rows at any input size.
    return df.join(F.broadcast(starts), ["shard", "_bucket"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_start") + F.col("_inside")).cast("long").alias("slot"))
