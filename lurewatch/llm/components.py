"""Connected components of a link table, for graphs that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lurewatch.llm.common import materialize, release


def _minimum(edges: DataFrame, with_self: bool) -> DataFrame:
    """(u, m): the smallest neighbour of each node. Written out, so that the join with the edges has plain
    shuffles on both sides and a node with very many links can be split over tasks."""
    least = F.least("u", F.min("v")) if with_self else F.min("v")
    return materialize(edges.groupBy("u").agg(least.alias("m")), "smallest")


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of ``links``; the component is the smallest node that it reaches.

    Alternating stars: every round points the larger neighbours of each node at the smallest one, and then
    a node's other parents at its smallest parent. The number of links never grows, and a few rounds leave one
    star per component. No task ever holds the neighbours of a node: minima are combined before the shuffle.
    Links of a node to itself and repeated links are ignored; an empty table gives an empty result.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = materialize(edges, "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _minimum(both, True)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct(), "large-star")
        parent = _minimum(large, False)
        small = large.join(parent, "u")
        starred = materialize(small.select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*").where("u <> v").distinct(), "small-star")
        release(edges, least, large, parent)
        edges = starred
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component")))
