"""Exact order-based results without sorting a whole table in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import QuantileDiscretizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: A cell with more rows than this is cut by four more digits before its rows are ordered.
CELL_ROWS = 1_000_000


def hash_ranks(df: DataFrame, strata: str, key_hash: Column, ranks: Callable[[dict], dict]) -> dict:
    """Fit step: the hash found at given ranks of each stratum, as ``{stratum: [hash, ...]}``.

    ``ranks`` maps the stratum sizes to the wanted ranks, ``{stratum: [rank, ...]}``. Two passes read
    the stratum and the key only. The first counts rows per cell, a cell being the first four hex
    digits; the cell in which a rank falls is then known, and the second pass orders just the rows of
    those cells. Cells that are too large for that are cut again, so the cells shrink as the table grows. Rows are
    never sorted or moved as a whole. A null stratum is a stratum; there is one row per stratum and rank on the driver.
    """
    spark, kind = df.sparkSession, dict(df.dtypes)[strata]
    keyed = df.select(F.col(strata).alias("_s"), key_hash.alias("_hash"))
    sizes = {r["_s"]: r["n"] for r in keyed.groupBy("_s").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = [(s, i, r, "") for s, rs in ranks(sizes).items() for i, r in enumerate(rs) if r > 0]
    out = {s: [] for s in sizes}
    digits, largest = 0, max(sizes.values(), default=0)
    # A wanted rank is narrowed to its place in ever smaller cells: (stratum, part, rank in the cell, the cell).
    while wanted and (digits == 0 or largest > CELL_ROWS) and digits < 32:
        table = spark.createDataFrame(wanted, f"_s {kind}, _part int, _rank bigint, _inside string")
        near = keyed.join(F.broadcast(table.select("_s", "_inside").distinct().toDF("_s2", "_inside")),
                          F.col("_s").eqNullSafe(F.col("_s2")) & (F.substring("_hash", 1, digits) == F.col("_inside")))
        digits += 4
        cells = near.groupBy("_s", "_inside", F.substring("_hash", 1, digits).alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
        upto = W.partitionBy("_s", "_inside").orderBy("_cell").rowsBetween(W.unboundedPreceding, 0)
        placed = cells.withColumn("_upto", F.sum("_n").over(upto))
        t, p = table.alias("t"), placed.alias("p")
        hit = p.join(F.broadcast(t), F.expr("p._s <=> t._s AND p._inside = t._inside AND _upto >= _rank AND _upto - _n < _rank"))
        found = hit.select("t._s", "_part", F.expr("_rank - _upto + _n").alias("_rank"), "_cell", "_n").collect()
        wanted = [(r["_s"], r["_part"], r["_rank"], r["_cell"]) for r in found]
        largest = max((r["_n"] for r in found), default=0)
    if wanted:
        table = spark.createDataFrame(wanted, f"_s2 {kind}, _part int, _need bigint, _cell string")  # one row per wanted rank
        rows = keyed.join(F.broadcast(table), F.col("_s").eqNullSafe(F.col("_s2")) & (F.substring("_hash", 1, digits) == F.col("_cell")))
        ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy("_s", "_part").orderBy("_hash")))
        for row in ranked.where("_r = _need").select("_s", "_hash").collect():
            out[row["_s"]].append(row["_hash"])
    return {s: sorted(hashes) for s, hashes in out.items()}


def running_totals(df: DataFrame, by: list[str], order: str, measures: list[str],
                   buckets: int = 256) -> DataFrame:
    """Add ``before_<m>``: the sum of each measure over rows of the same group with a larger ``order``.

    ``df`` has one row per group and order value. Quantile bounds cut the order axis into even
    buckets, so each task sorts about 1/buckets of the rows and bucket totals supply the rest.
    Ties cannot straddle buckets, and the bounds only affect balance, never the result.
    """
    cut = QuantileDiscretizer(numBuckets=buckets, inputCol=order, outputCol="_bucket",
                              relativeError=0.001, handleInvalid="keep").fit(df)
    cut.setHandleInvalid("keep")
    tagged = cut.transform(df)
    prior = W.partitionBy(*by, "_bucket").orderBy(F.col(order).desc()).rowsBetween(W.unboundedPreceding, -1)
    local = tagged.select("*", *[F.coalesce(F.sum(m).over(prior), F.lit(0)).alias(f"_l_{m}")
                                 for m in measures])
    higher = W.partitionBy(*by).orderBy(F.col("_bucket").desc()).rowsBetween(W.unboundedPreceding, -1)
    totals = (tagged.groupBy(*by, "_bucket").agg(*[F.sum(m).alias(m) for m in measures])
              .select(*by, "_bucket", *[F.coalesce(F.sum(m).over(higher), F.lit(0)).alias(f"_o_{m}")
                                        for m in measures]))
    joined = local.join(totals, [*by, "_bucket"])
    return joined.select(*df.columns, *[(F.col(f"_l_{m}") + F.col(f"_o_{m}")).alias(f"before_{m}")
                                        for m in measures])
