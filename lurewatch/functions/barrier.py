"""Keep computed columns computed once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def compute_once(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same table, with ``columns`` evaluated exactly once per row below this point.

    The optimizer pushes a filter through projections by copying the expressions it uses. With columns
    that build on each other many levels deep the copies multiply, and every one of them runs per row.
    A one-row generator stops that; filters on the other columns still reach the scan.
    """
    others = [c for c in df.columns if c not in columns]
    return df.select(*others, F.inline(F.array(F.struct(*columns))))
