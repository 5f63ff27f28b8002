"""Bitmaps of hash values: small filters that a task can ask whether a value may be in a table.

A bitmap has a power of two of bits, at most ``MOST_BITS`` (8 MB); that is the bound on what reaches the driver and
the tasks, whatever the table holds. A full bitmap lets everything pass, so callers join afterwards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

MOST_BITS = 1 << 26
_SLOT_BITS = 32_768  # bits of one value of bitmap_construct_agg


def bits_for(rows: int) -> int:
    """Bits that leave few false answers for so many values, within the bound."""
    bits = _SLOT_BITS
    while bits < 32 * rows and bits < MOST_BITS:
        bits *= 2
    return bits


def bitmap_of(df: DataFrame, hash_column: str, bits: int) -> np.ndarray:
    """The bits of the column's low hash bits, as bytes; at most bits / 8 bytes are collected."""
    slot = F.col(hash_column).bitwiseAND(F.lit(bits - 1).cast("long")) + 1
    rows = df.select(slot.alias("x")).groupBy(F.expr("bitmap_bucket_number(x)").alias("k")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(x))").alias("b")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        start = (r.k - 1) * _SLOT_BITS // 8
        out[start:start + len(r.b)] = np.frombuffer(bytes(r.b), np.uint8)
    return out


def maybe(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For unsigned 64-bit hashes: False where the value is surely not in the bitmap's table."""
    low = hashes & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 == 1
