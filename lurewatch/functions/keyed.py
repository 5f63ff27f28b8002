"""Repeatable pseudo-random choices that depend only on a row's key, a salt and a seed."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lurewatch.fixed.rules import SEED


def keyed_hash(key: Column, salt: str, seed: int = SEED) -> Column:
    """32 hex digits; ordering by them is a random order that every engine can repeat."""
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(salt), F.lit(str(seed))))


def keyed_int(key: Column, salt: str, seed: int = SEED) -> Column:
    """The first 32 bits of the hash as a bigint."""
    return F.conv(F.substring(keyed_hash(key, salt, seed), 1, 8), 16, 10).cast("bigint")


def keyed_uniform(key: Column, salt: str, seed: int = SEED) -> Column:
    """A double in [0, 1)."""
    return keyed_int(key, salt, seed) / F.lit(4294967296.0)


def keyed_pick(key: Column, salt: str, values: list[str], seed: int = SEED) -> Column:
    """One of ``values``."""
    index = (keyed_int(key, salt, seed) % len(values)).cast("int")
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)
