"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lurewatch.workspace import materialize, release, shared_path

__all__ = ["NO_ID", "barrier", "fresh", "ids_of", "materialize", "release", "shared_path", "spaced", "string_of", "words_of"]

#: What stands for a null id.
NO_ID = -(2 ** 63)
#: Characters that separate words: space and the five controls 09 to 0D.
SPACES = " \t\n\x0b\x0c\r"


def spaced(text: Column) -> Column:
    """``text`` with every separator turned into a space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES[1:]:
        out = F.replace(out, F.lit(c), F.lit(" "))
    return out


def words_of(spaced_text: Column) -> Column:
    """The words of a text that went through ``spaced``."""
    return F.array_remove(F.split(spaced_text, " "), "")


def string_of(column: str) -> Column:
    """A text column, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have yet, whatever extra columns it came with."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def barrier(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated once per row; later expressions cannot be merged into them, so a
    lambda that uses them does not evaluate them again for every element."""
    keep = [c for c in df.columns if c not in columns]
    return df.select(*[F.col(f"`{c}`") for c in keep],
                     F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def ids_of(name: str) -> Column:
    """A null-safe join key for an integer id."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID).cast("long"))
