"""Splitting a URL column into its parts with one regular expression per row.

The built-in ``parse_url`` drops user info and ports and returns NULL for malformed URLs; detection
needs those very cases, so the split is done here on the raw text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lurewatch.functions.barrier import compute_once

# Optional control characters, optional scheme, optional authority.
_PREFIX = r"^[\x00-\x20]*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?"
# Schemes whose last path segment may carry ';parameters'.
_PARAM_SCHEMES = ["", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps", "rtspu",
                  "sip", "sips", "mms", "sftp", "tel"]

PART_COLUMNS = ["_u", "_netloc", "_valid", "_host", "_scheme", "_path", "_params", "_query", "_fragment"]


def _after(text: Column, head: Column, mark: str) -> Column:
    """What follows ``head`` and the one-character ``mark``; empty if the mark is absent."""
    return F.when(text.contains(mark), F.substring(text, F.length(head) + 2, F.length(text))).otherwise("")


def with_url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Add the ``PART_COLUMNS``. Each stage is its own projection so that no part is computed twice."""
    df = df.withColumn("_u", F.coalesce(F.col(url), F.lit("")))
    df = df.withColumn("_clean", F.translate("_u", "\t\r\n", ""))
    df = df.withColumn("_prefix", F.regexp_extract("_clean", _PREFIX, 0))
    df = df.select(
        "*",
        F.substring(F.col("_clean"), F.length("_prefix") + 1, F.length("_clean")).alias("_rest"),
        F.when(F.col("_prefix").contains("//"), F.substring_index("_prefix", "//", -1)).otherwise("")
        .alias("_netloc"))
    df = df.select(
        "*",
        (F.col("_netloc").contains("[") == F.col("_netloc").contains("]")).alias("_valid"),
        F.substring_index("_rest", "#", 1).alias("_before"))
    df = df.select(
        "*",
        F.when(F.col("_valid"), F.substring_index("_netloc", ":", 1)).otherwise("").alias("_host"),
        F.when(F.regexp_like("_prefix", F.lit(r"^[\x00-\x20]*[a-zA-Z]")),
               F.lower(F.regexp_replace(F.substring_index("_prefix", ":", 1), r"[\x00-\x20]+", "")))
        .otherwise("").alias("_scheme"),
        F.substring_index("_before", "?", 1).alias("_rawpath"),
        _after(F.col("_rest"), F.col("_before"), "#").alias("_fragment"))
    df = df.withColumn("_query", _after(F.col("_before"), F.col("_rawpath"), "?"))
    df = df.withColumn(
        "_path",
        F.when(F.col("_rawpath").contains(";") & F.col("_scheme").isin(_PARAM_SCHEMES),
               F.regexp_replace("_rawpath", ";[^/]*$", "")).otherwise(F.col("_rawpath")))
    df = df.withColumn("_params", F.substring(F.col("_rawpath"), F.length("_path") + 2, F.length("_rawpath")))
    return compute_once(df.drop("_rawpath", "_clean", "_prefix", "_rest", "_before"), PART_COLUMNS)


def strip_www(host: Column) -> Column:
    return F.when(host.startswith("www."), F.substring(host, F.lit(5), F.length(host))).otherwise(host)


def second_last_label(host: Column) -> Column:
    """The label before the last dot, or the whole host when it has no dot."""
    return F.substring_index(F.substring_index(host, ".", -2), ".", 1)


def join_url(scheme: Column, netloc: Column, path: Column, params: Column, query: Column,
             fragment: Column) -> Column:
    """Put parts together again, leaving out empty ones."""
    path = F.when(params != "", F.concat(path, F.lit(";"), params)).otherwise(path)
    rooted = F.when((path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    has_authority = (netloc != "") | (scheme.isin("http", "https", "ftp") & ~path.startswith("//"))
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(has_authority, F.concat(F.lit("//"), netloc, rooted)).otherwise(path),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""))
