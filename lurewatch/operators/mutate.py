"""Benign-looking variants of URLs for robustness tests, repeatable by row key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lurewatch.fixed.rules import (
    BENIGN_PATHS, BENIGN_SUBDOMAINS, COMBINED_SKIP, KEYWORD_REPLACEMENT, MUTATIONS, REMOVED_KEYWORDS, SEED)
from lurewatch.functions.keyed import keyed_int, keyed_pick, keyed_uniform
from lurewatch.functions.urlparts import join_url, strip_www, with_url_parts


def _padded_host(key: Column, salt: str, seed: int) -> Column:
    return F.concat(keyed_pick(key, salt, BENIGN_SUBDOMAINS, seed), F.lit("."), strip_www(F.col("_netloc")))


def _diluted_path(path: Column, key: Column, salt: str, seed: int) -> Column:
    """Two different benign paths behind the old one; the draw is one of 5 x 4 ordered pairs."""
    n = len(BENIGN_PATHS)
    draw = keyed_int(key, salt, seed) % (n * (n - 1))
    first = F.floor(draw / (n - 1))
    second = (first + 1 + draw % (n - 1)) % n
    at = lambda i: F.element_at(F.array(*[F.lit(p) for p in BENIGN_PATHS]), (i + 1).cast("int"))
    return F.concat(F.regexp_replace(path, "/+$", ""), F.lit("/"), at(first), F.lit("/"), at(second))


def _plain_path(path: Column) -> Column:
    for word in REMOVED_KEYWORDS:
        path = F.replace(path, F.lit(word), F.lit(KEYWORD_REPLACEMENT))
    return path


def mutations(df: DataFrame, url: str = "url", key: str = "url_id", seed: int = SEED) -> DataFrame:
    """Append one column per mutation kind."""
    keep = df.columns
    k = F.col(key)
    df = with_url_parts(df, url)
    coin = lambda name: keyed_uniform(k, f"combined-{name}", seed) > COMBINED_SKIP
    path = F.col("_path")
    df = df.select(
        "*", _padded_host(k, "subdomain", seed).alias("_h1"), _diluted_path(path, k, "path", seed).alias("_p1"),
        F.when(coin("subdomain"), _padded_host(k, "combined-sub", seed)).otherwise(F.col("_netloc")).alias("_hc"),
        F.when(coin("path"), _diluted_path(path, k, "combined-pair", seed)).otherwise(path).alias("_pc0"),
        coin("keyword").alias("_ck"))
    df = df.withColumn("_pc", F.when(F.col("_ck"), _plain_path(F.col("_pc0"))).otherwise(F.col("_pc0")))

    def rebuild(scheme=F.col("_scheme"), netloc=F.col("_netloc"), path=path):
        return join_url(scheme, netloc, path, F.col("_params"), F.col("_query"), F.col("_fragment"))

    variants = {
        "subdomain_padding": rebuild(netloc=F.col("_h1")),
        "https_laundering": rebuild(scheme=F.lit("https")),
        "path_dilution": rebuild(path=F.col("_p1")),
        "keyword_removal": rebuild(path=_plain_path(path)),
        # with no coin up, the URL stays as it is
        "combined": F.when((F.col("_hc") == F.col("_netloc")) & (F.col("_pc") == path) & ~F.col("_ck"),
                           F.col("_u")).otherwise(rebuild(netloc=F.col("_hc"), path=F.col("_pc"))),
    }
    return df.select(*keep, *[variants[m].alias(m) for m in MUTATIONS])


def mutate_all(df: DataFrame, url: str = "url", key: str = "url_id", seed: int = SEED) -> DataFrame:
    """N rows -> 5 N rows with ``mutation`` and ``mutated_url``."""
    wide = mutations(df, url, key, seed)
    pairs = F.array(*[F.struct(F.lit(m).alias("mutation"), F.col(m).alias("mutated_url")) for m in MUTATIONS])
    return wide.select(*df.columns, F.explode(pairs).alias("_m")).select(*df.columns, "_m.*")
