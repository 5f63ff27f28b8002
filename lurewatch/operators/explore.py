"""Exploration statistics per class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lurewatch.fixed.words import EXPECTED_MEANS, FEATURES


def describe_by_class(df: DataFrame, column: str, digits: int = 2) -> DataFrame:
    """count, mean, std, min, quartiles, max of an integer column.

    Exact quartiles keep one counter per distinct value; lengths and counts have few of them.
    """
    quartiles = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    r = lambda c: F.round(c, digits)
    return df.groupBy("label").agg(
        F.count(column).alias("n"), r(F.avg(column)).alias("mean"), r(F.stddev_samp(column)).alias("std"),
        F.min(column).cast("long").alias("min_value"), quartiles.alias("_q"),
        F.max(column).cast("long").alias("max_value")).select(
        "label", "n", "mean", "std", "min_value", r(F.col("_q")[0]).alias("q25"), r(F.col("_q")[1]).alias("q50"),
        r(F.col("_q")[2]).alias("q75"), "max_value")


def _value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy("label", F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("c"))


def histogram_clipped(df: DataFrame, column: str, top: int = 160, bins: int = 54) -> DataFrame:
    """Even bins from 0 to ``top``; larger values fall into the last bin."""
    cut = F.least(F.col("v"), F.lit(top))
    bin_no = F.least(F.floor(cut * bins / F.lit(float(top))), F.lit(bins - 1)).cast("int")
    return (_value_counts(df, column).groupBy("label", bin_no.alias("bin"))
            .agg(F.sum("c").alias("n")))


def histogram_range(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Even bins over each class's own range; works on value counts, so the table is read once."""
    counts = _value_counts(df, column)
    per_class = W.partitionBy("label")  # one row per distinct value
    ranged = counts.select("*", F.min("v").over(per_class).alias("lo"), F.max("v").over(per_class).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    bin_no = F.when(F.col("hi") == F.col("lo"), 0).otherwise(
        F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    return ranged.groupBy("label", bin_no.alias("bin")).agg(F.sum("c").alias("n"))


def box_plot(df: DataFrame, column: str) -> DataFrame:
    """Quartiles, whiskers (furthest values within 1.5 IQR) and the number of outliers per class."""
    counts = _value_counts(df, column)
    q = counts.groupBy("label").agg(
        F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("c")).alias("_q"))
    j = counts.join(q, "label")
    q1, q3 = F.col("_q")[0], F.col("_q")[2]
    inside = (F.col("v") >= q1 - 1.5 * (q3 - q1)) & (F.col("v") <= q3 + 1.5 * (q3 - q1))
    return j.groupBy("label").agg(
        F.first(q1).alias("q25"), F.first(F.col("_q")[1]).alias("q50"), F.first(q3).alias("q75"),
        F.min(F.when(inside, F.col("v"))).cast("long").alias("whisker_low"),
        F.max(F.when(inside, F.col("v"))).cast("long").alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("c"))), F.lit(0)).alias("outliers"))


def longest(df: DataFrame, n: int = 5) -> DataFrame:
    """The n longest URLs per class; each partition is cut to n rows before the shuffle."""
    sized = df.select("label", "url_id", "url", F.length("url").alias("url_length"))
    first = W.partitionBy("label").orderBy(F.desc("url_length"), "url_id")
    return sized.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n)


def top_values(df: DataFrame, column: str, n: int = 15) -> DataFrame:
    """Most frequent values of a column per class; ties by name."""
    counts = df.groupBy("label", column).agg(F.count(F.lit(1)).alias("n"))
    first = W.partitionBy("label").orderBy(F.desc("n"), column)
    return counts.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n)


def mined_suffix_risk(df: DataFrame, min_count: int = 100, min_share: float = 0.7, top: int = 20) -> DataFrame:
    """Suffixes dominated by phishing."""
    per = df.groupBy("tld").agg(F.count(F.lit(1)).alias("total_count"),
                                F.round(F.avg(F.lit(1) - F.col("label")), 4).alias("legit_share"))
    per = per.withColumn("phishing_share", F.round(F.lit(1.0) - F.col("legit_share"), 4))
    return (per.where((F.col("total_count") >= min_count) & (F.col("phishing_share") >= min_share))
            .orderBy(F.desc("phishing_share"), F.desc("total_count"), "tld").limit(top))


def row_shares(df: DataFrame, column: str) -> DataFrame:
    """Row-normalised label x value table in long form, percent."""
    counts = df.groupBy("label", column).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy("label"))  # one row per distinct value
    return counts.select("label", column, "n", F.round(F.round(share, 4) * 100, 2).alias("pct"))


def https_crosstab(features: DataFrame) -> DataFrame:
    return features.groupBy("label").agg(
        F.round(F.avg(1 - F.col("has_https")) * 100, 2).alias("http_pct"),
        F.round(F.avg("has_https") * 100, 2).alias("https_pct"))


def means_by_class(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    return df.groupBy("label").agg(*[F.round(F.avg(c), digits).alias(c) for c in columns])


def _class_means(features: DataFrame, columns: list[str]) -> DataFrame:
    """feature, phishing mean, legitimate mean. All means come from one aggregation row; turning the
    table into one row per feature first would multiply it by the number of features."""
    y = F.col("label")
    one = features.agg(*[F.avg(F.when(y == v, F.col(c))).alias(f"{c}_{v}") for c in columns for v in (1, 0)])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}_1").alias("phishing"),
                              F.col(f"{c}_0").alias("legitimate")) for c in columns])
    return one.select(F.explode(rows).alias("_r")).select("_r.*")


def feature_means(features: DataFrame) -> DataFrame:
    return _class_means(features, FEATURES).select(
        "feature", F.round("phishing", 4).alias("phishing"), F.round("legitimate", 4).alias("legitimate"))


def drift_check(features: DataFrame, expected: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Class means against stored ones: actual, expected and absolute difference."""
    expected = expected or EXPECTED_MEANS
    pick = F.create_map(*[x for k, v in expected.items() for x in (F.lit(k), F.struct(
        F.lit(float(v[0])).alias("phishing"), F.lit(float(v[1])).alias("legitimate")))])
    df = _class_means(features, list(expected)).withColumn("_e", pick[F.col("feature")])
    out = [F.col("feature")]
    for c in ("phishing", "legitimate"):
        out += [F.round(c, 4).alias(c), F.col(f"_e.{c}").alias(f"{c}_expected"),
                F.round(F.abs(F.col(c) - F.col(f"_e.{c}")), 4).alias(f"{c}_diff")]
    return df.select(*out)


def class_separation(features: DataFrame) -> DataFrame:
    return features.groupBy("label").agg(F.round(F.avg("url_length"), 1).alias("mean_length"),
                                         F.round(F.avg("has_https") * 100, 1).alias("https_pct"))


def findings(df: DataFrame) -> DataFrame:
    """Key statistics of a labelled table in one nested row.

    Needs url, label, url_length, has_https, digit_ratio, alpha_ratio, subdomain_count. Work is one
    aggregation per URL, which also finds duplicates, and one over it.
    """
    measured = ["url_length", "has_https", "digit_ratio", "alpha_ratio", "subdomain_count"]
    per = df.groupBy("url").agg(
        F.count(F.lit(1)).alias("c"), F.count_if(F.col("label") == 1).alias("c1"),
        *[F.first(m).alias(m) for m in measured])  # functions of the URL
    per = per.withColumn("c0", F.col("c") - F.col("c1"))

    def mean(m: Column, w: str, digits: int) -> Column:
        return F.round(F.sum(m * F.col(w)) / F.sum(w), digits)

    def peak(m: str, w: str) -> Column:
        return F.max(F.when(F.col(w) > 0, F.col(m))).cast("long")

    sides = (("phishing", "c1"), ("legitimate", "c0"))
    none = (F.col("subdomain_count") == 0).cast("int")
    return per.agg(
        F.sum("c").alias("total_rows"),
        F.struct(*[F.sum(w).alias(f"{s}_count") for s, w in sides],
                 *[F.round(F.sum(w) * 100.0 / F.sum("c"), 2).alias(f"{s}_pct") for s, w in sides])
        .alias("class_distribution"),
        (F.sum("c") - F.count(F.lit(1))).alias("duplicates"),
        F.struct(*[x for s, w in sides for x in (
            mean(F.col("url_length"), w, 2).alias(f"{s}_mean"), peak("url_length", w).alias(f"{s}_max"))])
        .alias("url_length_stats"),
        F.struct(*[mean(F.col("has_https") * 100, w, 2).alias(f"{s}_pct") for s, w in sides])
        .alias("https_adoption"),
        F.struct(*[F.struct(mean(F.col("digit_ratio"), w, 4).alias("digit_ratio"),
                            mean(F.col("alpha_ratio"), w, 4).alias("alpha_ratio")).alias(s) for s, w in sides])
        .alias("char_ratios"),
        F.struct(*[x for s, w in sides for x in (
            mean(none * 100, w, 2).alias(f"{s}_zero_subdomain_pct"),
            peak("subdomain_count", w).alias(f"{s}_max_subdomains"))]).alias("subdomain_patterns"))
