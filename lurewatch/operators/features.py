"""The 24 URL feature columns as one projection, plus profiles used by exploration."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lurewatch.fixed.suffixes import WILDCARD_SUFFIXES
from lurewatch.fixed.words import (
    DEFAULT_TLD_RISK, FEATURES, LOGIN_KEYWORDS, NO_LABEL_DISTANCE, SECOND_LEVEL_SUFFIXES, SHORTENERS,
    SPOOFED_BRANDS, TLD_RISK, TOP_BRANDS)
from lurewatch.functions import text as T
from lurewatch.functions.urlparts import PART_COLUMNS, second_last_label, strip_www, with_url_parts
from lurewatch.workspace import materialize



def _tld_risk(host: str) -> Column:
    """Lookup of the last two labels (hosts with three or more) and then of the last one."""
    by_risk = defaultdict(list)
    for ending, risk in TLD_RISK.items():
        by_risk[risk].append(ending)
    branches = {n: "CASE " + " ".join(
        f"WHEN substring_index({host}, '.', -{n}) IN ({T.quoted(e)}) THEN {r}D" for r, e in by_risk.items()) + " END"
        for n in (1, 2)}
    dots = f"length({host}) - length(replace({host}, '.', ''))"
    return F.expr(f"CASE WHEN {dots} = 0 THEN {DEFAULT_TLD_RISK}D ELSE coalesce("
                  f"CASE WHEN {dots} >= 2 THEN {branches[2]} END, {branches[1]}, {DEFAULT_TLD_RISK}D) END")


def brand_distance(label: str) -> Column:
    """Smallest edit distance from a domain label (a column name) to the compared brands."""
    each = ", ".join(f"levenshtein({label}, {T.quoted([b])})" for b in TOP_BRANDS)
    return F.expr(f"CASE WHEN {label} = '' THEN {NO_LABEL_DISTANCE} WHEN {label} IN ({T.quoted(TOP_BRANDS)}) THEN 0 "
                  f"ELSE least({each}) END")


def _brand_in_tail() -> Column:
    return F.expr(" OR ".join(f"(contains(_tail, {b}) AND NOT contains(_lnetloc, {b}))"
                              for b in (T.quoted([w]) for w in SPOOFED_BRANDS)))


def _domain_label() -> Column:
    return second_last_label(strip_www(F.lower("_host")))


def brand_distance_cache(urls: DataFrame, url: str = "url", max_labels: int = 100_000) -> DataFrame:
    """Distances of the most frequent domain labels: ``_label, _distance``, at most ``max_labels`` rows.

    Edit distances are the costliest feature, and domain labels follow a steep popularity curve. The
    cache is only a shortcut: labels outside it are computed in place, so any ``urls`` (a sample, or
    yesterday's table) gives the same feature values. It is written to the shared folder, so that
    jobs that use it do not count labels again.
    """
    labels = with_url_parts(urls.select(url), url).select(_domain_label().alias("_label"))
    top = labels.groupBy("_label").count().orderBy(F.desc("count"), "_label").limit(max_labels)
    return materialize(top.select("_label", brand_distance("_label").alias("_distance")), "brand-distance")


def _with_work_columns(df: DataFrame, url: str) -> DataFrame:
    df = with_url_parts(df, url)
    df = df.select(
        "*",
        F.lower("_host").alias("_lhost"),
        strip_www(F.col("_host")).alias("_host_nw"),
        _domain_label().alias("_label"),
        T.without_alphanumerics(F.col("_u")).alias("_special"),
        T.digit_count(F.col("_u")).alias("_digits"),
        F.lower(F.concat("_path", "_query", "_fragment")).alias("_tail"))
    return df.withColumn(
        "_decoded", F.when(F.col("_u").contains("%"), T.percent_decode(F.col("_u"))).otherwise(F.col("_u")))


def url_features(df: DataFrame, url: str = "url", cache: DataFrame | None = None, parts: tuple[str, ...] = ()) -> DataFrame:
    """Append the 24 feature columns to ``df``. No shuffle, no Python worker.

    NULL and empty URLs give zeros. ``cache`` is an optional table from ``brand_distance_cache``. ``parts`` are
    URL parts to keep, such as ``_netloc``, so that later steps need not split the URL again.
    """
    keep = df.columns
    df = _with_work_columns(df, url)
    if cache is not None:
        df = df.join(cache, "_label", "left")
        distance = F.coalesce(F.col("_distance"), brand_distance("_label"))
    else:
        distance = brand_distance("_label")

    u, special, length = F.col("_u"), F.col("_special"), F.length("_u")
    lower, lhost, host_nw = F.lower("_u"), F.col("_lhost"), F.col("_host_nw")
    empty = u == ""
    df = df.withColumn("_lnetloc", F.lower("_netloc"))
    values = {
        "url_length": length,
        "qty_dot": T.count_char(special, "."),
        "qty_hyphen": T.count_char(special, "-"),
        "qty_slash": T.count_char(special, "/"),
        "qty_at": T.count_char(special, "@"),
        "qty_question": T.count_char(special, "?"),
        "qty_equal": T.count_char(special, "="),
        "qty_percent": T.count_char(special, "%"),
        "domain_length": F.length(second_last_label(host_nw)),
        "tld_length": F.when(F.col("_host").contains("."), F.length(F.substring_index("_host", ".", -1)))
        .otherwise(0),
        "url_entropy": T.entropy(u),
        "domain_entropy": T.entropy(host_nw),
        "digit_ratio": T.ratio(F.col("_digits"), length),
        "alpha_ratio": T.ratio(length - F.col("_digits") - F.length("_special"), length),
        "char_continuation_rate": T.ratio(F.when(length < 2, 0).otherwise(T.class_runs(u) - 1), length),
        "has_https": lower.startswith("https://").cast("int"),
        "has_shortener": strip_www(lhost).isin(SHORTENERS).cast("int"),
        "has_login_keyword": T.contains_any("lower(_u)", LOGIN_KEYWORDS).cast("int"),
        "is_ip": (F.col("_valid") & (
            host_nw.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$")
            | host_nw.rlike(r"^(?:0x[0-9a-fA-F]+\.){3}0x[0-9a-fA-F]+$")
            | (F.col("_netloc").contains("[") & F.col("_netloc").contains("]")))).cast("int"),
        "brand_in_path_not_domain": (F.col("_valid") & _brand_in_tail()).cast("int"),
        "recursive_decode_depth": T.decode_depth(u, F.col("_decoded")),
        "idn_homograph_flag": lhost.contains("xn--").cast("int"),
        "levenshtein_min": F.when(empty, 0).otherwise(distance),
        "tld_risk_score": F.when(empty, F.lit(0.0)).otherwise(_tld_risk("_lhost")),
    }
    return df.select(*keep, *parts, *[values[name].alias(name) for name in FEATURES])


def check_feature_columns(df: DataFrame, extra_allowed: tuple[str, ...] = ()) -> dict[str, list[str]]:
    """Missing and unexpected columns of a feature table, from its schema alone."""
    have = set(df.columns)
    return {"missing": [f for f in FEATURES if f not in have],
            "extra": sorted(have - set(FEATURES) - set(extra_allowed))}


def char_profile(df: DataFrame, url: str = "url") -> DataFrame:
    """Unrounded shares of digits, letters and other characters; zeros for an empty URL."""
    keep = df.columns
    df = df.withColumn("_u", F.coalesce(F.col(url), F.lit("")))
    df = df.select("*", F.length("_u").alias("_n"), T.digit_count(F.col("_u")).alias("_d"),
                   F.length(T.without_alphanumerics(F.col("_u"))).alias("_s"))
    part = lambda c: F.when(F.col("_n") == 0, F.lit(0.0)).otherwise(c / F.col("_n"))
    return df.select(*keep, part(F.col("_d")).alias("digit_ratio"),
                     part(F.col("_n") - F.col("_d") - F.col("_s")).alias("alpha_ratio"),
                     part(F.col("_s")).alias("special_ratio"))


BUILT_IN_SUFFIXES = [*TLD_RISK, *SECOND_LEVEL_SUFFIXES, *WILDCARD_SUFFIXES]


def suffix_dimension(spark: SparkSession) -> DataFrame:
    """suffix: the endings of the risk table, common second-level registries and wildcard rules."""
    return spark.createDataFrame([(s,) for s in BUILT_IN_SUFFIXES], "suffix string")


def suffix_rules(suffixes: DataFrame) -> DataFrame:
    """One row per name in the rules: ``name, labels`` and whether it ``ends`` a suffix itself, has a wildcard
    ``below`` it, or is ``excepted`` from the wildcard above it. Rules are lower case; a wildcard is their first label."""
    name = F.regexp_replace("suffix", r"^(?:\*\.|!)", "")
    below, excepted = F.col("suffix").startswith("*."), F.col("suffix").startswith("!")
    return (suffixes.where("suffix <> ''").groupBy(name.alias("name"))
            .agg(F.bool_or(~below & ~excepted).alias("ends"), F.bool_or(below).alias("below"),
                 F.bool_or(excepted).alias("excepted"))
            .withColumn("labels", T.count_char(F.col("name"), ".") + 1))


def _rules_by_join(df: DataFrame, suffixes: DataFrame) -> tuple[DataFrame, dict[int, tuple[Column, Column, Column]]]:
    """Look the last k labels of ``_h`` up among the rules of k labels, for every k that has rules."""
    rules, found = suffix_rules(suffixes), {}
    for k in sorted(r.labels for r in rules.select("labels").distinct().collect()):  # a host has at most 127 labels
        kinds = {kind: f"_{kind}{k}" for kind in ("ends", "below", "excepted")}
        level = rules.where(F.col("labels") == k).select(
            F.col("name").alias(f"_name{k}"), *[F.col(kind).alias(n) for kind, n in kinds.items()])
        df = df.withColumn(f"_name{k}", F.substring_index("_h", ".", -k)).join(level, f"_name{k}", "left")
        found[k] = tuple(F.coalesce(F.col(n), F.lit(False)) & (F.col("_nlabels") >= k) for n in kinds.values())
    return df, found


def _built_in_rules() -> dict[int, tuple[Column, Column, Column]]:
    """The same for the built-in rules, as literals."""
    by_level = defaultdict(lambda: ([], [], []))
    for rule in BUILT_IN_SUFFIXES:
        name = rule.removeprefix("*.").removeprefix("!")
        by_level[name.count(".") + 1][1 if rule.startswith("*.") else 2 if rule.startswith("!") else 0].append(name)
    return {k: tuple(F.substring_index("_h", ".", -k).isin(names) & (F.col("_nlabels") >= k) if names else F.lit(False)
                     for names in kinds) for k, kinds in sorted(by_level.items())}


def host_parts(df: DataFrame, url: str = "url", suffixes: DataFrame | None = None) -> DataFrame:
    """Public suffix, registered-domain length and subdomain count.

    Suffix rules are those of the public suffix list: a plain rule names a suffix of any number of labels, ``*.x``
    makes every label below ``x`` one, and ``!y.x`` takes ``y`` out again. An exception beats all rules, else the
    rule of most labels wins; a host without a rule ends in a one-label suffix, or in none if it is a single label.
    ``suffixes`` is a table with such rules in a ``suffix`` column, joined once per number of labels; its size
    decides how. Without it the built-in rules are literals.
    """
    keep = df.columns
    df = with_url_parts(df, url)
    # The real host: user info, port and a trailing dot removed.
    df = df.withColumn("_h", F.regexp_replace(
        F.substring_index(F.lower(F.substring_index("_netloc", "@", -1)), ":", 1), r"\.$", ""))
    df = df.withColumn("_ip", F.col("_h").rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$") | (F.col("_h") == ""))
    df = df.withColumn("_nlabels", T.count_char(F.col("_h"), ".") + 1)
    if suffixes is None:
        found = _built_in_rules()
    else:
        df, found = _rules_by_join(df, suffixes)
    excepted = F.coalesce(*[F.when(out, k - 1) for k, (_, _, out) in sorted(found.items(), reverse=True)], F.lit(None))
    fits = [F.when(ends, k) for k, (ends, _, _) in found.items()]
    fits += [F.when(below & (F.col("_nlabels") > k), k + 1) for k, (_, below, _) in found.items()]
    size = F.when(F.col("_ip"), 0).otherwise(
        F.coalesce(excepted, F.greatest(*fits, F.when(F.col("_nlabels") >= 2, 1).otherwise(0), F.lit(0))))
    df = df.withColumn("_size", size)
    df = df.withColumn("tld", F.when(F.col("_size") == 0, "")
                       .otherwise(F.expr("substring_index(_h, '.', -_size)")))
    # What is left of the suffix: subdomains and the registered name.
    df = df.withColumn("_left", F.when(F.col("_size") == 0, F.col("_h")).otherwise(
        F.expr("substring(_h, 1, greatest(length(_h) - length(tld) - 1, 0))")))
    whole = F.col("_ip") | (F.col("_left") == "")
    sub = F.when(whole, 0).otherwise(T.count_char(F.col("_left"), "."))
    return df.select(
        *keep, "tld",
        F.when(F.col("_ip"), F.length("_h")).otherwise(F.length(F.substring_index("_left", ".", -1)))
        .alias("reg_domain_length"),
        sub.alias("subdomain_count"), (sub > 0).cast("int").alias("has_subdomain"))


def simple_features(df: DataFrame, url: str = "url") -> DataFrame:
    """The ten-column subset of cheap lexical features."""
    keep = df.columns
    df = with_url_parts(df, url)
    u = F.col("_u")
    values = {
        "url_length": F.length("_u"), "netloc_length": F.length("_netloc"), "path_length": F.length("_path"),
        "num_dots": T.count_char(u, "."), "num_hyphens": T.count_char(u, "-"),
        "num_slashes": T.count_char(u, "/"), "num_digits": T.digit_count(u),
        "has_https": u.startswith("https").cast("int"), "has_at": u.contains("@").cast("int"),
        "digit_in_first_label": (T.digit_count(F.substring_index("_netloc", ".", 1)) > 0).cast("int"),
    }
    # A host with unbalanced brackets cannot be parsed and gives zeros.
    return df.select(*keep, *[F.when(F.col("_valid"), c).otherwise(0).alias(n) for n, c in values.items()])


def quarantine(df: DataFrame, url: str = "url") -> DataFrame:
    """Tag rows that cannot be analysed in full; nothing raises and no row is lost."""
    keep = df.columns
    df = with_url_parts(df, url)
    reason = (F.when(F.col(url).isNull(), "null_url").when(F.col(url) == "", "empty_url")
              .when(F.trim(F.translate("_u", "\t\r\n", "   ")) == "", "blank_url")
              .when(~F.col("_valid"), "unbalanced_brackets")
              .when(F.col("_netloc") == "", "no_host"))
    return df.select(*keep, reason.alias("error"))
