"""Hybrid scoring: rules first, then the ensemble, then caps, escalation, severity and explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lurewatch.fixed import texts
from lurewatch.fixed.rules import (
    AGREEMENT_BONUS, BOOST_WEIGHT, DECISION, ESCALATION_FLOOR, FOREST_WEIGHT, HIGH_RISK, RULES, SEVERITY,
    SUSPICIOUS, TRUSTED_LIMIT, TRUSTED_SCORE)
from lurewatch.fixed.words import FEATURE_GROUPS, FEATURES, TRUSTED_DOMAINS
from lurewatch.functions.barrier import compute_once
from lurewatch.functions.text import quoted
from lurewatch.functions.urlparts import with_url_parts


def ensemble_score(boosted: Column, forest: Column, weights=(BOOST_WEIGHT, FOREST_WEIGHT)) -> Column:
    return F.lit(weights[0]) * boosted + F.lit(weights[1]) * forest


def is_blank(url: str = "url") -> Column:
    return F.coalesce(F.col(url), F.lit("")).rlike(r"^\s*$")


def is_high_risk(url: str = "url") -> Column:
    return (F.col("layer1_verdict") == HIGH_RISK) & ~is_blank(url)


def with_trusted(df: DataFrame, url: str = "url", strict_host: bool = False) -> DataFrame:
    """Append ``trusted``: the host is a listed domain or a subdomain of one.

    The host is the text before the first ':' of the authority, user info included.
    ``strict_host=True`` drops user info first, so ``google.com:x@evil.com`` is not trusted. Parts that
    ``url_features`` has kept (``_host`` and ``_netloc``) are used and dropped; else the URL is split here.
    """
    keep = [c for c in df.columns if c not in ("_host", "_netloc")]
    if not {"_host", "_netloc"} <= set(df.columns):
        df = with_url_parts(df, url)
    host = F.lower("_host")
    if strict_host:
        host = F.lower(F.substring_index(F.substring_index("_netloc", "@", -1), ":", 1))
    suffix_tests = " OR ".join(f"endswith(_dotted, {quoted(['.' + d])})" for d in TRUSTED_DOMAINS)
    return df.withColumn("_dotted", F.concat(F.lit("."), host)).select(*keep, F.expr(suffix_tests).alias("trusted"))


def severity(score: Column) -> Column:
    chain = F
    for name, lowest in SEVERITY[:-1]:
        chain = chain.when(score >= lowest, name)
    return chain.otherwise(SEVERITY[-1][0])


def severity_scale(score: Column) -> Column:
    return F.round(score * 10, 1)


def _explanation() -> Column:
    three = F.format_string("%.3f", F.col("_l2"))
    listed = F.array_join("rules", ", ")
    rule_texts = F.concat_ws("; ", *[F.when(F.col(f"hit_{r}"), F.lit(f"{d} ({', '.join(t)})"))
                                     for r, _, t, d in RULES])
    return (F.when(F.col("_blank"), texts.EMPTY_URL_TEXT)
            .when(F.col("_high"), F.format_string(texts.BYPASS_TEXT, rule_texts))
            .when(F.col("escalated"), F.format_string(texts.ESCALATED_TEXT, listed, three, F.col("verdict")))
            .otherwise(F.concat_ws(
                " ", F.format_string(texts.SCORE_TEXT, three),
                F.when(F.col("layer1_verdict") == SUSPICIOUS, F.format_string(texts.AGREEMENT_TEXT, listed)),
                F.when(F.col("verdict") == "SAFE", texts.SAFE_TEXT))))


def hybrid_score(hits: DataFrame, layer2: str = "layer2", url: str = "url",
                 strict_host: bool = False) -> DataFrame:
    """Append the score record to a rule table that carries the ensemble score ``layer2``.

    Added: verdict, score, cvss, layer2_score, escalated, explanation, final_score (not rounded),
    trusted. The trusted cap is applied first and then replaced by escalation or agreement, which
    start from the model score again.
    """
    df = with_trusted(hits, url, strict_host)
    df = df.select(
        *[c for c in df.columns if c != layer2], F.col(layer2).cast("double").alias("_l2"),
        is_blank(url).alias("_blank"), is_high_risk(url).alias("_high"),
        (F.col("layer1_verdict") == SUSPICIOUS).alias("_susp"))
    l2, susp = F.col("_l2"), F.col("_susp")
    df = df.withColumn(
        "final_score",
        F.when(F.col("_blank"), F.lit(0.0)).when(F.col("_high"), F.lit(1.0))
        .when(susp & (l2 < DECISION), F.greatest(l2, F.lit(ESCALATION_FLOOR)))
        .when(susp, F.least(l2 + AGREEMENT_BONUS, F.lit(1.0)))
        .when(F.col("trusted") & (l2 > TRUSTED_LIMIT), F.lit(TRUSTED_SCORE)).otherwise(l2))
    df = df.select(
        "*", severity(F.col("final_score")).alias("verdict"), F.round("final_score", 4).alias("score"),
        severity_scale(F.col("final_score")).alias("cvss"),
        F.when(F.col("_blank"), F.lit(0.0)).when(~F.col("_high"), F.round(l2, 4)).alias("layer2_score"),
        F.coalesce(susp & ~F.col("_blank") & (l2 < DECISION), F.lit(False)).alias("escalated"))
    df = df.withColumn("explanation", _explanation()).drop("_l2", "_blank", "_high", "_susp")
    return compute_once(df, ["trusted", "final_score", "verdict", "score", "cvss", "layer2_score", "escalated",
                             "explanation"])


def split_fail_fast(hits: DataFrame, url: str = "url") -> tuple[DataFrame, DataFrame]:
    """(rows decided by rules or blank, rows the models have to see).

    Pass a materialised table, partitioned by the flag ``needs_model`` where possible, so that each
    side reads its own part only.
    """
    if "needs_model" in hits.columns:
        return hits.where(~F.col("needs_model")), hits.where("needs_model")
    decided = is_high_risk(url) | is_blank(url)
    return hits.where(decided), hits.where(~decided)


def _feature_test(feature: str, comparison: str) -> Column:
    return F.expr(f"{feature} {comparison}")


def inferred_techniques(verdict: Column) -> Column:
    """Technique ids read off the features, for rows without a rule hit."""
    none = F.array().cast("array<string>")
    found = F.array_distinct(F.concat(*[
        F.when(_feature_test(f, c), F.array(F.lit(t))).otherwise(none) for f, c, t in texts.INFERRED]))
    return (F.when(F.size(found) > 0, found)
            .when(verdict.isin("CRITICAL", "HIGH", "MEDIUM"), F.array(F.lit(texts.DEFAULT_TECHNIQUE)))
            .otherwise(none))


def final_techniques() -> Column:
    return F.when(F.size("techniques") > 0, F.col("techniques")).otherwise(
        inferred_techniques(F.col("verdict")))


def _filled(template: str, value: Column) -> Column:
    """Put the value into a text at {0}, {2} or {4} decimals."""
    for mark, shown in (("{0}", value.cast("int").cast("string")),
                        ("{2}", F.format_string("%.2f", value.cast("double"))),
                        ("{4}", F.format_string("%.4f", value.cast("double")))):
        if mark in template:
            before, after = template.split(mark)
            return F.concat(F.lit(before), shown, F.lit(after))
    return F.lit(template)


def top_signals(df: DataFrame, key: str = "url_id") -> DataFrame:
    """Up to three suspicious signals per URL in fixed priority order, one row per signal."""
    found = F.array_compact(F.array(*[
        F.when(_feature_test(f, c), F.struct(
            F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"),
            _filled(texts.FEATURE_TEXTS[f][0], F.col(f)).alias("plain"),
            _filled(texts.FEATURE_TEXTS[f][1], F.col(f)).alias("jargon"),
            F.lit(texts.FEATURE_TEXTS[f][2]).alias("technique")))
        for f, c in texts.SIGNALS]))
    ranked = df.select(key, F.posexplode(F.slice(found, 1, texts.SIGNAL_LIMIT)).alias("_p", "signal"))
    return ranked.select(key, (F.col("_p") + 1).alias("rank"), "signal.*")


def technique_info(df: DataFrame, key: str = "url_id", techniques: str = "techniques") -> DataFrame:
    """One row per URL and technique with its texts; an unknown id is its own name."""
    rows = df.select(key, F.posexplode_outer(techniques).alias("_p", "technique")).where("technique is not null")
    dim = df.sparkSession.createDataFrame(
        [(k, *v) for k, v in texts.TECHNIQUES.items()], "technique string, name string, plain string, jargon string")
    joined = rows.join(F.broadcast(dim), "technique", "left")  # six fixed rows
    return joined.select(
        key, (F.col("_p") + 1).alias("rank"), "technique", F.coalesce("name", "technique").alias("name"),
        F.coalesce("plain", F.lit("")).alias("plain"), F.coalesce("jargon", F.lit("")).alias("jargon"))


def verdict_summary(verdict: Column) -> Column:
    chain = F
    for name, text in texts.VERDICT_SUMMARIES.items():
        chain = chain.when(verdict == name, F.lit(text))
    return chain


def feature_map() -> Column:
    return F.map_from_arrays(F.array(*[F.lit(f) for f in FEATURES]),
                             F.array(*[F.col(f).cast("double") for f in FEATURES]))


def features_long(df: DataFrame, key: str = "url_id") -> DataFrame:
    """Feature values as rows with their display group."""
    group = F.create_map(*[F.lit(x) for g, names in FEATURE_GROUPS.items() for n in names for x in (n, g)])
    typed = df.select(key, *[F.col(f).cast("double").alias(f) for f in FEATURES])
    return (typed.unpivot(key, FEATURES, "feature", "value")
            .select(key, group[F.col("feature")].alias("feature_group"), "feature", "value"))
