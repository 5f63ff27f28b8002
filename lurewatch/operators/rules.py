"""Eight technique-tagged rules over the feature table, their verdict and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lurewatch.fixed.rules import (
    AITM_PATTERNS, CLEAN, DECODE_DEPTH_MIN, HIGH_RISK, LAYER1_VERDICTS, RULE_NAMES, RULES, SUSPICIOUS,
    TLD_RISK_MIN, TYPOSQUAT_DISTANCE)
from lurewatch.fixed.texts import NO_RULE_TEXT
from lurewatch.functions.barrier import compute_once
from lurewatch.functions.text import quoted


def rule_dimension(spark) -> DataFrame:
    return spark.createDataFrame(
        [(i, *rule) for i, rule in enumerate(RULES)],
        "rule_order int, rule string, severity string, techniques array<string>, description string")


def _predicates(url: str) -> dict[str, Column]:
    c = F.col
    return {
        "ip_url": c("is_ip") == 1,
        "idn_punycode": c("idn_homograph_flag") == 1,
        "multi_encoded": c("recursive_decode_depth") >= DECODE_DEPTH_MIN,
        "aitm_pattern": F.coalesce(c(url), F.lit("")).rlike("(?i)" + "|".join(AITM_PATTERNS)),
        "brand_spoof_sus_tld": (c("brand_in_path_not_domain") == 1) & (c("tld_risk_score") >= TLD_RISK_MIN),
        "ip_with_login": (c("is_ip") == 1) & (c("has_login_keyword") == 1),
        "embedded_credentials": c("qty_at") >= 1,
        "typosquat": c("levenshtein_min") == TYPOSQUAT_DISTANCE,
    }


def _hit(rule: str) -> Column:
    return F.col(f"hit_{rule}")


def rule_hits(features: DataFrame, url: str = "url") -> DataFrame:
    """Append ``hit_<rule>`` flags, ``rules``, ``techniques`` and ``layer1_verdict``; one projection."""
    flagged = features.select("*", *[p.alias(f"hit_{r}") for r, p in _predicates(url).items()])
    none = F.array().cast("array<string>")
    any_hit = F.expr(" OR ".join(f"hit_{r}" for r in RULE_NAMES))
    high = F.expr(" OR ".join(f"hit_{r}" for r, severity, _, _ in RULES if severity == HIGH_RISK))
    lists = lambda pick: "concat(" + ", ".join(
        f"if(hit_{rule[0]}, array({quoted(pick(rule))}), array())" for rule in RULES) + ")"
    names = F.expr(lists(lambda rule: [rule[0]]))
    techniques = F.expr(f"array_distinct({lists(lambda rule: rule[2])})")
    ruled = flagged.select(
        "*", F.when(any_hit, names).otherwise(none).alias("rules"),
        F.when(any_hit, techniques).otherwise(none).alias("techniques"),
        F.when(high, HIGH_RISK).when(any_hit, SUSPICIOUS).otherwise(CLEAN).alias("layer1_verdict"))
    return compute_once(ruled, [*[f"hit_{r}" for r in RULE_NAMES], "rules", "techniques", "layer1_verdict"])


def rule_explanation(url: str = "url") -> Column:
    """One text per URL: verdict and a line per triggered rule. Built in the row, so nothing shuffles."""
    lines = [F.when(_hit(r), F.lit(f"  - [{severity}] {r}: {text} ({', '.join(tech)})"))
             for r, severity, tech, text in RULES]
    return F.concat_ws(
        "\n",
        F.concat(F.lit("URL: "), F.substring(F.coalesce(F.col(url), F.lit("")), 1, 100)),
        F.concat(F.lit("Verdict: "), F.col("layer1_verdict")),
        F.when(F.col("layer1_verdict") == CLEAN, NO_RULE_TEXT).otherwise("Triggered rules:"),
        *lines)


def coverage(hits: DataFrame) -> DataFrame:
    """Rows and percentage per verdict; verdicts without rows are listed with 0. One aggregation row."""
    one = hits.agg(F.count(F.lit(1)).alias("_n"),
                   *[F.count_if(F.col("layer1_verdict") == v).alias(v) for v in LAYER1_VERDICTS])
    return one.unpivot("_n", LAYER1_VERDICTS, "verdict", "n").select(
        "verdict", "n", F.round(F.col("n") * 100.0 / F.col("_n"), 2).alias("pct"))


def crosstab(hits: DataFrame) -> DataFrame:
    """label x verdict counts with margins; ``label`` is 'All' in the total row."""
    cells = [F.count_if(F.col("layer1_verdict") == v).alias(v.lower()) for v in LAYER1_VERDICTS]
    return (hits.rollup("label").agg(*cells, F.count(F.lit(1)).alias("total"), F.grouping("label").alias("_g"))
            .select(F.when(F.col("_g") == 1, "All").otherwise(F.col("label").cast("string")).alias("label"),
                    *[v.lower() for v in LAYER1_VERDICTS], "total"))


def class_rates(hits: DataFrame) -> DataFrame:
    """Share of each class per verdict: recall for phishing, false-positive rates for legitimate."""
    n = F.count(F.lit(1))
    return hits.groupBy("label").agg(
        n.alias("total"),
        *[F.count_if(F.col("layer1_verdict") == v).alias(v.lower()) for v in LAYER1_VERDICTS],
        *[F.round(F.count_if(F.col("layer1_verdict") == v) * 100.0 / n, 4).alias(f"{v.lower()}_pct")
          for v in LAYER1_VERDICTS])


def workload(hits: DataFrame) -> DataFrame:
    """How many URLs the rules decide and how many go on to the models."""
    decided, n = F.count_if(F.col("layer1_verdict") == HIGH_RISK), F.count(F.lit(1))
    return hits.agg(decided.alias("decided"), (n - decided).alias("passed_on"),
                    F.round(decided * 100.0 / n, 2).alias("decided_pct"),
                    F.round(100.0 - decided * 100.0 / n, 2).alias("passed_on_pct"))


def hit_counts(hits: DataFrame) -> DataFrame:
    """Hits per rule, rules without hits included. One aggregation row, then turned into rows."""
    one = hits.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(_hit(r)).alias(r) for r in RULE_NAMES])
    severity = F.create_map(*[F.lit(x) for r, s, _, _ in RULES for x in (r, s)])
    return (one.unpivot("_n", RULE_NAMES, "rule", "hits")
            .select("rule", severity[F.col("rule")].alias("severity"), "hits",
                    F.round(F.col("hits") * 100.0 / F.col("_n"), 3).alias("pct")))


def technique_counts(hits: DataFrame) -> DataFrame:
    """Rows per technique id, most frequent first. The registry names all techniques there can be."""
    known = sorted({t for _, _, techniques, _ in RULES for t in techniques})
    one = hits.agg(F.count(F.lit(1)).alias("_n"),
                   *[F.count_if(F.array_contains("techniques", t)).alias(t) for t in known])
    return (one.unpivot("_n", [f"`{t}`" for t in known], "technique", "hits").where("hits > 0")
            .select("technique", "hits", F.round(F.col("hits") * 100.0 / F.col("_n"), 3).alias("pct"))
            .orderBy(F.desc("hits"), "technique"))
