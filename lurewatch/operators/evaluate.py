"""Evaluation and audit of predictions: metrics, curves, tests, leakage, hold-out and robustness."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lurewatch.fixed.rules import DECISION, DETECTED_VERDICTS, HIGH_RISK, VERDICTS
from lurewatch.fixed.words import FEATURES
from lurewatch.functions.ordered import running_totals
from lurewatch.operators.features import url_features
from lurewatch.operators.mutate import mutate_all
from lurewatch.operators.rules import rule_hits
from lurewatch.workspace import materialize

METRICS = ["accuracy", "precision", "recall", "f1", "mcc"]


def predictions_long(wide: DataFrame, scores: dict[str, str], keep: list[str]) -> DataFrame:
    """One row per URL and model: ``keep`` columns, model, proba, pred (1 from 0.5 up)."""
    items = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("proba"))
                      for m, c in scores.items()])
    return (wide.select(*keep, F.explode(items).alias("_x")).select(*keep, "_x.*")
            .withColumn("pred", (F.col("proba") >= DECISION).cast("int")))


def _counts() -> list[Column]:
    y, p = F.col("label"), F.col("pred")
    return [F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
            F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp")]


def confusion(pred: DataFrame, by: list[str]) -> DataFrame:
    return pred.groupBy(*by).agg(*_counts())


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def _metrics_of(counts: DataFrame, by: list[str], digits: int) -> DataFrame:
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    values = {
        "accuracy": _share(tp + tn, tp + tn + fp + fn), "precision": _share(tp, tp + fp),
        "recall": _share(tp, tp + fn), "f1": _share(2 * tp, 2 * tp + fp + fn),
        "mcc": _share(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)),
    }
    return counts.select(*by, *[F.round(v, digits).alias(m) for m, v in values.items()])


def metrics(pred: DataFrame, by: list[str], digits: int = 4) -> DataFrame:
    """accuracy, precision, recall, F1 and MCC per group from one pass of conditional counts."""
    return _metrics_of(confusion(pred, by), by, digits)


def _score_table(pred: DataFrame, by: list[str]) -> DataFrame:
    """Positives and negatives per distinct score, written out: the steps that follow read this table
    several times, and the predictions behind it should be computed once."""
    return materialize(pred.groupBy(*by, "proba").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")), "scores")


def _auc_of(table: DataFrame, by: list[str], digits: int) -> DataFrame:
    ranked = running_totals(table, by, "proba", ["pos"])
    wins = F.sum(F.col("neg") * (F.col("before_pos") + F.col("pos") / F.lit(2.0)))
    return ranked.groupBy(*by).agg(
        F.round(_share(wins, F.sum("pos").cast("double") * F.sum("neg")), digits).alias("roc_auc"))


def roc_auc(pred: DataFrame, by: list[str], digits: int = 4) -> DataFrame:
    """Exact area under the ROC curve; tied scores count half."""
    return _auc_of(_score_table(pred, by), by, digits)


def roc_curve(pred: DataFrame, by: list[str], max_fpr: float | None = None) -> DataFrame:
    """(fpr, tpr) at every distinct threshold; ``max_fpr`` zooms into the left end."""
    ranked = running_totals(_score_table(pred, by), by, "proba", ["pos", "neg"])
    sizes = ranked.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    curve = ranked.join(sizes, by).select(
        *by, F.col("proba").alias("threshold"),
        F.round(_share(F.col("before_neg") + F.col("neg"), F.col("_n")), 6).alias("fpr"),
        F.round(_share(F.col("before_pos") + F.col("pos"), F.col("_p")), 6).alias("tpr"))
    return curve if max_fpr is None else curve.where(F.col("fpr") <= max_fpr)


def full_metrics(pred: DataFrame, by: list[str]) -> DataFrame:
    """All metrics and the AUC per group (``pred`` being ``proba`` >= 0.5); predictions are computed once."""
    table = _score_table(pred, by)
    high = F.col("proba") >= DECISION
    total = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    counts = table.groupBy(*by).agg(total("neg", ~high).alias("tn"), total("neg", high).alias("fp"),
                                    total("pos", ~high).alias("fn"), total("pos", high).alias("tp"))
    return _metrics_of(counts, by, 4).join(_auc_of(table, by, 4), by)


def model_comparison(pred: DataFrame, by: str = "model") -> DataFrame:
    """model x metric in long form, with every model's rank per metric."""
    long = full_metrics(pred, [by]).unpivot(by, METRICS + ["roc_auc"], "metric", "value")
    best = W.partitionBy("metric").orderBy(F.desc("value"))  # one row per model
    return long.withColumn("rank", F.rank().over(best))


def classification_report(pred: DataFrame, by: list[str]) -> DataFrame:
    """Per-class rows plus accuracy, macro and weighted averages."""
    c = {n: F.col(n).cast("double") for n in ("tn", "fp", "fn", "tp")}

    def row(name, tp, fp, fn):
        return F.struct(F.lit(name).alias("row"), _share(tp, tp + fp).alias("precision"),
                        _share(tp, tp + fn).alias("recall"), _share(2 * tp, 2 * tp + fp + fn).alias("f1"),
                        (tp + fn).cast("long").alias("support"))

    base = confusion(pred, by).select(*by, row("Legitimate", c["tn"], c["fn"], c["fp"]).alias("a"),
                                      row("Phishing", c["tp"], c["fp"], c["fn"]).alias("b"),
                                      _share(c["tp"] + c["tn"], reduce(lambda x, y: x + y, c.values())).alias("_acc"))
    total = F.col("a.support") + F.col("b.support")

    def average(name, combine):
        return F.struct(F.lit(name).alias("row"),
                        *[combine(F.col(f"a.{m}"), F.col(f"b.{m}")).alias(m) for m in ("precision", "recall", "f1")],
                        total.alias("support"))

    rows = F.array(
        F.col("a"), F.col("b"), average("accuracy", lambda x, y: F.col("_acc")),
        average("macro avg", lambda x, y: (x + y) / 2),
        average("weighted avg", lambda x, y: (x * F.col("a.support") + y * F.col("b.support")) / total))
    return base.select(*by, F.explode(rows).alias("_r")).select(
        *by, "_r.row", *[F.round(f"_r.{m}", 4).alias(m) for m in ("precision", "recall", "f1")], "_r.support")


def chi_square_tail(x: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom, from the series of the error function.

    All terms are positive, so there is no cancellation; beyond 70 the tail is below 1e-16.
    """
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(200)),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
        lambda s, n: F.struct((s["term"] * x / (2 * n + 1)).alias("term"),
                              (s["total"] + s["term"] * x / (2 * n + 1)).alias("total")),
        lambda s: s["total"])
    return F.when(x > 70, F.lit(0.0)).when(x <= 0, F.lit(1.0)).otherwise(
        F.lit(1.0) - F.sqrt(F.lit(2.0) * x / F.pi()) * F.exp(-x / 2) * series)


def mcnemar(wide: DataFrame, pairs: list[tuple[str, str, str, str]]) -> DataFrame:
    """Paired comparison with continuity correction.

    ``wide`` holds label and one 0/1 prediction column per model; a pair is (name a, column a, name b,
    column b). All pairs share one aggregation over the table.
    """
    sums = []
    for i, (_, a, _, b) in enumerate(pairs):
        right_a, right_b = F.col(a) == F.col("label"), F.col(b) == F.col("label")
        sums += [F.count_if(right_a & ~right_b).alias(f"b{i}"), F.count_if(~right_a & right_b).alias(f"c{i}")]
    one = wide.agg(*sums)
    rows = F.array(*[F.struct(F.lit(f"{n} vs {m}").alias("comparison"), F.lit(n).alias("_na"), F.lit(m).alias("_nb"),
                              F.col(f"b{i}").alias("b_count"), F.col(f"c{i}").alias("c_count"))
                     for i, (n, _, m, _) in enumerate(pairs)])
    df = one.select(F.explode(rows).alias("_r")).select("_r.*")
    differ = F.col("b_count") + F.col("c_count")
    df = df.withColumn("_chi", F.when(differ == 0, F.lit(0.0)).otherwise(
        F.pow(F.abs(F.col("b_count") - F.col("c_count")) - 1.0, 2) / differ))
    df = df.withColumn("_p", chi_square_tail(F.col("_chi")))
    significant = F.col("_p") < 0.05
    return df.select(
        "comparison", "b_count", "c_count", F.round("_chi", 4).alias("chi_squared"),
        F.round("_p", 6).alias("p_value"), significant.alias("significant"),
        F.when(~significant, "none").when(F.col("b_count") > F.col("c_count"), F.col("_na"))
        .otherwise(F.col("_nb")).alias("better"))


# ---- feature-vector audits ------------------------------------------------------------------

def vector_counts(split: DataFrame) -> DataFrame:
    """Train and test rows per distinct feature vector. Copies combine before the shuffle, so one vector
    shared by a third of the rows is no hot spot, and no self-join is needed."""
    return split.groupBy(*FEATURES).agg(F.count_if(F.col("split") == "train").alias("n_train"),
                                        F.count_if(F.col("split") == "test").alias("n_test"))


def leakage(split: DataFrame) -> DataFrame:
    """Rows, distinct vectors, duplicates and test rows whose vector occurs in train; one row."""
    sizes = vector_counts(split).agg(
        F.sum("n_train").alias("train_rows"), F.sum("n_test").alias("test_rows"),
        F.count_if(F.col("n_train") > 0).alias("distinct_train_vectors"),
        F.count_if(F.col("n_test") > 0).alias("distinct_test_vectors"),
        F.sum(F.when(F.col("n_train") > 0, F.col("n_test")).otherwise(0)).alias("leaked_test_rows"))
    pct = lambda a, b: F.round(F.col(a) * 100.0 / F.col(b), 1)
    return (sizes.withColumn("leaked_test_pct", pct("leaked_test_rows", "test_rows"))
            .withColumn("train_duplicate_rows", F.col("train_rows") - F.col("distinct_train_vectors"))
            .withColumn("test_duplicate_rows", F.col("test_rows") - F.col("distinct_test_vectors"))
            .withColumn("train_duplicate_pct", pct("train_duplicate_rows", "train_rows"))
            .withColumn("test_duplicate_pct", pct("test_duplicate_rows", "test_rows")))


def stratification(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("n"),
                                      F.round(F.avg("label"), 4).alias("phishing_ratio"))


def collision_free(split: DataFrame) -> DataFrame:
    """Test rows whose feature vector does not occur in train. The train side is reduced to distinct
    vectors first, so only the test side can be skewed and adaptive execution may split it."""
    vectors = split.where("split = 'train'").select(*FEATURES).distinct()
    return split.where("split = 'test'").join(vectors, FEATURES, "left_anti").select(split.columns)


def collision_summary(split: DataFrame) -> DataFrame:
    """Size of the collision-free subset and the overlap in percent, from vector counts."""
    v = vector_counts(split).agg(
        F.sum("n_test").alias("total_test_rows"),
        F.sum(F.when(F.col("n_train") == 0, F.col("n_test")).otherwise(0)).alias("collision_free_rows"))
    free = F.col("collision_free_rows") * 100.0 / F.col("total_test_rows")
    return v.select("*", F.round(free, 1).alias("collision_free_pct"),
                    F.round(100.0 - free, 1).alias("feature_overlap_pct"))


# ---- hold-out, robustness, bias -------------------------------------------------------------

def holdout_results(scored: DataFrame, url: str = "url", error: str | None = None) -> DataFrame:
    """Flat result rows of a blind run. Rows with an ``error`` text stay, as verdict ERROR."""
    failed = F.col(error).isNotNull() if error else F.lit(False)
    none = lambda c: F.when(~failed, c)
    return scored.select(
        "url_id", F.substring(url, 1, 150).alias("url"),
        F.when(failed, "ERROR").otherwise(F.col("verdict")).alias("verdict"),
        none(F.col("score")).alias("score"), none(F.col("cvss")).alias("cvss"),
        F.when(failed, "ERROR").otherwise(F.col("layer1_verdict")).alias("layer1"),
        none(F.col("layer2_score")).alias("layer2_score"),
        (F.col("escalated") & ~failed).alias("escalated"),
        F.when(failed, "").otherwise(F.array_join("techniques", ",")).alias("mitre"),
        F.when(failed, F.substring(error, 1, 50) if error else F.lit(""))
        .otherwise(F.array_join("rules", ",")).alias("rules"))


def holdout_summary(results: DataFrame) -> DataFrame:
    """(section, item, n, pct): totals, all five verdict levels, detection and the rule-layer split."""
    levels = VERDICTS + ["ERROR"]
    layers = ["HIGH_RISK", "SUSPICIOUS", "CLEAN", "ERROR"]
    one = results.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("verdict") == v).alias(f"v_{v}") for v in levels],
        *[F.count_if(F.col("layer1") == v).alias(f"l_{v}") for v in layers],
        F.count_if("escalated").alias("escalated"))
    valid = F.col("total") - F.col("v_ERROR")
    detected = reduce(lambda a, b: a + b, [F.col(f"v_{v}") for v in DETECTED_VERDICTS])
    item = lambda s, i, n, whole: F.struct(
        F.lit(s).alias("section"), F.lit(i).alias("item"), n.cast("long").alias("n"),
        F.round(_share(n * 100.0, whole), 2).alias("pct"))
    rows = [item("rows", "total", F.col("total"), F.col("total")), item("rows", "valid", valid, F.col("total")),
            item("rows", "errors", F.col("v_ERROR"), F.col("total")),
            *[item("verdict", v, F.col(f"v_{v}"), F.col("total")) for v in VERDICTS],
            item("detection", "detected", detected, valid), item("detection", "missed", valid - detected, valid),
            item("detection", "escalated", F.col("escalated"), valid),
            *[item("layer1", v, F.col(f"l_{v}"), F.col("total")) for v in layers]]
    return one.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def adversarial_results(seeds: DataFrame, score: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    """Every URL against every mutation, judged before and after.

    ``seeds`` has url_id and url. ``score(df, mutated)`` appends ``ml_score`` to a feature table; on
    mutated rows a ``mutation`` column is present. One pass: rows fan out fivefold, nothing joins.
    """
    found = (F.col("layer1_verdict") == HIGH_RISK) | (F.col("ml_score") >= DECISION)
    before = score(rule_hits(url_features(seeds.select("url_id", "url"))), False).select(
        "url_id", "url", F.col("ml_score").alias("_s0"), F.col("layer1_verdict").alias("heuristic_before"),
        found.alias("detected_before"))
    after = score(rule_hits(url_features(mutate_all(before), "mutated_url"), "mutated_url"), True)
    return after.select(
        "url_id", F.col("url").alias("original_url"), "mutated_url", "mutation",
        F.round("_s0", 4).alias("score_before"), F.round("ml_score", 4).alias("score_after"),
        F.round(F.col("_s0") - F.col("ml_score"), 4).alias("score_drop"),
        "heuristic_before", F.col("layer1_verdict").alias("heuristic_after"),
        "detected_before", found.alias("detected_after"),
        (F.col("detected_before") & ~found).alias("evaded"))


def adversarial_summary(results: DataFrame) -> DataFrame:
    """Per mutation and, in the row 'all', overall: mean drop, detection, evasion, retention."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 4)
    return (results.rollup("mutation").agg(
        F.grouping("mutation").alias("_g"), F.count(F.lit(1)).alias("n"), rate("score_drop").alias("avg_score_drop"),
        rate("detected_after").alias("detection_rate"), rate("evaded").alias("evasion_rate"),
        F.round(1 - F.avg(F.col("evaded").cast("double")), 4).alias("retention"))
        .select(F.when(F.col("_g") == 1, "all").otherwise(F.col("mutation")).alias("mutation"), "n",
                "avg_score_drop", "detection_rate", "evasion_rate", "retention"))


def bias_results(scored: DataFrame, expected: str = "expected", score: str = "ml_score") -> DataFrame:
    """Expected against obtained class per URL and the kind of mistake."""
    got = F.when(F.col(score) >= DECISION, "PHISHING").otherwise("LEGIT")
    return scored.withColumn("got", got).withColumn(
        "outcome", F.when(F.col("got") == F.col(expected), "pass")
        .when(F.col(expected) == "LEGIT", "false_positive").otherwise("false_negative"))


def bias_summary(results: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return results.agg(n.alias("n"), F.count_if(F.col("outcome") == "pass").alias("passed"),
                       F.count_if(F.col("outcome") == "false_positive").alias("false_positives"),
                       F.count_if(F.col("outcome") == "false_negative").alias("false_negatives"))


def specimen_scores(scored: DataFrame, category: str = "category") -> DataFrame:
    """Verdict counts and mean score per specimen category."""
    return scored.groupBy(category, "verdict").agg(F.count(F.lit(1)).alias("n"),
                                                   F.round(F.avg("score"), 4).alias("avg_score"))


# ---- tables about models --------------------------------------------------------------------

def ensemble_weights(model_metrics: DataFrame) -> DataFrame:
    """Each model's share of the summed F1 (a metrics table with one row per model)."""
    total = F.sum("f1").over(W.partitionBy(F.lit(0)))  # one row per model
    return model_metrics.select("model", "f1", F.round(F.col("f1") / total, 4).alias("weight"))


def cv_rank(fold_scores: DataFrame, params: list[str], top: int | None = 10) -> DataFrame:
    """Mean, population deviation and shared-minimum rank of each setting over its folds."""
    per = fold_scores.groupBy(*params).agg(F.avg("score").alias("_m"), F.stddev_pop("score").alias("_s"))
    # one row per setting, so a single ordered window is small
    order = W.partitionBy(F.lit(0)).orderBy(F.desc("_m"))
    ranked = per.select(*params, F.round("_m", 6).alias("mean_score"), F.round("_s", 6).alias("std_score"),
                        F.rank().over(order).alias("rank"))
    return ranked if top is None else ranked.orderBy("rank", *params).limit(top)


def overfit_gap(split_metrics: DataFrame, limit: float = 0.01) -> DataFrame:
    """Train, validation and test F1 side by side with the train-validation gap and its verdict."""
    wide = split_metrics.groupBy("model").pivot("split", ["train", "validation", "test"]).agg(F.first("f1"))
    gap = F.round(F.abs(F.col("train") - F.col("validation")), 4)
    return wide.select("model", F.col("train").alias("train_f1"), F.col("validation").alias("validation_f1"),
                       F.col("test").alias("test_f1"), gap.alias("gap"),
                       F.when(gap < limit, "No overfitting").otherwise("Possible overfit").alias("conclusion"))
