"""Registered queries: every operator over whole tables derived from ``pages`` and ``events``.

Model scores are surrogates computed from the row key where the result has to be checked by SQL; the
queries that train real models say so in their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, partial

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lurewatch.fixed import seeds
from lurewatch.fixed.rules import MUTATIONS, RULES
from lurewatch.fixed.words import FEATURE_GROUPS, FEATURES
from lurewatch.operators import (
    attribution, evaluate as E, explore as X, features as C, hybrid as H, models as M, mutate as MU, prep as P,
    rules as R, trees)
from lurewatch.sources import reports, specimens as S, urls as U
from lurewatch.streaming import jobs as J
from lurewatch.workspace import materialize, shared_path

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


# ---- shared inputs --------------------------------------------------------------------------

def pages(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return S.specimens(pages(spark, sf))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return S.edge_urls(pages(spark, sf))


def features(spark: SparkSession, sf: str) -> DataFrame:
    return C.url_features(corpus(spark, sf))


def hits(spark: SparkSession, sf: str) -> DataFrame:
    """Rule table that keeps the URL parts which scoring needs."""
    return R.rule_hits(C.url_features(corpus(spark, sf), parts=("_host", "_netloc")))


def _surrogate(factor: int, shift: Column | int = 0) -> Column:
    return ((F.col("url_id") * factor + shift) % 1000).cast("double") / 1000.0


def with_surrogates(df: DataFrame) -> DataFrame:
    df = df.withColumns({"p1": _surrogate(7919), "p2": _surrogate(104729), "p3": _surrogate(15485863)})
    return df.withColumn("layer2", H.ensemble_score(F.col("p1"), F.col("p2")))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return H.hybrid_score(with_surrogates(hits(spark, sf)))


def deduped(spark: SparkSession, sf: str) -> DataFrame:
    """Deduped URLs in the shared folder: fitting a split reads them more than once."""
    return materialize(P.dedupe_first(corpus(spark, sf)), "deduped")


def split(spark: SparkSession, sf: str) -> DataFrame:
    return P.stratified_split(deduped(spark, sf))


def split_features(spark: SparkSession, sf: str) -> DataFrame:
    return C.url_features(split(spark, sf))


MODELS = {"logistic": "p3", "boosted": "p1", "forest": "p2", "ensemble": "layer2"}


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """url_id, split, label, model, proba, pred for four surrogate models over a three-way split."""
    rows = P.three_way_split(deduped(spark, sf))
    return E.predictions_long(with_surrogates(rows), MODELS, ["url_id", "split", "label"])


def test_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """The surrogates and the random baseline on the test split of the two-way split."""
    rows = with_surrogates(split(spark, sf))
    test = rows.where("split = 'test'")
    long = E.predictions_long(test, MODELS, ["url_id", "label"])
    random = M.random_baseline(test, rows.where("split = 'train'")).select(
        "url_id", "label", F.lit("random").alias("model"), "proba", "pred")
    return long.unionByName(random)


# ---- A sources and sinks --------------------------------------------------------------------

def _has_line_breaks(df, *columns):
    """Whether any text of ``columns`` spans lines, which decides how its CSV has to be read."""
    return not df.where(F.concat_ws("", *columns).rlike(r"[\r\n]")).isEmpty()


@query
def src_csv_urls(spark, sf):
    path = shared_path(spark, "csv")
    wide = corpus(spark, sf).select(
        F.col("url_id").alias("FILENAME"), F.col("url").alias("URL"), "kind", F.length("url").alias("URLLength"),
        (1 - F.col("label")).alias("label"))
    U.write_result(wide, path, "csv")
    return U.read_labelled_csv(spark, path, line_breaks=_has_line_breaks(wide, "URL", "kind"))


@query
def src_csv_wide(spark, sf):
    path = shared_path(spark, "csv-wide")
    U.write_result(corpus(spark, sf), path, "csv")
    return U.read_wide_csv(spark, path, "url_id bigint, kind string, label int, url string",
                           line_breaks=_has_line_breaks(corpus(spark, sf), "url", "kind"))


@query
def src_feed(spark, sf):
    """A text feed with indented, blank and foreign lines between the URLs."""
    path = shared_path(spark, "feed")
    lines = F.array(F.col("url"), F.concat(F.lit("  "), F.col("url")), F.lit("   "), F.concat(F.col("url"), F.lit(" \t")),
                    F.concat(F.lit("# "), F.col("url")))
    corpus(spark, sf).select(F.explode(lines).alias("value")).write.text(path)
    return U.read_feed(spark, path)


@query
def splits_roundtrip(spark, sf):
    """Partitioned split table written once; the train side is asked for in an augmented variant."""
    path = shared_path(spark, "splits")
    U.write_splits(split(spark, sf), path)
    train = U.read_split(spark, path, "train", augmented_path=path + "-absent")
    return train.unionByName(U.read_split(spark, path, "test")).select("url_id", "url", "label", "split")


@query
def report_roundtrip(spark, sf):
    """Metrics written as a JSON report, read back, one model picked."""
    path = shared_path(spark, "report")
    table = E.metrics(test_predictions(spark, sf), ["model"])
    reports.write_report(reports.metric_rows(table, "metrics", "model", E.METRICS), path)
    return reports.pick_item(reports.read_report(spark, path), "metrics", "ensemble")


@query
def weights_roundtrip(spark, sf):
    """Ensemble weights written to a report, read back from it and used for scoring."""
    path = shared_path(spark, "weights")
    pred = test_predictions(spark, sf).where(F.col("model").isin("boosted", "forest"))
    table = E.ensemble_weights(E.metrics(pred, ["model"]))
    reports.write_report(reports.metric_rows(table, "weights", "model", ["weight"]), path)
    weights = reports.read_weights(reports.read_report(spark, path), ["boosted", "forest"])
    score = H.ensemble_score(F.col("p1"), F.col("p2"), weights)
    return with_surrogates(corpus(spark, sf)).select("url_id", F.round(score, 6).alias("ensemble"))


@query
def nested_report_roundtrip(spark, sf):
    """Findings written as one nested record and read back."""
    path = shared_path(spark, "findings")
    table = _findings(spark, sf)
    reports.write_nested_report(table, path)
    return _flat_findings(reports.read_nested_report(spark, path, table.schema))


@query
def stored_rates(spark, sf):
    """Detection and retention rates read back from stored result files."""
    hold, adv = shared_path(spark, "holdout"), shared_path(spark, "adversarial")
    U.write_result(_holdout(spark, sf), hold, "csv")
    U.write_result(_adversarial(spark, sf), adv)
    detected = reports.detection_rate(spark.read.options(**U.CSV_READ).csv(hold))
    kept = reports.retention_rate(spark.read.parquet(adv))
    return detected.unionByName(kept)


@query
def results_summary(spark, sf):
    pred = test_predictions(spark, sf)
    leak = E.leakage(split_features(spark, sf)).withColumn("item", F.lit("all"))
    hold = E.holdout_summary(E.holdout_results(scored(spark, sf)))
    return reports.results_summary([
        reports.metric_rows(E.metrics(pred, ["model"]), "metrics", "model", E.METRICS),
        reports.metric_rows(E.confusion(pred, ["model"]), "confusion", "model", ["tn", "fp", "fn", "tp"]),
        reports.metric_rows(leak, "leakage", "item", ["train_rows", "test_rows", "leaked_test_rows"]),
        hold.select("section", "item", F.lit("n").alias("metric"), F.col("n").cast("double").alias("value"))])


# ---- B preparation --------------------------------------------------------------------------

@query
def dedupe_urls(spark, sf):
    return P.dedupe_first(corpus(spark, sf))


@query
def flip_labels(spark, sf):
    source = corpus(spark, sf).select("url_id", (1 - F.col("label")).alias("source_label"))
    return P.flip_label(source)


@query
def class_distribution(spark, sf):
    return P.class_distribution(P.dedupe_first(corpus(spark, sf)))


@query
def stratified_split(spark, sf):
    return split(spark, sf).select("url_id", "label", "split")


@query
def split_three_way(spark, sf):
    return P.three_way_split(deduped(spark, sf)).select("url_id", "label", "split")


@query
def split_sizes(spark, sf):
    return P.split_sizes(P.three_way_split(deduped(spark, sf)))


@query
def stratified_folds(spark, sf):
    return P.stratified_folds(deduped(spark, sf), 5).select("url_id", "label", "fold")


def _augmented(spark, sf):
    curated = spark.createDataFrame([(u,) for u in seeds.CURATED_LEGITIMATE], "url string")
    pool = split(spark, sf).where("split = 'train'").select("url_id", "url", "label")
    return C.url_features(P.augment_train(pool, curated))


@query
def augment_train(spark, sf):
    return _augmented(spark, sf).select("url_id", "url", "label", "augmented", *FEATURES)


@query
def augment_profile(spark, sf):
    return P.augment_profile(_augmented(spark, sf))


@query
def dq_profile(spark, sf):
    rows = corpus(spark, sf).select("url", "label").unionByName(
        edges(spark, sf).select("url", F.lit(None).cast("int").alias("label")))
    return P.quality_profile(rows)


@query
def blank_guard(spark, sf):
    rows = with_surrogates(R.rule_hits(C.url_features(edges(spark, sf))))
    return H.hybrid_score(rows).select(
        "url_id", "url_length", "levenshtein_min", "tld_risk_score", "layer1_verdict", "verdict", "score", "cvss",
        "layer2_score", "escalated", "explanation")


@query
def sample_per_class(spark, sf):
    return P.sample_per_class(corpus(spark, sf), 10).select("url_id", "label", "url")


@query
def quarantine(spark, sf):
    rows = edges(spark, sf).unionByName(corpus(spark, sf).select("url_id", "url"))
    return C.quarantine(rows).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


# ---- C features -----------------------------------------------------------------------------

@query
def url_features(spark, sf):
    return features(spark, sf).select("url_id", *FEATURES)


@query
def url_features_edge(spark, sf):
    return C.url_features(edges(spark, sf)).select("url_id", *FEATURES)


@query
def url_features_cached(spark, sf):
    rows = corpus(spark, sf)
    return C.url_features(rows, cache=C.brand_distance_cache(rows)).select("url_id", *FEATURES)


def _feature_group(group: str) -> Query:
    return lambda spark, sf: features(spark, sf).select("url_id", *FEATURE_GROUPS[group])


for _group in FEATURE_GROUPS:
    REGISTRY[f"feat_{_group}"] = _feature_group(_group)


@query
def char_profile(spark, sf):
    rows = C.char_profile(corpus(spark, sf))
    return rows.select("url_id", *[F.round(c, 6).alias(c) for c in ("digit_ratio", "alpha_ratio", "special_ratio")])


@query
def host_parts(spark, sf):
    rows = corpus(spark, sf).select("url_id", "url").unionByName(
        edges(spark, sf).select((-1 - F.col("url_id")).alias("url_id"), "url"))
    return C.host_parts(rows, suffixes=C.suffix_dimension(spark)).drop("url")


@query
def suffix_rules(spark, sf):
    return C.host_parts(S.suffix_urls(pages(spark, sf)), suffixes=C.suffix_dimension(spark))


@query
def feat_simple(spark, sf):
    return C.simple_features(corpus(spark, sf)).drop("kind", "label", "url")


# ---- D rules --------------------------------------------------------------------------------

@query
def rule_hits(spark, sf):
    return hits(spark, sf).select("url_id", *[f"hit_{r[0]}" for r in RULES], F.array_join("rules", ",").alias("rules"))


@query
def rule_dimension(spark, sf):
    """Every hit with its row of the rule dimension."""
    one = hits(spark, sf).select("url_id", F.explode("rules").alias("rule"))
    return one.join(R.rule_dimension(spark), "rule").select(
        "url_id", "rule", "rule_order", "severity", F.array_join("techniques", ",").alias("techniques"), "description")


@query
def rule_techniques(spark, sf):
    return hits(spark, sf).select("url_id", F.array_join("techniques", ",").alias("techniques"))


@query
def rule_verdict(spark, sf):
    return hits(spark, sf).select("url_id", "layer1_verdict")


@query
def rule_explain(spark, sf):
    return hits(spark, sf).select("url_id", R.rule_explanation().alias("explanation"))


def _deduped_hits(spark, sf):
    return R.rule_hits(C.url_features(P.dedupe_first(corpus(spark, sf))))


@query
def rule_coverage(spark, sf):
    return R.coverage(_deduped_hits(spark, sf))


@query
def rule_crosstab(spark, sf):
    return R.crosstab(_deduped_hits(spark, sf))


@query
def rule_class_metrics(spark, sf):
    return R.class_rates(_deduped_hits(spark, sf))


@query
def rule_workload(spark, sf):
    return R.workload(_deduped_hits(spark, sf))


@query
def rule_hit_counts(spark, sf):
    return R.hit_counts(_deduped_hits(spark, sf))


@query
def technique_counts(spark, sf):
    return R.technique_counts(_deduped_hits(spark, sf))


# ---- E models -------------------------------------------------------------------------------

@query
def scaled_features(spark, sf):
    rows = split_features(spark, sf)
    return M.scaled_features(rows, rows.where("split = 'train'")).select("url_id", "split", *FEATURES)


@query
def class_weights(spark, sf):
    return M.class_weights(split(spark, sf).where("split = 'train'")).withColumn("weight", F.round("weight", 6))


@query
def random_baseline(spark, sf):
    rows = split(spark, sf)
    return M.random_baseline(rows.where("split = 'test'"), rows.where("split = 'train'")).select(
        "url_id", "label", "pred", "proba")


@query
def ensemble_weights(spark, sf):
    pred = test_predictions(spark, sf).where(F.col("model").isin("boosted", "forest"))
    return E.ensemble_weights(E.metrics(pred, ["model"]))


@query
def ensemble_score(spark, sf):
    rows = with_surrogates(corpus(spark, sf))
    return rows.select("url_id", F.round("layer2", 6).alias("ensemble"),
                       (F.col("layer2") >= 0.5).cast("int").alias("pred"))


@query
def cv_rank(spark, sf):
    """Fold scores of surrogate settings over exact folds, ranked."""
    rows = with_surrogates(P.stratified_folds(deduped(spark, sf), 5))
    long = E.predictions_long(rows, {"setting_1": "p1", "setting_2": "p2", "setting_3": "p3", "setting_4": "layer2",
                                     "setting_5": "p1"}, ["fold", "label"])
    folds = E.metrics(long, ["model", "fold"], 12).select(F.col("model").alias("setting"), "fold",
                                                          F.col("f1").alias("score"))
    return E.cv_rank(folds, ["setting"])


@query
def overfit_gap(spark, sf):
    return E.overfit_gap(E.metrics(predictions(spark, sf), ["model", "split"]))


def _training_table(spark, sf):
    """Split features in the shared folder: training reads them many times."""
    return materialize(split_features(spark, sf).select("url_id", "url", "label", "split", *FEATURES), "training", "split")


def _sides(table):
    return table.where("split = 'train'"), table.where("split = 'test'")


#: Fitted models of this process by application, data and kind: several queries look at the same two models.
_FITTED: dict[tuple, tuple] = {}


def _fitted(spark, sf, *kinds):
    """(train, test, model of each kind) with the full settings of logistic, boosted or forest; the missing ones are fitted side by side."""
    key = (spark.sparkContext.applicationId, sf)
    if (*key, "table") not in _FITTED:
        _FITTED[(*key, "table")] = _sides(_training_table(spark, sf))
    train, test = _FITTED[(*key, "table")]
    missing = [kind for kind in kinds if (*key, kind) not in _FITTED]
    if missing:
        data = trees.binned(train) if set(missing) - {"logistic"} else None
        rows = M.fitting_table(train) if data is None or "logistic" in missing else train
        fits = {"logistic": M.fit_logistic, "boosted": partial(M.fit_boosted, data=data), "forest": partial(M.fit_forest, data=data)}
        for kind, model in M.fit_side_by_side(rows, {kind: fits[kind] for kind in missing}).items():
            _FITTED[(*key, kind)] = model
        if rows is not train:
            rows.unpersist()
    return train, test, *(_FITTED[(*key, kind)] for kind in kinds)


def _checked_scores(spark, sf, kind):
    """One row per test URL: whether its probability is one, and whether 95 % of all test URLs get their class."""
    _, test, model = _fitted(spark, sf, kind)
    scores = M.proba(test, model, "proba")
    right = scores.agg(F.avg(((F.col("proba") >= 0.5).cast("int") == F.col("label")).cast("double")) >= 0.95)
    return scores.select("url_id", "label", F.col("proba").between(0.0, 1.0).alias("is_probability"), right.scalar().alias("accurate"))


@query
def lr_baseline(spark, sf):
    """Test metrics of the logistic baseline and whether each is far above chance."""
    _, test, model = _fitted(spark, sf, "logistic")
    out = M.proba(test, model, "proba")
    table = E.full_metrics(out.withColumn("pred", (F.col("proba") >= 0.5).cast("int"))
                           .withColumn("model", F.lit("logistic")), ["model"])
    names = [c for c in table.columns if c != "model"]
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).between(0.8, 1.0).alias("far_above_chance")) for c in names])
    return table.select("model", F.explode(rows).alias("r")).select("model", "r.*")


@query
def gbt_scores(spark, sf):
    return _checked_scores(spark, sf, "boosted")


@query
def rf_scores(spark, sf):
    return _checked_scores(spark, sf, "forest")


@query
def feature_importance(spark, sf):
    """Every feature with sane importances; the totals are 1 and the ranks are 1 to 24."""
    table = M.feature_importance(*_fitted(spark, sf, "boosted", "forest")[2:], spark)
    every = P.over_groups()
    out = [F.round(F.sum(f"{m}_importance").over(every), 6).alias(f"{m}_total") for m in ("boosted", "forest")]
    ranks = [(F.sum(f"{m}_rank").over(every) == 300).alias(f"{m}_ranks_complete") for m in ("boosted", "forest")]
    return table.select("feature", (F.col("boosted_importance") >= 0).alias("boosted_ok"),
                        (F.col("forest_importance") >= 0).alias("forest_ok"), *out, *ranks)


@query
def attribution_topk(spark, sf):
    """Twelve contributions per test URL: sorted by size, with the feature's value, adding up to the model's margin."""
    _, test, model = _fitted(spark, sf, "boosted")
    whole = attribution.attribution(test, model)
    margin = model.transform(test).select("url_id", vector_to_array("rawPrediction")[1].alias("raw"), *[F.col(f).alias(f"t_{f}") for f in FEATURES])
    total = whole.select("url_id", (F.col("base_value") + sum(F.col(f) for f in FEATURES)).alias("total"))
    top = attribution.attribution_top(test, model)
    value = F.create_map(*[x for f in FEATURES for x in (F.lit(f), F.col(f"t_{f}").cast("double"))])
    joined = top.join(margin, "url_id").join(total, "url_id")
    return joined.select("url_id", "rank", (F.abs(F.col("total") - F.col("raw")) < 1e-6).alias("adds_up"),
                         (value[F.col("feature")] == F.col("value")).alias("value_ok"))


@query
def grid_search(spark, sf):
    train, _ = _sides(_training_table(spark, sf))
    return M.grid_search(train, "boosted", {"maxIter": [3, 6], "maxDepth": [2, 4]}, folds=3)[1]


@query
def learning_curve(spark, sf):
    train, _ = _sides(_training_table(spark, sf))
    return M.learning_curve(train, "boosted", {"maxIter": 3, "maxDepth": 3}, steps=3, folds=2)


@query
def training_summary(spark, sf):
    return M.training_summary(*_fitted(spark, sf, "forest"), "forest")


@query
def model_roundtrip(spark, sf):
    """A saved and reloaded model scores the test rows as the fitted one does."""
    _, test, model = _fitted(spark, sf, "boosted")
    path = shared_path(spark, "model")
    M.save_model(model, path)
    both = M.proba(M.proba(test, model, "fitted"), M.load_model(path), "loaded")
    return both.select("url_id", "label", (F.col("fitted") == F.col("loaded")).alias("same"))


# ---- F hybrid scoring -----------------------------------------------------------------------

@query
def hybrid_score(spark, sf):
    return scored(spark, sf).select(
        "url_id", "url", "verdict", "score", "cvss", "layer1_verdict", F.array_join("rules", ",").alias("layer1_rules"),
        "layer2_score", F.array_join("techniques", ",").alias("mitre_techniques"), "escalated", "explanation")


@query
def hybrid_score_ml(spark, sf):
    """The hybrid with the trained ensemble: rules decide as ever, open rows get a model score in range."""
    _, _, boosted, forest = _fitted(spark, sf, "boosted", "forest")
    todo = hits(spark, sf).withColumn("needs_model", ~(H.is_high_risk() | H.is_blank()))
    table = materialize(todo, "hits", "needs_model")
    out = M.hybrid_score_models(table, boosted, forest)
    decided = F.col("layer2_score").isNull()
    return out.select("url_id", "layer1_verdict", decided.alias("decided_by_rules"), F.when(decided, F.col("verdict")).alias("verdict"),
                      F.when(decided, F.col("score")).alias("score"), F.col("score").between(0.0, 1.0).alias("in_range"),
                      (F.col("escalated") & ((F.col("layer1_verdict") != "SUSPICIOUS") | (F.col("score") < 0.55))).alias("wrongly_escalated"))


@query
def fail_fast(spark, sf):
    decided, open_rows = H.split_fail_fast(with_surrogates(hits(spark, sf)))
    done = H.hybrid_score(decided).select("url_id", "verdict", "score", "cvss", "layer2_score")
    rest = open_rows.select("url_id", F.lit("OPEN").alias("verdict"), F.lit(None).cast("double").alias("score"),
                            F.lit(None).cast("double").alias("cvss"), F.round("layer2", 4).alias("layer2_score"))
    return done.unionByName(rest)


@query
def trusted_domain(spark, sf):
    rows = corpus(spark, sf).select("url_id", "url").unionByName(
        edges(spark, sf).select((-1 - F.col("url_id")).alias("url_id"), "url"))
    both = H.with_trusted(rows).withColumnRenamed("trusted", "trusted_default")
    return H.with_trusted(both, strict_host=True).select("url_id", "trusted_default", F.col("trusted").alias("trusted_strict"))


@query
def trusted_cap(spark, sf):
    return scored(spark, sf).where("trusted").select("url_id", "layer1_verdict", "layer2_score", "score", "verdict")


@query
def escalation(spark, sf):
    return scored(spark, sf).where("escalated").select("url_id", "layer2_score", "score", "verdict", "explanation")


@query
def agreement_boost(spark, sf):
    return scored(spark, sf).where("layer1_verdict = 'SUSPICIOUS' and not escalated").select(
        "url_id", "layer2_score", "score", "verdict")


@query
def severity(spark, sf):
    rows = with_surrogates(corpus(spark, sf))
    return rows.select("url_id", H.severity(F.col("p1")).alias("severity_p1"), H.severity(F.col("layer2")).alias("severity"))


@query
def severity_scale(spark, sf):
    rows = with_surrogates(corpus(spark, sf))
    return rows.select("url_id", H.severity_scale(F.col("p1")).alias("cvss"))


@query
def score_explain(spark, sf):
    return scored(spark, sf).select("url_id", "explanation")


@query
def infer_techniques(spark, sf):
    return scored(spark, sf).select(
        "url_id", F.array_join(H.inferred_techniques(F.col("verdict")), ",").alias("inferred"),
        F.array_join(H.final_techniques(), ",").alias("final"))


@query
def top_signals(spark, sf):
    return H.top_signals(features(spark, sf))


@query
def technique_info(spark, sf):
    rows = scored(spark, sf).select("url_id", H.final_techniques().alias("techniques"))
    return H.technique_info(rows)


@query
def analyze_batch(spark, sf):
    rows = scored(spark, sf).select("url_id", "verdict", "score", H.feature_map().alias("m"))
    return rows.select("url_id", "verdict", "score", *[F.col("m")[f].alias(f) for f in FEATURES])


@query
def features_long(spark, sf):
    return H.features_long(features(spark, sf))


@query
def verdict_summary(spark, sf):
    return scored(spark, sf).select("url_id", "verdict", H.verdict_summary(F.col("verdict")).alias("summary"))


# ---- G evaluation ---------------------------------------------------------------------------

@query
def confusion(spark, sf):
    return E.confusion(predictions(spark, sf), ["model", "split"])


@query
def metrics(spark, sf):
    return E.metrics(predictions(spark, sf), ["model", "split"])


@query
def roc_auc(spark, sf):
    return E.roc_auc(predictions(spark, sf), ["model", "split"])


@query
def roc_curve(spark, sf):
    return E.roc_curve(test_predictions(spark, sf), ["model"])


@query
def roc_curve_zoom(spark, sf):
    return E.roc_curve(test_predictions(spark, sf), ["model"], 0.01)


@query
def classification_report(spark, sf):
    return E.classification_report(test_predictions(spark, sf), ["model"])


@query
def model_comparison(spark, sf):
    return E.model_comparison(test_predictions(spark, sf))


@query
def mcnemar(spark, sf):
    rows = with_surrogates(split(spark, sf)).where("split = 'test'")
    wide = rows.select("label", *[(F.col(c) >= 0.5).cast("int").alias(m) for m, c in MODELS.items()])
    return E.mcnemar(wide, [("ensemble", "ensemble", "boosted", "boosted"), ("ensemble", "ensemble", "forest", "forest"),
                            ("boosted", "boosted", "forest", "forest")])


@query
def distinct_vectors(spark, sf):
    return E.leakage(split_features(spark, sf)).select("distinct_train_vectors", "distinct_test_vectors")


@query
def leakage(spark, sf):
    return E.leakage(split_features(spark, sf))


@query
def dup_vectors(spark, sf):
    return E.leakage(split_features(spark, sf)).select(
        "train_duplicate_rows", "train_duplicate_pct", "test_duplicate_rows", "test_duplicate_pct")


@query
def strat_ratio(spark, sf):
    return E.stratification(split(spark, sf))


@query
def collision_free(spark, sf):
    """Metrics of three surrogates on test rows whose vector does not occur in train."""
    free = with_surrogates(E.collision_free(split_features(spark, sf)))
    models = {m: c for m, c in MODELS.items() if m != "logistic"}
    return E.full_metrics(E.predictions_long(free, models, ["url_id", "label"]), ["model"])


@query
def collision_summary(spark, sf):
    return E.collision_summary(split_features(spark, sf))


def _holdout_hits(spark, sf):
    """The rule table of all specimen and edge URLs, with an ``error`` where a URL cannot be analysed."""
    rows = corpus(spark, sf).select("url_id", "url").unionByName(
        edges(spark, sf).select((-1 - F.col("url_id")).alias("url_id"), "url"))
    checked = C.quarantine(rows)
    checked = checked.withColumn("error", F.when(F.col("error") == "unbalanced_brackets", F.col("error")))
    return R.rule_hits(C.url_features(checked))


def _holdout(spark, sf):
    base = with_surrogates(_holdout_hits(spark, sf))
    base = base.withColumn("layer2", F.abs("layer2"))  # edge rows have negative keys
    return E.holdout_results(H.hybrid_score(base), error="error")


@query
def holdout_results(spark, sf):
    return _holdout(spark, sf)


@query
def holdout_summary(spark, sf):
    return E.holdout_summary(_holdout(spark, sf))


@query
def holdout_results_ml(spark, sf):
    """The blind run with the trained ensemble; the full result rows are written, and what rules alone decide is returned."""
    _, _, boosted, forest = _fitted(spark, sf, "boosted", "forest")
    todo = _holdout_hits(spark, sf).withColumn("needs_model", ~(H.is_high_risk() | H.is_blank()))
    done = M.hybrid_score_models(materialize(todo, "holdout-hits", "needs_model"), boosted, forest)
    rows = materialize(E.holdout_results(done, error="error"), "holdout-ml")
    decided = F.col("layer2_score").isNull()
    return rows.select("url_id", "url", "layer1", "mitre", "rules", decided.alias("decided_by_rules"),
                       F.when(decided, F.col("verdict")).alias("verdict"), F.when(decided, F.col("score")).alias("score"),
                       F.col("score").between(0.0, 1.0).alias("in_range"),
                       (F.col("escalated") & ((F.col("layer1") != "SUSPICIOUS") | (F.col("score") < 0.55))).alias("wrongly_escalated"))


def _variant_score(df: DataFrame, mutated: bool) -> DataFrame:
    """Surrogate ensemble score; variants shift it by the number of their mutation."""
    shift = F.lit(0)
    if mutated:
        shift = F.array_position(F.array(*[F.lit(m) for m in MUTATIONS]), F.col("mutation")) * 131
    return df.withColumn("ml_score", H.ensemble_score(_surrogate(7919, shift), _surrogate(104729, shift)))


def _attacks(spark, sf):
    attacks = corpus(spark, sf).where("label = 1").select("url_id", "url")
    seeded = spark.createDataFrame([(10 ** 12 + i, u) for i, u in enumerate(seeds.ATTACK_SEEDS)], "url_id bigint, url string")
    return attacks.unionByName(seeded)


def _adversarial(spark, sf):
    return E.adversarial_results(_attacks(spark, sf), _variant_score)


@query
def adversarial_results(spark, sf):
    return _adversarial(spark, sf)


@query
def adversarial_results_ml(spark, sf):
    """Every mutation against the trained ensemble; the scores are written, and their ranges and agreement returned."""
    _, _, boosted, forest = _fitted(spark, sf, "boosted", "forest")
    rows = materialize(E.adversarial_results(
        _attacks(spark, sf), lambda df, mutated: M.score_models(df, boosted, forest)), "adversarial-ml")
    before, after = F.col("score_before"), F.col("score_after")
    return rows.select(
        "url_id", "original_url", "mutated_url", "mutation", "heuristic_before", "heuristic_after",
        (before.between(0.0, 1.0) & after.between(0.0, 1.0)).alias("in_range"),
        (F.abs(before - after - F.col("score_drop")) < 2e-4).alias("drop_ok"),
        ((F.col("heuristic_after") != "HIGH_RISK") | F.col("detected_after")).alias("rules_detect"),
        (F.col("evaded") == (F.col("detected_before") & ~F.col("detected_after"))).alias("evaded_ok"))


@query
def adversarial_summary(spark, sf):
    return E.adversarial_summary(_adversarial(spark, sf))


def _bias_urls(spark, sf):
    known = spark.createDataFrame([(10 ** 12 + i, u, e) for i, (u, e, _) in enumerate(seeds.BIAS_URLS)],
                                  "url_id bigint, url string, expected string")
    rows = corpus(spark, sf).select("url_id", "url", F.when(F.col("label") == 1, "PHISHING").otherwise("LEGIT").alias("expected"))
    return rows.unionByName(known)


@query
def bias_stress_ml(spark, sf):
    """The bias URLs under the trained ensemble; the scores are written, and their ranges and outcomes returned."""
    _, _, boosted, forest = _fitted(spark, sf, "boosted", "forest")
    rows = materialize(E.bias_results(M.score_models(C.url_features(_bias_urls(spark, sf)), boosted, forest)), "bias-ml")
    summary = E.bias_summary(rows).select(
        (F.col("n") == F.col("passed") + F.col("false_positives") + F.col("false_negatives")) & (F.col("passed") >= 0.9 * F.col("n")))
    parts = F.col("p_boosted"), F.col("p_forest")
    return rows.select(
        "url_id", "expected", "qty_slash", "has_https", "url_length", F.col("ml_score").between(0.0, 1.0).alias("in_range"),
        F.col("ml_score").between(F.least(*parts) - 1e-9, F.greatest(*parts) + 1e-9).alias("between_models"),
        ((F.col("outcome") == "pass") == (F.col("got") == F.col("expected"))).alias("outcome_ok"), summary.scalar().alias("mostly_right"))


@query
def bias_stress(spark, sf):
    table = C.url_features(with_surrogates(_bias_urls(spark, sf)).withColumnRenamed("layer2", "ml_score"))
    return E.bias_results(table).select("url_id", "expected", "got", "outcome", F.round("ml_score", 4).alias("score"),
                                        "qty_slash", "has_https", "url_length")


@query
def bias_summary(spark, sf):
    rows = with_surrogates(corpus(spark, sf)).withColumnRenamed("layer2", "ml_score").withColumn(
        "expected", F.when(F.col("label") == 1, "PHISHING").otherwise("LEGIT"))
    return E.bias_summary(E.bias_results(rows))


@query
def specimen_scores(spark, sf):
    gallery = spark.createDataFrame([(2 * 10 ** 12 + i, c, u) for i, (c, _, u) in enumerate(seeds.SPECIMENS)],
                                    "url_id bigint, category string, url string")
    rows = corpus(spark, sf).select("url_id", F.col("kind").alias("category"), "url").unionByName(gallery)
    return E.specimen_scores(H.hybrid_score(with_surrogates(R.rule_hits(C.url_features(rows)))))


# ---- H mutations ----------------------------------------------------------------------------

def _mutation(kind: str) -> Query:
    return lambda spark, sf: MU.mutations(corpus(spark, sf)).select("url_id", F.col(kind).alias("mutated_url"))


for _name, _kind in (("mut_subdomain", "subdomain_padding"), ("mut_https", "https_laundering"),
                     ("mut_path", "path_dilution"), ("mut_keyword", "keyword_removal"), ("mut_combined", "combined")):
    REGISTRY[_name] = _mutation(_kind)


@query
def mutations_all(spark, sf):
    return MU.mutate_all(corpus(spark, sf)).select("url_id", "mutation", "mutated_url")


# ---- I exploration --------------------------------------------------------------------------

def _sized(spark, sf):
    return corpus(spark, sf).select("url_id", "label", "url", F.length("url").alias("url_length"))


@query
def length_describe(spark, sf):
    return X.describe_by_class(_sized(spark, sf), "url_length")


@query
def length_histogram(spark, sf):
    return X.histogram_clipped(_sized(spark, sf), "url_length")


@query
def length_histogram_range(spark, sf):
    return X.histogram_range(_sized(spark, sf), "url_length")


@query
def length_box(spark, sf):
    return X.box_plot(_sized(spark, sf), "url_length")


@query
def topk_longest(spark, sf):
    return X.longest(corpus(spark, sf)).select("label", "rank", "url_id", "url_length", "url")


@query
def char_ratio_means(spark, sf):
    return X.means_by_class(C.char_profile(corpus(spark, sf)), ["digit_ratio", "alpha_ratio", "special_ratio"])


def _hosts(spark, sf):
    return C.host_parts(corpus(spark, sf), suffixes=C.suffix_dimension(spark))


@query
def topk_tld(spark, sf):
    return X.top_values(_hosts(spark, sf), "tld")


@query
def tld_risk_mined(spark, sf):
    return X.mined_suffix_risk(_hosts(spark, sf), min_count=10)


@query
def https_crosstab(spark, sf):
    return X.https_crosstab(corpus(spark, sf).withColumn("has_https", F.lower("url").startswith("https://").cast("int")))


@query
def domain_describe(spark, sf):
    rows = _hosts(spark, sf)
    one = X.describe_by_class(rows, "reg_domain_length").withColumn("measure", F.lit("reg_domain_length"))
    return one.unionByName(X.describe_by_class(rows, "subdomain_count").withColumn("measure", F.lit("subdomain_count")))


@query
def subdomain_crosstab(spark, sf):
    return X.row_shares(_hosts(spark, sf), "subdomain_count")


def _findings(spark, sf):
    rows = C.char_profile(_hosts(spark, sf)).withColumns({
        "url_length": F.length("url"), "has_https": F.lower("url").startswith("https://").cast("int")})
    return X.findings(rows)


def _flat_findings(f):
    return f.select(
        "total_rows", "duplicates", "class_distribution.*",
        F.col("url_length_stats.phishing_mean").alias("phishing_length_mean"),
        F.col("url_length_stats.phishing_max").alias("phishing_length_max"),
        F.col("url_length_stats.legitimate_mean").alias("legitimate_length_mean"),
        F.col("url_length_stats.legitimate_max").alias("legitimate_length_max"),
        F.col("https_adoption.phishing_pct").alias("phishing_https_pct"),
        F.col("https_adoption.legitimate_pct").alias("legitimate_https_pct"),
        F.col("char_ratios.phishing.digit_ratio").alias("phishing_digit_ratio"),
        F.col("char_ratios.phishing.alpha_ratio").alias("phishing_alpha_ratio"),
        F.col("char_ratios.legitimate.digit_ratio").alias("legitimate_digit_ratio"),
        F.col("char_ratios.legitimate.alpha_ratio").alias("legitimate_alpha_ratio"), "subdomain_patterns.*")


@query
def findings(spark, sf):
    return _flat_findings(_findings(spark, sf))


@query
def feature_means(spark, sf):
    return X.feature_means(features(spark, sf))


@query
def drift_check(spark, sf):
    return X.drift_check(features(spark, sf))


@query
def class_separation(spark, sf):
    return X.class_separation(features(spark, sf))


# ---- J streaming ----------------------------------------------------------------------------

def _with_layer2(df: DataFrame) -> DataFrame:
    return with_surrogates(df).drop("p1", "p2", "p3")


@query
def stream_score(spark, sf):
    """Pages arrive as a stream; specimens are derived and scored as they come."""
    arriving = J.read_stream(spark, f"{sf}/pages.parquet", "page_id bigint, url string")
    out = J.score_urls(S.specimens(arriving), _with_layer2).select("url_id", "verdict", "score", "layer1_verdict", "escalated")
    path, checkpoint = shared_path(spark, "stream"), shared_path(spark, "stream-log")
    J.run_available(out, path, checkpoint)
    return spark.read.schema(out.schema).parquet(path)


def _scored_urls(spark, sf) -> tuple[DataFrame, int]:
    urls = J.score_urls(corpus(spark, sf), _with_layer2).select("url_id", "url", "verdict", "score")
    urls = materialize(urls, "scored-urls")  # scored once, not again for every micro-batch
    return urls, urls.count()


def _clicks(events: DataFrame, urls: DataFrame, n: int) -> DataFrame:
    """Click events with the URL they hit and its score."""
    return events.withColumn("url_id", F.col("event_id") % n).join(urls, "url_id")


DELIVERIES = 3
EVENT_SCHEMA = "event_id bigint, ts timestamp"


def _delivered(spark, sf) -> DataFrame:
    """Events with their delivery: thirds of the time span, but every 50th event of the first comes with the last."""
    events = spark.read.schema(EVENT_SCHEMA).parquet(f"{sf}/events.parquet")
    span = events.agg(F.min(F.unix_micros("ts")).alias("_a"), F.max(F.unix_micros("ts")).alias("_b"))
    third = F.expr(f"(unix_micros(ts) - _a) * {DELIVERIES} DIV (_b - _a + 1)")
    late = (third == 0) & (F.col("event_id") % 50 == 0)
    return (events.crossJoin(F.broadcast(span))  # one row
            .select("event_id", "ts", F.when(late, DELIVERIES - 1).otherwise(F.coalesce(third, F.lit(0))).alias("delivery")))


def _run_deliveries(spark, sf, run: Callable[[DataFrame], None]) -> None:
    """Let the deliveries arrive one after the other; ``run`` takes up each of them with a stream started anew."""
    urls, n = _scored_urls(spark, sf)
    events, folder = _delivered(spark, sf), shared_path(spark, "arriving")
    for i in range(DELIVERIES):
        events.where(F.col("delivery") == i).drop("delivery").write.mode("append").parquet(folder)
        run(_clicks(J.read_stream(spark, folder, EVENT_SCHEMA), urls, n))


@query
def stream_verdict_counts(spark, sf):
    """Windows that the watermark has closed; events that arrive after theirs was closed are dropped."""
    path, checkpoint = shared_path(spark, "counts"), shared_path(spark, "counts-log")
    _run_deliveries(spark, sf, lambda clicks: J.run_available(J.verdict_counts(clicks), path, checkpoint))
    return spark.read.parquet(path)


@query
def recent_scans(spark, sf):
    urls, n = _scored_urls(spark, sf)
    return J.recent_scans(_clicks(spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts"), urls, n))


@query
def stream_recent_scans(spark, sf):
    checkpoint = shared_path(spark, "recent-log")
    _run_deliveries(spark, sf, lambda clicks: J.run_recent(clicks, checkpoint))
    return J.held_scans(spark, checkpoint)


@cache
def all_queries() -> dict[str, Query]:
    return dict(REGISTRY)
