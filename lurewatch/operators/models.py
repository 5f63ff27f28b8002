"""Training, scoring, tuning and persistence of the two-model ensemble with Spark ML."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from lurewatch.fixed.rules import BOOST_GRID, BOOST_PARAMS, FOREST_GRID, FOREST_PARAMS, SEED
from lurewatch.fixed.words import FEATURES
from lurewatch.functions.keyed import keyed_uniform
from lurewatch.operators import evaluate, hybrid, staged, trees
from lurewatch.operators.prep import over_groups, stratified_folds


def assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=FEATURES, outputCol="features")


def class_weights(df: DataFrame) -> DataFrame:
    """n / (2 n_c) per class; one row per class."""
    counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("label", "n", (F.sum("n").over(over_groups()) / (2.0 * F.col("n"))).alias("weight"))


def with_class_weight(df: DataFrame) -> DataFrame:
    return df.join(F.broadcast(class_weights(df).select("label", "weight")), "label")  # one row per class


def scaled_features(df: DataFrame, fit_on: DataFrame | None = None, digits: int = 4) -> DataFrame:
    """Standardise the 24 columns with mean and population deviation; constant columns become 0.

    The statistics are one aggregation row, read as a scalar subquery.
    """
    base = df if fit_on is None else fit_on
    stats = base.agg(F.struct(*[x for f in FEATURES for x in (
        F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))]).alias("s")).scalar()
    df = df.withColumn("_s", stats)
    out = {f: F.when(F.col(f"_s.s_{f}") == 0, F.lit(0.0)).otherwise(
        F.round((F.col(f) - F.col(f"_s.m_{f}")) / F.col(f"_s.s_{f}"), digits)) for f in FEATURES}
    return df.select(*[out[c].alias(c) if c in out else F.col(c) for c in df.columns if c != "_s"])


def fit_logistic(train: DataFrame, max_iter: int = 1000, c: float = 1.0) -> PipelineModel:
    """L2 logistic regression on standardised columns, scaler fitted on the training rows only."""
    n = train.count()
    steps = [assembler().setOutputCol("raw"),
             StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
             LogisticRegression(maxIter=max_iter, regParam=1.0 / (c * n), elasticNetParam=0.0,
                                standardization=False)]
    return Pipeline(stages=steps).fit(train)


def _boosted(params: dict, max_bins: int) -> GBTClassifier:
    return GBTClassifier(seed=SEED, maxBins=max_bins, **{**BOOST_PARAMS, **params})


def _forest(params: dict, max_bins: int) -> RandomForestClassifier:
    return RandomForestClassifier(seed=SEED, maxBins=max_bins, weightCol="weight",
                                  **{**FOREST_PARAMS, **params})


#: Settings that the learners of ``trees`` know; any other one goes to ``spark.ml``. And what says that rows are not binned yet.
GROWN_BY = {"boosted": {"maxIter", "maxDepth", "stepSize"}, "forest": {"numTrees", "maxDepth", "featureSubsetStrategy"}}
NOT_BINNED = object()


def fit_boosted(train: DataFrame, params: dict | None = None, max_bins: int = 128, data=NOT_BINNED) -> PipelineModel:
    """Boosted trees, grown over ``data`` (``trees.binned`` of ``train``), or by ``spark.ml`` over ``train`` where that is None."""
    learner = _boosted(params or {}, max_bins)
    if set(params or {}) <= GROWN_BY["boosted"]:
        data = trees.binned(train, max_bins) if data is NOT_BINNED else data
        if data is not None:
            return PipelineModel([assembler(), trees.boosted_model(train.sparkSession, data, learner)])
    return Pipeline(stages=[assembler(), learner]).fit(train)


def fit_forest(train: DataFrame, params: dict | None = None, max_bins: int = 128, data=NOT_BINNED) -> PipelineModel:
    """A forest with class weights, grown as in ``fit_boosted``."""
    learner = _forest(params or {}, max_bins)
    if set(params or {}) <= GROWN_BY["forest"] and trees.subset_size(learner.getFeatureSubsetStrategy()):
        data = trees.binned(train, max_bins) if data is NOT_BINNED else data
        if data is not None:
            return PipelineModel([assembler(), trees.forest_model(train.sparkSession, data, learner)])
    return Pipeline(stages=[assembler(), learner]).fit(with_class_weight(train))


def proba(df: DataFrame, model: PipelineModel, name: str) -> DataFrame:
    """Append the probability of the phishing class as ``name``."""
    scored = model.transform(df)
    return scored.select(*df.columns, vector_to_array("probability")[1].alias(name))


def score_models(df: DataFrame, boosted: PipelineModel, forest: PipelineModel,
                 weights=(hybrid.BOOST_WEIGHT, hybrid.FOREST_WEIGHT)) -> DataFrame:
    """Append p_boosted, p_forest and their weighted sum ``ml_score``."""
    scores = trees.both_scores(df.sparkSession, boosted, forest)
    if scores is None:
        df = proba(proba(df, boosted, "p_boosted"), forest, "p_forest")
    else:  # the assembler refuses missing values, as it does for the models
        filled = boosted.stages[0].copy({boosted.stages[0].outputCol: "_features"}).transform(df)
        df = filled.select(*df.columns, scores(vector_to_array("_features")).alias("_p")).select(*df.columns, "_p.*")
    return df.withColumn("ml_score", hybrid.ensemble_score(F.col("p_boosted"), F.col("p_forest"), weights))


def hybrid_score_models(hits: DataFrame, boosted: PipelineModel, forest: PipelineModel) -> DataFrame:
    """Hybrid scores with the real ensemble; rows that rules decide never reach the models."""
    decided, open_rows = hybrid.split_fail_fast(hits)
    decided = decided.withColumn("layer2", F.lit(None).cast("double"))
    scored = score_models(open_rows, boosted, forest).drop("p_boosted", "p_forest")
    return hybrid.hybrid_score(decided.unionByName(scored.withColumnRenamed("ml_score", "layer2")))


def random_baseline(test: DataFrame, train: DataFrame, key: str = "url_id", seed: int = SEED) -> DataFrame:
    """Predict phishing with the training prior; probabilities are the 0/1 draws."""
    prior = train.agg(F.avg(F.col("label").cast("double")))
    draw = (keyed_uniform(F.col(key), "baseline", seed) < prior.scalar()).cast("int")
    return test.withColumn("pred", draw).withColumn("proba", F.col("pred").cast("double"))


def feature_importance(boosted: PipelineModel, forest: PipelineModel, spark: SparkSession) -> DataFrame:
    """feature, boosted and forest importance and the rank by each; 24 rows. A top list is a condition on a rank."""
    b, f = (list(map(float, m.stages[-1].featureImportances.toArray())) for m in (boosted, forest))

    def ranks(values: list[float]) -> dict[int, int]:
        return {i: n + 1 for n, i in enumerate(sorted(range(len(values)), key=lambda i: (-values[i], FEATURES[i])))}

    by_b, by_f = ranks(b), ranks(f)
    return spark.createDataFrame(
        [(x, b[i], f[i], by_b[i], by_f[i]) for i, x in enumerate(FEATURES)],
        "feature string, boosted_importance double, forest_importance double, boosted_rank int, forest_rank int")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    try:
        return PipelineModel.load(path)
    except Exception as exc:  # a missing path surfaces as different errors per file system
        if isinstance(exc, AnalysisException) or "does not exist" in str(exc).lower() or "No such" in str(exc):
            raise FileNotFoundError(f"no trained model at {path}; train and save one first") from exc
        raise


def _settings(grid: dict[str, list]) -> list[dict]:
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def grid_search(train: DataFrame, kind: str = "boosted", grid: dict[str, list] | None = None, folds: int = 5,
                parallelism: int = 8, max_bins: int = 128) -> tuple[PipelineModel, DataFrame]:
    """Cross-validated search by F1 of the phishing class; (refitted best model, result table).

    Folds are exact and stratified. Tree counts share fits, see ``staged``. Pass a materialised ``train``.
    """
    grid = grid or (BOOST_GRID if kind == "boosted" else FOREST_GRID)
    data = with_class_weight(stratified_folds(train, folds)).withColumn("side", F.lit("validation"))
    make, trees = (_boosted, "maxIter") if kind == "boosted" else (_forest, "numTrees")
    counts = sorted(grid.get(trees, [(BOOST_PARAMS if kind == "boosted" else FOREST_PARAMS)[trees]]))
    others = {k: v for k, v in grid.items() if k != trees}
    cells = [(i, fold) for i in range(len(_settings(others))) for fold in range(folds)]

    def fit(cell: tuple[int, int]) -> PipelineModel:
        params = {**_settings(others)[cell[0]], trees: counts[-1]}
        return Pipeline(stages=[assembler(), make(params, max_bins)]).fit(data.where(F.col("fold") != cell[1]))

    found: dict[tuple, list[float]] = {}
    for (i, _), _, k, score in staged.staged_scores(cells, fit, lambda c: data.where(F.col("fold") == c[1]), counts, parallelism):
        found.setdefault((i, k), []).append(score)
    settings = [({**_settings(others)[i], trees: k}, scores) for (i, k), scores in sorted(found.items())]
    rows = [(*[str(p[n]) for n in grid], float(np.mean(s)), float(np.std(s))) for p, s in settings]
    schema = ", ".join(f"{n} string" for n in grid) + ", mean_score double, std_score double"
    table = train.sparkSession.createDataFrame(rows, schema)  # one row per setting
    ranked = table.select("*", F.rank().over(
        evaluate.W.partitionBy(F.lit(0)).orderBy(F.desc("mean_score"))).alias("rank"))
    best = max(settings, key=lambda x: np.mean(x[1]))[0]
    return Pipeline(stages=[assembler(), make(best, max_bins)]).fit(data), ranked


def rank_of(cv_table: DataFrame, setting: dict) -> DataFrame:
    """The row of one setting in a search table."""
    for name, value in setting.items():
        cv_table = cv_table.where(F.col(name) == str(value))
    return cv_table


def learning_curve(train: DataFrame, kind: str = "boosted", params: dict | None = None, steps: int = 10,
                   folds: int = 5, limit: float = 0.01, max_bins: int = 128, parallelism: int = 8) -> DataFrame:
    """Mean and deviation of train and validation F1 per training share; the last row carries the verdict.

    Shares are nested hash prefixes of the training folds, so a larger share contains the smaller. A cell is a share and
    a fold; both its sides are scored in one pass. Pass a materialised ``train``: every cell reads it again.
    """
    fit, trees = (fit_boosted, "maxIter") if kind == "boosted" else (fit_forest, "numTrees")
    data = stratified_folds(train, folds).withColumn("_u", keyed_uniform(F.col("url_id"), "curve"))
    count = {**(BOOST_PARAMS if kind == "boosted" else FOREST_PARAMS), **(params or {})}[trees]

    def part(cell: tuple[int, int]):
        return (F.col("fold") != cell[1]) & (F.col("_u") < cell[0] / steps)

    def scored(cell: tuple[int, int]) -> DataFrame:
        side = F.when(F.col("fold") == cell[1], "validation").when(part(cell), "train")
        return data.withColumn("side", side).where("side IS NOT NULL")

    cells = list(itertools.product(range(1, steps + 1), range(folds)))
    scores = staged.staged_scores(cells, lambda c: fit(data.where(part(c)).drop("_u", "fold"), params, max_bins), scored, [count], parallelism)
    rows = [(step / steps, fold, side, score) for (step, fold), side, _, score in scores]  # two per cell
    per = train.sparkSession.createDataFrame(rows, "share double, fold int, side string, f1 double").groupBy("share").agg(
        *[x for s in ("train", "validation") for x in (
            F.round(F.avg(F.when(F.col("side") == s, F.col("f1"))), 4).alias(f"{s}_mean"),
            F.round(F.stddev_pop(F.when(F.col("side") == s, F.col("f1"))), 4).alias(f"{s}_std"))])
    gap = F.round(F.abs(F.col("train_mean") - F.col("validation_mean")), 4)
    return per.select("*", gap.alias("gap"), F.when(F.col("share") == 1.0, F.when(
        gap < limit, "No overfitting").otherwise("Possible overfit")).alias("conclusion"))


def fitting_table(train: DataFrame, least_rows: int = 10_000, most_rows: int = 1_000_000) -> DataFrame:
    """``train`` cached in one part per core: a learner passes over it once per tree level, in a job of its own.

    In each such job every task starts anew and sends a histogram per node, feature and bin, whose size does not depend on its rows.
    So there are fewer parts where one would have under ``least_rows`` rows, and more, by whole rounds of the cores,
    only where one would pass ``most_rows``. Which rows share a part decides what the learner draws: another number
    of cores may give another model of the same kind.
    """
    rows, cores = train.count(), train.sparkSession.sparkContext.defaultParallelism
    rounds = -(-rows // (cores * most_rows))
    parts = max(1, min(cores * rounds, rows // least_rows))
    return train.repartition(parts, "url_id").cache()


def fit_side_by_side(rows: DataFrame, fits: dict[str, Callable[[DataFrame], PipelineModel]]) -> dict[str, PipelineModel]:
    """A model per entry of ``fits``, all at a time over the same rows: a boosted tree waits for the one before it, and most of its
    levels are too short to keep the cores busy."""
    def one(name: str) -> tuple[str, PipelineModel]:
        return name, fits[name](rows)

    with ThreadPool(max(1, len(fits))) as pool:
        return dict(pool.map(inheritable_thread_target(one), fits))


def training_summary(train: DataFrame, test: DataFrame, model: PipelineModel, name: str,
                     seconds: float | None = None) -> DataFrame:
    """Sizes, feature count and settings of one training run as metric rows, with its time where given."""
    learner = model.stages[-1]
    settings = {p.name: str(learner.getOrDefault(p)) for p in learner.params if learner.isDefined(p)
                and p.name in {*BOOST_PARAMS, *FOREST_PARAMS, "seed", "maxBins"}}
    sizes = train.agg(F.count(F.lit(1)).alias("train_size"), F.lit(test.count()).alias("test_size"))
    values = {"features": str(len(FEATURES)), **settings}
    if seconds is not None:
        values["train_seconds"] = f"{seconds:.2f}"
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("string").alias("value"))
                     for k in ("train_size", "test_size")],
                   *[F.struct(F.lit(k).alias("metric"), F.lit(v).alias("value")) for k, v in values.items()])
    return sizes.select(F.lit(name).alias("model"), F.explode(rows).alias("_r")).select("model", "_r.*")
