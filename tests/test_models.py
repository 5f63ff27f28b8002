"""Properties of trained models on specimen URLs; exact numbers depend on the learner."""

import math
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from lurewatch.fixed.words import FEATURES
from lurewatch.operators import attribution, evaluate as E, models as M, trees
from lurewatch.plans import queries as Q

SF = "/root/testdata/sf0.001"
SMALL_BOOST = {"maxIter": 10, "maxDepth": 4}
SMALL_FOREST = {"numTrees": 20, "maxDepth": 6}


@pytest.fixture(scope="module")
def sides(spark):
    return Q._sides(Q._training_table(spark, SF))


@pytest.fixture(scope="module")
def boosted(sides):
    return M.fit_boosted(sides[0], SMALL_BOOST)


@pytest.fixture(scope="module")
def forest(sides):
    return M.fit_forest(sides[0], SMALL_FOREST)


def test_probabilities_and_quality(sides, boosted, forest):
    scored = M.score_models(sides[1], boosted, forest)
    lo, hi, n = scored.agg(F.min("ml_score"), F.max("ml_score"), F.count("ml_score")).first()
    assert 0 <= lo <= hi <= 1 and n == sides[1].count()
    pred = scored.withColumn("proba", F.col("ml_score")).withColumn("pred", (F.col("ml_score") >= 0.5).cast("int"))
    f1 = E.metrics(pred.withColumn("model", F.lit("m")), ["model"]).first()["f1"]
    base = M.random_baseline(sides[1], sides[0]).withColumn("model", F.lit("r"))
    assert f1 > E.metrics(base, ["model"]).first()["f1"] + 0.2


def test_same_seed_same_scores(sides, boosted):
    again = M.fit_boosted(sides[0], SMALL_BOOST)
    a = {r.url_id: r.p for r in M.proba(sides[1], boosted, "p").select("url_id", "p").collect()}
    b = {r.url_id: r.p for r in M.proba(sides[1], again, "p").select("url_id", "p").collect()}
    assert a == b


def test_small_trees_walked_by_hand(spark, sides, tmp_path):
    """The stored node table, walked in plain Python, gives the scores that the fitted models give."""
    names, rows = FEATURES, sides[1].collect()
    for kind, fit, params in (("forest", M.fit_forest, {"numTrees": 3, "maxDepth": 3}), ("boosted", M.fit_boosted, {"maxIter": 3, "maxDepth": 2})):
        model = fit(sides[0], params)
        learner = model.stages[-1]
        learner.write().overwrite().save(str(tmp_path / kind))
        nodes = {(r.treeID, r.nodeData.id): r.nodeData for r in spark.read.parquet(str(tmp_path / kind / "data")).collect()}

        def leaf(tree, values):
            node = nodes[tree, 0]
            while node.leftChild >= 0:
                split = node.split
                left = values[split.featureIndex] <= split.leftCategoriesOrThreshold[0]
                node = nodes[tree, node.leftChild if left else node.rightChild]
            return node

        got = {r.url_id: r.p for r in M.proba(sides[1], model, "p").select("url_id", "p").collect()}
        for r in rows:
            leaves = [leaf(t, [float(r[f]) for f in names]) for t in range(learner.getNumTrees)]
            if kind == "forest":
                expect = sum(x.impurityStats[1] / sum(x.impurityStats) for x in leaves) / len(leaves)
            else:
                margin = sum(x.prediction * w for x, w in zip(leaves, learner.treeWeights))
                expect = 1 / (1 + math.exp(-2 * margin))
            assert math.isclose(got[r.url_id], expect, rel_tol=1e-9), (kind, r.url_id)


def test_importances_sum_to_one(spark, boosted, forest):
    rows = M.feature_importance(boosted, forest, spark).collect()
    assert len(rows) == 24
    assert math.isclose(sum(r.boosted_importance for r in rows), 1, abs_tol=1e-9)
    assert math.isclose(sum(r.forest_importance for r in rows), 1, abs_tol=1e-9)


def test_attribution_adds_up_to_the_margin(sides, boosted):
    learner = boosted.stages[-1]
    raw = {r.url_id: r.rawPrediction[1] for r in boosted.transform(sides[1]).select("url_id", "rawPrediction").collect()}
    for r in attribution.attribution(sides[1], boosted).collect():
        assert math.isclose(r.margin, raw[r.url_id], rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r.base_value + sum(r[f] for f in FEATURES), r.margin, rel_tol=1e-9, abs_tol=1e-9)
    assert learner.getNumTrees == 10


def test_attribution_matches_brute_force():
    """Shares of one leaf against the definition over all orderings of the path features."""
    from itertools import permutations
    z, value = np.array([0.3, 0.5, 0.9]), 2.0
    shares = attribution._shares(z, value, (np.arange(8)[:, None] >> np.arange(3) & 1).astype(float))
    for pattern in range(8):
        agree = [(pattern >> j) & 1 for j in range(3)]
        worth = lambda s: value * math.prod(agree[j] if j in s else z[j] for j in range(3))  # noqa: B023, E731
        expect = np.zeros(3)
        for order in permutations(range(3)):
            seen = set()
            for j in order:
                expect[j] += (worth(seen | {j}) - worth(seen)) / 6
                seen.add(j)
        assert np.allclose(shares[pattern], expect)


def test_attribution_top_is_ranked(sides, boosted):
    top = attribution.attribution_top(sides[1], boosted, top=12)
    per = top.groupBy("url_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(
        F.struct("rank", F.abs("contribution").alias("a")))).alias("x")).collect()
    assert all(r.n == 12 and all(p.a >= q.a for p, q in zip(r.x, r.x[1:])) for r in per)


def test_missing_model_is_a_clear_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="train and save"):
        M.load_model(str(tmp_path / "none"))


def test_grid_search_and_rank(sides):
    best, table = M.grid_search(sides[0], "forest", {"numTrees": [3], "maxDepth": [2, 4]}, folds=2)
    rows = table.collect()
    assert len(rows) == 2 and min(r["rank"] for r in rows) == 1
    assert M.rank_of(table, {"numTrees": 3, "maxDepth": 4}).count() == 1
    assert set(best.transform(sides[0]).columns) >= {"probability"}
    assert len(M._settings(M.BOOST_GRID)) == len(M._settings(M.FOREST_GRID)) == 48


def test_features_have_no_nulls(sides):
    assert sides[0].where(" or ".join(f"{f} is null" for f in FEATURES)).count() == 0


def test_fitting_table_has_a_part_per_core(spark):
    cores = spark.sparkContext.defaultParallelism
    for rows, most, parts in ((0, 10 ** 6, 1), (25_000, 10 ** 6, 2), (900_000, 10 ** 6, cores), (900_000, 50_000, 3 * cores)):
        table = M.fitting_table(spark.range(rows).withColumnRenamed("id", "url_id"), most_rows=most)
        assert table.rdd.getNumPartitions() == parts and table.distinct().count() == rows
        table.unpersist()


def test_models_fitted_side_by_side_are_those_fitted_alone(sides, boosted, forest):
    meet = threading.Barrier(2, timeout=60)  # breaks if one fit ends before the other begins

    def after_meeting(fit, params):
        return lambda rows: (meet.wait(), fit(rows, params))[1]

    both = M.fit_side_by_side(sides[0], {"boosted": after_meeting(M.fit_boosted, SMALL_BOOST), "forest": after_meeting(M.fit_forest, SMALL_FOREST)})
    alone = M.score_models(sides[1], boosted, forest).select("url_id", "p_boosted", "p_forest").collect()
    assert sorted(alone) == sorted(M.score_models(sides[1], both["boosted"], both["forest"]).select("url_id", "p_boosted", "p_forest").collect())
    assert M.fit_side_by_side(sides[0], {}) == {}


def _made_up(rows, sizes, seed):
    """Binned rows of random bins, counts and labels."""
    rng = np.random.default_rng(seed)
    codes = np.stack([rng.integers(0, s, rows) for s in sizes], axis=1).astype(np.uint8)
    return trees.Binned(codes, rng.integers(0, 2, rows), rng.integers(1, 4, rows).astype(float), [np.arange(s - 1) + 0.5 for s in sizes], 128)


def _walk(nodes, code):
    at = 0
    while nodes.left[at] >= 0:
        at = nodes.left[at] + (code[nodes.feature[at]] > nodes.cut[at])
    return at


def test_regression_tree_is_the_plain_one():
    data = _made_up(300, [5, 2, 9, 1, 30], 1)
    r, w = np.random.default_rng(2).normal(size=300), data.counts

    def plain(rows, depth):
        """Row means of the tree that tries every cut."""
        mean = np.average(r[rows], weights=w[rows])
        best = (1e-9, None)
        for f in range(5):
            for cut in range(30):
                low = data.codes[rows, f] <= cut
                if low.any() and not low.all():
                    sides = [(w[x] * r[x]).sum() ** 2 / w[x].sum() for x in (rows[low], rows[~low])]
                    best = max(best, (sum(sides) - mean ** 2 * w[rows].sum(), (f, cut)), key=lambda x: x[0])
        if not depth or best[1] is None:
            return {i: mean for i in rows}
        low = data.codes[rows, best[1][0]] <= best[1][1]
        return {**plain(rows[low], depth - 1), **plain(rows[~low], depth - 1)}

    nodes, says = trees.regression_tree(np.ascontiguousarray(data.codes.T), np.array([5, 2, 9, 1, 30]), w, r, 4)
    expect = plain(np.arange(300), 4)
    assert np.allclose(says, [expect[i] for i in range(300)])
    stats = np.concatenate(nodes.stats)
    assert all(math.isclose(stats[a, 1] / stats[a, 0], says[i]) for i in range(300) for a in [_walk(nodes, data.codes[i])])


def test_forest_tree_holds_its_bootstrap_and_cuts_best():
    sizes = [5, 2, 9, 1, 30]
    data, weights = _made_up(300, sizes, 3), np.array([0.7, 1.9])
    raw = np.random.default_rng(4).poisson(data.counts)
    nodes = trees.forest_tree(data, weights, 6, 5, np.random.default_rng(4))
    stats, counts = np.concatenate(nodes.stats), np.concatenate(nodes.raw)
    ends = np.array([_walk(nodes, c) for c in data.codes])
    for leaf in np.flatnonzero(nodes.left < 0):
        own = ends == leaf
        assert counts[leaf] == raw[own].sum() > 0
        assert np.allclose(stats[leaf], [(raw * weights[data.labels])[own & (data.labels == k)].sum() for k in (0, 1)])

    def worth(f, cut):
        sides = [data.codes[:, f] <= cut, data.codes[:, f] > cut]
        s = [[(raw * weights[data.labels])[x & (data.labels == k)].sum() for k in (0, 1)] for x in sides]
        return sum((a * a + b * b) / (a + b) for a, b in s) if all(a + b for a, b in s) else -1
    assert math.isclose(worth(nodes.feature[0], nodes.cut[0]), max(worth(f, c) for f in range(5) for c in range(30)))


def test_fits_take_few_jobs_whatever_the_trees(spark, sides):
    """A job per tree level, as before, makes 80 of them for 20 trees of depth 4."""
    tracker = spark.sparkContext.statusTracker()
    for name, fit, params in (("few-b", M.fit_boosted, {"maxIter": 20, "maxDepth": 4}), ("few-f", M.fit_forest, {"numTrees": 20, "maxDepth": 14})):
        spark.sparkContext.setJobGroup(name, name)
        try:
            model = fit(sides[0], params)
            assert len(tracker.getJobIdsForGroup(name)) < 30
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert model.stages[-1].getNumTrees == 20


def test_model_depends_on_rows_only(sides):
    """Parts, order and copies of every row do not change the trees."""
    rows, twice = sides[0], sides[0].unionByName(sides[0])
    seen = []
    for table in (rows.coalesce(1), rows.repartition(7)):
        seen.append(M.fit_boosted(table, SMALL_BOOST).stages[-1].toDebugString.split("\n", 1)[1])
        seen.append(M.fit_forest(table, SMALL_FOREST).stages[-1].toDebugString.split("\n", 1)[1])
    assert seen[:2] == seen[2:]
    one, two = trees.binned(rows), trees.binned(twice)
    assert (one.codes == two.codes).all() and (2 * one.counts == two.counts).all()


def test_tables_that_spark_ml_has_to_learn(sides):
    rows = sides[0]
    assert trees.binned(rows, most_rows=10) is None and trees.binned(rows, max_bins=300) is None
    assert trees.binned(rows.withColumn("label", F.lit(1))) is None and trees.binned(rows.limit(0)) is None
    for odd in (F.lit(None).cast("double"), F.lit(float("nan"))):
        assert trees.binned(rows.withColumn("url_entropy", F.when(F.col("qty_dot") > 2, odd).otherwise(F.col("url_entropy")))) is None
    assert M.fit_boosted(rows, {"maxIter": 2, "maxDepth": 2}, data=None).stages[-1].getNumTrees == 2
    assert [trees.subset_size(s) for s in ("sqrt", "log2", "0.5", "all", "auto")] == [5, 5, 12, 24, None]


def test_bins_hold_every_value_or_equal_shares(spark):
    few = [F.col("id") % 7 / 7 if f == "url_entropy" else F.col("id").cast("double") if f == "alpha_ratio" else F.lit(1) for f in FEATURES]
    cuts = trees.bin_cuts(spark.range(3000).select(*[c.alias(f) for c, f in zip(few, FEATURES)]), 16)
    by = dict(zip(FEATURES, cuts))
    assert np.allclose(by["url_entropy"], (np.arange(6) + 0.5) / 7) and not len(by["qty_dot"])
    shares = np.diff([-1, *by["alpha_ratio"], 2999])
    assert len(shares) == 16 and shares.min() > 180 and shares.max() < 195


def test_both_scores_are_those_of_spark_ml(sides, forest):
    """Trees grown here and by ``spark.ml``, deep and of one node, applied in batches in one Python step."""
    rows = sides[1]
    stump = M.fit_boosted(sides[0], {"maxIter": 2, "maxDepth": 0})
    for b, f in ((M.fit_boosted(sides[0], SMALL_BOOST, data=None), M.fit_forest(sides[0], {"numTrees": 5, "maxDepth": 20})), (stump, forest)):
        scored = M.score_models(rows, b, f)
        plan = scored._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1
        old = {r.url_id: (r.b, r.f) for r in M.proba(M.proba(rows, b, "b"), f, "f").select("url_id", "b", "f").collect()}
        got = {r.url_id: (r.p_boosted, r.p_forest) for r in scored.collect()}
        assert old.keys() == got.keys() and all(np.allclose(got[k], old[k], rtol=0, atol=1e-12) for k in old)
        assert scored.columns == [*rows.columns, "p_boosted", "p_forest", "ml_score"]
    assert M.score_models(rows.limit(0), stump, forest).count() == 0
    with pytest.raises(Exception, match="null"):
        M.score_models(rows.withColumn("url_entropy", F.lit(None).cast("double")), stump, forest).collect()


def test_models_of_another_make_are_scored_by_themselves(spark, sides, boosted):
    logistic = M.fit_logistic(sides[0], max_iter=5)
    assert trees.both_scores(spark, boosted, logistic) is None
    assert M.score_models(sides[1], boosted, logistic).where("ml_score between 0 and 1").count() == sides[1].count()
