"""Training, prediction, importance, search and evaluation of models (M-1 to M-5)."""

import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from panelkiln.operators import dataset, ml


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(k, x := rng.random(), y := rng.random(), rng.random() if k % 9 else None, max(0.0, 10 * x - 3 + y), int(x + y > 1)) for k in range(600)]
    return spark.createDataFrame(data, "id long, x double, y double, noise double, target double, starts int").cache()


def test_regressor_learns_clips_and_reloads(spark, rows, tmp_path):
    train, test = rows.where("id % 4 <> 0"), rows.where("id % 4 = 0")
    model = ml.train_regressor(train, ["x", "y", "noise"], "target", maxIter=8, maxDepth=4)
    out = ml.predict(model, test.withColumn("target", F.col("target")))
    assert out.count() == test.count() and out.where("predicted < 0").count() == 0 and {"id", "x", "target", "predicted"} <= set(out.columns)
    off = lambda d, c: d.agg(F.avg(F.abs(F.col("target") - c))).first()[0]
    assert off(out, F.col("predicted")) < 0.5 * off(out, F.lit(train.agg(F.avg("target")).first()[0]))
    model.save(f"{tmp_path}/model")
    again = ml.predict(PipelineModel.load(f"{tmp_path}/model"), test)
    assert again.join(out, "id").where(again["predicted"] != out["predicted"]).count() == 0
    low = ml.train_regressor(train.withColumn("target", F.col("target") - 100), ["x"], "target", maxIter=2, maxDepth=2)
    assert ml.predict(low, test).agg(F.max("predicted")).first()[0] == 0.0
    early = ml.train_regressor(train, ["noise"], "target", validation=test, maxIter=40, maxDepth=3)
    assert early.stages[1].getNumTrees < 40


def test_classifier_weights_and_metrics(rows):
    train, test = rows.where("id % 4 <> 0"), rows.where("id % 4 = 0")
    model = ml.train_classifier(train, ["x", "y"], "starts", weight=1.5, maxIter=6, maxDepth=3)
    out = ml.predict(model, test)
    assert out.where("predicted not between 0 and 1").count() == 0
    found = ml.evaluate_classifier(out, "starts", "predicted")
    metrics = found["metrics"].first().asDict()
    assert metrics["accuracy"] > 0.9 and list(found["auc"].first().asDict().values())[0] > 0.95


def test_importance_is_sorted_and_sums_to_one(rows):
    model = ml.train_regressor(rows, ["noise", "x", "y"], "target", maxIter=4, maxDepth=3)
    found = [(r.feature, r.importance) for r in ml.importance(model, rows).collect()]
    assert [v for _, v in found] == sorted((v for _, v in found), reverse=True) and found[0][0] == "x" and abs(sum(v for _, v in found) - 1) < 1e-9
    assert [r.feature for r in ml.importance(model, rows, 2).collect()] == [f for f, _ in found[:2]]


def test_search_returns_the_best_of_its_tries(rows):
    d = rows.select("x", "y", "target", "starts")
    best, tried = ml.random_search(d, ["x", "y"], "target", {"maxDepth": [1, 4], "maxIter": [2, 4]}, tries=3, folds=2)
    scores = {r.parameters: r.score for r in tried.collect()}
    assert tried.count() == 3 and scores[str(best)] == min(scores.values()) and set(best) == {"maxDepth", "maxIter"}
    best, tried = ml.random_search(d, ["x", "y"], "starts", {"maxDepth": [1, 3], "maxIter": [2]}, tries=2, folds=2, classifier=True)
    assert {r.parameters: r.score for r in tried.collect()}[str(best)] == tried.agg(F.max("score")).first()[0]


def test_evaluation_beside_a_baseline(rows):
    d = rows.withColumn("p", F.col("target") + 1).withColumn("kind", F.col("id") % 2)
    found = ml.evaluate_model(d, "target", "p", "kind")
    assert set(found) == {"metrics", "residuals", "baseline", "by_category"} and found["by_category"].count() == 2
    assert abs(found["metrics"].first().asDict()["mae"] - 1) < 1e-9


def test_time_ordered_search_learns_from_the_past_only(spark, rows, monkeypatch):
    d = rows.withColumn("season", (F.col("id") / 100).cast("int"))
    folds = dataset.expanding_folds(d, "season", 3)
    assert [tuple(r) for r in folds.orderBy("fold").collect()] == [(1, 3, 2), (2, 4, 3), (3, 5, 4)]
    assert [tuple(r) for r in dataset.expanding_folds(d, "season", 9, gap=1).orderBy("fold").collect()][0][1:] == (2, 0)
    assert dataset.expanding_folds(d.limit(0), "season").count() == 0
    best, tried = ml.ordered_search(d, ["x", "y"], "target", {"maxDepth": [1, 4], "maxIter": [2]}, "season", folds, tries=2)
    found = tried.collect()
    assert {(r.fold, r.train_rows, r.test_rows) for r in found} == {(1, 300, 100), (2, 400, 100), (3, 500, 100)}
    means = {k: sum(r.score for r in found if r["try"] == k) / 3 for k in (0, 1)}
    assert str(best) == next(r.parameters for r in found if r["try"] == min(means, key=lambda k: (means[k], k)))
    # later targets have no say in an earlier fold
    spoiled = d.withColumn("target", F.when(F.col("season") == 5, 1e6).otherwise(F.col("target")))
    _, other = ml.ordered_search(spoiled, ["x", "y"], "target", {"maxDepth": [1, 4], "maxIter": [2]}, "season", folds, tries=2)
    early = lambda t: sorted(map(tuple, t.where("fold < 3").collect()))
    assert early(other) == early(tried)
    best, tried = ml.ordered_search(d, ["x", "y"], "starts", {"maxDepth": [2]}, "season", folds, tries=1, classifier=True)
    assert best == {"maxDepth": 2} and tried.where("parameters = 'constant' and score = 0.5").count() == 3
    assert ml.ordered_search(d.limit(0), ["x"], "target", {"maxDepth": [1]}, "season", folds, tries=1)[0] is None


def test_products_of_all_columns_equal_corr(spark):
    rng = random.Random(4)
    names = ["a", "b", "c", "far", "same", "none", "nan", "one"]
    made = lambda k: [x := rng.gauss(0, 1), None if k % 3 else 2 * x + rng.random(), None if k % 5 == 0 else rng.random(), 1e9 + x, 0.1, None, float("nan") if k == 6 else x, 1.0 if k == 0 else None]
    d = spark.createDataFrame([made(k) for k in range(300)], ", ".join(f"{n} double" for n in names)).repartition(5)
    got = {(r.feature_a, r.feature_b): r.correlation for r in dataset.correlations(d, names, 0.0).collect()}
    for k, a in enumerate(names):
        for b in names[k + 1 :]:
            if {"same", "none", "one"} & {a, b} and "nan" not in (a, b):
                assert (a, b) not in got
            elif "nan" in (a, b):
                assert "none" in (a, b) or (a, b) == ("nan", "one") or got[a, b] != got[a, b]
            else:
                assert got[a, b] == pytest.approx(d.agg(F.corr(a, b)).first()[0], abs=1e-6)
    assert set(dataset.correlations(d, ["a", "far", "c"], 0.95).select("feature_a", "feature_b").collect()) == {("a", "far")}
    assert dataset.correlations(d.limit(0), names).count() == 0 == dataset.correlations(d, ["a"]).count()


def test_two_hundred_columns(spark):
    d = spark.range(400).select(*[(F.sin(F.col("id") * (k % 100 + 1))).alias(f"c{k}") for k in range(200)])
    found = {(r.feature_a, r.feature_b) for r in dataset.correlations(d, d.columns, 0.999).collect()}
    assert {(f"c{k}", f"c{k + 100}") for k in range(100)} <= found


def test_walk_forward_leaves_rows_where_they_lie(spark):
    """rows were sorted by period, so all rows of a period were one task."""
    from panelkiln.operators import dataset

    d = spark.range(200).select("id", (F.col("id") % 4).alias("season"))
    made = dataset.walk_forward(d, spark.createDataFrame([(1, 1), (2, 3)], "fold int, at long"), "season")
    assert "SortMergeJoin" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.fold, r.role, r["count"]) for r in made.groupBy("fold", "role").count().collect()) == [(1, "test", 50), (1, "train", 50), (2, "test", 50), (2, "train", 150)]
