"""Models on feature tables with Spark ML's boosted trees (M-1 to M-5)."""

from __future__ import annotations

import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evaluate
from .lineage import once


def _train(df, features, model, validation):
    stages = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"), model])
    filled = lambda d: d.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})
    data = filled(df)
    if validation is not None:
        data = data.withColumn("_val", F.lit(False)).unionByName(filled(validation).withColumn("_val", F.lit(True)), allowMissingColumns=True)
        model.setValidationIndicatorCol("_val")
    return stages.fit(data)


def train_regressor(df: DataFrame, features, target: str, validation: DataFrame | None = None, **params) -> PipelineModel:
    """M-1: null features count 0; with a validation set boosting stops when it gets worse."""
    return _train(df, features, GBTRegressor(labelCol=target, seed=params.pop("seed", 42), **{"maxIter": 30, **params}), validation)


def train_classifier(df: DataFrame, features, target: str, validation: DataFrame | None = None, weight: float | None = None, **params) -> PipelineModel:
    """M-2: ``weight`` of positive rows, as A-25 gives it."""
    model = GBTClassifier(labelCol=target, seed=params.pop("seed", 42), **{"maxIter": 30, **params})
    if weight is not None:
        df = df.withColumn("_w", F.when(F.col(target) == 1, weight).otherwise(1.0))
        validation = validation.withColumn("_w", F.lit(1.0)) if validation is not None else None
        model.setWeightCol("_w")
    return _train(df, features, model, validation)


def predict(model: PipelineModel, df: DataFrame, into: str = "predicted") -> DataFrame:
    """Regression: values of 0 at least; classification: the probability of 1."""
    features = model.stages[0].getInputCols()
    out = model.transform(df.select(*[c for c in df.columns if c not in features], *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features]))
    value = vector_to_array("probability")[1] if "probability" in out.columns else F.greatest(F.lit(0.0), F.col("prediction"))
    return out.withColumn(into, value).drop("features", "rawPrediction", "probability", "prediction")


def importance(model: PipelineModel, df: DataFrame, n: int | None = None) -> DataFrame:
    """M-3: (feature, importance), highest first."""
    names, values = model.stages[0].getInputCols(), model.stages[1].featureImportances.toArray()
    rows = sorted(zip(names, map(float, values)), key=lambda x: (-x[1], x[0]))[:n]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def random_search(df: DataFrame, features, target: str, space: dict, tries: int = 8, folds: int = 3, classifier: bool = False, seed: int = 42, parallelism: int = 4):
    """M-4: (best parameters, rows of all tries) by cross-validation of sampled settings."""
    rng = random.Random(seed)
    model = (GBTClassifier if classifier else GBTRegressor)(labelCol=target, seed=seed)
    maps = [{model.getParam(k): rng.choice(v) for k, v in space.items()} for _ in range(tries)]
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"), model])
    scorer = BinaryClassificationEvaluator(labelCol=target) if classifier else RegressionEvaluator(labelCol=target, metricName="mae")
    fitted = CrossValidator(estimator=pipeline, estimatorParamMaps=maps, evaluator=scorer, numFolds=folds, seed=seed, parallelism=parallelism).fit(df)
    tried = [({p.name: v for p, v in m.items()}, s) for m, s in zip(maps, fitted.avgMetrics)]
    best = (max if classifier else min)(tried, key=lambda x: x[1])
    return best[0], df.sparkSession.createDataFrame([(str(p), float(s)) for p, s in tried], "parameters string, score double")


def ordered_search(df: DataFrame, features, target: str, space: dict, period: str, folds: DataFrame, tries: int = 8, classifier: bool = False, seed: int = 42):
    """M-4 on rows in time: (best parameters, rows of all tries by fold).

    ``folds`` (fold, at, until) are those of ``dataset.expanding_folds``: a try learns from the
    periods up to ``until`` and is scored on the period ``at``, so nothing is learned from a
    later row.  Scores: mean absolute error (regression), area under the ROC (classification;
    folds with one class give none).  The row ``constant`` is the error of the mean of the
    training rows, or 0.5.  Rows without a target are left out; null features count 0.  The
    best has the best mean over the folds; ties go to the earlier try."""
    rng = random.Random(seed)
    model = (GBTClassifier if classifier else GBTRegressor)(labelCol=target, seed=seed)
    maps = [{model.getParam(k): rng.choice(v) for k, v in space.items()} for _ in range(tries)]
    names = [str({p.name: v for p, v in m.items()}) for m in maps]
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"), model])
    scorer = BinaryClassificationEvaluator(labelCol=target) if classifier else RegressionEvaluator(labelCol=target, metricName="mae")
    # each fold and try reads these rows several times
    filled = df.where(F.col(target).isNotNull()).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})
    data = once(filled.select(*dict.fromkeys([*features, target, period])))
    rows = []
    for fold in folds.orderBy("fold").collect():  # a row for each fold
        train, test = data.where(F.col(period) <= F.lit(fold["until"])), data.where(F.col(period) == F.lit(fold["at"]))
        facts = train.agg(F.count("*").alias("n"), F.avg(target).alias("mean")).first()
        held = test.agg(F.count("*").alias("n"), F.avg(F.abs(F.col(target) - F.lit(facts["mean"]))).alias("off"), F.count_distinct(target).alias("kinds")).first()
        sizes = (int(facts["n"]), int(held["n"]))
        if not all(sizes) or (classifier and held["kinds"] < 2):
            continue
        rows.append((fold["fold"], *sizes, -1, "constant", 0.5 if classifier else float(held["off"])))
        for k, fitted in pipeline.fitMultiple(train, maps):
            rows.append((fold["fold"], *sizes, k, names[k], float(scorer.evaluate(fitted.transform(test)))))
    scores = [[r[5] for r in rows if r[3] == k] for k in range(tries)]
    means = [(sum(s) / len(s), k) for k, s in enumerate(scores) if s]
    best = min(means, key=lambda x: (-x[0] if classifier else x[0], x[1]), default=(None, None))[1]
    tried = df.sparkSession.createDataFrame(sorted(rows), "fold int, train_rows long, test_rows long, try int, parameters string, score double")
    return None if best is None else {p.name: v for p, v in maps[best].items()}, tried


def evaluate_model(predicted: DataFrame, truth: str, pred: str, category: str | None = None) -> dict[str, DataFrame]:
    """M-5, regression."""
    out = {"metrics": evaluate.regression_metrics(predicted, truth, pred), "residuals": evaluate.residual_summary(predicted, truth, pred), "baseline": evaluate.baseline_comparison(predicted, truth, pred)}
    return out | ({"by_category": evaluate.error_by(predicted, category, truth, pred)} if category else {})


def evaluate_classifier(predicted: DataFrame, truth: str, prob: str, cut: float = 0.5) -> dict[str, DataFrame]:
    """M-5, classification."""
    d = predicted.withColumn("_pred", (F.col(prob) >= cut).cast("int"))
    return {"metrics": evaluate.classification_metrics(d, truth, "_pred"), "auc": evaluate.roc_auc(predicted, truth, prob)}
