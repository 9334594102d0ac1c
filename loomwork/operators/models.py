"""Spark ML models behind one call."""

from __future__ import annotations

import math

from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = {
    "linear": lambda **p: LinearRegression(solver="normal", **p),
    "tree": DecisionTreeRegressor,
    "forest": RandomForestRegressor,
    "logistic": LogisticRegression,
    "tree_cls": DecisionTreeClassifier,
    "forest_cls": RandomForestClassifier,
    "gbt_cls": GBTClassifier,
    "svm": LinearSVC,
}


def estimator(kind: str, features: str = "features", label: str = "label", **params):
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {sorted(KINDS)}")
    return KINDS[kind](featuresCol=features, labelCol=label, **params)


def fit_model(kind: str, train: DataFrame, features: str = "features", label: str = "label", **params):
    if kind == "adaboost":
        return fit_adaboost(train, features, label, **params)
    return estimator(kind, features, label, **params).fit(train)


class AdaBoost:
    """Weighted vote of trees over labels 0 and 1."""

    def __init__(self, trees: list, weights: list[float]):
        self.trees, self.weights = trees, weights

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("_vote", F.lit(0.0))
        for tree, w in zip(self.trees, self.weights):
            out = tree.transform(out).withColumn("_vote", F.col("_vote") + w * (2 * F.col("prediction") - 1)).drop("prediction", "rawPrediction", "probability")
        return out.withColumn("prediction", (F.col("_vote") > 0).cast("double")).withColumnRenamed("_vote", "score")


def fit_adaboost(train: DataFrame, features: str = "features", label: str = "label", rounds: int = 10, depth: int = 2) -> AdaBoost:
    """Discrete boosting: rows got wrong weigh more in the next round.

    The weight of a row is a function of the trees so far, so nothing is kept between rounds but them.
    """
    trees, weights = [], []
    for _ in range(rounds):
        margin = AdaBoost(trees, weights).transform(train).withColumn("_w", F.exp(-F.col("score") * (2 * F.col(label) - 1))).drop("prediction", "score")
        tree = DecisionTreeClassifier(featuresCol=features, labelCol=label, weightCol="_w", maxDepth=depth).fit(margin)
        r = tree.transform(margin).agg(F.sum(F.when(F.col("prediction") != F.col(label), F.col("_w")).otherwise(0.0)).alias("bad"), F.sum("_w").alias("all")).first()
        error = min(max(r.bad / r.all, 1e-10), 1 - 1e-10)
        if error >= 0.5:
            break
        trees.append(tree)
        weights.append(0.5 * math.log((1 - error) / error))
        if error <= 1e-9:
            break
    return AdaBoost(trees, weights)


def grid_cv(model, grid: dict[str, list], train: DataFrame, folds: int = 3, metric: str = "mse", parallelism: int = 4, seed: int = 42):
    """Grid search with ``folds`` folds; the fitted CrossValidatorModel."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(model.getParam(name), values)
    evaluator = RegressionEvaluator(labelCol=model.getLabelCol(), metricName=metric)
    return CrossValidator(estimator=model, estimatorParamMaps=builder.build(), evaluator=evaluator, numFolds=folds, parallelism=parallelism, seed=seed).fit(train)


def predict_append(model, df: DataFrame, out: str = "predicted") -> DataFrame:
    """Rows with their prediction; working columns go."""
    made = model.transform(df).withColumnRenamed("prediction", out)
    return made.drop(*[c for c in made.columns if c not in df.columns and c != out])
