"""Training of pluggable risk models with Spark ML."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, functions as F

from careframe.functions.features import FEATURE_NAMES, named_features

# Defaults of a training job.
TEST_SIZE, RANDOM_STATE, FOLDS = 0.2, 42, 5

# Model types and the estimator each is trained with; both boosting types use Spark's own.
ESTIMATORS = {
    "logistic_regression": LogisticRegression,
    "random_forest": RandomForestClassifier,
    "xgboost": GBTClassifier,
    "lightgbm": GBTClassifier,
    "neural_network": MultilayerPerceptronClassifier,
    "svm": LinearSVC,
}
HIDDEN_LAYER = 8


@dataclass
class SparkRiskModel:
    """A fitted Spark ML chain as a risk model."""

    fitted: PipelineModel
    version: str
    name: str
    feature_names: list[str] = field(default_factory=lambda: list(FEATURE_NAMES))

    def transform(self, df: DataFrame) -> DataFrame:
        """Probability of the positive class, or the 0/1 prediction of models without one."""
        filled = df.withColumns(dict(zip(self.feature_names, named_features(df, self.feature_names), strict=True)))
        made = self.fitted.transform(filled)
        if "probability" in made.columns:
            value = vector_to_array("probability")[1]
        else:
            value = F.col("prediction").cast("double")
        return made.select(*df.columns, value.alias("probability"))

    def importances(self) -> list[tuple[str, float]]:
        last = self.fitted.stages[-1]
        for name in ("featureImportances", "coefficients"):
            weights = getattr(last, name, None)
            if weights is not None:
                return list(zip(self.feature_names, [float(w) for w in weights.toArray()], strict=True))
        return []


def _estimator(model_type: str, features: int, seed: int, hyperparameters: dict):
    kind = ESTIMATORS[model_type]
    settings = dict(hyperparameters)
    if model_type == "neural_network":
        settings.setdefault("layers", [features, HIDDEN_LAYER, 2])
    if kind.hasParam(kind(), "seed"):
        settings.setdefault("seed", seed)
    return kind(featuresCol="features", labelCol="label", **settings)


def train(
    rows: DataFrame, label: str, model_type: str, version: str, feature_names: list[str] = FEATURE_NAMES,
    test_size: float = TEST_SIZE, random_state: int = RANDOM_STATE, folds: int = FOLDS,
    hyperparameters: dict | None = None, grid: dict | None = None, scale: bool = True,
) -> tuple[SparkRiskModel, dict]:
    """(model, metrics): fit with cross validation and score on the rows held out.

    Rows are read straight from the cluster by the estimators; nothing but the
    fitted parameters and the metrics comes back.
    """
    names = list(feature_names)
    data = rows.select(*named_features_as(rows, names), F.col(label).cast("double").alias("label"))
    training, held_out = data.randomSplit([1 - test_size, test_size], seed=random_state)
    assembled = "raw" if scale else "features"
    stages = [VectorAssembler(inputCols=names, outputCol=assembled)]
    if scale:
        stages.append(StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True))
    estimator = _estimator(model_type, len(names), random_state, hyperparameters or {})
    chain = Pipeline(stages=[*stages, estimator])
    ranking = BinaryClassificationEvaluator(rawPredictionCol="rawPrediction", labelCol="label")
    if folds > 1:
        builder = ParamGridBuilder()
        for param, values in (grid or {}).items():
            builder = builder.addGrid(estimator.getParam(param), values)
        search = CrossValidator(estimator=chain, estimatorParamMaps=builder.build(), evaluator=ranking,
                                numFolds=folds, seed=random_state)
        outcome = search.fit(training)
        fitted, fold_auc = outcome.bestModel, max(outcome.avgMetrics)
    else:
        fitted, fold_auc = chain.fit(training), None
    judged = fitted.transform(held_out)

    def metric(name: str) -> float:
        return MulticlassClassificationEvaluator(labelCol="label", metricName=name, metricLabel=1.0).evaluate(judged)

    metrics = {
        "validation_auc_roc": fold_auc,
        "test_auc_roc": ranking.evaluate(judged),
        "test_f1": metric("fMeasureByLabel"),
        "validation_accuracy": metric("accuracy"),
        "precision": metric("precisionByLabel"),
        "recall": metric("recallByLabel"),
    }
    return SparkRiskModel(fitted, version, model_type, names), metrics


def named_features_as(df: DataFrame, names: list[str]) -> list:
    return [c.alias(n) for n, c in zip(names, named_features(df, names), strict=True)]


def choose_model(models: dict[str, object], name: str | None = None):
    """The trained model of that name (the default name when none is given), or ``None``
    so that scoring uses the rule-based score."""
    return models.get(name or "sti_risk_v1")
