"""Quality of risk scores against known outcomes."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from careframe.operators.running import running_totals

POSITIVE, NEGATIVE = "positive", "negative"
LOGIT_EDGE = 1e-6


def labelled(predictions: DataFrame, score: str = "risk_score", outcome: str = "actual_outcome") -> DataFrame:
    """(score, y) of the predictions that have a score and whose outcome is known."""
    known = predictions.filter(F.col(outcome).isin(POSITIVE, NEGATIVE) & F.col(score).isNotNull())
    return known.select(F.col(score).alias("score"), (F.col(outcome) == POSITIVE).cast("int").alias("y"))


def confusion(predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: sample size, confusion counts, accuracy, precision, recall, F1, Brier score."""
    rows = labelled(predictions)
    said, is_positive = F.col("score") >= F.lit(threshold), F.col("y") == 1
    counts = rows.agg(
        F.count("*").alias("sample_size"),
        F.count_if(said & is_positive).alias("tp"), F.count_if(said & ~is_positive).alias("fp"),
        F.count_if(~said & is_positive).alias("fn"), F.count_if(~said & ~is_positive).alias("tn"),
        F.avg(F.pow(F.col("score") - F.col("y"), F.lit(2))).alias("brier_score"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({
        "accuracy": F.try_divide(tp + tn, F.col("sample_size")),
        "precision": F.try_divide(tp, tp + fp),
        "recall": F.try_divide(tp, tp + fn),
        "f1_score": F.try_divide(tp * 2, tp * 2 + fp + fn),
    })


def auc(predictions: DataFrame) -> DataFrame:
    """Area under the ROC curve, ties counted half.

    Scores are folded to one row per distinct value; the negatives below each
    value come from a running total, so no task sees the whole order.
    """
    per_score = labelled(predictions).groupBy("score").agg(
        F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    below = running_totals(per_score, "score", ["neg"])
    wins = F.sum((F.col("pos") * (F.col("neg_before") + F.col("neg") / F.lit(2.0))))
    return below.agg(F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg")).alias("auc_roc"))


def calibration_slope(predictions: DataFrame) -> float:
    """Slope of a logistic regression of the outcome on the logit of the score."""
    rows = labelled(predictions)
    inner = F.least(F.lit(1 - LOGIT_EDGE), F.greatest(F.lit(LOGIT_EDGE), F.col("score")))
    logits = rows.select(F.col("y").cast("double").alias("label"), F.log(inner / (1 - inner)).alias("logit"))
    vectors = VectorAssembler(inputCols=["logit"], outputCol="features").transform(logits)
    return float(LogisticRegression(maxIter=100, regParam=0.0).fit(vectors).coefficients[0])


def performance(predictions: DataFrame, model_version: str, sti_type: str, evaluated_on) -> DataFrame:
    """A row for the model performance table."""
    area = auc(predictions).first()["auc_roc"]
    slope = calibration_slope(predictions)
    return confusion(predictions).select(
        F.lit(model_version).alias("model_version"), F.lit(sti_type).alias("sti_type"),
        F.lit(area).cast("double").alias("auc_roc"), "precision", "recall", "f1_score", "accuracy",
        F.lit(slope).alias("calibration_slope"), "brier_score",
        F.lit(evaluated_on).cast("date").alias("evaluated_on"), "sample_size")
