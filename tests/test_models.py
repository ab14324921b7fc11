"""Scoring paths, plug-in models, training and evaluation."""

import math

import pytest
from pyspark.sql import functions as F

from careframe.functions.features import FEATURE_NAMES, feature_columns, feature_exprs
from careframe.operators import evaluate as ev, learn, scoring as sc
from careframe.plans import adapters

FOLDER = "/root/testdata/sf0.001"
DAY = adapters.AGES_AS_OF


@pytest.fixture(scope="module")
def patients(spark):
    return adapters.patients(spark, FOLDER)


@pytest.fixture(scope="module")
def training_rows(spark, patients):
    """Features with an outcome that mostly follows partners and symptoms."""
    k = F.col("id")
    rows = feature_columns(patients, DAY)
    signal = F.col("num_partners_12m") * 0.5 + F.col("symptoms_present") * 2 + (k * 7919 % 13) / 10.0
    return rows.withColumn("label", (signal > 3.0).cast("double"))


def test_heuristic_result_shape(patients):
    scored = sc.score(patients, DAY, sti_type="")
    row = scored.filter("id = 33").first()
    assert set(sc.RESULT_COLUMNS) <= set(scored.columns)
    assert row["top_risk_factors"] == {"heuristic_model": "Using rule-based fallback"}
    assert row["model_name"] == "Rule-based Heuristic" and row["sti_type"] == "general"
    assert set(row["input_features"]) == set(FEATURE_NAMES)
    assert "Exchange" not in scored.drop("county")._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")


def test_linear_model(spark):
    model = sc.LinearRiskModel({"age": 0.1, "nothing": 5.0, "symptoms_present": -1.0}, 0.5)
    df = spark.createDataFrame([(10.0, 1.0), (None, 0.0)], "age double, symptoms_present double")
    got = [r["probability"] for r in model.transform(df).collect()]
    assert got == pytest.approx([1 / (1 + math.exp(-0.5)), 1 / (1 + math.exp(-0.5))])
    top = sc.score(adapters.patients(spark, FOLDER), DAY, model).first()
    assert top["top_risk_factors"] == {"nothing": "5.0", "symptoms_present": "1.0", "age": "0.1"}


def test_feature_rows_without_model_get_the_constant(spark):
    df = spark.createDataFrame([(1.0,)], "age double")
    assert sc.score_features(df).first()["probability"] == 0.3


def test_batch_keeps_order_and_repeats(spark):
    people = spark.createDataFrame(
        [(1, "P1", "a", "b", True), (2, "P2", "c", "d", False), (3, "P3", "e", "f", True)],
        "id long, patient_id string, first_name string, last_name string, is_active boolean")
    base = adapters.patients(people.sparkSession, FOLDER).drop(*people.columns).limit(1)
    values = base.first().asDict()
    people = people.withColumns({k: F.lit(v).cast(base.schema[k].dataType) for k, v in values.items()})
    asked = sc.requested_ids(spark.createDataFrame([(["P3", "P9", "P1", "P2", "P3"],)], "patient_ids array<string>"))
    got = sc.score_batch(asked, people, DAY, first_id=100).orderBy("id").collect()
    assert [(r["id"], r["patient_id"], r["patient_name"]) for r in got] == [
        (100, "P3", "e f"), (102, "P1", "a b"), (104, "P3", "e f")]


@pytest.mark.parametrize("kind", ["logistic_regression", "random_forest", "svm", "lightgbm", "neural_network"])
def test_training(spark, training_rows, patients, kind):
    model, metrics = learn.train(training_rows, "label", kind, "v1", folds=2 if kind == "logistic_regression" else 1,
                                 hyperparameters={"maxIter": 5} if kind in ("lightgbm",) else None)
    assert 0.5 < metrics["test_auc_roc"] <= 1.0 and 0 <= metrics["test_f1"] <= 1
    scored = sc.score(patients, DAY, model).select("id", "risk_score", "risk_level", "top_risk_factors", "model_version")
    rows = scored.collect()
    assert len(rows) == patients.count() and all(0 <= r["risk_score"] <= 1 for r in rows)
    if kind == "svm":
        assert {r["risk_score"] for r in rows} <= {0.0, 1.0}
    names = [n for n, _ in model.importances()]
    assert names == ([] if kind == "neural_network" else list(FEATURE_NAMES))
    if names:
        assert len(rows[0]["top_risk_factors"]) == 5


def test_model_choice():
    model = sc.LinearRiskModel({})
    assert learn.choose_model({}) is None
    assert learn.choose_model({"sti_risk_v1": model}) is model
    assert learn.choose_model({"sti_risk_v1": model}, "other") is None


def test_evaluation(spark):
    data = [(0.9, "positive"), (0.8, "negative"), (0.8, "positive"), (0.3, "negative"), (0.2, "positive"), (0.1, "negative"),
            (0.5, "")]
    df = spark.createDataFrame(data, "risk_score double, actual_outcome string")
    row = ev.confusion(df).first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"], row["sample_size"]) == (2, 1, 1, 2, 6)
    assert row["precision"] == row["recall"] == row["f1_score"] == pytest.approx(2 / 3)
    assert row["brier_score"] == pytest.approx((0.01 + 0.64 + 0.04 + 0.09 + 0.64 + 0.01) / 6)
    # Pairs won, ties as a half: 3 + 2.5 + 1 of 9.
    assert ev.auc(df).first()[0] == pytest.approx(6.5 / 9)
    one_sided = df.filter("actual_outcome = 'positive'")
    assert ev.auc(one_sided).first()[0] is None and ev.confusion(one_sided.limit(0)).first()["precision"] is None


def test_performance_row(spark):
    made = adapters.predictions(spark, FOLDER)
    row = ev.performance(made, "v1", "general", "2024-01-01").first()
    assert 0 <= row["auc_roc"] <= 1 and row["sample_size"] == made.filter("actual_outcome <> ''").count()


def test_features_of_missing_values_are_zero(spark, patients):
    empty = patients.limit(1).withColumns({c: F.lit(None).cast(t) for c, t in patients.dtypes})
    row = empty.select(*[e.alias(n) for n, e in feature_exprs(DAY).items()]).first()
    assert set(row) == {0.0}
