"""Risk scoring of whole patient tables: one narrow projection, no shuffle."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, functions as F

from careframe.functions.features import FEATURE_NAMES, feature_exprs, feature_vector, named_features
from careframe.functions.predicates import time_literal
from careframe.functions.scalars import clamp, full_name, interval, risk_level
from careframe.operators.keyed import spread_join

# Fixed values of the rule-based score.
PARTNER_WEIGHT, PARTNER_CAP = 0.05, 0.3
PRIOR_WEIGHT = 0.15
SUBSTANCE_WEIGHT = 0.1
SYMPTOMS_WEIGHT = 0.1
HIV_POSITIVE_WEIGHT = 0.15
HIV_UNKNOWN_WEIGHT = 0.05
CONDOM_WEIGHT = 0.2
MALE_WEIGHT = 0.05
NO_RECORD_SCORE = 0.3
MANY_TESTS_ABOVE = 0.3
HEURISTIC_HALF_WIDTH, MODEL_HALF_WIDTH = 0.15, 0.1
HEURISTIC_VERSION, HEURISTIC_NAME = "heuristic_v1", "Rule-based Heuristic"
HEURISTIC_FACTORS = {"heuristic_model": "Using rule-based fallback"}
HEURISTIC_ACTIONS = "Schedule screening appointment. Provide risk reduction counseling."

# Recommended tests, from fewest to most.
TESTS_FEW = ("HIV", "Syphilis")
TESTS_SOME = ("HIV", "Syphilis", "Gonorrhea", "Chlamydia")
TESTS_ALL = ("HIV", "Syphilis", "Gonorrhea", "Chlamydia", "Hepatitis B", "HPV")

# Advice texts of the model path.
ACTIONS_HIGH = (
    "Immediate comprehensive STI screening recommended. "
    "Provide risk reduction counseling. "
    "Consider PrEP evaluation for HIV. "
    "Partner notification and contact tracing. "
    "Follow-up in 2-4 weeks."
)
ACTIONS_MODERATE = (
    "Routine STI screening recommended. "
    "Provide condom counseling and risk reduction education. "
    "Schedule follow-up in 3 months. "
    "Consider PrEP if ongoing risk factors."
)
ACTIONS_LOW = (
    "Continue routine screening per guidelines. "
    "Reinforce safer sex practices. "
    "Annual rescreening recommended."
)

RESULT_COLUMNS = (
    "sti_type", "risk_score", "risk_level", "confidence_interval_lower", "confidence_interval_upper",
    "top_risk_factors", "input_features", "model_version", "model_name", "recommended_tests",
    "recommended_actions",
)


class RiskModel(Protocol):
    """What a pluggable model provides."""

    version: str
    name: str

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``probability`` to a frame holding one column per feature."""

    def importances(self) -> list[tuple[str, float]]:
        """Feature weights in feature order; empty when the model has none."""


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _points(condition: Column, weight: float) -> Column:
    return F.when(condition, F.lit(weight)).otherwise(F.lit(0.0))


def heuristic_score() -> Column:
    """Unrounded rule-based score over patient columns.

    Levels cut the score at exact thresholds, so the terms are added strictly
    left to right.
    """
    terms = (
        clamp(F.col("number_of_partners_12m") * F.lit(PARTNER_WEIGHT), low=None, high=PARTNER_CAP),
        _points(F.col("prior_sti_history"), PRIOR_WEIGHT),
        _points(F.col("substance_use"), SUBSTANCE_WEIGHT),
        _points(F.col("symptoms_present"), SYMPTOMS_WEIGHT),
        _points(F.col("hiv_status") == "positive", HIV_POSITIVE_WEIGHT),
        _points(F.col("hiv_status") == "unknown", HIV_UNKNOWN_WEIGHT),
        (F.lit(1.0) - F.col("condom_use_frequency")) * F.lit(CONDOM_WEIGHT),
        _points(F.col("gender") == "M", MALE_WEIGHT),
    )
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return clamp(total, low=None, high=1.0)


def heuristic_tests(score: Column) -> Column:
    return F.when(score > MANY_TESTS_ABOVE, _strings(TESTS_SOME)).otherwise(_strings(TESTS_FEW))


def model_tests(level: Column) -> Column:
    return (F.when(level.isin("high", "very_high"), _strings(TESTS_ALL))
            .when(level == "moderate", _strings(TESTS_SOME)).otherwise(_strings(TESTS_FEW)))


def model_actions(level: Column) -> Column:
    return (F.when(level.isin("high", "very_high"), F.lit(ACTIONS_HIGH))
            .when(level == "moderate", F.lit(ACTIONS_MODERATE)).otherwise(F.lit(ACTIONS_LOW)))


def top_factors(names: list[str], weights: Column, n: int = 5) -> Column:
    """The ``n`` largest weights (by absolute value, four digits) as name/weight structs.

    Equal weights keep feature order.
    """
    ranked = F.transform(weights, lambda w, i: F.struct(
        (-F.round(F.abs(w), 4)).alias("order"), i.alias("place"),
        F.element_at(_strings(names), (i + 1).cast("int")).alias("name")))
    return F.transform(F.slice(F.array_sort(ranked), 1, n),
                       lambda s: F.struct(s["name"].alias("name"), (-s["order"]).alias("weight")))


def _factor_map(model: RiskModel) -> Column:
    pairs = model.importances()
    if not pairs:
        return F.lit(None).cast("map<string,string>")
    entries = top_factors([n for n, _ in pairs], F.array(*[F.lit(float(w)) for _, w in pairs]))
    return F.map_from_entries(F.transform(entries, lambda s: F.struct(s["name"], s["weight"].cast("string"))))


def _feature_map(exprs: dict[str, Column]) -> Column:
    return F.map_from_arrays(_strings(exprs), F.array(*exprs.values()))


def score(patients: DataFrame, as_of, model: RiskModel | None = None, sti_type: str = "general") -> DataFrame:
    """Add the result columns to a patient table.

    Uses the model when there is one, the rule-based score otherwise.
    ``sti_type`` is stored with the result and never changes it.
    """
    features = feature_exprs(as_of)
    if model is None:
        scored = patients.withColumn("_score", heuristic_score())
        width, version, name = HEURISTIC_HALF_WIDTH, HEURISTIC_VERSION, HEURISTIC_NAME
        factors = F.create_map(*[F.lit(v) for pair in HEURISTIC_FACTORS.items() for v in pair])
        tests, actions = heuristic_tests(F.col("_score")), F.lit(HEURISTIC_ACTIONS)
    else:
        # The model sees its feature columns beside the untouched patient row.
        row = F.struct(*[F.col(c) for c in patients.columns]).alias("_patient")
        scored = model.transform(patients.select(row, *[e.alias(n) for n, e in features.items()]))
        scored = scored.select("_patient.*", clamp(F.col("probability")).alias("_score"))
        width, version, name = MODEL_HALF_WIDTH, model.version, model.name
        factors = _factor_map(model)
        tests, actions = model_tests(risk_level(F.col("_score"))), model_actions(risk_level(F.col("_score")))
    lower, upper = interval(F.col("_score"), width)
    return scored.select(
        *patients.columns,
        F.lit(sti_type or "general").alias("sti_type"),
        F.round("_score", 4).alias("risk_score"),
        risk_level(F.col("_score")).alias("risk_level"),
        lower.alias("confidence_interval_lower"),
        upper.alias("confidence_interval_upper"),
        factors.alias("top_risk_factors"),
        _feature_map(features).alias("input_features"),
        F.lit(version).alias("model_version"),
        F.lit(name).alias("model_name"),
        tests.alias("recommended_tests"),
        actions.alias("recommended_actions"),
    )


def score_features(features: DataFrame, model: RiskModel | None = None) -> DataFrame:
    """Score rows that are feature values without a patient record.

    Without a model every such row gets the constant score.
    """
    if model is None:
        return features.withColumn("probability", F.lit(NO_RECORD_SCORE))
    values = dict(zip(FEATURE_NAMES, named_features(features), strict=True))
    return model.transform(features.withColumns(values)).withColumn("probability", clamp(F.col("probability")))


def request_rows(requests: DataFrame, patients: DataFrame, key: str = "patient_id") -> DataFrame:
    """Requested ids (``pos``, ``patient_id``) matched to *active* patients.

    Repeated ids stay repeated and unknown or inactive ids drop out; ``pos``
    carries the request order.  An id requested very often is spread.
    """
    return spread_join(requests, patients.filter("is_active"), key)


def requested_ids(ids: DataFrame, column: str = "patient_ids") -> DataFrame:
    """(pos, patient_id) rows from one array of requested ids."""
    return ids.select(F.posexplode(column).alias("pos", "patient_id"))


def score_batch(
    requests: DataFrame, patients: DataFrame, as_of, model: RiskModel | None = None,
    sti_type: str = "general", first_id: int = 0,
) -> DataFrame:
    """Prediction rows for a batch of requested ids, in the shape of the predictions table."""
    scored = score(request_rows(requests, patients), as_of, model, sti_type)
    return scored.select(
        (F.col("pos") + F.lit(first_id)).cast("long").alias("id"),
        F.col("id").alias("patient_key"), "patient_id",
        full_name(F.col("first_name"), F.col("last_name")).alias("patient_name"),
        F.lit(None).cast("long").alias("clinician_id"),
        *RESULT_COLUMNS,
        F.lit(False).alias("validated_by_clinician"), F.lit("").alias("clinician_notes"),
        F.lit("").alias("actual_outcome"), time_literal(as_of).alias("created_at"),
    )


@dataclass
class LinearRiskModel:
    """Logistic model given by its weights; evaluated as one column expression."""

    weights: dict[str, float]
    intercept: float = 0.0
    version: str = "sti_risk_v1"
    name: str = "logistic_regression"
    means: list[float] | None = None
    scales: list[float] | None = None
    names: list[str] = field(init=False)

    def __post_init__(self):
        self.names = list(self.weights)

    def transform(self, df: DataFrame) -> DataFrame:
        vector = feature_vector(named_features(df, self.names), self.means, self.scales)
        pairs = F.zip_with(vector, F.array(*[F.lit(float(w)) for w in self.weights.values()]), lambda v, w: v * w)
        margin = F.aggregate(pairs, F.lit(float(self.intercept)), lambda total, v: total + v)
        return df.withColumn("probability", F.lit(1.0) / (F.lit(1.0) + F.exp(-margin)))

    def importances(self) -> list[tuple[str, float]]:
        return list(self.weights.items())
