"""Model features of a patient, in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from careframe.functions.scalars import age_years, flag, indicator
from careframe.functions.predicates import as_instant

# Feature names, in the order models expect them.
FEATURE_NAMES = (
    "age", "gender_male", "gender_female", "gender_other",
    "num_partners_12m", "num_partners_lifetime",
    "condom_use_freq", "substance_use",
    "prior_sti_history", "hiv_positive", "hiv_unknown",
    "symptoms_present", "marital_single", "marital_married",
    "marital_divorced", "marital_cohabiting",
)

# Patient column each feature is made from, and how.
_NUMBERS = {
    "num_partners_12m": "number_of_partners_12m",
    "num_partners_lifetime": "number_of_partners_lifetime",
    "condom_use_freq": "condom_use_frequency",
}
_FLAGS = ("substance_use", "prior_sti_history", "symptoms_present")
_INDICATORS = {
    "gender_male": ("gender", "M"),
    "gender_female": ("gender", "F"),
    "gender_other": ("gender", "O", "U"),
    "hiv_positive": ("hiv_status", "positive"),
    "hiv_unknown": ("hiv_status", "unknown"),
    "marital_single": ("marital_status", "single"),
    "marital_married": ("marital_status", "married"),
    "marital_divorced": ("marital_status", "divorced"),
    "marital_cohabiting": ("marital_status", "cohabiting"),
}


def feature_exprs(as_of) -> dict[str, Column]:
    """Expression of every feature over patient columns."""
    on = F.lit(as_instant(as_of).date())
    made = {"age": age_years(F.col("date_of_birth"), on)}
    made |= {name: F.col(source) for name, source in _NUMBERS.items()}
    made |= {name: flag(F.col(name)) for name in _FLAGS}
    made |= {name: indicator(F.col(source), *values) for name, (source, *values) in _INDICATORS.items()}
    return {name: F.coalesce(made[name].cast("double"), F.lit(0.0)) for name in FEATURE_NAMES}


def feature_columns(patients: DataFrame, as_of, keep: list[str] = ("id",)) -> DataFrame:
    """``keep`` plus one double column per feature."""
    made = feature_exprs(as_of)
    return patients.select(*keep, *[made[name].alias(name) for name in FEATURE_NAMES])


def named_features(df: DataFrame, names: list[str] = FEATURE_NAMES) -> list[Column]:
    """Feature values from columns of the same name; an absent one is 0.0."""
    return [F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in df.columns else F.lit(0.0) for n in names]


def feature_vector(values: list[Column], means: list[float] | None = None, scales: list[float] | None = None) -> Column:
    """Array of the values, standardised when a scaler's means and scales are given."""
    if means is not None:
        values = [(v - F.lit(float(m))) / F.lit(float(s)) for v, m, s in zip(values, means, scales, strict=True)]
    return F.array(*values)
