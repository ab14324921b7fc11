"""Record checks: an array of error texts per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from careframe.operators.profile import nan_to_null

# Required fields in the order their errors are listed, limits and texts.
REQUIRED_FIELDS = ("age", "gender", "num_partners_12m")
AGE_LIMITS = (10, 120)
AGE_ERROR = "Age must be between 10 and 120"
PARTNERS_ERROR = "Number of partners cannot be negative"
CONDOM_ERROR = "Condom use frequency must be between 0 and 1"
MISSING_ERROR = "Missing required field: "


def _errors(columns: list[str]) -> list[Column]:
    found = []
    for name in REQUIRED_FIELDS:
        absent = F.col(name).isNull() if name in columns else F.lit(True)
        found.append(F.when(absent, F.lit(MISSING_ERROR + name)))
    if "age" in columns:
        found.append(F.when(~F.col("age").between(*AGE_LIMITS), F.lit(AGE_ERROR)))
    if "num_partners_12m" in columns:
        found.append(F.when(F.col("num_partners_12m") < 0, F.lit(PARTNERS_ERROR)))
    if "condom_use_freq" in columns:
        found.append(F.when(~F.col("condom_use_freq").between(0, 1), F.lit(CONDOM_ERROR)))
    return found


def validate(df: DataFrame) -> DataFrame:
    """Add ``errors`` and ``is_valid``; a null value yields only its missing error, and NaN is null."""
    df = nan_to_null(df)
    errors = F.array_compact(F.array(*_errors(df.columns)))
    return df.withColumn("errors", errors).withColumn("is_valid", F.size("errors") == 0)


def short_names(patients: DataFrame) -> DataFrame:
    """Patient columns under the names preparation and validation use."""
    return patients.withColumnsRenamed({
        "number_of_partners_12m": "num_partners_12m",
        "number_of_partners_lifetime": "num_partners_lifetime",
        "condom_use_frequency": "condom_use_freq",
    })
