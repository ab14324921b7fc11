"""Retention and consent rules as table jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from careframe.functions.predicates import as_instant, time_literal
from careframe.operators.asof import as_of_join
from careframe.operators.keyed import spread_join


def enforce_retention(
    df: DataFrame, policies: DataFrame, data_type: str, time_col: str, identifying: list[str], as_of,
) -> DataFrame:
    """Drop rows past the retention period and pseudonymise rows past the anonymising one.

    Rows without a time are not known to be past either period and stay.
    Text columns in ``identifying`` become a SHA-256 digest, others null.
    ``data_type`` is unique among policies, so the active policy is one row.
    """
    rows = (policies.filter("is_active").filter(F.col("data_type") == data_type)
            .select("retention_days", "anonymize_after_days").limit(2).collect())
    if not rows:
        return df
    if len(rows) > 1:
        raise ValueError(f"more than one active policy for {data_type!r}")
    keep_days, hide_days = rows[0]
    at, now = F.col(time_col), time_literal(as_instant(as_of), df.schema[time_col].dataType)

    def since(days: int):
        return now - F.make_dt_interval(F.lit(days))

    kept = df.filter(at.isNull() | (at >= since(keep_days)))
    if hide_days is None:
        return kept
    return kept.withColumns(pseudonyms(df, identifying, at < since(hide_days)))


def pseudonyms(df: DataFrame, identifying: list[str], where: Column) -> dict[str, Column]:
    """The columns with a SHA-256 digest (text) or null (others) where ``where`` holds."""
    hidden = {}
    for name in identifying:
        kind = df.schema[name].dataType.simpleString()
        mask = F.sha2(F.col(name), 256) if kind == "string" else F.lit(None).cast(kind)
        hidden[name] = F.when(where, mask).otherwise(F.col(name))
    return hidden


def consented(df: DataFrame, consents: DataFrame, consent_type: str, as_of, key: str = "patient_key") -> DataFrame:
    """Rows of patients whose consent of this type is granted and not expired."""
    now = time_literal(as_of, consents.schema["expires_at"].dataType)
    valid = consents.filter(
        (F.col("consent_type") == consent_type) & F.col("granted")
        & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))
    people = valid.select(F.col("patient_key").alias(key)).distinct()
    return spread_join(df, people, key, "left_semi")


def consented_then(
    df: DataFrame, history: DataFrame, consent_type: str, time_col: str = "created_at", key: str = "patient_key",
    changed_col: str = "changed_at", order_col: str = "id",
) -> DataFrame:
    """Rows whose patient's consent of this type was in force at the time of the row.

    ``history`` has a row per change: granted, withdrawn (``granted`` false) or renewed.  The last change at or before the row
    counts, and ``expires_at`` is compared with the row's own time.  Rows without a key or a time have no consent.
    """
    changes = history.filter(F.col("consent_type") == consent_type)
    judged = as_of_join(df, changes.select(F.col("patient_key").alias(key), changed_col, order_col, "granted", "expires_at"), key, time_col,
                        changed_col, order_col, ["granted", "expires_at"], "_consent")
    ends = F.col("_consent.expires_at")
    valid = F.coalesce(F.col("_consent.granted"), F.lit(False)) & (ends.isNull() | (ends > F.col(time_col)))
    return judged.filter(valid).drop("_consent")
