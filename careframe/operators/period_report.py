"""Period reports: screenings, positives and high-risk totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from careframe.functions.predicates import equals_ci, is_high
from careframe.operators.geo import period_end

# Report types and the calendar period each covers.
PERIODS = {"weekly": "week", "monthly": "month", "quarterly": "quarter", "annual": "year"}


def period_report(
    predictions: DataFrame, report_type: str, patients: DataFrame | None = None,
    clinicians: DataFrame | None = None, county: str | None = None, facility_id: int | None = None,
) -> DataFrame:
    """One row per period with data, oldest first; falsy filters are skipped."""
    period = PERIODS[report_type]
    start = F.date_trunc(period, F.col("created_at")).cast("date").alias("period_start")
    keys = [start]
    keys += [F.col("patient_key")] if county else []
    keys += [F.col("clinician_id")] if facility_id else []
    sums = predictions.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col("actual_outcome") == "positive").alias("positive_n"),
        F.count_if(is_high(F.col("risk_level"))).alias("high_n"))
    if county:
        residents = patients.filter(equals_ci(F.col("county"), county)).select(F.col("id").alias("patient_key"))
        sums = sums.join(residents, "patient_key", "left_semi")
    if facility_id:
        staff = clinicians.filter(F.col("facility_id") == facility_id).select(F.col("id").alias("clinician_id"))
        sums = sums.join(staff, "clinician_id", "left_semi")
    return (sums.groupBy("period_start")
            .agg(F.sum("n").alias("total_screenings"), F.sum("positive_n").alias("total_positive"),
                 F.sum("high_n").alias("total_high_risk"))
            .withColumn("period_end", period_end(F.col("period_start"), period))
            .orderBy("period_start"))
