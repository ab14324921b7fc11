"""Counts, averages and breakdowns over predictions and patients.

Predictions are always summed per patient (and per whatever the report groups
by) *before* they meet the patient table.  A patient holding a third of all
predictions then reaches the join as a handful of rows, distinct patients are
counted as plain rows, and no raw prediction is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from careframe.functions.predicates import (
    HIGH_LEVELS, RISK_LEVELS, active_only, equals_ci, is_high, lookback, optional_eq,
)
from careframe.functions.scalars import age_band, age_years, period_label, utc_day, zero_if_null

# Fixed value: the model name the statistics report carries.
STATS_MODEL = "sti_risk_v1"


def _sums(df: DataFrame, *keys) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum("risk_score").alias("score_sum"),
        F.count("risk_score").alias("score_n"),
        F.count_if(is_high(F.col("risk_level"))).alias("high_n"),
    )


def _resum(*extra: Column) -> list[Column]:
    return [F.sum("n").alias("n"), F.sum("score_sum").alias("score_sum"), F.sum("score_n").alias("score_n"), *extra]


def _mean() -> Column:
    return F.try_divide(F.col("score_sum"), F.col("score_n"))


def scoped_sums(
    predictions: DataFrame,
    patients: DataFrame | None = None,
    clinicians: DataFrame | None = None,
    county: str | None = None,
    facility_id: int | None = None,
    by: list[Column] = (),
) -> DataFrame:
    """Prediction sums by ``by``, limited to a county and / or a facility.

    Falsy limits are skipped, and then the table they need is not read.  The
    sums keep the join keys, so each limit is a semi join on reduced rows.
    Predictions without a clinician drop out when a facility is asked for.
    """
    keys = list(by)
    if county:
        keys.append(F.col("patient_key"))
    if facility_id:
        keys.append(F.col("clinician_id"))
    sums = _sums(predictions, *keys)
    if county:
        residents = patients.filter(equals_ci(F.col("county"), county)).select(F.col("id").alias("patient_key"))
        sums = sums.join(residents, "patient_key", "left_semi")
    if facility_id:
        staff = optional_eq(clinicians, "facility_id", facility_id).select(F.col("id").alias("clinician_id"))
        sums = sums.join(staff, "clinician_id", "left_semi")
    return sums


def zero_filled(counts: DataFrame, column: str, values=RISK_LEVELS) -> DataFrame:
    """Add a zero row for every expected value that is missing; keep unexpected ones."""
    one_row = counts.sparkSession.range(1, numPartitions=1)
    spine = one_row.select(F.explode(F.array(*[F.lit(v) for v in values])).alias(column),
                           F.lit(0).cast("long").alias("n"))
    return counts.select(column, "n").unionByName(spine).groupBy(column).agg(F.sum("n").alias("n"))


def risk_distribution(predictions: DataFrame, patients: DataFrame | None = None, county: str | None = None) -> DataFrame:
    """Predictions per risk level, the four known levels zero-filled."""
    sums = scoped_sums(predictions, patients, county=county, by=[F.col("risk_level")])
    return zero_filled(sums.groupBy("risk_level").agg(F.sum("n").alias("n")), "risk_level")


def prediction_stats(
    predictions: DataFrame,
    patients: DataFrame,
    clinicians: DataFrame,
    as_of,
    days: int = 30,
    county: str | None = None,
    facility_id: int | None = None,
) -> DataFrame:
    """One row: total, one column per known level, all other levels, mean, model, period."""
    recent = lookback(predictions, "created_at", as_of, days)
    sums = scoped_sums(recent, patients, clinicians, county, facility_id, by=[F.col("risk_level")])
    level = F.col("risk_level")

    def counted(keep: Column) -> Column:
        return F.coalesce(F.sum(F.when(keep, F.col("n"))), F.lit(0))

    return sums.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_predictions"),
        *[counted(level == name).alias(f"{name}_count") for name in RISK_LEVELS],
        counted(~level.isin(*RISK_LEVELS)).alias("other_count"),
        F.round(zero_if_null(F.try_divide(F.sum("score_sum"), F.sum("score_n"))), 4).alias("avg_risk_score"),
        F.lit(STATS_MODEL).alias("model_version"),
        period_label(days).alias("period"),
    )


def gender_distribution(patients: DataFrame) -> DataFrame:
    return patients.groupBy("gender").agg(F.count("*").alias("n"))


def age_distribution(patients: DataFrame, on: Column) -> DataFrame:
    """Patients per age band; bands nobody falls in are absent."""
    return (patients.groupBy(age_band(age_years(F.col("date_of_birth"), on)).alias("age_group"))
            .agg(F.count("*").alias("n")))


def county_breakdown(
    patients: DataFrame, predictions: DataFrame, top: int = 10, distinct_patients: bool = False,
) -> DataFrame:
    """Largest counties among active patients, with mean score and high-risk count.

    ``patients`` counts one row per patient *and prediction* (patients without
    any count once); ``distinct_patients`` counts each patient once instead.
    Predictions are not limited to a period.
    """
    sums = _sums(predictions, "patient_key")
    joined = active_only(patients).select("id", "county").join(
        sums, F.col("id") == F.col("patient_key"), "left")
    rows = F.count("*") if distinct_patients else F.sum(F.coalesce(F.col("n"), F.lit(1)))
    return (
        joined.groupBy("county")
        .agg(rows.alias("patients"),
             F.try_divide(F.sum("score_sum"), F.sum("score_n")).alias("avg_risk"),
             F.coalesce(F.sum("high_n"), F.lit(0)).alias("high_risk"))
        .orderBy(F.desc("patients"), "county").limit(top)
    )


def daily_trend(
    predictions: DataFrame, as_of, days: int = 30, top: int = 30,
    patients: DataFrame | None = None, county: str | None = None,
) -> DataFrame:
    """Count and mean score per day of the window, the *earliest* ``top`` days."""
    recent = lookback(predictions, "created_at", as_of, days)
    sums = scoped_sums(recent, patients, county=county, by=[utc_day(F.col("created_at")).alias("date")])
    return (sums.groupBy("date").agg(*_resum())
            .select("date", F.col("n").alias("count"), _mean().alias("avg_risk"))
            .orderBy("date").limit(top))


def dashboard_summary(
    patients: DataFrame, predictions: DataFrame, as_of, days: int = 30, county: str | None = None,
) -> DataFrame:
    """One row: active patients, screenings, mean score, high-risk predictions."""
    recent = lookback(predictions, "created_at", as_of, days)
    people = optional_eq(active_only(patients), "county", county, ci=True)
    sums = scoped_sums(recent, patients, county=county)
    # A row of each total, added up: no join is needed to put them side by side.
    totals = people.agg(F.count("*").alias("total_patients")).select(
        "total_patients", F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("score_sum"),
        F.lit(0).cast("long").alias("score_n"), F.lit(0).cast("long").alias("high_n"),
    ).unionByName(sums.select(F.lit(0).cast("long").alias("total_patients"), "n", "score_sum", "score_n", "high_n"))
    return totals.agg(
        F.sum("total_patients").alias("total_patients"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_screenings"),
        F.round(zero_if_null(F.try_divide(F.sum("score_sum"), F.sum("score_n"))), 3).alias("avg_risk_score"),
        F.coalesce(F.sum("high_n"), F.lit(0)).alias("high_risk_patients"),
    ).select(period_label(days).alias("period"), F.lit(county).cast("string").alias("county_filter"), "*")


def dashboard(
    patients: DataFrame, predictions: DataFrame, as_of, days: int = 30, county: str | None = None,
) -> dict[str, DataFrame]:
    """All dashboard parts, each its own lazy DataFrame."""
    recent = lookback(predictions, "created_at", as_of, days)
    people = optional_eq(active_only(patients), "county", county, ci=True)
    today = F.lit(as_of).cast("date")
    return {
        "summary": dashboard_summary(patients, predictions, as_of, days, county),
        "risk_distribution": risk_distribution(recent, patients, county),
        "age_distribution": age_distribution(people, today),
        "gender_distribution": gender_distribution(people),
        "county_breakdown": county_breakdown(people, predictions),
        "daily_trend": daily_trend(predictions, as_of, days, 30, patients, county),
    }


def dashboard_table(
    patients: DataFrame, predictions: DataFrame, as_of, days: int = 30, county: str | None = None,
) -> DataFrame:
    """The counting parts of the dashboard as one long table (section, label, n, avg_risk).

    Both inputs are reduced once to a small cube (per gender and age band; per
    day and level) and grouping sets read every section off the cube, so
    each table is scanned once however many sections there are.
    """
    recent = lookback(predictions, "created_at", as_of, days)
    people = optional_eq(active_only(patients), "county", county, ci=True)
    today = F.lit(as_of).cast("date")

    cube = people.groupBy(
        "gender", age_band(age_years(F.col("date_of_birth"), today)).alias("age_group"),
    ).agg(F.count("*").alias("n"))
    gender, age = F.col("gender"), F.col("age_group")
    by_person = cube.groupingSets([[gender], [age], []], gender, age).agg(
        F.sum("n").alias("n"), F.grouping_id().alias("gid"))
    # grouping_id has one bit per column, set where the column was summed over.
    person_part = by_person.select(
        F.when(F.col("gid") == 1, "gender").when(F.col("gid") == 2, "age").otherwise("total_patients").alias("section"),
        F.when(F.col("gid") == 1, gender).when(F.col("gid") == 2, age).otherwise("all").alias("label"),
        F.coalesce(F.col("n"), F.lit(0)).alias("n"), F.lit(None).cast("double").alias("avg_risk"))

    day, level = F.col("day"), F.col("risk_level")
    sums = scoped_sums(recent, patients, county=county, by=[level, utc_day(F.col("created_at")).alias("day")])
    by_screening = sums.groupingSets([[level], [day], []], level, day).agg(
        *_resum(F.grouping_id().alias("gid")))
    screening_part = by_screening.select(
        F.when(F.col("gid") == 1, "risk_level").when(F.col("gid") == 2, "day").otherwise("total_screenings").alias("section"),
        F.when(F.col("gid") == 1, level).when(F.col("gid") == 2, day.cast("string")).otherwise("all").alias("label"),
        F.coalesce(F.col("n"), F.lit(0)).alias("n"), _mean().alias("avg_risk"))
    return _with_zeros(person_part.unionByName(screening_part), [
        ("total_patients", "all"), ("total_screenings", "all"), *[("risk_level", name) for name in RISK_LEVELS]])


def _with_zeros(counts: DataFrame, expected: list[tuple[str, str]]) -> DataFrame:
    """``counts`` (section, label, n, ..) with a zero row for every expected label that is missing; null labels stay null."""
    pairs = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(l).alias("label")) for s, l in expected])
    zeros = counts.sparkSession.range(1, numPartitions=1).select(F.inline(pairs)).withColumn("n", F.lit(0).cast("long"))
    rest = [c for c in counts.columns if c not in ("section", "label", "n")]
    return counts.unionByName(zeros, allowMissingColumns=True).groupBy("section", "label").agg(
        F.sum("n").alias("n"), *[F.max(c).alias(c) for c in rest])


def high_risk_total(predictions: DataFrame) -> DataFrame:
    """Predictions (not patients) in the two upper levels."""
    return predictions.agg(F.count_if(F.col("risk_level").isin(*HIGH_LEVELS)).alias("high_risk_patients"))


def audit_cube(audit: DataFrame, as_of, days: int = 30) -> DataFrame:
    recent = lookback(audit, "created_at", as_of, days)
    return recent.groupBy("user_name", "action", "resource_type").agg(F.count("*").alias("n"))


def audit_summary(audit: DataFrame, as_of, days: int = 30, top_users: int = 10) -> DataFrame:
    """Total, per action, per resource and busiest users as one long table.

    One scan: the log is first counted per (user, action, resource), and the
    grouping sets only expand those counts.
    """
    cube = audit_cube(audit, as_of, days)
    action, resource, user = F.col("action"), F.col("resource_type"), F.col("user_name")
    counts = cube.groupingSets([[action], [resource], [user], []], action, resource, user).agg(
        F.sum("n").alias("n"), F.grouping_id().alias("gid")).select(
        F.when(F.col("gid") == 3, "action").when(F.col("gid") == 5, "resource")
        .when(F.col("gid") == 6, "user").otherwise("total").alias("section"),
        F.when(F.col("gid") == 3, action).when(F.col("gid") == 5, resource).when(F.col("gid") == 6, user)
        .otherwise("all").alias("label"),
        F.coalesce(F.col("n"), F.lit(0)).alias("n"))
    users = counts.filter(F.col("section") == "user").orderBy(F.desc("n"), "label").limit(top_users)
    return _with_zeros(counts.filter(F.col("section") != "user"), [("total", "all")]).unionByName(users)
