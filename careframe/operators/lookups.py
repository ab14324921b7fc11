"""Key lookups, histories, listings and pages."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, functions as F, types as T

from careframe.functions.features import feature_exprs
from careframe.functions.predicates import (
    active_only, as_instant, is_high, lookback, optional_eq, optional_flag, search,
)
from careframe.functions.scalars import age_band, age_years, full_name
from careframe.operators.keyed import having, spread_join, top_per_key
from careframe.operators.quantiles import kth_value

SEARCHED = ["patient_id", "first_name", "last_name", "phone"]

# Columns of the detail view of a patient, in order.
DETAIL_COLUMNS = (
    "id", "patient_id", "first_name", "last_name", "date_of_birth", "gender", "age", "age_group", "phone", "email",
    "county", "sub_county", "ward", "marital_status", "number_of_partners_12m", "condom_use_frequency",
    "substance_use", "prior_sti_history", "hiv_status", "symptoms_present", "is_active", "created_at", "updated_at",
)
LIST_COLUMNS = ("id", "patient_id", "full_name", "age", "gender", "county", "is_active", "created_at")

# An offset up to this is skipped while collecting the page; a deeper page first
# finds the row where it starts.
DIRECT_OFFSET = 10_000


def lookup(df: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is wanted, wanted keys that do not exist)."""
    wanted = keys.select(key).distinct()
    return having(df, keys, key), having(wanted, df, key, "left_anti")


def newest(df: DataFrame, order_col: str, n: int | None = None, filters: dict | None = None, tie: str = "id") -> DataFrame:
    """Newest ``n`` rows after optional equality filters, all if no ``n`` is given."""
    for column, value in (filters or {}).items():
        df = optional_eq(df, column, value)
    ordered = df.orderBy(F.desc(order_col), F.desc(tie))
    return ordered if n is None else ordered.limit(n)


def page(df: DataFrame, order_col: str, limit: int = 50, offset: int = 0, tie: str = "id",
         direct: int = DIRECT_OFFSET) -> DataFrame:
    """Rows ``offset`` .. ``offset + limit`` in descending order, rows without an order value last.

    For a deep page of a time or number the order value at which it starts is found first, so that
    only rows from there on are ranked, not all rows before it; the rows are the same either way.
    """
    if offset > direct and (_is_time(df, order_col) or isinstance(df.schema[order_col].dataType, T.NumericType)):
        rank = F.unix_micros(F.col(order_col).cast("timestamp")) if _is_time(df, order_col) else F.col(order_col)
        if isinstance(df.schema[order_col].dataType, (T.DoubleType, T.FloatType)):
            # NaN sorts above infinity; as ties of the largest number both stay before all others.
            top = sys.float_info.max
            rank = F.when(F.isnan(rank) | (rank > top), F.lit(top)).when(rank < -top, F.lit(-top)).otherwise(rank.cast("double"))
        ranked = df.withColumn("_at", rank)
        start = kth_value(ranked.select((-F.col("_at")).alias("_at")), "_at", offset)
        if start is None:  # beyond all values: the page lies among the rows that have none
            rest, passed = F.col("_at").isNull(), F.col("_at").isNotNull()
        else:
            rest, passed = F.col("_at").isNull() | (F.col("_at") <= -start), F.col("_at") > -start
        offset -= ranked.filter(passed).count()
        df = ranked.filter(rest).drop("_at")
    return df.orderBy(F.desc(order_col), F.desc(tie)).offset(offset).limit(limit)


def _is_time(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))


def page_after(df: DataFrame, order_col: str, last_value, last_id, limit: int = 50, tie: str = "id") -> DataFrame:
    """The page that follows a row already seen; no row before it is touched."""
    at, key = F.col(order_col), F.col(tie)
    rest = df.filter((at < last_value) | ((at == last_value) & (key < last_id)))
    return rest.orderBy(F.desc(order_col), F.desc(tie)).limit(limit)


def _with_age(patients: DataFrame, as_of) -> DataFrame:
    on = F.lit(as_instant(as_of).date())
    age = age_years(F.col("date_of_birth"), on)
    return patients.withColumns({"age": age, "age_group": age_band(age)})


def patient_list(patients: DataFrame, as_of) -> DataFrame:
    named = _with_age(patients, as_of).withColumn("full_name", full_name(F.col("first_name"), F.col("last_name")))
    return named.select(*LIST_COLUMNS)


def patient_detail(patients: DataFrame, as_of) -> DataFrame:
    return _with_age(patients, as_of).select(*DETAIL_COLUMNS)


def list_patients(
    patients: DataFrame, as_of, text: str | None = None, county: str | None = None, gender: str | None = None,
    is_active: bool | None = None, limit: int = 50, offset: int = 0,
) -> DataFrame:
    """One page of the filtered patient list, newest first."""
    kept = search(patients, text, SEARCHED)
    kept = optional_eq(kept, "county", county, ci=True)
    kept = optional_eq(kept, "gender", gender)
    kept = optional_flag(kept, "is_active", is_active)
    return patient_list(page(kept, "created_at", limit, offset), as_of)


def history(
    patients: DataFrame, predictions: DataFrame, sti_type: str | None = None, n: int = 20,
) -> DataFrame:
    """Newest ``n`` predictions of every patient, with the patient's id and name.

    The cut to ``n`` comes before the join, so no patient brings more than ``n`` rows to it.
    """
    recent = top_per_key(optional_eq(predictions, "sti_type", sti_type), ["patient_key"],
                         [F.desc("created_at"), F.desc("id")], n)
    who = patients.select(F.col("id").alias("patient_key"), "patient_id",
                          full_name(F.col("first_name"), F.col("last_name")).alias("patient_name"))
    return recent.join(who, "patient_key")


def patient_visits(patients: DataFrame, visits: DataFrame) -> DataFrame:
    """Visits with the public id of their patient, one row per visit."""
    who = patients.select(F.col("id").alias("patient_key"), "patient_id")
    return spread_join(visits, who, "patient_key")


def patient_consents(patients: DataFrame, consents: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(consent rows of the wanted patients, wanted ids without a patient)."""
    found, missing = lookup(patients, keys, "patient_id")
    who = found.select(F.col("id").alias("patient_key"), "patient_id")
    return spread_join(consents, who, "patient_key"), missing


def predictions_by_facility(predictions: DataFrame, clinicians: DataFrame, facility_id: int) -> DataFrame:
    """Predictions made by staff of a facility; those without a clinician drop out."""
    staff = optional_eq(clinicians, "facility_id", facility_id)
    return spread_join(predictions, staff.select(F.col("id").alias("clinician_id"), "facility_id"), "clinician_id")


def predictions_in_county(predictions: DataFrame, patients: DataFrame, county: str) -> DataFrame:
    """Prediction rows of patients living in ``county``, with its spelling in the data."""
    residents = optional_eq(patients, "county", county, ci=True)
    return spread_join(predictions, residents.select(F.col("id").alias("patient_key"), "county"), "patient_key")


def patients_with_predictions(patients: DataFrame, predictions: DataFrame) -> DataFrame:
    """Patients and their predictions, one row each pair; patients without any are kept."""
    scores = predictions.select("patient_key", F.col("id").alias("prediction_id"), "risk_score")
    who = patients.select(F.col("id").alias("patient_key"), "county", "is_active")
    paired = spread_join(scores, who, "patient_key")
    alone = having(who, scores, "patient_key", "left_anti")
    return paired.unionByName(alone, allowMissingColumns=True)


def high_risk_in_window(predictions: DataFrame, patients: DataFrame, as_of, days: int) -> DataFrame:
    """High-risk counts of patients predicted in the window; the filter precedes the join."""
    recent = lookback(predictions, "created_at", as_of, days)
    sums = recent.groupBy("patient_key").agg(
        F.count("*").alias("n"), F.count_if(is_high(F.col("risk_level"))).alias("high_n"))
    return sums.join(patients.select(F.col("id").alias("patient_key"), "county"), "patient_key")


def with_facility(clinicians: DataFrame, facilities: DataFrame) -> DataFrame:
    """Clinicians with their facility as a struct (null where there is none)."""
    nested = facilities.select(F.col("id").alias("facility_id"), F.struct(*facilities.columns).alias("facility"))
    return spread_join(clinicians, nested, "facility_id", "left")


def list_facilities(facilities: DataFrame, county: str | None = None) -> DataFrame:
    return optional_eq(active_only(facilities), "county", county, ci=True).orderBy("name", "id")


def list_clinicians(
    clinicians: DataFrame, facilities: DataFrame, facility_id: int | None = None, role: str | None = None,
) -> DataFrame:
    kept = optional_eq(optional_eq(active_only(clinicians), "facility_id", facility_id), "role", role)
    return with_facility(kept, facilities)


def top_risk_zones(
    zones: DataFrame, county: str | None = None, risk_level: str | None = None, n: int = 100,
) -> DataFrame:
    """Highest scored zones; period dates as ISO text."""
    kept = optional_eq(optional_eq(zones, "county", county, ci=True), "risk_level", risk_level)
    top = kept.orderBy(F.desc("risk_score"), "id").limit(n)
    return top.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("period_start", "period_end")})


def one_hot_columns(patients: DataFrame, as_of) -> DataFrame:
    made: dict[str, Column] = feature_exprs(as_of)
    picked = [n for n in made if n.startswith(("gender_", "hiv_", "marital_"))]
    return patients.select("id", *[made[n].alias(n) for n in picked])
