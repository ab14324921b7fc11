"""Registered queries: features, scores, batches, model quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from careframe.functions.features import FEATURE_NAMES, feature_columns
from careframe.functions.scalars import clamp, interval, risk_level
from careframe.operators import evaluate as ev, scoring as sc
from careframe.operators.lookups import one_hot_columns
from careframe.operators.period_report import period_report
from careframe.operators.tables import dated
from careframe.plans.adapters import (
    AGES_AS_OF, PREDICTIONS_AS_OF, clinicians, measures, patients, predictions, sql, table,
)
from careframe.plans.cases_reports import AGE

SCORE = """least(1e0, least(number_of_partners_12m * 5e-2, 3e-1)
  + case when prior_sti_history then 15e-2 else 0e0 end + case when substance_use then 1e-1 else 0e0 end
  + case when symptoms_present then 1e-1 else 0e0 end + case when hiv_status = 'positive' then 15e-2 else 0e0 end
  + case when hiv_status = 'unknown' then 5e-2 else 0e0 end + (1e0 - condom_use_frequency) * 2e-1
  + case when gender = 'M' then 5e-2 else 0e0 end)"""
LEVEL = """case when {0} < 25e-2 then 'low' when {0} < 5e-1 then 'moderate' when {0} < 75e-2 then 'high'
  else 'very_high' end"""

FEATURES = f"""
select id, cast({AGE.format(on=AGES_AS_OF)} as double) as age,
  cast(gender = 'M' as double) as gender_male, cast(gender = 'F' as double) as gender_female,
  cast(gender in ('O', 'U') as double) as gender_other,
  cast(number_of_partners_12m as double) as num_partners_12m,
  cast(number_of_partners_lifetime as double) as num_partners_lifetime,
  condom_use_frequency as condom_use_freq, cast(substance_use as double) as substance_use,
  cast(prior_sti_history as double) as prior_sti_history, cast(hiv_status = 'positive' as double) as hiv_positive,
  cast(hiv_status = 'unknown' as double) as hiv_unknown, cast(symptoms_present as double) as symptoms_present,
  cast(marital_status = 'single' as double) as marital_single, cast(marital_status = 'married' as double) as marital_married,
  cast(marital_status = 'divorced' as double) as marital_divorced,
  cast(marital_status = 'cohabiting' as double) as marital_cohabiting
from patients"""

MODEL = sc.LinearRiskModel(
    weights={"age": -0.01, "num_partners_12m": 0.3, "condom_use_freq": -0.8, "prior_sti_history": 0.6,
             "hiv_positive": 0.4, "symptoms_present": 0.7, "gender_male": 0.2},
    intercept=-1.0, version="linear_v1",
    means=[40.0, 2.0, 0.5, 0.0, 0.0, 0.0, 0.0], scales=[10.0, 2.0, 0.25, 1.0, 1.0, 1.0, 1.0])

MODEL_SQL = f"""
with f as ({FEATURES}),
p as (select id, 1e0 / (1e0 + exp(-(-1e0 + ((age - 4e1) / 1e1) * -1e-2 + ((num_partners_12m - 2e0) / 2e0) * 3e-1
  + ((condom_use_freq - 5e-1) / 25e-2) * -8e-1 + prior_sti_history * 6e-1 + hiv_positive * 4e-1
  + symptoms_present * 7e-1 + gender_male * 2e-1))) as s from f)
select id, round(s, 4) as risk_score, {LEVEL.format('s')} as risk_level,
  round(greatest(0, s - 1e-1), 4) as confidence_interval_lower, round(least(1, s + 1e-1), 4) as confidence_interval_upper,
  case when s < 25e-2 then 2 when s < 5e-1 then 4 else 6 end as tests, 'linear_v1' as model_version,
  case when s < 25e-2 then 'Continue' when s < 5e-1 then 'Routine' else 'Immediate' end as advice from p"""

HEURISTIC_SQL = f"""
with p as (select id, {SCORE} as s from patients)
select id, round(s, 4) as risk_score, {LEVEL.format('s')} as risk_level,
  round(greatest(0, s - 15e-2), 4) as confidence_interval_lower, round(least(1, s + 15e-2), 4) as confidence_interval_upper,
  case when s > 3e-1 then 4 else 2 end as tests, 'heuristic_v1' as model_version, 'Schedule' as advice from p"""

RESULT = ["id", "risk_score", "risk_level", "confidence_interval_lower", "confidence_interval_upper"]


def _shown(scored):
    return scored.select(*RESULT, F.size("recommended_tests").alias("tests"), "model_version",
                         F.split_part("recommended_actions", F.lit(" "), F.lit(1)).alias("advice"))


def _requests(s, f):
    """One requested patient id per order, in order of the order key."""
    k = F.col("o_custkey")
    return table(s, f, "orders").select(
        F.col("o_orderkey").alias("pos"),
        F.when(k % 10 == 3, "Nobody").otherwise(
            F.concat(F.lit("Customer#"), F.lpad(k.cast("string"), 9, "0"))).alias("patient_id"))


REQUESTS = """requests as (
  select o_orderkey as pos, case when o_custkey % 10 = 3 then 'Nobody'
         else concat('Customer#', lpad(cast(o_custkey as varchar), 9, '0')) end as patient_id from orders)"""

BATCH_SQL = f"""
with {REQUESTS}
select pos + 1000 as id, q.id as patient_key, patient_id, concat(first_name, ' ', last_name) as patient_name,
  'hpv' as sti_type, round({SCORE}, 4) as risk_score, {LEVEL.format(SCORE)} as risk_level {{extra}}
from requests join patients q using (patient_id) where is_active"""


def _batch(s, f):
    return sc.score_batch(_requests(s, f), patients(s, f), PREDICTIONS_AS_OF, sti_type="hpv", first_id=1000)


def _importances(s, f):
    """A weight per feature and customer, with many ties and both signs."""
    weights = F.transform(F.sequence(F.lit(0), F.lit(len(FEATURE_NAMES) - 1)),
                          lambda i: ((F.col("c_custkey") * (i + 3)) % 11 - 5) / F.lit(7.0))
    factors = sc.top_factors(list(FEATURE_NAMES), weights)
    return table(s, f, "customer").select("c_custkey", F.posexplode(factors).alias("place", "factor")).select(
        "c_custkey", "place", "factor.name", "factor.weight")


NAME_VALUES = ", ".join(f"({i}, '{n}')" for i, n in enumerate(FEATURE_NAMES))
FACTOR_SQL = f"""
with names(i, name) as (values {NAME_VALUES}),
w as (select c_custkey, i, name, round(abs(((c_custkey * (i + 3)) % 11 - 5) / 7e0), 4) as weight from customer, names),
ranked as (select *, row_number() over (partition by c_custkey order by weight desc, i) - 1 as place from w)
select c_custkey, place, name, weight from ranked where place < 5"""

KNOWN = """known as (select risk_score as score, case actual_outcome when 'positive' then 1 else 0 end as y
from predictions where actual_outcome in ('positive', 'negative'))"""


def _report(s, f, kind, **filters):
    made = period_report(predictions(s, f), kind, patients(s, f), clinicians(s, f), **filters)
    return made.withColumns({c: F.col(c).cast("string") for c in ("period_start", "period_end")})


REPORT_SQL = """
select cast(cast(date_trunc('{p}', p.created_at) as date) as varchar) as period_start,
  cast(cast(date_trunc('{p}', p.created_at) + {step} - interval 1 day as date) as varchar) as period_end,
  count(*) as total_screenings, count(*) filter (where actual_outcome = 'positive') as total_positive,
  count(*) filter (where risk_level in ('high', 'very_high')) as total_high_risk
from predictions p {joins} group by 1, 2"""

CASES = {
    "heuristic_scores": (
        lambda s, f: _shown(sc.score(patients(s, f), AGES_AS_OF)), sql("patients", HEURISTIC_SQL)),
    "model_scores": (
        lambda s, f: _shown(sc.score(patients(s, f), AGES_AS_OF, MODEL)), sql("patients", MODEL_SQL)),
    "risk_levels": (
        lambda s, f: predictions(s, f).select("id", risk_level(F.col("risk_score")).alias("level")),
        sql("predictions", f"select id, {LEVEL.format('risk_score')} as level from predictions"),
    ),
    # An odd divisor: engines round exact decimal ties differently.
    "score_interval": (
        lambda s, f: table(s, f, "orders").select("o_orderkey", *[c.alias(n) for c, n in zip(
            interval(F.col("o_totalprice") / 499979.0, 0.1), ("lower_bound", "upper_bound"))]),
        """select o_orderkey, round(greatest(0, o_totalprice / 499979e0 - 1e-1), 4) as lower_bound,
round(least(1, o_totalprice / 499979e0 + 1e-1), 4) as upper_bound from orders""",
    ),
    "clamped_values": (
        lambda s, f: table(s, f, "customer").select("c_custkey", clamp(F.col("c_acctbal") / 5000.0).alias("share")),
        "select c_custkey, greatest(0e0, least(1e0, c_acctbal / 5e3)) as share from customer",
    ),
    "rounded_values": (
        lambda s, f: table(s, f, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_extendedprice") / 7, 3).alias("three"),
            F.round(F.col("l_extendedprice") / 7, 4).alias("four")),
        """select l_orderkey, l_linenumber, l_partkey, round(l_extendedprice / 7, 3) as three,
round(l_extendedprice / 7, 4) as four from lineitem""",
    ),
    "feature_columns": (
        lambda s, f: feature_columns(patients(s, f), AGES_AS_OF), sql("patients", FEATURES)),
    "one_hot_columns": (
        lambda s, f: one_hot_columns(patients(s, f), AGES_AS_OF),
        sql("patients", f"""with f as ({FEATURES}) select id, gender_male, gender_female, gender_other, hiv_positive,
hiv_unknown, marital_single, marital_married, marital_divorced, marital_cohabiting from f"""),
    ),
    "scores_without_record": (
        lambda s, f: sc.score_features(measures(s, f).select("l_orderkey", F.col("q").alias("num_partners_12m")))
        .select("l_orderkey", "probability"),
        "select l_orderkey, 3e-1 as probability from lineitem",
    ),
    "scores_of_feature_rows": (
        lambda s, f: sc.score_features(feature_columns(patients(s, f), AGES_AS_OF), MODEL)
        .select("id", F.round("probability", 4).alias("probability")),
        sql("patients", f"with m as ({MODEL_SQL}) select id, risk_score as probability from m"),
    ),
    "batch_requests": (
        lambda s, f: sc.request_rows(_requests(s, f), patients(s, f)).select("pos", "patient_id", "id"),
        sql("patients", f"with {REQUESTS} select pos, patient_id, q.id from requests join patients q using (patient_id) where is_active"),
    ),
    "batch_scores": (
        lambda s, f: _batch(s, f).select("id", "patient_key", "patient_id", "patient_name", "sti_type", "risk_score", "risk_level"),
        sql("patients", BATCH_SQL.format(extra="")),
    ),
    "prediction_rows": (
        lambda s, f: dated(_batch(s, f)).select(
            "id", "patient_key", "patient_id", "patient_name", "sti_type", "risk_score", "risk_level",
            F.col("created_date").cast("string").alias("created_date"), "validated_by_clinician",
            F.col("input_features").getItem("num_partners_12m").alias("partners")),
        sql("patients", BATCH_SQL.format(extra=""", '2001-08-02' as created_date, false as validated_by_clinician,
  cast(number_of_partners_12m as double) as partners""")),
    ),
    "top_factors": (_importances, FACTOR_SQL),
    "outcome_confusion": (
        lambda s, f: ev.confusion(predictions(s, f)).withColumns(
            {c: F.round(c, 6) for c in ("brier_score", "accuracy", "precision", "recall", "f1_score")}),
        sql("predictions", f"""with {KNOWN},
c as (select count(*) as sample_size, count(*) filter (where score >= 5e-1 and y = 1) as tp,
  count(*) filter (where score >= 5e-1 and y = 0) as fp, count(*) filter (where score < 5e-1 and y = 1) as fn,
  count(*) filter (where score < 5e-1 and y = 0) as tn, round(avg(pow(score - y, 2)), 6) as brier_score from known)
select *, round((tp + tn) / cast(sample_size as double), 6) as accuracy, round(tp / cast(tp + fp as double), 6) as precision,
  round(tp / cast(tp + fn as double), 6) as recall, round(2 * tp / cast(2 * tp + fp + fn as double), 6) as f1_score from c"""),
    ),
    "outcome_auc": (
        lambda s, f: ev.auc(predictions(s, f)).withColumn("auc_roc", F.round("auc_roc", 6)),
        sql("predictions", f"""with {KNOWN},
r as (select y, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2e0 as place from known)
select round((sum(place) filter (where y = 1) - count(*) filter (where y = 1) * (count(*) filter (where y = 1) + 1) / 2e0)
  / (cast(count(*) filter (where y = 1) as double) * count(*) filter (where y = 0)), 6) as auc_roc from r"""),
    ),
    "weekly_report": (
        lambda s, f: _report(s, f, "weekly"),
        sql("predictions", REPORT_SQL.format(p="week", step="interval 7 day", joins=""))),
    "monthly_report": (
        lambda s, f: _report(s, f, "monthly", county="nation_7"),
        sql("patients predictions", REPORT_SQL.format(p="month", step="interval 1 month", joins="""
join patients q on q.id = p.patient_key and lower(county) = 'nation_7'"""))),
    "quarterly_report": (
        lambda s, f: _report(s, f, "quarterly", facility_id=5),
        sql("clinicians predictions", REPORT_SQL.format(p="quarter", step="interval 3 month", joins="""
join clinicians c on c.id = p.clinician_id and facility_id = 5"""))),
    "annual_report": (
        lambda s, f: _report(s, f, "annual"),
        sql("predictions", REPORT_SQL.format(p="year", step="interval 1 year", joins=""))),
}
