"""Registered queries: counts, breakdowns, trends, dashboards, audit summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from careframe.functions.predicates import active_only, lookback
from careframe.operators import dashboards as d
from careframe.plans.adapters import (
    AGES_AS_OF, AUDIT_AS_OF, PREDICTIONS_AS_OF, audit, clinicians, patients, predictions, sql,
)

SINCE_30 = "timestamp '2001-08-02 00:00:00' - interval 30 day"
SINCE_90 = "timestamp '2001-08-02 00:00:00' - interval 90 day"
HIGH = "risk_level in ('high', 'very_high')"
LEVELS = "(values ('low'), ('moderate'), ('high'), ('very_high')) as v(risk_level)"
AGE = """year(date '{on}') - year(date_of_birth)
         - case when strftime(date '{on}', '%m%d') < strftime(date_of_birth, '%m%d') then 1 else 0 end"""
BAND = """case when age < 15 then '<15' when age < 20 then '15-19' when age < 25 then '20-24'
               when age < 30 then '25-29' when age < 35 then '30-34' when age < 40 then '35-39'
               when age < 50 then '40-49' else '50+' end"""

BREAKDOWN_SQL = """
select county, count(*) as patients, round(avg(risk_score), 4) as avg_risk,
       count(*) filter (where risk_level in ('high', 'very_high')) as high_risk
from patients left join predictions on patients.id = predictions.patient_key
where is_active {extra}
group by county order by patients desc, county limit 10"""

STATS_SQL = """
with scoped as (
  select p.* from predictions p {joins}
  where p.created_at >= {since} {where})
select count(*) as total_predictions,
       count(*) filter (where risk_level = 'low') as low_count,
       count(*) filter (where risk_level = 'moderate') as moderate_count,
       count(*) filter (where risk_level = 'high') as high_count,
       count(*) filter (where risk_level = 'very_high') as very_high_count,
       count(*) filter (where risk_level not in ('low', 'moderate', 'high', 'very_high')) as other_count,
       round(coalesce(avg(risk_score), 0), 4) as avg_risk_score,
       'sti_risk_v1' as model_version, 'Last {days} days' as period
from scoped"""

SUMMARY_SQL = """
with people as (select * from patients where is_active {person}),
     recent as (select p.* from predictions p {joins} where p.created_at >= {since} {where})
select 'Last {days} days' as period, {label} as county_filter,
       (select count(*) from people) as total_patients,
       (select count(*) from recent) as total_screenings,
       (select round(coalesce(avg(risk_score), 0), 3) from recent) as avg_risk_score,
       (select count(*) from recent where risk_level in ('high', 'very_high')) as high_risk_patients"""

TREND_SQL = """
select cast(cast(created_at as date) as varchar) as date, count(*) as count, round(avg(risk_score), 4) as avg_risk
from predictions {joins} where predictions.created_at >= {since} {where}
group by 1 order by 1 limit 30"""

TABLE_SQL = f"""
with people as (select *, {AGE.format(on='2001-08-02')} as age from patients where is_active),
     recent as (select * from predictions where created_at >= timestamp '2001-08-02 00:00:00' - interval 600 day)
select 'gender' as section, gender as label, count(*) as n, cast(null as double) as avg_risk from people group by gender
union all select 'age', {BAND}, count(*), null from people group by 2
union all select 'total_patients', 'all', count(*), null from people
union all select 'risk_level', risk_level, count(*), round(avg(risk_score), 4) from recent group by 2
union all select 'day', cast(cast(created_at as date) as varchar), count(*), round(avg(risk_score), 4) from recent group by 2
union all select 'total_screenings', 'all', count(*), round(avg(risk_score), 4) from recent"""

AUDIT_SQL = """
with recent as (select * from audit where created_at >= timestamp '2024-01-31 00:00:00' - interval {days} day)
select 'total' as section, 'all' as label, count(*) as n from recent
union all select 'action', action, count(*) from recent group by 2
union all select 'resource', resource_type, count(*) from recent group by 2
union all (select 'user', user_name, count(*) from recent group by 2 order by 3 desc, 2 limit 10)"""

IN_COUNTY = "join patients q on q.id = {p}.patient_key"
SAME_COUNTY = "and lower(q.county) = lower('nation_7')"


def _rounded(df, *columns, digits=4):
    for name in columns:
        df = df.withColumn(name, F.round(name, digits))
    return df


def _day_text(df):
    return _rounded(df, "avg_risk").withColumn("date", F.col("date").cast("string"))


def _recent(spark, folder, days=30):
    return lookback(predictions(spark, folder), "created_at", PREDICTIONS_AS_OF, days)


CASES = {
    "county_breakdown": (
        lambda s, f: _rounded(d.county_breakdown(patients(s, f), predictions(s, f)), "avg_risk"),
        sql("patients predictions", BREAKDOWN_SQL.format(extra="")),
    ),
    "county_breakdown_distinct": (
        lambda s, f: _rounded(d.county_breakdown(patients(s, f), predictions(s, f), distinct_patients=True), "avg_risk"),
        sql("patients predictions", BREAKDOWN_SQL.format(extra="").replace(
            "count(*) as patients", "count(distinct patients.id) as patients")),
    ),
    "prediction_count": (
        lambda s, f: predictions(s, f).agg(F.count("*").alias("total")),
        sql("predictions", "select count(*) as total from predictions"),
    ),
    "average_score": (
        lambda s, f: predictions(s, f).agg(F.round(d.zero_if_null(F.avg("risk_score")), 4).alias("avg_risk_score")),
        sql("predictions", "select round(coalesce(avg(risk_score), 0), 4) as avg_risk_score from predictions"),
    ),
    "average_score_empty_window": (
        lambda s, f: lookback(predictions(s, f), "created_at", "2031-01-01", 30).agg(
            F.count("*").alias("total"), d.zero_if_null(F.avg("risk_score"), 3).alias("avg_risk_score"),
            d.period_label(30).alias("period"), F.count_if(F.col("risk_level") == "low").alias("low_count"),
        ).select("total", "avg_risk_score", "period", "low_count"),
        sql("predictions", """
select count(*) as total, round(coalesce(avg(risk_score), 0), 3) as avg_risk_score, 'Last 30 days' as period,
       count(*) filter (where risk_level = 'low') as low_count
from predictions where created_at >= timestamp '2031-01-01' - interval 30 day"""),
    ),
    "risk_distribution": (
        lambda s, f: d.risk_distribution(_recent(s, f)),
        sql("predictions", f"""
select v.risk_level, count(p.id) as n
from {LEVELS} left join (select * from predictions where created_at >= {SINCE_30}) p on p.risk_level = v.risk_level
group by 1"""),
    ),
    "risk_distribution_by_county": (
        lambda s, f: d.risk_distribution(_recent(s, f), patients(s, f), "nation_7"),
        sql("patients predictions", f"""
select v.risk_level, count(p.id) as n from {LEVELS} left join (
  select predictions.* from predictions {IN_COUNTY.format(p='predictions')}
  where predictions.created_at >= {SINCE_30} {SAME_COUNTY}) p on p.risk_level = v.risk_level
group by 1"""),
    ),
    "gender_distribution": (
        lambda s, f: d.gender_distribution(active_only(patients(s, f))),
        sql("patients", "select gender, count(*) as n from patients where is_active group by gender"),
    ),
    "age_distribution": (
        lambda s, f: d.age_distribution(active_only(patients(s, f)), F.lit(AGES_AS_OF).cast("date")),
        sql("patients", f"""
with aged as (select *, {AGE.format(on=AGES_AS_OF)} as age from patients where is_active)
select {BAND} as age_group, count(*) as n from aged group by 1"""),
    ),
    "daily_trend": (
        lambda s, f: _day_text(d.daily_trend(predictions(s, f), PREDICTIONS_AS_OF, 90)),
        sql("predictions", TREND_SQL.format(joins="", where="", since=SINCE_90)),
    ),
    "daily_trend_by_county": (
        lambda s, f: _day_text(d.daily_trend(
            predictions(s, f), PREDICTIONS_AS_OF, 600, 30, patients(s, f), "nation_7")),
        sql("patients predictions", TREND_SQL.replace("created_at as date", "predictions.created_at as date").format(
            joins=IN_COUNTY.format(p="predictions"), where=SAME_COUNTY,
            since="timestamp '2001-08-02 00:00:00' - interval 600 day")),
    ),
    "high_risk_total": (
        lambda s, f: d.high_risk_total(_recent(s, f)),
        sql("predictions", f"select count(*) as high_risk_patients from predictions where created_at >= {SINCE_30} and {HIGH}"),
    ),
    "prediction_stats": (
        lambda s, f: d.prediction_stats(predictions(s, f), patients(s, f), clinicians(s, f), PREDICTIONS_AS_OF, 30),
        sql("predictions", STATS_SQL.format(joins="", where="", since=SINCE_30, days=30)),
    ),
    "prediction_stats_by_county": (
        lambda s, f: d.prediction_stats(
            predictions(s, f), patients(s, f), clinicians(s, f), PREDICTIONS_AS_OF, 90, county="nation_7"),
        sql("patients predictions", STATS_SQL.format(
            joins=IN_COUNTY.format(p="p"), where=SAME_COUNTY, since=SINCE_90, days=90)),
    ),
    "prediction_stats_by_facility": (
        lambda s, f: d.prediction_stats(
            predictions(s, f), patients(s, f), clinicians(s, f), PREDICTIONS_AS_OF, 90, facility_id=5),
        sql("clinicians predictions", STATS_SQL.format(
            joins="join clinicians c on c.id = p.clinician_id", where="and c.facility_id = 5", since=SINCE_90, days=90)),
    ),
    "prediction_stats_by_county_and_facility": (
        lambda s, f: d.prediction_stats(predictions(s, f), patients(s, f), clinicians(s, f), PREDICTIONS_AS_OF, 90,
                                        county="NATION_7", facility_id=5),
        sql("patients clinicians predictions", STATS_SQL.format(
            joins=IN_COUNTY.format(p="p") + " join clinicians c on c.id = p.clinician_id",
            where=SAME_COUNTY + " and c.facility_id = 5", since=SINCE_90, days=90)),
    ),
    "dashboard_summary": (
        lambda s, f: d.dashboard_summary(patients(s, f), predictions(s, f), PREDICTIONS_AS_OF, 90),
        sql("patients predictions", SUMMARY_SQL.format(
            person="", joins="", where="", since=SINCE_90, days=90, label="cast(null as varchar)")),
    ),
    "dashboard_summary_by_county": (
        lambda s, f: d.dashboard_summary(patients(s, f), predictions(s, f), PREDICTIONS_AS_OF, 90, "nation_7"),
        sql("patients predictions", SUMMARY_SQL.format(
            person="and lower(county) = 'nation_7'", joins=IN_COUNTY.format(p="p"), where=SAME_COUNTY,
            since=SINCE_90, days=90, label="'nation_7'")),
    ),
    "dashboard_county_breakdown": (
        lambda s, f: _rounded(d.dashboard(patients(s, f), predictions(s, f), PREDICTIONS_AS_OF, 90, "nation_7")
                              ["county_breakdown"], "avg_risk"),
        sql("patients predictions", BREAKDOWN_SQL.format(extra="and lower(county) = 'nation_7'")),
    ),
    "dashboard_table": (
        lambda s, f: _rounded(d.dashboard_table(patients(s, f), predictions(s, f), PREDICTIONS_AS_OF, 600), "avg_risk"),
        sql("patients predictions", TABLE_SQL),
    ),
    "audit_summary": (
        lambda s, f: d.audit_summary(audit(s, f), AUDIT_AS_OF, 30),
        sql("audit", AUDIT_SQL.format(days=30)),
    ),
    "audit_summary_week": (
        lambda s, f: d.audit_summary(audit(s, f), AUDIT_AS_OF, 7),
        sql("audit", AUDIT_SQL.format(days=7)),
    ),
}
