"""Registered queries: heatmaps, zones, coverage, request audit, consent, retention, files, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from careframe.functions.predicates import lookback, optional_eq
from careframe.functions.requests import audit_action, audit_resource, client_ip
from careframe.operators import geo, governance as gov
from careframe.operators.audit import audit_from_requests
from careframe.operators.lookups import newest, patient_consents, top_risk_zones
from careframe.plans.adapters import (
    AUDIT_AS_OF, LAYOUTS, PREDICTIONS_AS_OF, as_requests, audit, facilities, patients, predictions, requests, sql, table,
)
from careframe.plans.ingest import merge_checked
from careframe.session import work_folder
from careframe.sources.patient_csv import check_rows, ingest_stats, split_rows
from careframe.streaming.audit_stream import append_audit, audit_stream, daily_actions, mark_end, open_marks

# The test log holds nothing from here on.
LOG_ENDS = "2024-12-31 00:00:00"

# Counties of the test data that get coordinates of their own.
COORDINATES = {"NATION_0": (-1.25, 36.75), "NATION_7": (-4.0, 39.5), "nation_8": (1.0, 1.0)}

HEATMAP_SQL = """
with places as (
  select county, sub_county, avg(risk_score) as avg_risk, count(distinct q.id) as patient_count,
    count(*) filter (where risk_level in ('high', 'very_high')) as high_risk_count
  from predictions p join patients q on q.id = p.patient_key
  where p.created_at >= timestamp '2001-08-02 00:00:00' - interval {days} day {where}
  group by 1, 2 order by avg_risk desc, county, sub_county limit 50)
select case county when 'NATION_0' then -125e-2 when 'NATION_7' then -4e0 else -5e-1 end as lat,
  case county when 'NATION_0' then 3675e-2 when 'NATION_7' then 395e-1 else 37e0 end as lng,
  round(avg_risk, 3) as intensity, county, sub_county, patient_count, high_risk_count from places"""

SUMMARY_SQL = """
select county, count(distinct q.id) as total_patients, round(avg(risk_score), 4) as avg_risk,
  count(*) filter (where risk_level in ('high', 'very_high')) as high_risk,
  count(*) filter (where risk_level = 'moderate') as moderate_risk,
  count(*) filter (where risk_level = 'low') as low_risk
from predictions p join patients q on q.id = p.patient_key
where p.created_at >= timestamp '2001-08-02 00:00:00' - interval {days} day group by 1"""

ZONES = """zones as (
  select county, sub_county, cast(date_trunc('quarter', p.created_at) as date) as period_start,
    avg(risk_score) as risk_score, count(distinct q.id) as population_at_risk, count(*) as total_screenings,
    count(*) filter (where actual_outcome = 'positive') as positive_cases
  from predictions p join patients q on q.id = p.patient_key group by 1, 2, 3)"""
ZONE_LEVEL = """case when risk_score < 25e-2 then 'low' when risk_score < 5e-1 then 'moderate'
  when risk_score < 75e-2 then 'high' else 'very_high' end"""


def _zones(s, f):
    zones = geo.risk_zones(patients(s, f), predictions(s, f), "quarter")
    return zones.withColumns({
        "risk_score": F.round("risk_score", 4), "period_start": F.col("period_start").cast("string"),
        "period_end": F.col("period_end").cast("string")})


def _top_zones(s, f):
    zones = geo.risk_zones(patients(s, f), predictions(s, f), "quarter").withColumn(
        "id", F.concat_ws("/", "county", "sub_county", F.col("period_start").cast("string")))
    top = top_risk_zones(zones, "nation_5", "high")
    return top.select("id", "county", "risk_level", F.round("risk_score", 4).alias("risk_score"), "period_start", "period_end")


def _places(s, f):
    """Every customer at a coordinate of their own key."""
    k = F.col("c_custkey")
    return table(s, f, "customer").select(
        (F.lit(-5.5) + (k % 211) * 0.05).alias("latitude"), (F.lit(33.5) + (k % 173) * 0.04).alias("longitude"),
        (k % 7 + 1).alias("population"))


COVERAGE_SQL = """
with places as (select -55e-1 + (c_custkey % 211) * 5e-2 as lat, 335e-1 + (c_custkey % 173) * 4e-2 as lng,
    c_custkey % 7 + 1 as population from customer),
near as (
  select f.id, p.lat, p.lng, p.population from facilities f join places p
    on 2 * 6371 * asin(sqrt(least(1, pow(sin(radians(p.lat - f.latitude) / 2), 2) + cos(radians(f.latitude))
       * cos(radians(p.lat)) * pow(sin(radians(p.lng - f.longitude) / 2), 2)))) <= f.service_radius_km),
sums as (select id, sum(population) as population, count(distinct (lat, lng)) as places from near group by id)
select f.id as facility_id, cast(coalesce(population, 0) as bigint) as population, coalesce(places, 0) as places
from facilities f left join sums on sums.id = f.id"""

ACTION = """case when contains(path, 'predict') then 'predict' when contains(path, 'login') then 'login'
  when contains(path, 'logout') then 'logout' when contains(path, 'export') or contains(path, 'report') then 'export'
  when http_method = 'POST' then 'create' when http_method in ('PUT', 'PATCH') then 'update'
  when http_method = 'DELETE' then 'delete' else 'read' end"""
RESOURCE = """case when contains(path, 'patients') then 'Patient' when contains(path, 'predictions') then 'Prediction'
  when contains(path, 'clinicians') then 'Clinician' when contains(path, 'reports') then 'Report' else 'Unknown' end"""
ADDRESS = "case when x_forwarded_for <> '' then trim(split_part(x_forwarded_for, ',', 1)) else remote_addr end"
AUDITED = "not starts_with(path, '/static/')"

REQUEST_AUDIT_SQL = f"""
select event_id, user_id, case when user_id is null then 'Anonymous' when trim(full_name) = '' then username
    else trim(full_name) end as user_name,
  {ACTION} as action, {RESOURCE} as resource_type, concat(http_method, ' ', path) as description,
  {ADDRESS} as ip_address, substring(user_agent, 1, 500) as user_agent, cast(ts as varchar) as created_at
from requests where {AUDITED}"""


def _shown_audit(df):
    return df.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def _consents(s, f):
    """A consent per order: type by status, granted and expiring by key."""
    o = F.col("o_orderkey")
    return table(s, f, "orders").select(
        F.col("o_custkey").alias("patient_key"), F.col("o_orderstatus").alias("consent_type"),
        (o % 3 != 0).alias("granted"), F.when(o % 2 == 0, F.col("o_orderdate")).alias("expires_at"), o.alias("consent_id"))


CONSENTS = """consents as (select o_custkey as patient_key, o_orderstatus as consent_type, o_orderkey % 3 <> 0 as granted,
  case when o_orderkey % 2 = 0 then o_orderdate end as expires_at, o_orderkey as consent_id from orders)"""


def _policies(s, f):
    """One policy per region; the first two drive retention of two kinds of data."""
    k = F.col("r_regionkey")
    return table(s, f, "region").select(
        F.concat(F.lit("kind "), k.cast("string")).alias("data_type"), ((k + 1) * 500).cast("int").alias("retention_days"),
        F.when(k != 2, (k * 300).cast("int")).alias("anonymize_after_days"), (k != 4).alias("is_active"))


def _retained(s, f, kind):
    people = patients(s, f).select("id", "patient_id", "phone", "date_of_birth", "created_at")
    kept = gov.enforce_retention(people, _policies(s, f), kind, "created_at", ["phone", "date_of_birth"], "2001-01-01")
    return kept.withColumns({"date_of_birth": F.col("date_of_birth").cast("string"),
                             "created_at": F.col("created_at").cast("string")})


RETAINED_SQL = """
select id, patient_id, case when {old} then sha256(phone) else phone end as phone,
  case when {old} then null else cast(date_of_birth as varchar) end as date_of_birth, cast(created_at as varchar) as created_at
from patients where patients.created_at >= timestamp '2001-01-01' - interval {keep} day"""


def _raw_file(s, f):
    """Text rows as a patient file would give them, one per order, with faults of several kinds."""
    k, o, day = F.col("o_custkey"), F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    born = (F.when(o % 9 == 1, F.date_format("o_orderdate", "yyyyMMdd")).when(o % 9 == 2, F.lit("1999-02-30"))
            .when(o % 9 == 3, F.lit("")).when(o % 9 == 4, F.lit("2001-07")).when(o % 9 == 5, F.lit("2004-W53-7"))
            .otherwise(day))
    return table(s, f, "orders").select(
        (o + 1).alias("row_no"),
        F.when(k % 5 == 2, F.concat(F.lit("New#"), k.cast("string"))).otherwise(
            F.concat(F.lit("Customer#"), F.lpad(k.cast("string"), 9, "0"))).alias("patient_id"),
        F.when(o % 40 != 7, F.concat(F.lit("n"), o.cast("string"))).alias("first_name"),
        born.alias("date_of_birth"),
        F.when(o % 3 == 0, "male").when(o % 3 == 1, "Female").otherwise("").alias("gender"),
        F.col("o_orderpriority").alias("phone"))


RAW = """raw as (select o_orderkey + 1 as row_no,
  case when o_custkey % 5 = 2 then concat('New#', o_custkey)
       else concat('Customer#', lpad(cast(o_custkey as varchar), 9, '0')) end as patient_id,
  case when o_orderkey % 40 <> 7 then concat('n', o_orderkey) end as first_name,
  case o_orderkey % 9 when 1 then strftime(o_orderdate, '%Y%m%d') when 2 then '1999-02-30' when 3 then ''
    when 4 then '2001-07' when 5 then '2004-W53-7' else strftime(o_orderdate, '%Y-%m-%d') end as born,
  case o_orderkey % 9 when 5 then date '2005-01-02' when 2 then null when 3 then null when 4 then null
    else cast(o_orderdate as date) end as date_of_birth,
  case o_orderkey % 3 when 0 then 'M' when 1 then 'F' else '' end as gender, o_orderpriority as phone from orders),
good as (select * from raw where first_name is not null and date_of_birth is not null),
bad as (select row_no, concat_ws('; ', case when first_name is null then 'missing value for first_name' end,
  case when date_of_birth is null then concat('invalid date_of_birth: ', born) end) as problem
  from raw where first_name is null or date_of_birth is null)"""


def _merged_file(s, f):
    merged = merge_checked(patients(s, f).drop("id"), check_rows(_raw_file(s, f)), "2002-01-01 00:00:00")
    return merged.select("patient_id", "first_name", "last_name", F.col("date_of_birth").cast("string").alias("date_of_birth"),
                         "gender", "phone", "county", "hiv_status", F.col("updated_at").cast("string").alias("updated_at"))


def _request_stream(s, f):
    """The request log as a stream of files."""
    events = s.readStream.schema(LAYOUTS["events"]).parquet(f"{f}/events*.parquet")
    return audit_stream(as_requests(events))


def _streamed_audit(s, f):
    root = work_folder(s, "audit-stream")
    append_audit(_request_stream(s, f), f"{root}/rows", f"{root}/progress").awaitTermination()
    return _shown_audit(s.read.parquet(f"{root}/rows").drop("created_date"))


def _streamed_days(s, f):
    """The log until it is used up, then its end mark, through one query that goes on from its own state."""
    root = work_folder(s, "daily-actions")
    days = daily_actions(_request_stream(s, f), "1 hour", open_marks(s, f"{root}/marks"))

    def go_on():
        days.writeStream.format("parquet").outputMode("append").option("path", f"{root}/rows").option(
            "checkpointLocation", f"{root}/progress").trigger(availableNow=True).start().awaitTermination()

    go_on()
    mark_end(s, f"{root}/marks", LOG_ENDS)
    go_on()
    return s.read.schema(days.schema).parquet(f"{root}/rows").withColumn("day", F.col("day").cast("string"))


CASES = {
    "heatmap_points": (
        lambda s, f: geo.heatmap(predictions(s, f), patients(s, f), PREDICTIONS_AS_OF, 600, coords=COORDINATES,
                                 with_jitter=False),
        sql("patients predictions", HEATMAP_SQL.format(days=600, where="")),
    ),
    "heatmap_points_by_county": (
        lambda s, f: geo.heatmap(predictions(s, f), patients(s, f), PREDICTIONS_AS_OF, 90, "nation_7", COORDINATES, False),
        sql("patients predictions", HEATMAP_SQL.format(days=90, where="and lower(county) = 'nation_7'")),
    ),
    "heatmap_points_jittered": (
        lambda s, f: geo.heatmap(predictions(s, f), patients(s, f), PREDICTIONS_AS_OF, 600), None),
    "county_coordinates": (
        lambda s, f: patients(s, f).select("id", geo.coordinate(F.col("county"), 0, COORDINATES).alias("lat"),
                                           geo.coordinate(F.col("county"), 1, COORDINATES).alias("lng")),
        sql("patients", """select id,
case county when 'NATION_0' then -125e-2 when 'NATION_7' then -4e0 else -5e-1 end as lat,
case county when 'NATION_0' then 3675e-2 when 'NATION_7' then 395e-1 else 37e0 end as lng from patients"""),
    ),
    "county_summary": (
        lambda s, f: geo.county_summary(patients(s, f), predictions(s, f), PREDICTIONS_AS_OF, 30)
        .withColumn("avg_risk", F.round("avg_risk", 4)),
        sql("patients predictions", SUMMARY_SQL.format(days=30)),
    ),
    "risk_zones": (
        _zones,
        sql("patients predictions", f"""with {ZONES} select county, sub_county,
concat(county, ' / ', sub_county) as name, cast(period_start as varchar) as period_start,
cast(cast(period_start + interval 3 month - interval 1 day as date) as varchar) as period_end,
round(risk_score, 4) as risk_score, {ZONE_LEVEL} as risk_level, population_at_risk, total_screenings, positive_cases
from zones"""),
    ),
    "top_risk_zones": (
        _top_zones,
        sql("patients predictions", f"""with {ZONES}
select concat(county, '/', sub_county, '/', cast(zones.period_start as varchar)) as id, county, {ZONE_LEVEL} as risk_level,
round(zones.risk_score, 4) as risk_score, cast(zones.period_start as varchar) as period_start,
cast(cast(zones.period_start + interval 3 month - interval 1 day as date) as varchar) as period_end
from zones where lower(county) = 'nation_5' and {ZONE_LEVEL} = 'high'
order by zones.risk_score desc, 1 limit 100"""),
    ),
    "facility_coverage": (
        lambda s, f: geo.facility_coverage(_places(s, f), facilities(s, f)), sql("facilities", COVERAGE_SQL)),
    "request_classes": (
        lambda s, f: requests(s, f).select(
            "event_id", audit_action(F.col("http_method"), F.col("path")).alias("action"),
            audit_resource(F.col("path")).alias("resource_type"),
            client_ip(F.col("x_forwarded_for"), F.col("remote_addr")).alias("ip_address")),
        sql("requests", f"select event_id, {ACTION} as action, {RESOURCE} as resource_type, {ADDRESS} as ip_address from requests"),
    ),
    "request_audit": (
        lambda s, f: _shown_audit(audit_from_requests(requests(s, f))), sql("requests", REQUEST_AUDIT_SQL.replace(
            "cast(ts as varchar)", "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"))),
    "audit_log_page": (
        lambda s, f: newest(lookback(audit(s, f), "created_at", AUDIT_AS_OF, 7), "created_at", 100,
                            {"user_id": 8, "action": None, "resource_type": ""}).select("id", "action", "resource_type"),
        sql("audit", """select id, action, resource_type from audit
where created_at >= timestamp '2024-01-31' - interval 7 day and user_id = 8 order by created_at desc, id desc limit 100"""),
    ),
    "audit_log_filtered": (
        lambda s, f: optional_eq(optional_eq(audit(s, f), "action", "delete"), "resource_type", "Report").select("id", "user_id"),
        sql("audit", "select id, user_id from audit where action = 'delete' and resource_type = 'Report'"),
    ),
    "consented_predictions": (
        lambda s, f: gov.consented(predictions(s, f), _consents(s, f), "P", PREDICTIONS_AS_OF).select("id", "patient_key"),
        sql("predictions", f"""with {CONSENTS} select id, patient_key from predictions where patient_key in (
select patient_key from consents where consent_type = 'P' and granted
and (expires_at is null or expires_at > timestamp '2001-08-02'))"""),
    ),
    "patient_consents": (
        lambda s, f: patient_consents(patients(s, f), _consents(s, f), table(s, f, "orders").select(
            F.concat(F.lit("Customer#"), F.lpad((F.col("o_custkey") * 2).cast("string"), 9, "0")).alias("patient_id")))[0]
        .select("patient_id", "consent_id", "consent_type", "granted"),
        sql("patients", f"""with {CONSENTS} select patient_id, consent_id, consent_type, granted
from consents join patients on patients.id = patient_key where patient_id in (
select concat('Customer#', lpad(cast(o_custkey * 2 as varchar), 9, '0')) from orders)"""),
    ),
    "retained_patients": (
        lambda s, f: _retained(s, f, "kind 1"),
        sql("patients", RETAINED_SQL.format(keep=1000, old="patients.created_at < timestamp '2001-01-01' - interval 300 day")),
    ),
    "retained_without_hiding": (
        lambda s, f: _retained(s, f, "kind 0"),
        sql("patients", RETAINED_SQL.format(keep=500, old="patients.created_at < timestamp '2001-01-01'")),
    ),
    "coerced_file_rows": (
        lambda s, f: split_rows(check_rows(_raw_file(s, f)))[0].withColumn("date_of_birth", F.col("date_of_birth").cast("string")),
        f"""with {RAW} select row_no, patient_id, first_name, '' as last_name, cast(date_of_birth as varchar) as date_of_birth,
gender, phone, '' as email, '' as county, '' as sub_county from good""",
    ),
    "rejected_file_rows": (
        lambda s, f: split_rows(check_rows(_raw_file(s, f)))[1].select("row_no", F.array_join("errors", "; ").alias("problem")),
        f"with {RAW} select row_no, problem from bad",
    ),
    "ingest_statistics": (
        lambda s, f: ingest_stats(check_rows(_raw_file(s, f))),
        f"""with {RAW}, logged as (select * from bad order by row_no limit 50)
select (select count(*) from raw) as total, (select count(*) from good) as processed, (select count(*) from bad) as failed,
(select string_agg(concat('Row ', row_no, ': ', problem), chr(10) order by row_no) from logged) as error_log,
'partial' as status""",
    ),
    "ingested_patients": (
        _merged_file,
        sql("patients", f"""with {RAW},
last as (select * from good where row_no in (select max(row_no) from good group by patient_id))
select coalesce(q.patient_id, u.patient_id) as patient_id, coalesce(u.first_name, q.first_name) as first_name,
  case when u.patient_id is null then q.last_name else '' end as last_name,
  cast(coalesce(u.date_of_birth, q.date_of_birth) as varchar) as date_of_birth, coalesce(u.gender, q.gender) as gender,
  coalesce(u.phone, q.phone) as phone, case when u.patient_id is null then q.county else '' end as county,
  coalesce(hiv_status, 'unknown') as hiv_status,
  case when u.patient_id is null then '2001-01-01 00:00:00' else '2002-01-01 00:00:00' end as updated_at
from patients q full outer join last u on u.patient_id = q.patient_id"""),
    ),
    # --- streams run over the whole log until it is used up
    "audit_stream": (
        _streamed_audit, sql("requests", REQUEST_AUDIT_SQL.replace(
            "cast(ts as varchar)", "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"))),
    "daily_action_stream": (
        _streamed_days,
        sql("requests", f"""
select cast(cast(ts as date) as varchar) as day, {ACTION} as action, count(*) as n from requests where {AUDITED} group by 1, 2"""),
    ),
}
