"""Registered queries: filters, lookups, listings, joins, table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from careframe.functions.predicates import (
    active_only, high_risk_only, lookback, optional_eq, optional_flag, search,
)
from careframe.functions.scalars import age_band, age_years, full_name, text_map, utc_day
from careframe.operators import lookups as lk, tables as tb
from careframe.operators.keyed import having, latest_per_key
from careframe.plans.adapters import (
    AGES_AS_OF, PREDICTIONS_AS_OF, clinicians, facilities, models, patients, predictions, sql, table, visits,
)
from careframe.plans.cases_reports import AGE, BAND, SINCE_90

PATIENT_KEYS = "id, patient_id, county, gender, is_active"


def _keys(df):
    return df.select("id", "patient_id", "county", "gender", "is_active")


def _text(df, *columns):
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def _wanted(s, f):
    """Requested ids: one per order, a third of them for people who do not exist."""
    k = F.col("o_custkey")
    name = F.concat(F.lit("Customer#"), F.lpad(k.cast("string"), 9, "0"))
    return table(s, f, "orders").select(
        F.col("o_orderkey").alias("pos"), F.when(k % 3 == 1, F.concat(F.lit("Nobody"), k.cast("string")))
        .otherwise(name).alias("patient_id"))


WANTED = """wanted as (
select o_orderkey as pos, case when o_custkey % 3 = 1 then concat('Nobody', o_custkey)
       else concat('Customer#', lpad(cast(o_custkey as varchar), 9, '0')) end as patient_id from orders)"""


def _updates(s, f):
    """Incoming patient rows, one per order: known customers and new people."""
    k, o = F.col("o_custkey"), F.col("o_orderkey")
    name = F.concat(F.lit("Customer#"), F.lpad(k.cast("string"), 9, "0"))
    return table(s, f, "orders").select(
        F.when(k % 5 == 2, F.concat(F.lit("New#"), k.cast("string"))).otherwise(name).alias("patient_id"),
        o.alias("row_no"), F.lit("First").alias("first_name"), F.concat(F.lit("L"), o.cast("string")).alias("last_name"),
        F.col("o_orderdate").cast("date").alias("date_of_birth"), F.lit("F").alias("gender"),
        F.col("o_orderpriority").alias("phone"), F.lit("").alias("email"),
        F.col("o_orderstatus").alias("county"), F.lit("").alias("sub_county"))


UPDATES = """updates as (
select case when o_custkey % 5 = 2 then concat('New#', o_custkey)
            else concat('Customer#', lpad(cast(o_custkey as varchar), 9, '0')) end as patient_id, o_orderkey as row_no,
       'First' as first_name, concat('L', o_orderkey) as last_name, cast(o_orderdate as date) as date_of_birth,
       'F' as gender, o_orderpriority as phone, '' as email, o_orderstatus as county, '' as sub_county
from orders)"""

UPSERTED = ["first_name", "last_name", "date_of_birth", "gender", "phone", "email", "county", "sub_county"]
SHOWN = ["patient_id", "first_name", "last_name", "date_of_birth", "gender", "phone", "county", "marital_status",
         "number_of_partners_12m", "condom_use_frequency", "hiv_status", "is_active", "created_at", "updated_at"]


def _registrations(s, f):
    """New patients to append, one per order: some known, some repeated, some invalid."""
    k, o = F.col("o_custkey"), F.col("o_orderkey")
    name = F.concat(F.lit("Customer#"), F.lpad(k.cast("string"), 9, "0"))
    return table(s, f, "orders").select(
        o.alias("row_no"),
        F.when(k % 2 == 0, name).otherwise(F.concat(F.lit("Reg#"), (o % 4000).cast("string"))).alias("patient_id"),
        F.lit("A").alias("first_name"), F.lit("B").alias("last_name"),
        F.when(o % 19 != 0, F.col("o_orderdate").cast("date")).alias("date_of_birth"),
        F.col("o_orderstatus").alias("gender_code"),
        F.when(F.col("o_orderstatus") == "P", "X").otherwise(F.lit("M")).alias("gender"),
        (F.col("o_totalprice") / 400000.0).alias("condom_use_frequency"),
    ).drop("gender_code")


REGISTRATIONS = """reg as (
select o_orderkey as row_no, case when o_custkey % 2 = 0 then concat('Customer#', lpad(cast(o_custkey as varchar), 9, '0'))
            else concat('Reg#', o_orderkey % 4000) end as patient_id,
       case when o_orderkey % 19 <> 0 then cast(o_orderdate as date) end as date_of_birth,
       case when o_orderstatus = 'P' then 'X' else 'M' end as gender,
       o_totalprice / cast(400000 as double) as condom_use_frequency from orders),
valid as (select * from reg where date_of_birth is not null and gender = 'M' and condom_use_frequency <= 1),
firsts as (select patient_id, min(row_no) as row_no from valid group by patient_id),
accepted as (select valid.* from valid join firsts using (patient_id, row_no)
             where patient_id not in (select c_name from customer))"""


def _patches(s, f):
    """One patch per order; each supplies other fields, and one in seven sets none."""
    o = F.col("o_orderkey")
    entries = F.array(
        F.when(o % 2 == 0, F.struct(F.lit("phone").alias("key"), F.concat(F.lit("+"), o.cast("string")).alias("value"))),
        F.when(o % 3 == 0, F.struct(F.lit("condom_use_frequency").alias("key"),
                                    ((o % 4) / 4.0).cast("string").alias("value"))),
        F.when(o % 5 == 0, F.struct(F.lit("is_active").alias("key"), F.lit("false").alias("value"))),
        F.when(o % 77 == 0, F.struct(F.lit("email").alias("key"), F.lit(None).cast("string").alias("value"))),
    )
    return table(s, f, "orders").select(
        F.col("o_custkey").alias("id"), o.alias("seq"), F.map_from_entries(F.array_compact(entries)).alias("fields"))


def _patched(s, f):
    usable, _ = tb.accepted_patches(_patches(s, f))
    changed = tb.patch(patients(s, f), usable, "id", "2002-01-01 00:00:00")
    return _text(changed.select("id", "phone", "email", "condom_use_frequency", "is_active", "updated_at"), "updated_at")


PATCH_SQL = """
with usable as (select o_custkey as id, o_orderkey as seq from orders where o_orderkey % 77 <> 0),
merged as (
  select id, max(seq) filter (where seq % 2 = 0) as p, max(seq) filter (where seq % 3 = 0) as c,
         max(seq) filter (where seq % 5 = 0) as a from usable group by id)
select patients.id, case when p is null then phone else concat('+', p) end as phone, email,
       case when c is null then condom_use_frequency else (c % 4) / cast(4 as double) end as condom_use_frequency,
       case when a is null then is_active else false end as is_active,
       case when merged.id is null then '2001-01-01 00:00:00' else '2002-01-01 00:00:00' end as updated_at
from patients left join merged on merged.id = patients.id"""


def _feedback(s, f):
    """Feedback per line item, on the prediction of every third order."""
    line = F.col("l_linenumber")
    return table(s, f, "lineitem").select(
        (F.col("l_orderkey") - F.col("l_orderkey") % 3).alias("id"),
        (F.col("l_partkey") * 100000 + F.col("l_suppkey") * 10 + line).alias("seq"),
        F.concat(F.lit("note "), F.col("l_partkey").cast("string")).alias("notes"),
        F.when(F.col("l_returnflag") == "A", "negative").when(F.col("l_returnflag") == "R", "positive")
        .otherwise("").alias("actual_outcome"))


FEEDBACK_SQL = """
with feedback as (
  select l_orderkey - l_orderkey % 3 as id, l_partkey * 100000 + l_suppkey * 10 + l_linenumber as seq,
         concat('note ', l_partkey) as notes,
         case l_returnflag when 'A' then 'negative' when 'R' then 'positive' else '' end as actual_outcome
  from lineitem),
merged as (
  select id, max_by(notes, seq) as notes, max_by(actual_outcome, seq) filter (where actual_outcome <> '') as outcome
  from feedback group by id)
select predictions.id, validated_by_clinician or merged.id is not null as validated_by_clinician,
       case when merged.id is null then clinician_notes else merged.notes end as clinician_notes,
       coalesce(outcome, actual_outcome) as actual_outcome
from predictions left join merged on merged.id = predictions.id"""


def _targets(s, f):
    """Promotion requests, one per line item's part; parts repeat and most are not ready."""
    return table(s, f, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.min(
        F.col("l_orderkey") * 10000 + F.col("l_suppkey")).alias("first"), F.max("l_suppkey").alias("last")
    ).select("id", F.explode(F.array(
        F.struct((F.col("first") * 10000 + F.col("id")).alias("seq")),
        F.struct((F.col("first") * 10000 + F.col("id") + 5000).alias("seq")))).alias("s")).select("id", "s.seq")


PROMOTE_SQL = """
with firsts as (
  select l_partkey as id, min(l_orderkey * 10000 + l_suppkey) * 10000 + l_partkey as seq from lineitem group by l_partkey),
accepted as (select firsts.id, name, seq from firsts join models on models.id = firsts.id where status = 'ready'),
winners as (select name, arg_max(id, seq) as winner from accepted group by name)
select models.id, case when models.id = winner then 'deployed'
            when winner is not null and (is_default or accepted.id is not null) then 'deprecated'
            else status end as status,
       case when models.id = winner then true
            when winner is not null and (is_default or accepted.id is not null) then false
            else is_default end as is_default
from models left join winners on winners.name = models.name left join accepted on accepted.id = models.id"""


def _with_prediction_id(df):
    return df.select("id", "patient_key", "risk_score", "risk_level")


CASES = {
    # --- scans, filters and predicates
    "patient_table": (
        lambda s, f: _text(patients(s, f).select(*SHOWN), "date_of_birth", "created_at", "updated_at"),
        sql("patients", f"""select {', '.join(
            f"cast({c} as varchar) as {c}" if c in ('date_of_birth', 'created_at', 'updated_at') else c for c in SHOWN)}
from patients"""),
    ),
    "search_patients": (
        lambda s, f: _keys(search(patients(s, f), "#00000001", lk.SEARCHED)),
        sql("patients", f"""
select {PATIENT_KEYS} from patients
where contains(lower(patient_id), '#00000001') or contains(lower(first_name), '#00000001')
   or contains(lower(last_name), '#00000001') or contains(lower(phone), '#00000001')"""),
    ),
    "search_is_literal": (
        lambda s, f: _keys(search(patients(s, f).withColumn("first_name", F.concat(
            F.when(F.col("id") % 7 == 0, "5%_").when(F.col("id") % 7 == 1, "5xy").otherwise("5_%"), "first_name")), "5%_", lk.SEARCHED)),
        sql("patients", f"select {PATIENT_KEYS} from patients where id % 7 = 0"),
    ),
    "county_equals": (
        lambda s, f: _keys(optional_eq(patients(s, f), "county", "nation_3", ci=True)),
        sql("patients", f"select {PATIENT_KEYS} from patients where lower(county) = lower('nation_3')"),
    ),
    "gender_equals": (
        lambda s, f: _keys(optional_eq(optional_eq(patients(s, f), "gender", "F"), "hiv_status", "")),
        sql("patients", f"select {PATIENT_KEYS} from patients where gender = 'F'"),
    ),
    "inactive_flag": (
        lambda s, f: _keys(optional_flag(optional_flag(patients(s, f), "is_active", False), "is_active", None)),
        sql("patients", f"select {PATIENT_KEYS} from patients where not is_active"),
    ),
    "active_patients": (
        lambda s, f: _keys(active_only(patients(s, f))),
        sql("patients", f"select {PATIENT_KEYS} from patients where is_active"),
    ),
    "recent_predictions": (
        lambda s, f: _with_prediction_id(lookback(predictions(s, f), "created_at", PREDICTIONS_AS_OF, 90)),
        sql("predictions", f"""select id, patient_key, risk_score, risk_level
from predictions where created_at >= {SINCE_90}"""),
    ),
    "high_risk_predictions": (
        lambda s, f: _with_prediction_id(high_risk_only(predictions(s, f))),
        sql("predictions", """select id, patient_key, risk_score, risk_level
from predictions where risk_level in ('high', 'very_high')"""),
    ),
    "lookup_found": (
        lambda s, f: _keys(lk.lookup(patients(s, f), _wanted(s, f), "patient_id")[0]),
        sql("patients", f"with {WANTED} select {PATIENT_KEYS} from patients where patient_id in (select patient_id from wanted)"),
    ),
    "lookup_missing": (
        lambda s, f: lk.lookup(patients(s, f), _wanted(s, f), "patient_id")[1],
        sql("patients", f"""with {WANTED} select distinct patient_id from wanted
where patient_id not in (select patient_id from patients)"""),
    ),
    # --- projections
    "patient_ages": (
        lambda s, f: patients(s, f).select(
            "id", age_years(F.col("date_of_birth"), F.lit(AGES_AS_OF).cast("date")).alias("age"),
            full_name(F.col("first_name"), F.col("last_name")).alias("full_name"),
        ).withColumn("age_group", age_band(F.col("age"))),
        sql("patients", f"""with aged as (select *, {AGE.format(on=AGES_AS_OF)} as age from patients)
select id, age, concat(first_name, ' ', last_name) as full_name, {BAND} as age_group from aged"""),
    ),
    "patient_list": (
        lambda s, f: _text(lk.patient_list(patients(s, f), AGES_AS_OF), "created_at"),
        sql("patients", f"""select id, patient_id, concat(first_name, ' ', last_name) as full_name,
{AGE.format(on=AGES_AS_OF)} as age, gender, county, is_active, cast(created_at as varchar) as created_at from patients"""),
    ),
    "patient_detail": (
        lambda s, f: _text(lk.patient_detail(patients(s, f), AGES_AS_OF), "date_of_birth", "created_at", "updated_at"),
        sql("patients", f"""with aged as (select *, {AGE.format(on=AGES_AS_OF)} as age from patients)
select id, patient_id, first_name, last_name, cast(date_of_birth as varchar) as date_of_birth, gender, age,
       {BAND} as age_group, phone, email, county, sub_county, ward, marital_status, number_of_partners_12m,
       condom_use_frequency, substance_use, prior_sti_history, hiv_status, symptoms_present, is_active,
       cast(created_at as varchar) as created_at, cast(updated_at as varchar) as updated_at from aged"""),
    ),
    "prediction_days": (
        lambda s, f: predictions(s, f).select("id", utc_day(F.col("created_at")).cast("string").alias("day")),
        sql("predictions", "select id, cast(cast(created_at as date) as varchar) as day from predictions"),
    ),
    "event_properties": (
        lambda s, f: table(s, f, "events").select(
            "event_id", text_map(F.col("props")).getItem("k").cast("int").alias("k"),
            F.to_json(text_map(F.col("props"))).alias("document")),
        "select event_id, cast(json_extract_string(props, '$.k') as int) as k, "
        "concat('{\"k\":\"', json_extract_string(props, '$.k'), '\"}') as document from events",
    ),
    # --- listings and pages
    "patient_page": (
        lambda s, f: _text(lk.list_patients(patients(s, f), AGES_AS_OF, text="customer", gender="M", is_active=True,
                                            limit=50, offset=100), "created_at"),
        sql("patients", f"""select id, patient_id, concat(first_name, ' ', last_name) as full_name,
{AGE.format(on=AGES_AS_OF)} as age, gender, county, is_active, cast(patients.created_at as varchar) as created_at
from patients where contains(lower(patient_id), 'customer') and gender = 'M' and is_active
order by patients.created_at desc, id desc limit 50 offset 100"""),
    ),
    "deep_prediction_page": (
        lambda s, f: _text(lk.page(predictions(s, f).select("id", "patient_key", "created_at"), "created_at", 50, 12345),
                           "created_at"),
        sql("predictions", """select id, patient_key, cast(predictions.created_at as varchar) as created_at from predictions
order by predictions.created_at desc, id desc limit 50 offset 12345"""),
    ),
    "next_prediction_page": (
        lambda s, f: _text(lk.page_after(predictions(s, f).select("id", "patient_key", "created_at"), "created_at",
                                         F.lit("1998-05-05 00:00:00").cast("timestamp_ntz"), F.lit(5000)), "created_at"),
        sql("predictions", """select id, patient_key, cast(predictions.created_at as varchar) as created_at from predictions
where predictions.created_at < timestamp '1998-05-05' or (predictions.created_at = timestamp '1998-05-05' and id < 5000)
order by predictions.created_at desc, id desc limit 50"""),
    ),
    "newest_predictions": (
        lambda s, f: lk.newest(predictions(s, f), "created_at", 20, {"sti_type": "hiv", "model_version": None})
        .select("id", "sti_type"),
        sql("predictions", """select id, sti_type from predictions where sti_type = 'hiv'
order by created_at desc, id desc limit 20"""),
    ),
    "newest_models": (
        lambda s, f: lk.newest(models(s, f), "created_at", 20, {"status": "ready"}).select("id", "name", "status"),
        sql("models", "select id, name, status from models where status = 'ready' order by created_at desc, id desc limit 20"),
    ),
    "all_models": (
        lambda s, f: lk.newest(models(s, f), "created_at", None, {"status": "ready"}).select("id", "name", "status"),
        sql("models", "select id, name, status from models where status = 'ready'"),
    ),
    "facility_list": (
        lambda s, f: lk.list_facilities(facilities(s, f), "africa").select("id", "name", "county"),
        sql("facilities", "select id, name, county from facilities where is_active and lower(county) = 'africa'"),
    ),
    "active_facility": (
        lambda s, f: optional_eq(active_only(facilities(s, f)), "id", 7).select("id", "name", "county"),
        sql("facilities", "select id, name, county from facilities where is_active and id = 7"),
    ),
    "clinician_list": (
        lambda s, f: lk.list_clinicians(clinicians(s, f), facilities(s, f), role="nurse").select(
            "id", "staff_id", "role", F.col("facility.name").alias("facility_name"),
            F.col("facility.county").alias("facility_county"), F.col("facility").isNull().alias("no_facility")),
        sql("clinicians facilities", """
select c.id, staff_id, role, f.name as facility_name, f.county as facility_county, f.id is null as no_facility
from clinicians c left join facilities f on f.id = c.facility_id where c.is_active and role = 'nurse'"""),
    ),
    # --- joins
    "predictions_in_county": (
        lambda s, f: lk.predictions_in_county(predictions(s, f), patients(s, f), "nation_5").select("id", "patient_key", "county"),
        sql("patients predictions", """select p.id, patient_key, county from predictions p
join patients q on q.id = p.patient_key where lower(county) = 'nation_5'"""),
    ),
    "predictions_by_facility": (
        lambda s, f: lk.predictions_by_facility(predictions(s, f), clinicians(s, f), 5).select("id", "clinician_id", "facility_id"),
        sql("clinicians predictions", """select p.id, clinician_id, facility_id from predictions p
join clinicians c on c.id = p.clinician_id where facility_id = 5"""),
    ),
    "patients_with_predictions": (
        lambda s, f: lk.patients_with_predictions(patients(s, f), predictions(s, f)).select(
            "patient_key", "county", "is_active", "prediction_id", "risk_score"),
        sql("patients predictions", """select q.id as patient_key, county, is_active, p.id as prediction_id,
risk_score from patients q left join predictions p on p.patient_key = q.id"""),
    ),
    "high_risk_in_window": (
        lambda s, f: lk.high_risk_in_window(predictions(s, f), patients(s, f), PREDICTIONS_AS_OF, 600).select(
            "patient_key", "county", "n", "high_n"),
        sql("patients predictions", """select patient_key, county, count(*) as n,
count(*) filter (where risk_level in ('high', 'very_high')) as high_n
from predictions p join patients q on q.id = p.patient_key
where p.created_at >= timestamp '2001-08-02 00:00:00' - interval 600 day group by 1, 2"""),
    ),
    "patient_visits": (
        lambda s, f: _text(lk.patient_visits(patients(s, f), visits(s, f)).select(
            "patient_id", "id", "visit_type", "facility", "visit_date"), "visit_date"),
        sql("patients visits", """select patient_id, v.id, visit_type, facility, cast(visit_date as varchar) as visit_date
from visits v join patients q on q.id = v.patient_key"""),
    ),
    "prediction_history": (
        lambda s, f: lk.history(patients(s, f), predictions(s, f)).select("patient_id", "patient_name", "id", "risk_level"),
        sql("patients predictions", """
with ranked as (select *, row_number() over (partition by patient_key order by created_at desc, id desc) as place
                from predictions)
select patient_id, concat(first_name, ' ', last_name) as patient_name, r.id, risk_level
from ranked r join patients q on q.id = r.patient_key where place <= 20"""),
    ),
    "prediction_history_by_type": (
        lambda s, f: lk.history(patients(s, f), predictions(s, f), "hpv", 2).select("patient_id", "patient_name", "id"),
        sql("patients predictions", """
with ranked as (select *, row_number() over (partition by patient_key order by created_at desc, id desc) as place
                from predictions where sti_type = 'hpv')
select patient_id, concat(first_name, ' ', last_name) as patient_name, r.id
from ranked r join patients q on q.id = r.patient_key where place <= 2"""),
    ),
    "clinician_facility": (
        lambda s, f: lk.with_facility(clinicians(s, f), facilities(s, f)).select(
            "id", F.col("facility.id").alias("facility_id"), F.col("facility.code").alias("facility_code")),
        sql("clinicians facilities", """select c.id, f.id as facility_id, f.code as facility_code
from clinicians c left join facilities f on f.id = c.facility_id"""),
    ),
    "patients_without_predictions": (
        lambda s, f: having(patients(s, f), predictions(s, f).select(F.col("patient_key").alias("id")), "id", "left_anti")
        .select("id", "patient_id"),
        sql("patients predictions", """select id, patient_id from patients
where id not in (select patient_key from predictions)"""),
    ),
    "patients_with_any_prediction": (
        lambda s, f: having(patients(s, f), predictions(s, f).select(F.col("patient_key").alias("id")), "id")
        .select("id", "patient_id"),
        sql("patients predictions", "select id, patient_id from patients where id in (select patient_key from predictions)"),
    ),
    # --- table maintenance
    "keep_last_update": (
        lambda s, f: latest_per_key(_updates(s, f), ["patient_id"], "row_no").select("patient_id", "row_no", "last_name"),
        f"with {UPDATES} select patient_id, max(row_no) as row_no, concat('L', max(row_no)) as last_name from updates group by 1",
    ),
    "upsert_patients": (
        lambda s, f: _text(tb.upsert(patients(s, f).drop("id"), _updates(s, f), "patient_id", "row_no", UPSERTED,
                                     "2002-01-01 00:00:00").select(*SHOWN), "date_of_birth", "created_at", "updated_at"),
        sql("patients", f"""with {UPDATES},
last as (select * from updates where row_no in (select max(row_no) from updates group by patient_id))
select coalesce(q.patient_id, u.patient_id) as patient_id,
       case when u.patient_id is null then q.first_name else u.first_name end as first_name,
       case when u.patient_id is null then q.last_name else u.last_name end as last_name,
       cast(case when u.patient_id is null then q.date_of_birth else u.date_of_birth end as varchar) as date_of_birth,
       case when u.patient_id is null then q.gender else u.gender end as gender,
       case when u.patient_id is null then q.phone else u.phone end as phone,
       case when u.patient_id is null then q.county else u.county end as county,
       coalesce(marital_status, 'single') as marital_status,
       coalesce(number_of_partners_12m, 0) as number_of_partners_12m,
       coalesce(condom_use_frequency, 0) as condom_use_frequency, coalesce(hiv_status, 'unknown') as hiv_status,
       coalesce(is_active, true) as is_active,
       cast(coalesce(created_at, timestamp '2002-01-01 00:00:00') as varchar) as created_at,
       cast(case when u.patient_id is null then updated_at else timestamp '2002-01-01 00:00:00' end as varchar) as updated_at
from patients q full outer join last u on u.patient_id = q.patient_id"""),
    ),
    "append_validated_patients": (
        lambda s, f: tb.append_validated(patients(s, f), _registrations(s, f), "row_no")[0].select(
            "patient_id", F.col("date_of_birth").cast("string").alias("date_of_birth"), "gender", "marital_status",
            "hiv_status", "condom_use_frequency", "is_active"),
        f"""with {REGISTRATIONS} select patient_id, cast(date_of_birth as varchar) as date_of_birth, gender,
'single' as marital_status, 'unknown' as hiv_status, condom_use_frequency,
true as is_active from accepted""",
    ),
    "rejected_registrations": (
        lambda s, f: tb.append_validated(patients(s, f), _registrations(s, f), "row_no")[1].select("row_no", "patient_id"),
        f"with {REGISTRATIONS} select row_no, patient_id from reg where row_no not in (select row_no from accepted)",
    ),
    "patch_patients": (_patched, sql("patients", PATCH_SQL)),
    "refused_patches": (
        lambda s, f: tb.accepted_patches(_patches(s, f))[1].select("id", "seq"),
        "select o_custkey as id, o_orderkey as seq from orders where o_orderkey % 77 = 0",
    ),
    "deactivate_patients": (
        lambda s, f: tb.deactivate(patients(s, f), _wanted(s, f), "patient_id").select("id", "is_active"),
        sql("patients", f"""with {WANTED} select id, case when patient_id in (select patient_id from wanted) then false
else is_active end as is_active from patients"""),
    ),
    "clinician_feedback": (
        lambda s, f: tb.apply_feedback(predictions(s, f), _feedback(s, f)).select(
            "id", "validated_by_clinician", "clinician_notes", "actual_outcome"),
        sql("predictions", FEEDBACK_SQL),
    ),
    "promote_models": (
        lambda s, f: tb.promote(models(s, f), _targets(s, f), "2002-01-01 00:00:00")[0].select("id", "status", "is_default"),
        sql("models", PROMOTE_SQL),
    ),
    "refused_promotions": (
        lambda s, f: tb.promote(models(s, f), _targets(s, f))[1].select("id", "seq"),
        sql("models", """with firsts as (select l_partkey as id,
  min(l_orderkey * 10000 + l_suppkey) * 10000 + l_partkey as seq from lineitem group by l_partkey)
select id, seq from firsts where id not in (select id from models where status = 'ready')
union all select id, seq + 5000 from firsts"""),
    ),
}
