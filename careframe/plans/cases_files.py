"""Registered queries that go through files: appends, reports, patient files, resources, landing folders; and training."""

from __future__ import annotations

from pyspark.sql import functions as F

from careframe.functions.features import feature_columns
from careframe.functions.predicates import active_only
from careframe.operators import bucketed, evaluate as ev, learn, scoring as sc, tables as tb
from careframe.operators.dashboards import county_breakdown
from careframe.plans import cases_scoring as scores
from careframe.plans.adapters import AGES_AS_OF, PREDICTIONS_AS_OF, patients, predictions, sql, table
from careframe.plans.cases_places import RAW, _policies, _raw_file
from careframe.plans.cases_reports import BREAKDOWN_SQL
from careframe.session import work_folder
from careframe.sources import fhir, patient_csv as pc, stored
from careframe.streaming import landing


def _appended(s, f):
    """Score a batch twice, append both to one table as whole prediction rows, and read the recent dates back."""
    path = f"{work_folder(s, 'predictions')}/rows"
    for first_id in (0, 1_000_000_000):
        tb.append_rows(sc.score_batch(scores._requests(s, f), patients(s, f), PREDICTIONS_AS_OF, sti_type="hpv", first_id=first_id), path)
    rows = tb.recent_partitions(s, path, PREDICTIONS_AS_OF, 30)
    return rows.select(
        *[c for c in rows.columns if c not in ("top_risk_factors", "input_features", "recommended_tests", "created_at", "created_date")],
        F.col("top_risk_factors").getItem("heuristic_model").alias("factor"), F.size("input_features").alias("features"),
        F.col("input_features").getItem("num_partners_12m").alias("partners"), F.col("input_features").getItem("age").alias("age"),
        F.array_join("recommended_tests", "|").alias("tests"), F.col("created_at").cast("string").alias("created_at"),
        F.col("created_date").cast("string").alias("created_date"))


APPENDED_SQL = f"""
with {scores.REQUESTS},
one as (select pos, q.id as patient_key, patient_id, concat(first_name, ' ', last_name) as patient_name, {scores.SCORE} as s,
    cast(number_of_partners_12m as double) as partners, cast({scores.AGE.format(on=PREDICTIONS_AS_OF[:10])} as double) as age
  from requests join patients q using (patient_id) where is_active)
select pos + first_id as id, patient_key, patient_id, patient_name, null::bigint as clinician_id, 'hpv' as sti_type, round(s, 4) as risk_score,
  {scores.LEVEL.format("s")} as risk_level, round(greatest(0, s - 15e-2), 4) as confidence_interval_lower,
  round(least(1, s + 15e-2), 4) as confidence_interval_upper, 'heuristic_v1' as model_version, 'Rule-based Heuristic' as model_name,
  'Schedule screening appointment. Provide risk reduction counseling.' as recommended_actions, false as validated_by_clinician,
  '' as clinician_notes, '' as actual_outcome, 'Using rule-based fallback' as factor, 16 as features, partners, age,
  case when s > 3e-1 then 'HIV|Syphilis|Gonorrhea|Chlamydia' else 'HIV|Syphilis' end as tests,
  '2001-08-02 00:00:00' as created_at, '2001-08-02' as created_date
from one, (values (0), (1000000000)) as v(first_id)"""


def _written_report(s, f):
    path = f"{work_folder(s, 'report')}/county"
    report = county_breakdown(patients(s, f), predictions(s, f)).withColumn("avg_risk", F.round("avg_risk", 4))
    stored.write_report(report, path, "csv")
    return s.read.schema("county string, patients long, avg_risk double, high_risk long").option("header", True).csv(path)


def _files(s, f):
    """Patient rows written as CSV files of three layouts, one with line breaks inside fields, and read back."""
    path = f"{work_folder(s, 'patient-files')}/in"
    raw, part = _raw_file(s, f), (F.col("row_no") - 1) % 3
    lines = raw.withColumn("county", F.lit("two\nlines"))
    layouts = ["patient_id first_name date_of_birth gender phone", "county phone gender date_of_birth first_name patient_id",
               "phone zone patient_id gender first_name date_of_birth"]
    for i, names in enumerate(layouts):
        lines.withColumn("zone", F.lit("z")).filter(part == i).select(*names.split()).write.option("header", True).option(
            "escape", '"').csv(f"{path}/{i}")
    return pc.check_rows(pc.read_patient_csv(s, f"{path}/*"))


def _file_rows(s, f):
    valid, _ = pc.split_rows(_files(s, f))
    return valid.select("patient_id", "first_name", F.col("date_of_birth").cast("string").alias("date_of_birth"), "gender",
                        "phone", "county")


def _file_statistics(s, f):
    """Statistics per file, added up per layout."""
    layout = F.regexp_extract(pc.SOURCE_FILE, "/in/(.)/", 1).cast("int").alias("layout")
    return pc.file_stats(_files(s, f)).groupBy(layout).agg(*[F.sum(c).alias(c) for c in ("total", "processed", "failed")])


def _landing(s, f):
    """Patient rows of updates, new keys, repeats and faults, landing as files beside the bucketed patient table, three per batch.

    A key's rows are in one file, in order, so the last of them wins whichever file is newer."""
    root = work_folder(s, "landing")
    _raw_file(s, f).repartition(8, "patient_id").sortWithinPartitions("row_no").drop("row_no").write.option("header", True).csv(f"{root}/in")
    bucketed.create(patients(s, f).drop("id"), f"{root}/table", "patient_id", 16)
    landing.start_landing(s, f"{root}/in", None, f"{root}/table", f"{root}/stats", f"{root}/progress",
                          "2002-01-01 00:00:00", max_files=3).awaitTermination()
    return root


def _landed(s, f):
    return bucketed.read(s, f"{_landing(s, f)}/table").select(
        "patient_id", "first_name", "last_name", F.col("date_of_birth").cast("string").alias("date_of_birth"), "gender", "phone", "county",
        "hiv_status", F.col("updated_at").cast("string").alias("updated_at"))


def _landed_statistics(s, f):
    """What the landing's jobs say, added up, and how many of their log lines are of each kind of fault."""
    jobs = s.read.parquet(f"{_landing(s, f)}/stats/jobs")
    return jobs.agg(F.count("*").alias("files"), *[F.sum(c).alias(c) for c in ("total", "processed", "failed")],
                    F.count_if(F.col("status") == "partial").alias("partial"),
                    F.sum(F.size(F.regexp_extract_all("error_log", F.lit("(?m)^Row [0-9]+: invalid date_of_birth: "), F.lit(0)))).alias("logged"))


LANDED_SQL = f"""with {RAW},
landed as (select row_no, patient_id, coalesce(first_name, '') as first_name, date_of_birth, gender, phone from raw where date_of_birth is not null),
last as (select * from landed where row_no in (select max(row_no) from landed group by patient_id))
select coalesce(q.patient_id, u.patient_id) as patient_id, coalesce(u.first_name, q.first_name) as first_name,
  case when u.patient_id is null then q.last_name else '' end as last_name,
  cast(coalesce(u.date_of_birth, q.date_of_birth) as varchar) as date_of_birth, coalesce(u.gender, q.gender) as gender,
  coalesce(u.phone, q.phone) as phone, case when u.patient_id is null then q.county else '' end as county,
  coalesce(hiv_status, 'unknown') as hiv_status,
  case when u.patient_id is null then '2001-01-01 00:00:00' else '2002-01-01 00:00:00' end as updated_at
from patients q full outer join last u on u.patient_id = q.patient_id"""


def _resources(s, f):
    """Patients written out as FHIR documents and read back from their text."""
    people = patients(s, f)
    document = F.to_json(F.struct(
        F.when(F.col("id") % 10 == 9, "Organization").otherwise("Patient").alias("resourceType"),
        F.col("patient_id").alias("id"),
        F.when(F.col("gender") == "M", "male").when(F.col("gender") == "F", "female").when(F.col("gender") == "O", "other")
        .alias("gender"),
        F.col("date_of_birth").cast("string").alias("birthDate"), F.col("is_active").alias("active"),
        F.array(F.struct(F.col("last_name").alias("family"), F.array("first_name", F.lit("X")).alias("given"))).alias("name"),
        F.array(F.struct(F.lit("email").alias("system"), F.col("email").alias("value")),
                F.struct(F.lit("phone").alias("system"), F.col("phone").alias("value"))).alias("telecom"),
        F.array(F.struct(F.col("county").alias("state"), F.col("sub_county").alias("district"))).alias("address")))
    parsed = people.select(F.from_json(document, fhir.RESOURCE).alias("r")).select("r.*")
    return fhir.fhir_patients(parsed).withColumn("date_of_birth", F.col("date_of_birth").cast("string"))


def _outcomes(s, f):
    """Features of every patient with the outcome of their predictions: more positives than negatives or not."""
    y = F.when(F.col("actual_outcome") == "positive", 1).when(F.col("actual_outcome") == "negative", -1).otherwise(0)
    balance = predictions(s, f).groupBy(F.col("patient_key").alias("id")).agg(F.sum(y).alias("balance"))
    return feature_columns(patients(s, f), AGES_AS_OF).join(balance, "id").withColumn("label", (F.col("balance") > 0).cast("double"))


def _trained(s, f):
    model, _ = learn.train(_outcomes(s, f), "label", "logistic_regression", "trained_v1", folds=1)
    return sc.score(patients(s, f), AGES_AS_OF, model).select("id", "risk_score", "risk_level", "model_version", "model_name")


CASES = {
    "appended_predictions": (_appended, sql("patients", APPENDED_SQL)),
    "written_report": (_written_report, sql("patients predictions", BREAKDOWN_SQL.format(extra=""))),
    "patient_file_rows": (
        _file_rows,
        f"""with {RAW} select patient_id, coalesce(first_name, '') as first_name, cast(date_of_birth as varchar) as date_of_birth,
gender, phone, case when row_no % 3 = 2 then concat('two', chr(10), 'lines') else '' end as county
from raw where date_of_birth is not null"""),
    "file_statistics": (
        _file_statistics,
        f"""with {RAW} select cast((row_no - 1) % 3 as integer) as layout, count(*) as total, count(date_of_birth) as processed,
count(*) - count(date_of_birth) as failed from raw group by 1"""),
    "landed_patients": (_landed, sql("patients", LANDED_SQL)),
    # Every file has over 50 faults at sf0.01 and more; the smallest tables have fewer, hence the least of both.
    "landed_statistics": (
        _landed_statistics,
        f"""with {RAW}, faults as (select count(*) - count(date_of_birth) as failed, count(*) as total, count(date_of_birth) as processed from raw)
select 8::bigint as files, total, processed, failed, 8::bigint as partial, case when failed > 400 then 400 else failed end::bigint as logged from faults"""),
    "resource_patients": (
        _resources,
        sql("patients", """select patient_id, concat(first_name, ' X') as first_name, last_name,
cast(date_of_birth as varchar) as date_of_birth, gender, phone, email, county, sub_county, is_active
from patients where id % 10 <> 9""")),
    "active_policies": (
        lambda s, f: active_only(_policies(s, f)).select("data_type", "retention_days"),
        """select concat('kind ', r_regionkey) as data_type, (r_regionkey + 1) * 500 as retention_days from region
where r_regionkey <> 4"""),
    # Fitted parameters have no SQL; tests cover these two.
    "trained_model_scores": (_trained, None),
    "model_performance": (lambda s, f: ev.performance(predictions(s, f), "heuristic_v1", "general", "2001-08-02"), None),
}
