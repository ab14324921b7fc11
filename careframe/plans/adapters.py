"""The driver tables seen as the library's domain tables.

Every view exists twice: as DataFrame code for the library side, and as SQL
text for the checking side.  The SQL of a check is built from these texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

# Fixed instants of the test data; never the wall clock.
PREDICTIONS_AS_OF = "2001-08-02 00:00:00"
AUDIT_AS_OF = "2024-01-31 00:00:00"
AGES_AS_OF = "2024-02-28"


# Layouts of the test tables, given so that no job is spent on finding them out.
LAYOUTS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(LAYOUTS[name]).parquet(f"{folder}/{name}.parquet")


def _pick(column, *values):
    """``values[column]`` for a column holding 0 .. len(values)-1."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (column + 1).cast("int"))


def patients(spark: SparkSession, folder: str) -> DataFrame:
    customer, nation = table(spark, folder, "customer"), table(spark, folder, "nation")
    k = F.col("c_custkey")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        k.alias("id"),
        F.col("c_name").alias("patient_id"),
        F.split_part("c_name", F.lit("#"), F.lit(1)).alias("first_name"),
        F.split_part("c_name", F.lit("#"), F.lit(2)).alias("last_name"),
        F.date_add(F.lit("1940-02-29").cast("date"), ((k * 37) % 27000).cast("int")).alias("date_of_birth"),
        _pick(k % 4, "M", "F", "O", "U").alias("gender"),
        F.concat(F.lit("07"), k.cast("string")).alias("phone"),
        F.concat(F.lit("p"), k.cast("string"), F.lit("@example.org")).alias("email"),
        _pick(k % 5, "single", "married", "divorced", "widowed", "cohabiting").alias("marital_status"),
        (k % 9).cast("int").alias("number_of_partners_12m"),
        (k % 31).cast("int").alias("number_of_partners_lifetime"),
        ((k % 5) / F.lit(4.0)).alias("condom_use_frequency"),
        (k % 3 == 0).alias("substance_use"),
        (k % 7 == 0).alias("prior_sti_history"),
        (k % 11 < 4).alias("symptoms_present"),
        _pick(k % 3, "negative", "positive", "unknown").alias("hiv_status"),
        F.col("n_name").alias("county"),
        F.col("c_mktsegment").alias("sub_county"),
        F.concat(F.lit("ward "), (k % 6).cast("string")).alias("ward"),
        (k % 20 != 0).alias("is_active"),
        F.timestamp_add("DAY", (k % 900).cast("int"), F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")).alias("created_at"),
        F.lit("2001-01-01 00:00:00").cast("timestamp_ntz").alias("updated_at"),
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    score = F.col("o_totalprice") / F.lit(500000.0)
    return table(spark, folder, "orders").select(
        k.alias("id"),
        F.when(c % 3 == 0, c + 1).otherwise(c).alias("patient_key"),
        F.when(k % 4 != 0, k % 100).alias("clinician_id"),
        _pick(k % 3, "general", "hiv", "hpv").alias("sti_type"),
        score.alias("risk_score"),
        F.when(score < 0.25, "low").when(score < 0.50, "moderate").when(score < 0.75, "high")
        .otherwise("very_high").alias("risk_level"),
        F.col("o_orderpriority").alias("model_version"),
        (F.col("o_orderstatus") == "F").alias("validated_by_clinician"),
        F.lit("").alias("clinician_notes"),
        F.when(F.col("o_orderstatus") == "F", "positive").when(F.col("o_orderstatus") == "O", "negative")
        .otherwise("").alias("actual_outcome"),
        F.col("o_orderdate").alias("created_at"),
    )


def facilities(spark: SparkSession, folder: str) -> DataFrame:
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    k = F.col("n_nationkey")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        k.alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("F"), k.cast("string")).alias("code"),
        F.col("r_name").alias("county"), (k % 6 != 0).alias("is_active"),
        (k * 0.4 - 5.0).alias("latitude"), (34.0 + (k % 7) * 0.9).alias("longitude"),
        (20.0 + (k % 4) * 15.0).alias("service_radius_km"),
    )


def clinicians(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        k.alias("id"), F.col("s_name").alias("staff_id"),
        _pick(k % 3, "doctor", "nurse", "lab_tech").alias("role"),
        F.when(k % 9 != 0, F.col("s_nationkey")).alias("facility_id"),
        (k % 10 != 0).alias("is_active"),
    )


def measures(spark: SparkSession, folder: str) -> DataFrame:
    order, line, price = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_extendedprice")
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when((order + line) % 13 == 0, None).when(order % 97 == 0, price * 10).otherwise(price).alias("x"),
        F.when(order % 17 != 0, F.col("l_quantity")).alias("q"),
        F.when(order % 11 != 0, F.col("l_returnflag")).alias("flag"),
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    return as_requests(table(spark, folder, "events"))


def as_requests(events: DataFrame) -> DataFrame:
    """Events, from a table or a stream, seen as web requests."""
    k, kind = F.col("event_id"), F.col("event_type")
    return events.select(
        "event_id", "ts",
        F.when(k % 6 != 0, F.col("user_id")).alias("user_id"),
        F.when(k % 7 == 0, " ").otherwise(F.concat(F.lit("Full "), F.col("user_id").cast("string"))).alias("full_name"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("username"),
        F.when(kind == "click", "PUT").when(kind == "purchase", "POST").when(kind == "error", "DELETE")
        .otherwise("GET").alias("http_method"),
        _pick(k % 8, "/api/predictions/predict", "/api/patients/", "/api/reporting/reports", "/static/app.js",
              "/api/clinicians/", "/accounts/login", "/accounts/logout", "/api/ml/models").alias("path"),
        F.when(k % 4 == 0, "").otherwise(
            F.concat(F.lit(" 10.0.0."), (k % 250).cast("string"), F.lit(" , 10.1.1.1"))).alias("x_forwarded_for"),
        F.lit("192.168.0.1").alias("remote_addr"),
        F.repeat(F.col("event_type"), F.lit(120)).alias("user_agent"),
    )


def audit(spark: SparkSession, folder: str) -> DataFrame:
    k, kind = F.col("event_id"), F.col("event_type")
    return table(spark, folder, "events").select(
        k.alias("id"), "user_id", F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("user_name"),
        F.when(kind == "view", "read").when(kind == "click", "update").when(kind == "purchase", "create")
        .when(kind == "error", "delete").otherwise("login").alias("action"),
        _pick(k % 3, "Patient", "Prediction", "Report").alias("resource_type"),
        F.col("ts").alias("created_at"),
    )


def visits(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        k.alias("id"), F.col("o_custkey").alias("patient_key"),
        _pick(k % 4, "screening", "follow_up", "treatment", "counseling").alias("visit_type"),
        F.col("o_orderpriority").alias("facility"), F.col("o_orderdate").alias("visit_date"),
    )


def models(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, folder, "part").select(
        k.alias("id"), F.col("p_brand").alias("name"), F.concat(F.lit("v"), k.cast("string")).alias("version"),
        F.when(k % 4 == 0, "deployed").when(k % 4 == 1, "ready").when(k % 4 == 2, "training")
        .otherwise("failed").alias("status"),
        (k % 4 == 0).alias("is_default"),
        F.timestamp_add("HOUR", k.cast("int"), F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")).alias("created_at"),
        F.lit("2020-01-01 00:00:00").cast("timestamp_ntz").alias("updated_at"),
    )


VIEWS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "patients": patients, "predictions": predictions, "facilities": facilities, "clinicians": clinicians,
    "measures": measures, "requests": requests, "audit": audit, "visits": visits, "models": models,
}

SQL_VIEWS = {
    "patients": """
select c_custkey as id, c_name as patient_id,
       split_part(c_name, '#', 1) as first_name, split_part(c_name, '#', 2) as last_name,
       cast(date '1940-02-29' + cast((c_custkey * 37) % 27000 as int) as date) as date_of_birth,
       case c_custkey % 4 when 0 then 'M' when 1 then 'F' when 2 then 'O' else 'U' end as gender,
       concat('07', c_custkey) as phone, concat('p', c_custkey, '@example.org') as email,
       case c_custkey % 5 when 0 then 'single' when 1 then 'married' when 2 then 'divorced'
                          when 3 then 'widowed' else 'cohabiting' end as marital_status,
       cast(c_custkey % 9 as int) as number_of_partners_12m,
       cast(c_custkey % 31 as int) as number_of_partners_lifetime,
       cast(c_custkey % 5 as double) / cast(4 as double) as condom_use_frequency,
       c_custkey % 3 = 0 as substance_use, c_custkey % 7 = 0 as prior_sti_history,
       c_custkey % 11 < 4 as symptoms_present,
       case c_custkey % 3 when 0 then 'negative' when 1 then 'positive' else 'unknown' end as hiv_status,
       n_name as county, c_mktsegment as sub_county, concat('ward ', c_custkey % 6) as ward,
       c_custkey % 20 <> 0 as is_active,
       timestamp '1998-01-01 00:00:00' + to_days(cast(c_custkey % 900 as int)) as created_at,
       timestamp '2001-01-01 00:00:00' as updated_at
from customer join nation on c_nationkey = n_nationkey""",
    "predictions": """
select o_orderkey as id, case when o_custkey % 3 = 0 then o_custkey + 1 else o_custkey end as patient_key,
       case when o_orderkey % 4 = 0 then null else o_orderkey % 100 end as clinician_id,
       case o_orderkey % 3 when 0 then 'general' when 1 then 'hiv' else 'hpv' end as sti_type,
       o_totalprice / cast(500000 as double) as risk_score,
       case when o_totalprice / cast(500000 as double) < 0.25 then 'low'
            when o_totalprice / cast(500000 as double) < 0.50 then 'moderate'
            when o_totalprice / cast(500000 as double) < 0.75 then 'high' else 'very_high' end as risk_level,
       o_orderpriority as model_version, o_orderstatus = 'F' as validated_by_clinician, '' as clinician_notes,
       case o_orderstatus when 'F' then 'positive' when 'O' then 'negative' else '' end as actual_outcome,
       o_orderdate as created_at
from orders""",
    "facilities": """
select n_nationkey as id, n_name as name, concat('F', n_nationkey) as code, r_name as county,
       n_nationkey % 6 <> 0 as is_active,
       n_nationkey * cast(0.4 as double) - cast(5 as double) as latitude,
       cast(34 as double) + (n_nationkey % 7) * cast(0.9 as double) as longitude,
       cast(20 as double) + (n_nationkey % 4) * cast(15 as double) as service_radius_km
from nation join region on n_regionkey = r_regionkey""",
    "clinicians": """
select s_suppkey as id, s_name as staff_id,
       case s_suppkey % 3 when 0 then 'doctor' when 1 then 'nurse' else 'lab_tech' end as role,
       case when s_suppkey % 9 = 0 then null else s_nationkey end as facility_id,
       s_suppkey % 10 <> 0 as is_active
from supplier""",
    "measures": """
select l_orderkey, l_linenumber,
       case when (l_orderkey + l_linenumber) % 13 = 0 then null
            when l_orderkey % 97 = 0 then l_extendedprice * 10 else l_extendedprice end as x,
       case when l_orderkey % 17 = 0 then null else l_quantity end as q,
       case when l_orderkey % 11 = 0 then null else l_returnflag end as flag
from lineitem""",
    "requests": """
select event_id, ts, case when event_id % 6 = 0 then null else user_id end as user_id,
       case when event_id % 7 = 0 then ' ' else concat('Full ', user_id) end as full_name,
       concat('user_', user_id) as username,
       case event_type when 'click' then 'PUT' when 'purchase' then 'POST'
                       when 'error' then 'DELETE' else 'GET' end as http_method,
       case event_id % 8 when 0 then '/api/predictions/predict' when 1 then '/api/patients/'
                         when 2 then '/api/reporting/reports' when 3 then '/static/app.js'
                         when 4 then '/api/clinicians/' when 5 then '/accounts/login'
                         when 6 then '/accounts/logout' else '/api/ml/models' end as path,
       case when event_id % 4 = 0 then '' else concat(' 10.0.0.', event_id % 250, ' , 10.1.1.1') end as x_forwarded_for,
       '192.168.0.1' as remote_addr, repeat(event_type, 120) as user_agent
from events""",
    "audit": """
select event_id as id, user_id, concat('user_', user_id) as user_name,
       case event_type when 'view' then 'read' when 'click' then 'update' when 'purchase' then 'create'
                       when 'error' then 'delete' else 'login' end as action,
       case event_id % 3 when 0 then 'Patient' when 1 then 'Prediction' else 'Report' end as resource_type,
       ts as created_at
from events""",
    "visits": """
select o_orderkey as id, o_custkey as patient_key,
       case o_orderkey % 4 when 0 then 'screening' when 1 then 'follow_up' when 2 then 'treatment'
                           else 'counseling' end as visit_type,
       o_orderpriority as facility, o_orderdate as visit_date
from orders""",
    "models": """
select p_partkey as id, p_brand as name, concat('v', p_partkey) as version,
       case p_partkey % 4 when 0 then 'deployed' when 1 then 'ready' when 2 then 'training' else 'failed' end as status,
       p_partkey % 4 = 0 as is_default,
       timestamp '2020-01-01 00:00:00' + to_hours(p_partkey) as created_at,
       timestamp '2020-01-01 00:00:00' as updated_at
from part""",
}


def sql(views: str, body: str) -> str:
    """SQL text of ``body`` over the named views (space separated)."""
    parts = [f"{name} as ({SQL_VIEWS[name]})" for name in views.split()]
    head = "with " + ",\n".join(parts)
    body = body.strip()
    if body.lower().startswith("with "):
        return f"{head},\n{body[5:]}" if parts else body
    return f"{head}\n{body}" if parts else body
