"""Registered queries over what is kept beside the tables: search postings, consent history, catchment areas, daily state."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from careframe.functions import documents
from careframe.operators import bucketed, catchments, daily_state as state, governance as gov, lookups as lk, retention, search_index
from careframe.plans.adapters import PREDICTIONS_AS_OF, facilities, patients, predictions, sql, table
from careframe.plans.cases_places import _places, _policies
from careframe.session import work_folder

# From a few hits to all patients, one and two letters, other case, and none.
NEEDLES = ("er#00000012", "R#0000001", "oMER#00", "#", "07", "9", "customer", "no such name", "713")


def _indexed_search(s, f):
    root = work_folder(s, "search")
    bucketed.create(patients(s, f).drop("id"), f"{root}/table", "patient_id", 16)
    search_index.build(s, f"{root}/table", f"{root}/index", "patient_id", lk.SEARCHED)
    found = [search_index.search_indexed(s, f"{root}/table", f"{root}/index", text, "patient_id", lk.SEARCHED).select(
        F.lit(text).alias("needle"), "patient_id") for text in NEEDLES]
    return reduce(DataFrame.unionAll, found)


SEARCH_SQL = f"""
select needle, patient_id from patients, (values {', '.join(f"('{n}')" for n in NEEDLES)}) as v(needle)
where contains(lower(patient_id), lower(needle)) or contains(lower(first_name), lower(needle))
   or contains(lower(last_name), lower(needle)) or contains(lower(phone), lower(needle))"""


def _consent_history(s, f):
    """A change of consent per order: granted, withdrawn or renewed at its date, one in four for 200 days."""
    o = F.col("o_orderkey")
    return table(s, f, "orders").select(
        o.alias("id"), F.col("o_custkey").alias("patient_key"), F.when(o % 7 == 0, "research").otherwise("care").alias("consent_type"),
        (o % 3 != 0).alias("granted"), F.col("o_orderdate").alias("changed_at"),
        F.when(o % 4 == 0, F.col("o_orderdate") + F.expr("interval 200 days")).alias("expires_at"))


CONSENT_SQL = """with history as (
  select o_orderkey as id, o_custkey as patient_key, o_orderkey % 3 <> 0 as granted, o_orderdate as changed_at,
    case when o_orderkey % 4 = 0 then o_orderdate + interval 200 day end as expires_at from orders where o_orderkey % 7 <> 0),
judged as (
  select p.id, p.patient_key, p.created_at, h.granted, h.expires_at from predictions p join history h on h.patient_key = p.patient_key and h.changed_at <= p.created_at
  qualify row_number() over (partition by p.id order by h.changed_at desc, h.id desc) = 1)
select id, patient_key from judged where granted and (expires_at is null or expires_at > created_at)"""

def _retained_table(s, f):
    """All orders, a kind by key: most of them under retention first, the others added late, retention again half a year later."""
    o, name = F.col("o_orderkey"), f"retained_{uuid.uuid4().hex}"
    rows = table(s, f, "orders").select(
        o.alias("id"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.concat(F.lit("kind "), (o % 6).cast("string")).alias("data_type"))
    late = F.pmod(F.xxhash64("id"), F.lit(10)) == 0
    retention.create(rows.filter(~late), name, "data_type", "created_at")
    for as_of in RETAINED_AT:
        retention.enforce(s, name, _policies(s, f), "data_type", "created_at", ["priority", "price"], as_of, work_folder(s, "retention"))
        if as_of != RETAINED_AT[-1]:
            retention.append(rows.filter(late), name, "data_type", "created_at")
    return retention.read(s, name).withColumn("created_at", F.col("created_at").cast("string"))


RETAINED_AT = ("2001-01-15 00:00:00", "2001-07-20 00:00:00")
RETAINED_TABLE_SQL = f"""
with policies as (select concat('kind ', r_regionkey) as kind, (r_regionkey + 1) * 500 as keep,
    case when r_regionkey <> 2 then r_regionkey * 300 end as hide from region where r_regionkey <> 4),
rows as (select o_orderkey as id, o_orderpriority as priority, o_totalprice as price, cast(o_orderdate as timestamp) as created_at,
    concat('kind ', o_orderkey % 6) as data_type from orders),
judged as (select rows.*, timestamp '{RETAINED_AT[-1]}' - to_days(cast(keep as integer)) as kept_from,
    coalesce(created_at < timestamp '{RETAINED_AT[-1]}' - to_days(cast(hide as integer)), false) as old
  from rows left join policies on kind = data_type)
select id, case when old then sha256(priority) else priority end as priority, case when not old then price end as price, data_type,
  cast(created_at as varchar) as created_at
from judged where kept_from is null or created_at >= kept_from"""

# Corners around a facility, in hundredths of a degree: the outline, a hole, and a second part that only some have.
OUTLINE = ((-80, -40), (80, -40), (95, 5), (60, 55), (-70, 50))
HOLE = ((-20, -10), (25, -15), (10, 20))
PART = ((100, -100), (130, -100), (130, -60), (100, -60))


def _catchments(s, f):
    k = F.col("id")

    def ring(corners):
        points = [F.concat_ws(" ", *[((base + d) / 100).cast("decimal(10,2)").cast("string") for base, d in (
            (F.lit(3400) + (k % 7) * 90, x), (k * 40 - 500, y))]) for x, y in (*corners, corners[0])]
        return F.concat(F.lit("("), F.concat_ws(", ", *points), F.lit(")"))

    first = F.concat(F.lit("("), ring(OUTLINE), F.lit(", "), ring(HOLE), F.lit(")"))
    many = F.concat(F.lit("MULTIPOLYGON ("), first, F.lit(", ("), ring(PART), F.lit("))"))
    areas = facilities(s, f).select("id", F.when(k % 5 == 4, None).when(k % 2 == 0, many).otherwise(F.concat(F.lit("POLYGON "), first)).alias("catchment"))
    return catchments.catchment_population(_places(s, f), areas)


def _corner_rows():
    rows = []
    for ring, corners in enumerate((OUTLINE, HOLE, PART)):
        for a, b in zip(corners, (*corners[1:], corners[0])):
            low, high = sorted((a, b), key=lambda p: p[1])
            if low[1] != high[1]:
                rows.append(f"({ring}, {low[0]}, {low[1]}, {high[0]}, {high[1]})")
    return ", ".join(rows)


CATCHMENT_SQL = f"""
with places as (select -55e-1 + (c_custkey % 211) * 5e-2 as lat, 335e-1 + (c_custkey % 173) * 4e-2 as lng, c_custkey % 7 + 1 as population from customer),
spots as (select lat, lng, sum(population) as population from places group by 1, 2),
edges as (
  select id, (3400 + (id % 7) * 90 + ax)::double / 100 as x1, (id * 40 - 500 + ay)::double / 100 as y1,
    (3400 + (id % 7) * 90 + bx)::double / 100 as x2, (id * 40 - 500 + by_)::double / 100 as y2
  from facilities, (values {_corner_rows()}) as v(ring, ax, ay, bx, by_) where id % 5 <> 4 and (ring < 2 or id % 2 = 0)),
crossed as (
  select id, lat, lng, population from edges join spots on y1 <= lat and lat < y2 and lng < x1 + (lat - y1) / (y2 - y1) * (x2 - x1)
  group by all having count(*) % 2 = 1),
sums as (select id, sum(population) as population, count(*) as places from crossed group by id)
select f.id as area_id, cast(coalesce(population, 0) as bigint) as population, coalesce(places, 0) as places from facilities f left join sums using (id)"""



def _daily_state(s, f):
    """All predictions in three batches that share their days, the second appended twice with one journal."""
    root, made = work_folder(s, "daily-state"), predictions(s, f)
    state.create(s, f"{root}/state")
    for part in (0, 1, 1, 2):
        state.append(s, f"{root}/state", made.filter(F.col("id") % 3 == part), patients(s, f), f"{root}/journal/{part}")
    return state.read(s, f"{root}/state")


WINDOW = "created_at >= timestamp '2001-08-02 00:00:00' - interval 600 day"
SCREENINGS_SQL = f"""with recent as (select * from predictions where {WINDOW}),
sections as (
  select 'risk_level' as section, risk_level as label, risk_score from recent
  union all select 'day', cast(cast(created_at as date) as varchar), risk_score from recent
  union all select 'total_screenings', 'all', risk_score from recent)
select section, label, count(*) as n, round(avg(risk_score), 4) as avg_risk from sections group by 1, 2"""

# Few enough patients per place for the sketches to be exact.
PLACES_SQL = f"""
select county, sub_county, round(avg(risk_score), 4) as avg_risk, count(distinct q.id) as patients, count(*) as predictions,
  count(*) filter (where risk_level in ('high', 'very_high')) as high_risk,
  count(*) filter (where risk_level = 'moderate') as moderate_risk, count(*) filter (where risk_level = 'low') as low_risk
from predictions p join patients q on q.id = p.patient_key where p.{WINDOW} group by 1, 2"""


def _results(s, f):
    """Test results of a visit per order, as nested JSON text: an object, a list, no JSON, or nothing."""
    o = F.col("o_orderkey")
    tests = F.to_json(F.struct(F.struct(F.col("o_orderpriority").alias("result"), (o % 97).alias("titre")).alias("hiv"), F.lit("x").alias("note")))
    return table(s, f, "orders").select(o.alias("id"), F.when(o % 11 == 0, "{bad").when(o % 7 == 0, " ").when(o % 5 == 0, F.concat(
        F.lit('["HIV", "'), F.col("o_orderstatus"), F.lit('"]'))).otherwise(tests).alias("test_results"))


def _visit_results(s, f):
    good, bad = documents.split_documents(_results(s, f), "test_results")
    at = F.col("test_results")
    return good.select(
        "id", F.lit(False).alias("refused"), documents.value_at(at, "$.hiv.result").alias("result"), documents.value_at(at, "$.hiv.titre", "int").alias("titre"),
        documents.value_at(at, "$[1]").alias("second")).unionByName(bad.select("id", F.lit(True).alias("refused")), allowMissingColumns=True)


def _visit_fields(s, f):
    good, _ = documents.split_documents(_results(s, f), "test_results")
    return documents.fields_of(good, "test_results", "id").filter("name is not null or position is not null").groupBy("name", "position").agg(
        F.count("*").alias("n"), F.count(documents.value_at(F.col("value"), "$.titre", "int")).alias("titres"))


RESULTS_SQL = """
select o_orderkey as id, o_orderkey % 11 = 0 as refused, case when kind = 1 then o_orderpriority end as result,
  case when kind = 1 then cast(o_orderkey % 97 as integer) end as titre, case when kind = 2 then o_orderstatus end as second
from (select *, case when o_orderkey % 11 = 0 or o_orderkey % 7 = 0 then 0 when o_orderkey % 5 = 0 then 2 else 1 end as kind from orders)"""

FIELDS_SQL = """with kinds as (select case when o_orderkey % 11 = 0 or o_orderkey % 7 = 0 then 0 when o_orderkey % 5 = 0 then 2 else 1 end as kind from orders)
select name, cast(position as integer) as position, count(*) as n, count(*) filter (where name = 'hiv') as titres
from kinds join (values (1, 'hiv', 0), (1, 'note', 1), (2, null, 0), (2, null, 1)) as v(k, name, position) on k = kind group by 1, 2"""


def _round(df):
    return df.withColumn("avg_risk", F.round("avg_risk", 4))




def _daily_state(s, f):
    """All predictions in three batches that share their days, the second appended twice with one journal."""
    root, made = work_folder(s, "daily-state"), predictions(s, f)
    state.create(s, f"{root}/state")
    for part in (0, 1, 1, 2):
        state.append(s, f"{root}/state", made.filter(F.col("id") % 3 == part), patients(s, f), f"{root}/journal/{part}")
    return state.read(s, f"{root}/state")


WINDOW = "created_at >= timestamp '2001-08-02 00:00:00' - interval 600 day"
SCREENINGS_SQL = f"""with recent as (select * from predictions where {WINDOW}),
sections as (
  select 'risk_level' as section, risk_level as label, risk_score from recent
  union all select 'day', cast(cast(created_at as date) as varchar), risk_score from recent
  union all select 'total_screenings', 'all', risk_score from recent)
select section, label, count(*) as n, round(avg(risk_score), 4) as avg_risk from sections group by 1, 2"""

# Few enough patients per place for the sketches to be exact.
PLACES_SQL = f"""
select county, sub_county, round(avg(risk_score), 4) as avg_risk, count(distinct q.id) as patients, count(*) as predictions,
  count(*) filter (where risk_level in ('high', 'very_high')) as high_risk,
  count(*) filter (where risk_level = 'moderate') as moderate_risk, count(*) filter (where risk_level = 'low') as low_risk
from predictions p join patients q on q.id = p.patient_key where p.{WINDOW} group by 1, 2"""


def _results(s, f):
    """Test results of a visit per order, as nested JSON text: an object, a list, no JSON, or nothing."""
    o = F.col("o_orderkey")
    tests = F.to_json(F.struct(F.struct(F.col("o_orderpriority").alias("result"), (o % 97).alias("titre")).alias("hiv"), F.lit("x").alias("note")))
    return table(s, f, "orders").select(o.alias("id"), F.when(o % 11 == 0, "{bad").when(o % 7 == 0, " ").when(o % 5 == 0, F.concat(
        F.lit('["HIV", "'), F.col("o_orderstatus"), F.lit('"]'))).otherwise(tests).alias("test_results"))


def _visit_results(s, f):
    good, bad = documents.split_documents(_results(s, f), "test_results")
    at = F.col("test_results")
    return good.select(
        "id", F.lit(False).alias("refused"), documents.value_at(at, "$.hiv.result").alias("result"), documents.value_at(at, "$.hiv.titre", "int").alias("titre"),
        documents.value_at(at, "$[1]").alias("second")).unionByName(bad.select("id", F.lit(True).alias("refused")), allowMissingColumns=True)


def _visit_fields(s, f):
    good, _ = documents.split_documents(_results(s, f), "test_results")
    return documents.fields_of(good, "test_results", "id").filter("name is not null or position is not null").groupBy("name", "position").agg(
        F.count("*").alias("n"), F.count(documents.value_at(F.col("value"), "$.titre", "int")).alias("titres"))


RESULTS_SQL = """
select o_orderkey as id, o_orderkey % 11 = 0 as refused, case when kind = 1 then o_orderpriority end as result,
  case when kind = 1 then cast(o_orderkey % 97 as integer) end as titre, case when kind = 2 then o_orderstatus end as second
from (select *, case when o_orderkey % 11 = 0 or o_orderkey % 7 = 0 then 0 when o_orderkey % 5 = 0 then 2 else 1 end as kind from orders)"""

FIELDS_SQL = """with kinds as (select case when o_orderkey % 11 = 0 or o_orderkey % 7 = 0 then 0 when o_orderkey % 5 = 0 then 2 else 1 end as kind from orders)
select name, cast(position as integer) as position, count(*) as n, count(*) filter (where name = 'hiv') as titres
from kinds join (values (1, 'hiv', 0), (1, 'note', 1), (2, null, 0), (2, null, 1)) as v(k, name, position) on k = kind group by 1, 2"""


def _round(df):
    return df.withColumn("avg_risk", F.round("avg_risk", 4))


CASES = {
    "retained_table": (_retained_table, RETAINED_TABLE_SQL),
    "visit_results": (_visit_results, RESULTS_SQL),
    "visit_result_fields": (_visit_fields, FIELDS_SQL),
    "kept_screenings": (
        lambda s, f: _round(state.screenings(_daily_state(s, f), PREDICTIONS_AS_OF, 600)), sql("predictions", SCREENINGS_SQL)),
    "kept_places": (
        lambda s, f: _round(state.places(_daily_state(s, f), PREDICTIONS_AS_OF, 600)), sql("predictions patients", PLACES_SQL)),
    "kept_screenings": (
        lambda s, f: _round(state.screenings(_daily_state(s, f), PREDICTIONS_AS_OF, 600)), sql("predictions", SCREENINGS_SQL)),
    "kept_places": (
        lambda s, f: _round(state.places(_daily_state(s, f), PREDICTIONS_AS_OF, 600)), sql("predictions patients", PLACES_SQL)),
    "indexed_search": (_indexed_search, sql("patients", SEARCH_SQL)),
    "consented_then": (
        lambda s, f: gov.consented_then(predictions(s, f), _consent_history(s, f), "care").select("id", "patient_key"),
        sql("predictions", CONSENT_SQL)),
    "catchment_population": (_catchments, sql("facilities", CATCHMENT_SQL)),
}
