"""Empty windows, null groups and keys, unreadable values, and places on either side of the date line."""

import pytest
from pyspark.sql import functions as F

from careframe.operators import dashboards, geo, lookups, tables as tb
from careframe.operators.validate import validate
from careframe.sources import fhir

AUDIT = "id long, user_name string, action string, resource_type string, created_at timestamp"


def test_audit_summary_of_an_empty_window_has_its_total(spark):
    empty = spark.createDataFrame([], AUDIT)
    assert [tuple(r) for r in dashboards.audit_summary(empty, "2031-01-01").collect()] == [("total", "all", 0)]


def test_audit_summary_keeps_null_groups_null(spark):
    log = spark.sql("select 1L id, string(null) user_name, 'view' action, string(null) resource_type, timestamp'2030-12-31' created_at")
    got = {(r["section"], r["label"]): r["n"] for r in dashboards.audit_summary(log, "2031-01-01").collect()}
    assert got == {("total", "all"): 1, ("action", "view"): 1, ("resource", None): 1, ("user", None): 1}


def test_dashboard_table_of_nothing_has_zeros(spark):
    patients = spark.createDataFrame([], "id long, gender string, date_of_birth date, county string, is_active boolean")
    predictions = spark.createDataFrame(
        [], "id long, patient_key long, clinician_id long, risk_score double, risk_level string, created_at timestamp")
    got = {(r["section"], r["label"]): (r["n"], r["avg_risk"]) for r in dashboards.dashboard_table(patients, predictions, "2031-01-01").collect()}
    assert got.pop(("total_patients", "all")) == (0, None)
    assert got.pop(("total_screenings", "all"))[0] == 0
    assert len(got) == 4 and all(section == "risk_level" and n == 0 for (section, _), (n, _) in got.items())


def test_upsert_takes_no_row_without_a_key(spark):
    current = spark.createDataFrame([("P1", "a")], "patient_id string, phone string")
    incoming = spark.createDataFrame([(None, "x", 1), ("P1", "b", 2), ("P2", "c", 3)], "patient_id string, phone string, seq long")
    got = tb.upsert(current, incoming, "patient_id", "seq", ["phone"], "2024-01-01").collect()
    assert sorted(map(tuple, got)) == [("P1", "b"), ("P2", "c")]


def test_one_unreadable_patch_is_refused_alone(rows):
    patches = rows("id long, seq long, fields map<string,string>",
                   (1, 1, {"number_of_partners_12m": "abc"}), (2, 1, {"number_of_partners_12m": "3"}))
    usable, refused = tb.accepted_patches(patches)
    assert [r["id"] for r in usable.collect()] == [2] and [r["id"] for r in refused.collect()] == [1]
    people = rows("id long, number_of_partners_12m int", (1, 7), (2, 8))
    assert sorted(map(tuple, tb.patch(people, patches, "id").collect())) == [(1, 7), (2, 3)]


def test_coverage_goes_on_beyond_the_date_line(spark):
    facilities = spark.createDataFrame([(1, 0.0, 179.95, 50.0)], "id long, latitude double, longitude double, service_radius_km double")
    places = spark.createDataFrame([(0.0, -179.95, 5), (0.0, 179.9, 2), (0.0, 178.0, 1)], "latitude double, longitude double, population long")
    assert geo.facility_coverage(places, facilities).first()["population"] == 7


def test_lines_that_are_no_json_are_returned(spark, tmp_path):
    path = tmp_path / "p.ndjson"
    path.write_text('{"resourceType": "Patient", "id": "a"}\nnot json\n\n')
    assert [r["line"] for r in fhir.rejected_lines(spark, str(path)).collect()] == ["not json"]
    assert fhir.read_fhir_patients(spark, str(path)).count() == 1


def test_nan_is_null_in_validation(spark):
    row = validate(spark.createDataFrame([(float("nan"), "M", 1.0)], "age double, gender string, num_partners_12m double")).first()
    assert row["errors"] == ["Missing required field: age"]


@pytest.mark.parametrize("kind", ["double", "string", "timestamp"])
def test_a_deep_page_is_the_page(spark, kind):
    value = F.when(F.col("id") % 5 < 3, F.pmod(F.col("id") * 37, F.lit(50)))
    df = spark.range(100).withColumn("at", value.cast("int").cast(kind) if kind == "string" else value.cast("long").cast(kind))
    for offset in (10, 58, 70):
        want = lookups.page(df, "at", 5, offset).collect()
        assert len(want) == 5 and lookups.page(df, "at", 5, offset, direct=0).collect() == want
    assert lookups.newest(df, "at").count() == 100


def test_a_deep_page_over_nan_equals_the_shallow_one(rows):
    nan, inf = float("nan"), float("inf")
    data = [(i, [float(i % 7), nan, inf, -inf, None][0 if i % 10 < 6 else i % 10 - 5]) for i in range(100)]
    for kind in ("double", "float"):
        df = rows(f"id long, x {kind}", *data)
        for offset in (0, 5, 12, 20, 35, 50, 85, 95, 120):
            shallow, deep = (lookups.page(df, "x", 7, offset, direct=d).collect() for d in (1000, 1))
            assert [r["id"] for r in shallow] == [r["id"] for r in deep], (kind, offset)
