"""Batch table maintenance and lookups."""

import datetime as dt

from pyspark.sql import functions as F

from careframe.operators import dashboards as d, geo, governance as gov, lookups as lk, tables as tb
from tests.conftest import as_set

PERSON = "id long, patient_id string, phone string, condom_use_frequency double, is_active boolean, updated_at string"


def people(rows):
    df = rows(PERSON, (1, "P1", "a", 0.5, True, "2020-01-01"), (2, "P2", "b", 0.0, True, "2020-01-01"),
              (3, "P3", "c", 1.0, False, "2020-01-01"))
    return df.withColumn("updated_at", F.col("updated_at").cast("timestamp"))


def test_patch_changes_supplied_fields_only(rows):
    patches = rows("id long, seq long, fields map<string,string>",
                   (1, 1, {"phone": "x", "is_active": "false"}), (1, 2, {"phone": "y"}), (2, 1, {"phone": None}),
                   (3, 1, {"county": "ignored"}), (9, 1, {"phone": "nobody"}))
    got = {r["id"]: r for r in tb.patch(people(rows), patches, "id", "2024-01-01").collect()}
    assert (got[1]["phone"], got[1]["is_active"], got[1]["condom_use_frequency"]) == ("y", False, 0.5)
    assert got[2]["phone"] is None and got[3]["phone"] == "c" and len(got) == 3
    usable, refused = tb.accepted_patches(patches)
    assert usable.count() == 4 and [r["id"] for r in refused.collect()] == [2]


def test_patch_twice_is_patch_once(rows):
    patches = rows("id long, seq long, fields map<string,string>", (1, 1, {"condom_use_frequency": "0.25"}))
    once = tb.patch(people(rows), patches, "id", "2024-01-01")
    assert once.collect() == tb.patch(once, patches, "id", "2024-01-01").collect()
    assert {r["id"]: r["condom_use_frequency"] for r in once.collect()} == {1: 0.25, 2: 0.0, 3: 1.0}


def test_both_ways_of_upserting_agree(spark, rows):
    incoming = rows("patient_id string, seq long, phone string", ("P1", 1, "x"), ("P1", 2, "y"), ("N1", 3, "z"), ("P3", 4, None))
    made = []
    for limit in ("10MB", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        made.append(as_set(tb.upsert(people(rows), incoming, "patient_id", "seq", ["phone"], "2024-01-01")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    assert made[0] == made[1] and len(made[0]) == 4
    got = {r[1]: r for r in made[0]}
    assert got["P1"][2] == "y" and got["P2"][2] == "b" and got["P3"][2] is None
    assert (got["N1"][0], got["N1"][2], got["N1"][4], got["N1"][5].year) == (None, "z", True, 2024)


def test_deactivate(rows):
    gone = rows("patient_id string", ("P1",), ("P1",), ("P7",))
    got = {r["patient_id"]: (r["is_active"], r["updated_at"].year) for r in
           tb.deactivate(people(rows), gone, "patient_id", "2024-01-01").collect()}
    assert got == {"P1": (False, 2024), "P2": (True, 2020), "P3": (False, 2020)}


def test_feedback(rows):
    made = rows("id long, validated_by_clinician boolean, clinician_notes string, actual_outcome string",
                (1, False, "", ""), (2, False, "old", "negative"), (3, True, "kept", "positive"))
    feedback = rows("id long, seq long, notes string, actual_outcome string",
                    (1, 1, "n1", "positive"), (1, 2, "", ""), (2, 1, None, None))
    got = {r["id"]: tuple(r)[1:] for r in tb.apply_feedback(made, feedback).collect()}
    assert got == {1: (True, "", "positive"), 2: (True, "", "negative"), 3: (True, "kept", "positive")}


def test_promotion(rows):
    models = rows("id long, name string, status string, is_default boolean",
                  (1, "a", "deployed", True), (2, "a", "ready", False), (3, "a", "ready", False),
                  (4, "a", "deployed", True), (5, "b", "deployed", True), (6, "b", "training", False),
                  (7, "c", "ready", True), (8, "a", "ready", False))
    targets = rows("id long, seq long", (2, 1), (3, 2), (6, 3), (7, 4), (99, 5), (2, 6))
    table, refused = tb.promote(models, targets)
    got = {r["id"]: (r["status"], r["is_default"]) for r in table.collect()}
    assert got == {
        1: ("deprecated", False), 2: ("deprecated", False), 3: ("deployed", True), 4: ("deprecated", False),
        5: ("deployed", True), 6: ("training", False), 7: ("deployed", True), 8: ("ready", False)}
    assert as_set(refused.select("id", "seq")) == {(6, 3), (99, 5), (2, 6)}


def test_registration(rows):
    current = rows("patient_id string", ("P1",))
    incoming = rows("row_no long, patient_id string, first_name string, last_name string, date_of_birth string, "
                    "gender string, condom_use_frequency double, number_of_partners_12m int",
                    (1, "P1", "a", "b", "2000-01-01", "M", None, None), (2, "N1", "a", "b", "2000-01-01", "F", 1.0, 3),
                    (3, "N1", "a", "b", "2000-01-01", "F", 0.5, 3), (4, "N2", "a", "b", "2000-01-01", "m", 0.5, 1),
                    (5, "N3", "a", "b", "2000-01-01", "U", 1.01, 1), (6, "N4", "a", "b", None, "U", 0.0, 1),
                    (7, "N5", "a", "b", "2000-01-01", "O", None, -1), (8, "N6", "", "", "2000-01-01", "O", None, None))
    accepted, rejected = tb.append_validated(current, incoming, "row_no")
    got = {r["patient_id"]: r for r in accepted.collect()}
    assert set(got) == {"N1", "N6"} and got["N1"]["condom_use_frequency"] == 1.0
    assert got["N6"]["condom_use_frequency"] == 0.0 and got["N6"]["hiv_status"] == "unknown" and got["N6"]["is_active"]
    assert {r["row_no"]: r["errors"] for r in rejected.collect()} == {
        1: ["patient_id already exists"], 3: ["patient_id repeated in batch"], 4: ["gender must be one of M, F, O, U"],
        5: ["condom_use_frequency out of range"], 6: ["missing date_of_birth"],
        7: ["number_of_partners_12m cannot be negative"]}


def test_lookup(rows):
    found, missing = lk.lookup(people(rows), rows("patient_id string", ("P1",), ("P1",), ("P8",)), "patient_id")
    assert [r["patient_id"] for r in found.collect()] == ["P1"] and [r[0] for r in missing.collect()] == ["P8"]


def fanout(rows):
    patients = rows("id long, county string, sub_county string, is_active boolean, date_of_birth string, gender string",
                    (1, "A", "x", True, "1990-01-01", "M"), (2, "A", "x", True, "1990-01-01", "F"),
                    (3, "A", "y", True, "2010-01-01", "F"), (4, "B", "", False, "1990-01-01", "F"))
    patients = patients.withColumn("date_of_birth", F.col("date_of_birth").cast("date"))
    made = rows("id long, patient_key long, clinician_id long, risk_score double, risk_level string, t string",
                (1, 2, None, 0.2, "low", "2024-01-05"), (2, 3, 7, 0.8, "very_high", "2024-01-05"),
                (3, 3, 7, 0.6, "high", "2024-01-06"), (4, 3, 8, 0.4, "moderate", "2020-01-01"),
                (5, 4, 8, 0.5, "odd", "2024-01-07"))
    return patients, made.withColumn("created_at", F.col("t").cast("timestamp")).drop("t")


def test_breakdown_counts_join_rows(rows):
    patients, made = fanout(rows)
    got = d.county_breakdown(patients, made).collect()
    assert [(r["county"], r["patients"], round(r["avg_risk"], 6), r["high_risk"]) for r in got] == [("A", 5, 0.5, 2)]
    assert d.county_breakdown(patients, made, distinct_patients=True).first()["patients"] == 3
    alone = d.county_breakdown(patients, made.filter("id < 0")).first()
    assert (alone["patients"], alone["avg_risk"], alone["high_risk"]) == (3, None, 0)


def test_distribution_fills_zeros_and_keeps_unknown(rows):
    _, made = fanout(rows)
    assert as_set(d.risk_distribution(made)) == {("low", 1), ("moderate", 1), ("high", 1), ("very_high", 1), ("odd", 1)}
    assert as_set(d.risk_distribution(made.filter("id < 0"))) == {
        ("low", 0), ("moderate", 0), ("high", 0), ("very_high", 0)}


def test_stats_and_dashboard(rows):
    patients, made = fanout(rows)
    staff = rows("id long, facility_id long", (7, 1), (8, 2))
    stats = d.prediction_stats(made, patients, staff, "2024-01-10", 30).first()
    assert (stats["total_predictions"], stats["other_count"], stats["avg_risk_score"], stats["period"]) == (
        4, 1, 0.525, "Last 30 days")
    assert d.prediction_stats(made, patients, staff, "2024-01-10", 30, county="a", facility_id=1).first()[0] == 2
    empty = d.prediction_stats(made, patients, staff, "2034-01-10", 30, county="a").first()
    assert (empty["total_predictions"], empty["avg_risk_score"], empty["low_count"]) == (0, 0.0, 0)
    summary = d.dashboard(patients, made, "2024-01-10", 30, "a")["summary"].first()
    assert (summary["total_patients"], summary["total_screenings"], summary["high_risk_patients"]) == (3, 3, 2)
    parts = {(r["section"], r["label"]): r["n"] for r in d.dashboard_table(patients, made, "2024-01-10", 30).collect()}
    assert parts["total_patients", "all"] == 3 and parts["age", "<15"] == 1 and parts["risk_level", "odd"] == 1
    assert sum(n for (s, _), n in parts.items() if s == "day") == parts["total_screenings", "all"] == 4


def test_trend_keeps_the_earliest_days(rows):
    _, made = fanout(rows)
    got = d.daily_trend(made, "2024-01-10", 30, top=2).collect()
    assert [(str(r["date"]), r["count"]) for r in got] == [("2024-01-05", 2), ("2024-01-06", 1)]


def test_heatmap_and_county_summary(rows):
    patients, made = fanout(rows)
    points = {(r["county"], r["sub_county"]): r for r in
              geo.heatmap(made, patients.replace("B", "", "county"), "2024-01-10", 90).collect()}
    assert set(points) == {("A", "x"), ("A", "y"), ("Unknown", "")}
    assert points["A", "y"]["intensity"] == 0.7 and points["A", "y"]["patient_count"] == 1
    assert 0 <= points["A", "x"]["lat"] + 0.5 < 0.1 and 0 <= points["A", "x"]["lng"] - 37 < 0.1
    flat = geo.heatmap(made, patients, "2024-01-10", 90, with_jitter=False).first()
    assert (flat["lat"], flat["lng"]) == (-0.5, 37.0)
    summary = {r["county"]: tuple(r)[1:] for r in geo.county_summary(patients, made, "2024-01-10", 30).collect()}
    assert summary["A"][0] == 2 and summary["A"][2:] == (2, 0, 1) and summary["B"] == (1, 0.5, 0, 0, 0)


def test_known_county_coordinates(rows):
    df = rows("c string", ("Nairobi",), ("nairobi",), ("Nakuru",))
    assert as_set(df.select("c", geo.coordinate(F.col("c"), 0), geo.coordinate(F.col("c"), 1))) == {
        ("Nairobi", -1.2921, 36.8219), ("nairobi", -0.5, 37.0), ("Nakuru", -0.3031, 36.08)}


def test_facility_coverage_equals_brute_force(spark):
    import math
    import random

    random.seed(5)
    spots = [(random.uniform(-5, 5), random.uniform(33, 42), random.randrange(1, 9)) for _ in range(400)]
    spots += [(0.5, 36.5, 1)] * 300
    sites = [(i, random.uniform(-5, 5), random.uniform(33, 42), random.choice([5.0, 30.0, 120.0])) for i in range(25)]
    got = {r["facility_id"]: r["population"] for r in geo.facility_coverage(
        spark.createDataFrame(spots, "latitude double, longitude double, population long"),
        spark.createDataFrame(sites, "id long, latitude double, longitude double, service_radius_km double")).collect()}

    def km(a, b, c, d):
        h = (math.sin(math.radians(c - a) / 2) ** 2
             + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2)
        return 2 * 6371.0 * math.asin(math.sqrt(h))

    assert got == {i: sum(n for x, y, n in spots if km(a, b, x, y) <= r) for i, a, b, r in sites}


def test_retention(rows):
    df = rows("id long, phone string, age int, t string", (1, "07", 30, "2024-01-01"), (2, "08", 31, "2023-06-01"),
              (3, "09", 32, "2020-01-01")).withColumn("t", F.col("t").cast("timestamp"))
    policies = rows("data_type string, retention_days int, anonymize_after_days int, is_active boolean",
                    ("patient", 365, 100, True), ("audit", 10, None, True), ("off", 1, None, False))
    got = {r["id"]: (r["phone"], r["age"]) for r in gov.enforce_retention(
        df, policies, "patient", "t", ["phone", "age"], "2024-01-31").collect()}
    assert set(got) == {1, 2} and got[1] == ("07", 30) and len(got[2][0]) == 64 and got[2][1] is None
    assert gov.enforce_retention(df, policies, "off", "t", [], "2024-01-31").count() == 3
    assert gov.enforce_retention(df, policies, "audit", "t", [], "2024-01-31").count() == 0


def test_consent_gate(rows):
    consents = rows("patient_key long, consent_type string, granted boolean, e string",
                    (1, "research", True, None), (2, "research", True, "2024-01-01"), (3, "research", False, None),
                    (4, "screening", True, None), (5, "research", True, "2030-01-01"))
    consents = consents.withColumn("expires_at", F.col("e").cast("timestamp"))
    data = rows("patient_key long, n int", *[(k, n) for k in range(1, 7) for n in range(2)])
    kept = gov.consented(data, consents, "research", dt.datetime(2024, 1, 1))
    assert sorted(r["patient_key"] for r in kept.collect()) == [1, 1, 5, 5]


def test_history_keeps_twenty(rows):
    who = rows("id long, patient_id string, first_name string, last_name string", (1, "P1", "a", "b"))
    made = rows("id long, patient_key long, sti_type string, t int", *[(i, 1, "hiv", i // 2) for i in range(30)])
    got = lk.history(who, made.withColumnRenamed("t", "created_at"))
    assert sorted(r["id"] for r in got.collect()) == list(range(10, 30))
    assert got.first()["patient_name"] == "a b"


def test_facility_struct_is_null_when_absent(rows):
    staff = rows("id long, facility_id long, is_active boolean, role string", (1, 5, True, "nurse"), (2, None, True, "nurse"))
    places = rows("id long, name string", (5, "F5"))
    got = {r["id"]: r["facility"] for r in lk.list_clinicians(staff, places).collect()}
    assert got[2] is None and got[1]["name"] == "F5"


def test_rows_without_a_time_are_retained(rows):
    from careframe.operators.governance import enforce_retention

    table = rows("id long, at timestamp", (1, None), (2, dt.datetime(2000, 1, 1)))
    policies = rows("data_type string, is_active boolean, retention_days int, anonymize_after_days int", ("x", True, 30, None))
    kept = enforce_retention(table, policies, "x", "at", [], dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc))
    assert [r["id"] for r in kept.collect()] == [1]
