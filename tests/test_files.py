"""Patient files, FHIR resources, stored tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from careframe import schemas
from careframe.operators import tables as tb
from careframe.plans.ingest import ingest_file
from careframe.sources import fhir, patient_csv as pc, stored

HEADER = "patient_id,first_name,last_name,date_of_birth,gender,phone,email,county,sub_county"


def write(tmp_path, text, name="in.csv", binary=None):
    path = tmp_path / name
    path.write_bytes(binary if binary is not None else text.encode())
    return str(path)


def checked(spark, path, **options):
    rows = pc.read_patient_csv(spark, path, **options)
    return pc.split_rows(pc.check_rows(pc.number_rows(rows)))


def test_good_rows(spark, tmp_path):
    path = write(tmp_path, "\n".join([
        HEADER,
        "P1,Ann,Lee,1990-05-01,female,07,a@x.org,Nairobi,West",
        "P2,,Roe,1990-5-1,,,,,",
        "",
        'P3,"A, ""q""",B,19900501,male,,,,',
        "P4,a,b,2004-W53-7,M,,,,,extra,fields",
        '"P5",a,b,2004W011,x,"","",,',
        'P6,a,b,1990-01-01,M,,,,,',
    ]) + "\n")
    valid, rejected = checked(spark, path)
    got = {r["patient_id"]: r for r in valid.collect()}
    assert rejected.count() == 0
    assert [got[f"P{i}"]["row_no"] for i in range(1, 7)] == [1, 2, 3, 4, 5, 6]
    assert got["P1"]["gender"] == "F" and got["P1"]["county"] == "Nairobi"
    assert got["P2"]["first_name"] == "" and got["P2"]["gender"] == "" and got["P2"]["date_of_birth"] == dt.date(1990, 5, 1)
    assert got["P3"]["first_name"] == 'A, "q"' and got["P3"]["date_of_birth"] == dt.date(1990, 5, 1)
    assert got["P4"]["date_of_birth"] == dt.date.fromisoformat("2004-W53-7")
    assert got["P5"]["date_of_birth"] == dt.date.fromisoformat("2004W011") and got["P5"]["gender"] == "X"
    assert got["P6"]["sub_county"] == ""


def test_bad_rows(spark, tmp_path):
    path = write(tmp_path, "\n".join([
        HEADER,
        "P1,a,b,,M,,,,",
        "P2,a,b,2000-13-01,M,,,,",
        "P3,a,b,2000-01,M,,,,",
        "P4,a,b,2000-01-01,M",
        'P5,"x,y",b,2000-01-01,M,,',
        "P6,a,b,2001-W53-1,M,,,,",
        "P7,a,b, 2000-01-01,M,,,,",
        "P8,a,b,0000-01-01,M,,,,",
        "P9,a,b,2000-01-01,M,,,,",
    ]) + "\n")
    valid, rejected = checked(spark, path)
    assert [r["patient_id"] for r in valid.collect()] == ["P9"]
    errors = {r["patient_id"]: r["errors"] for r in rejected.collect()}
    assert set(errors) == {f"P{i}" for i in range(1, 9)}
    assert errors["P4"] == [f"missing value for {c}" for c in ("phone", "email", "county", "sub_county")]
    assert errors["P5"] == ["missing value for county", "missing value for sub_county"]
    assert errors["P3"] == ["invalid date_of_birth: 2000-01"]


def test_absent_columns_get_defaults(spark, tmp_path):
    valid, _ = checked(spark, write(tmp_path, "first_name,zone\nAnn,1\nBob,2\n"))
    got = [r.asDict() for r in valid.orderBy("row_no").collect()]
    assert [g["patient_id"] for g in got] == ["AUTO_1", "AUTO_2"]
    assert got[0]["date_of_birth"] == dt.date(2000, 1, 1) and got[0]["gender"] == "U" and got[0]["phone"] == ""


def test_quoted_line_breaks(spark, tmp_path):
    path = write(tmp_path, HEADER + '\nP1,"two\nlines",b,2000-01-01,M,,,,\nP2,a,b,2000-01-01,M,,,,\n')
    valid, _ = checked(spark, path, multi_line=True)
    assert [(r["patient_id"], r["row_no"], r["first_name"]) for r in valid.orderBy("row_no").collect()] == [
        ("P1", 1, "two\nlines"), ("P2", 2, "a")]


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder, "\ufeffpatient_id,first_name,last_name\nA1,Ann,Bee\nA2,short\n", "a.csv")
    write(folder, 'last_name,first_name,zone,patient_id\nBee,"An\nn",z,B1\n', "b.csv")
    write(folder, "\nfirst_name\nAuto\nNext\n", "c.csv")
    checked = pc.check_rows(pc.read_patient_csv(spark, str(folder)))
    valid, rejected = pc.split_rows(checked)
    assert sorted((r["patient_id"], r["first_name"], r["last_name"], r["gender"]) for r in valid.collect()) == [
        ("A1", "Ann", "Bee", "U"), ("AUTO_1", "Auto", "", "U"), ("AUTO_2", "Next", "", "U"), ("B1", "An\nn", "Bee", "U")]
    assert [(r["patient_id"], r["errors"]) for r in rejected.collect()] == [("A2", ["missing value for last_name"])]
    stats = {r["source_file"][-5:]: (r["total"], r["processed"], r["failed"], r["error_log"], r["status"])
             for r in pc.file_stats(checked).collect()}
    assert stats == {"a.csv": (2, 1, 1, "Row 2: missing value for last_name", "partial"),
                     "b.csv": (1, 1, 0, "", "completed"), "c.csv": (2, 2, 0, "", "completed")}


def test_errors_are_logged_per_file(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("a.csv", "b.csv"):
        write(folder, "\n".join([HEADER] + [f"P{i},a,b,bad,M,,,," for i in range(80)]), name)
    for row in pc.file_stats(pc.check_rows(pc.read_patient_csv(spark, str(folder)))).collect():
        lines = row["error_log"].split("\n")
        assert row["failed"] == 80 and len(lines) == 50 and lines[0].startswith("Row 1: ") and lines[-1].startswith("Row 50: ")


def test_byte_order_mark_is_skipped(spark, tmp_path):
    path = write(tmp_path, "", binary=b"\xef\xbb\xbf" + (HEADER + "\nP1,a,b,2000-01-01,M,,,,\n").encode())
    assert [r["patient_id"] for r in checked(spark, path)[0].collect()] == ["P1"]


def test_row_numbers_run_through_all_splits(spark, tmp_path):
    lines = [HEADER] + [f"P{i},a,b,2000-01-01,M,{'x' * (i % 50)},,," for i in range(1, 5001)]
    path = write(tmp_path, "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        raw = pc.read_patient_csv(spark, path, multi_line=False)
        assert raw.rdd.getNumPartitions() > 4
        rows = pc.number_rows(raw).select("patient_id", "row_no").collect()
        few = pc.number_rows(raw.filter("patient_id in ('P1', 'P4711')"), raw).select("patient_id", "row_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128MB")
    assert {r["patient_id"]: r["row_no"] for r in rows} == {f"P{i}": i for i in range(1, 5001)}
    assert {r["patient_id"]: r["row_no"] for r in few} == {"P1": 1, "P4711": 4711}


def patients_now(spark):
    base = spark.createDataFrame([(1, "P1", "Old", True), (2, "P9", "Other", False)],
                                 "id long, patient_id string, first_name string, is_active boolean")
    moment = F.lit("2020-01-01 00:00:00").cast("timestamp")
    fill = {"date_of_birth": F.lit("1980-01-01").cast("date"), "created_at": moment, "updated_at": moment,
            "hiv_status": F.lit("negative"), "number_of_partners_12m": F.lit(4)}
    return base.withColumns({f.name: fill.get(f.name, F.lit(None)).cast(f.dataType)
                             for f in schemas.PATIENT.fields if f.name not in base.columns})


def test_ingest_upserts_and_reports(spark, tmp_path):
    path = write(tmp_path, "\n".join([
        HEADER, "P1,First,b,2000-01-01,M,,,,", "P2,New,b,2000-01-01,F,,,,", "P3,a,b,nope,F,,,,",
        "P1,Last,b,2001-01-01,f,,,,"]) + "\n")
    table, stats = ingest_file(spark, path, patients_now(spark), "2024-06-01", staging=str(tmp_path / "staged"))
    got = {r["patient_id"]: r for r in table.collect()}
    assert set(got) == {"P1", "P2", "P9"}
    assert got["P1"]["first_name"] == "Last" and got["P1"]["gender"] == "F" and got["P1"]["hiv_status"] == "negative"
    assert got["P1"]["number_of_partners_12m"] == 4
    assert got["P1"]["created_at"] == dt.datetime(2020, 1, 1) and got["P1"]["updated_at"] == dt.datetime(2024, 6, 1)
    assert got["P2"]["hiv_status"] == "unknown" and got["P2"]["is_active"] and got["P2"]["marital_status"] == "single"
    assert got["P2"]["created_at"] == got["P2"]["updated_at"] == dt.datetime(2024, 6, 1)
    assert got["P9"]["first_name"] == "Other" and got["P9"]["updated_at"] == dt.datetime(2020, 1, 1)
    assert stats.first().asDict() == {
        "total": 4, "processed": 3, "failed": 1, "status": "partial", "error_log": "Row 3: invalid date_of_birth: nope"}
    # A second run changes nothing but the time of update.
    again, _ = ingest_file(spark, path, table, "2024-07-01")
    drop = ["updated_at"]
    assert sorted(map(str, again.drop(*drop).collect())) == sorted(map(str, table.drop(*drop).collect()))


def test_stats_without_errors_and_with_many(spark, tmp_path):
    good = pc.check_rows(pc.read_patient_csv(spark, write(tmp_path, HEADER + "\nP1,a,b,2000-01-01,M,,,,\n")))
    assert pc.ingest_stats(good).first()["status"] == "completed"
    lines = [HEADER] + [f"P{i},a,b,bad,M,,,," for i in range(80)]
    many = pc.ingest_stats(pc.check_rows(pc.read_patient_csv(spark, write(tmp_path, "\n".join(lines), "b.csv")))).first()
    assert many["failed"] == 80 and many["error_log"].count("\n") == 49
    assert many["error_log"].startswith("Row 1: ") and "Row 50: " in many["error_log"]


def test_unreadable_files_fail_as_a_whole(spark, tmp_path):
    now = patients_now(spark)
    table, stats = ingest_file(spark, str(tmp_path / "none.csv"), now, "2024-06-01")
    assert table is now and stats.first()["status"] == "failed"
    path = write(tmp_path, "", "latin.csv", binary=(HEADER + "\nP1,Jos\xe9,b,2000-01-01,M,,,,\n").encode("latin-1"))
    assert ingest_file(spark, path, now, "2024-06-01")[1].first()["status"] == "failed"


def test_fhir_patients(spark, tmp_path):
    people = [
        {"resourceType": "Patient", "id": "f1", "gender": "female", "birthDate": "1990-05-01", "active": False,
         "name": [{"use": "official", "family": "Lee", "given": ["Ann", "B."]}],
         "telecom": [{"system": "email", "value": "a@x.org"}, {"system": "phone", "value": "07"}],
         "address": [{"state": "Nairobi", "district": "West"}]},
        {"resourceType": "Patient", "id": "f2", "birthDate": "1990"},
        {"resourceType": "Observation", "id": "o1"},
    ]
    path = write(tmp_path, "\n".join(json.dumps(p) for p in people), "p.ndjson")
    got = {r["patient_id"]: r for r in fhir.read_fhir_patients(spark, path).collect()}
    assert set(got) == {"f1", "f2"}
    assert tuple(got["f1"]) == ("f1", "Ann B.", "Lee", dt.date(1990, 5, 1), "F", "07", "a@x.org", "Nairobi", "West", False)
    assert tuple(got["f2"]) == ("f2", "", "", None, "U", "", "", "", "", True)


def test_reports_are_written_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([("a, b", 1), ('say "x"', 2)], "county string, n long")
    stored.write_report(df, str(tmp_path / "c"), "csv")
    stored.write_report(df, str(tmp_path / "j"), "json")
    back = spark.read.option("header", True).option("escape", '"').schema("county string, n long").csv(str(tmp_path / "c"))
    assert sorted(back.collect()) == sorted(df.collect())
    assert sorted(spark.read.schema("county string, n long").json(str(tmp_path / "j")).collect()) == sorted(df.collect())
    with pytest.raises(ValueError):
        stored.write_report(df, str(tmp_path / "x"), "pdf")


def test_jdbc_reads_are_split():
    options = stored.jdbc_options("jdbc:x", "patients", "id", 1, 1000, 16, user="u")
    assert options["numPartitions"] == "16" and options["partitionColumn"] == "id" and options["user"] == "u"


def test_predictions_append_by_date(spark, tmp_path):
    path = str(tmp_path / "predictions")
    df = spark.createDataFrame([(1, "2024-01-01 05:00:00"), (2, "2024-01-02 23:00:00")], "id long, t string")
    df = df.select("id", F.col("t").cast("timestamp").alias("created_at"))
    tb.append_rows(df, path)
    tb.append_rows(df.withColumn("id", F.col("id") + 10), path)
    assert spark.read.parquet(path).count() == 4
    recent = tb.recent_partitions(spark, path, "2024-01-12", 10)
    assert sorted(r["id"] for r in recent.collect()) == [2, 12]
    assert "PartitionFilters: [isnotnull(created_date" in recent._jdf.queryExecution().executedPlan().toString()


def test_layouts_cover_all_tables_and_choices(spark):
    assert len(schemas.TABLES) == 19
    df = spark.createDataFrame([("M", "single", "positive"), ("Z", "single", "maybe")],
                               "gender string, marital_status string, hiv_status string")
    assert [r[0] for r in df.select(schemas.choice_errors("patient")).collect()] == [[], ["gender", "hiv_status"]]
