"""Streams against the batch jobs they mirror."""

import datetime as dt
import os

from pyspark.sql import functions as F

from careframe.operators import bucketed
from careframe.operators.audit import audit_from_requests
from careframe.plans import adapters
from careframe.plans.cases_places import CASES
from careframe.plans.ingest import merge_checked
from careframe.sources import patient_csv as pc
from careframe.streaming import audit_stream as au, landing
from tests.test_files import HEADER, patients_now

FOLDER = "/root/testdata/sf0.001"


def request_files(spark, tmp_path, parts=5):
    """The request log as files, each covering a later span of time."""
    log = adapters.requests(spark, FOLDER)
    path = str(tmp_path / "requests")
    log.repartitionByRange(parts, "ts").sortWithinPartitions("ts").write.parquet(path)
    # Files are streamed by age, so make their ages follow their spans.
    for place, name in enumerate(sorted(n for n in os.listdir(path) if n.startswith("part-"))):
        os.utime(f"{path}/{name}", (1_700_000_000 + place, 1_700_000_000 + place))
    stream = (spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path))
    return log, stream


def test_audit_stream_equals_batch(spark, tmp_path):
    log, stream = request_files(spark, tmp_path)
    for _ in range(2):  # the second run finds nothing new
        au.append_audit(au.audit_stream(stream), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("created_date")
    batch = audit_from_requests(log.withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect()))


def test_daily_actions_equal_batch_for_closed_days(spark, tmp_path):
    log, stream = request_files(spark, tmp_path)
    out = str(tmp_path / "days")
    (au.daily_actions(au.audit_stream(stream), "30 days").writeStream.format("parquet").outputMode("append")
     .option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True)
     .start().awaitTermination())
    assert spark.read.parquet(out).count() == 0  # no day is past such a watermark
    out = str(tmp_path / "days2")
    (au.daily_actions(au.audit_stream(stream), "1 day").writeStream.format("parquet").outputMode("append")
     .option("path", out).option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True)
     .start().awaitTermination())
    got = {(r["day"], r["action"]): r["n"] for r in spark.read.parquet(out).collect()}
    batch = audit_from_requests(log).groupBy(F.to_date("created_at").alias("day"), "action").agg(F.count("*").alias("n"))
    last = batch.agg(F.max("day")).first()[0]
    closed = {(r["day"], r["action"]): r["n"] for r in batch.collect() if r["day"] <= last - dt.timedelta(days=2)}
    assert len(closed) > 100 and {k: v for k, v in got.items() if k[0] <= last - dt.timedelta(days=2)} == closed


def test_daily_action_stream_has_every_day(spark):
    got = {(r["day"], r["action"]): r["n"] for r in CASES["daily_action_stream"][0](spark, FOLDER).collect()}
    batch = audit_from_requests(adapters.requests(spark, FOLDER)).groupBy(F.to_date("created_at").cast("string").alias("day"), "action").agg(
        F.count("*").alias("n"))
    assert got == {(r["day"], r["action"]): r["n"] for r in batch.collect()}


def table_files(root):
    """Data files by bucket."""
    return {d: sorted(n for n in os.listdir(f"{root}/{d}") if n.endswith(".parquet")) for d in os.listdir(root) if d.startswith("bucket_of_")}


def test_landing_folder_equals_batch_upserts(spark, tmp_path):
    root, stats, folder = str(tmp_path / "table"), str(tmp_path / "stats"), tmp_path / "in"
    folder.mkdir()
    start = patients_now(spark)
    bucketed.create(start, root, "patient_id", 8)
    names = HEADER.split(",")
    files = [["P1,One,b,2000-01-01,M,,,,", "P2,Two,b,2000-01-01,F,,,,", "P5,x,b,bad,F,,,,"],
             ["P1,Later,b,2000-01-01,M,,,,", "P3,Three,b,2000-01-01,F,,,,"]]
    expected = start
    for i, lines in enumerate(files):
        path = folder / f"{i}.csv"
        path.write_text("\n".join([HEADER, *lines]) + "\n")
        landing.start_landing(spark, str(folder), names, root, stats, str(tmp_path / "ck"), "2024-01-01").awaitTermination()
        expected = merge_checked(expected, pc.check_rows(pc.read_patient_csv(spark, str(path))), "2024-01-01")
    got = bucketed.read(spark, root)
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
    jobs = spark.read.parquet(f"{stats}/jobs")
    assert sorted((r["total"], r["failed"], r["status"]) for r in jobs.collect()) == [(2, 0, "completed"), (3, 1, "partial")]
    # Nothing new has landed: no file is written.
    files = table_files(root)
    landing.start_landing(spark, str(folder), names, root, stats, str(tmp_path / "ck"), "2024-01-01").awaitTermination()
    assert table_files(root) == files


def test_files_of_one_batch_apply_in_order(spark, tmp_path):
    root, folder = str(tmp_path / "table"), tmp_path / "in"
    folder.mkdir()
    bucketed.create(patients_now(spark), root, "patient_id", 8)
    for name, who, age in (("b.csv", "Older", 100), ("a.csv", "Newer", 10)):
        path = folder / name
        path.write_text(f"{HEADER}\nP1,{who},b,2000-01-01,M,,,,\n")
        os.utime(path, (1_700_000_000 - age, 1_700_000_000 - age))
    landing.start_landing(spark, str(folder), HEADER.split(","), root, str(tmp_path / "stats"), str(tmp_path / "ck"),
                          "2024-01-01").awaitTermination()
    assert bucketed.read(spark, root).filter("patient_id = 'P1'").first()["first_name"] == "Newer"


def test_landing_takes_each_file_by_its_header_and_refuses_other_encodings(spark, tmp_path):
    root, stats, folder = str(tmp_path / "table"), str(tmp_path / "stats"), tmp_path / "in"
    folder.mkdir()
    bucketed.create(patients_now(spark), root, "patient_id", 8)
    (folder / "a.csv").write_text('first_name,patient_id\n"Two\nlines",P7\n')
    (folder / "b.csv").write_text("patient_id,first_name\nP8,Eight\n")
    (folder / "c.csv").write_bytes("patient_id,first_name\nP1,Jos\xe9\n".encode("latin-1"))
    landing.start_landing(spark, str(folder), None, root, stats, str(tmp_path / "ck"), "2024-01-01").awaitTermination()
    got = {r["patient_id"]: r["first_name"] for r in bucketed.read(spark, root).collect()}
    assert got == {"P1": "Old", "P9": "Other", "P7": "Two\nlines", "P8": "Eight"}
    jobs = {r["source_file"][-5:]: (r["total"], r["status"]) for r in spark.read.parquet(f"{stats}/jobs").collect()}
    assert jobs == {"a.csv": (1, "completed"), "b.csv": (1, "completed"), "c.csv": (0, "failed")}


def test_an_end_mark_closes_the_days_before_it_and_only_those(spark, tmp_path):
    rows = str(tmp_path / "rows")
    spark.createDataFrame([("2024-01-01 10:00:00", "read"), ("2024-01-01 23:59:59", "read"), ("2024-01-02 01:00:00", "create"),
                           ("2024-01-03 05:00:00", "read")], "created_at string, action string").select(
        F.col("created_at").cast("timestamp"), "action").write.parquet(rows)
    audit = spark.readStream.schema("created_at timestamp, action string").parquet(rows)
    days = au.daily_actions(audit, "2 hours", au.open_marks(spark, str(tmp_path / "marks")))

    def written():
        days.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        got = spark.read.schema(days.schema).parquet(str(tmp_path / "out")).collect()
        return sorted((str(r["day"]), r["action"], r["n"]) for r in got)

    closed = [("2024-01-01", "read", 2), ("2024-01-02", "create", 1)]
    assert written() == closed  # the last row closes the days before its own
    au.mark_end(spark, str(tmp_path / "marks"), "2024-01-04 01:59:59")
    assert written() == closed  # within the lateness of the third day
    au.mark_end(spark, str(tmp_path / "marks"), "2024-01-04 02:00:00")
    assert written() == [*closed, ("2024-01-03", "read", 1)]
    assert written() == [*closed, ("2024-01-03", "read", 1)]
