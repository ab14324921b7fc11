"""Upserts of a bucketed table against upserts of a plain one."""

import pytest
from pyspark.sql import functions as F

from careframe.operators import bucketed
from careframe.operators.tables import upsert
from tests.test_streams import table_files

COLUMNS = ["first_name", "county"]


@pytest.fixture
def table(spark):
    rows = [(f"P{i}", f"n{i}", "A") for i in range(40)]
    return spark.createDataFrame(rows, "patient_id string, first_name string, county string").select(
        "*", *[F.lit("2020-01-01").cast("timestamp").alias(c) for c in ("created_at", "updated_at")])


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), "patient_id string, first_name string, county string, row long")


def merge(spark, root, rows, journal, as_of="2024-01-01"):
    bucketed.upsert_buckets(spark, root, rows, "patient_id", "row", COLUMNS, as_of, journal)


def as_text(df):
    return sorted(map(str, df.collect()))


def test_equals_a_plain_upsert_and_leaves_other_buckets(spark, table, tmp_path):
    root = str(tmp_path / "table")
    bucketed.create(table, root, "patient_id", 16)
    before = table_files(root)
    rows = batch(spark, ("P1", "first", "B", 1), ("P1", "last", "B", 2), ("New", "x", "C", 3), (None, "no key", "C", 4))
    merge(spark, root, rows, str(tmp_path / "j1"))
    assert as_text(bucketed.read(spark, root)) == as_text(upsert(table, rows, "patient_id", "row", COLUMNS, "2024-01-01"))
    after = table_files(root)
    touched = {r[0] for r in rows.filter("patient_id is not null").select(F.concat(F.lit("bucket_of_16="), bucketed.bucket("patient_id", 16))).collect()}
    assert {d for d in after if after[d] != before.get(d)} == touched and set(before) <= set(after)


def test_a_batch_run_again_changes_nothing(spark, table, tmp_path):
    root, journal = str(tmp_path / "table"), str(tmp_path / "j")
    bucketed.create(table, root, "patient_id", 4)
    rows = batch(spark, ("P1", "a", "B", 1), ("New", "x", "C", 3))
    merge(spark, root, rows, journal)
    once, files = as_text(bucketed.read(spark, root)), table_files(root)
    merge(spark, root, rows, journal)
    assert as_text(bucketed.read(spark, root)) == once and table_files(root) == files


def test_buckets_lost_while_they_were_replaced_come_back_from_the_journal(spark, table, tmp_path):
    root, journal, name = str(tmp_path / "table"), str(tmp_path / "j"), "bucket_of_4"
    bucketed.create(table, root, "patient_id", 4)
    rows = batch(spark, *[(f"P{i}", "new", "B", i) for i in range(0, 40, 3)])
    merged = upsert(table, rows, "patient_id", "row", COLUMNS, "2024-01-01")
    # The journal was complete when the job died between deleting a bucket and putting the new one in its place.
    merged.withColumn(name, bucketed.bucket("patient_id", 4)).write.partitionBy(name).parquet(f"{journal}/rows")
    spark.range(1).select(F.lit(True).alias("done")).write.parquet(f"{journal}/complete")
    for file in (tmp_path / "table" / sorted(table_files(root))[0]).iterdir():
        file.unlink()
    merge(spark, root, rows, journal)
    assert as_text(bucketed.read(spark, root)) == as_text(merged)


def test_empty_batches_and_reads_by_key(spark, table, tmp_path):
    root = str(tmp_path / "table")
    bucketed.create(table, root, "patient_id", 16)
    files = table_files(root)
    merge(spark, root, batch(spark, ("x", "", "", 1)).limit(0), str(tmp_path / "j"))
    assert table_files(root) == files
    found = bucketed.having_keys(spark, root, spark.createDataFrame([("P3",), ("P7",), ("none",), ("P3",)], "key string"), "patient_id")
    assert sorted(r["patient_id"] for r in found.collect()) == ["P3", "P7"]
    assert "PartitionFilters: [bucket_of_16" in found._jdf.queryExecution().toString()
