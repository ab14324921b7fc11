"""Files with quoted line breaks, read in many splits, against Spark's own reader of whole files."""

import csv
import io
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from careframe.sources import patient_csv as pc, record_splits
from careframe.sources.record_splits import _line_states, read_records

HEADER = "patient_id,first_name,last_name,date_of_birth,gender,phone,email,county,sub_county"


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def nasty(seed, n, end):
    """Rows whose fields hold breaks, quotes, commas and things that look like other rows."""
    rng = random.Random(seed)
    bits = ["a", "", "\n", '"', ",", "x\ny", "\n\n", '""', "é", "P9,q", "long " * 20, '",', "\r\n"]
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(HEADER.split(","))
    for i in range(n):
        writer.writerow([f"P{i}", *("".join(rng.choice(bits) for _ in range(rng.randrange(4))) for _ in range(rng.choice([3, 8, 8, 8, 10])))])
        if rng.random() < 0.1:
            out.write(end)
    return out.getvalue()


@pytest.mark.parametrize("seed,size,end", [(1, 300, "\n"), (2, 90, "\n"), (3, 500, "\r\n")])
def test_splits_equal_whole_files(spark, tmp_path, small_splits, seed, size, end):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(2):
        (folder / f"{k}.csv").write_bytes(nasty(10 * seed + k, 25, end).encode())
    small_splits(size)
    whole = pc.number_rows(pc.read_patient_csv(spark, str(folder), whole_files=True))
    cut = pc.number_rows(pc.read_patient_csv(spark, str(folder)))
    assert cut.select("split_start").distinct().count() > 5
    # In a file whose lines end in CR LF, Spark's parser turns those inside quotes into LF; here they stay.
    shown = [pc.ROW, "source_file", *[F.replace(c, F.lit("\r\n"), F.lit("\n")).alias(c) for c in HEADER.split(",")]]
    assert sorted(map(str, cut.select(shown).collect())) == sorted(map(str, whole.select(shown).collect()))


def test_a_field_longer_than_many_splits_and_a_quote_left_open(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('﻿patient_id,first_name\r\nP1,"' + "line, of \"\"text\"\"\n" * 60 + '"\nP2,b\n\n  \nP3,5" pipe\nP4,"open\nto the end')
    small_splits(100)
    rows = read_records(spark, str(tmp_path)).orderBy("split_start", "split_order").collect()
    assert [r["record"] for r in rows] == [
        'P1,"' + "line, of \"\"text\"\"\n" * 60 + '"', "P2,b", 'P3,5" pipe', 'P4,"open\nto the end']
    got = {r["patient_id"]: r["first_name"] for r in pc.read_patient_csv(spark, str(tmp_path)).collect()}
    assert got["P1"] == 'line, of "text"\n' * 60 and got["P2"] == "b" and got["P3"] == '5" pipe'


def test_one_task_per_split(spark, tmp_path, small_splits):
    path = tmp_path / "big.csv"
    path.write_text("patient_id,first_name\n" + "".join(f'P{i},"two\nlines {i}"\n' for i in range(20_000)))
    small_splits(64 << 10)
    rows = pc.read_patient_csv(spark, str(path))
    assert rows.groupBy(F.spark_partition_id()).count().count() > 6
    assert rows.filter(F.col("first_name") == F.concat(F.lit("two\nlines "), F.substring("patient_id", 2, 9))).count() == 20_000


def test_a_file_below_the_usual_split_size_is_read_by_several_tasks_in_one_pass(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text("patient_id,first_name\n" + "".join(f"P{i},name {i} {'x' * 200}\n" for i in range(100_000)))
    records = read_records(spark, str(path))
    assert records.rdd.getNumPartitions() == -(-path.stat().st_size // record_splits.SPLIT_BYTES) > 2
    assert records.count() == 100_000 and records.select("split_start", "split_order").distinct().count() == 100_000
    plan = records._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_plain_lines_become_records_as_line_by_line():
    lines = ["P1,a", "", "  ", "\t\r", "P2,b\r", "é", "\u3000\x1c", "P3\r\r", "P\r4"]
    want = [line.removesuffix("\r") for line in lines if line.strip()]
    assert record_splits._plain_records(pa.array(lines)).to_pylist() == want
    assert record_splits._plain_records(pa.array(["", " "])).to_pylist() == []


@pytest.mark.parametrize("line,out_in,in_in", [
    ("a,b", False, True), ("", False, True), ('a,"b', True, False), ('b"', False, False), ('b",c', False, False), ('b","c', True, True),
    ('"a""', True, False), ('"a"",', True, False), ('a"b', False, False), ('"",""', False, True), ('"a","b"\r', False, False), ('x"",y', False, True)])
def test_states_of_a_line(spark, line, out_in, in_in):
    states = spark.createDataFrame([(line,)], "value string").select(*_line_states(F.col("value"))).first()
    assert tuple(states) == (out_in, in_in)


def test_headers_of_other_case_and_too_many_headers(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("patient_id,First_Name,Zone\nP1,Ann,z\n")
    (tmp_path / "b.csv").write_text(" Patient_ID ,zone,first_name\nP2,y,Bob\n")
    rows = pc.read_patient_csv(spark, str(tmp_path))
    assert [c for c in rows.columns if c not in pc.PLACE] == ["patient_id", "zone", "first_name"]
    assert {(r["patient_id"], r["first_name"], r["zone"]) for r in rows.collect()} == {("P1", "Ann", "z"), ("P2", "Bob", "y")}
    monkeypatch.setattr(pc, "MAX_LAYOUTS", 1)
    with pytest.raises(ValueError, match="different headers"):
        pc.read_patient_csv(spark, str(tmp_path))
