"""Retention by partition against the row-wise rule, run after run."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from careframe.operators import governance, retention
from careframe.session import work_folder

SCHEMA = "id int, kind string, at timestamp, phone string, born date, note string"
POLICIES = [("a", 400, 100, True), ("b'\\ /=", 200, None, True), ("c", 90, 300, True), ("d", 1, 1, False), ("f", 365, 0, True)]


def made(spark, n, seed, first=0):
    rng, start = random.Random(seed), datetime(2023, 9, 1)
    rows = [(first + i, rng.choice(["a", "a", "a", "b'\\ /=", "c", "d", "e", "f", None]),
             rng.choice([None, *[start + timedelta(hours=rng.randrange(24 * 270)) for _ in range(12)]]),
             rng.choice(["0700", "0711", "", None]), rng.choice([None, datetime(1990, 1, 1).date()]), "n") for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def policies(spark):
    return spark.createDataFrame(POLICIES, "data_type string, retention_days int, anonymize_after_days int, is_active boolean")


@pytest.fixture
def name(spark):
    table = f"kept_{random.randrange(1 << 60)}"
    yield table
    spark.sql(f"drop table if exists {table}")


def by_rows(df, policies, as_of):
    """The same rule, kind by kind, over all rows."""
    kinds = ["a", "b'\\ /=", "c", "d", "e", "f"]
    parts = [governance.enforce_retention(df.filter(F.col("kind") == k), policies, k, "at", ["phone", "born"], as_of) for k in kinds]
    return sorted(map(str, [tuple(r) for part in parts for r in part.collect()] + [tuple(r) for r in df.filter("kind is null").collect()]))


def content(spark, name):
    return sorted(str(tuple(r)) for r in retention.read(spark, name).select("id", "kind", "at", "phone", "born", "note").collect())


def files(spark, name):
    rows = spark.table(name).select("kind", "_hidden", "_month", F.input_file_name().alias("file")).distinct().collect()
    return {(r["kind"], r["_hidden"], r["_month"]): r["file"] for r in rows}


def test_runs_and_late_rows_equal_the_rule_over_all_rows(spark, policies, name):
    first, late = made(spark, 400, 1), made(spark, 100, 2, 1000)
    retention.create(first, name, "kind", "at")
    for as_of in ("2024-03-05 10:00:00", "2024-03-05 10:00:00", "2024-07-01 00:00:00"):
        before = files(spark, name)
        done = retention.enforce(spark, name, policies, "kind", "at", ["phone", "born"], as_of, work_folder(spark, "journal"))
        assert content(spark, name) == by_rows(first, policies, as_of)
        after, moved = files(spark, name), {(k, m) for k, _, m in done["rewritten"]}
        assert all(after[part] == file for part, file in before.items() if part in after and (part[0], part[2]) not in moved)
        assert not set(done["dropped"]) & set(after)
    retention.append(late, name, "kind", "at")
    retention.enforce(spark, name, policies, "kind", "at", ["phone", "born"], "2024-07-02 00:00:00", work_folder(spark, "journal"))
    assert content(spark, name) == by_rows(first.unionAll(late), policies, "2024-07-02 00:00:00")


@pytest.mark.parametrize("dies_at", ["complete", "insert", "drop", "finished"])
def test_a_run_that_dies_is_started_again(spark, policies, name, monkeypatch, dies_at):
    rows, journal = made(spark, 200, 3), work_folder(spark, "journal")
    retention.create(rows, name, "kind", "at")
    run = lambda: retention.enforce(spark, name, policies, "kind", "at", ["phone", "born"], "2024-05-20", journal)
    real_mark = retention.mark

    def dying_mark(session, place):
        if place.endswith(dies_at):
            raise RuntimeError("lost")
        real_mark(session, place)

    def dying(*args, **kwargs):
        raise RuntimeError("lost")

    real_sql, dropped = type(spark).sql, []

    def dying_sql(session, text, *args, **kwargs):
        if text.startswith("alter"):
            dropped.append(text)
            if len(dropped) == 2:
                raise RuntimeError("lost")
        return real_sql(session, text, *args, **kwargs)

    monkeypatch.setattr(retention, "DROPPED_TOGETHER", 3)
    with monkeypatch.context() as patch:
        if dies_at == "insert":
            patch.setattr("pyspark.sql.DataFrameWriter.insertInto", dying)
        elif dies_at == "drop":
            patch.setattr(type(spark), "sql", dying_sql)
        else:
            patch.setattr(retention, "mark", dying_mark)
        with pytest.raises(RuntimeError, match="lost"):
            run()
    run()
    assert content(spark, name) == by_rows(rows, policies, "2024-05-20")
    assert run() == {"dropped": [], "rewritten": []}
    assert content(spark, name) == by_rows(rows, policies, "2024-05-20")


def test_empty_table_and_two_policies_of_a_kind(spark, policies, name):
    retention.create(made(spark, 5, 1).limit(0), name, "kind", "at")
    retention.enforce(spark, name, policies, "kind", "at", ["phone"], "2024-05-20", work_folder(spark, "journal"))
    assert content(spark, name) == []
    with pytest.raises(ValueError, match="more than one"):
        retention.enforce(spark, name, policies.unionAll(policies), "kind", "at", ["phone"], "2024-05-20", work_folder(spark, "journal"))
    with pytest.raises(ValueError, match="own"):
        retention.append(made(spark, 1, 1).withColumn("_month", F.lit("x")), name, "kind", "at")
