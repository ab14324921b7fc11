"""Dashboards from the daily state against the same computed afresh."""

import os
import random

import pytest
from pyspark.sql import functions as F

from careframe.operators import daily_state as state, dashboards, geo


def people(spark, n):
    return spark.createDataFrame([(i, f"C{i % 3}", ["x", "", None][i % 3 if i % 2 else 0], True, "1990-01-01", "F") for i in range(n)],
                                 "id long, county string, sub_county string, is_active boolean, date_of_birth string, gender string").withColumn(
        "date_of_birth", F.col("date_of_birth").cast("date"))


def scores(spark, rng, ids, n, days):
    rows = [(rng.choice(ids), rng.choice([None, 0.25, 0.5, 0.75]), rng.choice(["low", "moderate", "high", "very_high", "odd"]),
             rng.choice(days) * 3600 * 7) for _ in range(n)]
    return spark.createDataFrame(rows, "patient_key long, risk_score double, risk_level string, s int").select(
        "patient_key", "risk_score", "risk_level", F.expr("timestamp'2024-01-01' + make_dt_interval(0, 0, 0, s)").alias("created_at"))


@pytest.mark.parametrize("seed", [1, 2])
def test_any_sequence_of_appends_equals_a_dashboard_computed_afresh(spark, tmp_path, seed):
    rng, patients, root = random.Random(seed), people(spark, 30), str(tmp_path / "state")
    state.create(spark, root)
    assert state.screenings(state.read(spark, root), "2024-01-20", 30).count() == 5  # zeros only
    made = None
    for i, days in enumerate(([1, 2, 3], [3, 9, 20], [2, 140], [90])):
        batch = scores(spark, rng, [0, 0, 0, *range(40)], 60, days)  # some patients are unknown
        state.append(spark, root, batch, patients, f"{tmp_path}/j{i}")
        made = batch if made is None else made.unionAll(batch)
    kept = state.read(spark, root)
    known = made.join(patients.select(F.col("id").alias("patient_key")), "patient_key", "left_semi")
    for days, county in ((30, None), (12, None), (30, "c1")):
        fresh = dashboards.dashboard_table(patients, known, "2024-01-20", days, county).filter("section not in ('gender', 'age', 'total_patients')")
        assert sorted(map(str, state.screenings(kept, "2024-01-20", days, county).collect())) == sorted(map(str, fresh.collect()))
        got = state.places(kept, "2024-01-20", days, ("county",)).select("county", "patients", F.round("avg_risk", 9), "high_risk", "moderate_risk", "low_risk")
        summary = geo.county_summary(patients, known, "2024-01-20", days).select(
            "county", "total_patients", F.round("avg_risk", 9), "high_risk", "moderate_risk", "low_risk")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, summary.collect()))


def test_a_batch_run_again_counts_once_and_other_months_stay(spark, tmp_path):
    patients, root, rng = people(spark, 9), str(tmp_path / "state"), random.Random(5)
    state.create(spark, root)
    state.append(spark, root, scores(spark, rng, range(9), 40, [1, 120]), patients, f"{tmp_path}/a")
    before = {d: n for d, n in month_files(root).items()}
    batch = scores(spark, rng, range(9), 20, [120])
    for _ in range(2):
        state.append(spark, root, batch, patients, f"{tmp_path}/b")
    assert state.read(spark, root).agg(F.sum("n")).first()[0] == 60
    after = month_files(root)
    assert [d for d in after if after[d] != before.get(d)] == ["month=2024-02-01"]
    with pytest.raises(ValueError, match="midnight"):
        state.window(state.read(spark, root), "2024-01-20 01:00:00", 3)


def month_files(root):

    return {d: sorted(n for n in os.listdir(f"{root}/{d}") if n.endswith(".parquet")) for d in os.listdir(root) if d.startswith("month=")}


def test_distinct_patients_of_a_window_are_within_the_error(spark, tmp_path):
    n, root = 60_000, str(tmp_path / "state")
    patients = spark.range(n).select("id", F.lit("C").alias("county"), F.lit("s").alias("sub_county"))
    made = spark.range(3 * n).select((F.col("id") % n).alias("patient_key"), F.lit(0.5).alias("risk_score"), F.lit("high").alias("risk_level"),
                                     F.date_add(F.lit("2024-01-01"), (F.col("id") % 7).cast("int")).cast("timestamp").alias("created_at"))
    state.create(spark, root)
    state.append(spark, root, made, patients, f"{tmp_path}/j")
    row = state.places(state.read(spark, root), "2024-01-20", 30).first()
    assert row["predictions"] == 3 * n and abs(row["patients"] - n) < 0.025 * n
