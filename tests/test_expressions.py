"""Column expressions against hand-worked values."""

import datetime as dt

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from careframe.functions import bins, predicates as p, requests as rq, scalars as sc
from careframe.operators import scoring
from tests.conftest import as_set


def test_age_counts_completed_years(rows):
    df = rows("dob string, day string",
              ("2000-02-29", "2023-02-28"), ("2000-02-29", "2023-03-01"),
              ("1990-12-31", "2024-12-31"), ("1990-12-31", "2024-12-30"))
    got = [r[0] for r in df.select(sc.age_years(F.to_date("dob"), F.to_date("day"))).collect()]
    assert got == [22, 23, 34, 33]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.dates(dt.date(1920, 1, 1), dt.date(2020, 1, 1)),
                          st.dates(dt.date(2020, 1, 2), dt.date(2030, 1, 1))), min_size=50, max_size=60))
def test_age_equals_calendar_arithmetic(spark, pairs):
    df = spark.createDataFrame(pairs, "born date, today date")
    got = [r[0] for r in df.select(sc.age_years(F.col("born"), F.col("today"))).collect()]
    assert got == [t.year - b.year - ((t.month, t.day) < (b.month, b.day)) for b, t in pairs]


AGES = [0, 14, 15, 19, 20, 24, 25, 29, 30, 34, 35, 39, 40, 49, 50, 100, 101, None]


def test_bands_are_left_closed_and_codes_right_closed(spark):
    df = spark.createDataFrame([(a,) for a in AGES], "age int")
    got = df.select(sc.age_band(F.col("age")), bins.age_code(F.col("age"))).collect()
    assert [r[0] for r in got] == ["<15", "<15", "15-19", "15-19", "20-24", "20-24", "25-29", "25-29", "30-34", "30-34",
                                   "35-39", "35-39", "40-49", "40-49", "50+", "50+", "50+", None]
    assert [r[1] for r in got] == [None, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6, 7, None, None]


def test_level_bounds(spark):
    scores = [0.0, 0.2499999, 0.25, 0.4999, 0.5, 0.75, 1.0, None]
    df = spark.createDataFrame([(s,) for s in scores], "s double")
    assert [r[0] for r in df.select(sc.risk_level(F.col("s"))).collect()] == [
        "low", "low", "moderate", "moderate", "high", "very_high", "very_high", None]


def test_interval_stays_inside_unit_range(spark):
    df = spark.createDataFrame([(0.05,), (0.1,), (0.95,), (0.5,), (None,)], "s double")
    low, high = sc.interval(F.col("s"), 0.1)
    assert [tuple(r) for r in df.select(low, high).collect()] == [
        (0.0, 0.15), (0.0, 0.2), (0.85, 1.0), (0.4, 0.6), (None, None)]
    low, high = sc.interval(F.col("s"), 0.15)
    assert [tuple(r) for r in df.filter("s in (0.1, 0.9)").select(low, high).collect()] == [(0.0, 0.25)]


def test_clamp_keeps_null(spark):
    df = spark.createDataFrame([(-1.0,), (0.3,), (7.0,), (None,)], "x double")
    assert [r[0] for r in df.select(sc.clamp(F.col("x"))).collect()] == [0.0, 0.3, 1.0, None]
    assert [r[0] for r in df.select(sc.clamp(F.col("x"), low=None)).collect()] == [-1.0, 0.3, 1.0, None]


PATHS = [
    ("GET", "/api/predictions/predict", "predict", "Prediction"), ("POST", "/login", "login", "Unknown"),
    ("POST", "/logout", "logout", "Unknown"), ("GET", "/api/patients/export", "export", "Patient"),
    ("POST", "/api/reporting/reports", "export", "Report"), ("GET", "/login/predict", "predict", "Unknown"),
    ("POST", "/api/patients/", "create", "Patient"), ("PUT", "/api/patients/1", "update", "Patient"),
    ("PATCH", "/api/clinicians/1", "update", "Clinician"), ("DELETE", "/x", "delete", "Unknown"),
    ("GET", "/api/clinicians/", "read", "Clinician"), ("OPTIONS", "/api/ml/models", "read", "Unknown"),
]


def test_request_classes(spark):
    df = spark.createDataFrame([x[:2] for x in PATHS], "m string, p string")
    got = df.select(rq.audit_action(F.col("m"), F.col("p")), rq.audit_resource(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [x[2:] for x in PATHS]


def test_client_address(spark):
    df = spark.createDataFrame([("", "1.1.1.1"), (None, "1.1.1.1"), (" 2.2.2.2 , 3.3.3.3", "1.1.1.1"), ("4.4.4.4", "1")],
                               "x string, r string")
    assert [r[0] for r in df.select(rq.client_ip(F.col("x"), F.col("r"))).collect()] == [
        "1.1.1.1", "1.1.1.1", "2.2.2.2", "4.4.4.4"]


def test_skipped_paths_and_user_names(spark):
    df = spark.createDataFrame([("/static/a",), ("/media/b",), ("/admin/jsi18n/",), ("/admin/",), ("/x/static/",)], "p string")
    assert [r[0] for r in df.select(rq.is_audited(F.col("p"))).collect()] == [False, False, False, True, True]
    who = spark.createDataFrame([(1, "Ann Lee", "al"), (1, " ", "al"), (1, None, "al"), (None, "Ann", "al")],
                                "u long, f string, n string")
    assert [r[0] for r in who.select(rq.audit_user(F.col("u"), F.col("f"), F.col("n"))).collect()] == [
        "Ann Lee", "al", "al", "Anonymous"]


def test_optional_filters(rows):
    df = rows("id int, county string, on boolean", (1, "Nairobi", True), (2, "nairobi", False), (3, "", True))
    assert p.optional_eq(df, "county", "").count() == 3
    assert p.optional_eq(df, "id", 0).count() == 3
    assert p.optional_eq(df, "id", None).count() == 3
    assert p.optional_eq(df, "county", "NAIROBI", ci=True).count() == 2
    assert p.optional_eq(df, "county", "Nairobi").count() == 1
    assert p.optional_flag(df, "on", None).count() == 3
    assert p.optional_flag(df, "on", False).count() == 1


def test_search_takes_text_literally(rows):
    df = rows("a string, b string", ("50%", "x"), ("500", "Y_1"), (None, "50% OFF"))
    assert p.search(df, "50%", ["a", "b"]).count() == 2
    assert p.search(df, "_", ["a", "b"]).count() == 1
    assert p.search(df, "y_1", ["a", "b"]).count() == 1
    assert p.search(df, "", ["a", "b"]).count() == 3


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date"])
def test_lookback_is_closed_below_and_open_above(spark, kind):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-02",), ("2030-01-01",)], "t string")
    df = df.select(F.col("t").cast(kind).alias("t"))
    assert p.lookback(df, "t", "2024-01-12", 10).count() == 2
    assert p.lookback(df, "t", dt.datetime(2024, 1, 12, 0, 0, 1), 10).count() == (2 if kind == "date" else 1)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_lookback_reaches_the_file_scan(spark, tmp_path, kind):
    path = str(tmp_path / "t")
    spark.range(10).select(F.lit("2024-01-01 00:00:00").cast(kind).alias("t")).write.parquet(path)
    plan = p.lookback(spark.read.parquet(path), "t", "2024-01-12", 10)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(t," in plan


HEURISTIC = ("gender string, number_of_partners_12m int, prior_sti_history boolean, substance_use boolean, "
             "symptoms_present boolean, hiv_status string, condom_use_frequency double")


@pytest.mark.parametrize("person, expected", [
    (("F", 0, False, False, False, "negative", 1.0), 0.0),
    (("F", 5, False, False, False, "negative", 1.0), 0.25),
    (("F", 6, False, False, False, "negative", 1.0), 0.3),
    (("F", 20, False, False, False, "negative", 1.0), 0.3),
    (("F", 0, False, False, False, "unknown", 1.0), 0.05),
    (("F", 0, False, False, False, "negative", 0.0), 0.2),
    (("M", 0, False, False, False, "negative", 1.0), 0.05),
    (("M", 20, True, True, True, "positive", 0.0), 1.0),
])
def test_heuristic_score(spark, person, expected):
    got = spark.createDataFrame([person], HEURISTIC).select(scoring.heuristic_score()).first()[0]
    assert got == pytest.approx(expected, abs=1e-12)


def test_heuristic_score_adds_in_order(spark):
    """Same double as adding the terms left to right."""
    people = [("M" if g else "F", n, a, b, c, h, w) for g in (0, 1) for n in range(0, 9, 2) for a in (True, False)
              for b in (True, False) for c in (True, False) for h in ("positive", "unknown", "negative")
              for w in (0.0, 0.25, 0.5, 0.75, 1.0)]
    got = [r[0] for r in spark.createDataFrame(people, HEURISTIC).select(scoring.heuristic_score()).collect()]
    for (g, n, a, b, c, h, w), value in zip(people, got):
        total = min(n * 0.05, 0.3)
        for term in (0.15 * a, 0.1 * b, 0.1 * c, 0.15 * (h == "positive"), 0.05 * (h == "unknown"), (1 - w) * 0.2,
                     0.05 * (g == "M")):
            total += term
        assert value == min(1.0, total)


def test_top_factors(spark):
    names = ["a", "b", "c", "d", "e", "f"]
    df = spark.createDataFrame([([0.1, -0.9, 0.30001, 0.3, 0.3, 0.1],)], "w array<double>")
    got = [tuple(s) for s in df.select(scoring.top_factors(names, F.col("w"))).first()[0]]
    # 0.30001 rounds to 0.3, so the three equal ones keep feature order.
    assert got == [("b", 0.9), ("c", 0.3), ("d", 0.3), ("e", 0.3), ("a", 0.1)]
    few = spark.createDataFrame([([0.1, 0.2],)], "w array<double>").select(scoring.top_factors(["a", "b"], F.col("w")))
    assert [s[0] for s in few.first()[0]] == ["b", "a"]


def test_recommendations_by_level(spark):
    df = spark.createDataFrame([("low",), ("moderate",), ("high",), ("very_high",)], "l string")
    got = df.select(F.size(scoring.model_tests(F.col("l"))), scoring.model_actions(F.col("l"))).collect()
    assert [r[0] for r in got] == [2, 4, 6, 6]
    assert got[2][1] == got[3][1] and got[0][1].startswith("Continue") and got[1][1].startswith("Routine")
    scores = spark.createDataFrame([(0.3,), (0.3001,)], "s double")
    assert [len(r[0]) for r in scores.select(scoring.heuristic_tests(F.col("s"))).collect()] == [2, 4]


def test_equal_width_edges():
    assert bins.equal_width_edges(0, 10, 4) == pytest.approx([-0.01, 2.5, 5, 7.5, 10])
    assert bins.equal_width_edges(5, 5, 2) == pytest.approx([4.995, 5, 5.005])
    assert bins.equal_width_edges(0, 0, 1) == pytest.approx([-0.001, 0.001])
    with pytest.raises(ValueError):
        bins.equal_width_edges(0, float("inf"), 3)


def test_cut_equals_pandas(spark):
    import pandas as pd

    for values, count in [([0, 1, 2, 3, 10], 4), ([5, 5], 2), ([-3.5, 0.001, 0.0012, 8.25], 7), ([1e-7, 2e-7], 3)]:
        series = pd.Series([float(v) for v in values])
        expected = [str(v) for v in pd.cut(series, bins=count)]
        edges = bins.equal_width_edges(float(min(values)), float(max(values)), count)
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        assert [r[0] for r in df.select(bins.cut(F.col("x"), edges)).collect()] == expected
    assert bins.interval_labels([0, 15, 20]) == ["(0, 15]", "(15, 20]"]


def test_interval_labels_equal_pandas():
    import random

    import pandas as pd

    draw = random.Random(7)
    for _ in range(400):
        scale = 10.0 ** draw.randint(-9, 9)
        edges = sorted({draw.uniform(-scale, scale) * draw.choice([1, 1e-4]) for _ in range(draw.randint(2, 9))} | {0.0})
        if draw.random() < 0.3:
            edges.append(float("inf"))
        assert bins.interval_labels(edges) == [str(x) for x in pd.cut(pd.Series([0.0]), edges).cat.categories]


def test_json_columns(spark):
    df = spark.createDataFrame([('{"a": 1, "b": "x"}', '["p", "q"]')], "m string, l string")
    row = df.select(sc.text_map(F.col("m")).alias("m"), sc.text_list(F.col("l")).alias("l")).first()
    assert row["m"] == {"a": "1", "b": "x"} and row["l"] == ["p", "q"]
    assert as_set(df.select(F.to_json(sc.text_list(F.col("l"))))) == {('["p","q"]',)}
