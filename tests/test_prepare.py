"""Cleaning rules, feature transforms and validation on small frames."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from careframe import schemas
from careframe.operators.clean import Rule, clean, read_rules
from careframe.operators.engineer import Transform, engineer, read_transforms
from careframe.operators.profile import column_profile
from careframe.operators.validate import validate


def rule(column, kind, action, rule_id=0, **condition):
    return Rule(f"{column}/{action}", column, kind, action, condition, True, rule_id)


def column(df, name):
    return [r[name] for r in df.orderBy("i").collect()]


def numbers(spark, values, kind="double"):
    return spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")


def log_of(log):
    return [tuple(r) for r in log.collect()]


def test_fills(spark):
    df = numbers(spark, [1.0, None, float("nan"), 4.0, 4.0])
    assert column(clean(df, [rule("x", "missing", "fill_mean")])[0], "x") == [1.0, 3.0, 3.0, 4.0, 4.0]
    assert column(clean(df, [rule("x", "missing", "fill_median")])[0], "x") == [1.0, 4.0, 4.0, 4.0, 4.0]
    assert column(clean(numbers(spark, [3, 1, 3, 1, None], "int"), [rule("x", "missing", "fill_mode")])[0], "x") == [3, 1, 3, 1, 1]
    assert column(clean(numbers(spark, [1, 2, None], "int"), [rule("x", "missing", "fill_mean")])[0], "x") == [1.0, 2.0, 1.5]
    assert column(clean(numbers(spark, ["b", "a", None], "string"), [rule("x", "missing", "fill_mode")])[0], "x") == ["b", "a", "a"]


def test_nothing_missing_changes_and_logs_nothing(spark):
    df, log = clean(numbers(spark, [1, 2], "int"), [rule("x", "missing", "fill_mean")])
    assert column(df, "x") == [1, 2] and dict(df.dtypes)["x"] == "int"
    assert log_of(log) == [("total", "summary", None, 2, 2, 0)]


def test_all_null_column_stays(spark):
    for action in ("fill_mean", "fill_median", "fill_mode"):
        df, log = clean(numbers(spark, [None, None]), [rule("x", "missing", action)])
        assert column(df, "x") == [None, None] and log_of(log)[0][2] == 2


def test_text_cannot_be_averaged(spark):
    with pytest.raises(TypeError):
        clean(numbers(spark, ["a", None], "string"), [rule("x", "missing", "fill_mean")])


def test_outliers(spark):
    df = numbers(spark, [1.0, 2.0, 2.0, 3.0, None, 100.0])
    flagged, log = clean(df, [rule("x", "outlier", "flag")])
    assert column(flagged, "x_outlier") == [False, False, False, False, False, True]
    assert log_of(log) == [("x/flag", "flag", 1, None, None, None), ("total", "summary", None, 6, 6, 0)]
    calm, log = clean(numbers(spark, [1.0, 2.0]), [rule("x", "outlier", "flag")])
    assert calm.columns == ["i", "x"] and log_of(log)[0][2] == 0
    assert "x_outlier" in clean(numbers(spark, [1.0, 2.0]), [rule("x", "outlier", "flag")], always_add=True)[0].columns
    kept, log = clean(df, [rule("x", "outlier", "drop")])
    assert kept.count() == 6 and log_of(log)[0][2] == 1


def test_rules_see_earlier_rules(spark):
    df = spark.createDataFrame([(0, 1.0, None), (1, None, 1.0), (2, 5.0, 2.0), (3, None, 50.0)], "i int, x double, y double")
    rules = [rule("y", "missing", "drop", 1), rule("x", "missing", "fill_mean", 2), rule("y", "missing", "fill_mean", 3),
             rule("x", "missing", "flag", 4)]
    cleaned, log = clean(df, rules)
    assert column(cleaned, "x") == [5.0, 5.0, 5.0]
    assert log_of(log) == [("y/drop", "drop", 1, None, None, None), ("x/fill_mean", "fill_mean", 2, None, None, None),
                           ("total", "summary", None, 4, 3, 1)]


def test_rule_order_and_activity_come_from_the_table(spark):
    table = spark.createDataFrame(
        [(2, "fill", "x", "missing", "", "fill_mean", True, None), (1, "drop", "y", "missing", "{}", "drop", True, None),
         (3, "off", "x", "missing", "", "drop", False, None)], schemas.CLEANING_RULE)
    assert [r.name for r in read_rules(table)] == ["drop", "fill"]
    df = spark.createDataFrame([(0, 1.0, None), (1, None, 1.0), (2, 5.0, 2.0)], "i int, x double, y double")
    assert column(clean(df, table)[0], "x") == [5.0, 5.0]


def pandas_clean(frame, rules):
    """The intended behaviour in pandas."""
    for r in rules:
        at = frame[r.field_name]
        if r.rule_type == "missing" and at.isna().any():
            if r.action == "drop":
                frame = frame.dropna(subset=[r.field_name])
            elif r.action == "fill_mean":
                frame = frame.assign(**{r.field_name: at.fillna(at.mean())})
            elif r.action == "fill_median":
                frame = frame.assign(**{r.field_name: at.fillna(at.median())})
            elif r.action == "fill_mode":
                frame = frame.assign(**{r.field_name: at.fillna(at.mode()[0])})
        elif r.rule_type == "outlier":
            low, high = at.quantile(0.25), at.quantile(0.75)
            mask = (at < low - 1.5 * (high - low)) | (at > high + 1.5 * (high - low))
            if mask.any():
                frame = frame.assign(**{f"{r.field_name}_outlier": mask})
    return frame


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("small", [5, 10_000])
def test_random_rule_sequences_equal_pandas(spark, seed, small):
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame({"i": range(300), "x": rng.normal(0, 10, 300).round(1), "y": rng.integers(0, 5, 300).astype(float)})
    frame.loc[rng.random(300) < 0.2, "x"] = np.nan
    frame.loc[rng.random(300) < 0.1, "y"] = np.nan
    frame.loc[:2, "x"] = 500.0
    actions = [("missing", a) for a in ("fill_mean", "fill_median", "fill_mode", "drop")] + [("outlier", "flag")]
    rules = [rule(str(rng.choice(["x", "y"])), *actions[rng.integers(len(actions))], n) for n in range(5)]
    expected = pandas_clean(frame, rules)
    data = [tuple(None if pd.isna(v) else v for v in r) for r in frame.itertuples(index=False, name=None)]
    got = clean(spark.createDataFrame(data, "i long, x double, y double"), rules, small=small)[0].toPandas().sort_values("i")
    assert sorted(got.columns) == sorted(expected.columns)
    for name in expected.columns:
        np.testing.assert_allclose(got[name].astype(float), expected[name].astype(float), rtol=1e-9, equal_nan=True)


def test_settled_input_gives_the_same(spark):
    df, steps = numbers(spark, [1.0, None, 3.0, 90.0]), [Transform("x", "scale", "o")]
    rules = [rule("x", "missing", "fill_mean")]
    assert clean(df, rules, settle=True)[0].collect() == clean(df, rules)[0].collect()
    settled = engineer(df, steps, settle=True)
    assert settled.collect() == engineer(df, steps).collect()
    assert "Scan ExistingRDD" in settled._jdf.queryExecution().executedPlan().toString()


def test_format_rules(spark):
    df = numbers(spark, ["0712", "abc", None, "0799"], "string")
    flagged, log = clean(df, [rule("x", "format", "flag", regex=r"^07\d+$")])
    assert column(flagged, "x_invalid") == [False, True, False, False] and log_of(log)[0][2] == 1
    assert column(clean(df, [rule("x", "format", "drop", regex=r"^07\d+$")])[0], "i") == [0, 2, 3]


def test_duplicate_rules(spark):
    df = numbers(spark, ["a", "b", "a", None, None, "a"], "string")
    flagged, log = clean(df, [rule("x", "duplicate", "flag")])
    assert column(flagged, "x_duplicate") == [True, False, True, True, True, True] and log_of(log)[0][2] == 5
    kept, log = clean(df, [rule("x", "duplicate", "drop", order="i")])
    assert column(kept, "i") == [0, 1, 3] and log_of(log) == [
        ("x/drop", "drop", 3, None, None, None), ("total", "summary", None, 6, 3, 3)]


def test_flagging_whole_copies(spark):
    """A third of the rows are copies of one row, and some keys are null."""
    data = [(7, "x") if i % 3 == 0 else (None, "y") if i % 100 == 1 else (i // 2, str(i % 2)) for i in range(3000)]
    df = spark.createDataFrame(data, "k long, v string")
    got = clean(df, [rule("k", "duplicate", "flag", keys=["k", "v"])])[0].collect()
    counts = {}
    for r in data:
        counts[r] = counts.get(r, 0) + 1
    assert len(got) == 3000 and all(r["k_duplicate"] == (counts[r["k"], r["v"]] > 1) for r in got)


def test_profile(spark):
    got = column_profile(numbers(spark, [3.0, 1.0, 3.0, 1.0, None, float("nan")]), ["x"]).first().asDict()
    assert (got["rows"], got["nulls"], got["mode"], got["median"], got["min"], got["max"]) == (6, 2, 1.0, 2.0, 1.0, 3.0)
    assert got["std"] == pytest.approx(np.std([3, 1, 3, 1], ddof=1))
    assert column_profile(numbers(spark, [7.0]), ["x"]).first()["std"] is None


def made(spark, values, step, kind="double"):
    return engineer(numbers(spark, values, kind), [step])


def test_log_and_sqrt_ignore_negatives(spark):
    values = [-4.0, 0.0, 9.0, None, float("nan")]
    assert column(made(spark, values, Transform("x", "sqrt", "o")), "o") == [0.0, 0.0, 3.0, None, None]
    assert column(made(spark, values, Transform("x", "log", "o")), "o") == [0.0, 0.0, pytest.approx(np.log(10)), None, None]


def test_scales(spark):
    values = [-2.0, 0.0, 2.0, None]
    assert column(made(spark, values, Transform("x", "scale", "o")), "o") == [0.0, 0.5, 1.0, None]
    assert column(made(spark, values, Transform("x", "standardize", "o")), "o") == [-1.0, 0.0, 1.0, None]
    for kind in ("scale", "standardize"):
        assert "o" not in made(spark, [5.0, 5.0], Transform("x", kind, "o")).columns
        assert "o" not in made(spark, [5.0] if kind == "standardize" else [None], Transform("x", kind, "o")).columns
    always = engineer(numbers(spark, [5.0, 5.0]), [Transform("x", "scale", "o")], always_add=True)
    assert column(always, "o") == [None, None]


@pytest.mark.parametrize("values, parameters", [
    ([0.0, 1.0, 2.0, 3.0, 10.0, None], {}), ([0.0, 1.0, 2.0, 3.0, 10.0], {"bins": 3, "labels": ["l", "m", "h"]}),
    ([5.0, 5.0], {"bins": 2}), ([0.0, 0.0], {"bins": 2}), ([-1.0, 0.0, 0.5, 5.0, 7.0], {"bins": [0, 0.5, 5]}),
    ([1.0, 2.0, 3.0], {"bins": [0, 1, 3], "labels": ["a", "b"]}), ([1.0, 9.0, 4.0], {"bins": 5, "labels": False}),
])
def test_binning_equals_pandas(spark, values, parameters):
    expected = pd.cut(pd.Series(values, dtype=float), bins=parameters.get("bins", 4), labels=parameters.get("labels"))
    got = column(made(spark, values, Transform("x", "binning", "o", parameters)), "o")
    assert [None if g is None else str(g) for g in got] == [
        None if pd.isna(e) else str(int(e) if parameters.get("labels") is False else e) for e in expected]


def test_onehot_and_interaction(spark):
    df = engineer(numbers(spark, ["b", "a", None], "string"), [Transform("x", "onehot", "k")])
    assert df.columns == ["i", "x", "k_a", "k_b"] and column(df, "k_b") == [1, 0, 0]
    with pytest.raises(ValueError):
        engineer(spark.range(300).select(F.col("id").alias("x")), [Transform("x", "onehot", "k")])
    both = engineer(numbers(spark, [2.0, None]).withColumn("y", F.lit(3)), [Transform("x", "interaction", "o", {"other": "y"})])
    assert column(both, "o") == [6.0, None]


def test_transforms_of_transforms_and_tables(spark):
    table = spark.createDataFrame(
        [(2, "b", "o", "scale", None, "p", True), (1, "a", "x", "sqrt", json.dumps({}), "o", True),
         (3, "c", "x", "log", None, "q", False), (4, "d", "absent", "log", None, "r", True)], schemas.FEATURE_TRANSFORM)
    assert [t.output_field for t in read_transforms(table)] == ["o", "p", "r"]
    df = engineer(numbers(spark, [0.0, 4.0, 16.0]), table)
    assert column(df, "p") == [0.0, 0.5, 1.0] and df.columns == ["i", "x", "o", "p"]


def test_domain_features(spark):
    df = spark.createDataFrame([(0, 4, 0.25, 15), (1, 4, None, 101)], "i int, num_partners_12m int, condom_use_freq double, age int")
    df = engineer(df, [])
    assert column(df, "risk_exposure_index") == [3.0, None] and column(df, "age_group_encoded") == [0, None]


def test_validation(spark):
    data = [(0, 30, "M", 2, 0.5), (1, None, "M", 2, 0.5), (2, 9, None, -1, 1.5), (3, 120, "F", 0, 0.0), (4, 121, "F", 0, None),
            (5, None, None, None, -0.1)]
    df = validate(spark.createDataFrame(data, "i int, age int, gender string, num_partners_12m int, condom_use_freq double"))
    assert column(df, "errors") == [
        [], ["Missing required field: age"],
        ["Missing required field: gender", "Age must be between 10 and 120", "Number of partners cannot be negative",
         "Condom use frequency must be between 0 and 1"],
        [], ["Age must be between 10 and 120"],
        ["Missing required field: age", "Missing required field: gender", "Missing required field: num_partners_12m",
         "Condom use frequency must be between 0 and 1"]]
    assert column(df, "is_valid") == [True, False, False, True, False, False]
    assert validate(spark.createDataFrame([(0, "M")], "i int, gender string")).first()["errors"] == [
        "Missing required field: age", "Missing required field: num_partners_12m"]
