"""Skew handling, order statistics and running totals against brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from careframe.operators import keyed, quantiles
from careframe.operators.lookups import page
from careframe.operators.running import running_totals


@pytest.fixture
def no_broadcast(spark):
    """Sizes as if nothing were small: joins are shuffled unless a hint says otherwise."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key; some keys are null or unknown on the other side."""
    random.seed(3)
    data = [(i, 7 if i % 3 == 0 else None if i % 50 == 1 else random.randrange(2000)) for i in range(6000)]
    one = [(k, f"name {k}") for k in range(1500)]
    return spark.createDataFrame(data, "id long, k long"), spark.createDataFrame(one, "k long, name string")


def test_hot_values_finds_the_hot_key(skewed):
    many, _ = skewed
    hot = dict(keyed.hot_values(many, "k"))
    assert set(hot) == {7, None} and 60 <= hot[7] <= 75 and hot[None] <= 5  # a third of 200 fair loads; 1 in 75
    assert keyed.hot_values(many.filter("k < 0"), "k") == []


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("unique", [True, False])
def test_spread_join_equals_plain_join(no_broadcast, skewed, how, unique):
    many, one = skewed
    if not unique:
        one = one.unionByName(one.filter("k < 100").withColumn("name", F.lit("again")))
    got = keyed.spread_join(many, one, "k", how, unique)
    plain = many.join(one, "k", how)
    assert ("Broadcast" in got._jdf.queryExecution().executedPlan().toString())  # of the hot part
    assert sorted(map(str, got.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_salted_hot_rows_use_many_partitions(no_broadcast, skewed):
    many, one = skewed
    spark = many.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = keyed.spread_join(many, one, "k", "inner", unique=False).filter("k = 7")
        used = joined.select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert used == 4


@pytest.mark.parametrize("how", ["left_semi", "left_anti"])
def test_having_equals_plain_join(no_broadcast, skewed, how):
    many, one = skewed
    for df, keys in ((many, one.unionAll(one)), (one, many)):
        got, plain = keyed.having(df, keys, "k", how), df.join(keys, "k", how)
        assert sorted(map(str, got.select(*df.columns).collect())) == sorted(map(str, plain.select(*df.columns).collect()))


def test_small_sides_are_joined_without_a_sketch(spark, skewed):
    many, one = skewed[0], spark.range(100).withColumnRenamed("id", "k")
    plan = keyed.spread_join(many, one, "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1 and "Union" not in plan


def test_top_per_key_cuts_before_the_shuffle(skewed):
    many, _ = skewed
    top = keyed.top_per_key(many, ["k"], [F.desc("id")], 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan
    newest = {}
    for r in sorted(many.collect(), key=lambda r: -r["id"]):
        newest.setdefault(r["k"], []).append(r["id"])
    assert sorted(r["id"] for r in top.collect()) == sorted(i for ids in newest.values() for i in ids[:2])


def test_split_first(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "n long, k string")
    first, later = keyed.split_first(df, ["k"], "n")
    assert sorted(r["n"] for r in first.collect()) == [1, 3, 5]
    assert sorted(r["n"] for r in later.collect()) == [2, 4]


VALUES = st.lists(st.one_of(st.sampled_from([0.0, 1.5, -2.25, 1e9]), st.floats(-1e6, 1e6)), min_size=1, max_size=300)


@settings(max_examples=8, deadline=None)
@given(VALUES)
def test_narrowed_percentiles_equal_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double")
    points = [0.0, 0.25, 0.5, 0.9, 1.0]
    narrowed = quantiles.exact_percentiles(df, {"x": points}, small=3, accuracy=20)["x"]
    built_in = quantiles.exact_percentiles(df, {"x": points})["x"]
    expected = np.percentile(values, [100 * p for p in points])
    assert narrowed == pytest.approx(list(expected), rel=1e-9, abs=1e-9)
    assert built_in == pytest.approx(list(expected), rel=1e-9, abs=1e-9)


def test_narrowing_with_heavy_ties(spark):
    values = [5.0] * 4000 + [float(i) for i in range(2000)] + [5.0000001] * 3000
    random.seed(1)
    random.shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "x double")
    ordered = sorted(values)
    ranks = [0, 5, 6, 4005, 4006, 7005, 7006, 8999]
    got = quantiles.select_ranks(df, [("x", [r], len(values)) for r in ranks], small=10, accuracy=50)
    assert got == {("x", r): ordered[r] for r in ranks}
    together = quantiles.select_ranks(df, [("x", ranks, len(values))], small=400, accuracy=50)
    assert together == got


def test_percentiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert quantiles.exact_percentiles(df, {"x": [0.5]}) == {"x": [None]}
    assert quantiles.approx_percentiles(df, {"x": [0.5]}) == {"x": [None]}


def test_approximate_percentiles_are_close(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("x"))
    assert quantiles.approx_percentiles(df, {"x": [0.5]})["x"][0] == pytest.approx(500, abs=1)


def test_mode_takes_the_smallest_on_ties(rows):
    assert quantiles.mode_of(rows("x int", (3,), (1,), (3,), (1,), (None,)), "x") == 1
    assert quantiles.mode_of(rows("x double", (float("nan"),), (float("nan"),), (2.0,)), "x") == 2.0
    assert quantiles.mode_of(rows("x string", (None,)), "x") is None


@settings(max_examples=6, deadline=None)
@given(st.dictionaries(st.floats(-100, 100), st.integers(0, 50), min_size=1, max_size=120), st.sampled_from([1, 3, 16]))
def test_running_totals_equal_brute_force(spark, values, slices):
    df = spark.createDataFrame(list(values.items()), "v double, n long")
    got = {r["v"]: r["n_before"] for r in running_totals(df, "v", ["n"], slices).collect()}
    assert got == {v: sum(n for w, n in values.items() if w < v) for v in values}


@pytest.mark.parametrize("offset", [0, 7, 60, 250, 295, 300, 400])
def test_deep_page_equals_plain_page(spark, offset):
    df = spark.createDataFrame([(i, f"2024-01-{1 + i % 9:02d}") for i in range(300)], "id long, t string")
    df = df.withColumn("t", F.col("t").cast("timestamp"))
    expected = df.orderBy(F.desc("t"), F.desc("id")).offset(offset).limit(20).collect()
    assert page(df, "t", 20, offset, direct=5).collect() == expected
