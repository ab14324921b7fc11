"""Dashboards and heatmaps kept up by appends, from one small state per day and place.

The state has a row per UTC day, county, sub-county and risk level: number of predictions, sum and number of scores, and a mergeable sketch of
the patients, partitioned by month.  A batch of predictions is reduced to the same shape and merged into the partitions of its days,
late days included; other months' files stay.  Any look-back is then a sum over the state's days, and distinct patients of any window and place come
from the union of its sketches, with a relative error of about 1.04 / sqrt(2 ** LG_K) (0.8 %); ``geo`` and ``dashboards`` are the
exact path.  A patient counts for the place they had when the prediction was appended.
"""

from __future__ import annotations

from datetime import time, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from careframe.functions.predicates import RISK_LEVELS, as_instant, equals_ci, is_high
from careframe.functions.scalars import utc_day
from careframe.operators.dashboards import _with_zeros
from careframe.operators.keyed import spread_join
from careframe.operators.partitions import replace_partitions

LG_K = 14
DAY, MONTH = "day", "month"
KEYS = ["county", "sub_county", "risk_level"]
SCHEMA = T.StructType([
    *[T.StructField(k, T.StringType()) for k in KEYS], T.StructField("n", T.LongType()), T.StructField("score_sum", T.DoubleType()),
    T.StructField("score_n", T.LongType()), T.StructField("people", T.BinaryType()), T.StructField(DAY, T.DateType()),
    T.StructField(MONTH, T.DateType())])


def day_rows(predictions: DataFrame, patients: DataFrame) -> DataFrame:
    """The state of ``predictions`` alone.  They are summed per patient, day and level before they meet their patients."""
    sums = predictions.groupBy("patient_key", utc_day(F.col("created_at")).alias(DAY), "risk_level").agg(
        F.count("*").alias("n"), F.sum("risk_score").alias("score_sum"), F.count("risk_score").alias("score_n"))
    placed = spread_join(sums.filter("day is not null"), patients.select(F.col("id").alias("patient_key"), "county", "sub_county"), "patient_key")
    return placed.groupBy(*KEYS, DAY).agg(
        F.sum("n").alias("n"), F.sum("score_sum").alias("score_sum"), F.sum("score_n").alias("score_n"),
        F.hll_sketch_agg(F.col("patient_key").cast("string"), F.lit(LG_K)).alias("people"), _month().alias(MONTH)).select(*SCHEMA.names)


def _month() -> Column:
    return F.first(F.trunc(DAY, "month"))


def create(spark: SparkSession, root: str) -> None:
    spark.createDataFrame([], SCHEMA).write.mode("errorifexists").partitionBy(MONTH).parquet(root)


def read(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(root)


def append(spark: SparkSession, root: str, predictions: DataFrame, patients: DataFrame, journal: str) -> None:
    """Add a batch of predictions.  ``journal`` is a folder of this batch alone: run again with it, the batch counts once."""

    def merged() -> DataFrame:
        new = day_rows(predictions, patients)
        # One date per month of the batch.
        months = [r[0] for r in predictions.select(F.trunc(utc_day(F.col("created_at")), "month").alias(MONTH)).distinct().filter(
            "month is not null").collect()]
        both = read(spark, root).filter(F.col(MONTH).isin(months)).unionByName(new)
        return both.groupBy(*KEYS, DAY).agg(
            F.sum("n").alias("n"), F.sum("score_sum").alias("score_sum"), F.sum("score_n").alias("score_n"),
            F.hll_union_agg("people").alias("people"), _month().alias(MONTH)).select(*SCHEMA.names)

    replace_partitions(spark, root, SCHEMA, MONTH, journal, merged)


def window(state: DataFrame, as_of, days: int, county: str | None = None) -> DataFrame:
    """The state's rows of a look-back, which has to begin at midnight UTC; only its months are read."""
    since = as_instant(as_of) - timedelta(days=days)
    if since.time() != time():
        raise ValueError("the state is kept per UTC day: as_of has to be a midnight")
    recent = state.filter((F.col(MONTH) >= F.lit(since.date().replace(day=1))) & (F.col(DAY) >= F.lit(since.date())))
    return recent.filter(equals_ci(F.col("county"), county)) if county else recent


def screenings(state: DataFrame, as_of, days: int = 30, county: str | None = None) -> DataFrame:
    """The prediction sections of ``dashboards.dashboard_table``: (section, label, n, avg_risk)."""
    level, day = F.col("risk_level"), F.col(DAY)
    sums = window(state, as_of, days, county).groupingSets([[level], [day], []], level, day).agg(
        F.sum("n").alias("n"), F.try_divide(F.sum("score_sum"), F.sum("score_n")).alias("avg_risk"), F.grouping_id().alias("gid"))
    named = sums.select(
        F.when(F.col("gid") == 1, "risk_level").when(F.col("gid") == 2, "day").otherwise("total_screenings").alias("section"),
        F.when(F.col("gid") == 1, level).when(F.col("gid") == 2, day.cast("string")).otherwise("all").alias("label"),
        F.coalesce("n", F.lit(0)).alias("n"), "avg_risk")
    return _with_zeros(named, [("total_screenings", "all"), *[("risk_level", name) for name in RISK_LEVELS]])


def places(state: DataFrame, as_of, days: int = 90, by: tuple[str, ...] = ("county", "sub_county"), county: str | None = None) -> DataFrame:
    """Per place of the window: mean score, patients (estimated), and predictions per level group, as ``geo.heatmap`` and
    ``geo.county_summary`` have them before rounding and cutting."""
    level = F.col("risk_level")

    def counted(keep: Column) -> Column:
        return F.sum(F.when(keep, F.col("n")).otherwise(0))

    return window(state, as_of, days, county).groupBy(*by).agg(
        F.try_divide(F.sum("score_sum"), F.sum("score_n")).alias("avg_risk"),
        F.hll_sketch_estimate(F.hll_union_agg("people")).alias("patients"), F.sum("n").alias("predictions"),
        counted(is_high(level)).alias("high_risk"), counted(level == "moderate").alias("moderate_risk"), counted(level == "low").alias("low_risk"))
