"""Pieces several operators share."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from careframe.session import work_folder

WORD = "[^ \\t-\\r]+"


def text_of(name: str) -> Column:
    """The whole text; null is the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read again: later jobs neither repeat it nor depend on its executors."""
    place = work_folder(df.sparkSession, purpose)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that hands Python at most 1,000 rows at a time: rows that hold whole texts are large."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return df


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished jobs now, not when the driver happens to collect garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def as_rows(docs: DataFrame, **columns: Column) -> DataFrame:
    """Every row of ``docs`` as one struct ``row`` beside computed columns, so that no names can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       *[value.alias(name) for name, value in columns.items()])

