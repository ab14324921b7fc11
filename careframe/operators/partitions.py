"""Replacing some partitions of a Parquet folder so that a job which dies can be run again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

MARK = "done boolean"


def marked(spark: SparkSession, place: str) -> bool:
    """Has ``mark`` been called for this place?"""
    try:
        return spark.read.schema(MARK).parquet(place).limit(1).count() == 1
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error.getCondition()):
            return False
        raise


def mark(spark: SparkSession, place: str) -> None:
    spark.range(1, numPartitions=1).select(F.lit(True).alias("done")).write.mode("overwrite").parquet(place)


def replace_partitions(
    spark: SparkSession, root: str, schema: T.StructType, name: str, journal: str, rows: Callable[[], DataFrame],
) -> None:
    """Put ``rows()``, the whole new content of the partitions they fall in, in place of these partitions of ``root``.

    Rows may be made from ``root`` itself: they go to ``journal`` first, a folder of this change alone.  A job that dies
    is run again with the same journal.  While that is not marked complete the rows are made anew, from partitions not yet touched;
    else the same partitions are replaced by the same rows.  Files of other partitions stay.  Readers should not run
    while partitions are replaced.
    """
    staged = f"{journal}/rows"
    if not marked(spark, f"{journal}/complete"):
        rows().repartition(name).write.mode("overwrite").partitionBy(name).parquet(staged)
        mark(spark, f"{journal}/complete")
    spark.read.schema(schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(name).parquet(root)
    # The journal's rows have served; its mark stays, and replaying an empty journal replaces nothing.
    spark.createDataFrame([], schema).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(name).parquet(staged)
