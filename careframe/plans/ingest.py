"""File ingestion end to end: read, coerce, upsert, job statistics."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from careframe.operators.tables import upsert
from careframe.sources.patient_csv import (
    COLUMN_DEFAULTS, KEY, check_rows, failed_stats, ingest_stats, is_utf8, place_of, read_patient_csv, split_rows,
)

NOT_UTF8 = "file is not valid UTF-8"


def merge_checked(current: DataFrame, checked: DataFrame, as_of) -> DataFrame:
    """New patient table after upserting the usable rows of checked files.

    Within a file the last row of a key wins; among files, the newest file.
    """
    valid, _ = split_rows(checked)
    placed = valid.withColumn("_place", place_of(valid))
    return upsert(current, placed, KEY, "_place", list(COLUMN_DEFAULTS), as_of)


def ingest_file(
    spark: SparkSession, path: str, current: DataFrame, as_of, staging: str | None = None, multi_line: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(new patient table, one row of job statistics).

    A file that cannot be read or decoded changes nothing and is reported as
    failed.  With a ``staging`` path the checked rows are written there once,
    so the file is parsed once for the table and the statistics together.
    """
    try:
        if not is_utf8(spark, path):
            raise UnicodeError(NOT_UTF8)
        checked = check_rows(read_patient_csv(spark, path, multi_line))
        if staging:
            checked.write.mode("errorifexists").parquet(staging)
            checked = spark.read.parquet(staging)
    except (PySparkException, UnicodeError) as error:
        return current, failed_stats(spark, str(error))
    return merge_checked(current, checked, as_of), ingest_stats(checked)
