"""Request log streams: audit rows and daily counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from careframe.operators.audit import audit_from_requests
from careframe.operators.tables import dated


def audit_stream(requests: DataFrame, time_col: str = "ts") -> DataFrame:
    """Audit rows of a request stream; stateless, so nothing is held back.

    Times become zoned timestamps, which watermarks need.
    """
    return audit_from_requests(requests.withColumn(time_col, F.col(time_col).cast("timestamp")), time_col)


def append_audit(audit: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append audit rows to a Parquet table partitioned by date, exactly once."""
    writer = (dated(audit).writeStream.format("parquet").outputMode("append").partitionBy("created_date")
              .option("path", path).option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


MARK = "created_at timestamp"


def open_marks(spark: SparkSession, folder: str) -> DataFrame:
    """The end marks of a log as a stream; the folder is made if need be."""
    spark.createDataFrame([], MARK).write.mode("append").parquet(folder)
    return spark.readStream.schema(MARK).parquet(folder)


def mark_end(spark: SparkSession, folder: str, instant) -> None:
    """Say that the log is complete up to ``instant``: no row before it will come any more."""
    spark.range(1, numPartitions=1).select(F.lit(instant).cast("timestamp").alias("created_at")).write.mode("append").parquet(folder)


def daily_actions(audit: DataFrame, lateness: str = "1 day", marks: DataFrame | None = None) -> DataFrame:
    """Counts per day and action; a day is final once ``lateness`` has passed.

    State is one counter per open (day, action), whatever the traffic.  Rows alone never pass the end of their last
    day.  A mark in the stream of ``marks`` counts for nothing but moves event time, so the days that end ``lateness`` before it
    are written too, from the same state.  Give a mark only once the rows before it have been read: later ones are late.
    """
    rows = audit.select("created_at", "action")
    if marks is not None:
        rows = rows.unionByName(marks.select("created_at", F.lit(None).cast("string").alias("action")))
    counts = (rows.withWatermark("created_at", lateness)
              .groupBy(F.window("created_at", "1 day"), "action").agg(F.count("action").alias("n")))
    # The marks' own groups are told by their count: a test of the action would be pushed below the watermark.
    return counts.filter("n > 0").select(F.to_date("window.start").alias("day"), "action", "n")
