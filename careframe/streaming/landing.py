"""A landing folder of patient files, upserted file batch by file batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from careframe.operators import bucketed
from careframe.plans.ingest import NOT_UTF8
from careframe.sources.patient_csv import (
    COLUMN_DEFAULTS, KEY, SOURCE_FILE, check_rows, failed_stats, file_stats, place_of, read_patient_csv, split_rows,
    undecodable_files,
)

FILE = "path string, modificationTime timestamp, length long, content binary"


def landing_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Paths of files as they land; their content is not read here."""
    return (spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", max_files)
            .load(folder).select("path"))


def start_landing(
    spark: SparkSession, folder: str, names: list[str] | None, table_root: str, stats_root: str, checkpoint: str, as_of,
    max_files: int = 1000,
) -> StreamingQuery:
    """Upsert each batch of files into the bucketed patient table at ``table_root`` (``operators.bucketed``).

    Files are read as ``read_patient_csv`` reads them: each by its own header, unless ``names`` gives one for all.
    One that is no UTF-8 fails as a whole and changes nothing.  Statistics have a row per file.  Only the buckets that a
    batch touches are rewritten.  A batch that is run again after a failure finds its checked rows and its journal below
    ``stats_root`` and ends in the same table.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        paths = [r["path"] for r in batch.select("path").collect()]  # at most max_files
        broken = [r[SOURCE_FILE] for r in undecodable_files(spark, paths).collect()]
        rows = read_patient_csv(spark, paths, names=names)
        staged = f"{stats_root}/checked/batch={batch_id}"
        check_rows(rows.filter(~F.col(SOURCE_FILE).isin(broken))).write.mode("overwrite").parquet(staged)
        checked = spark.read.parquet(staged)
        jobs = file_stats(checked)
        if broken:
            failed = failed_stats(spark, NOT_UTF8).withColumn(SOURCE_FILE, F.explode(F.lit(broken)))
            jobs = jobs.unionByName(failed)
        jobs.write.mode("overwrite").parquet(f"{stats_root}/jobs/batch={batch_id}")
        valid, _ = split_rows(checked)
        placed = valid.withColumn("_place", place_of(valid))
        bucketed.upsert_buckets(spark, table_root, placed, KEY, "_place", list(COLUMN_DEFAULTS), as_of, f"{stats_root}/journal/batch={batch_id}")

    return (landing_stream(spark, folder, max_files).writeStream.foreachBatch(merge)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
