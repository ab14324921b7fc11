"""Stored tables in and reports out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

# File formats reports can be written in.
REPORT_FORMATS = ("csv", "json", "parquet")


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet table scan; filters and column choice reach the files."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def jdbc_options(url: str, table: str, split_column: str, low, high, parts: int, **more: str) -> dict[str, str]:
    """Options of a split read: ``parts`` range queries on ``split_column``."""
    return {"url": url, "dbtable": table, "partitionColumn": split_column, "lowerBound": str(low),
            "upperBound": str(high), "numPartitions": str(parts), "fetchsize": "10000", **more}


def read_jdbc(spark: SparkSession, url: str, table: str, split_column: str, low, high, parts: int = 64,
              **more: str) -> DataFrame:
    """Database table read in parallel ranges rather than through one connection."""
    return spark.read.format("jdbc").options(**jdbc_options(url, table, split_column, low, high, parts, **more)).load()


def write_report(df: DataFrame, path: str, file_format: str = "csv") -> None:
    """Report files, written by the tasks that hold the rows."""
    if file_format not in REPORT_FORMATS:
        raise ValueError(f"report format must be one of {REPORT_FORMATS}")
    writer = df.write.mode("errorifexists").format(file_format)
    if file_format == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.save(path)
