"""A keyed table in hash buckets, of which an upsert rewrites only those that its rows touch.

The table is a Parquet folder partitioned by a bucket of the key; the partition column's name tells how many buckets there are, so
one table cannot be written with two numbers.  An upsert merges the touched buckets (partition pruning reads no others) and
replaces them behind a journal (``partitions``).  Files of other buckets are never touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from careframe.operators.partitions import replace_partitions
from careframe.operators.tables import upsert

PREFIX = "bucket_of_"
BUCKETS = 256


def bucket(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def create(df: DataFrame, root: str, key: str, buckets: int = BUCKETS) -> None:
    """Write ``df`` as a new bucketed table.  A bucket is one file, or more with ``spark.sql.files.maxRecordsPerFile``."""
    name = f"{PREFIX}{buckets}"
    df.withColumn(name, bucket(key, buckets)).repartition(name).write.mode("errorifexists").partitionBy(name).parquet(root)


def _stored(spark: SparkSession, root: str) -> tuple[DataFrame, str, int]:
    table = spark.read.parquet(root)
    name = next(c for c in table.columns if c.startswith(PREFIX))
    return table, name, int(name.removeprefix(PREFIX))


def read(spark: SparkSession, root: str) -> DataFrame:
    """The table without its bucket column."""
    table, name, _ = _stored(spark, root)
    return table.drop(name)


def having_keys(spark: SparkSession, root: str, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among ``keys`` (key); only their buckets are read, a number per bucket comes to the driver."""
    table, name, n = _stored(spark, root)
    hit = [r[0] for r in keys.select(bucket("key", n)).distinct().collect()]
    wanted = keys.select(F.col("key").alias(key)).distinct()
    return table.filter(F.col(name).isin(hit)).drop(name).join(wanted, key, "left_semi").select(*[c for c in table.columns if c != name])


def upsert_buckets(
    spark: SparkSession, root: str, incoming: DataFrame, key: str, order_col: str, update_cols: list[str], as_of, journal: str,
    defaults: dict | None = None,
) -> None:
    """``tables.upsert`` of the buckets that ``incoming`` touches, in place.  ``incoming`` is read twice: store it first.

    ``journal`` is a folder of this batch alone; after a failure the same batch is run again with the same one.
    """
    table, name, n = _stored(spark, root)

    def merged() -> DataFrame:
        # At most one number per bucket comes to the driver.
        hit = [r[0] for r in incoming.filter(F.col(key).isNotNull()).select(bucket(key, n)).distinct().collect()]
        touched = table.filter(F.col(name).isin(hit)).drop(name)
        return upsert(touched, incoming, key, order_col, update_cols, as_of, defaults).withColumn(name, bucket(key, n))

    replace_partitions(spark, root, table.schema, name, journal, merged)
