"""Substring search over a trigram posting table instead of the whole patient table.

The index of a bucketed table (``bucketed``) has a row per (column, gram, key): every three consecutive letters of the lower-cased
value, two end marks added, so that a needle of one or two letters is the beginning of some grams.  Postings are range-partitioned
and sorted by column and gram, so a gram's rows are a few row groups of the files, and a gram of every patient still spreads over tasks.
A second, small table counts the rows of each gram.

A search reads the counts of the needle's grams, intersects the postings of the rarest per column, and verifies the candidates with
the same predicate as ``predicates.search``, so the rows are the same.  If even the rarest gram is in more than ``SCAN_SHARE`` of all
rows, reading postings saves nothing and the table is scanned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from careframe.functions.predicates import search
from careframe.operators import bucketed

END = "\u0000\u0000"
RAREST = 3
SCAN_SHARE = 0.2


def _grams(value: Column, end: str = END) -> Column:
    """The different grams of a text, lower-cased; none of an empty one."""
    padded = F.concat(F.lower(value), F.lit(end))
    starts = F.sequence(F.lit(1), F.length(padded) - 2)
    return F.when(F.length(padded) >= 3, F.array_distinct(F.transform(starts, lambda i: F.substring(padded, i, F.lit(3))))).otherwise(
        F.array().cast("array<string>"))


def postings(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(column, gram, key): one row per different gram of a value."""
    listed = F.array(*[F.struct(F.lit(c).alias("column"), _grams(F.col(c)).alias("grams")) for c in columns])
    return rows.select(F.col(key).alias("key"), F.explode(listed).alias("x")).select(
        F.col("x.column").alias("column"), F.explode("x.grams").alias("gram"), "key")


def extend(rows: DataFrame, index: str, key: str, columns: list[str]) -> None:
    """Add the postings of new or changed rows.  Postings of values that have changed stay, and are refuted when verified."""
    found = postings(rows, key, columns)
    found.repartitionByRange("column", "gram", "key").sortWithinPartitions("column", "gram").write.mode("append").parquet(f"{index}/postings")
    found.groupBy("column", "gram").agg(F.count("*").alias("n")).write.mode("append").parquet(f"{index}/counts")
    rows.agg(F.count("*").alias("n")).write.mode("append").parquet(f"{index}/rows")


def build(spark: SparkSession, root: str, index: str, key: str, columns: list[str]) -> None:
    """Index the bucketed table at ``root``."""
    extend(bucketed.read(spark, root).select(key, *[c for c in columns if c != key]), index, key, columns)


def _rarest(spark: SparkSession, index: str, text: str, columns: list[str], most: int) -> dict[str, list[tuple[str, int]]] | None:
    """The needle's rarest grams per column with their rows; a column is left out if it lacks one of them.  A needle under three
    letters stands for itself: the beginning of grams."""
    needle = spark.range(1).select(F.lower(F.lit(text)).alias("t")).first()["t"]
    wanted = sorted({needle[i:i + 3] for i in range(len(needle) - 2)}) or [needle]
    counts = spark.read.parquet(f"{index}/counts").filter(F.col("column").isin(columns))
    if len(needle) >= 3:
        counts = counts.filter(F.col("gram").isin(wanted)).groupBy("column", "gram")
    else:
        counts = counts.filter(F.startswith("gram", F.lit(needle))).groupBy("column", F.lit(needle).alias("gram"))
    found: dict[str, list[tuple[str, int]]] = {}
    for r in counts.agg(F.sum("n").alias("n")).collect():  # at most the needle's grams times the columns
        found.setdefault(r["column"], []).append((r["gram"], r["n"]))
    return {c: sorted(g, key=lambda x: (x[1], x[0]))[:most] for c, g in found.items() if len(g) == len(wanted)}


def candidates(spark: SparkSession, index: str, text: str, columns: list[str], rarest: int = RAREST) -> DataFrame:
    """(key): every key that has the rarest grams of the needle in one of its columns."""
    table = spark.read.parquet(f"{index}/postings")
    return _candidates(table, _rarest(spark, index, text, columns, rarest))


def _candidates(table: DataFrame, grams: dict[str, list[tuple[str, int]]]) -> DataFrame:
    keys = table.select("key").limit(0)
    for column, listed in sorted(grams.items()):
        rows = table.filter(F.col("column") == column)
        if len(listed) == 1:
            hit = rows.filter(F.startswith("gram", F.lit(listed[0][0]))).select("key")
        else:
            names = [g for g, _ in listed]
            # A posting may be there twice if a row was indexed again.
            hit = rows.filter(F.col("gram").isin(names)).groupBy("key").agg(F.count_distinct("gram").alias("n")).filter(
                F.col("n") == len(names)).select("key")
        keys = keys.unionByName(hit)
    return keys.distinct()


def search_indexed(
    spark: SparkSession, root: str, index: str, text: str | None, key: str, columns: list[str], rarest: int = RAREST,
    scan_share: float = SCAN_SHARE,
) -> DataFrame:
    """The rows of ``predicates.search`` over the table at ``root``.  Reads only the buckets that hold candidates; runs small jobs."""
    rows = bucketed.read(spark, root)
    if not text:
        return rows
    grams = _rarest(spark, index, text, columns, rarest)
    total = spark.read.parquet(f"{index}/rows").agg(F.sum("n")).first()[0] or 0
    if sum(g[0][1] for g in grams.values()) > scan_share * total:
        return search(rows, text, columns)
    found = _candidates(spark.read.parquet(f"{index}/postings"), grams)
    return search(bucketed.having_keys(spark, root, found, key), text, columns)
