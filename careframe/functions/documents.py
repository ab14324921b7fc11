"""JSON columns as VARIANT: parsed once, read by path, malformed text told apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def parsed(document: Column) -> Column:
    """Any JSON text as VARIANT; null for null, blank and malformed text."""
    return F.try_parse_json(F.nullif(F.trim(document), F.lit("")))


def value_at(variant: Column, path: str, kind: str = "string") -> Column:
    """The value at a path such as ``$.hiv.result`` or ``$.tests[0]``; null where it is missing or not of that kind."""
    return F.try_variant_get(variant, path, kind)


def split_documents(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``column`` as VARIANT, rows whose text is no JSON).  Null and blank texts are rows without a document."""
    text, variant = F.col(column), parsed(F.col(column))
    refused = variant.isNull() & (F.length(F.trim(text)) > 0)
    bad = F.coalesce(refused, F.lit(False))
    return df.filter(~bad).withColumn(column, variant), df.filter(bad)


def schema_of(df: DataFrame, column: str) -> str:
    """The schema that all documents of a VARIANT column fit, found by one aggregation that merges schemas map-side."""
    return df.agg(F.schema_of_variant_agg(column).alias("s")).first()["s"]


def fields_of(df: DataFrame, column: str, key: str) -> DataFrame:
    """(key, position, name, value) of the top-level entries of every document: the members of an object (``name``), the items
    of a list (``name`` null).  Documents that are neither have none."""
    return df.select(F.col(key), F.col(column).alias("_document")).lateralJoin(
        df.sparkSession.tvf.variant_explode(F.col("_document").outer())).select(key, F.col("pos").alias("position"), F.col("key").alias("name"), "value")
