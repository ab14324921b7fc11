"""Line deduplication over overlapping windows of three consecutive lines.

Lines that hold a word are numbered within their document; every three consecutive ones are a window, known by two
64-bit hashes.  A window seen more than once in the corpus keeps its first occurrence (smallest id,
then place); every later occurrence covers its three lines and the blank lines between them.  Covered
stretches are merged and cut out.  Windows are judged on the input, not on what is left.

Counting is pre-aggregated map-side and only windows found twice are joined back, so a window owning a
third of all lines is one row on one side of a join whose other side Spark may split.

Edge cases: a null text has no lines and stays null; a document of fewer than three such lines has no window
and is left alone; null ids come last in order; rows equal in id and text are one document seen
more than once and are all cut alike; an empty table stays empty; other columns are carried along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from careframe.llm.common import as_rows, stored, text_batches, text_of
from careframe.llm.words import BLOCK_BYTES, stretches

WINDOW = 3


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, version, start, end): line numbers, end exclusive, of every later occurrence of a repeated window."""
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"), F.filter(
        F.transform(F.split(text_of(text_col), "\n"), lambda line, i: F.struct(line.alias("line"), i.alias("i"))),
        lambda x: x["line"].rlike("[^ \\t-\\r]")).alias("lines")).filter(F.size("lines") >= WINDOW)

    def hashed(seed: int, i):
        return F.xxhash64(F.lit(seed), *[F.get("lines", i + k)["line"] for k in range(WINDOW)])

    windows = lines.select("id", "version", F.explode(F.transform(
        F.sequence(F.lit(0), F.size("lines") - WINDOW), lambda i: F.struct(
            hashed(1, i).alias("h1"), hashed(2, i).alias("h2"), F.get("lines", i)["i"].alias("start"),
            (F.get("lines", i + WINDOW - 1)["i"] + 1).alias("end")))).alias("w")).select(
        "w.h1", "w.h2", F.col("id").isNull().alias("last"), "id", "version", "w.start", "w.end")
    place = F.struct("last", "id", "version", "start")
    twice = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").select(
        "h1", "h2", "first")
    return windows.join(twice, ["h1", "h2"]).filter(~place.eqNullSafe(F.col("first"))).select("id", "version", "start", "end")


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None) -> DataFrame:
    """``docs`` with repeated stretches cut out of the text; ``removed_col``, if given, holds the number of lines cut."""
    cuts = stored(repeats(docs, id_col, text_col), "line-repeats").groupBy("id", "version").agg(
        F.array_distinct(F.sort_array(F.collect_list(F.struct("start", "end")))).alias("cuts")).select(
        F.col("id").alias("_id"), F.col("version").alias("_version"), "cuts")
    rows = as_rows(docs, id=F.col(id_col), version=F.xxhash64(text_col), text=F.col(text_col))
    joined = rows.join(cuts, F.col("id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version")), "left")
    other = [c for c in docs.columns if c not in (text_col, removed_col)]
    found = joined.select(F.struct(*[F.col(f"row.`{c}`") for c in other] or [F.lit(0).alias("none")]).alias("row"), "text", "cuts")

    def run(batches):
        for batch in (whole.slice(start, end - start) for whole in batches for start, end in stretches(
                np.asarray(pc.binary_length(whole.column(1)).fill_null(0)), BLOCK_BYTES)):
            texts, removed = [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                n, before = 0, 0
                if spans:
                    lines, kept = text.split("\n"), []
                    for span in spans:
                        kept += lines[before:span["start"]]
                        n += max(0, span["end"] - max(before, span["start"]))
                        before = max(before, span["end"])
                    text = "\n".join(kept + lines[before:])
                texts.append(text)
                removed.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int64())], names=["row", "text", "removed"])

    schema = T.StructType([found.schema["row"], T.StructField("text", T.StringType()), T.StructField("removed", T.LongType())])
    done = text_batches(found).mapInArrow(run, schema)
    outputs = [F.col("text").alias(text_col) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns if c != removed_col]
    return done.select(*outputs, *([F.col("removed").alias(removed_col)] if removed_col else []))
