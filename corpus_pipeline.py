"""From raw documents to token ids: five stages, each written as Parquet before the next reads it.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  All but the last return
the columns of ``documents``; where a stage changes a text, ``n_chars`` follows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from careframe.llm import bpe, classifier, lines, mixing, near_duplicates
from careframe.llm.common import free_shuffles, stored
from careframe.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour vote finds good."""
    model = classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classifier.score(docs, model, score_col="_quality").filter(F.col("_quality") >= classifier.THRESHOLD).drop("_quality")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of repeated lines; one that has no word left then is dropped."""
    cut = lines.dedupe(docs, removed_col="_removed")
    left = cut.filter((F.col("_removed") == 0) | F.col("text").rlike("[^ \\t-\\r]"))
    return left.withColumn("n_chars", F.when(F.col("_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).drop("_removed")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_duplicates.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's weight lets them in, in order of virtual finish time."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the digest of what they decode to."""
    path = tokenizer_path()
    return bpe.decode(bpe.encode(docs.select("doc_id", "lang", "source", "text"), path), path).select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("bpe", tokens),
]

# The classifier's votes and the signatures are beyond SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        free_shuffles(spark)
    return docs
