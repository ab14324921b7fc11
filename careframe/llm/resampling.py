"""Importance resampling towards a target distribution of hashed word n-grams.

Every n-gram falls into one of ``buckets`` buckets.  A bucket's gain is the log ratio of its share in the target texts and in
all documents, both smoothed by one, in whole thousandths.  A document's weight is the floored mean gain of its n-grams,
its score the weight plus Gumbel noise drawn from its id; the highest scores are a sample without replacement in
proportion to the weights.  Reruns draw the same documents.

The texts are read twice, to count and to score.  Each batch interns its n-grams in an open-addressed table
(``interning.Table``): the CRC of an n-gram is taken once per batch and kept with its count in its slot, and every occurrence
gathers its gain by slot id.  A task sends at most one count per bucket.  The driver sees the counts of all buckets and the
histogram of scores; both are bounded, by ``buckets`` and by the logarithms of counts (whole thousandths, under
150,000 values).  Ranks are counts of higher scores plus places within a score, so no task orders more than one score's documents.

Edge cases: a null text has no words; a document without n-grams weighs 0; a null id hashes as the empty text and comes last
among ties; rows equal in id and counts are ranked one after the other; a very long text is one block of
its own; without documents or without target texts all gains follow from zero counts; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from careframe.llm.common import stored, text_of
from careframe.llm.interning import Table, WordRuns, byte_blocks

BUCKETS, ORDER, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, "2024"


def _interned(words: WordRuns, order: int, buckets: int) -> Iterator[tuple[Table, np.ndarray, np.ndarray]]:
    """(table, bucket per slot, first n-gram per text) for runs of 1 to ``order`` words."""
    whole = memoryview(words.data)
    for n in range(1, order + 1):
        starts, ends, first = words.ngrams(n)
        table = Table(words.data, starts, ends)
        bucket = np.zeros(table.size, np.int32)
        bucket[table.used] = [zlib.crc32(whole[a:b]) % buckets for a, b in zip(
            starts[table.owner].tolist(), ends[table.owner].tolist())]
        yield table, bucket, first


def bucket_counts(docs: DataFrame, text_col: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many n-grams of all texts fall into each bucket that has any."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, raw, cuts in byte_blocks(batch.column(0)):
                for table, bucket, _ in _interned(WordRuns(raw, cuts), order, buckets):
                    total += np.bincount(bucket[table.used], table.counts, buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["bucket", "n"])

    return docs.select(text_of(text_col)).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_text_col: str = "text", order: int = ORDER,
          buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket; runs two jobs, which send one row per bucket to the driver."""
    counts = []
    for df, column in ((docs, text_col), (target, target_text_col)):
        found = np.zeros(buckets, np.int64)
        for row in bucket_counts(df, column, order, buckets).collect():
            found[row["bucket"]] = row["n"]
        counts.append(found.tolist())
    s_all, t_all = (float(sum(c) + buckets) for c in counts)
    return np.array([math.floor(1000.0 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(*counts)], np.int64)


def noise(id_col: Column, seed: str = SEED) -> Column:
    """Standard Gumbel noise of an id, in whole thousandths."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
          seed: str = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score, version) of every row; ``version`` is a hash of the text."""
    buckets = len(gain)

    def run(batches):
        for batch in batches:
            for row, raw, cuts in byte_blocks(batch.column(1)):
                words = WordRuns(raw, cuts)
                n, total = np.zeros(len(cuts) - 1, np.int64), np.zeros(len(cuts) - 1, np.int64)
                for table, bucket, first in _interned(words, order, buckets):
                    upto = np.concatenate(([0], np.cumsum(gain[bucket][table.slots])))
                    total += np.diff(upto[first])
                    n += np.diff(first)
                ids = batch.column(0).slice(row, len(n))
                yield pa.RecordBatch.from_arrays(
                    [ids, batch.column(2).slice(row, len(n)), pa.array(np.diff(words.first)), pa.array(n), pa.array(total // np.maximum(n, 1))],
                    names=["id", "version", "n_words", "n_features", "weight"])

    slim = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), F.xxhash64(text_col).alias("version"))
    found = slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, version long, n_words long, n_features long, weight long")
    return found.select("id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("id"), seed)).alias("score"), "version")


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3... by score for the drawn ``percent`` of the documents of ``least_words`` or more, else null.

    Reads the histogram of scores.  ``scored`` should be stored: it is read three times.
    """
    fit = F.col("n_words") >= least_words
    histogram = scored.filter(fit).groupBy("score").agg(F.count("*").alias("n")).collect()
    left = wanted = percent * sum(r["n"] for r in histogram) // 100
    above, cut = [], None
    for r in sorted(histogram, key=lambda r: -r["score"]):
        if left <= 0:
            break
        above.append((r["score"], wanted - left))
        left, cut = left - r["n"], r["score"]
    if cut is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    inside = fit & (F.col("score") >= cut)
    columns = scored.columns
    times = scored.filter(inside).groupBy(*columns).agg(F.count("*").alias("_times"))
    # One row per distinct score: bounded, see above.
    bases = F.broadcast(scored.sparkSession.createDataFrame(above, "_score long, _base long"))
    place = Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last(), *[c for c in columns if c not in ("id", "score")])
    upto = F.sum("_times").over(place.rowsBetween(Window.unboundedPreceding, 0))
    placed = times.withColumn("_upto", upto).join(bases, F.col("score") == F.col("_score"))
    ranked = placed.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), "_times")).alias("_i"),
                           (F.col("_base") + F.col("_upto") - F.col("_times")).alias("_at")).select(
        *columns, F.when(F.col("_at") + F.col("_i") <= wanted, F.col("_at") + F.col("_i")).alias("rank"))
    return ranked.unionByName(scored.filter(~inside).withColumn("rank", F.lit(None).cast("long")))


def score_and_draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   target_text_col: str = "text", order: int = ORDER, buckets: int = BUCKETS, percent: int = PERCENT,
                   least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score, version, rank) of every row; runs jobs."""
    gain = gains(docs, target, text_col, target_text_col, order, buckets)
    return draw(stored(weigh(docs, gain, id_col, text_col, order, seed), "resampling-scores"), percent, least_words)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The drawn rows of ``docs``, whole.  Rows equal in id and text are drawn together as soon as one of them is."""
    drawn = score_and_draw(docs, target, id_col, text_col, **options).filter("rank is not null").select("id", "version").distinct()
    return docs.join(drawn, docs[id_col].eqNullSafe(drawn["id"]) & (F.xxhash64(docs[text_col]) == drawn["version"]), "left_semi")
