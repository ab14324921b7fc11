"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a fixed pseudo-random order, offered ``rounds`` times.
A document's virtual finish time is its queue's cumulative words, this document included, divided
by the source's weight.  All queues are merged by virtual finish time and the merge is cut where the
total budget (as many words as the table holds) is reached.  A queue that runs out after
``rounds`` rounds leaves its share to the others by weight, so the cut falls where the capped targets
say it should.

Nothing is sorted or summed in one task: prefix sums run per slice of a source's order, and the
merge only orders the one slice of virtual time the budget ends in.

Edge cases: a null text has no words; a null source is a source of its own, last in order; a null
id is an id; documents without words finish with their predecessor and are taken as often as the cut
says, adding nothing; rows equal in id, source and text are one queue entry counted as often as
it occurs, and are taken equally often; an empty table gives an empty mix.  Other columns are carried along.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from careframe.llm.common import WORD, as_rows, stored, text_of

WEIGHTS = (5, 2, 1)
ROUNDS = 3
SEED = "mix-1"
SLICE_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def shuffle_key(id_col: str, text_col: str, seed: str = SEED) -> Column:
    """A 60-bit pseudo-random number of the row's id and text."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text_of(text_col))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def entries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
            seed: str = SEED) -> DataFrame:
    """Queue entries (source, key, id, size, times): one per different row, with how often it occurs."""
    return docs.select(
        F.col(source_col).alias("source"), shuffle_key(id_col, text_col, seed).alias("key"), F.col(id_col).alias("id"),
        word_count(text_of(text_col)).alias("size"),
    ).groupBy("source", "key", "id", "size").agg(F.count("*").alias("times"))


def targets(queue: DataFrame, weights: tuple[int, ...] = WEIGHTS, rounds: int = ROUNDS) -> DataFrame:
    """(source, rank, weight, source_size, level, target), one row per source.

    With ``level`` words per unit of weight a source wants level * weight, but at most rounds * its size.  The level at
    which all wants add up to the total is the largest over sources, in the order they reach their
    limit, of (what is left) / (weight left).  One row per source passes these windows, never documents.
    """
    sizes = queue.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    limits = sizes.withColumn("rank", rank).withColumn("weight", cycle).withColumn("limit", F.col("source_size") * rounds)
    order = Window.orderBy((F.col("limit") / F.col("weight")).asc(), "rank")
    full = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight_left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return limits.withColumn("_level", (F.sum("source_size").over(every) - full) / weight_left).withColumn(
        "level", F.max("_level").over(every)).select(
        "source", "rank", "weight", "source_size", "level",
        F.least(F.col("limit").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def schedule(queue: DataFrame, weights: tuple[int, ...] = WEIGHTS, rounds: int = ROUNDS) -> DataFrame:
    """``queue`` with rank, source_size, target, ``before`` / ``through`` (cumulative words) and ``copies`` taken.

    Runs three jobs: the queue is written to the shared folder, its totals are read, the cut is found.
    """
    spark = queue.sparkSession
    queue = stored(queue, "mix-queue")
    shares = stored(targets(queue, weights, rounds), "mix-shares")
    seen = queue.agg(F.count("*").alias("n"), F.sum(F.col("size") * F.col("times")).alias("words")).first()
    n, budget = seen["n"], seen["words"] or 0
    level = (shares.agg(F.max("level")).first()[0] or 0.0) if n else 0.0

    # Cumulative words of each queue: totals of slices of its order, then sums within a slice.
    parts = max(1, math.ceil(n / SLICE_ROWS))
    sliced = queue.withColumn("part", F.floor(F.col("key").cast("double") / float(1 << 60) * parts).cast("int"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sliced.groupBy("source", "part").agg(F.sum(F.col("size") * F.col("times")).alias("_total")).select(
        F.col("source").alias("_source"), F.col("part").alias("_part"),
        F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy("source", "part").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = sliced.withColumn("_through", F.sum(F.col("size") * F.col("times")).over(within))
    placed = placed.join(bases, placed["source"].eqNullSafe(bases["_source"]) & (F.col("part") == F.col("_part")))
    known = shares.withColumnRenamed("source", "_s").drop("level")
    placed = placed.join(known, placed["source"].eqNullSafe(known["_s"])).select(
        "source", "rank", "weight", "key", "id", "size", "times", "source_size", "target",
        (F.col("_base") + F.col("_through")).alias("through"))
    placed = stored(placed, "mix-placed")

    # Virtual finish times of all rounds, in slices of virtual time as wide as fair queueing makes them even.
    finish = F.expr(f"transform(sequence(0, {rounds - 1}), r -> (r * source_size + through) / weight)")
    offers = placed.select("rank", "key", "id", "size", (F.col("size") * F.col("times")).alias("words"),
                           F.explode(finish).alias("finish"))
    widths = max(1, math.ceil(rounds * n / SLICE_ROWS))
    offers = offers.withColumn("slot", F.least(F.lit(2 * widths), F.floor(
        F.col("finish") / F.lit(level or 1.0) * widths).cast("int")))
    upto = F.sum("words").over(Window.orderBy("slot"))
    first = offers.groupBy("slot").agg(F.sum("words").alias("words")).select(
        "slot", (upto - F.col("words")).alias("before"), upto.alias("after")).filter(
        F.col("after") > budget).orderBy("slot").limit(1).collect()
    if first:
        slot, before = first[0]["slot"], first[0]["before"]
        order = ["finish", "rank", "key", "id", "size"]
        running = F.lit(before) + F.sum("words").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        # The offer the budget ends in is taken if at least half of it fits.
        last = offers.filter(F.col("slot") == slot).withColumn("_middle", 2 * running - F.col("words")).filter(
            F.col("_middle") > 2 * budget).orderBy(*order).limit(1).collect()
    else:
        last = []
    if not last:
        slot_end = first[0]["slot"] if first else None
        taken = F.lit(True) if slot_end is None else F.col("_slot") <= slot_end
    else:
        cut = last[0]
        taken = (F.col("_finish") < cut["finish"]) | (
            (F.col("_finish") == cut["finish"]) & (F.struct("rank", "key", spread(F.col("id")).alias("id"), "size") < F.struct(
                F.lit(cut["rank"]).alias("rank"), F.lit(cut["key"]).alias("key"),
                spread(F.lit(cut["id"]).cast(placed.schema["id"].dataType)).alias("id"), F.lit(cut["size"]).alias("size"))))
    copies = F.lit(0)
    for r in range(rounds):
        at = (F.lit(r) * F.col("source_size") + F.col("through")) / F.col("weight")
        slot_at = F.least(F.lit(2 * widths), F.floor(at / F.lit(level or 1.0) * widths).cast("int"))
        probe = placed.select("*", at.alias("_finish"), slot_at.alias("_slot"))
        placed = probe.withColumn("copies_" + str(r), taken.cast("int")).drop("_finish", "_slot")
        copies = copies + F.col("copies_" + str(r))
    return placed.withColumn("copies", copies).drop(*["copies_" + str(r) for r in range(rounds)])


def spread(column: Column) -> Column:
    """Nulls first, as in an ascending window order."""
    return F.struct(column.isNotNull().alias("some"), column.alias("id"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken, range-partitioned and sorted by virtual finish time."""
    plan = schedule(entries(docs, id_col, text_col, source_col, seed), weights, rounds).filter("copies > 0").select(
        F.col("source").alias("_source"), F.col("key").alias("_key"), F.col("id").alias("_id"), "copies", "through",
        "source_size", "weight", "rank")
    rows = as_rows(docs, source=F.col(source_col), key=shuffle_key(id_col, text_col, seed), id=F.col(id_col))
    taken = rows.join(plan, (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id"))
                      & F.col("source").eqNullSafe(F.col("_source")))
    turns = F.expr("transform(sequence(0, copies - 1), r -> (r * source_size + through) / weight)")
    served = taken.select("row", "rank", "key", F.explode(turns).alias("finish"))
    return served.repartitionByRange("finish", "rank", "key").sortWithinPartitions("finish", "rank", "key").select("row.*")
