"""Records of delimited files whose quoted fields may hold line breaks, read in splits of any size.

Spark's own reader takes such a file as a whole.  Here a file is read line by line in its splits.  For each line two
expressions tell whether it ends inside quotes, once if it begins outside and once if it begins inside them; over many
lines that is again such a pair.  A first pass reduces every split to its pair (one row each) and a prefix over a file's splits tells
how each begins.  In the second pass every split puts its lines together from its first true record on; a record
that crosses splits is joined from one piece per split.  Lines without open quotes are records as they stand, taken over an Arrow batch
at a time.

What a split needs is one row, broadcast up to ``MOST_BROADCAST`` splits and joined by a sorted shuffle beyond.  Splits are
known by file and block, so both passes run in a session that is the caller's but for one fixed split size, ``SPLIT_BYTES`` at most, small
enough to give every core some of a batch of a few files.
Lines end in LF or CR LF; bytes that are no UTF-8 read as U+FFFD.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from careframe.session import pinned_session, work_folder

MOST_BROADCAST = 1_000_000
SPLIT_BYTES = 8 << 20
# What the second pass gives: records within one split, pieces of all others, or whatever begins in a split.
WHOLE, PIECES, BEGUN = range(3)

# A complete field, and a line's end inside a quoted one, once doubled quotes are left out.
_FIELD = '(?:"[^"]*+"[^,]*+|[^",][^,]*+|)'
_OPEN = '"[^"]*+$'
_OUTSIDE_IN = f"^(?:{_FIELD},)*+{_OPEN}"
_INSIDE_IN = f'^[^"]*+(?:$|"[^,]*+,(?:{_FIELD},)*+{_OPEN})'

PIECE = ("source_time timestamp, source_file string, split_start long, split_order long, begins boolean, ends boolean, record string")


def _line_states(line: Column) -> tuple[Column, Column]:
    """Whether a line ends inside quotes if it begins outside, and if it begins inside."""
    quoted, plain = F.contains(line, F.lit('"')), F.replace(F.regexp_replace(line, "\r$", ""), F.lit('""'), F.lit(""))
    return quoted & plain.rlike(_OUTSIDE_IN), ~quoted | plain.rlike(_INSIDE_IN)


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    out_in, in_in = _line_states(F.col("value"))
    return spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("split_start"),
        out_in.alias("out_in"), in_in.alias("in_in"), F.col("_metadata.file_modification_time").alias("source_time"),
        F.make_valid_utf8("value").alias("value"))


def _by_split(batches) -> Iterator[tuple[str, int, bool, pa.RecordBatch]]:
    """(file, block, last, rows): stretches of rows of one split; a split's rows are contiguous and in order."""
    held = None
    for batch in batches:
        files, blocks, n = batch.column(0), batch.column(1).to_numpy(), batch.num_rows
        other = pc.not_equal(files.slice(1), files.slice(0, max(n - 1, 0))).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(other | (blocks[1:] != blocks[:-1])) + 1
        bounds = [0, *edges.tolist(), n]
        for start, end in zip(bounds, bounds[1:]):
            if start == end:
                continue
            place = (files[start].as_py(), int(blocks[start]))
            if held is not None:
                yield *held[0], held[0] != place, held[1]
            held = place, batch.slice(start, end - start)
    if held is not None:
        yield *held[0], True, held[1]


def _ends_inside(out_in: np.ndarray, in_in: np.ndarray, inside: bool) -> np.ndarray:
    """For each line in order whether it ends inside quotes, the first beginning ``inside`` or not."""
    fixed, swaps = out_in == in_in, np.cumsum(out_in & ~in_in)
    last = np.maximum.accumulate(np.where(fixed, np.arange(len(fixed)), -1))
    since = np.where(last >= 0, swaps[last], 0)
    return np.where(last >= 0, out_in[last], inside) ^ ((swaps - since) % 2 == 1)


def _flags(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)


def _pairs(batches):
    """One row per split: how it ends if it begins outside quotes, and inside."""
    ends = [False, True]
    for file, block, last, batch in _by_split(batches):
        ends = [bool(_ends_inside(*_flags(batch), inside)[-1]) for inside in ends]
        if last:
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block]), pa.array([ends[0]]), pa.array([ends[1]])],
                                             names=["source_file", "split_start", "out_in", "in_in"])
            ends = [False, True]


def split_states(lines: DataFrame) -> DataFrame:
    """(source_file, split_start, inside): whether a split begins inside quotes.  One row per split."""
    pairs = lines.select("source_file", "split_start", "out_in", "in_in").mapInArrow(
        _pairs, "source_file string, split_start long, out_in boolean, in_in boolean")
    order = Window.partitionBy("source_file").orderBy("split_start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    swaps = pairs.withColumn("swaps", F.sum((F.col("out_in") & ~F.col("in_in")).cast("int")).over(order))
    fixed = F.when(F.col("out_in") == F.col("in_in"), F.struct(F.col("out_in").alias("inside"), "swaps"))
    known = swaps.select("source_file", "split_start", F.last(fixed, True).over(before).alias("fixed"),
                         F.coalesce(F.last("swaps").over(before), F.lit(0)).alias("swaps"))
    odd = (F.col("swaps") - F.coalesce("fixed.swaps", F.lit(0))) % 2 == 1
    return known.select("source_file", "split_start", (F.coalesce("fixed.inside", F.lit(False)) != odd).alias("inside"))


def _plain_records(lines: pa.Array) -> pa.Array:
    """Records of lines none of which ends inside quotes: all but the blank ones."""
    shown = pc.match_substring_regex(lines, "[!-~]").to_numpy(zero_copy_only=False).copy()
    for i in np.flatnonzero(~shown).tolist():
        shown[i] = bool(lines[i].as_py().strip())
    if not shown.all():
        lines = lines.filter(pa.array(shown))
    if pc.any(pc.ends_with(lines, "\r")).as_py():
        lines = pc.replace_substring_regex(lines, "\r\\z", "")
    return lines


def _put_together(wanted: int):
    """The records or pieces that are ``wanted``: ``WHOLE``, ``PIECES`` or ``BEGUN``."""

    def rows(time, file, block, orders, begins, ends, records):
        n = len(records)
        return pa.RecordBatch.from_arrays(
            [pa.repeat(time, n), pa.repeat(pa.scalar(file, pa.string()), n), pa.repeat(pa.scalar(block, pa.int64()), n),
             pa.array(orders, pa.int64()), pa.array(begins, pa.bool_()), pa.array(ends, pa.bool_()), records],
            names=["source_time", "source_file", "split_start", "split_order", "begins", "ends", "record"])

    def run(batches):
        place = None
        for file, block, last, batch in _by_split(batches):
            if place != (file, block):
                place, inside, order = (file, block), batch.column(4)[0].as_py(), 0
                begins, parts, header = not inside, [], block == 0
            time, after = batch.column(5)[0], _ends_inside(*_flags(batch), inside)
            if begins and not parts and not header and not after.any():
                inside, found = False, _plain_records(batch.column(6))
                if wanted != PIECES and len(found):
                    every = np.ones(len(found), bool)
                    yield rows(time, file, block, np.arange(order, order + len(found)), every, every, found)
                order += len(found)
                continue
            lines = batch.column(6).to_pylist()
            if header and lines[0].startswith("﻿") and order == 0 and not parts:
                lines[0] = lines[0][1:]
            inside = bool(after[-1])
            orders, records, pieces = [], [], []
            for line, open_ in zip(lines, after.tolist()):
                if not parts and begins and not open_ and not line.strip():
                    continue  # a blank line between records
                parts.append(line)
                if open_:
                    continue
                if header:
                    header = False  # the first record of a file names its columns
                elif begins:
                    orders.append(order)
                    records.append("\n".join(parts).removesuffix("\r"))
                    order += 1
                else:
                    pieces.append((-1, False, True, "\n".join(parts).removesuffix("\r")))
                begins, parts = True, []
            if last and parts:
                pieces.append((order if begins else -1, begins, False, "\n".join(parts)))
            if wanted != PIECES:
                begun = [p for p in pieces if p[1]] if wanted == BEGUN else []
                pieces = [(o, True, True, r) for o, r in zip(orders, records)] + begun
            if pieces:
                orders, starts, ends, texts = zip(*pieces)
                yield rows(time, file, block, orders, starts, ends, pa.array(texts, pa.string()))

    return run


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source_time, source_file, split_start, split_order, record): the text of every record but each file's first, which
    is its header, and blank lines.  ``split_order`` counts the records that begin in a split.  Runs the job of the first pass."""
    own = pinned_session(spark)
    largest = own._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    own.conf.set("spark.sql.files.maxPartitionBytes", str(min(largest, SPLIT_BYTES)))
    place = work_folder(own, "record-splits")
    split_states(_lines(own, path)).write.parquet(place)
    states = own.read.schema("source_file string, split_start long, inside boolean").parquet(place)
    shape = ["source_file", "split_start", "out_in", "in_in", "inside", "source_time", "value"]
    if states.count() <= MOST_BROADCAST:
        placed = _lines(own, path).join(F.broadcast(states), ["source_file", "split_start"]).select(*shape)
    else:
        numbered = _lines(own, path).withColumn("line", F.monotonically_increasing_id())
        placed = numbered.join(states, ["source_file", "split_start"]).repartition("source_file", "split_start").sortWithinPartitions(
            "source_file", "split_start", "line").select(*shape)
    columns = ["source_time", "source_file", "split_start", "split_order", "record"]
    if not states.filter("inside").limit(1).count():
        # No record crosses splits: one pass gives all, and the piece that a file leaves if it ends inside quotes.
        return placed.mapInArrow(_put_together(BEGUN), PIECE).select(*columns)
    records, pieces = (placed.mapInArrow(_put_together(wanted), PIECE) for wanted in (WHOLE, PIECES))
    # At most two pieces per split: one that began earlier, one that goes on.
    number = F.sum(F.col("begins").cast("int")).over(Window.partitionBy("source_file").orderBy("split_start", "split_order"))
    joined = pieces.withColumn("number", number).groupBy("source_file", "number").agg(
        F.min("source_time").alias("source_time"), F.min("split_start").alias("split_start"),
        F.max("split_order").alias("split_order"), F.max("begins").alias("begun"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split_start", "split_order", "record"))), lambda x: x["record"]), "\n").alias("record"))
    return records.select(*columns).unionByName(joined.filter("begun").select(*columns))
