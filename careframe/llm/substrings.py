"""Substring deduplication by relative Lempel-Ziv factors over indexed reference blocks.

Every window of ``LEAST`` words is anchored at the smallest hash among its ``GRAM``-word grams (the rightmost of equals), so
equal windows have equal anchors at equal places.  Consecutive windows with one anchor form a block; every
block of the corpus is indexed by its anchor's hash and by the hash of all its words.  A
document is factored greedily against that index: as long as its next block stands in the index a
second time, the factor grows by the whole block.  Where a block is not found whole but its anchor is
known, a factor ends or begins inside it: there, and only there, windows are looked up one by one, against the other
different blocks with that anchor.  Words covered by factors of ``LEAST`` words or more go, wherever they occur, the
first occurrence included.

Blocks are about one per 12 words.  Rows are shuffled by hashes of contents, pre-aggregated; only blocks whose
anchor occurs twice travel further.  Runs of equal blocks, as in groups of copies, are looked at once.

Edge cases: a null text has no words; texts of fewer than ``LEAST`` words lose none; a window
that occurs twice in one document is a repeat; rows equal in id and text count as two occurrences of all their
windows; null ids are ids; an empty table stays empty; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from careframe.llm.common import free_shuffles, stored, text_batches, text_of
from careframe.llm.words import Spans, Words, blocks, mix

LEAST = 35
GRAM = 8
SECOND_BASE = 0x8EBC6AF09C88C6E3


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest, then rightmost, gram in every run of ``width`` grams, by doubling."""
    value, place, span = grams, np.arange(len(grams)), 1

    def lower(shift: int):
        right = value[shift:] <= value[:len(value) - shift]
        return (np.where(right, value[shift:], value[:len(value) - shift]),
                np.where(right, place[shift:], place[:len(place) - shift]))

    while span * 2 <= width:
        value, place = lower(span)
        span *= 2
    if width > span:
        value, place = lower(width - span)
    return place


def indexed(words: Words, least: int) -> tuple[np.ndarray, ...] | None:
    """(anchor hash, block hash, document, first window within it, number of windows) of every block."""
    n = len(words.hashes)
    if n < least:
        return None
    gram = min(GRAM, least)
    spans, starts = Spans(words.hashes), np.arange(n - gram + 1)
    grams = spans.hashes(starts, starts + gram)
    place = anchors(grams, least - gram + 1)
    doc = words.document()
    windows = np.flatnonzero(doc[:n - least + 1] == doc[least - 1:])
    if not len(windows):
        return None
    at = place[windows]
    new = np.ones(len(windows), bool)
    new[1:] = (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(windows)))
    begin, anchor = windows[first], at[first]
    whole = Spans(words.hashes, SECOND_BASE).hashes(begin, begin + length + least - 1)
    block = mix(whole + (anchor - begin).astype(np.uint64))
    owner = doc[begin]
    return grams[anchor], block, owner, begin - words.first[owner], length


def _id(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("version"), text_of(text_col).alias("text"))


def block_rows(texts: DataFrame, least: int) -> DataFrame:
    """(anchor, block, id, version, at): ``at`` packs the block's first window and its number of windows."""
    def run(batches):
        for batch in batches:
            for row, words in blocks(batch.column(2)):
                found = indexed(words, least)
                if found:
                    anchor, block, owner, begin, length = found
                    rows = pa.array(owner + row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor.view(np.int64)), pa.array(block.view(np.int64)), batch.column(0).take(rows),
                         batch.column(1).take(rows), pa.array(begin * least + length - 1)],
                        names=["anchor", "block", "id", "version", "at"])

    schema = f"anchor long, block long, id {texts.schema['id'].dataType.simpleString()}, version long, at long"
    return text_batches(texts).mapInArrow(run, schema)


def window_rows(texts: DataFrame, checks: DataFrame, least: int) -> DataFrame:
    """(h1, h2, id, version, start) of every window of the blocks listed per document in ``checks``."""
    joined = checks.join(texts, checks["_id"].eqNullSafe(texts["id"]) & (checks["_version"] == texts["version"])).select(
        "id", "version", "text", "blocks")

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            for row, words in blocks(batch.column(2)):
                part = lists.slice(row, len(words))
                at = np.asarray(part.flatten(), np.int64)
                sizes = np.asarray(part.value_lengths())
                first, length = at // least, at % least + 1
                owner = np.repeat(np.arange(len(words)), sizes)
                start = np.repeat(first, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
                owner = np.repeat(owner, length)
                place = words.first[owner] + start
                h1 = Spans(words.hashes).hashes(place, place + least)
                h2 = Spans(words.hashes, SECOND_BASE).hashes(place, place + least)
                rows = pa.array(owner + row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows),
                     pa.array(start)], names=["h1", "h2", "id", "version", "start"])

    return joined.mapInArrow(run, f"h1 long, h2 long, id {texts.schema['id'].dataType.simpleString()}, version long, start long")


def factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(id, version, start, length): runs of words to remove; those of one document may overlap.

    Runs jobs; intermediate tables go to the shared folder.
    """
    spark = docs.sparkSession
    texts = _id(docs, id_col, text_col)
    rows = block_rows(texts, least)
    known = rows.groupBy("anchor").agg(F.count("*").alias("n"), F.min("block").alias("low"), F.max("block").alias("high")).filter(
        "n > 1").select("anchor", (F.col("low") != F.col("high")).alias("mixed"))
    met = stored(rows.join(known, "anchor"), "blocks")
    free_shuffles(spark)

    one = F.struct("id", "version", "at")
    times = stored(met.groupBy("anchor", "block", "mixed").agg(F.count("*").alias("n"), F.min(one).alias("one")), "block-counts")
    twice = times.filter("n > 1").select("anchor", "block")
    whole = stored(met.join(twice, ["anchor", "block"], "left_semi").select(
        "id", "version", F.floor(F.col("at") / least).alias("start"), (F.col("at") % least + least).alias("length")), "whole-blocks")

    # Inside a block that occurs once, windows may still repeat; of repeated blocks one stands for all.
    checks = times.filter("mixed").select(F.col("one.id").alias("_id"), F.col("one.version").alias("_version"), F.col("one.at").alias("at"))
    lists = checks.groupBy("_id", "_version").agg(F.sort_array(F.collect_list("at")).alias("blocks"))
    windows = stored(window_rows(texts, lists, least), "windows")
    free_shuffles(spark)
    place = F.struct("id", "version", "start")
    found = windows.groupBy("h1", "h2").agg(F.min(place).alias("low"), F.max(place).alias("high")).filter(
        "low != high").select("h1", "h2")
    single = windows.join(found, ["h1", "h2"], "left_semi").select("id", "version", "start", F.lit(least).cast("long").alias("length"))
    return whole.union(single)


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(id, n_words, n_removed, kept): every row's kept words joined by single spaces."""
    spans = stored(factors(docs, id_col, text_col, least), "factors").groupBy("id", "version").agg(
        F.collect_set(F.struct("start", "length")).alias("spans")).select(
        F.col("id").alias("_id"), F.col("version").alias("_version"), "spans")
    free_shuffles(docs.sparkSession)
    texts = _id(docs, id_col, text_col)
    joined = texts.join(spans, F.col("id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version")), "left").select(
        "id", "text", "spans")

    def run(batches):
        for batch in batches:
            for row, words in blocks(batch.column(1)):
                part = batch.slice(row, len(words))
                lists = part.column(2)
                cover = np.zeros(len(words.hashes) + 1, np.int64)
                if len(flat := lists.flatten()):
                    sizes = np.asarray(lists.value_lengths().fill_null(0))
                    start = np.repeat(words.first[:-1], sizes) + np.asarray(flat.field("start"))
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + np.asarray(flat.field("length")), -1)
                kept = np.cumsum(cover[:-1]) == 0
                n = np.diff(words.first)
                left = np.add.reduceat(np.append(kept, False), words.first[:-1]) * (n > 0) if len(n) else n
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n.astype(np.int64)), pa.array((n - left).astype(np.int64)), joined_words(words, kept)],
                    names=["id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, n_words long, n_removed long, kept string")


def joined_words(words: Words, kept: np.ndarray) -> pa.Array:
    """Kept words of every document with one space between, copied as bytes without a loop over words."""
    doc = words.document()[kept]
    lengths = (words.ends - words.starts)[kept]
    first = np.ones(len(doc), bool)
    first[1:] = doc[1:] != doc[:-1]
    room = lengths + ~first  # a space before every word but a document's first
    begin = np.cumsum(room) - room + ~first
    out = np.full(int(room.sum()), 0x20, np.uint8)
    step = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(begin, lengths) + step] = words.data[np.repeat(words.starts[kept], lengths) + step]
    cuts = np.concatenate([[0], np.cumsum(np.bincount(doc, weights=room, minlength=len(words)).astype(np.int64))])
    return pa.Array.from_buffers(pa.large_string(), len(words), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(out)]).cast(pa.string())
