"""Language-model scores from n-gram counts kept in Elias-Fano tries.

Documents are dealt to blocks of bounded size by a hash.  A block sends every different word and n-gram it holds, with its
training counts, to the shard the n-gram's hash names, packed as one Elias-Fano sequence per block and shard.  A
shard adds up the counts of all blocks, builds its part of the trie, and answers every block's list in its own
order: exact counts for words, quantised frequencies for longer n-grams.  The block then scores its documents.
Texts travel to their block as compressed record batches.
Common contexts are spread over all shards, since shards are named by whole n-grams.

A word's probability is interpolated with ``PRIOR`` pseudo-counts of the shorter context's probability,
p(w | c) = (n(c w) + PRIOR * p(w | shorter c)) / (n(c) + PRIOR); the first level is (n(w) + 1/2) / (N + (V + 1) / 2).  It
adds up to one over the vocabulary and an unknown word.  Words are lower-cased (A-Z) and known by 64-bit hashes, and so
is a longer n-gram.  Inside its shard, whose size is bounded, 24 bits of its context and 24 of its last word tell it from the others.

Edge cases: a null text is the empty text, one end token; null ids are ids and are learnt from; repeated rows
are scored alike and counted as often as they occur; without training rows every count is 0; an
empty table stays empty; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from careframe.llm.common import free_shuffles, stored, text_batches, text_of
from careframe.llm.elias_fano import EliasFano, Level, frequency
from careframe.llm.words import blocks, mix

ORDER = 2
PRIOR = 50.0
BLOCK_CHARS = 5_000_000
SHARD_CHARS = 6_000_000
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_NEXT = np.uint64(0x9E3779B97F4A7C15)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never learnt from: those whose crc32 of the id, as text, leaves 1 when divided by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(False))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes of all rows in order, each row's words then its end; first token of every row and the total)."""
    parts, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, words in blocks(texts, lower=True):
        parts.append(np.insert(words.hashes, words.first[1:], END))
        sizes.append(np.diff(words.first) + 1)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def keys(found: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """Per n-gram length 1 .. order, the key of the n-gram ending at every token; the text's beginning is a token.

    Keys of longer n-grams: 24 bits of the context, 24 of the word, 16 of both that serve only to choose the shard.
    """
    out, context = [found], np.zeros(len(found), np.uint64)
    word = mix(found)
    earlier = found
    for _ in range(1, order):
        earlier = np.concatenate([[BEGIN], earlier[:-1]]).astype(np.uint64)
        earlier[first[:-1]] = BEGIN
        context = mix(context * _NEXT + earlier)
        rest = (context ^ word) & np.uint64(0xFFFF)
        out.append((context >> np.uint64(40) << np.uint64(40)) | (word >> np.uint64(40) << np.uint64(16)) | rest)
    return out


def shard_of(key: np.ndarray, length: int, shards: int) -> np.ndarray:
    return (mix(key + np.uint64(length)) % np.uint64(shards)).astype(np.int64)


def by_shard(key: np.ndarray, length: int, shards: int):
    """(different keys in order of shard and key, place of every key among them, bounds of the shards)."""
    different, place = np.unique(key, return_inverse=True)
    shard = shard_of(different, length, shards)
    order = np.argsort(shard, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return different[order], rank[place], np.searchsorted(shard[order], np.arange(shards + 1))


def level_keys(sent: np.ndarray) -> np.ndarray:
    """Keys of longer n-grams, as a shard receives them, with the context in the upper half."""
    return (sent >> np.uint64(24) << np.uint64(32)) | (sent & np.uint64(0xFFFFFF))


def packed(dealt: DataFrame) -> DataFrame:
    """(block, data): the rows that a batch holds of each block, as one compressed record batch."""
    def run(batches):
        squeeze = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            block = np.asarray(batch.column("block"))
            rows = batch.take(pa.array(np.argsort(block, kind="stable")))
            names, sizes = np.unique(block, return_counts=True)
            data = []
            for end, n in zip(np.cumsum(sizes), sizes):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=squeeze) as out:
                    out.write_batch(rows.slice(end - n, n))
                data.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(data, pa.binary())], names=["block", "data"])

    return text_batches(dealt).mapInArrow(run, "block long, data binary")


def unpacked(table: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x.as_py()).read_all() for x in table["data"]])


def ask(table: pa.Table, shards: int, order: int) -> pa.Table:
    """One block's lists: (block, length, shard, keys, counts)."""
    found, first = tokens(table["text"].combine_chunks())
    learn = np.repeat(np.asarray(table["learn"].combine_chunks()), np.diff(first))
    block, rows = table["block"][0].as_py(), []
    for length, key in enumerate(keys(found, first, order), 1):
        different, place, bounds = by_shard(key, length, shards)
        counts = np.bincount(place, weights=learn, minlength=len(different)).astype(np.uint32)
        for shard in range(shards):
            low, high = bounds[shard], bounds[shard + 1]
            if low < high:
                sent = different[low:high] >> np.uint64(0 if length == 1 else 16)
                rows.append((block, length, shard, EliasFano.of(sent).to_bytes(), pa.compress(counts[low:high].tobytes(), "zstd", asbytes=True)))
    return pa.table([pa.array(x, t) for x, t in zip(zip(*rows), (
        pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["block", "length", "shard", "keys", "counts"])


def answer(table: pa.Table) -> pa.Table:
    """One shard: add up all blocks' counts, build the trie, answer every list; plus one row of totals."""
    shard, out = table["shard"][0].as_py(), []
    for length in sorted(set(table["length"].to_pylist())):
        part = table.filter(pc.equal(table["length"], length))
        lists = [EliasFano.from_buffer(x.as_py()).values() for x in part["keys"]]
        different, place = np.unique(np.concatenate(lists), return_inverse=True)
        counts = np.zeros(len(different), np.int64)
        np.add.at(counts, place, np.frombuffer(b"".join(
            pa.decompress(x.as_py(), 4 * len(keys), "zstd", asbytes=True) for x, keys in zip(part["counts"], lists)), np.uint32))
        seen = counts > 0
        if length == 1:
            answers = np.split(counts[place], np.cumsum([len(x) for x in lists])[:-1])
            out.append((-1, length, shard, b"", int(seen.sum()), int(counts.sum())))
        else:
            level = Level(level_keys(different[seen]), counts[seen])
            answers = [level.look_up(level_keys(x)) for x in lists]
        out += [(b, length, shard, x.tobytes(), 0, 0) for b, x in zip(part["block"].to_pylist(), answers)]
    return pa.table([pa.array(x, t) for x, t in zip(zip(*out), (
        pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()))],
        names=["block", "length", "shard", "answer", "seen", "total"])


def judge(table: pa.Table, answers: pa.Table, shards: int, order: int, total: int, vocabulary: int) -> pa.Table:
    """One block's documents with their scores."""
    found, first = tokens(table["text"].combine_chunks())
    held: dict[int, dict[int, bytes]] = {}
    for length, shard, data in zip(*(answers[c].to_pylist() for c in ("length", "shard", "answer"))):
        held.setdefault(length, {})[shard] = data
    known, scores, context = None, None, None
    for length, key in enumerate(keys(found, first, order), 1):
        _, place, _ = by_shard(key, length, shards)
        data = b"".join(held[length][s] for s in sorted(held[length]))
        if length == 1:
            counts = np.frombuffer(data, np.int64)[place].astype(np.float64)
            known, scores = counts, (counts + 0.5) / (total + 0.5 * (vocabulary + 1))
            base = np.log10(scores)
            ends = counts[first[1:] - 1]  # how often a text ended, and so began
        else:
            counts = frequency(np.frombuffer(data, np.uint16)[place])
            scores = (counts + PRIOR * scores) / (context + PRIOR)
        # The next length's context is this n-gram, one token earlier.
        context = np.concatenate([[0.0], counts[:-1]])
        context[first[:-1]] = ends
    total_of = lambda x: np.add.reduceat(x, first[:-1])
    return pa.table({
        "id": table["id"], "learn": table["learn"], "n_tokens": np.diff(first), "n_known": total_of((known > 0).astype(np.int64)),
        "train_tokens": np.full(len(table), total, np.int64), "base_score": total_of(base), "score": total_of(np.log10(scores))})


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(id, learn, n_tokens, n_known, train_tokens, base_score, score) of every row, learnt from the rows ``learn`` marks.

    Runs jobs: the size of the texts is added up, the shards' answers are written to the shared folder, their totals are read.
    """
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length(text_of(text_col)))).first()[0] or 0
    n_blocks, shards = max(1, math.ceil(chars / BLOCK_CHARS)), max(1, math.ceil(chars / SHARD_CHARS))
    dealt = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), learn.alias("learn"), F.pmod(
        F.xxhash64(id_col, text_col), F.lit(n_blocks)).alias("block"))
    sent = packed(dealt)
    asked = sent.groupBy("block").applyInArrow(
        lambda t: ask(unpacked(t), shards, order), "block long, length int, shard int, keys binary, counts binary")
    answers = stored(asked.groupBy("shard").applyInArrow(
        answer, "block long, length int, shard int, answer binary, seen long, total long"), "ngram-answers")
    free_shuffles(spark)
    sums = answers.filter("block < 0").agg(F.sum("seen").alias("seen"), F.sum("total").alias("total")).first()
    vocabulary, total = sums["seen"] or 0, sums["total"] or 0
    id_type = dealt.schema["id"].dataType.simpleString()
    return sent.groupBy("block").cogroup(answers.filter("block >= 0").groupBy("block")).applyInArrow(
        lambda t, a: judge(unpacked(t), a, shards, order, total, vocabulary),
        f"id {id_type}, learn boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
