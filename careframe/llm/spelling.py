"""Spelling variants: words one letter apart, grouped under their most frequent forms, by finite-state composition.

The vocabulary grows with the corpus, so it is never in one place.  Two words one edit apart share their first half or all that
follows it: for the shorter word's length ``m`` they agree in the first ``m // 2`` letters or in the last ``m - m // 2``.  Each such half
is an initial state: what remains of its words (read backwards behind a shared ending) is one word list of a task's minimised
acceptor, which is composed with a one-edit transducer and itself (``automata``); accepted pairs are enumerated per
initial state.  A pair that shares both halves is taken from the first only, so every pair is found once.

An initial state with more than ``LIMIT`` words is replaced, one letter at a time, by its successor states and, for the edits made
at the state itself, by one small state per remaining word: pairs are neither lost nor compared within the large state.
A task emits at most one row per word and initial state: number of near words and the best of them.  Forms are at least
``ratio`` times as frequent as their words, so chains of forms are logarithmically short; roots are found by pointer jumping.

Edge cases: a null or empty text has no words; a null id counts as the empty text in the check that alters runs; repeated rows
count again; ties go to the smaller word in code-point order; words as long as a text are rows like others; an empty table has
no words; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from careframe.llm.automata import Acceptor, OneEdit, letters_of
from careframe.llm.common import stored, text_of

RUN = "[A-Za-z\\u00C0-\\u00FF]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAST_LETTERS, LEAST_COUNT, RATIO = 5, 3, 2
LIMIT = 100_000  # words of one initial state
BLOCK_ROWS, BLOCK_LETTERS = 50_000, 1 << 21

STATE = ["m", "side", "key"]


def altered(run: Column, id_col: Column, every: int) -> Column:
    """``run`` without one letter where the CRC of ``<id>:<run>`` is divisible by ``every``."""
    h = F.crc32(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS,
               least_count: int = LEAST_COUNT, alter_every: int | None = None) -> DataFrame:
    """(word, n): runs of letters of at least ``least_letters``, A-Z lower-cased, that occur ``least_count`` times or more."""
    # A shorter run cannot become a longer word.
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(
        text_of(text_col), F.lit(f"{RUN}{{{least_letters},}}"), F.lit(0))).alias("run"))
    low = runs.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", CAPITALS, CAPITALS.lower())).otherwise(
        F.col("run")).alias("run"))
    word = altered(F.col("run"), F.col("id"), alter_every) if alter_every else F.col("run")
    return low.select(word.alias("word")).filter(F.length("word") >= least_letters).groupBy("word").agg(
        F.count("*").alias("n")).filter(F.col("n") >= least_count)


def initial_states(words: DataFrame, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """(m, side, key, rest, word, n): a word under every half it may share with a near word; ``rest`` is what is left to read."""
    size, half = F.length("word"), F.expr("m div 2")
    lengths = words.withColumn("m", F.explode(F.when(size > least_letters, F.array(size - 1, size)).otherwise(F.array(size))))
    begin = F.struct(F.lit("begin").alias("side"), F.substring("word", F.lit(1), half.cast("int")).alias("key"),
                     F.substring("word", (half + 1).cast("int"), size).alias("rest"))
    tail = (F.col("m") - half).cast("int")
    end = F.struct(F.lit("end").alias("side"), F.substring("word", (size - tail + 1).cast("int"), tail).alias("key"),
                   F.reverse(F.substring("word", F.lit(1), size - tail)).alias("rest"))
    return lengths.select("m", "word", "n", F.explode(F.array(begin, end)).alias("x")).select("m", "x.*", "word", "n")


def _deeper(rows: DataFrame) -> DataFrame:
    """Rows of too large states under their successor states, and under one state per edit made right here."""
    rest, key, size = F.col("rest"), F.col("key"), F.length("rest")
    after = F.substring(rest, F.lit(2), size)
    # "\\0" is in no word, so these keys meet no others.
    onward = F.when(size > 0, F.struct(F.col("side").alias("side"), F.concat(key, F.substring(rest, 1, 1)).alias("key"), after.alias("rest")))
    short = F.length("word") == F.col("m")
    replace = F.when(short & (size > 0), F.struct(F.concat(F.col("side"), F.lit("=")).alias("side"), F.concat(
        key, F.lit("\0"), after).alias("key"), F.substring(rest, 1, 1).alias("rest")))
    without = F.when(short, F.struct(F.concat(F.col("side"), F.lit("+")).alias("side"), F.concat(key, F.lit("\0"), rest).alias("key"), F.lit("").alias("rest")))
    # The inserted letter differs from what it is put before, else the words differ further on.
    put = F.when(~short & (F.substring(rest, 1, 1) != F.substring(rest, 2, 1)), F.struct(F.concat(F.col("side"), F.lit("+")).alias("side"), F.concat(
        key, F.lit("\0"), after).alias("key"), F.substring(rest, 1, 1).alias("rest")))
    states = F.filter(F.array(onward, replace, without, put), lambda x: x.isNotNull())
    return rows.select("m", "word", "n", F.explode(states).alias("x")).select("m", "x.*", "word", "n")


def split_states(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``rows`` with every state of more than ``limit`` words replaced by smaller ones.  Runs a counting job, and one more per letter
    by which large states are followed."""
    done, open_ = None, rows
    while True:
        large = stored(open_.groupBy(*STATE).agg(F.count("*").alias("size")).filter(
            (F.col("size") > limit) & F.col("side").isin("begin", "end")).select(*STATE, F.lit(True).alias("large")), "spelling-states")
        if not large.limit(1).count():
            return open_ if done is None else done.unionByName(open_)
        small = open_.join(large, STATE, "left_anti")
        done = small if done is None else done.unionByName(small)
        open_ = stored(_deeper(open_.join(large, STATE, "left_semi")), "spelling-deeper")


def _blocks(batches) -> Iterator[tuple[int, str, np.ndarray, list[str], list[str], np.ndarray]]:
    """(m, side, state numbers, rests, words, counts) of consecutive whole states of one ``m`` and side."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table):
        m, side = table.column(0).to_numpy(), table.column(1).to_pylist()
        keys = table.column(2).to_pylist()
        rests, words, counts = table.column(3).to_pylist(), table.column(4).to_pylist(), table.column(5).to_numpy()
        fresh = np.array([True] + [keys[i] != keys[i - 1] or side[i] != side[i - 1] or m[i] != m[i - 1] for i in range(1, len(keys))])
        number = np.cumsum(fresh)
        starts = np.flatnonzero(fresh).tolist() + [len(keys)]
        begin = 0
        for s in range(1, len(starts)):
            at, end = starts[s], starts[s] == len(keys)
            size = (starts[s + 1] if not end else at) - begin
            if end or m[at] != m[begin] or side[at] != side[begin] or size > BLOCK_ROWS or size * int(m[begin]) > BLOCK_LETTERS:
                yield int(m[begin]), side[begin], number[begin:at], rests[begin:at], words[begin:at], counts[begin:at]
                begin = at

    size = 0
    for batch in batches:
        # Hold back the last state: it may go on in the next batch.
        held.append(batch)
        size += batch.num_rows
        if size < BLOCK_ROWS:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = [table.column(c)[-1].as_py() for c in range(3)]
        keep = table.num_rows
        while keep and [table.column(c)[keep - 1].as_py() for c in range(3)] == last:
            keep -= 1
        if keep:
            yield from cut(table.slice(0, keep))
        held = table.slice(keep).to_batches()
        size = table.num_rows - keep
    if size:
        yield from cut(pa.Table.from_batches(held).combine_chunks())


def _accepted(batches) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """(words, counts, rows, rows): the near pairs of each block."""
    for m, side, groups, rests, words, counts in _blocks(batches):
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        left, right = OneEdit(Acceptor(groups, rests, np.where(sizes == m, 1, 2))).pairs()
        if side.startswith("end") and len(left):
            # Words that share the first half as well are found there.
            some = np.unique(np.concatenate((left, right)))
            half, _ = letters_of([words[i][:m // 2] for i in some])
            other = (half[np.searchsorted(some, left)] != half[np.searchsorted(some, right)]).any(axis=1)
            left, right = left[other], right[other]
        if len(left):
            yield words, counts, left, right


def _links(batches):
    for words, _, left, right in _accepted(batches):
        names = pa.array(words, pa.string())
        for i in range(0, len(left), 100_000):
            yield pa.RecordBatch.from_arrays([names.take(pa.array(x[i:i + 100_000])) for x in (left, right)], names=["word", "near"])


def _bests(batches):
    for words, counts, left, right in _accepted(batches):
        one, two = np.concatenate((left, right)), np.concatenate((right, left))
        rank = np.empty(len(words), np.int64)
        rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        order = np.lexsort((rank[two], -counts[two], one))
        one, two = one[order], two[order]
        first = np.flatnonzero(np.append(True, one[1:] != one[:-1]))
        names = pa.array(words, pa.string())
        yield pa.RecordBatch.from_arrays(
            [names.take(pa.array(one[first])), pa.array(np.diff(np.append(first, len(one)))), pa.array(counts[two[first]]),
             names.take(pa.array(two[first]))], names=["word", "n_near", "best_n", "best"])


def _placed(words: DataFrame, least_letters: int, limit: int) -> DataFrame:
    """Words under their initial states, each state whole in one task and in order."""
    rows = split_states(initial_states(words, least_letters), limit)
    return rows.repartition(*STATE).sortWithinPartitions(*STATE, "rest").select(
        F.col("m").cast("long").alias("m"), "side", "key", "rest", "word", F.col("n").cast("long").alias("n"))


def links(words: DataFrame, least_letters: int = LEAST_LETTERS, limit: int = LIMIT) -> DataFrame:
    """(word, near): every pair of ``words`` (word, n) one inserted, deleted or replaced letter apart, once."""
    return _placed(words, least_letters, limit).mapInArrow(_links, "word string, near string")


def forms(words: DataFrame, least_letters: int = LEAST_LETTERS, ratio: int = RATIO, limit: int = LIMIT) -> DataFrame:
    """``words`` (word, n; stored, as they are read twice) with n_near, form and form_n: the near word of largest n, if that is at least
    ``ratio`` times the word's."""
    found = _placed(words, least_letters, limit).mapInArrow(_bests, "word string, n_near long, best_n long, best string")
    none = F.lit(None)
    rows = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), none.cast("struct<down:bigint,best:string>").alias("best")).unionAll(
        found.select("word", none.cast("long"), "n_near", F.struct((-F.col("best_n")).alias("down"), "best")))
    best = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    form = -F.col("best.down") >= ratio * F.col("n")
    return best.select("word", "n", "n_near", F.when(form, F.col("best.best")).alias("form"), F.when(form, -F.col("best.down")).alias("form_n"))


def with_roots(found: DataFrame) -> DataFrame:
    """``found`` (of ``forms``, stored) with ``root``: the last word of its chain of forms.  A job per doubling of the longest chain."""
    pointers = found.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = pointers.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumped = stored(pointers.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                                 F.col("further").isNotNull().alias("moved")), "spelling-roots")
        pointers = jumped.select("word", "root")
        if not jumped.filter("moved").limit(1).count():
            break
    return found.join(pointers, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS,
             least_count: int = LEAST_COUNT, ratio: int = RATIO, alter_every: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs``; runs jobs."""
    words = stored(vocabulary(docs, id_col, text_col, least_letters, least_count, alter_every), "spelling-words")
    found = stored(forms(words, least_letters, ratio), "spelling-forms")
    return with_roots(found).select("word", "form", "root", "n", "n_near", "form_n")
