"""Near-duplicate documents by DartMinHash signatures and banded joining.

Equal texts are one text.  Every text's signature is cut into bands; texts that share a band meet in a bucket.
In a bucket of at most ``ALL_PAIRS`` texts every two are compared.  A larger one is compared with its ``LEADERS``, the
texts that meet most others over all bands, and then, while it holds several classes, with the leaders of
its ``LEADERS`` busiest other classes, for ``ROUNDS`` rounds.  That only joins most texts cheaply; whichever two of a
bucket are in different classes then are compared too, so no pair that shares a band is left out.  Compared means
exactly: the Jaccard similarity of their five-word shingles must be ``LEAST`` or more.  Two texts one of which has less than
``LEAST`` times the other's different shingles cannot reach it and are never brought together; of the last pairs neither are
those whose parity sketches differ in more bits than similar texts differ in shingles, which is proof that they are not similar.
Classes are the connected components of all links.

Two texts at the threshold share none of the 22 bands once in 7 million times; closer ones less often.

Edge cases: a null text is the empty text; texts of one to four words are one shingle; texts without
words are alike only if equal; texts of any length are compared whole; null ids and repeated rows are documents like others; an empty table gives an empty
result; other columns are ignored, or carried along by ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from careframe.llm import minhash
from careframe.llm.common import as_rows, free_shuffles, stored, text_batches, text_of
from careframe.llm.components import components
from careframe.llm.words import BLOCK_BYTES, blocks, stretches

LEAST = 0.8
ROWS = 3
ALL_PAIRS = 32
LEADERS = 4
ROUNDS = 2
# Rows of a bucket whose last pairs are made in one task.
PART = 1024
# Bits, as a power of two, of the bitmap that says which texts are wanted: 16 MB.
MARK_BITS = 27


def text_key(text_col: str) -> Column:
    return F.unhex(F.md5(text_of(text_col)))


def band_lists(texts: DataFrame, by_count: bool = False) -> DataFrame:
    """(key, size, bands) of every text (key, text), each once: its units of weight, the hashes of its bands.

    A text's bands rest and travel as one list: its key, longer than a hash, is written once and not once per band.
    """
    def run(batches):
        for batch in batches:
            for row, words in blocks(batch.column(1)):
                doc, h, size = minhash.bands(words, ROWS, by_count)
                order = np.argsort(doc, kind="stable")
                doc, h, size = doc[order], h[order], size[order]
                first = np.flatnonzero(np.diff(doc, prepend=-1))
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)).astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc[first] + row)), pa.array(size[first]), lists], names=["key", "size", "bands"])

    return text_batches(texts).mapInArrow(run, "key binary, size long, bands array<long>").distinct()


def _near(size: str | Column, other: str | Column) -> Column:
    """Whether sizes allow similarity: shared units are at most the smaller size, all units at least the larger."""
    return F.least(size, other) / F.greatest(size, other) >= LEAST


def sketched(texts: DataFrame, by_count: bool = False) -> DataFrame:
    """(key, s0, s1, ..) of every text: the words of its parity sketch."""
    names = [f"s{i}" for i in range(minhash.SKETCH_WORDS)]

    def run(batches):
        for batch in batches:
            for row, words in blocks(batch.column(1)):
                sketch = minhash.parities(minhash.region(words, by_count), len(words))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(words)), *[pa.array(np.ascontiguousarray(x)) for x in sketch.T]], names=["key", *names])

    return text_batches(texts.select("key", "text")).mapInArrow(run, "key binary, " + ", ".join(f"{n} long" for n in names))


def _maybe(left: str, right: str) -> Column:
    """Whether the rows' sketches allow similarity: texts differ in at least as many units as their sketches in bits."""
    bits = sum((F.bit_count(F.col(f"{left}.s{i}").bitwiseXOR(F.col(f"{right}.s{i}"))) for i in range(minhash.SKETCH_WORDS)), F.lit(0))
    return bits * (1 + LEAST) <= (F.col(f"{left}.size") + F.col(f"{right}.size")) * (1 - LEAST) + 1e-6


def last_pairs(open_: DataFrame, sketches: DataFrame) -> DataFrame:
    """All pairs (a, b) of different classes that share a bucket of ``open_`` and may be alike, each once.

    A large bucket is dealt to several tasks: parts of it meet copies of the whole.
    """
    parts = open_.groupBy("h").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    rows = open_.select("h", "key", "size", "root").join(sketches, "key").join(parts, "h")
    left = rows.withColumn("part", F.pmod(F.xxhash64("key"), "parts").cast("int")).alias("x")
    right = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("y")
    met = left.join(right, (F.col("x.h") == F.col("y.h")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.key") < F.col("y.key"))
                    & (F.col("x.root") != F.col("y.root")) & _near("x.size", "y.size") & _maybe("x", "y"))
    return met.select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()


def _mark(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << MARK_BITS))


def marked(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``texts`` that may have one of ``keys`` (key): all that have, and few others.

    The keys set bits of one bitmap of ``2 ** MARK_BITS`` bits, whatever their number, so its 16 MB can be broadcast and other texts
    are not shuffled.  With very many keys the bitmap fills and holds less back; the join that follows is exact.
    """
    bits = keys.select(F.bitmap_bucket_number(_mark("key")).alias("_part"), F.bitmap_bit_position(_mark("key")).alias("_at")).repartition(
        "_part").groupBy("_part").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    placed = texts.withColumns({"_part": F.bitmap_bucket_number(_mark("key")), "_at": F.bitmap_bit_position(_mark("key"))})
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return placed.join(F.broadcast(bits), "_part").filter(F.getbit(byte, (F.col("_at") % 8).cast("int")) == 1).select(*texts.columns)


def compared(pairs: DataFrame, texts: DataFrame, by_count: bool = False) -> DataFrame:
    """The pairs (a, b) that are alike; one text of every key in them is shuffled, and one per pair."""
    one = marked(texts, pairs.select(F.explode(F.array("a", "b")).alias("key"))).dropDuplicates(["key"])
    left = pairs.join(one.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    met = left.join(one.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def regions(texts: pa.Array) -> tuple[np.ndarray, ...]:
        parts = [(row, minhash.region(words, by_count)) for row, words in blocks(texts)]
        return tuple(np.concatenate(x) for x in zip(*[(owner + row, element, nth) for row, (owner, element, nth) in parts]))

    def run(batches):
        for batch in batches:
            sizes = sum(np.asarray(pc.binary_length(batch.column(i))) for i in (2, 3))
            for start, end in stretches(sizes, BLOCK_BYTES):
                part = batch.slice(start, end - start)
                alike = minhash.similarity(regions(part.column(2)), regions(part.column(3)), len(part)) >= LEAST
                good = pa.array(np.flatnonzero(alike))
                yield pa.RecordBatch.from_arrays([part.column(0).take(good), part.column(1).take(good)], names=["a", "b"])

    return met.mapInArrow(run, "a binary, b binary")


def _ordered(left: str, right: str) -> list[Column]:
    return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]


def bucket_lists(rows: DataFrame) -> DataFrame:
    """(key, size, root, buckets, heads) of every text of ``rows`` (h, key, size, degree, root).

    ``buckets``: its buckets, each with the bucket's first leader; ``heads``: all leaders it meets, each once: those of
    the ``LEADERS`` busiest classes of every bucket.  A text is in at most as many buckets as there are bands.
    """
    heads = rows.groupBy("h", "root").agg(F.max(F.struct("degree", F.col("key").alias("leader"), "size")).alias("x")).select(
        "h", "root", "x.leader", "x.size", F.col("x.degree").alias("top"))
    rank = F.row_number().over(Window.partitionBy("h").orderBy(F.desc("top"), "leader"))
    chosen = heads.withColumn("_rank", rank).filter(F.col("_rank") <= LEADERS).groupBy("h").agg(
        F.min_by("leader", "_rank").alias("first"), F.collect_list(F.struct("root", "leader", "size")).alias("heads"))
    return rows.join(chosen, "h").groupBy("key", "size", "root").agg(
        F.collect_list(F.struct("h", "first")).alias("buckets"), F.array_distinct(F.flatten(F.collect_list("heads"))).alias("heads"))


def still_open(rows: DataFrame, lists: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of ``rows`` whose bucket holds several classes, with the new ``roots``; a bucket of one class stays so.

    A bucket holds several classes if and only if one of its texts is not in its first leader's.  Texts of one family share
    their leaders over most bands, so classes are joined to a text once and to each different leader it meets, not to every bucket it is in.
    """
    now = lists.select("key", "buckets").join(roots.withColumnRenamed("member", "key").withColumnRenamed("root", "_root"), "key", "left").select(
        "key", F.coalesce("_root", "key").alias("root"), "buckets")
    meets = now.select("key", "root", F.explode(F.array_distinct("buckets.first")).alias("first"))
    away = meets.join(roots.select(F.col("member").alias("first"), F.col("root").alias("_root")), "first", "left").filter(
        F.col("root") != F.coalesce("_root", "first")).groupBy("key").agg(F.collect_set("first").alias("away"))
    split = now.join(away, "key").select(F.explode(F.filter("buckets", lambda x: F.array_contains("away", x["first"]))["h"]).alias("h")).distinct()
    left = rows.select("h", "key", "size", "degree").join(split, "h", "left_semi")
    return left.join(now.select("key", "root"), "key").select("h", "key", "size", "degree", "root")


def _joined(roots: DataFrame | None, more: DataFrame) -> DataFrame:
    """Classes after further links (a, b): the links so far are as good as the classes they made."""
    return components(more if roots is None else roots.select(F.col("member").alias("a"), F.col("root").alias("b")).union(more))


def linked(texts: DataFrame) -> DataFrame:
    """(member, root) of all similar different texts, as ``components`` gives them.  Runs jobs; intermediate tables go to the shared folder."""
    spark = texts.sparkSession
    bands = stored(band_lists(texts), "bands").select("key", "size", F.explode("bands").alias("h"))
    full = bands.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    met = stored(bands.join(full, "h"), "buckets")
    free_shuffles(spark)
    small, large = met.filter(F.col("n") <= ALL_PAIRS).select("h", "key", "size"), met.filter(F.col("n") > ALL_PAIRS)
    pairs = small.withColumnsRenamed({"key": "a", "size": "size_a"}).join(small.withColumnsRenamed({"key": "b", "size": "size_b"}), "h").filter(
        (F.col("a") < F.col("b")) & _near("size_a", "size_b")).select("a", "b")
    degree = met.groupBy("key").agg(F.sum("n").alias("degree"))
    open_ = stored(large.join(degree, "key").select("h", "key", "size", "degree", F.col("key").alias("root")), "large-buckets")
    tried, roots = None, None
    for turn in range(1 + ROUNDS):
        lists = stored(bucket_lists(open_), "bucket-lists")
        fresh = lists.select("key", F.explode(F.filter(
            "heads", lambda x: (x["root"] != F.col("root")) & _near(F.col("size"), x["size"]))).alias("x")).select(
            *_ordered("key", "x.leader")).distinct()
        fresh = stored(pairs.union(fresh).distinct() if tried is None else fresh.join(tried, ["a", "b"], "left_anti"), "candidates")
        if turn and fresh.isEmpty():
            break
        tried = fresh if tried is None else tried.union(fresh)
        free_shuffles(spark)
        more = stored(compared(fresh, texts), "links")
        free_shuffles(spark)
        if turn and more.isEmpty():
            break  # the same classes have the same leaders again
        roots = _joined(roots, more)
        open_ = stored(still_open(open_, lists, roots), "open-buckets")
    if open_.isEmpty():
        return roots
    keys = stored(open_.select("key").distinct(), "open-keys")
    # Sketches are much smaller to shuffle than texts.
    sketches = stored(sketched(marked(texts, keys)).join(keys, "key", "left_semi").dropDuplicates(["key"]), "sketches")
    free_shuffles(spark)
    last = stored(last_pairs(open_, sketches).join(tried, ["a", "b"], "left_anti"), "candidates")
    free_shuffles(spark)
    if last.isEmpty():
        return roots
    more = stored(compared(last, texts), "links")
    free_shuffles(spark)
    return roots if more.isEmpty() else _joined(roots, more)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, root, class_id): every row's class, named by its smallest id."""
    texts = docs.select(text_key(text_col).alias("key"), text_of(text_col).alias("text"))
    roots = linked(texts).withColumnRenamed("root", "_root")
    rows = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"))
    rooted = stored(rows.join(roots, F.col("key") == F.col("member"), "left").select(
        "id", "key", F.coalesce("_root", "key").alias("root")), "near-rows")
    firsts = rooted.groupBy("root").agg(F.min("id").alias("class_id"))
    return rooted.join(firsts, "root").select("id", "key", "root", "class_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, one of each class: the smallest id's (null ids last), of equal rows one."""
    found = classes(docs, id_col, text_col)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key")).alias("x")).select(
        F.col("x.id").alias("_id"), F.col("x.key").alias("_key"))
    rows = as_rows(docs, id=F.col(id_col), key=text_key(text_col))
    hashed = F.xxhash64(*[F.col(f"row.`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])
    held = rows.join(stored(first, "near-kept"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left_semi")
    return held.groupBy("id", "key").agg(F.min_by("row", hashed).alias("row")).select("row.*")
