"""Quality rules with thresholds learnt per language and source from mergeable quantile sketches.

Counts of every text are turned into four rates.  A rate's sketch is a histogram whose buckets are
exact below 128 and within 1/64 of the value above: sketches of parts add up to the sketch of the whole, in any
order, so a hot source is summed map-side and thresholds are the same on every run.  A threshold is
the upper quartile plus ``REACH`` times the spread between the quartiles, the spread taken as at least ``LEAST`` so
that a group of uniform documents loses none.  Groups of fewer than ``MIN_GROUP`` documents use the
sketch of their language, and failing that the one of all documents.

Everything is column expressions: no Python on the executors.  Edge cases: a null text has no
words and fails the base rules; null languages and sources are groups of their own; repeated rows are
judged alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from careframe.llm.common import WORD, stored, text_of

MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"
REACH = 3
MIN_GROUP = 50
# Smallest spread per rate; rates are per 10,000, word length is in hundredths of a character.
LEAST = {"symbol_rate": 200, "repeat_line_rate": 1000, "repeat_word_rate": 500, "word_length": 300}


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines instead of the text."""
    other = [c for c in docs.columns if c != text_col]
    text = text_of(text_col)
    split = docs.select(
        *other, F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)).alias("_words"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike("[^ \\t-\\r]")).alias("_lines"))
    window = F.transform(F.sequence(F.lit(0), F.size("_words") - WINDOW), lambda i: F.xxhash64(
        *[F.get("_words", i + k) for k in range(WINDOW)]))
    hashed = split.select(
        *other, "n_symbols", F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_words") >= WINDOW, window).alias("_windows"))
    # Only a text that holds a window twice has its windows sorted.
    ordered = hashed.withColumn("_sorted", F.when(
        F.size(F.array_distinct("_windows")) < F.size("_windows"),
        F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_windows")
    twice = F.filter("_sorted", lambda e, i: (i > 0) & (F.get("_sorted", i - 1)["h"] == e["h"])
                     | F.coalesce(F.get("_sorted", i + 1)["h"] == e["h"], F.lit(False)))
    found = ordered.withColumn("_at", F.sort_array(F.transform(twice, lambda e: e["i"]))).drop("_sorted")
    gains = F.transform("_at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", i + 1) - p, F.lit(WINDOW))))
    covered = F.aggregate(gains, F.lit(0).cast("long"), lambda total, gain: total + gain)
    return found.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_at")


def bucket(value: Column) -> Column:
    """Lower edge of the value's sketch bucket, in whole-number arithmetic."""
    drop = F.length(F.bin(value)) - 7
    return F.when(value < 128, value).otherwise(
        F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop))


def rates() -> dict[str, Column]:
    def per(top: Column, below: Column, scale: int) -> Column:
        return F.floor(top * scale / F.greatest(below, F.lit(1)))

    return {
        "symbol_rate": per(F.col("n_symbols"), F.col("word_chars"), 10_000),
        "repeat_line_rate": per(F.col("n_dup_lines"), F.col("n_lines"), 10_000),
        "repeat_word_rate": per(F.col("n_repeat_words"), F.col("n_words"), 10_000),
        "word_length": per(F.col("word_chars"), F.col("n_words"), 100),
    }


def sketches(rated: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, rate, bucket, n): one sketch per group and rate."""
    names = list(LEAST)
    long = rated.select(*groups, F.explode(F.array(*[
        F.struct(F.lit(n).alias("rate"), bucket(F.col(n)).alias("bucket")) for n in names])).alias("x"))
    return long.groupBy(*groups, "x.rate", "x.bucket").agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame, groups: list[str], prefix: str) -> DataFrame:
    """One row per group: its size and a threshold per rate, read off its sketches."""
    by = [*groups, "rate"]
    run = Window.partitionBy(*by).orderBy("bucket")
    whole = Window.partitionBy(*by)
    cut = sketch.select(*by, "bucket", F.sum("n").over(run).alias("upto"), F.sum("n").over(whole).alias("all"))
    quartiles = cut.groupBy(*by).agg(
        F.max("all").alias("all"), F.min(F.when(4 * F.col("upto") >= F.col("all"), F.col("bucket"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("all"), F.col("bucket"))).alias("q3"))
    least = F.element_at(F.create_map(*[F.lit(x) for pair in LEAST.items() for x in pair]), F.col("rate"))
    fence = F.col("q3") + REACH * F.greatest(F.col("q3") - F.col("q1"), least)
    return quartiles.groupBy(*groups).agg(
        F.max("all").alias(f"{prefix}size"),
        *[F.max(F.when(F.col("rate") == n, fence)).alias(f"{prefix}{n}") for n in LEAST])


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          id_col: str = "doc_id") -> DataFrame:
    """(id_col, counts, base_failed, kept) of every document; counts are written to the shared folder first."""
    measured = counts(docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"),
                                  F.col(text_col).alias("_text")), "_text")
    rated = stored(measured.withColumns({n: c.cast("long") for n, c in rates().items()}), "quality-counts")
    fine = sketches(rated, ["_lang", "_source"])
    by_lang = fine.groupBy("_lang", "rate", "bucket").agg(F.sum("n").alias("n"))
    of_all = by_lang.groupBy("rate", "bucket").agg(F.sum("n").alias("n"))
    overall = thresholds(of_all, [], "").first()  # one row of numbers
    groups = thresholds(fine, ["_lang", "_source"], "own_").withColumnsRenamed({"_lang": "_l", "_source": "_s"})
    langs = thresholds(by_lang, ["_lang"], "lang_").withColumnRenamed("_lang", "_ll")
    limits = groups.join(langs, F.col("_l").eqNullSafe(F.col("_ll")), "left").select("_l", "_s", *[
        F.when(F.col("own_size") >= MIN_GROUP, F.col(f"own_{n}")).when(
            F.col("lang_size") >= MIN_GROUP, F.col(f"lang_{n}")).otherwise(F.lit(overall[n])).alias(f"most_{n}") for n in LEAST])
    joined = rated.join(limits, F.col("_lang").eqNullSafe(F.col("_l")) & F.col("_source").eqNullSafe(F.col("_s")), "left")
    too_high = F.lit(False)
    for n in LEAST:
        too_high = too_high | (F.col(n) > F.col(f"most_{n}"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return joined.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~F.coalesce(too_high, F.lit(False))).alias("kept"))


def keep(docs: DataFrame, id_col: str = "doc_id", **columns: str) -> DataFrame:
    """Rows of ``docs`` whose id is kept: the verdicts joined back as a filter."""
    good = judge(docs, id_col=id_col, **columns).filter("kept").select(F.col(id_col).alias("_good")).distinct()
    return docs.join(good, docs[id_col].eqNullSafe(good["_good"]), "left_semi")
