"""Patient files: reading, coercion, per-row errors and job statistics."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from careframe.sources.record_splits import read_records

CORRUPT = "_corrupt_record"
ROW = "row_no"
# Where a row was read: file (newest last), split of the file, and order inside the split.
SOURCE_TIME, SOURCE_FILE, SPLIT_START, SPLIT_ORDER = "source_time", "source_file", "split_start", "split_order"
PLACE = (SOURCE_TIME, SOURCE_FILE, SPLIT_START, SPLIT_ORDER, ROW)

# Mapped columns, and the default of each when the file lacks the column.
COLUMN_DEFAULTS = {
    "first_name": "",
    "last_name": "",
    "date_of_birth": "2000-01-01",
    "gender": "U",
    "phone": "",
    "email": "",
    "county": "",
    "sub_county": "",
}
KEY = "patient_id"
AUTO_PREFIX = "AUTO_"
MAX_LOGGED_ERRORS = 50
# Different headers that the files of one read may have.
MAX_LAYOUTS = 1000

# Accepted spellings of a date of birth (there is no year 0).
DASHED_DATE = r"^(?!0000)\d{4}-\d{1,2}-\d{1,2}$"
COMPACT_DATE = r"^(\d{4})(\d{2})(\d{2})$"
WEEK_DATE = r"^(?!0000)(\d{4})-?W(\d{2})(?:-?([1-7]))?$"


def file_heads(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source_file, head): the first line of each file that is not blank, sought in the first split of the file."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias(SOURCE_FILE), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_order"), F.regexp_replace("value", "^\ufeff", "").alias("_line"))
    return lines.filter((F.col("_start") == 0) & F.col("_line").rlike("[^\\s]")).groupBy(SOURCE_FILE).agg(
        F.min_by("_line", "_order").alias("head"))


def names_in(head: str) -> list[str]:
    """Column names of a header line.  A mapped column is known whatever its case and the blanks around it; other names stay as
    they are; empty and repeated ones are told apart by their place."""
    names: list[str] = []
    mapped = {name.lower(): name for name in (KEY, *COLUMN_DEFAULTS)}
    for i, name in enumerate(next(csv.reader([head]))):
        name = mapped.get(name.strip().lower(), name)
        again = name.lower() in (n.lower() for n in names)
        names.append(f"_c{i}" if not name else f"{name}{i}" if again else name)
    return names


def csv_schema(names: list[str]) -> T.StructType:
    """All columns as text, plus the raw text of rows with too few or too many fields."""
    return T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])


def _with_missing(raw: DataFrame, names: list[str]) -> DataFrame:
    """Add ``_missing``: which columns a short row does not have at all.

    An empty field reads as null, and so does a field beyond the end of a short
    row.  The field count of the raw text tells them apart: quoted parts are
    blanked first, then separators are counted.
    """
    unquoted = F.regexp_replace(F.col(CORRUPT), r'(^|,)"(?:[^"]|"")*"', "$1q")
    fields = F.when(F.col(CORRUPT).isNotNull(), F.size(F.split(unquoted, ",")))
    absent = F.array_compact(F.array(*[
        F.when(F.coalesce(fields <= F.lit(i), F.lit(False)), F.lit(n)) for i, n in enumerate(names)]))
    return raw.withColumn("_missing", absent)


def place_rows(raw: DataFrame) -> DataFrame:
    """Add where each row was read, straight above the scan."""
    return raw.withColumns({
        SOURCE_TIME: F.col("_metadata.file_modification_time"), SOURCE_FILE: F.col("_metadata.file_path"),
        SPLIT_START: F.col("_metadata.file_block_start"), SPLIT_ORDER: F.monotonically_increasing_id(),
    })


def place_of(df: DataFrame) -> Column:
    """Reading order of rows, from whichever place columns they carry."""
    return F.struct(*[c for c in PLACE if c in df.columns])


def split_offsets(placed: DataFrame) -> DataFrame:
    """Per file split: its first order value and the number of rows before it in the file.

    One row per split, summed up map-side.
    """
    splits = placed.groupBy(SOURCE_FILE, SPLIT_START).agg(
        F.count("*").alias("_rows"), F.min(SPLIT_ORDER).alias("_first"))
    before = Window.partitionBy(SOURCE_FILE).orderBy(SPLIT_START).rowsBetween(Window.unboundedPreceding, -1)
    return splits.select(SOURCE_FILE, SPLIT_START, "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))


def number_rows(some: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """Add ``row_no`` (1, 2, ... in file order, per file) to some rows of ``placed``.

    Keeping the place of a row is enough to order rows; counting is only for
    those whose number is shown.
    """
    offsets = split_offsets(some if placed is None else placed)
    numbered = some.join(offsets, [SOURCE_FILE, SPLIT_START])
    number = F.col("_before") + F.col(SPLIT_ORDER) - F.col("_first") + 1
    return numbered.withColumn(ROW, number).drop("_before", "_first")


def _different_heads(heads: DataFrame) -> list[str]:
    """The different first lines, in order; more than ``MAX_LAYOUTS`` are refused, since data lines are no headers."""
    found = heads.groupBy("head").agg(F.min(SOURCE_FILE).alias("one")).limit(MAX_LAYOUTS + 1).collect()
    if len(found) > MAX_LAYOUTS:
        raise ValueError(f"over {MAX_LAYOUTS} different headers, such as those of {found[0]['one']} and {found[1]['one']}; give names")
    return sorted(r["head"] for r in found)


def read_patient_csv(
    spark: SparkSession, path: str | list[str], multi_line: bool = True, names: list[str] | None = None, whole_files: bool = False,
) -> DataFrame:
    """Header-named text columns and the place of each row.

    Each file is read by its own header, unless ``names`` gives the columns of all.  Where files have different
    columns, a mapped column that a file lacks takes its default there, and any other is null; names that differ only in
    case are one column, spelled as in the first header.  Blank lines are skipped and surplus fields ignored.  Line breaks inside
    quotes are part of the field; files are split all the same (``record_splits``, a job), or with ``whole_files`` read by Spark's
    own parser, one task per file.  ``multi_line=False`` takes every line for a record.  Without ``names`` a job
    finds the different headers.
    """
    heads = None if names else file_heads(spark, path)
    known = [] if names else _different_heads(heads)
    layouts = [names] if names else [names_in(head) for head in known] or [[]]
    slots = layouts[0] if len(layouts) == 1 else [f"_slot{i}" for i in range(max(map(len, layouts)))]
    options = {"multiLine": str(multi_line).lower(), "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    if multi_line and not whole_files and slots:
        records = read_records(spark, path)
        schema = csv_schema(slots)
        fields = F.from_csv("record", ", ".join(f"`{n.replace('`', '``')}` string" for n in schema.names), options)
        raw = records.select(*PLACE[:-1], fields.alias("_fields")).select(
            *PLACE[:-1], *[F.col("_fields").getField(n).alias(n) for n in schema.names])
    else:
        raw = place_rows(spark.read.schema(csv_schema(slots)).option("header", True).options(**options).csv(path))
    shaped = shape_csv(raw, slots)
    if len(layouts) == 1:
        return shaped
    return _by_layout(shaped, heads, known, _one_spelling(layouts), slots)


def _one_spelling(layouts: list[list[str]]) -> list[list[str]]:
    """Names that differ only in case, spelled as where they come first."""
    first: dict[str, str] = {}
    return [[first.setdefault(name.lower(), name) for name in names] for names in layouts]


def _by_layout(shaped: DataFrame, heads: DataFrame, known: list[str], layouts: list[list[str]], slots: list[str]) -> DataFrame:
    """Rows of files with different headers, their fields under the names of each file's own."""
    rows = shaped.join(heads, SOURCE_FILE)
    if not all(KEY in names for names in layouts):
        rows = number_rows(rows)

    def field(name: str) -> Column:
        found = F.lit(None).cast("string")
        for head, names in zip(known, layouts):
            if name in names:
                value = F.col(slots[names.index(name)])
            elif name == KEY:
                value = F.concat(F.lit(AUTO_PREFIX), F.col(ROW).cast("string"))
            else:
                value = F.lit(COLUMN_DEFAULTS.get(name)).cast("string")
            found = F.when(F.col("head") == head, value).otherwise(found)
        return found.alias(name)

    every = dict.fromkeys([KEY, *(name for names in layouts for name in names)])
    return rows.select(*[c for c in PLACE if c in rows.columns], *[field(name) for name in every])


def shape_csv(raw: DataFrame, names: list[str]) -> DataFrame:
    """Placed rows with empty fields as ``''``, truly missing ones as null."""
    marked = _with_missing(raw, names)
    filled = [
        F.when(~F.array_contains("_missing", n), F.coalesce(F.col(n), F.lit(""))).alias(n) for n in names]
    return marked.select(*PLACE[:-1], *filled)


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _week_day(part) -> Column:
    """Date of an ISO year, week and day; null where the year has no such week."""
    fourth = F.make_date(part["year"], F.lit(1), F.lit(4))  # always lies in week 1
    start = F.date_add(F.date_trunc("week", fourth).cast("date"), (part["week"] - 1) * 7)
    return _bind(start, lambda day: F.when(F.weekofyear(day) == part["week"], F.date_add(day, part["day"] - 1)))


def parse_birth_date(text: Column) -> Column:
    """Date from ``Y-M-D``, ``YYYYMMDD`` or ISO week text; null when it is none of them."""
    dashed = F.regexp_replace(text, COMPACT_DATE, "$1-$2-$3")
    by_day = F.when(F.rlike(dashed, F.lit(DASHED_DATE)), dashed.try_cast("date"))
    year, week, day = (F.regexp_extract(text, WEEK_DATE, i).try_cast("int") for i in (1, 2, 3))
    parts = F.struct(year.alias("year"), week.alias("week"), F.coalesce(day, F.lit(1)).alias("day"))
    by_week = F.when(F.rlike(text, F.lit(WEEK_DATE)), _bind(parts, _week_day))
    return F.coalesce(by_day, by_week)


def check_rows(raw: DataFrame) -> DataFrame:
    """Coerced rows with an ``errors`` array, empty where the row is usable.

    Defaults apply only where the file has no such *column*.  A row is in error
    when a mapped field is missing from it or the date of birth is no date.
    Without a key column the key is made from the row number.
    """
    if KEY not in raw.columns and ROW not in raw.columns:
        raw = number_rows(raw)
    present = set(raw.columns)
    key = F.col(KEY) if KEY in present else F.concat(F.lit(AUTO_PREFIX), F.col(ROW).cast("string"))
    texts = {n: F.col(n) if n in present else F.lit(default) for n, default in COLUMN_DEFAULTS.items()}
    place = [c for c in PLACE if c in present]
    # The date is parsed in a step of its own, so that its users share one result.
    parsed = raw.select(*place, key.alias(KEY), *[c.alias(n) for n, c in texts.items()],
                        parse_birth_date(texts["date_of_birth"]).alias("_born"))
    born, text = F.col("_born"), F.col("date_of_birth")
    problems = []
    for name in (KEY, *COLUMN_DEFAULTS):
        problems.append(F.when(F.col(name).isNull(), F.lit(f"missing value for {name}")))
    invalid = F.when(text.isNotNull() & born.isNull(), F.concat(F.lit("invalid date_of_birth: "), text))
    coerced = {"date_of_birth": born, "gender": F.upper(F.substring("gender", 1, 1))}
    return parsed.select(
        *place, KEY, *[coerced.get(n, F.col(n)).alias(n) for n in COLUMN_DEFAULTS],
        F.when(_usable(born), F.array().cast("array<string>")).otherwise(
            F.array_compact(F.array(*problems, invalid))).alias("errors"))


def _usable(born: Column) -> Column:
    """Whether every mapped field of a row has a value."""
    complete = born.isNotNull()
    for name in (KEY, *COLUMN_DEFAULTS):
        complete = complete & F.col(name).isNotNull()
    return complete


def split_rows(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their ``errors``).

    A row has errors exactly where a mapped column is null, which is the cheaper test.
    """
    usable = _usable(F.col("date_of_birth"))
    return checked.filter(usable).drop("errors"), checked.filter(~usable)


def coerce_patients(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their ``errors``) of a raw file."""
    return split_rows(check_rows(raw))


def ingest_stats(checked: DataFrame) -> DataFrame:
    """One row: total, processed, failed, log of the first errors, status."""
    bad = ~_usable(F.col("date_of_birth"))
    logged = checked.filter(bad).orderBy(place_of(checked)).limit(MAX_LOGGED_ERRORS)
    if ROW not in checked.columns:
        logged = number_rows(logged, checked)
    logged = logged.select(
        place_of(checked).alias("_place"), F.concat(F.lit("Row "), F.col(ROW).cast("string"), F.lit(": "), F.array_join("errors", "; ")).alias("text"))
    lines = F.array_sort(F.collect_list(F.struct("_place", "text")))  # at most MAX_LOGGED_ERRORS entries
    counts = checked.agg(F.count("*").alias("total"), F.count_if(bad).alias("failed"),
                         F.lit(None).cast("string").alias("error_log"))
    texts = logged.agg(F.array_join(F.transform(lines, lambda s: s["text"]), "\n").alias("error_log")).select(
        F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("failed"), "error_log")
    return counts.unionByName(texts).agg(
        F.sum("total").alias("total"),
        F.sum(F.col("total") - F.col("failed")).alias("processed"), F.sum("failed").alias("failed"),
        F.coalesce(F.max("error_log"), F.lit("")).alias("error_log"),
        F.when(F.sum("failed") == 0, "completed").otherwise("partial").alias("status"))


def file_stats(checked: DataFrame) -> DataFrame:
    """One row per file that has rows: ``source_file`` and the statistics of ``ingest_stats``, with the file's own first errors."""
    bad = ~_usable(F.col("date_of_birth"))
    nth = F.row_number().over(Window.partitionBy(SOURCE_FILE).orderBy(place_of(checked)))
    logged = checked.filter(bad).withColumn("_nth", nth).filter(F.col("_nth") <= MAX_LOGGED_ERRORS)
    if ROW not in checked.columns:
        logged = number_rows(logged, checked)
    line = F.concat(F.lit("Row "), F.col(ROW).cast("string"), F.lit(": "), F.array_join("errors", "; "))
    logs = logged.groupBy(SOURCE_FILE).agg(F.array_sort(F.collect_list(F.struct("_nth", line.alias("text")))).alias("_log"))
    counts = checked.groupBy(SOURCE_FILE).agg(F.count("*").alias("total"), F.count_if(bad).alias("failed"))
    return counts.join(logs, SOURCE_FILE, "left").select(
        SOURCE_FILE, "total", (F.col("total") - F.col("failed")).alias("processed"), "failed",
        F.coalesce(F.array_join("_log.text", "\n"), F.lit("")).alias("error_log"),
        F.when(F.col("failed") == 0, "completed").otherwise("partial").alias("status"))


def failed_stats(spark: SparkSession, error: str) -> DataFrame:
    """Statistics row of a file that could not be read at all."""
    zero = F.lit(0).cast("long")
    return spark.range(1, numPartitions=1).select(
        zero.alias("total"), zero.alias("processed"), zero.alias("failed"),
        F.lit(error).alias("error_log"), F.lit("failed").alias("status"))


def undecodable_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source_file) of the files with a line that is no UTF-8."""
    lines = spark.read.text(path)
    return lines.filter(~F.is_valid_utf8("value")).select(F.col("_metadata.file_path").alias(SOURCE_FILE)).distinct()


def is_utf8(spark: SparkSession, path: str) -> bool:
    """Whether every line of the file decodes as UTF-8."""
    lines = spark.read.text(path)
    return lines.filter(~F.is_valid_utf8("value")).limit(1).count() == 0
