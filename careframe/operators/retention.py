"""Retention of a table that is partitioned by kind of data and month, for the policies of all kinds at once.

A catalog table has three partition columns: the kind, whether its rows have been pseudonymised, and the month of their time.  A run looks
at the list of partitions only.  A month that is wholly past its policy's period is dropped, files unread.  Read and written
again are the months that a border falls in, and those past the anonymising border that still hold rows in clear; what
becomes a pseudonym moves to the other side of the table, so nothing is hidden twice.  Files of all other months stay.

A run keeps a journal, a folder of its own: the new content of the touched months is written there first.  A run that dies is started
again with the same journal and the same ``as_of``: before the journal is complete nothing of the table has changed, afterwards the same
partitions are replaced and dropped.  Readers should not run meanwhile.

Rows without a time are in a month of their own and stay, as do kinds without an active policy and rows of a null kind.  A
policy made longer later does not bring anything back.  A run on an empty table does nothing.
"""

from __future__ import annotations

from datetime import timedelta
from functools import reduce
from operator import or_
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

from careframe.functions.predicates import as_instant, time_literal
from careframe.operators.governance import pseudonyms
from careframe.operators.partitions import mark, marked
from careframe.session import pinned_session

HIDDEN, MONTH = "_hidden", "_month"
MAX_POLICIES = 1_000
DROPPED_TOGETHER = 200
NONE = "__HIVE_DEFAULT_PARTITION__"


def _laid_out(df: DataFrame, kind_col: str, time_col: str) -> DataFrame:
    """``df`` with its partition columns last; a large month is dealt over several tasks."""
    if {HIDDEN, MONTH} & set(df.columns):
        raise ValueError(f"{HIDDEN} and {MONTH} are columns of the table's own")
    rows = df.withColumns({HIDDEN: F.lit(0), MONTH: F.date_format(time_col, "yyyy-MM")})
    return rows.select(*[c for c in df.columns if c != kind_col], kind_col, HIDDEN, MONTH).hint("rebalance", kind_col, MONTH)


def create(df: DataFrame, table: str, kind_col: str, time_col: str) -> None:
    """``df`` as a new catalog table under retention."""
    _laid_out(df, kind_col, time_col).write.partitionBy(kind_col, HIDDEN, MONTH).saveAsTable(table)


def append(df: DataFrame, table: str, kind_col: str, time_col: str) -> None:
    """Add rows with the table's columns, in clear; rows older than a border are treated by the next run."""
    rows = _laid_out(df, kind_col, time_col)
    rows.select(*df.sparkSession.table(table).columns).write.insertInto(table)


def read(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table).drop(HIDDEN, MONTH)


def partitions(spark: SparkSession, table: str) -> list[tuple[str, int, str]]:
    """(kind, hidden, month) of every partition that has a kind and a month, from the catalog."""
    found = []
    for row in spark.sql("show partitions identifier(:name)", {"name": table}).collect():
        kind, hidden, month = (unquote(part.split("=", 1)[1]) for part in row[0].split("/"))
        if NONE not in (kind, month):
            found.append((kind, int(hidden), month))
    return sorted(found)


def _policies(policies: DataFrame) -> dict[str, tuple[int, int | None]]:
    rows = policies.filter("is_active").filter(F.col("data_type").isNotNull()).select(
        "data_type", "retention_days", "anonymize_after_days").limit(MAX_POLICIES + 1).collect()
    if len(rows) > MAX_POLICIES:
        raise ValueError(f"more than {MAX_POLICIES} active policies")
    found = {kind: (keep, hide) for kind, keep, hide in rows}
    if len(found) < len(rows):
        raise ValueError("more than one active policy for a kind of data")
    return found


def enforce(
    spark: SparkSession, table: str, policies: DataFrame, kind_col: str, time_col: str, identifying: list[str], as_of, journal: str,
) -> dict[str, list[tuple[str, int, str]]]:
    """Apply all active policies as of an instant; which partitions were ``dropped`` unread and which ``rewritten``.

    The result for a kind is that of ``governance.enforce_retention``: at the instant, not rounded to months.
    """
    if "." not in table:
        table = f"{spark.catalog.currentDatabase()}.{table}"
    if marked(spark, f"{journal}/finished"):
        return {"dropped": [], "rewritten": []}
    rules, now = _policies(policies), as_instant(as_of)
    dropped, touched = [], []
    for part in partitions(spark, table):
        kind, hidden, month = part
        if kind not in rules:
            continue
        keep_from, hide_from = ((now - timedelta(days=d)).strftime("%Y-%m") if d is not None else "" for d in rules[kind])
        if month < keep_from:
            dropped.append(part)
        elif month == keep_from or not hidden and month <= hide_from:
            touched.append(part)

    # Dynamic overwriting is a setting of the session; the caller's stays as it is.
    own = pinned_session(spark)
    own.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    stored, staged = own.table(table), f"{journal}/rows"
    if not marked(spark, f"{journal}/complete"):
        _rewritten(stored, rules, touched, kind_col, time_col, identifying, now).hint("rebalance", kind_col, MONTH).write.mode(
            "overwrite").option("partitionOverwriteMode", "static").parquet(staged)
        mark(spark, f"{journal}/complete")
    rows = own.read.schema(stored.schema).parquet(staged)
    rows.hint("rebalance", kind_col, MONTH).write.insertInto(table, overwrite=True)
    filled = {tuple(r) for r in rows.select(kind_col, HIDDEN, MONTH).distinct().collect()}  # partitions, not rows
    gone = [_spec(kind_col, part) for part in [*dropped, *(part for part in touched if part not in filled)]]
    for at in range(0, len(gone), DROPPED_TOGETHER):
        own.sql(f"alter table identifier(:name) drop if exists {', '.join(gone[at:at + DROPPED_TOGETHER])}", {"name": table})
    spark.catalog.refreshTable(table)
    mark(spark, f"{journal}/finished")
    return {"dropped": dropped, "rewritten": touched}


def _spec(kind_col: str, part: tuple[str, int, str]) -> str:
    values = [str(v).replace("\\", "\\\\").replace("'", "\\'") for v in part]
    return "partition (" + ", ".join(f"`{c}` = '{v}'" for c, v in zip((kind_col, HIDDEN, MONTH), values)) + ")"


def _rewritten(stored: DataFrame, rules, touched, kind_col: str, time_col: str, identifying: list[str], now) -> DataFrame:
    """New content of the touched months, on both sides; the filter names partition columns only, so no others are read."""
    months: dict[str, set[str]] = {}
    for kind, _, month in touched:
        months.setdefault(kind, set()).add(month)
    wanted = reduce(or_, [(F.col(kind_col) == kind) & F.col(MONTH).isin(sorted(found)) for kind, found in sorted(months.items())], F.lit(False))
    bounds = stored.sparkSession.createDataFrame([(k, *rules[k]) for k in sorted(months)], "_kind string, _keep int, _hide int")
    rows = stored.filter(wanted).join(F.broadcast(bounds), F.col(kind_col) == F.col("_kind"))
    at, end = F.col(time_col), time_literal(now, stored.schema[time_col].dataType)
    rows = rows.filter(at >= end - F.make_dt_interval(F.col("_keep")))
    old = (F.col(HIDDEN) == 0) & F.coalesce(at < end - F.make_dt_interval(F.col("_hide")), F.lit(False))
    # All columns at once: each reads the side that the row comes from.
    return rows.withColumns({**pseudonyms(stored, identifying, old), HIDDEN: F.when(old, 1).otherwise(F.col(HIDDEN))}).select(*stored.columns)
