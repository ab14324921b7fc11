"""Filters.  Each takes a DataFrame and returns a lazy, narrower one."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Risk levels in ascending order, and the two counted as high.
RISK_LEVELS = ("low", "moderate", "high", "very_high")
HIGH_LEVELS = ("high", "very_high")


def as_instant(moment: str | date | datetime) -> datetime:
    """Naive UTC datetime for any accepted form of ``as_of``."""
    if isinstance(moment, str):
        moment = datetime.fromisoformat(moment)
    if isinstance(moment, datetime):
        if moment.tzinfo is not None:
            moment = moment.astimezone(timezone.utc).replace(tzinfo=None)
        return moment
    return datetime(moment.year, moment.month, moment.day)


def time_literal(moment: str | date | datetime, dtype: T.DataType | None = None) -> Column:
    """Literal of the *column's* own time type.

    Comparing like with like keeps the cast off the column, so the predicate
    still reaches the file scan for ``timestamp_ntz`` and ``date`` columns.
    """
    instant = as_instant(moment)
    if isinstance(dtype, T.TimestampNTZType):
        return F.lit(instant.isoformat(sep=" ")).cast("timestamp_ntz")
    if isinstance(dtype, T.DateType):
        return F.lit(instant.date())
    return F.lit(instant.isoformat(sep=" ") + "Z").cast("timestamp")


def optional_eq(df: DataFrame, column: str, value, ci: bool = False) -> DataFrame:
    """Equality filter that is skipped for any falsy value (``None``, ``''``, 0)."""
    if not value:
        return df
    if ci:
        return df.filter(equals_ci(F.col(column), value))
    return df.filter(F.col(column) == F.lit(value))


def optional_flag(df: DataFrame, column: str, value: bool | None) -> DataFrame:
    """Boolean filter that is skipped only for ``None``; ``False`` filters."""
    return df if value is None else df.filter(F.col(column) == F.lit(value))


def equals_ci(column: Column, value: str) -> Column:
    return F.lower(column) == F.lower(F.lit(value))


def active_only(df: DataFrame) -> DataFrame:
    return df.filter("is_active")


def lookback(df: DataFrame, column: str, as_of, days: int, date_column: str | None = None) -> DataFrame:
    """Rows no older than ``days`` before ``as_of``; there is no upper bound.

    ``date_column`` names the date the table is partitioned by, so that old
    partitions are pruned too.
    """
    since = as_instant(as_of) - timedelta(days=days)
    kept = df.filter(F.col(column) >= time_literal(since, df.schema[column].dataType))
    if date_column:
        kept = kept.filter(F.col(date_column) >= F.lit(since.date()))
    return kept


def search(df: DataFrame, text: str | None, columns: list[str]) -> DataFrame:
    """Case-insensitive literal substring in any of ``columns``; falsy text keeps all."""
    if not text:
        return df
    needle = F.lower(F.lit(text))
    hit = F.lit(False)
    for name in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(name)), needle), F.lit(False))
    return df.filter(hit)


def is_high(level: Column) -> Column:
    return level.isin(*HIGH_LEVELS)


def high_risk_only(df: DataFrame, column: str = "risk_level") -> DataFrame:
    return df.filter(is_high(F.col(column)))
