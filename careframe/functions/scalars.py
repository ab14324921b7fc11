"""Column expressions: ages, bands, risk levels, intervals, labels, JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Upper bound (exclusive) and label of every age band but the last.
AGE_BANDS = (
    (15, "<15"),
    (20, "15-19"),
    (25, "20-24"),
    (30, "25-29"),
    (35, "30-34"),
    (40, "35-39"),
    (50, "40-49"),
)
LAST_AGE_BAND = "50+"

# Upper bound (exclusive) and name of every risk level but the last.
LEVEL_BOUNDS = ((0.25, "low"), (0.50, "moderate"), (0.75, "high"))
LAST_LEVEL = "very_high"


def _banded(value: Column, bounds: Sequence[tuple], last: str) -> Column:
    chain = F.when(value.isNull(), F.lit(None).cast("string"))
    for upper, label in bounds:
        chain = chain.when(value < F.lit(upper), F.lit(label))
    return chain.otherwise(F.lit(last))


def age_years(born: Column, on: Column) -> Column:
    """Completed years: one less until the month and day of birth come round."""
    before_birthday = F.date_format(on, "MMdd") < F.date_format(born, "MMdd")
    return (F.year(on) - F.year(born) - before_birthday.cast("int")).cast("int")


def age_band(age: Column) -> Column:
    """Left-closed band label (15 belongs to ``15-19``)."""
    return _banded(age, AGE_BANDS, LAST_AGE_BAND)


def full_name(first: Column, last: Column) -> Column:
    return F.concat(first, F.lit(" "), last)


def risk_level(score: Column) -> Column:
    """Level of an *unrounded* score."""
    return _banded(score, LEVEL_BOUNDS, LAST_LEVEL)


def clamp(value: Column, low: float | None = 0.0, high: float | None = 1.0) -> Column:
    """Limit a value to ``[low, high]``.  ``least``/``greatest`` skip nulls, hence the guard."""
    limited = value
    if low is not None:
        limited = F.greatest(F.lit(float(low)), limited)
    if high is not None:
        limited = F.least(F.lit(float(high)), limited)
    return F.when(value.isNotNull(), limited)


def interval(score: Column, half_width: float) -> tuple[Column, Column]:
    """Score minus and plus ``half_width``, kept inside [0, 1], to four digits."""
    lower = clamp(score - F.lit(half_width), low=0.0, high=None)
    upper = clamp(score + F.lit(half_width), low=None, high=1.0)
    return F.round(lower, 4), F.round(upper, 4)


def flag(column: Column) -> Column:
    """Boolean as 0.0 / 1.0; null counts as false."""
    return F.coalesce(column.cast("double"), F.lit(0.0))


def indicator(column: Column, *values: str) -> Column:
    """1.0 where the column is one of ``values``, else 0.0."""
    return flag(column.isin(*values))


def utc_day(moment: Column) -> Column:
    """Calendar day (the session time zone is UTC)."""
    return F.to_date(moment)


def zero_if_null(value: Column, digits: int | None = None) -> Column:
    filled = F.coalesce(value, F.lit(0.0))
    return filled if digits is None else F.round(filled, digits)


def period_label(days: int) -> Column:
    return F.lit(f"Last {days} days")


def text_map(document: Column) -> Column:
    """JSON object text as ``map<string,string>``."""
    return F.from_json(document, "map<string,string>")


def text_list(document: Column) -> Column:
    """JSON array text as ``array<string>``."""
    return F.from_json(document, "array<string>")
