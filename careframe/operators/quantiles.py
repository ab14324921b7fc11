"""Exact order statistics of columns of any size.

The built-in ``percentile`` and ``mode`` keep every distinct value of a column
in one task.  Here a column is only handed to ``percentile`` while it is known
to be small; otherwise each wanted rank is bracketed with a mergeable sketch,
the rows on either side are *counted*, and the bracket shrinks until its value
is certain.  Every pass is one map-side-combined aggregate for all ranks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SMALL = 200_000
ACCURACY = 10_000
SLACK = 2.0  # sketch errors (one is 1/accuracy) kept free on either side of a rank


def clean_number(column: Column) -> Column:
    """As double with NaN turned into null.

    ``nanvl`` mentions the column once: where plans are merged, every mention
    becomes a copy of whatever computes the column.
    """
    return F.nanvl(column.cast("double"), F.lit(None).cast("double"))


@dataclass
class _Search:
    """Ranks still wanted among the ``size`` values strictly between ``low`` and ``high``.

    ``ranks`` maps each rank, counted from the start of the interval, to the
    rank in the whole column it stands for.
    """

    column: str
    ranks: dict[int, int]
    size: int
    low: float | None = None
    high: float | None = None

    @property
    def interval(self) -> tuple:
        return self.column, self.low, self.high

    def inside(self) -> Column:
        at = F.col(self.column)
        if self.low is None and self.high is None:
            return at.isNotNull()
        if self.low is None:
            return at < F.lit(self.high)
        if self.high is None:
            return at > F.lit(self.low)
        return (at > F.lit(self.low)) & (at < F.lit(self.high))

    def around(self, accuracy: int) -> list[float]:
        """Fractions a sketch surely finds on either side of the wanted ranks."""
        slack = SLACK / accuracy
        return [max(0.0, min(self.ranks) / self.size - slack), min(1.0, max(self.ranks) / self.size + slack)]

    def narrow(self, a, b, below: int, at_a: int, between: int, at_b: int) -> tuple[dict, list["_Search"]]:
        """(values found, searches left), given exact counts of the parts around a bracket."""
        found, left = {}, {}
        for rank, wanted in self.ranks.items():
            if rank < below:
                left.setdefault((self.low, a, below), {})[rank] = wanted
            elif rank < below + at_a:
                found[self.column, wanted] = a
            elif rank < below + at_a + between:
                left.setdefault((a, b, between), {})[rank - below - at_a] = wanted
            elif rank < below + at_a + between + at_b:
                found[self.column, wanted] = b
            else:
                start = below + at_a + between + at_b
                left.setdefault((b, self.high, self.size - start), {})[rank - start] = wanted
        return found, [_Search(self.column, ranks, size, low, high) for (low, high, size), ranks in left.items()]


def _scope(df: DataFrame, searches: list[_Search]) -> DataFrame:
    """Only rows some search still needs (a filter the file scan can use)."""
    if any(s.low is None and s.high is None for s in searches):
        return df
    keep = F.lit(False)
    for search in searches:
        keep = keep | search.inside()
    return df.filter(keep)


def _brackets(df: DataFrame, searches: list[_Search], accuracy: int) -> list[tuple]:
    """(a, b) around the ranks of each search; one sketch per distinct interval."""
    fractions: dict[tuple, list[float]] = {}
    owners: dict[tuple, _Search] = {}
    places = []
    for s in searches:
        points = fractions.setdefault(s.interval, [])
        owners.setdefault(s.interval, s)
        places.append((list(fractions).index(s.interval), len(points)))
        points += s.around(accuracy)
    sketches = [
        F.percentile_approx(F.when(owners[key].inside(), F.col(key[0])), F.array(*[F.lit(p) for p in points]),
                            F.lit(accuracy)).alias(f"s{i}")
        for i, (key, points) in enumerate(fractions.items())]
    row = _scope(df, searches).agg(*sketches).first()
    return [(row[i][at], row[i][at + 1]) for i, at in places]


def _pick(df: DataFrame, searches: list[_Search]) -> dict[tuple[str, int], float]:
    """Wanted values of intervals known to hold few rows."""
    picks = []
    for i, s in enumerate(searches):
        ordered = F.array_sort(F.collect_list(F.when(s.inside(), F.col(s.column))))
        picks.append(F.transform(F.array(*[F.lit(r) for r in s.ranks]), lambda r: F.get(ordered, r)).alias(f"p{i}"))
    row = _scope(df, searches).agg(*picks).first()
    return {(s.column, rank): value for s, values in zip(searches, row) for rank, value in zip(s.ranks.values(), values)}


def _count_parts(df: DataFrame, searches: list[_Search], brackets: list[tuple]) -> list[list[int]]:
    """Rows below, at, between, and at the end of each bracket, within its interval."""
    counts = []
    for s, (a, b) in zip(searches, brackets):
        at, inside = F.col(s.column), s.inside()
        for part in (at < a, at == a, (at > a) & (at < b), (at == b) & F.lit(a < b)):
            counts.append(F.count_if(inside & part).alias(f"c{len(counts)}"))
    row = _scope(df, searches).agg(*counts).first()
    return [list(row[4 * i: 4 * i + 4]) for i in range(len(searches))]


def select_ranks(df: DataFrame, wanted: list[tuple[str, list[int], int]], small: int = SMALL,
                 accuracy: int = ACCURACY) -> dict[tuple[str, int], float]:
    """{(column, rank): value} for (column, zero-based ranks, non-null row count), ascending order.

    Ranks listed together should lie close together: they share a bracket.
    """
    values: dict[tuple[str, int], float] = {}
    searches = [_Search(column, {r: r for r in ranks}, size) for column, ranks, size in wanted]
    while wide := [s for s in searches if s.size > small]:
        searches = [s for s in searches if s.size <= small]
        brackets = _brackets(df, wide, accuracy)
        for s, bracket, parts in zip(wide, brackets, _count_parts(df, wide, brackets)):
            found, left = s.narrow(*bracket, *parts)
            values.update(found)
            searches += left
    if searches:
        values.update(_pick(df, searches))
    return values


def exact_percentiles(
    df: DataFrame, wanted: dict[str, list[float]], sizes: dict[str, int] | None = None,
    small: int = SMALL, accuracy: int = ACCURACY,
) -> dict[str, list[float | None]]:
    """Linearly interpolated percentiles of number columns, ignoring null and NaN."""
    numbers = df.select(*[clean_number(F.col(c)).alias(c) for c in wanted])
    if sizes is None:
        row = numbers.agg(*[F.count(c).alias(c) for c in wanted]).first()
        sizes = {c: row[c] for c in wanted}
    found: dict[str, list[float | None]] = {c: [None] * len(ps) for c, ps in wanted.items()}

    few = [c for c in wanted if 0 < sizes[c] <= small and wanted[c]]
    if few:
        exprs = [F.percentile(c, F.array(*[F.lit(float(p)) for p in wanted[c]])).alias(c) for c in few]
        row = numbers.agg(*exprs).first()
        for c in few:
            found[c] = list(row[c])

    spots = []
    for c, ps in wanted.items():
        if sizes[c] > small:
            for i, p in enumerate(ps):
                at = p * (sizes[c] - 1)
                spots.append((c, i, math.floor(at), at - math.floor(at)))
    if spots:
        ranks = [(c, [r, r + 1] if share > 0 else [r], sizes[c]) for c, _, r, share in spots]
        values = select_ranks(numbers, ranks, small, accuracy)
        for c, i, r, share in spots:
            low = values[c, r]
            found[c][i] = low + (values[c, r + 1] - low) * share if share > 0 else low
    return found


def approx_percentiles(df: DataFrame, wanted: dict[str, list[float]], accuracy: int = ACCURACY) -> dict[str, list]:
    """Percentiles from a mergeable sketch: one pass, rank error at most 1/accuracy."""
    exprs = [
        F.percentile_approx(clean_number(F.col(c)), F.array(*[F.lit(float(p)) for p in ps]), F.lit(accuracy)).alias(c)
        for c, ps in wanted.items()
    ]
    row = df.agg(*exprs).first()
    return {c: list(row[c] or [None] * len(ps)) for c, ps in wanted.items()}


def mode_of(df: DataFrame, column: str):
    """Most frequent value, smallest on ties; counted per value, never gathered."""
    value = F.col(column)
    if dict(df.dtypes)[column] in ("float", "double"):
        value = F.nanvl(value, F.lit(None).cast("double"))
    counts = df.select(value.alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    row = counts.orderBy(F.desc("n"), "v").limit(1).first()
    return None if row is None else row["v"]


def kth_value(df: DataFrame, column: str, rank: int, small: int = SMALL):
    """Value at a zero-based rank in ascending order, or ``None`` past the end."""
    values = df.select(column).filter(F.col(column).isNotNull())
    size = values.count()
    return select_ranks(values, [(column, [rank], size)], small)[column, rank] if rank < size else None
