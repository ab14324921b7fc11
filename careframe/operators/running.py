"""Running totals over a global order, without sorting everything in one task."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

SLICES = 256
ACCURACY = 10_000


def running_totals(df: DataFrame, order_col: str, sums: list[str], slices: int = SLICES) -> DataFrame:
    """Add ``<name>_before``: the total of ``name`` over all rows with a smaller ``order_col``.

    ``order_col`` must be unique and not null, so group by it first: that also
    folds a value shared by a third of all rows into one row.  Slice bounds
    come from a sketch of the values, slice totals (at most ``slices`` rows)
    are accumulated on their own, and each slice is ordered by its own task.
    """
    points = [i / slices for i in range(1, slices)]
    found = df.agg(F.percentile_approx(order_col, F.array(*[F.lit(p) for p in points]), F.lit(ACCURACY))).first()[0]
    bounds = [-math.inf, *(sorted(set(found or [])) or [0.0]), math.inf]
    placed = Bucketizer(splits=bounds, inputCol=order_col, outputCol="_slice").transform(df)
    # At most `slices` rows: one window over them is bounded.
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_slice").agg(*[F.sum(s).alias(s) for s in sums]).select(
        "_slice", *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"_{s}_base") for s in sums])
    within = Window.partitionBy("_slice").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(F.broadcast(totals), "_slice")
    return joined.withColumns({
        f"{s}_before": F.col(f"_{s}_base") + F.coalesce(F.sum(s).over(within), F.lit(0)) for s in sums
    }).drop("_slice", *[f"_{s}_base" for s in sums])
