"""The last earlier row of another table for every row, hot keys in slices of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from careframe.operators.keyed import hot_values, local_rows

SLICES = 64


def _slice_of(at: Column, bounds: list) -> Column:
    """How many of the bounds are at or below ``at``."""
    listed = F.array(*[F.lit(b) for b in bounds])
    return F.size(F.filter(listed, lambda b: b <= at))


def as_of_join(
    left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, order_col: str, columns: list[str],
    name: str = "as_of", slices: int = SLICES,
) -> DataFrame:
    """``left`` with ``name``: a struct of ``columns`` of the last ``right`` row of the key whose time is at or before the row's.

    Of right rows at one instant the one with the largest ``order_col`` counts.  Null where there is none, or where key or time is
    null.  Both sides are shuffled once, together.  A key that owns more than a task's fair load is cut into slices of
    time; what a slice inherits is the last right row of the earlier slices, one row per hot key and slice.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    value = F.struct(*columns)
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    stated = right.filter(F.col(key).isNotNull() & F.col(right_time).isNotNull()).select(
        F.col(key).alias("key"), micros(right_time).alias("at"), F.lit(0).alias("side"), F.col(order_col).alias("order"), value.alias("value"))
    asked = left.select(F.col(key).alias("key"), micros(left_time).alias("at"), F.lit(1).alias("side"),
                        F.lit(None).cast(stated.schema["order"].dataType).alias("order"), row.alias("row"))
    both = stated.unionByName(asked, allowMissingColumns=True)
    alone = F.col("key").isNull() | F.col("at").isNull()
    unknown = F.lit(None).cast(stated.schema["value"].dataType)
    hot = [v for v, _ in hot_values(both.select("key"), "key") if v is not None]
    rows = both.filter(~alone)
    if hot:
        kind = both.schema["key"].dataType.simpleString()
        # As many rows as there are hot keys.
        marked = F.broadcast(local_rows(left.sparkSession, [(v, True) for v in hot], [("key", kind), ("hot", "boolean")]))
        rows = rows.join(marked, "key", "left")
        points = [i / slices for i in range(1, slices)]
        bounds = rows.filter("hot").agg(F.percentile_approx("at", F.array(*[F.lit(p) for p in points]))).first()[0] or []
        bounds = sorted(set(bounds))
        rows = rows.withColumn("slice", F.when(F.col("hot"), _slice_of(F.col("at"), bounds)).otherwise(0)).drop("hot")
        ends = rows.filter((F.col("side") == 0) & F.col("key").isin(hot)).groupBy("key", "slice").agg(
            F.max_by("value", F.struct("at", "order")).alias("value"))
        spine = marked.select("key", F.explode(F.sequence(F.lit(0), F.lit(len(bounds)))).alias("slice"))
        earlier = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        inherited = spine.join(ends, ["key", "slice"], "left").select(
            "key", "slice", F.last("value", True).over(earlier).alias("value"), F.lit(-1).alias("side")).filter("value is not null")
        rows = rows.unionByName(inherited, allowMissingColumns=True)
    else:
        rows = rows.withColumn("slice", F.lit(0))
    upto = Window.partitionBy("key", "slice").orderBy(F.col("side") >= 0, "at", "side", "order").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn(name, F.last("value", True).over(upto)).filter(F.col("side") == 1).select("row.*", name)
    return found.unionByName(both.filter((F.col("side") == 1) & alone).select("row.*", unknown.alias(name)))
