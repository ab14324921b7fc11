"""Per-key selection and joins that hold up when one key owns much of the data."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# A key is "hot" when it owns more rows than a task's fair load, one part in
# MIN_SHARE (or in as many as there are shuffle partitions, if more).
MIN_SHARE = 200
# Limits of the frequent-items sketch.
MAX_TOP, MAX_TRACKED = 100_000, 1_000_000


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of every key.

    A row-number filter lets the optimizer cut every input partition down to
    ``n`` rows per key before the shuffle, so a hot key sends at most
    ``n`` rows per map task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= n).drop("_rank")


def latest_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return top_per_key(df, keys, [F.col(order).desc()], 1)


def first_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return top_per_key(df, keys, [F.col(order).asc()], 1)


def split_first(df: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(first row per key, all later rows); ``order`` must be unique within a key.

    The minimum per key is pre-aggregated and matched on key *and* order value,
    which spreads a hot key over all tasks.  Null keys form one group.
    """
    match = keys + [order]
    firsts = df.groupBy(*keys).agg(F.min(order).alias(order))
    left, right = df.alias("l"), firsts.alias("r")
    same = F.lit(True)
    for name in match:
        same = same & F.col(f"l.{name}").eqNullSafe(F.col(f"r.{name}"))
    return left.join(right, same, "left_semi"), left.join(right, same, "left_anti")


def _share(df: DataFrame) -> int:
    """One part in this many is a task's fair load."""
    return max(MIN_SHARE, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def hot_values(df: DataFrame, key: str) -> list[tuple]:
    """(value, parts) of every key, null included, owning more rows than a task's fair load.

    Found with a mergeable frequent-items sketch: one pass, no shuffle of keys,
    and by counting never more values than there are fair loads.  ``parts`` is
    how many fair loads the key makes up.
    """
    share = _share(df)
    sketch = F.expr(f"approx_top_k(`{key}`, {min(share, MAX_TOP)}, {min(share * 10, MAX_TRACKED)})")
    row = df.agg(sketch.alias("top"), F.count(key).alias("n"), F.count("*").alias("rows")).first()
    counts = [(t["item"], t["count"]) for t in row["top"] if t["item"] is not None] + [(None, row["rows"] - row["n"])]
    return [(value, math.ceil(n * share / row["rows"])) for value, n in counts if n * share > row["rows"]]


def spread_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner", unique: bool = True,
                hot: list[tuple] | None = None) -> DataFrame:
    """Join a possibly skewed ``many`` side to ``one`` on ``key``, hot keys apart.

    Where ``one`` holds each key once (``unique``), its rows for hot keys number
    no more than the hot keys, so they are broadcast and the hot rows of
    ``many`` stay where they are.  Otherwise hot rows are salted: spread by
    their content over as many sub-keys as they make up fair loads.  Cold keys
    are joined as usual; null keys, which match nothing, are never gathered.
    Nothing is shuffled, and so nothing looked for, where all of ``one`` fits a
    broadcast.  Exact for inner, left, left_semi and left_anti joins.
    """
    if hot is None:
        hot = [] if fits_broadcast(one) else hot_values(many, key)
    if not hot:
        return many.join(one, key, how)
    if not unique:
        return _salted_join(many, one, key, how, hot)
    listed = F.col(key).isin([value for value, _ in hot if value is not None])
    stays = F.coalesce(listed, F.lit(True))
    apart = many.filter(stays).join(F.broadcast(one.filter(listed)), key, how)
    return apart.unionByName(many.filter(~stays).join(one.filter(~listed), key, how))


def _salted_join(many: DataFrame, one: DataFrame, key: str, how: str, hot: list[tuple]) -> DataFrame:
    kind = many.schema[key].dataType.simpleString()
    # As many rows as there are hot keys.
    salts = F.broadcast(local_rows(many.sparkSession, [h for h in hot if h[0] is not None], [(key, kind), ("_salts", "int")]))
    # Null keys match nothing wherever they go, so they go everywhere.
    parts = F.when(F.col(key).isNull(), F.lit(_share(many))).otherwise(F.coalesce("_salts", F.lit(1)))
    spread = F.pmod(F.xxhash64(*many.columns), parts.cast("long")).cast("int")
    left = many.join(salts, key, "left").withColumn("_salt", spread).drop("_salts")
    copies = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    right = one.join(salts, key, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def fits_broadcast(df: DataFrame) -> bool:
    """Whether the planner's size estimate of ``df`` is below its broadcast limit."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return 0 <= int(str(size)) <= limit


def having(df: DataFrame, keys: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose key occurs in ``keys`` (or, with ``left_anti``, does not).

    The keys are made distinct map-side first: a key repeated over and over
    would otherwise be shuffled and scanned whole by one task.
    """
    return spread_join(df, keys.select(key).distinct(), key, how)


def local_rows(spark: SparkSession, rows: list[tuple], schema: list[tuple[str, str]]) -> DataFrame:
    """A small DataFrame of driver-side values, as literals of the plan."""
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(k).alias(n) for n, k in schema])
    names = ", ".join(f"`{n}`: {k}" for n, k in schema)
    structs = [F.struct(*[F.lit(v).cast(k).alias(n) for v, (n, k) in zip(row, schema, strict=True)]) for row in rows]
    packed = F.array(*structs).cast(f"array<struct<{names}>>")
    return spark.range(1, numPartitions=1).select(F.inline(packed))
