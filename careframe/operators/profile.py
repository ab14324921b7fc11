"""Column statistics that imputation, scaling and outlier rules are built on."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from careframe.operators.keyed import local_rows
from careframe.operators.quantiles import SMALL, approx_percentiles, clean_number, exact_percentiles, mode_of

PROFILE_COLUMNS = ("column", "rows", "nulls", "mean", "median", "mode", "q25", "q75", "min", "max", "std")


def is_number(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating columns with NaN turned into null: Spark would compare and average NaN."""
    fixes = {
        f.name: F.nanvl(f.name, F.lit(None).cast(f.dataType))
        for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(fixes) if fixes else df


def basic_stats(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """Rows, nulls and, for numbers, mean, sample deviation, min and max; one aggregate for all columns."""
    exprs = [F.count("*").alias("rows")]
    for i, name in enumerate(columns):
        if is_number(df, name):
            at = clean_number(F.col(name))
            exprs += [F.count(at).alias(f"n{i}"), F.avg(at).alias(f"mean{i}"), F.stddev_samp(at).alias(f"std{i}"),
                      F.min(at).alias(f"min{i}"), F.max(at).alias(f"max{i}")]
        else:
            exprs.append(F.count(name).alias(f"n{i}"))
    row = df.agg(*exprs).first().asDict()
    found = {}
    for i, name in enumerate(columns):
        found[name] = {k: row.get(f"{k}{i}") for k in ("n", "mean", "std", "min", "max")}
        found[name] |= {"rows": row["rows"], "nulls": row["rows"] - row[f"n{i}"]}
    return found


def percentiles(df: DataFrame, wanted: dict[str, list[float]], sizes: dict[str, int], approx: bool = False,
                small: int = SMALL) -> dict[str, list]:
    if not wanted:
        return {}
    return approx_percentiles(df, wanted) if approx else exact_percentiles(df, wanted, sizes, small)


def column_profile(df: DataFrame, columns: list[str], approx: bool = False, small: int = SMALL) -> DataFrame:
    """One row of statistics per number column (eager: a few passes, tiny result)."""
    stats = basic_stats(df, columns)
    cuts = percentiles(df, {c: [0.25, 0.5, 0.75] for c in columns}, {c: stats[c]["n"] for c in columns}, approx, small)
    rows = []
    for c in columns:
        s, (q25, median, q75), mode = stats[c], cuts[c], mode_of(df, c)
        rows.append((c, s["rows"], s["nulls"], s["mean"], median, None if mode is None else float(mode),
                     q25, q75, s["min"], s["max"], s["std"]))
    kinds = ["string", "long", "long"] + ["double"] * 8
    return local_rows(df.sparkSession, rows, list(zip(PROFILE_COLUMNS, kinds, strict=True)))
