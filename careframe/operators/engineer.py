"""Feature transforms: an ordered transform table applied to a DataFrame."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from careframe.functions.bins import age_code, cut, equal_width_edges
from careframe.operators.profile import basic_stats, nan_to_null
from careframe.session import cut_lineage

MAX_TRANSFORMS = 10_000
DEFAULT_BINS = 4
MAX_CATEGORIES = 200


@dataclass(frozen=True)
class Transform:
    source_field: str
    transform_type: str
    output_field: str
    parameters: dict = field(default_factory=dict)
    name: str = ""
    is_active: bool = True
    id: int = 0

    @property
    def counts_values(self) -> bool:
        return self.transform_type == "onehot" and "categories" not in self.parameters

    @property
    def needs_stats(self) -> bool:
        whole_bins = self.transform_type == "binning" and not isinstance(self.parameters.get("bins", 0), list)
        return self.transform_type in ("scale", "standardize") or whole_bins


def read_transforms(transforms: DataFrame) -> list[Transform]:
    """Transform objects from the transform table (configuration)."""
    rows = transforms.filter("is_active").orderBy("id").limit(MAX_TRANSFORMS + 1).collect()
    if len(rows) > MAX_TRANSFORMS:
        raise ValueError(f"more than {MAX_TRANSFORMS} feature transforms")
    return [Transform(r["source_field"], r["transform_type"], r["output_field"],
                      json.loads(r["parameters"] or "{}"), r["name"], True, r["id"]) for r in rows]


def _at_least_zero(column: str) -> Column:
    return F.when(F.col(column).isNotNull(), F.greatest(F.col(column).cast("double"), F.lit(0.0)))


def _categories(df: DataFrame, column: str) -> list:
    """Distinct values of a category column; refused when there are too many for columns."""
    rows = df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).limit(MAX_CATEGORIES + 1).collect()
    if len(rows) > MAX_CATEGORIES:
        raise ValueError(f"{column!r} has more than {MAX_CATEGORIES} distinct values; give the wanted categories")
    return [r[0] for r in rows]


def _outputs(df: DataFrame, step: Transform, stats: dict | None, always_add: bool) -> dict[str, Column]:
    """New columns of one transform; empty where the data do not allow any."""
    source, out = step.source_field, step.output_field
    at = F.col(source)
    number = at.cast("double")
    missing = {out: F.lit(None).cast("double")} if always_add else {}
    kind = step.transform_type
    if kind == "log":
        return {out: F.log1p(_at_least_zero(source))}
    if kind == "sqrt":
        return {out: F.sqrt(_at_least_zero(source))}
    if kind == "scale":
        low, high = stats["min"], stats["max"]
        if low is None or not high > low:
            return missing
        return {out: (number - F.lit(low)) / F.lit(high - low)}
    if kind == "standardize":
        if not stats["std"]:
            return missing
        return {out: (number - F.lit(stats["mean"])) / F.lit(stats["std"])}
    if kind == "binning":
        bins, labels = step.parameters.get("bins", DEFAULT_BINS), step.parameters.get("labels")
        if labels is False:  # bin numbers instead of labels
            labels = list(range(len(bins) - 1 if isinstance(bins, list) else bins))
        if isinstance(bins, list):
            return {out: cut(at, bins, labels)}
        if stats["min"] is None:
            return {out: F.lit(None).cast("string")}
        return {out: cut(number, equal_width_edges(stats["min"], stats["max"], bins), labels)}
    if kind == "onehot":
        values = step.parameters.get("categories") or _categories(df, source)
        return {f"{out}_{v}": F.coalesce((at == F.lit(v)).cast("int"), F.lit(0)) for v in values}
    if kind == "interaction":
        return {out: number * F.col(step.parameters["other"]).cast("double")}
    return {}


def domain_features(df: DataFrame) -> DataFrame:
    """Exposure index and encoded age group, where their source columns exist."""
    made = {}
    if {"num_partners_12m", "condom_use_freq"} <= set(df.columns):
        made["risk_exposure_index"] = F.col("num_partners_12m") * (F.lit(1) - F.col("condom_use_freq"))
    if "age" in df.columns:
        made["age_group_encoded"] = age_code(F.col("age"))
    return df.withColumns(made) if made else df


def engineer(df: DataFrame, transforms: list[Transform] | DataFrame, always_add: bool = False,
             settle: bool = False) -> DataFrame:
    """Add the transforms' columns in order, then the domain features.

    Statistics of all transforms whose source is already there are fetched in
    one aggregate; another pass is made only for a transform of a transform.
    ``settle`` an input that is costly to compute, as each pass reads it again.
    """
    if isinstance(transforms, DataFrame):
        transforms = read_transforms(transforms)
    steps = sorted((t for t in transforms if t.is_active), key=lambda t: t.id)
    current, stats = nan_to_null(cut_lineage(df) if settle else df), {}
    for place, step in enumerate(steps):
        if step.source_field not in current.columns:
            continue
        if step.needs_stats and step.source_field not in stats:
            ahead = {t.source_field for t in steps[place:] if t.needs_stats and t.source_field in current.columns}
            stats |= basic_stats(current, sorted(ahead - set(stats)))
        made = _outputs(current, step, stats.get(step.source_field), always_add)
        current = current.withColumns(made) if made else current
        for name in made:
            stats.pop(name, None)
    return domain_features(current)
