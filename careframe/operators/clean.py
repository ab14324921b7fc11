"""Cleaning rules: an ordered rule table applied to a DataFrame.

Rules see the result of the rules before them.  Statistics are fetched for as
many rules at once as that allows: a new pass is only needed after a rule that
drops rows or changes a column a later rule measures.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from careframe.operators.keyed import first_per_key, hot_values, local_rows
from careframe.operators.profile import basic_stats, is_number, mode_of, nan_to_null, percentiles
from careframe.operators.quantiles import SMALL
from careframe.session import cut_lineage

MAX_RULES = 10_000
FENCE = 1.5
FILLS = ("fill_mean", "fill_median", "fill_mode")
LOG_SCHEMA = [("rule", "string"), ("action", "string"), ("affected_rows", "long"),
              ("original_rows", "long"), ("final_rows", "long"), ("dropped_rows", "long")]


@dataclass(frozen=True)
class Rule:
    name: str
    field_name: str
    rule_type: str
    action: str
    condition: dict = field(default_factory=dict)
    is_active: bool = True
    id: int = 0

    @property
    def drops(self) -> bool:
        return self.action == "drop" and self.rule_type in ("missing", "format", "duplicate")

    @property
    def fills(self) -> bool:
        return self.action in FILLS and self.rule_type == "missing"


def read_rules(rules: DataFrame) -> list[Rule]:
    """Rule objects from the rule table (configuration; refused when implausibly long)."""
    rows = rules.filter("is_active").orderBy("id").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} cleaning rules")
    return [Rule(r["name"], r["field_name"], r["rule_type"], r["action"],
                 json.loads(r["condition"] or "{}"), True, r["id"]) for r in rows]


def _batches(rules: list[Rule], columns: list[str]) -> list[list[Rule]]:
    """Longest runs of rules whose statistics do not depend on each other's effects."""
    known, runs, run = set(columns), [], []
    changed: set[str] = set()
    dropped = False
    for rule in rules:
        if rule.field_name not in known:
            continue
        if run and (dropped or rule.field_name in changed):
            runs.append(run)
            run, changed, dropped = [], set(), False
        run.append(rule)
        dropped = dropped or rule.drops
        if rule.fills:
            changed.add(rule.field_name)
        if rule.action == "flag" and rule.rule_type != "missing":
            # The flag column may itself be the field of a later rule.
            known.add(flag_column(rule))
            changed.add(flag_column(rule))
    return runs + [run] if run else runs


def flag_column(rule: Rule) -> str:
    suffix = {"outlier": "outlier", "format": "invalid", "duplicate": "duplicate"}[rule.rule_type]
    return f"{rule.field_name}_{suffix}"


def _beyond(column: str, q1: float | None, q3: float | None):
    """True outside the quartile fences; null counts as inside."""
    if q1 is None:
        return F.lit(False)
    reach = FENCE * (q3 - q1)
    at = F.col(column).cast("double")
    return F.coalesce((at < F.lit(q1 - reach)) | (at > F.lit(q3 + reach)), F.lit(False))


def _malformed(rule: Rule):
    """True for a value that is present and does not match the rule's pattern."""
    return F.coalesce(~F.rlike(F.col(rule.field_name).cast("string"), F.lit(rule.condition["regex"])), F.lit(False))


def _keys(rule: Rule) -> list[str]:
    return list(rule.condition.get("keys") or [rule.field_name])


def _repeat_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("_copies"))


def drop_repeats(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First row per key by ``order``."""
    return first_per_key(df, keys, order)


def flag_repeats(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Mark every row whose key occurs more than once; null keys equal each other.

    Keys are counted map-side first.  Rows of hot keys are marked where they
    are from a broadcast of the few hot keys, the others by a shuffled join.
    """
    repeated = _repeat_counts(df, keys).filter("_copies > 1").select(*keys)
    token = F.xxhash64(*keys)
    hot = [value for value, _ in hot_values(df.select(token.alias("_token")), "_token")]
    if not hot:
        return _marked(df, repeated, keys, name)
    is_hot = token.isin(hot)
    apart = _marked(df.filter(is_hot), F.broadcast(repeated.filter(is_hot)), keys, name)
    return apart.unionByName(_marked(df.filter(~is_hot), repeated.filter(~is_hot), keys, name))


def _marked(df: DataFrame, repeated: DataFrame, keys: list[str], name: str) -> DataFrame:
    other = repeated.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.lit(True).alias("_repeated"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    joined = df.join(other, same, "left")
    return joined.select(*df.columns, F.coalesce("_repeated", F.lit(False)).alias(name))


def _apply(df: DataFrame, rule: Rule, seen: dict, always_add: bool) -> DataFrame:
    name, count = rule.field_name, seen["count"]
    if rule.rule_type == "missing":
        if count == 0 or (rule.fills and seen.get("fill") is None):
            return df
        if rule.action == "drop":
            return df.dropna(subset=[name])
        if rule.action in ("fill_mean", "fill_median"):
            return df.withColumn(name, F.coalesce(F.col(name).cast("double"), F.lit(float(seen["fill"]))))
        if rule.action == "fill_mode":
            return df.withColumn(name, F.coalesce(F.col(name), F.lit(seen["fill"]).cast(df.schema[name].dataType)))
        return df
    if rule.rule_type == "outlier":
        if rule.action == "flag" and (count > 0 or always_add):
            return df.withColumn(flag_column(rule), _beyond(name, *seen["fences"]))
        return df
    if rule.rule_type == "format":
        if rule.action == "drop":
            return df.filter(~_malformed(rule))
        if rule.action == "flag" and (count > 0 or always_add):
            return df.withColumn(flag_column(rule), _malformed(rule))
        return df
    if rule.rule_type == "duplicate":
        if rule.action == "drop":
            return drop_repeats(df, _keys(rule), rule.condition["order"])
        if rule.action == "flag" and (count > 0 or always_add):
            return flag_repeats(df, _keys(rule), flag_column(rule))
    return df


def _measure(df: DataFrame, run: list[Rule], approx: bool, small: int) -> tuple[list[dict], int]:
    """What each rule of a run needs to know, and the number of rows."""
    columns = list(dict.fromkeys(r.field_name for r in run))
    stats = basic_stats(df, columns)
    rows = stats[columns[0]]["rows"]
    cuts: dict[str, list[float]] = {}
    for rule in run:
        quartiles = rule.rule_type == "outlier"
        median = rule.rule_type == "missing" and rule.action == "fill_median" and stats[rule.field_name]["nulls"]
        if quartiles or median:
            if not is_number(df, rule.field_name):
                raise TypeError(f"rule {rule.name!r} needs a number column, {rule.field_name!r} is not one")
            cuts[rule.field_name] = [0.25, 0.5, 0.75]
    points = percentiles(df, cuts, {c: stats[c]["n"] for c in cuts}, approx, small)

    seen: list[dict] = []
    counted, later = [], []
    for rule in run:
        info: dict = {"count": 0}
        column = rule.field_name
        if rule.rule_type == "missing":
            info["count"] = stats[column]["nulls"]
            if info["count"] and rule.action == "fill_mean":
                if not is_number(df, column):
                    raise TypeError(f"rule {rule.name!r} needs a number column, {column!r} is not one")
                info["fill"] = stats[column]["mean"]
            elif info["count"] and rule.action == "fill_median":
                info["fill"] = points[column][1]
            elif info["count"] and rule.action == "fill_mode":
                info["fill"] = mode_of(df, column)
        elif rule.rule_type == "outlier":
            info["fences"] = (points[column][0], points[column][2])
            counted.append(F.count_if(_beyond(column, *info["fences"])))
            later.append(info)
        elif rule.rule_type == "format":
            counted.append(F.count_if(_malformed(rule)))
            later.append(info)
        elif rule.rule_type == "duplicate":
            copies = F.col("_copies")
            extra = F.sum(copies - 1) if rule.action == "drop" else F.sum(F.when(copies > 1, copies))
            info["count"] = _repeat_counts(df, _keys(rule)).agg(extra.alias("n")).first()["n"] or 0
        seen.append(info)
    if counted:
        row = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(counted)]).first()
        for i, info in enumerate(later):
            info["count"] = row[i]
    return seen, rows


def clean(
    df: DataFrame, rules: list[Rule] | DataFrame, always_add: bool = False, approx: bool = False, small: int = SMALL,
    settle: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(cleaned rows, action log).

    Inactive rules and rules for absent columns are skipped.  Flag columns are
    added only where something was flagged, unless ``always_add``.  Statistics
    read the input several times: ``settle`` an input that is costly to compute.
    """
    if isinstance(rules, DataFrame):
        rules = read_rules(rules)
    rules = sorted((r for r in rules if r.is_active), key=lambda r: r.id)
    current = nan_to_null(cut_lineage(df) if settle else df)
    log: list[tuple] = []
    original = dropped = None
    for run in _batches(rules, df.columns):
        # Flag columns that no data called for do not exist; their rules are skipped.
        run = [r for r in run if r.field_name in current.columns]
        if not run:
            continue
        seen, rows = _measure(current, run, approx, small)
        if original is None:
            original, dropped = rows, 0
        for rule, info in zip(run, seen, strict=True):
            current = _apply(current, rule, info, always_add)
            if rule.rule_type != "missing" or info["count"] > 0:
                log.append((rule.name, rule.action, info["count"], None, None, None))
            if rule.drops:
                dropped += info["count"]
    if original is None:
        original, dropped = df.count(), 0
    log.append(("total", "summary", None, original, original - dropped, dropped))
    return current, local_rows(df.sparkSession, log, LOG_SCHEMA)
