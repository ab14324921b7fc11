"""Batch maintenance of the domain tables.

Without a catalog that can update rows in place, each function returns the new
table; write it to a *new* path, never over the one being read.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from careframe.functions.predicates import as_instant, time_literal
from careframe.functions.scalars import utc_day
from careframe.operators.keyed import fits_broadcast, latest_per_key, split_first

# Model defaults of patient columns that an insert leaves out.
PATIENT_DEFAULTS = {
    "phone": "", "email": "", "address": "", "marital_status": "single",
    "number_of_partners_12m": 0, "number_of_partners_lifetime": 0, "condom_use_frequency": 0.0,
    "substance_use": False, "substance_type": "", "prior_sti_history": False, "prior_sti_types": "",
    "hiv_status_known": False, "hiv_status": "unknown", "symptoms_present": False, "symptom_description": "",
    "county": "", "sub_county": "", "ward": "", "is_active": True,
}
REQUIRED_COLUMNS = ("patient_id", "first_name", "last_name", "date_of_birth", "gender")
GENDERS = ("M", "F", "O", "U")

# Patient columns that a patch may change.
PATCHABLE = (
    "first_name", "last_name", "phone", "email", "number_of_partners_12m",
    "condom_use_frequency", "substance_use", "symptoms_present", "is_active",
)

# Model registry states.
READY, DEPLOYED, DEPRECATED = "ready", "deployed", "deprecated"


def _stamp(df: DataFrame, column: str, as_of) -> Column:
    return time_literal(as_of, df.schema[column].dataType)


def upsert(
    current: DataFrame, incoming: DataFrame, key: str, order_col: str, update_cols: list[str], as_of,
    defaults: dict | None = None,
) -> DataFrame:
    """Insert new keys, update ``update_cols`` of known ones; the last incoming row of a key wins.

    Incoming rows without a key are not taken.  New rows get ``defaults`` elsewhere; ``created_at`` is kept, ``updated_at``
    set.  While the incoming rows fit a broadcast the table is not shuffled;
    beyond that both sides meet in one shuffle on the key, which the reduction
    to one row per key already provides for the incoming side.
    """
    defaults = PATIENT_DEFAULTS if defaults is None else defaults
    latest = latest_per_key(incoming.filter(F.col(key).isNotNull()), [key], order_col).select(
        F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in update_cols])
    table, same = current.withColumn("_known", F.lit(True)), F.col(key) == F.col("_key")
    if fits_broadcast(latest):
        kept = table.join(latest, same, "left")
        known_keys = current.select(key).join(latest.select("_key"), same, "left_semi")
        added = latest.join(known_keys, same, "left_anti")
        joined = kept.unionByName(added, allowMissingColumns=True)
    else:
        joined = table.join(latest, same, "full_outer")
    known, changed = F.col("_known").isNotNull(), F.col("_key").isNotNull()
    columns = []
    for field in current.schema.fields:
        name, old = field.name, F.col(field.name)
        if name == key:
            value = F.coalesce(old, F.col("_key"))
        elif name in update_cols:
            value = F.when(changed, F.col(f"_new_{name}").cast(field.dataType)).otherwise(old)
        elif name == "created_at":
            value = F.when(known, old).otherwise(_stamp(current, name, as_of))
        elif name == "updated_at":
            value = F.when(changed, _stamp(current, name, as_of)).otherwise(old)
        else:
            value = F.when(known, old).otherwise(F.lit(defaults.get(name)).cast(field.dataType))
        columns.append(value.alias(name))
    return joined.select(*columns)


def _registration_errors(columns: list[str]) -> Column:
    found = [F.when(F.col(c).isNull() if c in columns else F.lit(True), F.lit(f"missing {c}")) for c in REQUIRED_COLUMNS]
    if "gender" in columns:
        found.append(F.when(~F.col("gender").isin(*GENDERS), F.lit("gender must be one of M, F, O, U")))
    if "condom_use_frequency" in columns:
        found.append(F.when(~F.col("condom_use_frequency").between(0, 1), F.lit("condom_use_frequency out of range")))
    for name in ("number_of_partners_12m", "number_of_partners_lifetime"):
        if name in columns:
            found.append(F.when(F.col(name) < 0, F.lit(f"{name} cannot be negative")))
    return F.array_compact(F.array(*found))


def append_validated(
    current: DataFrame, incoming: DataFrame, order_col: str, key: str = "patient_id",
) -> tuple[DataFrame, DataFrame]:
    """(rows to append with defaults filled, rejected rows with ``errors``).

    Of several valid rows with one new key the first is accepted; keys that
    already exist are rejected.
    """
    checked = incoming.withColumn("errors", _registration_errors(incoming.columns))
    invalid = checked.filter(F.size("errors") > 0)
    valid = checked.filter(F.size("errors") == 0).drop("errors")
    firsts, repeats = split_first(valid, [key], order_col)
    keys = current.select(key)
    accepted = firsts.join(keys, key, "left_anti")
    taken = firsts.join(keys, key, "left_semi")

    def because(df: DataFrame, text: str) -> DataFrame:
        return df.withColumn("errors", F.array(F.lit(text)))

    rejected = invalid.unionByName(because(repeats, f"{key} repeated in batch")).unionByName(
        because(taken, f"{key} already exists"))
    filled = {
        name: F.coalesce(F.col(name), F.lit(value)) if name in incoming.columns else F.lit(value)
        for name, value in PATIENT_DEFAULTS.items()}
    return accepted.withColumns(filled).drop(order_col), rejected


# Patchable columns that are not text.
PATCH_TYPES = {"number_of_partners_12m": "int", "condom_use_frequency": "double", "substance_use": "boolean",
               "symptoms_present": "boolean", "is_active": "boolean"}


def accepted_patches(patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, refused): a patch that gives a patchable column null, or a value not of its type, is refused whole."""
    bad = F.exists(F.map_entries("fields"), lambda e: e["key"].isin(*PATCHABLE) & e["value"].isNull())
    for name, kind in PATCH_TYPES.items():
        value = F.col("fields").getItem(name)
        bad = bad | (value.isNotNull() & value.try_cast(kind).isNull())
    bad = F.coalesce(bad, F.lit(False))
    return patches.filter(~bad), patches.filter(bad)


def _patched(supplied: Column, old: Column, kind) -> Column:
    value = supplied["value"].try_cast(kind)
    return F.when(supplied.isNotNull() & (supplied["value"].isNull() | value.isNotNull()), value).otherwise(old)


def patch(
    df: DataFrame, patches: DataFrame, key: str, as_of=None, cols: list[str] = PATCHABLE, order_col: str = "seq",
) -> DataFrame:
    """Change only the fields each patch supplies; later patches of a key win per field.

    ``patches`` holds ``key``, ``order_col`` and ``fields``, a text map.  A field
    supplied as null sets null, one not supplied or not of the column's type stays.
    """
    cols = [c for c in cols if c in df.columns]
    latest = []
    for name in cols:
        supplied = F.map_contains_key("fields", F.lit(name))
        value = F.struct(F.col("fields").getItem(name).alias("value"))
        latest.append(F.max_by(value, F.when(supplied, F.col(order_col))).alias(f"_new_{name}"))
    merged = patches.groupBy(key).agg(*latest).withColumn("_patched", F.lit(True))
    joined = df.join(merged, key, "left")
    changes = {
        name: _patched(F.col(f"_new_{name}"), F.col(name), df.schema[name].dataType) for name in cols}
    if as_of is not None and "updated_at" in df.columns:
        changes["updated_at"] = F.when(F.col("_patched"), _stamp(df, "updated_at", as_of)).otherwise(F.col("updated_at"))
    return joined.withColumns(changes).select(*df.columns)


def deactivate(df: DataFrame, keys: DataFrame, key: str, as_of=None) -> DataFrame:
    """Soft delete: ``is_active`` becomes false for the given keys."""
    gone = keys.select(key).distinct().withColumn("_gone", F.lit(True))
    joined = df.join(gone, key, "left")
    hit = F.col("_gone").isNotNull()
    changes = {"is_active": F.when(hit, F.lit(False)).otherwise(F.col("is_active"))}
    if as_of is not None and "updated_at" in df.columns:
        changes["updated_at"] = F.when(hit, _stamp(df, "updated_at", as_of)).otherwise(F.col("updated_at"))
    return joined.withColumns(changes).select(*df.columns)


def apply_feedback(predictions: DataFrame, feedback: DataFrame, order_col: str = "seq") -> DataFrame:
    """Mark predictions as validated and store clinicians' notes and outcomes.

    ``feedback`` holds ``id``, ``order_col``, ``notes`` and ``actual_outcome``.
    The last notes win; the outcome changes only where one was given.
    """
    order = F.col(order_col)
    given = F.length("actual_outcome") > 0
    merged = feedback.groupBy("id").agg(
        F.coalesce(F.max_by(F.coalesce("notes", F.lit("")), order), F.lit("")).alias("_notes"),
        F.max_by("actual_outcome", F.when(given, order)).alias("_outcome"),
    ).withColumn("_seen", F.lit(True))
    joined = predictions.join(merged, "id", "left")
    seen = F.col("_seen").isNotNull()
    return joined.withColumns({
        "validated_by_clinician": F.col("validated_by_clinician") | seen,
        "clinician_notes": F.when(seen, F.col("_notes")).otherwise(F.col("clinician_notes")),
        "actual_outcome": F.coalesce("_outcome", "actual_outcome"),
    }).select(*predictions.columns)


def promote(models: DataFrame, targets: DataFrame, as_of=None, order_col: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(new registry, refused targets).

    Only ``ready`` models can be promoted.  Promotion retires the defaults of
    the same name; of several targets of one name the last is left deployed.
    A second request for a model finds it no longer ready.
    """
    ready = models.filter(F.col("status") == READY).select("id", "name")
    firsts, repeats = split_first(targets.select("id", order_col), ["id"], order_col)
    accepted = firsts.join(ready, "id")
    refused = firsts.join(ready, "id", "left_anti").unionByName(repeats)
    winners = latest_per_key(accepted, ["name"], order_col).select("name", F.col("id").alias("_winner"))
    joined = models.join(winners, "name", "left").join(
        accepted.select("id", F.lit(True).alias("_accepted")), "id", "left")
    wins = F.coalesce(F.col("id") == F.col("_winner"), F.lit(False))
    retired = F.coalesce(
        F.col("_winner").isNotNull() & (F.col("is_default") | F.col("_accepted").isNotNull()), F.lit(False)) & ~wins
    changes = {
        "status": F.when(wins, F.lit(DEPLOYED)).when(retired, F.lit(DEPRECATED)).otherwise(F.col("status")),
        "is_default": F.when(wins, F.lit(True)).when(retired, F.lit(False)).otherwise(F.col("is_default")),
    }
    if as_of is not None and "updated_at" in models.columns:
        saved = F.col("_accepted").isNotNull()
        changes["updated_at"] = F.when(saved, _stamp(models, "updated_at", as_of)).otherwise(F.col("updated_at"))
    return joined.withColumns(changes).select(*models.columns), refused


def dated(df: DataFrame, column: str = "created_at", date_column: str = "created_date") -> DataFrame:
    """Add the date that append-only tables are partitioned by."""
    return df.withColumn(date_column, utc_day(F.col(column)))


def append_rows(df: DataFrame, path: str, column: str = "created_at", date_column: str = "created_date") -> None:
    """Append to a Parquet table partitioned by date.

    Rows of one date are kept together, but a large date may still use many
    tasks, so a batch with a single date is not written by one.
    """
    spread = dated(df, column, date_column).hint("rebalance", date_column)
    spread.write.mode("append").partitionBy(date_column).parquet(path)


def recent_partitions(spark: SparkSession, path: str, as_of, days: int, date_column: str = "created_date") -> DataFrame:
    """Rows of an append-only table in the partitions a look-back window can touch."""
    since = (as_instant(as_of) - timedelta(days=days)).date()
    return spark.read.parquet(path).filter(F.col(date_column) >= F.lit(since))
