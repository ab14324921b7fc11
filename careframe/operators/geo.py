"""Heatmaps, county summaries, risk zones and facility coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from careframe.functions.predicates import is_high, lookback, optional_eq
from careframe.functions.scalars import risk_level
from careframe.operators.keyed import spread_join

# Coordinates of known counties, and of any other.
COUNTY_COORDINATES = {
    "Nairobi": (-1.2921, 36.8219),
    "Mombasa": (-4.0435, 39.6682),
    "Kisumu": (-0.0917, 34.7680),
    "Nakuru": (-0.3031, 36.0800),
}
DEFAULT_COORDINATES = (-0.5, 37.0)
NO_COUNTY = "Unknown"
JITTER_STEPS, JITTER_SCALE = 1000, 10000

EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.0
CELL_ROW = 1_000_000_000  # more than the columns of any grid in use


def coordinate(county: Column, axis: int, coords: dict[str, tuple[float, float]] | None = None) -> Column:
    """Latitude (axis 0) or longitude (axis 1) of an exactly spelled county."""
    known = COUNTY_COORDINATES if coords is None else coords
    table = F.create_map(*[F.lit(v) for name, place in known.items() for v in (name, place[axis])])
    return F.coalesce(F.try_element_at(table, county), F.lit(DEFAULT_COORDINATES[axis]))


def jitter(text: Column) -> Column:
    """Small offset that depends on the text only, so reruns agree."""
    return F.pmod(F.crc32(F.encode(text, "UTF-8")), F.lit(JITTER_STEPS)) / F.lit(float(JITTER_SCALE))


def _place_sums(predictions: DataFrame, patients: DataFrame, as_of, days: int, by: list[str]) -> DataFrame:
    """Prediction sums of a window per place.  Predictions are summed per patient
    first, so each patient joins once and counting rows counts patients."""
    recent = lookback(predictions, "created_at", as_of, days)
    level = F.col("risk_level")
    sums = recent.groupBy("patient_key").agg(
        F.sum("risk_score").alias("score_sum"), F.count("risk_score").alias("score_n"),
        F.count_if(is_high(level)).alias("high_n"), F.count_if(level == "moderate").alias("moderate_n"),
        F.count_if(level == "low").alias("low_n"))
    placed = sums.join(patients.select(F.col("id").alias("patient_key"), *by), "patient_key")
    return placed.groupBy(*by).agg(
        F.try_divide(F.sum("score_sum"), F.sum("score_n")).alias("avg_risk"), F.count("*").alias("patient_n"),
        F.sum("high_n").alias("high_n"), F.sum("moderate_n").alias("moderate_n"), F.sum("low_n").alias("low_n"))


def heatmap(
    predictions: DataFrame, patients: DataFrame, as_of, days: int = 90, county: str | None = None,
    coords: dict[str, tuple[float, float]] | None = None, with_jitter: bool = True, top: int = 50,
) -> DataFrame:
    """Points of the riskiest (county, sub-county) places of the window."""
    people = optional_eq(patients, "county", county, ci=True)
    places = _place_sums(predictions, people, as_of, days, ["county", "sub_county"])
    top_places = places.orderBy(F.desc("avg_risk"), "county", "sub_county").limit(top)
    name = F.coalesce(F.nullif(F.col("county"), F.lit("")), F.lit(NO_COUNTY))
    sub = F.coalesce("sub_county", F.lit(""))
    shift = jitter if with_jitter else (lambda _: F.lit(0.0))
    return top_places.select(
        (coordinate(name, 0, coords) + shift(name)).alias("lat"),
        (coordinate(name, 1, coords) + shift(sub)).alias("lng"),
        F.round("avg_risk", 3).alias("intensity"), name.alias("county"), sub.alias("sub_county"),
        F.col("patient_n").alias("patient_count"), F.col("high_n").alias("high_risk_count"))


def county_summary(patients: DataFrame, predictions: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Per county: patients predicted in the window, mean score, predictions per level group."""
    return _place_sums(predictions, patients, as_of, days, ["county"]).select(
        "county", F.col("patient_n").alias("total_patients"), "avg_risk", F.col("high_n").alias("high_risk"),
        F.col("moderate_n").alias("moderate_risk"), F.col("low_n").alias("low_risk"),
    ).orderBy(F.desc("avg_risk"), "county")


def risk_zones(patients: DataFrame, predictions: DataFrame, period: str = "month") -> DataFrame:
    """Zones per county, sub-county and period: mean score and its level, patients, screenings, positives.

    The mean is over predictions that have a score.  ``population_at_risk`` counts distinct patients: predictions are first
    reduced to one row per patient and period.
    """
    if period not in ("week", "month", "quarter", "year"):
        raise ValueError(f"unknown period {period!r}")
    start = F.date_trunc(period, F.col("created_at")).cast("date")
    sums = predictions.groupBy("patient_key", start.alias("period_start")).agg(
        F.sum("risk_score").alias("score_sum"), F.count("risk_score").alias("score_n"), F.count("*").alias("n"),
        F.count_if(F.col("actual_outcome") == "positive").alias("positive_n"))
    placed = sums.join(patients.select(F.col("id").alias("patient_key"), "county", "sub_county"), "patient_key")
    zones = placed.groupBy("county", "sub_county", "period_start").agg(
        F.try_divide(F.sum("score_sum"), F.sum("score_n")).alias("risk_score"), F.count("*").alias("population_at_risk"),
        F.sum("n").alias("total_screenings"), F.sum("positive_n").alias("positive_cases"))
    return zones.withColumns({
        "name": F.concat_ws(" / ", "county", "sub_county"),
        "risk_level": risk_level(F.col("risk_score")),
        "period_end": period_end(F.col("period_start"), period),
    })


def period_end(start: Column, period: str) -> Column:
    """Last day of the period that begins on ``start``."""
    if period == "week":
        return F.date_add(start, 6)
    months = {"month": 1, "quarter": 3, "year": 12}[period]
    return F.date_sub(F.add_months(start, months), 1)


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance."""
    half_lat, half_lng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    root = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lng), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), root)))


def facility_coverage(places: DataFrame, facilities: DataFrame, cell_degrees: float = 0.25) -> DataFrame:
    """Population within the service radius of each facility.

    ``places`` holds ``latitude``, ``longitude`` and ``population``.  Points
    are added up per coordinate first; a facility is listed under every grid
    cell its radius touches, cells are matched by equality, and the distance
    decides.  Only (facility, nearby coordinate) pairs are ever formed.
    """
    spots = places.groupBy("latitude", "longitude").agg(F.sum("population").alias("population"))
    spots = spots.withColumn("_cell", _cell(F.col("latitude"), F.col("longitude"), cell_degrees))

    lat, lng, reach = F.col("f_lat"), F.col("f_lng"), F.col("service_radius_km")
    span_lat = reach / F.lit(KM_PER_DEGREE)
    # Meridians draw closer toward the poles; take the wider edge of the circle.
    widest = F.cos(F.radians(F.least(F.lit(89.0), F.abs(lat) + span_lat)))
    span_lng = F.least(F.lit(180.0), span_lat / widest)
    size = F.lit(cell_degrees)

    def steps(low: Column, high: Column) -> Column:
        return F.sequence(F.floor(low / size), F.floor(high / size))

    def around(low: Column, high: Column) -> Column:
        # A circle that crosses the date line goes on at the other edge of the grid.
        parts = []
        for turn in (-360.0, 0.0, 360.0):
            west, east = F.greatest(low + turn, F.lit(-180.0)), F.least(high + turn, F.lit(180.0))
            parts.append(F.when(west <= east, steps(west, east)).otherwise(F.array().cast("array<bigint>")))
        return F.array_distinct(F.concat(*parts))

    row, column = F.col("_row"), F.col("_column")

    sites = facilities.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
        F.col("id").alias("facility_id"), F.col("latitude").alias("f_lat"), F.col("longitude").alias("f_lng"), reach)
    listed = (sites.withColumn("_row", F.explode(steps(lat - span_lat, lat + span_lat)))
              .withColumn("_column", F.explode(around(lng - span_lng, lng + span_lng)))
              .withColumn("_cell", _cell_number(row, column)).drop("_row", "_column"))
    near = spread_join(spots, listed, "_cell", unique=False)
    within = near.filter(haversine_km(lat, lng, F.col("latitude"), F.col("longitude")) <= reach)
    totals = within.groupBy("facility_id").agg(
        F.sum("population").alias("population"), F.count("*").alias("places"))
    return sites.select("facility_id").join(totals, "facility_id", "left").fillna(0, ["population", "places"])


def _cell(latitude: Column, longitude: Column, size: float) -> Column:
    return _cell_number(F.floor(latitude / F.lit(size)), F.floor(longitude / F.lit(size)))


def _cell_number(row: Column, column: Column) -> Column:
    return row * F.lit(CELL_ROW) + column
