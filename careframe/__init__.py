"""careframe: health-risk screening analytics on Spark DataFrames."""

from careframe.functions.features import feature_columns
from careframe.functions.predicates import active_only, lookback, optional_eq, optional_flag, search
from careframe.functions.scalars import age_band, age_years, risk_level
from careframe.operators.audit import audit_from_requests
from careframe.operators.clean import Rule, clean
from careframe.operators.dashboards import (
    audit_summary, county_breakdown, daily_trend, dashboard, dashboard_table, prediction_stats, risk_distribution,
)
from careframe.operators.engineer import Transform, engineer
from careframe.operators.geo import county_summary, facility_coverage, heatmap, risk_zones
from careframe.operators.governance import consented, enforce_retention
from careframe.operators.lookups import history, list_patients, lookup, newest, page, page_after
from careframe.operators.period_report import period_report
from careframe.operators.profile import column_profile
from careframe.operators.scoring import LinearRiskModel, RiskModel, score, score_batch
from careframe.operators.tables import (
    append_rows, append_validated, apply_feedback, deactivate, patch, promote, upsert,
)
from careframe.operators.validate import validate
from careframe.session import build_session, cut_lineage
from careframe.sources.patient_csv import coerce_patients, ingest_stats, read_patient_csv

__all__ = [
    "LinearRiskModel", "RiskModel", "Rule", "Transform", "active_only", "age_band", "age_years", "append_rows",
    "append_validated", "apply_feedback", "audit_from_requests", "audit_summary", "build_session", "clean",
    "coerce_patients", "column_profile", "consented", "county_breakdown", "county_summary", "cut_lineage", "daily_trend",
    "dashboard", "dashboard_table", "deactivate", "enforce_retention", "engineer", "facility_coverage",
    "feature_columns", "heatmap", "history", "ingest_stats", "list_patients", "lookback", "lookup", "newest",
    "optional_eq", "optional_flag", "page", "page_after", "patch", "period_report", "prediction_stats", "promote",
    "read_patient_csv", "risk_distribution", "risk_level", "risk_zones", "score", "score_batch", "search", "upsert",
    "validate",
]
