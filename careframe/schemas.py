"""Column layouts of the domain tables."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

TEXT, WHOLE, KEY, NUMBER = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
FLAG, DAY, TIME = T.BooleanType(), T.DateType(), T.TimestampType()
TEXT_MAP, NUMBER_MAP = T.MapType(TEXT, TEXT), T.MapType(TEXT, NUMBER)
TEXT_LIST = T.ArrayType(TEXT)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


PATIENT = _table(
    id=KEY, patient_id=TEXT, first_name=TEXT, last_name=TEXT, date_of_birth=DAY, gender=TEXT, phone=TEXT, email=TEXT,
    address=TEXT, marital_status=TEXT, number_of_partners_12m=WHOLE, number_of_partners_lifetime=WHOLE,
    condom_use_frequency=NUMBER, substance_use=FLAG, substance_type=TEXT, prior_sti_history=FLAG, prior_sti_types=TEXT,
    hiv_status_known=FLAG, hiv_status=TEXT, symptoms_present=FLAG, symptom_description=TEXT, county=TEXT,
    sub_county=TEXT, ward=TEXT, created_at=TIME, updated_at=TIME, is_active=FLAG,
)
PATIENT_VISIT = _table(
    id=KEY, patient_key=KEY, visit_date=TIME, visit_type=TEXT, facility=TEXT, clinician_notes=TEXT,
    tests_conducted=TEXT_MAP, test_results=TEXT_MAP,
)
FACILITY = _table(
    id=KEY, name=TEXT, code=TEXT, county=TEXT, sub_county=TEXT, ward=TEXT, latitude=NUMBER, longitude=NUMBER,
    facility_type=TEXT, is_active=FLAG,
)
CLINICIAN = _table(
    id=KEY, username=TEXT, full_name=TEXT, staff_id=TEXT, phone=TEXT, role=TEXT, facility_id=KEY, license_number=TEXT,
    is_active=FLAG, created_at=TIME,
)
RISK_PREDICTION = _table(
    id=KEY, patient_key=KEY, clinician_id=KEY, sti_type=TEXT, risk_score=NUMBER, risk_level=TEXT,
    confidence_interval_lower=NUMBER, confidence_interval_upper=NUMBER, top_risk_factors=TEXT_MAP,
    input_features=NUMBER_MAP, model_version=TEXT, model_name=TEXT, recommended_tests=TEXT_LIST,
    recommended_actions=TEXT, validated_by_clinician=FLAG, clinician_notes=TEXT, actual_outcome=TEXT, created_at=TIME,
)
MODEL_PERFORMANCE = _table(
    model_version=TEXT, sti_type=TEXT, auc_roc=NUMBER, precision=NUMBER, recall=NUMBER, f1_score=NUMBER,
    accuracy=NUMBER, calibration_slope=NUMBER, brier_score=NUMBER, evaluated_on=DAY, sample_size=KEY,
)
CLEANING_RULE = _table(
    id=KEY, name=TEXT, field_name=TEXT, rule_type=TEXT, condition=TEXT, action=TEXT, is_active=FLAG, created_at=TIME,
)
FEATURE_TRANSFORM = _table(
    id=KEY, name=TEXT, source_field=TEXT, transform_type=TEXT, parameters=TEXT, output_field=TEXT, is_active=FLAG,
)
MODEL = _table(
    id=KEY, name=TEXT, version=TEXT, model_type=TEXT, description=TEXT, model_file=TEXT, scaler_file=TEXT,
    metadata_file=TEXT, hyperparameters=TEXT_MAP, training_accuracy=NUMBER, validation_accuracy=NUMBER,
    test_auc_roc=NUMBER, test_f1=NUMBER, status=TEXT, is_default=FLAG, training_data_size=WHOLE,
    training_started_at=TIME, training_completed_at=TIME, training_duration_seconds=WHOLE, created_by=TEXT,
    created_at=TIME, updated_at=TIME,
)
TRAINING_JOB = _table(
    id=KEY, model_id=KEY, status=TEXT, dataset_path=TEXT, test_size=NUMBER, random_state=WHOLE,
    cross_validation_folds=WHOLE, error_message=TEXT, started_at=TIME, completed_at=TIME, created_at=TIME,
)
DATA_SOURCE = _table(
    id=KEY, name=TEXT, source_type=TEXT, description=TEXT, schedule=TEXT, is_active=FLAG, last_ingested_at=TIME,
    created_at=TIME,
)
INGESTION_JOB = _table(
    id=KEY, source_id=KEY, status=TEXT, uploaded_file=TEXT, total_records=KEY, processed_records=KEY,
    failed_records=KEY, error_log=TEXT, started_at=TIME, completed_at=TIME, created_at=TIME,
)
RISK_ZONE = _table(
    id=KEY, name=TEXT, county=TEXT, sub_county=TEXT, ward=TEXT, boundary=TEXT, centroid=TEXT, risk_level=TEXT,
    risk_score=NUMBER, population_at_risk=KEY, total_screenings=KEY, positive_cases=KEY, period_start=DAY,
    period_end=DAY, created_at=TIME,
)
FACILITY_LOCATION = _table(facility_id=KEY, catchment_area=TEXT, service_radius_km=NUMBER)
REPORT_TEMPLATE = _table(
    id=KEY, name=TEXT, report_type=TEXT, description=TEXT, query_config=TEXT_MAP, output_formats=TEXT_LIST,
    is_active=FLAG, created_at=TIME,
)
GENERATED_REPORT = _table(
    id=KEY, template_id=KEY, title=TEXT, period_start=DAY, period_end=DAY, county_filter=TEXT, facility_filter=TEXT,
    status=TEXT, file_path=TEXT, file_size_bytes=KEY, total_screenings=KEY, total_positive=KEY, total_high_risk=KEY,
    generated_by=TEXT, generated_at=TIME,
)
AUDIT_LOG = _table(
    id=KEY, user_id=KEY, user_name=TEXT, action=TEXT, resource_type=TEXT, resource_id=TEXT, description=TEXT,
    ip_address=TEXT, user_agent=TEXT, previous_state=TEXT_MAP, new_state=TEXT_MAP, consent_obtained=FLAG,
    consent_type=TEXT, created_at=TIME,
)
RETENTION_POLICY = _table(
    id=KEY, data_type=TEXT, retention_days=WHOLE, anonymize_after_days=WHOLE, description=TEXT, is_active=FLAG,
)
PATIENT_CONSENT = _table(
    id=KEY, patient_key=KEY, consent_type=TEXT, granted=FLAG, granted_at=TIME, expires_at=TIME, document_version=TEXT,
    witness_name=TEXT, notes=TEXT, created_at=TIME,
)

TABLES: dict[str, T.StructType] = {
    "patient": PATIENT, "patient_visit": PATIENT_VISIT, "facility": FACILITY, "clinician": CLINICIAN,
    "risk_prediction": RISK_PREDICTION, "model_performance": MODEL_PERFORMANCE, "cleaning_rule": CLEANING_RULE,
    "feature_transform": FEATURE_TRANSFORM, "model": MODEL, "training_job": TRAINING_JOB, "data_source": DATA_SOURCE,
    "ingestion_job": INGESTION_JOB, "risk_zone": RISK_ZONE, "facility_location": FACILITY_LOCATION,
    "report_template": REPORT_TEMPLATE, "generated_report": GENERATED_REPORT, "audit_log": AUDIT_LOG,
    "retention_policy": RETENTION_POLICY, "patient_consent": PATIENT_CONSENT,
}

# Accepted values of the choice columns.
CHOICES: dict[str, dict[str, tuple[str, ...]]] = {
    "patient": {
        "gender": ("M", "F", "O", "U"),
        "marital_status": ("single", "married", "divorced", "widowed", "cohabiting"),
        "hiv_status": ("negative", "positive", "unknown"),
    },
    "patient_visit": {"visit_type": ("screening", "follow_up", "treatment", "counseling")},
    "facility": {"facility_type": ("hospital", "health_center", "dispensary", "clinic")},
    "clinician": {"role": ("doctor", "nurse", "clinical_officer", "lab_tech", "counselor", "admin")},
    "risk_prediction": {
        "sti_type": ("hiv", "syphilis", "gonorrhea", "chlamydia", "hepatitis_b", "hpv", "general"),
        "risk_level": ("low", "moderate", "high", "very_high"),
    },
    "audit_log": {"action": ("create", "read", "update", "delete", "predict", "export", "login", "logout")},
}


def choice_errors(table: str) -> Column:
    """Names of the choice columns holding a value that is not accepted."""
    checks = [F.when(~F.col(name).isin(*values), F.lit(name)) for name, values in CHOICES.get(table, {}).items()]
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
