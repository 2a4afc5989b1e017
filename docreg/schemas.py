"""Declared schemas of the registry tables (decimals are read as doubles)."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _S, _D, _B, _I, _TS = (
    T.LongType(), T.StringType(), T.DoubleType(), T.BooleanType(), T.IntegerType(), T.TimestampType(),
)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in columns.items()])


#: A document or a layout may carry at most this many fields.
MAX_FIELDS = 450

ROLES = _schema(id=_L, slug=_S, name=_S, description=_S)
USERS = _schema(
    id=_L, name=_S, email=_S, role_id=_L, is_active=_B, must_change_password=_B,
    last_login_at=_TS, password_changed_at=_TS, created_by=_L, created_at=_TS, updated_at=_TS,
)
DOCUMENT_TYPES = _schema(id=_L, key=_S, name=_S, short_name=_S, icon=_S, is_system=_B)
DOCUMENT_TEMPLATES = _schema(
    id=_L, name=_S, doc_type=_S, document_type_id=_L, description=_S, grouping_mode=_S,
    paper_size=_S, orientation=_S, custom_width_mm=_D, custom_height_mm=_D, is_active=_B, created_by=_L,
)
TEMPLATE_FIELDS = _schema(
    id=_L, document_template_id=_L, name=_S, person_group=_I, person_field_order=_I,
    x=_D, y=_D, width=_D, height=_D, sort_order=_I, is_required=_B,
)
RECORDS = _schema(
    id=_L, doc_type=_S, document_type_id=_L, document_template_id=_L, registry_number=_S, status=_S,
    scan_path=_S, scan_mime=_S, ocr_model_key=_S, created_by=_L, submitted_by=_L, submitted_at=_TS,
    created_at=_TS, updated_at=_TS,
)
RECORD_FIELDS = _schema(
    id=_L, record_id=_L, name=_S, ocr_text=_S, ocr_confidence=_D, verified_value=_S, is_required=_B,
    person_group=_I, person_field_order=_I, x=_D, y=_D, width=_D, height=_D, sort_order=_I,
)
CHANGE_REQUESTS = _schema(
    id=_L, record_id=_L, status=_S, reason=_S, changes_registry_number=_B, current_registry_number=_S,
    proposed_registry_number=_S, requested_by=_L, reviewed_by=_L, reviewed_at=_TS, decision_note=_S,
    created_at=_TS, updated_at=_TS,
)
CHANGE_REQUEST_ITEMS = _schema(
    id=_L, change_request_id=_L, record_field_id=_L, current_value=_S, proposed_value=_S,
)
AUDIT_LOGS = _schema(
    id=_L, user_id=_L, actor_name=_S, actor_role=_S, action=_S, auditable_type=_S, auditable_id=_L,
    description=_S, old_values=_S, new_values=_S, ip_address=_S, user_agent=_S, created_at=_TS,
)
OCR_MODELS = _schema(
    id=_L, key=_S, label=_S, is_active=_B, cer=_D, wer=_D, exact_match=_D, evaluated_at=_TS,
    evaluation_dataset=_S, evaluation_split=_S, evaluation_sample_count=_L,
    evaluation_manifest_sha256=_S, evaluation_weights_sha256=_S, disk_deleted_at=_TS,
)
OCR_SETTINGS = _schema(id=_L, allow_staff_model_choice=_B, confidence_review_threshold=_D)

TABLES: dict[str, T.StructType] = {
    "roles": ROLES,
    "users": USERS,
    "document_types": DOCUMENT_TYPES,
    "document_templates": DOCUMENT_TEMPLATES,
    "document_template_fields": TEMPLATE_FIELDS,
    "records": RECORDS,
    "record_fields": RECORD_FIELDS,
    "change_requests": CHANGE_REQUESTS,
    "change_request_items": CHANGE_REQUEST_ITEMS,
    "audit_logs": AUDIT_LOGS,
    "ocr_models": OCR_MODELS,
    "ocr_settings": OCR_SETTINGS,
}

MANIFEST_COLUMNS = ("filename", "label", "split", "source")

EVALUATION_REPORT = T.StructType([
    T.StructField("schema_version", _S), T.StructField("model_key", _S), T.StructField("dataset", _S),
    T.StructField("manifest_sha256", _S), T.StructField("split", _S), T.StructField("sample_count", _S),
    T.StructField("metrics", T.StructType([
        T.StructField("cer", _S), T.StructField("wer", _S), T.StructField("exact_match", _S),
    ])),
    T.StructField("evaluated_at", _S), T.StructField("weights_file", _S), T.StructField("weights_sha256", _S),
])

CAPTURED_FIELD = T.StructType([
    T.StructField("name", _S), T.StructField("ocr_text", _S), T.StructField("ocr_confidence", _D),
    T.StructField("verified_value", _S), T.StructField("verified", _B), T.StructField("person_group", _I),
    T.StructField("person_field_order", _I), T.StructField("x", _D), T.StructField("y", _D),
    T.StructField("width", _D), T.StructField("height", _D),
])
