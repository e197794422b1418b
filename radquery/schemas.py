"""Schemas of the stored tables, as Spark DDL."""

PATIENTS = "id bigint, patient_id string, name string, age int, gender string, contact string, email string, medical_history string, created_at timestamp, updated_at timestamp"
LUNG_SCANS = "id bigint, scan_id string, patient_id bigint, image_path string, image_filename string, image_size_bytes bigint, scan_type string, scan_date timestamp, preprocessed boolean, notes string"
_MODEL = "{0}_primary_condition string, {0}_confidence double, {0}_accuracy double, {0}_all_probabilities map<string, double>"
PREDICTIONS = (
    "id bigint, prediction_id string, scan_id bigint, model_used string, selected_model string, "
    f"{_MODEL.format('cnn')}, {_MODEL.format('resnet')}, final_condition string, final_confidence double, urgency_level string, "
    "alternative_conditions array<string>, key_findings array<struct<label: string, value: string>>, precautions array<string>, created_at timestamp"
)
_RATES = "accuracy double, precision double, recall double, f1_score double, auc_roc double"
MODEL_METRICS = (
    f"id bigint, model_name string, version string, {_RATES}, training_loss array<double>, validation_loss array<double>, "
    "confusion_matrix array<array<bigint>>, class_names array<string>, training_samples int, test_samples int, epochs int, trained_at timestamp, is_active boolean"
)
REPORTS = "id bigint, report_id string, prediction_id bigint, report_content string, generated_by string, reviewed_by string, review_notes string, is_reviewed boolean, created_at timestamp"
REJECTIONS = "filename string, patient_id string, code int, reason string"
DATASET_INDEX = "image_path string, label string, filename string, length bigint"
_RESULT = f"model_name string, {_RATES}, confusion_matrix array<array<bigint>>, class_names array<string>, training_loss array<double>, validation_loss array<double>, training_accuracy array<double>, validation_accuracy array<double>"
METRICS_DOCUMENT = ", ".join(f"{m} struct<{', '.join(f'{a}: {b}' for a, b in (x.split(' ', 1) for x in _RESULT.split(', ')))}>" for m in ("cnn", "resnet")) + ", selected_model string, class_names array<string>"
