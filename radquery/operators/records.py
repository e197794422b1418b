"""Uploads to records: for each accepted one a scan, a prediction and a report, for each other one a rejection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radquery import schemas
from radquery.operators import keys, predict, store
from radquery.operators.report import SYSTEM, report
from radquery.sources.tables import read_table

#: Fixed values.
SCAN_TYPE, GENERATED_BY = "X-Ray", "AI System"


def uuid_of(kind: str, key: Column) -> Column:
    """A text in the form of a UUID that a record's key decides, so that a batch that runs again gives the same one."""
    return F.regexp_replace(F.md5(F.concat(F.lit(f"{kind}:"), key.cast("string"))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def with_patients(rows: DataFrame, folder: str, batch: str) -> DataFrame:
    """Adds ``patient``: the id of the record whose patient_id the row names, that of the default record where it names none,
    and null where there is no such record. The default record is made when it is first needed."""
    spark = rows.sparkSession
    named = F.nullif(F.col("patient_id"), F.lit(""))
    if not rows.where(named.isNull()).isEmpty():
        missing = store.missing_default(read_table(spark, folder, "patients")).withColumn("created_at", F.current_timestamp())
        keys.append_numbered(missing, folder, "patients", f"default-{batch}", schemas.PATIENTS)
    patients = read_table(spark, folder, "patients").select(F.col("patient_id").alias("_named"), F.col("id").alias("_patient"))
    default = patients.where(F.col("_named") == store.DEFAULT_PATIENT).first()
    joined = rows.join(patients, named == F.col("_named"), "left")  # rows without a name, maybe most, meet no key
    return joined.withColumn("patient", F.when(named.isNull(), F.lit(default["_patient"] if default else None)).otherwise(F.col("_patient"))).drop("_named", "_patient")


def write_records(rows: DataFrame, folder: str, batch: str, order: list[Column], system: str = SYSTEM, made: Callable[[DataFrame], DataFrame] = predict.predictions) -> DataFrame:
    """Writes the three records of each row, which has patient, filename, size_bytes, scan_type, notes, at (a time), and what
    ``made`` adds a prediction's columns from. Returns the rows with ``image_path``, where a scan's file belongs.

    Rows are numbered before predictions are made, so the wide columns of these go to their table alone, and reports are made
    from there. Scans come first and reports last, and a batch that runs again writes the same rows in the same place, so after any
    failure no record lacks the one that it refers to.
    """
    spark = rows.sparkSession
    rows = keys.numbered(rows, order, "_id")
    n = rows.count()
    if not n:
        return rows.withColumn("image_path", F.lit(None).cast("string"))
    first = keys.reserve(spark, folder, batch, ["lung_scans", "predictions", "reports"], n)
    scan, prediction, number = F.col("_id") + first[0], F.col("_id") + first[1], F.col("id") + (first[2] - first[1])
    scan_id, prediction_id, report_id = uuid_of("scan", scan), uuid_of("prediction", prediction), uuid_of("report", number)
    name = F.coalesce(F.nullif("filename", F.lit("")), F.lit("upload.jpg"))
    path = F.concat(F.lit(f"{folder}/uploads/batch={batch}/"), scan_id, F.lit("_"), F.element_at(F.split(name, "/"), -1))
    scans = rows.select(
        scan.alias("id"), scan_id.alias("scan_id"), F.col("patient").alias("patient_id"), path.alias("image_path"), name.alias("image_filename"),
        F.col("size_bytes").alias("image_size_bytes"), F.coalesce(F.nullif("scan_type", F.lit("")), F.lit(SCAN_TYPE)).alias("scan_type"), F.col("at").alias("scan_date"), F.lit(True).alias("preprocessed"), "notes",
    )
    keys.write_batch(scans, folder, "lung_scans", batch, schemas.LUNG_SCANS)
    predictions = made(rows).withColumns({"id": prediction, "prediction_id": prediction_id, "scan_id": scan, "created_at": F.col("at")})
    keys.write_batch(predictions, folder, "predictions", batch, schemas.PREDICTIONS)
    written = keys.read_batch(spark, folder, "predictions", batch, schemas.PREDICTIONS)
    reports = written.select(number.alias("id"), report_id.alias("report_id"), F.col("id").alias("prediction_id"), report(report_id, F.col("created_at"), system).alias("report_content"), F.lit(GENERATED_BY).alias("generated_by"), F.lit(False).alias("is_reviewed"), "created_at")
    keys.write_batch(reports, folder, "reports", batch, schemas.REPORTS)
    return rows.withColumn("image_path", path)


def write_rejections(rows: DataFrame, folder: str, batch: str) -> None:
    """Rows with filename, patient_id, code and reason."""
    keys.write_batch(rows, folder, "rejections", batch, schemas.REJECTIONS)


def reason(code: Column, patient_id: Column, mime: Column) -> Column:
    """Fixed texts, by code."""
    return (
        F.when(code == 404, F.concat(F.lit("Patient '"), patient_id, F.lit("' not found. Register the patient first.")))
        .when(code == 413, "File too large. Maximum size is 10 MB.")
        .when(mime.isin(*store.MIME_TYPES), "Invalid image: Could not decode image from bytes.")
        .otherwise(F.concat(F.lit("Unsupported file type: "), F.coalesce(mime, F.lit("None")), F.lit(". Accepted: JPEG, PNG, BMP, TIFF, WebP")))
    )
